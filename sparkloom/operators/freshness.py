"""Staleness of nodes, kept up by deltas of deleted and added chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import scratch
from sparkloom.sources.store import Keyed


class SourceIndex:
    """From chunks to the nodes made of them, with each node's number of sources and of living ones.

    Links (chunk_id, node_id) are Parquet partitions by hash bucket of the chunk; the chunks' states and the nodes' counts
    are keyed tables. A delta reads the buckets of its own chunks, the links of those, and the counts of the nodes that
    they lead to; the result equals a full computation. Deleting what is gone, or adding what lives, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, chunk: str = "string", node: str = "string", buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.chunks = Keyed(spark, f"{path}/chunks", f"chunk_id {chunk}, alive boolean", "chunk_id", buckets)
        self.nodes = Keyed(spark, f"{path}/nodes", f"node_id {node}, n_sources long, n_alive long", "node_id", buckets)
        self.link_schema = spark.createDataFrame([], f"node_id {node}, chunk_id {chunk}, bucket int").schema

    def _links(self, buckets: list[int]) -> DataFrame:
        where = f"{self.path}/links"
        if not scratch.files_of(self.spark, where).exists(scratch.hadoop_path(self.spark, where)):
            return self.spark.createDataFrame([], self.link_schema)
        return self.spark.read.schema(self.link_schema).parquet(where).where(F.col("bucket").isin(buckets))

    def add_nodes(self, nodes: DataFrame) -> None:
        """Take in new nodes (node_id, source_chunks); chunks not heard of yet count as gone."""
        links = scratch.written(nodes.select("node_id", F.explode_outer("source_chunks").alias("chunk_id")), "links")
        known = links.where("chunk_id is not null").withColumn("bucket", self.chunks.bucket("chunk_id"))
        states = self.chunks.lookup(known.select("chunk_id")).where("alive").select("chunk_id", F.lit(1).alias("one"))
        counts = links.join(states, "chunk_id", "left").groupBy("node_id").agg(F.count("chunk_id").alias("n_sources"), F.count("one").alias("n_alive"))
        self.nodes.save(counts)
        known.select("node_id", "chunk_id", "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/links")

    def apply(self, delta: DataFrame) -> DataFrame:
        """Take in a delta (chunk_id, alive), one row for each chunk; returns the counts of the nodes that it changed."""
        before = self.chunks.lookup(delta.select("chunk_id")).select("chunk_id", F.col("alive").alias("was"))
        changed = delta.join(before, "chunk_id", "left").where(F.col("alive") != F.coalesce("was", F.lit(False)))
        changed = scratch.written(changed.select("chunk_id", "alive", F.when(F.col("alive"), 1).otherwise(-1).alias("step")), "delta")
        links = self._links(self.chunks.buckets_of(changed.select("chunk_id")))
        steps = scratch.written(links.join(changed, "chunk_id").groupBy("node_id").agg(F.sum("step").alias("step")).where("step != 0"), "steps")
        counts = self.nodes.lookup(steps.select("node_id")).join(steps, "node_id").select("node_id", "n_sources", (F.col("n_alive") + F.col("step")).alias("n_alive"))
        counts = scratch.written(counts, "counts")
        self.nodes.save(counts)
        self.chunks.save(changed.select("chunk_id", "alive"))
        return counts

    def staleness(self) -> DataFrame:
        """(node_id, n_sources, n_alive, ratio, is_stale, gone) of all nodes, as evolve.staleness() works them out in full."""
        ratio = F.coalesce(F.try_divide(F.col("n_alive").cast("double"), F.col("n_sources")), F.lit(0.0))
        return self.nodes.read().withColumn("ratio", ratio).withColumns({"is_stale": F.col("ratio") < 1, "gone": F.col("ratio") == 0})
