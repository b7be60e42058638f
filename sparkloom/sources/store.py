"""Tables at rest: vector collections, the benchmark table, reports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas, scratch
from sparkloom.operators import upsert as U


class Collection:
    """A Parquet table of chunks with vectors. Appends are new files; a replaced table is a new version beside the old one."""

    def __init__(self, spark: SparkSession, path: str, schema: str = schemas.CHUNK):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def insert(self, chunks: DataFrame, key: str = "chunk_id", order: list[str] | None = None) -> None:
        """Append chunks that have a vector; of equal ids the first stays, by `order` or as the frame has them, and the table's."""
        by = F.struct(*([F.col(c) for c in order] if order else [F.monotonically_increasing_id()]))
        new = U.with_vectors(chunks)
        row = F.struct(*new.columns)
        new = new.withColumn("__order", by).groupBy(F.col(key).alias("__key")).agg(F.min_by(row, "__order").alias("r")).select("r.*")
        known = self.read().select(key)
        new = new.join(known, key, "left_anti").select(*[f.name for f in self.read().schema])
        new.write.mode("append").parquet(self.path)

    def metadata(self) -> DataFrame:
        return self.read().drop("embedding", "text")

    def peek(self, n: int = 5) -> DataFrame:
        return self.read().orderBy("chunk_id").limit(n)


@contextmanager
def passing_collection(spark: SparkSession, schema: str = schemas.CHUNK) -> Iterator[Collection]:
    """A collection in the shared folder for as long as one model is tried, then deleted."""
    where = scratch.path(spark, "collection")
    try:
        yield Collection(spark, where, schema)
    finally:
        scratch.release(where)


class Keyed:
    """A Parquet table by key, of which the last write of a key wins.

    A save adds one change set, numbered by `seq`: files by hash bucket of the key, of the buckets only that it has rows of.
    Reading takes each key's row of the greatest number, merged bucket by bucket; compact() merges the files of single
    buckets, and vacuum() deletes change sets that all their buckets have been compacted beyond. A change set counts
    once it is complete. Numbers go up; saving one that isn't above the last changes nothing, so a replayed batch does no harm.
    One writer at a time.

    Within a save, the last of a key's rows by `order` stays: columns that tell them apart, or, if none are given, the order in
    which the frame has its rows (which is defined only where the frame's rows are in a defined order).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = schemas.BENCHMARK_QA, key: str = "id", buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the complete tables below a folder."""
        where, files = scratch.hadoop_path(self.spark, folder), scratch.files_of(self.spark, self.path)
        if not files.exists(where):
            return []
        names = [x.getPath().getName() for x in files.listStatus(where)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and files.exists(scratch.hadoop_path(self.spark, folder, n, "_SUCCESS")))

    def _delete(self, *parts: str) -> None:
        scratch.files_of(self.spark, self.path).delete(scratch.hadoop_path(self.spark, *parts), True)

    def changes(self) -> list[int]:
        return self._numbers(f"{self.path}/changes", "seq=")

    def _names(self, folder: str, prefix: str) -> list[int]:
        where, files = scratch.hadoop_path(self.spark, folder), scratch.files_of(self.spark, self.path)
        names = [x.getPath().getName() for x in files.listStatus(where)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def compacted(self) -> dict[int, tuple[int, int]]:
        """For each merged bucket the last run that merged it, and up to which number."""
        out = {}
        for run in self._numbers(f"{self.path}/merged", "run="):
            for upto in self._names(f"{self.path}/merged/run={run}", "upto="):
                out.update({b: (run, upto) for b in self._names(f"{self.path}/merged/run={run}/upto={upto}", "bucket=")})
        return out

    def save(self, rows: DataFrame, seq: int | None = None, order: list[str] | None = None) -> int:
        """Insert or replace by key; returns the change set's number, by default the next one."""
        done = self.changes()
        if seq is None:
            seq = (done or [0])[-1] + 1
        elif done and seq <= done[-1]:  # numbers go up, and the last one is never deleted
            return seq
        by = [F.col(c) for c in order] if order else [F.monotonically_increasing_id()]
        numbered = rows.withColumn("__order", F.struct(*by))
        row = F.struct(*(c if c in rows.columns else F.lit(None).alias(c) for c in self.columns))
        kept = numbered.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(row, "__order").alias("r")).select("r.*")
        kept.withColumn("bucket", self.bucket(self.key)).repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/changes/seq={seq}")
        return seq

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows that may be the last of their key, with bucket and seq."""
        names = [*self.columns, "bucket", "seq"]
        merged, chosen = self.compacted(), range(self.buckets) if buckets is None else buckets
        out = self.spark.createDataFrame([], f"{self.schema}, bucket int, seq long")
        done = self.changes()
        schema = self.spark.createDataFrame([], f"{self.schema}, seq long, bucket int").schema
        if done:
            new = self.spark.read.schema(schema).option("basePath", f"{self.path}/changes").parquet(*(f"{self.path}/changes/seq={n}" for n in done))
            upto = F.create_map(*(F.lit(x) for b, (_, n) in merged.items() for x in (b, n))) if merged else None
            new = new if upto is None else new.where(F.col("seq") > F.coalesce(F.try_element_at(upto, "bucket"), F.lit(-1)))
            out = out.unionByName(new.where(F.col("bucket").isin(list(chosen))).select(*names))
        old = [f"{self.path}/merged/run={run}/upto={n}/bucket={b}" for b, (run, n) in merged.items() if b in chosen]
        if old:
            read = self.spark.read.schema(self.spark.createDataFrame([], f"{self.schema}, run int, upto long, bucket int").schema).option("basePath", f"{self.path}/merged").parquet(*old)
            out = out.unionByName(read.withColumnRenamed("upto", "seq").select(*names))
        return out

    def read(self) -> DataFrame:
        return self._last(self._rows()).select(*self.columns)

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        return sorted(r["b"] for r in keys.select(self.bucket(keys.columns[0]).alias("b")).distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (one column), from the keys' buckets only."""
        rows = self._rows(self.buckets_of(keys)).join(keys.select(F.col(keys.columns[0]).alias(self.key)).distinct(), self.key, "left_semi")
        return self._last(rows).select(*self.columns)

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*self.columns), "seq").alias("r")).select("r.*", "bucket")

    def compact(self, buckets: list[int] | None = None, least: int = 2) -> list[int]:
        """Merge the change sets of buckets, by default of those with `least` or more of them; returns which were merged."""
        done, merged = self.changes(), self.compacted()
        if not done:
            return []
        files = scratch.files_of(self.spark, self.path)
        has = lambda b, n: files.exists(scratch.hadoop_path(self.spark, f"{self.path}/changes/seq={n}/bucket={b}"))
        if buckets is None:
            buckets = [b for b in range(self.buckets) if sum(n > merged.get(b, (0, -1))[1] and has(b, n) for n in done) >= least]
        if buckets:
            run = (self._numbers(f"{self.path}/merged", "run=") or [0])[-1] + 1
            rows = self._last(self._rows(list(buckets)))
            rows.withColumn("upto", F.lit(done[-1])).repartition(len(list(buckets)), "bucket").write.mode("overwrite").partitionBy("upto", "bucket").parquet(f"{self.path}/merged/run={run}")
        return list(buckets)

    def vacuum(self) -> None:
        """Delete what no read needs any more; not while an earlier read is under way."""
        merged, done = self.compacted(), self.changes()
        for run in self._numbers(f"{self.path}/merged", "run="):
            if all(r != run for r, _ in merged.values()):
                self._delete(f"{self.path}/merged/run={run}")
        for n in done[:-1]:  # numbers go on from the last one
            if all(merged.get(b, (0, -1))[1] >= n for b in self._names(f"{self.path}/changes/seq={n}", "bucket=")):
                self._delete(f"{self.path}/changes/seq={n}")


def table_size(spark: SparkSession, path: str) -> DataFrame:
    """(kilobytes) of all files below a path, from their listing; no file is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").agg((F.sum("length") / 1024).alias("kilobytes"))


def save_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_report(lines: DataFrame, path: str, line: str = "line", order: str = "pos") -> None:
    """Text lines in order, as one short file."""
    lines.orderBy(order).select(line).coalesce(1).write.mode("overwrite").text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)
