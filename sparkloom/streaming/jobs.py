"""Streaming forms of the stateful operators. Each is checked against its batch form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.evolve import SAME_QUERY

CLUSTER_STATE = "sums array<array<double>>, hits array<bigint>"


def source(spark: SparkSession, path: str, schema, name: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(path)


def event_time(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks take timestamps with a zone only."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(rows: DataFrame, key: str, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """First rows by key: for good, or with `ts` within a watermark, so that the state stays bounded."""
    if ts is None:
        return rows.dropDuplicates([key])
    return event_time(rows, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed(rows: DataFrame, by: list[str], length: str, slide: str | None = None, ts: str = "ts", delay: str = "1 hour", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = event_time(rows, ts).withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(rows: DataFrame, by: str, gap: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    out = event_time(rows, ts).withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def online_clusters(rows: DataFrame, shard: str, least: float = SAME_QUERY) -> DataFrame:
    """(shard, item_id, cluster): online clustering with its centroids as state, each shard for itself.

    rows: shard, item_id, pos, vector; within a micro-batch in the order of pos.
    """
    kinds = dict(rows.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        from sparkloom.operators.evolve import OnlineClusters

        c = OnlineClusters(least)
        if state.exists:
            sums, hits = state.get
            c.restore([(n, int(h), 0, s) for n, (s, h) in enumerate(zip(sums, hits))], len(hits))
        part = pd.concat(list(frames)).sort_values(["pos", "item_id"])
        names = [c.add(v) for v in part["vector"]]
        state.update((c.sums.tolist(), c.hits))
        yield pd.DataFrame({"shard": part[shard].to_numpy(), "item_id": part["item_id"].to_numpy(), "cluster": np.array(names, np.int32)})

    return rows.groupBy(shard).applyInPandasWithState(step, f"shard {kinds[shard]}, item_id {kinds['item_id']}, cluster int", CLUSTER_STATE, "append", "NoTimeout")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LivingClusters(StatefulProcessor):
    """The clusters of a shard as list state, and a timer for when the next one is idle for too long."""

    def __init__(self, least: float, moving: bool, idle: int):
        self.least, self.moving, self.idle = least, moving, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.living = handle.getListState("living", "number int, hits bigint, last bigint, centroid array<double>")
        self.following = handle.getValueState("following", "number int")

    def _load(self):
        from sparkloom.operators.evolve import OnlineClusters

        c = OnlineClusters(self.least, self.moving, self.idle)
        c.restore([tuple(r) for r in self.living.get()] if self.living.exists() else [], self.following.get()[0] if self.following.exists() else 0)
        return c

    def _save(self, c) -> None:
        rows = c.state()
        self.living.put(rows) if rows else self.living.clear()
        self.following.update((c.next,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if rows:
            # A millisecond beyond, as a cluster that was hit just `idle` ago still lives.
            self.handle.registerTimer((min(r[2] for r in rows) + self.idle) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        c = self._load()
        part = pd.concat(list(rows)).sort_values(["at", "pos", "item_id"])
        names = [c.add(v, t) for v, t in zip(part["vector"], part["at"])]
        self._save(c)
        yield self._rows(part["shard"].tolist(), part["item_id"].tolist(), names, [None] * len(part), key, c.closed)

    def _rows(self, shards: list, items: list, names: list, hits: list, key, closed: list[tuple]) -> pd.DataFrame:
        """Rows of hits, and of closed clusters."""
        none = [None] * len(closed)
        return pd.DataFrame(
            {
                "shard": shards + [key[0]] * len(closed),
                "item_id": pd.Series(items + none, dtype="object"),
                "cluster": np.array(names + [r[0] for r in closed], np.int32),
                "hits": pd.Series(hits + [r[1] for r in closed], dtype="object"),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c = self._load()
        closed = c.close(expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.idle)
        self._save(c)
        if closed:
            yield self._rows([], [], [], [], key, closed)

    def close(self) -> None:
        pass


def living_clusters(rows: DataFrame, shard: str, idle: str, least: float = SAME_QUERY, moving: bool = True, delay: str = "0 seconds") -> DataFrame:
    """(shard, item_id, cluster, hits): online clustering whose state holds living clusters only.

    rows: shard, item_id (a number), pos, ts, vector; within a micro-batch in the order of ts and pos. A cluster that wasn't hit for
    longer than `idle` is closed: when a later row of its shard comes, or at the latest when the watermark, `delay` behind
    the latest ts, has passed that time; a row with its hits and a null item_id comes out then. So the state is bounded by what is hit within `idle`, and
    the clusters are those of evolve.online_clusters(idle=...) however the stream is cut, as long as ts ascend. The session's
    state store becomes RocksDB, which this kind of state needs.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(rows.dtypes)
    timed = event_time(rows).withWatermark("ts", delay)
    plain = timed.select(F.col(shard).alias("shard"), F.col("item_id").cast("long").alias("item_id"), "pos", "ts", F.unix_micros("ts").alias("at"), "vector")
    step = _LivingClusters(least, moving, pd.Timedelta(idle).value // 1000)
    schema = f"shard {kinds[shard]}, item_id long, cluster int, hits long"
    return plain.groupBy("shard").transformWithStateInPandas(statefulProcessor=step, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def run_once(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Take what there is, batch by batch, and stop; a later run goes on from the checkpoint."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def run_every(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], interval: str = "5 minutes", mode: str = "append"):
    """Start a query that takes what has come in every `interval`; batches never overlap, and a late one isn't made up for."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(each).start()


#: Hours between the runs of maintenance jobs.
CADENCE = {"staleness_check": 1, "decay_scorer": 6, "hierarchy_merger": 24}


def due(runs: DataFrame, now: Column, cadence: dict[str, int] | None = None) -> DataFrame:
    """(job, last_run, due_at) of the maintenance jobs to run now, the longest overdue first; runs: (job, ts) of all runs so far."""
    hours = CADENCE if cadence is None else cadence
    jobs = runs.sparkSession.createDataFrame(list(hours.items()), "job string, hours int")
    last = jobs.join(runs.groupBy("job").agg(F.max(F.col("ts").cast("timestamp")).alias("last_run")), "job", "left")
    at = F.col("last_run") + F.make_interval(hours=F.col("hours"))
    return last.select("job", "last_run", at.alias("due_at")).where(F.coalesce(F.col("due_at") <= now.cast("timestamp"), F.lit(True))).orderBy(F.asc_nulls_first("due_at"), "job")


def to_table(rows: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Run an append stream into a Parquet table (each batch once, by its number) and read it."""
    run_once(rows, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def complete_to_table(rows: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Run an aggregating stream in complete mode; the last batch's result is the table."""
    run_once(rows, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(path), "complete")
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def upsert_to(table, rows: DataFrame, checkpoint: str, order: list[str] | None = None) -> None:
    """Save each batch into a keyed table under its number; a batch that is replayed is passed over."""
    run_once(rows, checkpoint, lambda batch, n: table.save(batch, n, order))
