"""Shared pieces: table access, scratch tables in the shared folder, and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Characters of the two word definitions, as Java and Python regular expressions both read them.
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"

_made: dict[str, SparkSession] = {}
_scopes = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset, as in tests, a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: release_scratch(*_made))
    _made[path] = spark
    if open_scopes := getattr(_scopes, "open", None):
        open_scopes[-1].append(path)
    return path


@contextmanager
def scope() -> Iterator[Callable[..., None]]:
    """Delete at the end the scratch tables made meanwhile in this thread, but for those handed to the function given."""
    open_scopes = _scopes.open = getattr(_scopes, "open", [])
    open_scopes.append([])
    kept: set[str] = set()
    try:
        yield lambda *tables: kept.update(t._scratch_path for t in tables)
    finally:
        made = open_scopes.pop()
        release_scratch(*(p for p in made if p not in kept and p in _made))
        if open_scopes:
            open_scopes[-1].extend(p for p in made if p in kept)


def release_scratch(*paths: str) -> None:
    """Delete the scratch tables named."""
    for path in paths:
        spark = _made.pop(path, None)
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended already
            return


#: Rows of a file where a table's size is known beforehand, and files at least, so that short tables aren't in hundreds.
FILE_ROWS = 100_000
FILES = 8


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage, survives lost executors.

    rows: how many it has at most, if known; it is then written by no more tasks than they are worth.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(FILES + rows // FILE_ROWS)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Have Python workers get up to so many rows at once, in what is run meanwhile; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing will read again."""
    if tables:
        release_scratch(*(t._scratch_path for t in tables))


def free_memory(spark: SparkSession) -> None:
    """Drop shuffle files that nothing refers to any more, which Spark does when the driver collects its garbage, and have
    the executors collect theirs: their heaps shrink, which leaves room to the Python workers beside them. For the
    ends of stages that shuffle much; the tasks are as many as reach all executors as a rule, and nothing hangs on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    tasks = 2 * spark.sparkContext.defaultParallelism
    if not spark.sparkContext.master.startswith("local["):  # there the driver's heap is the only one
        spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def unused(name: str, taken: set[str]) -> str:
    """The name, or one made from it, that is not among the lower-case names taken; it is added to them."""
    while name.lower() in taken:
        name = "_" + name
    taken.add(name.lower())
    return name


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts batches of rows sorted by some columns into the groups of equal values, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[lo].item() for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            # alike in what may be null
            held.append(pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns, batch.schema.names))
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of equal keys begin, and the end."""
    n = len(table)
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        c = table[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where these begin, from rows sorted by the keys; a group that has grown beyond `most`
    rows is given in parts, each of more than `most` rows but the last."""
    held: list[pa.RecordBatch] = []  # the last group may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.RecordBatch.from_arrays(batch.columns, batch.schema.names))  # alike in what may be null
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        cut = int(starts[-2])
        if cut:
            yield table.slice(0, cut), starts[:-1]
        table = table.slice(cut)
        if most is not None and len(table) > most:
            yield table, np.array([0, len(table)])
            table = table.slice(0, 0)
        held = [pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns], table.column_names)] if len(table) else []
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_starts(table, keys)


#: Edges that a task merges at once before they are shuffled.
MERGED_AT_ONCE = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the least nodes of their components, which together bind what the given edges bind."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            break
        least = np.minimum(p, q)
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _merge_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        hi, lo = forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("hi", "lo")))
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= MERGED_AT_ONCE:
            yield out()
            held = []
    if held:
        yield out()


def _edge_table(edges: DataFrame, name: str, rows: int | None) -> tuple[DataFrame, tuple]:
    """(the edges as a table, their number and the sum of their hashes), in one job."""
    seen = Observation()
    written = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")), name, rows)
    got = seen.get
    return written, (got["n"], got["h"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", merge_first: bool = True, rows: int | None = None) -> DataFrame:
    """(node, component), a table: the smallest node reachable over undirected edges, for every node that has an edge.

    Each task first merges what edges it has, a bounded number at a time, into edges to least nodes (merge_first=False:
    not, so that the plan has DataFrame operations only). Then two distributed
    steps alternate until nothing changes: each node's larger neighbours, then each node's smaller ones, are re-attached
    to the smallest node seen. Labels travel by joins and map-side combined minimums only, so a star of any width is
    summed before it is shuffled; adaptive execution splits the join of a star's edges. Each round's edges are a table
    in the shared folder, deleted after the next. Loops and edges with a null end are ignored; an empty input gives an
    empty result. Nodes are integers. rows: how many edges there are at most, if known.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"))
    edges = edges.mapInArrow(_merge_edges, "hi long, lo long") if merge_first else edges
    edges, before = _edge_table(edges.distinct(), "cc-edges", rows)
    while before[0]:
        # Large star: every neighbour above a node goes to the least of the node and its neighbours.
        both = edges.unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "near")
        least = both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("least", "node").alias("least"))
        large = both.where("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("least").alias("lo")).distinct()
        large = materialize(large, "cc-large", before[0])
        # Small star: a node's smaller neighbours, and the node, go to the least of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        joined = large.join(least, "hi")
        small = joined.select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi != lo").distinct()
        small, after = _edge_table(small, "cc-small", before[0])
        release(edges, large)
        edges = small
        if before == after:
            break
        before = after
    out = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    out = materialize(out, "components", 2 * before[0])
    release(edges)
    return out
