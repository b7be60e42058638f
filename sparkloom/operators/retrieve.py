"""Exact nearest-neighbour retrieval by cosine distance, and re-ranking over two kinds of nodes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.functions import text as T
from sparkloom.functions import vectors as V
from sparkloom.functions.batches import whole_groups

#: Query vectors that are sent to the tasks at most; larger sets meet the collection block by block.
QUERY_BLOCK = 4096
#: Rows of a block of a large query set, and of the collection it is held against.
GRID_ROWS = 32_768
GRID_BYTES = 512 << 20
MAX_K = 10


def check_k(k: int, most: int = MAX_K) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"top_k must lie between 1 and {most}")
    return k


def nonblank(queries: DataFrame, text: str = "query") -> DataFrame:
    return queries.where(T.strip(F.col(text)) != "")


def _nearest(names: list, q: np.ndarray, ids: list, v: np.ndarray, k: int, skip_self: bool) -> Iterator[tuple[int, list]]:
    """For each query its k best (distance, id) among the given items, or more where the last are equally near."""
    most = min(len(ids), k + 1)
    for at in range(0, len(names), 512):
        far = 1 - q[at : at + 512] @ v.T
        # All items as near as the k-th are kept, so that ties are settled by id.
        cut = np.partition(far, most - 1, axis=1)[:, most - 1]
        for row in range(len(far)):
            yield at + row, [(round(float(far[row, j]), 12), ids[j]) for j in np.flatnonzero(far[row] <= cut[row]) if not (skip_self and ids[j] == names[at + row])]


def top_k(queries: DataFrame, collection: DataFrame, k: int = 5, query_id: str = "query_id", query_vector: str = "query_vector", item_id: str = "item_id", vector: str = "vector", skip_self: bool = False) -> DataFrame:
    """(query_id, item_id, distance, rank): each query's k nearest items; ties go to the lesser item_id.

    The queries are a stated set. Up to `QUERY_BLOCK` of them are sent to the tasks, and each task keeps the k best of its
    own items before anything is shuffled; larger sets meet the collection in a grid of blocks, which are shuffled, and
    each cell keeps the k best. Null, zero and non-finite vectors have no neighbours and are none, nor do vectors of
    different lengths.
    """
    spark = collection.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *collection.schema]}
    schema = f"query_id {kinds[query_id]}, item_id {kinds[item_id]}, distance double"
    types = [to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(collection.schema[item_id].dataType), pa.float64()]
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("vector")).where("vector is not null")
    rows = collection.select(F.col(item_id).alias("item_id"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null")

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in found], types[c]) for c in range(3)], ["query_id", "item_id", "distance"])

    def sent(names: list, q: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            for batch in batches:
                at, v = V.unit_rows(batch.column("vector"), q.shape[1])
                if len(at):
                    ids = batch.column("item_id").take(pa.array(at)).to_pylist()
                    for row, own in _nearest(names, q, ids, v, k, skip_self):
                        best[row] = sorted(best[row] + own)[:k]
            yield batch_of([(name, i, d) for name, own in zip(names, best) for d, i in own])

        return run

    first = asked.limit(QUERY_BLOCK + 1).toArrow()
    if len(first) > QUERY_BLOCK:
        found = _grid(asked, rows, k, skip_self, batch_of, schema)
    else:
        found, size = spark.createDataFrame([], schema), pc.list_value_length(first["vector"])
        for n in pc.unique(size).to_pylist():
            some = first.filter(pc.equal(size, n))
            at, q = V.unit_rows(some["vector"])
            if len(at):
                found = found.unionAll(rows.mapInArrow(sent(some["query_id"].combine_chunks().take(pa.array(at)).to_pylist(), q), schema))
    w = W.partitionBy("query_id").orderBy("distance", "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _grid(asked: DataFrame, rows: DataFrame, k: int, skip_self: bool, batch_of, schema: str) -> DataFrame:
    """The k best of each cell, from blocks of queries and blocks of items of one length.

    Blocks hold GRID_ROWS vectors at most, and fewer of long ones, so that a cell's are within GRID_BYTES.
    """
    (i, dim_i), (j, dim_j) = (x.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first() for x in (asked, rows))
    most = min(GRID_ROWS, max(1, GRID_BYTES // (16 * max(dim_i, dim_j, 1))))
    i, j = max(1, -(-i // most)), max(1, -(-j // most))
    place = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda d, name: F.lit(None).cast(d.schema[name].dataType).alias(name)
    dim = F.size("vector").alias("dim")
    left = asked.select("query_id", none(rows, "item_id"), "vector", dim, place("query_id", i).alias("i"), every(j).alias("j"))
    right = rows.select(none(asked, "query_id"), "item_id", "vector", dim, every(i).alias("i"), place("item_id", j).alias("j"))
    keys = ["dim", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            for lo, hi in zip(starts[:-1], starts[1:]):
                cell = table.slice(lo, hi - lo)
                sides = []
                for side, name in ((cell.filter(cell["is_query"]), "query_id"), (cell.filter(pc.invert(cell["is_query"])), "item_id")):
                    at, unit = V.unit_rows(side["vector"])
                    sides += [side[name].take(pa.array(at)).to_pylist(), unit]
                names, q, ids, v = sides
                if names and ids:
                    yield batch_of([(names[row], item, d) for row, own in _nearest(names, q, ids, v, k, skip_self) for d, item in sorted(own)[:k]])

    cells = left.withColumn("is_query", F.lit(True)).unionByName(right.withColumn("is_query", F.lit(False)))
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def max_sim(query_tokens: DataFrame, document_tokens: DataFrame) -> DataFrame:
    """Late interaction of all pairs: (query_id, item_id, score), the sum over query tokens of their best cosine in the document.

    query_tokens: (query_id, position, query_vector), a stated set, in blocks of about QUERY_BLOCK tokens, each sent to the
    tasks; document_tokens: (item_id, vector). Tasks take each document's best by token before anything is shuffled.
    Unusable vectors don't count. For the best documents only, `ann.LateInteraction` compares few.
    """
    blocks = -(-query_tokens.count() // QUERY_BLOCK) or 1
    parts = [query_tokens.where(F.pmod(F.xxhash64("query_id", "position"), F.lit(blocks)) == n) if blocks > 1 else query_tokens for n in range(blocks)]
    best = functools.reduce(DataFrame.unionAll, [_best_by_token(p, document_tokens) for p in parts])
    return best.groupBy("query_id", "item_id", "position").agg(F.max("best").alias("best")).groupBy("query_id", "item_id").agg(F.sum("best").alias("score"))


def _best_by_token(asked: DataFrame, document_tokens: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in [*asked.schema, *document_tokens.schema]}
    schema = f"query_id {kinds['query_id'].simpleString()}, item_id {kinds['item_id'].simpleString()}, position {kinds['position'].simpleString()}, best double"
    known = asked.select("query_id", "position", F.col("query_vector").cast("array<double>").alias("vector")).toArrow()
    at, q = V.unit_rows(known["vector"])
    if not len(at):
        return asked.sparkSession.createDataFrame([], schema)
    query, position = (known[c].combine_chunks().take(pa.array(at)) for c in ("query_id", "position"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = V.unit_rows(batch.column("vector"), q.shape[1])
            if len(rows):
                names = batch.column("item_id").take(pa.array(rows)).dictionary_encode()
                code = names.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
                best = np.maximum.reduceat(q @ v[order].T, first, axis=1)
                row, item = np.divmod(np.arange(best.size), len(first))
                yield pa.RecordBatch.from_arrays([query.take(pa.array(row)), names.dictionary.take(pa.array(code[order][first][item])), position.take(pa.array(row)), pa.array(best.reshape(-1))], ["query_id", "item_id", "position", "best"])

    return document_tokens.where("item_id is not null").select("item_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, schema)


def mask_children(hits: DataFrame, children: DataFrame) -> DataFrame:
    """Drop hits that are children of a node the same query retrieved. children: (parent_id, child_id)."""
    covered = hits.join(children, hits["item_id"] == children["parent_id"]).select("query_id", F.col("child_id").alias("item_id")).distinct()
    return hits.join(covered, ["query_id", "item_id"], "left_anti")


def boosted(distance: Column, is_super: Column, exploit: Column, factor: float = 0.85) -> Column:
    return F.when(is_super & exploit, distance * factor).otherwise(distance)


def preferential(raw: DataFrame, supers: DataFrame, children: DataFrame, exploit: Column, k: int = 5, factor: float = 0.85, masking: bool = True, fresh_only: bool = False) -> DataFrame:
    """Merge raw and super-node hits: children of retrieved nodes masked, super-nodes boosted where `exploit` holds.

    raw, supers: (query_id, item_id, distance); supers may have is_stale. Returns (query_id, item_id, type, score, rank).
    """
    if fresh_only and "is_stale" in supers.columns:
        supers = supers.where(~F.coalesce("is_stale", F.lit(False)))
    supers = supers.select("query_id", "item_id", "distance")
    if masking:
        supers = mask_children(supers, children)
    both = raw.select("query_id", "item_id", "distance", F.lit("raw").alias("type")).unionByName(supers.withColumn("type", F.lit("super_node")))
    w = W.partitionBy("query_id").orderBy("score", "item_id", "type")
    scored = both.withColumn("score", boosted(F.col("distance"), F.col("type") == "super_node", exploit, factor))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", "type", "score", "rank")


def exploits(query_id: Column, epsilon: float = 0.10) -> Column:
    """A reproducible coin: false for about `epsilon` of the queries."""
    return F.pmod(F.xxhash64(query_id), F.lit(10_000)) >= int(epsilon * 10_000)
