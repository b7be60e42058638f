"""Approximate nearest neighbours by an inverted-file index, and late interaction by token centroids.

Both learn centroids on a bounded sample, the only vectors that the driver sees, and index every row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom import scratch
from sparkloom.functions import vectors as V
from sparkloom.functions.batches import whole_groups

#: Vectors that centroids and codebooks are learned on, by hash order; rounds of k-means.
SAMPLE = 20_000
ROUNDS = 12
MAX_CELLS = 4096
CODEBOOK = 256
#: Operations that spreading the starts of k-means may take; beyond, they are drawn evenly.
SPREAD_COST = 2e9
#: Queries, or query tokens, that are sent to the tasks at once; more come in blocks, one after the other.
QUERY_BLOCK = 4096
#: Numbers of a matrix of query tokens and documents' tokens, or of queries and rows.
MATRIX = 1 << 22
#: Decimals of a distance; neighbours that are alike in them are ranked by their ids.
DECIMALS = 9


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centroids of rows by Lloyd's rounds; fewer than k if there are fewer different rows."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    distinct = np.unique(x, axis=0)
    if k < len(distinct) and k * distinct.size <= SPREAD_COST:
        # Starts are spread: each is drawn by its squared distance to those before.
        chosen, far = [int(rng.integers(len(distinct)))], np.full(len(distinct), np.inf)
        while len(chosen) < k:
            far = np.minimum(far, ((distinct - distinct[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(rng.choice(len(distinct), p=far / far.sum())))
        c = distinct[chosen]
    else:
        c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = nearest_rows(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_rows(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for each row of x, by Euclidean distance."""
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[k : k + 4096] @ c.T - half).argmax(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _sample(rows: DataFrame, name: str, vector: str) -> np.ndarray:
    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(name).cast("string"))).limit(SAMPLE).select(vector).toArrow()
    return V.unit_rows(some[vector])[1]


class VectorIndex:
    """An index of unit vectors beside a collection: a Parquet partition for each cell of coarse k-means.

    A row holds its residual's product-quantised code and the vector itself. A search reads the cells nearest to its
    queries only, which the scan's partition filters show; of their rows it first reads the codes, keeps each query's
    `rerank` best by table look-ups (as each task does for its own rows), and then compares those exactly. An exact search
    goes on from there: the k-th best bounds what can be nearer, and every row of the cells that its code doesn't rule out by
    that is compared where it lies. An insert adds files to its rows' cells. All vectors
    have the length that the sample's first has; others, null, zero and non-finite ones are not indexed and have no neighbours.
    compared: how many rows and queries exact searches have compared beyond the `rerank` best so far.
    """

    def __init__(self, spark: SparkSession, path: str, item_id: str = "item_id", vector: str = "vector"):
        self.spark, self.path, self.item_id, self.vector = spark, path, item_id, vector
        self.compared = spark.sparkContext.accumulator(0)

    def build(self, rows: DataFrame, cells: int | None = None, parts: int = 16) -> VectorIndex:
        """Learn cells (by default the square root of the rows' number) and codebooks, and index all rows."""
        x = _sample(rows, self.item_id, self.vector)
        cells = cells or min(MAX_CELLS, max(1, round(rows.count() ** 0.5)))
        centres = k_means(x, cells) if len(x) else np.zeros((0, 1))
        parts = max(p for p in range(1, parts + 1) if x.shape[1] % p == 0) if x.shape[1] else 1
        rest = x - centres[nearest_rows(x, centres)] if len(x) else x
        books = [k_means(piece, CODEBOOK) for piece in np.split(rest, parts, axis=1)] if len(x) else []
        model = [("cell", 0, n, c.tolist()) for n, c in enumerate(centres)] + [("book", p, n, c.tolist()) for p, b in enumerate(books) for n, c in enumerate(b)]
        self.spark.createDataFrame(model, "kind string, part int, number int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")
        self._write(rows, "overwrite")
        return self

    @functools.cached_property
    def model(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(cells, a codebook for each part); their numbers are bounded by parameters."""
        found: dict[tuple, list] = {}
        for r in self.spark.read.parquet(f"{self.path}/model").orderBy("kind", "part", "number").collect():
            found.setdefault((r["kind"], r["part"]), []).append(r["vector"])
        return np.array(found.get(("cell", 0), np.zeros((0, 1)))), [np.array(v) for k, v in sorted(found.items()) if k[0] == "book"]

    def _write(self, rows: DataFrame, mode: str) -> None:
        self.__dict__.pop("model", None)
        centres, books = self.model
        kind = rows.schema[self.item_id].dataType
        width = centres.shape[1]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = V.unit_rows(batch.column("vector"), width)
                if not len(at) or not len(centres):
                    continue
                cell = nearest_rows(unit, centres)
                rest = np.split(unit - centres[cell], len(books), axis=1)
                code = np.stack([nearest_rows(r, b) for r, b in zip(rest, books)], 1).astype(np.uint8)
                vector = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(unit.reshape(-1)))
                codes = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * len(books)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(code))])
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)).cast(to_arrow_type(kind)), codes, vector, pa.array(cell.astype(np.int32))], ["item_id", "code", "vector", "cell"])

        plain = rows.select(F.col(self.item_id).alias("item_id"), F.col(self.vector).cast("array<double>").alias("vector"))
        coded = plain.mapInArrow(encode, f"item_id {kind.simpleString()}, code binary, vector array<double>, cell int")
        coded.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/cells")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def insert(self, rows: DataFrame) -> None:
        """Add rows whose ids the index doesn't hold."""
        self._write(rows.join(self.read().select(F.col("item_id").alias(self.item_id)), self.item_id, "left_anti"), "append")

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The cells that each query reads: those whose centroids are nearest."""
        centres = self.model[0]
        far = (centres * centres).sum(1) / 2 - queries @ centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :probes]

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, rerank: int = 50, query_id: str = "query_id", query_vector: str = "query_vector", skip_self: bool = False, exact: bool = False) -> DataFrame:
        """(query_id, item_id, distance, rank): each query's k nearest by cosine distance, among the cells it reads.

        The queries are a stated set, taken in blocks of QUERY_BLOCK. Ties, to DECIMALS, go to the lesser item_id. exact: none
        of the nearest in those cells is missed; else they are the nearest of `rerank` that the codes tell.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("vector"))
        blocks = -(-asked.count() // QUERY_BLOCK) or 1
        parts = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else asked for n in range(blocks)]
        return functools.reduce(DataFrame.unionAll, [self._block(p, k, probes, rerank, skip_self, exact) for p in parts])

    def _block(self, asked: DataFrame, k: int, probes: int, rerank: int, skip_self: bool, exact: bool) -> DataFrame:
        compared, (centres, books) = self.compared, self.model
        rows = self.read()
        kinds = [asked.schema["query_id"].dataType, rows.schema["item_id"].dataType]
        schema = f"query_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, distance double, rank int"
        known = asked.toArrow()
        at, q = V.unit_rows(known["vector"], centres.shape[1])
        if not len(at) or not len(centres):
            return self.spark.createDataFrame([], schema)
        names = known["query_id"].combine_chunks().take(pa.array(at))
        reads = self.probed(q, probes)
        of_cell = {int(c): np.flatnonzero((reads == c).any(1)) for c in np.unique(reads)}
        tables = np.stack([piece @ b.T if len(b) == CODEBOOK else np.pad(piece @ b.T, ((0, 0), (0, CODEBOOK - len(b)))) for piece, b in zip(np.split(q, len(books), axis=1), books)], 1).astype(np.float32)
        base = (q @ centres.T).astype(np.float32)
        own = {name: n for n, name in enumerate(names.to_pylist())} if skip_self else {}
        keep = rerank + 1 if skip_self else rerank
        of_item = rows.schema["item_id"].dataType

        def looked_up(some: np.ndarray, c: int, code: np.ndarray) -> np.ndarray:
            """The products of some queries and of rows of a cell, as the rows' codes tell them."""
            near = np.repeat(base[some, c][:, None], len(code), 1)
            for p in range(code.shape[1]):
                near += tables[some, p][:, code[:, p]]
            return near

        def codes_of(batch: pa.RecordBatch) -> np.ndarray:
            return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)

        def by_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None  # each query's best so far: (query, cell, similarity, item)
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                code = codes_of(batch)
                found = []
                for c in np.unique(cell).tolist():
                    some, rows_ = of_cell[c], np.flatnonzero(cell == c)
                    near = looked_up(some, c, code[rows_])
                    most = min(keep, len(rows_))
                    top = np.argpartition(-near, most - 1, axis=1)[:, :most]
                    found.append((np.repeat(some, most), rows_[top.reshape(-1)], np.take_along_axis(near, top, 1).reshape(-1)))
                if not found:
                    continue
                n, r, near = (np.concatenate(x) for x in zip(*found))
                items, cell = batch.column("item_id").take(pa.array(r)), cell[r]
                if held:
                    n, cell, near, items = np.concatenate([held[0], n]), np.concatenate([held[1], cell]), np.concatenate([held[2], near]), pa.concat_arrays([held[3], items])
                order = np.lexsort((-near, n))
                n = n[order]
                nth = np.arange(len(n)) - np.searchsorted(n, n)
                order, n = order[nth < keep], n[nth < keep]
                held = n, cell[order], near[order], items.take(pa.array(order))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), held[3], pa.array(held[1], pa.int32()), pa.array(held[2].astype(np.float64))], ["n", "item_id", "cell", "near"])

        cells = F.col("cell").isin([int(c) for c in of_cell])
        coded = rows.where(cells).select("item_id", "cell", "code").mapInArrow(by_codes, f"n long, item_id {of_item.simpleString()}, cell int, near double")
        best = coded.withColumn("nth", F.row_number().over(W.partitionBy("n").orderBy(F.desc("near"), "item_id"))).where(F.col("nth") <= keep).select("n", "item_id", "cell")

        def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n").to_numpy()
                if len(n):
                    x = V.unit_rows(batch.column("vector"))[1]
                    far = np.round(1 - np.einsum("ij,ij->i", q[n], x), 12)
                    yield pa.RecordBatch.from_arrays([batch.column("n"), names.take(pa.array(n)), batch.column("item_id"), pa.array(far)], ["n", "query_id", "item_id", "distance"])

        # Candidates are `keep` for each query of a block at most, so their number is bounded.
        joined = rows.where(cells).select("item_id", "cell", "vector").join(F.broadcast(best), ["cell", "item_id"]).select("n", "item_id", "vector")
        table = f"n long, query_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, distance double"

        def ranked(found: DataFrame) -> DataFrame:
            if own:
                found = found.where(~F.col("query_id").eqNullSafe(F.col("item_id")))
            w = W.partitionBy("n").orderBy(F.round("distance", DECIMALS), "item_id")
            return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

        best = joined.mapInArrow(exactly, table)
        if not exact:
            return ranked(best).select("query_id", "item_id", "distance", "rank")
        cut = np.full(len(q), np.inf)  # a number for each query of the block
        for r in ranked(best.distinct()).where(F.col("rank") == k).select("n", "distance").collect():
            cut[r["n"]] = r["distance"] + 2 * 10.0**-DECIMALS
        reach = np.sqrt(2 * np.maximum(cut, 0))

        def not_ruled_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, code, x = batch.column("cell").to_numpy(), codes_of(batch), V.unit_rows(batch.column("vector"))[1]
                told = centres[cell] + np.concatenate([b[code[:, p]] for p, b in enumerate(books)], axis=1)
                error, square = np.sqrt(((x - told) ** 2).sum(1)), (told * told).sum(1)
                for c in np.unique(cell).tolist():
                    some, all_rows = of_cell[c], np.flatnonzero(cell == c)
                    step = max(1, MATRIX // len(some))
                    for rows_ in (all_rows[at : at + step] for at in range(0, len(all_rows), step)):
                        # |q - x| >= |q - told| - |x - told|; the look-ups have single precision.
                        least = 1 - 1e-5 + square[rows_] - 2 * looked_up(some, c, code[rows_])
                        open_ = least <= (error[rows_] + reach[some][:, None]) ** 2
                        i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
                        open_ = open_[np.ix_(i, j)]
                        compared.add(int(open_.sum()))
                        i, j = some[i], rows_[j]
                        far = np.round(1 - q[i] @ x[j].T, 12)
                        a, b = np.nonzero(open_ & (far <= cut[i][:, None]))
                        if len(a):
                            new = pa.table({"n": i[a], "query_id": names.take(pa.array(i[a])), "item_id": batch.column("item_id").take(pa.array(j[b])), "distance": far[a, b], "near": -np.round(far[a, b], DECIMALS)})
                            if own:
                                new = new.filter(pc.invert(pc.fill_null(pc.equal(new["query_id"], new["item_id"]), False)))
                            held = _best(new if held is None else pa.concat_tables([held, new]), "near", k)
            if held is not None:
                yield from held.drop_columns("near").combine_chunks().to_batches()

        near = rows.where(cells).select("item_id", "cell", "code", "vector").mapInArrow(not_ruled_out, table)
        return ranked(near).select("query_id", "item_id", "distance", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, item_id) that were found."""
    keys = ["query_id", "item_id"]
    n, hits = exact.select(*keys, F.lit(1).alias("x")).join(found.select(*keys, F.lit(1).alias("y")), keys, "left").agg(F.count("x"), F.count("y")).first()
    return hits / n if n else 1.0


def _best(rows: pa.Table, order: str, k: int) -> pa.Table:
    """Of rows (n, item_id, ...) the k greatest by `order` for each n; ties go to the lesser item_id."""
    rows = rows.sort_by([("n", "ascending"), (order, "descending"), ("item_id", "ascending")])
    n = rows["n"].to_numpy()
    return rows.filter(pa.array(np.arange(len(n)) - np.searchsorted(n, n) < k))


class LateInteraction:
    """Documents of token vectors, by inverted lists from token centroids to the documents that have tokens near them.

    A list's row (centroid, item_id, reach) says within which angle of the centroid the document's tokens there lie. By the
    triangle inequality that bounds, from both sides, what a query's token can score in a document. The k-th greatest
    lower bound of a query rules out all documents whose upper bound is less, and only the others are compared token by
    token. Tasks give each query's k best of their documents, so neither pairs nor bounds are shuffled. Unusable
    vectors don't count. compared: how many pairs of a query and a document have been compared so far.
    """

    def __init__(self, document_tokens: DataFrame, centroids: int = 256):
        """document_tokens: (item_id, vector)."""
        self.tokens = document_tokens.where("item_id is not null").select("item_id", F.col("vector").cast("array<double>").alias("vector"))
        self.compared = document_tokens.sparkSession.sparkContext.accumulator(0)
        x = _sample(document_tokens.withColumn("__name", F.struct("item_id", "vector").cast("string")), "__name", "vector")
        c = k_means(x, centroids) if len(x) else np.zeros((0, 1))
        norm = np.sqrt((c * c).sum(1, keepdims=True))
        self.centroids = centres = c / np.where(norm > 0, norm, 1.0)
        self.kind = document_tokens.schema["item_id"].dataType
        kind = to_arrow_type(self.kind)

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, unit = V.unit_rows(batch.column("vector"), centres.shape[1])
                if len(at) and len(centres):
                    angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
                    own = angle.argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)).cast(kind), pa.array(own), pa.array(angle[np.arange(len(at)), own])], ["item_id", "centroid", "angle"])

        rows = self.tokens.mapInArrow(listed, f"item_id {self.kind.simpleString()}, centroid long, angle double")
        self.lists = scratch.written(rows.groupBy("item_id", "centroid").agg(F.max("angle").alias("reach")), "token-lists")

    def top_k(self, query_tokens: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, item_id, score, rank): each query's k documents of the greatest sums of best cosines, exactly.

        query_tokens: (query_id, position, query_vector), a stated set, in blocks of about QUERY_BLOCK tokens, or of one
        query. Ties go to the lesser item_id.
        """
        blocks = -(-query_tokens.count() // QUERY_BLOCK) or 1
        parts = [query_tokens.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else query_tokens for n in range(blocks)]
        return functools.reduce(DataFrame.unionAll, [self._block(p, k) for p in parts])

    def _block(self, asked: DataFrame, k: int) -> DataFrame:
        spark, kind, compared, centres = asked.sparkSession, self.kind.simpleString(), self.compared, self.centroids
        known = asked.select("query_id", "position", F.col("query_vector").cast("array<double>").alias("vector")).orderBy("query_id", "position").toArrow()
        at, q = V.unit_rows(known["vector"], centres.shape[1])
        if not len(at) or not len(centres):
            return spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, item_id {kind}, score double, rank int")
        names = known["query_id"].combine_chunks().take(pa.array(at)).dictionary_encode()
        query, names = names.indices.to_numpy(), names.dictionary
        begin = np.searchsorted(query, np.arange(len(names)))
        end = np.append(begin[1:], len(q))
        angle = np.arccos(np.clip(q @ centres.T, -1, 1))

        def bounds(centroid: np.ndarray, reach: np.ndarray, first: np.ndarray, upper: bool) -> np.ndarray:
            """What each query (row) scores in each document at most, or at least; first: where a document's lists begin."""
            far = angle[:, centroid]
            one = np.cos(np.maximum(far - reach, 0) if upper else np.minimum(far + reach, np.pi))
            return np.add.reduceat(np.maximum.reduceat(one, first, axis=1), begin, axis=0)

        def slices(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
            """Some whole documents at once, so that a matrix of them and all query tokens stays short."""
            at = 0
            while at < len(starts) - 1:
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + max(1, MATRIX // len(q)), "right")) - 1)
                yield table.slice(starts[at], starts[to] - starts[at]), starts[at:to] - starts[at]
                at = to

        def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for table, starts in whole_groups(batches, ["item_id"]):
                for part, first in slices(table, starts):
                    least = bounds(part["centroid"].to_numpy(), part["reach"].to_numpy(), first, False)
                    most = min(k, least.shape[1])
                    top = -np.partition(-least, most - 1, axis=1)[:, :most]
                    held = top if held is None else -np.sort(-np.concatenate([held, top], 1), axis=1)[:, :k]
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held)), held.shape[1])), pa.array(held.reshape(-1))], ["n", "lower"])

        lists = self.lists.repartition("item_id").sortWithinPartitions("item_id")
        nth = F.row_number().over(W.partitionBy("n").orderBy(F.desc("lower")))
        found = lists.mapInArrow(lower, "n long, lower double").withColumn("nth", nth).where(F.col("nth") == k).select("n", "lower").collect()
        cut = np.full(len(names), -np.inf)  # a number for each query of the block
        for r in found:
            cut[r["n"]] = r["lower"] - 1e-9

        def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for table, starts in whole_groups(batches, ["item_id"]):
                for part, first in slices(table, starts):
                    rows, unit = V.unit_rows(part["vector"], q.shape[1])
                    if not len(rows):
                        continue
                    item = np.searchsorted(first, rows, "right") - 1
                    own = np.arccos(np.clip(unit @ centres.T, -1, 1))
                    centroid = own.argmin(1)
                    pair, at = np.unique(item * len(centres) + centroid, return_inverse=True)
                    reach = np.zeros(len(pair))
                    np.maximum.at(reach, at, own[np.arange(len(rows)), centroid])
                    items, list_first = np.unique(pair // len(centres), return_index=True)
                    open_ = bounds(pair % len(centres), reach, list_first, True) >= cut[:, None]
                    item_names = part["item_id"].combine_chunks().take(pa.array(first[items]))
                    place = np.searchsorted(items, item)
                    done = []
                    for n in np.flatnonzero(open_.any(1)).tolist():
                        some = np.flatnonzero(open_[n][place])  # rows of the documents that are left, in order
                        of = place[some]
                        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                        score = np.maximum.reduceat(unit[some] @ q[begin[n] : end[n]].T, start, axis=0).sum(1)
                        done.append((np.full(len(start), n), of[start], np.round(score, 12)))
                    compared.add(int(open_.sum()))
                    if done:
                        n, of, score = (np.concatenate(x) for x in zip(*done))
                        new = pa.table({"n": n, "item_id": item_names.take(pa.array(of)), "score": score})
                        held = _best(new if held is None else pa.concat_tables([held, new]), "score", k)
            if held is not None:
                yield from held.combine_chunks().to_batches()

        scored = self.tokens.repartition("item_id").sortWithinPartitions("item_id").mapInArrow(exactly, f"n long, item_id {kind}, score double")
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("n").orderBy(F.desc("score"), "item_id"))).where(F.col("rank") <= k)
        called = spark.createDataFrame(pa.table({"n": np.arange(len(names)), "query_id": names}))
        return ranked.join(F.broadcast(called), "n").select("query_id", "item_id", "score", "rank")
