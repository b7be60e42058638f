"""Embedding near-duplicates by iterative quantisation (ITQ).

Learning: on a bounded sample, for each of several random starts a rotation of the principal axes is learned that
balances the bits: signs and rotation are fitted to each other in turn (an orthogonal Procrustes problem). Each
rotation gives a code of as many bits as the vectors have dimensions. Bits are taken about the origin, as cosines
are, so the chance that a pair's bits differ hangs on its angle alone, however the vectors lie.
Retrieval: the codes are cut into substrings, each a hash table. A vector's row of a table holds its name and the first
128 bits of its code; vectors that share a substring are held against each other by the Hamming distance of those bits,
inside the bucket. A bucket gives each vector one edge into its local group, not its pairs. Buckets of up to BLOCK
vectors are compared as they are read; larger ones in pairs of blocks. Connected components over these edges are the
candidate groups. Substrings grow with the logarithm of the number of vectors, so that buckets keep their size, and the
number of tables by the recall wanted for pairs right at the least cosine: 9 for 50,000 vectors, 14 for a million.
Rerank: within a candidate group all original vectors are compared by cosine in double precision, in blocks, so a
group of any size is spread over many tasks; a block gives counts and one edge for each vector.

Equal vectors are one class from the start: each counts the others of its class and all members of linked classes.
Null, empty, zero vectors and those with null or non-finite components link with nothing; vectors of different lengths
don't link with each other, and each length has tables of its own. Rows with null vec_id are vectors like others; a
component's id is the least vec_id in it. Empty tables give empty results. Columns other than vec_id and embedding don't
matter, whatever their names. The codes depend on the data through the sample alone; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common

MIN_COSINE = 0.95
#: Vectors of a length that the rotations are learned on, and rounds of fitting.
SAMPLE = 10_000
ROUNDS = 30
#: Vectors of a bucket, if they were spread evenly; recall wanted for pairs right at the least cosine.
BUCKET = 64
RECALL = 0.97
#: Bits of a vector's row that are compared within a bucket.
SKETCH_BITS = 128
#: Standard deviations above the expected Hamming distance at the least cosine that a candidate may be off.
SLACK = 3.5
#: Vectors of a block that are compared with each other at once.
BLOCK = 1024
#: In groups of up to so many vectors every close pair is an edge; larger ones give each vector one.
FEW = 16
#: Parts that the further rows of a bucket are spread over, where a task finds it larger than a block.
SALTS = 64
#: Buckets sent to every task at most, with their sizes; beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000


def learn(sample: np.ndarray, rotations: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """One matrix of all rotations side by side."""
    d = sample.shape[1]
    axes = np.linalg.svd(sample.T @ sample + 1e-9 * np.eye(d))[0]
    v = sample @ axes
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, t = np.linalg.svd(b.T @ v)
            r = (u @ t).T
        out.append(axes @ r)
    return np.concatenate(out, 1)


def unit_rows(rows: pa.Array, dim: int) -> np.ndarray:
    """Usable vectors of one length as unit vectors in double precision."""
    x = np.asarray(rows.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def local_groups(linked: np.ndarray) -> np.ndarray:
    """Component (least index) of each node of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tables_for(n: int, least: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, number of tables) for n vectors."""
    # The chance that a bit differs is the angle's share of half a turn, for codes through the origin.
    chance = math.acos(least) / math.pi
    width = max(8, min(32, math.ceil(math.log2(max(2.0, n / BUCKET)))))
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - chance) ** width)))


INDEXED = "bucket long, salt int, class long, low long, high long"


def indexed(classes: DataFrame, rotation: np.ndarray, dim: int, width: int, tables: int) -> DataFrame:
    """For each vector and table a row: bucket (table and substring), salt, class, and the sketch as two numbers.

    Rows of a bucket that a batch holds more than a block of are salted, but for a block and one more, which show that
    the bucket is large: so no bucket's rows all go to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(width, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                bit = unit_rows(batch.column("vector"), dim) @ rotation >= 0
                names = batch.column("class").to_numpy()
                sketch = np.packbits(bit[:, :SKETCH_BITS], axis=1).view(np.int64)
                bucket = np.stack([bit[:, k * width : (k + 1) * width] @ weight + (k << 40) for k in range(tables)], 1).reshape(-1)
                owner = np.repeat(np.arange(len(names)), tables)
                order = np.argsort(bucket, kind="stable")
                bucket, owner = bucket[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                nth = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
                salt = np.where(nth > BLOCK, 1 + nth % SALTS, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(salt), pa.array(names[owner]), pa.array(sketch[owner, 0]), pa.array(sketch[owner, 1])], ["bucket", "salt", "class", "low", "high"])

    return classes.select("class", "vector").mapInArrow(run, INDEXED)


def near_edges(names: np.ndarray, code: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within groups of rows; starts: of each group, and the end."""
    size = np.diff(starts)
    group = np.repeat(np.arange(len(size)), size)
    small = np.repeat(size <= FEW, size)
    found = [np.zeros((2, 0), np.int64)]
    for lag in range(1, min(FEW, int(size.max(initial=0)))):
        at = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        near = at[np.bitwise_count(code[at] ^ code[at + lag]).sum(1) <= limit]
        found.append(np.stack([names[near], names[near + lag]]))
    for g in np.flatnonzero(size > FEW).tolist():
        own, c = names[starts[g] : starts[g + 1]], code[starts[g] : starts[g + 1]]
        far = np.zeros((len(own), len(own)), np.uint16)
        for k in range(c.shape[1]):
            far += np.bitwise_count(c[:, None, k] ^ c[None, :, k])
        label = local_groups(far <= limit)
        moved = label != np.arange(len(own))
        found.append(np.stack([own[moved], own[label[moved]]]))
    both = np.concatenate(found, 1)
    return both[0], both[1]


def _sketches(table: pa.Table) -> np.ndarray:
    return np.stack([table["low"].to_numpy(), table["high"].to_numpy()], 1).view(np.uint64)


def candidate_edges(rows: DataFrame, limit: int) -> DataFrame:
    """(a, b): edges inside buckets, from rows as indexed() gives them. Each vector of a bucket has one at most in a block or pair of blocks."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large: tuple | None = None  # the bucket whose rows have begun to be given as those of a large one
        for table, starts in common.whole_groups(batches, ["bucket", "salt"], BLOCK):
            size = np.diff(starts)
            bucket, salt = table["bucket"].to_numpy()[starts[:-1]], table["salt"].to_numpy()[starts[:-1]]
            many = (size > BLOCK) | (salt > 0)
            if large is not None and (bucket[0], salt[0]) == large:
                many[0] = True
            large = (bucket[-1], salt[-1]) if many[-1] else None
            names, code = table["class"].to_numpy(), _sketches(table)
            rest = np.repeat(many, size)
            a, b = near_edges(names[~rest], code[~rest], np.concatenate([[0], np.cumsum(size[~many])]), limit)
            n, m = len(a), int(rest.sum())
            null = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([null(n), pa.array(table["bucket"].to_numpy()[rest])]), pa.concat_arrays([pa.array(a), pa.array(names[rest])]), pa.concat_arrays([pa.array(b), null(m)])]
                + [pa.concat_arrays([null(n), pa.array(code.view(np.int64)[rest, k])]) for k in range(2)],
                ["bucket", "a", "b", "low", "high"],
            )

    found = rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "class").mapInArrow(small, "bucket long, a long, b long, low long, high long")
    found = common.materialize(found, "buckets")
    edges = found.where("bucket is null").select("a", "b")
    large = found.where("bucket is not null").select("bucket", F.col("a").alias("class"), "low", "high")
    if large.isEmpty():
        return edges.distinct()
    # A bucket above a block's size is cut into blocks by a hash, and each pair of blocks is compared.
    sizes = common.materialize(large.groupBy("bucket").agg(F.count("*").alias("size")), "bucket-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_BUCKETS else sizes
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")))
    cells = large.join(sizes, "bucket").select("bucket", "class", "low", "high", F.explode(pairs).alias("p")).select("bucket", "class", "low", "high", "p.i", "p.j")
    keys = ["bucket", "i", "j"]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in common.whole_groups(batches, keys, None):
            a, b = near_edges(table["class"].to_numpy(), _sketches(table), starts, limit)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.unionByName(cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(paired, "a long, b long")).distinct()


def reranked(groups: DataFrame, dim: int, least: float) -> DataFrame:
    """(class, n, edge): for each block pair, what a class links with there (members) and one edge.

    groups: rows (grp, size, class, members, vector). Classes are compared with all others of their group.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")))
    rows = groups.select("grp", "class", "members", "vector", mine.alias("mine"), F.explode(pairs).alias("p")).select("grp", "class", "members", "vector", "mine", "p.i", "p.j")
    keys = ["grp", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, keys):
            names, members = np.asarray(group["class"]), np.asarray(group["members"])
            x = unit_rows(group["vector"].combine_chunks(), dim)
            block, i, j = np.asarray(group["mine"]), group["i"][0].as_py(), group["j"][0].as_py()
            order = np.argsort(names, kind="stable")
            names, members, x, block = names[order], members[order], x[order], block[order]
            linked = x @ x.T >= least
            np.fill_diagonal(linked, False)
            if i != j:  # pairs inside a block are counted where it is paired with itself
                linked &= block[:, None] != block[None, :]
            n = linked @ members
            tied = local_groups(linked)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64()), pa.array(names[tied], pa.int64())], ["class", "n", "edge"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "class long, n long, edge long")


def _linked(classes: DataFrame, dim: int, n: int, least: float, recall: float) -> DataFrame:
    """(class, n, edge) as reranked() gives them, for the n classes of vectors of one length."""
    sample = classes.orderBy("class").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    width, tables = tables_for(n, least, recall)
    bits = max(SKETCH_BITS, tables * width)
    rotation = learn(unit_rows(sample, dim), math.ceil(bits / dim))[:, :bits]
    chance = math.acos(least) / math.pi
    limit = math.ceil(SKETCH_BITS * chance + SLACK * math.sqrt(SKETCH_BITS * chance * (1 - chance)))
    edges = candidate_edges(indexed(classes, rotation, dim, width, tables), limit)
    candidates = common.connected_components(edges)
    sizes = candidates.groupBy("component").agg(F.count("*").alias("size"))
    groups = candidates.join(sizes, "component").select(F.col("component").alias("grp"), "size", F.col("node").alias("class")).join(classes, "class")
    return common.materialize(reranked(groups, dim, least), "reranked")


def near_duplicates(vectors: DataFrame, least: float = MIN_COSINE, recall: float = RECALL) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    with common.scope() as keep:
        out = _near_duplicates(vectors, least, recall)
        keep(out)
    return out


def _near_duplicates(vectors: DataFrame, least: float, recall: float) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    # Negative zeros are zeros; hashing the components names the class of equal vectors.
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("class", F.when(F.coalesce(good, F.lit(False)), F.xxhash64("vector")))
    classes = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("members"), F.min(F.struct("vector")).alias("v")).select("class", "members", "v.vector")
    classes = common.materialize(classes, "vector-classes")
    ids = common.materialize(rows.select("vec_id", "class"), "vector-ids")
    lengths = classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).where("n > 1").orderBy("dim").collect()
    found = spark.createDataFrame([], "class long, n long, edge long")
    for r in lengths:
        found = found.unionByName(_linked(classes.where(F.size("vector") == r["dim"]), r["dim"], r["n"], least, recall))
    counts = found.groupBy("class").agg(F.sum("n").alias("others"))
    components = common.connected_components(found.select(F.col("class").alias("a"), F.col("edge").alias("b")))
    named = classes.select("class", "members").join(counts, "class", "left").join(components.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("class", "members", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "class").alias("component"))
    out = ids.join(named, "class", "left")
    least_id = out.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = out.join(least_id, "component", "left")
    lone = F.col("component").isNull()
    component = F.when(lone, F.col("vec_id")).otherwise(F.col("least"))
    out = out.select("vec_id", F.when(lone, F.lit(0)).otherwise(F.col("members") - 1 + F.col("others")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    return common.materialize(out, "near-vectors")


def op10(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive e as (
    select vec_id, list_transform(embedding, lambda v: v::double) as v from embeddings
), u as (
    select vec_id, list_transform(v, lambda c: c / sqrt(list_dot_product(v, v))) as v
    from e
    where v is not null and len(v) > 0 and len(list_filter(v, lambda c: c is null or not isfinite(c))) = 0 and list_dot_product(v, v) > 0
), links as (
    select a.vec_id as x, b.vec_id as y from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.95
), reach as (
    select vec_id as x, vec_id as y from e
    union
    select r.x, l.y from reach r join links l on r.y = l.x
), least as (
    select x, min(y) as component_id from reach group by x
), degree as (
    select x, count(*) as n from links group by x
)
select l.x as vec_id, cast(coalesce(d.n, 0) as bigint) as n_links, l.component_id, l.x = l.component_id as kept
from least l left join degree d on d.x = l.x
"""
