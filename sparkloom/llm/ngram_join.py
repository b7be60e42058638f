"""Jaccard join of word-shingle sets by parity sketches.

A document's set of shingle hashes is XOR-ed into a parity sketch: each shingle flips one bit of a wide bit space.
Two sets differ in at least as many shingles as their sketches differ in bits. Sizes fall into bands by powers of two;
for each band the bit space is cut into equally many pieces (0.75 for each shingle of the band's least size), and a set
just above a band's start is also cut as the band below cuts, where it meets that band's sets only. A piece is named by the XOR of its shingles' hashes,
which is a hash of the bits that are odd in it. Bands below 64 have a piece for every shingle.

With a similarity of at least t, a set of s shingles differs from another in d = s(1-t)/t shingles at most, hence in d
pieces. So among the first d+1+x of its pieces that aren't empty, in any order that is the same for all sets, at least
1+x agree (pigeonhole). Only those are joined, by the hashes of pieces. Equal sets share one node from the start.

Groups of nodes with one piece in common:
* Light ones, of up to LIGHT nodes, give all their pairs.
* Of the heavy ones a node leaves out its x heaviest (the order is the same for all): two nodes that share 1+x pieces
  still meet in the lightest of them. So a passage that many documents share costs nothing more, unless documents
  consist of such passages. What is left are clusters: each member is held against the most central one of the group,
  then those in other components against all of the group, in blocks.

Sketches folded to 1024 bits reject pairs by their Hamming distance, a lower bound; pairs of large sets are then held
against each other by sketches that grow with the sets. What remains is verified on the shingle sets: first the closest
pair of each node, then the pairs between different components. So no group is expanded into all its pairs, and no
link between different sets is lost: a pair that isn't verified lies in one component already.

Null and empty texts, or texts without words, have an empty set and link with nothing. With fewer words than a
shingle has, the whole sequence is the one shingle. Texts of any length are read whole. Rows with equal or null doc_id
are documents of their own; a component's id is the least doc_id in it (null if it has none). Empty tables give empty
results. Columns other than doc_id and text don't matter, whatever their names. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import common, textmodel, workers

SHINGLE_WORDS = 5
PERCENT = 80
#: Nodes of a group that gives all its pairs, at most.
LIGHT = 32
#: Bands below this one have a piece for (nearly) every shingle.
FINE_BAND = 6
FINE_PARTS = 1 << 20
#: One more piece is joined for so many that must be, so that heavy groups can be left out.
SPARE_ONE_IN = 8
WORDS64 = 16  # of the folded sketch
#: Members of a heavy group that a task compares with as many others, a strip of them at a time.
BLOCK = 4096
STRIP = 128
#: Short rows that a pair of sets to be verified is worth, where tasks are dealt out.
PAIR_ROWS = 20
#: Ids sent to every task at most (8 or 16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Nodes whose pieces a task remembers having given, so that copies don't give them again.
REMEMBERED = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def shingle_sets(texts: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in textmodel.slices(texts):
        b = textmodel.Batch(lowered(part))
        w, n = b.hashes, len(b.hashes)
        starts = np.searchsorted(b.begin, b.bounds)
        h = np.zeros(max(n - k + 1, 0), np.uint64)
        for i in range(k):
            h = textmodel.mix(h + w[i : n - k + 1 + i]) if len(h) else h
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if hi - lo >= k:
                own = np.sort(h[lo : hi - k + 1])
                if len(own) > 1:
                    keep = np.empty(len(own), bool)
                    keep[0] = True
                    np.not_equal(own[1:], own[:-1], out=keep[1:])
                    own = own[keep]
                yield own
            elif hi > lo:
                x = np.array([hi - lo], np.uint64)
                for i in range(lo, hi):
                    x = textmodel.mix(x * _A + w[i])
                yield x
            else:
                yield np.zeros(0, np.uint64)


def node_of(own: np.ndarray) -> int:
    """A 63-bit name of a set, an even number."""
    x = textmodel.mix(own * _B + _C)
    with np.errstate(over="ignore"):
        both = np.array([np.add.reduce(x, dtype=np.uint64) + _A * np.uint64(len(own)) + np.bitwise_xor.reduce(x) * _C], np.uint64)
    return int(textmodel.mix(both).view(np.int64)[0]) & ~1


def folded(own: np.ndarray) -> np.ndarray:
    bits = np.bincount((textmodel.mix(own + _C) >> np.uint64(54)).astype(np.int64), minlength=64 * WORDS64)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def wide(own: np.ndarray) -> np.ndarray | None:
    """A sketch of twice as many bits as the set has shingles, or more; none where the folded one has as many."""
    bits = 1 << (2 * len(own) - 1).bit_length()
    if bits <= 64 * WORDS64:
        return None
    at = (textmodel.mix(own + _C) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def hamming(x: Column, y: Column) -> Column:
    """Distance of two wide sketches (array<long>), the longer one folded to the shorter one's length."""
    long, short = (F.when(F.size(x) >= F.size(y), p).otherwise(q) for p, q in ((x, y), (y, x)))
    both = F.struct(long.alias("l"), short.alias("s"))

    def apart(b: Column) -> Column:
        n, times = F.size(b["s"]), (F.size(b["l"]) / F.size(b["s"])).cast("int")
        fold = lambda i: F.aggregate(F.sequence(F.lit(0), times - 1), F.lit(0).cast("long"), lambda bits, j: bits.bitwiseXOR(F.get(b["l"], i + j * n)))
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda total, i: total + F.bit_count(F.get(b["s"], i).bitwiseXOR(fold(i))))

    return F.transform(F.array(both), apart)[0]


def piece_keys(own: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray, int]]:
    """(band, names of the pieces that a set joins by, how many of them are to spare): for its band, and for the band
    below if a set there could link. A name's last bit is the band's, so it tells which of the two it is for. In the band
    below the set is a visitor."""
    s = len(own)
    band = s.bit_length() - 1
    out = []
    x = textmodel.mix(own ^ _B)
    for slot in (band, band - 1) if band and s * percent <= 100 * ((1 << band) - 1) else (band,):
        differ = s * (100 - percent) // percent
        if slot < band:  # the other set is smaller than this band's start
            differ = min(differ, (s + (1 << band) - 1) * (100 - percent) // (100 + percent))
        parts = FINE_PARTS if slot < FINE_BAND else -(-(3 << slot) * (100 - percent) // percent)
        part = (own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # ascending, as the set is
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        joined_by = min(len(first), differ + 1 + differ // SPARE_ONE_IN + 2)
        ends = np.append(first, s)[: joined_by + 1]
        first = first[:joined_by]
        names = textmodel.mix(np.bitwise_xor.reduceat(x[: ends[-1]], first) + part[first] * _A + np.uint64(slot * int(_C) % (1 << 64)))
        out.append((slot, names & ~np.uint64(1) | np.uint64(slot & 1), max(0, joined_by - differ - 1)))
    return out


SKETCHED = "doc_id long, text_hash long, n long, node long, parity int, sketch array<long>, wide array<long>, spare0 int, spare1 int, keys array<long>, more array<long>"


def sketched(docs: DataFrame, percent: int) -> DataFrame:
    """One row for each document: size and name of its set, the last bit of its band, and, where the task meets the set
    first, the folded and the wide sketch, the spare pieces of even and odd bands, and the names of the pieces it joins by.

    Names that more than LIGHT documents of a batch hold are heavy already: LIGHT + 1 of them stay in `keys` to tell
    so, the others go to `more` and needn't meet them. So a group of any size is thinned out before it is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.forget()
        seen: set[int] = set()
        for batch in batches:
            n, node, sketch, broad, spare, keys = [], [], [], [], ([], []), []
            for own in shingle_sets(batch.column("text")):
                n.append(len(own))
                name = node_of(own) if len(own) else None
                node.append(name)
                new = name is not None and name not in seen
                found = piece_keys(own, percent) if new else []
                if new:
                    seen.add(name)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                sketch.append(folded(own) if new else None)
                broad.append(wide(own) if new else None)
                spares = {slot & 1: x for slot, _, x in found}
                for parity in (0, 1):
                    spare[parity].append(spares.get(parity))
                keys.append(np.concatenate([np.zeros(0, np.uint64), *(k for _, k, _ in found)]))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int64)
            stays = _first_few(flat)
            kept = np.concatenate([[0], np.cumsum(stays)])[bounds]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array([x.bit_length() - 1 & 1 for x in n], pa.int32()), pa.array(sketch, pa.list_(pa.int64())), pa.array(broad, pa.list_(pa.int64())),
                    pa.array(spare[0], pa.int32()), pa.array(spare[1], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(flat[stays].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array((bounds - kept).astype(np.int32)), pa.array(flat[~stays].view(np.int64))),
                ],
                [x.split()[0] for x in SKETCHED.split(", ")],
            )
            workers.trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SKETCHED)


def _first_few(keys: np.ndarray) -> np.ndarray:
    """Which keys are among the first LIGHT + 1 occurrences of their value."""
    stays = np.ones(len(keys), bool)
    bucket = (keys >> np.uint64(44)).astype(np.int64)
    at = np.flatnonzero((np.bincount(bucket, minlength=1 << 20) > LIGHT + 1)[bucket])
    if len(at):
        at = at[np.argsort(keys[at], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], keys[at][1:] != keys[at][:-1]]))
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        stays[at[nth > LIGHT]] = False
    return stays


def _pairs_of(node: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within groups of up to LIGHT nodes, each group's nodes ascending, but for pairs of visitors."""
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[sizes > 1]).tolist():
        members = node[starts[sizes == size][:, None] + np.arange(size)]
        members = members[(members & 1 == 0).any(1)]
        i, j = np.triu_indices(size, 1)
        xs.append(members[:, i].ravel())
        ys.append(members[:, j].ravel())
    x, y = np.concatenate(xs), np.concatenate(ys)
    native = (x & y & 1) == 0
    x, y = x[native] & ~1, y[native] & ~1
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def groups_of(keys: DataFrame) -> DataFrame:
    """From rows (key, node), (key, x, y): pairs x < y of light groups, with a null key; and the nodes x of heavy ones, with a null y.

    An odd node stands for the even one before it, as a visitor from the band above. Two visitors aren't paired, as their
    own band does that. Nodes of heavy groups come out as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last group, which may go on in the next batch
        heavy_key = None

        def out(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(key)))
            many = sizes > LIGHT
            if heavy_key is not None and len(key) and key[0] == heavy_key:
                many[0] = True
            x, y = _pairs_of(node, starts[~many], sizes[~many])
            rows = np.repeat(many, sizes)
            key = pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(key[rows])])
            return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([x, node[rows]])), pa.concat_arrays([pa.array(y), pa.nulls(int(rows.sum()), pa.int64())])], ["key", "x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "node")))
            cut = int(np.searchsorted(key, key[-1]))
            if len(key) - cut > LIGHT and len(np.unique(node[cut:])) > LIGHT or key[-1] == heavy_key:
                yield out(key, node)
                heavy_key, held = key[-1], (np.zeros(0, np.int64), np.zeros(0, np.int64))
            else:
                if cut:
                    yield out(key[:cut], node[:cut])
                heavy_key, held = None, (key[cut:], node[cut:])
        if len(held[0]):
            yield out(*held)

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, x long, y long")


def _close(percent: int) -> tuple[Column, Column]:
    """Whether sets a and b can be similar enough by their sizes and by the Hamming distance of their sketches, and the distance."""
    a, b = F.col("a.n"), F.col("b.n")
    far = None
    for i in range(WORDS64):
        x = F.bit_count(F.col("a.sketch")[i].bitwiseXOR(F.col("b.sketch")[i]))
        far = x if far is None else far + x
    # |A xor B| <= (|A| + |B|) (100 - p) / (100 + p)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (far * (100 + percent) <= (a + b) * (100 - percent)), far


def _alike(rows: DataFrame) -> DataFrame:
    """Rows sent to every task where they are few, else as they are, for a join by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def leftovers(heavy: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """(key, node, size): rows of heavy groups without each node's spare ones, the heaviest first; size: of the heavy group.

    Groups of visitors alone are left out. An odd node is a visitor.
    """
    sizes = heavy.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("node").bitwiseAND(F.lit(1)) == 0).alias("native")).where("native > 0").select("key", "size")
    sizes = common.materialize(sizes, "heavy-sizes", rows // LIGHT)
    left = heavy.join(_alike(sizes), "key").select("key", F.col("node").bitwiseAND(F.lit(-2)).alias("node"), "size").join(nodes.select("node", "spare0", "spare1"), "node")
    nth = F.row_number().over(W.partitionBy("node", "odd").orderBy(F.desc("size"), "key"))
    left = left.withColumn("odd", F.col("key").bitwiseAND(F.lit(1))).withColumn("nth", nth).where(F.col("nth") > F.when(F.col("odd") == 0, F.col("spare0")).otherwise(F.col("spare1")))
    return common.materialize(left.select("key", "node", "size"), "heavy-groups", rows)


def across(rows: DataFrame, percent: int, all_pairs: bool, n_rows: int) -> DataFrame:
    """(x, y, far): pairs of a group's nodes in different components whose sketches let them link.

    rows: (key, node, component, open, n, sketch). The commonest component of a group is its core; each node outside,
    if it is open, is held against the core and the other such nodes of the group, in blocks. Of each such node and
    another component, the closest pair of a block is given, or all.
    """
    parts = rows.groupBy("key", "component").agg(F.count_if("open").alias("o"), F.count("*").alias("c"))
    parts = parts.groupBy("key").agg(F.sum("o").alias("open"), F.max(F.struct("c", "component", "o")).alias("core"))
    outside = F.col("open") - F.col("core.o")
    parts = common.materialize(parts.where(outside > 0).select("key", (outside + F.col("core.c")).alias("size"), outside.alias("outside"), F.col("core.component").alias("core")), "open-groups", n_rows // LIGHT)
    full = rows.join(_alike(parts), "key").where("open or component = core")
    m, o = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("size", "outside"))
    place = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    own = ["key", "node", "component", "n", "sketch"]
    inner = full.select(*own, F.lit(False).alias("out"), place(m).alias("i"), F.explode(F.sequence(F.lit(0), o - 1)).alias("j"))
    outer = full.where("component != core").select(*own, F.lit(True).alias("out"), F.explode(F.sequence(F.lit(0), m - 1)).alias("i"), place(o).alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, ["key", "i", "j"]):
            node, component, n = (group[c].to_numpy() for c in ("node", "component", "n"))
            sketch = np.ascontiguousarray(group["sketch"].combine_chunks().flatten().to_numpy()).view(np.uint64).reshape(len(node), -1)
            out = group["out"].to_numpy()
            p, q = np.flatnonzero(out), np.flatnonzero(~out)
            found = []
            for at in range(0, len(p), STRIP):
                some = p[at : at + STRIP]
                far = np.zeros((len(some), len(q)), np.uint16)
                for k in range(sketch.shape[1]):
                    far += np.bitwise_count(sketch[some, k][:, None] ^ sketch[q, k][None, :])
                a, b = n[some][:, None], n[q][None, :]
                ok = far <= (a + b) * (100 - percent) // (100 + percent)
                ok &= (100 * a >= percent * b) & (100 * b >= percent * a) & (component[some][:, None] != component[q][None, :])
                i, j = np.nonzero(ok)
                found.append((i + at, j, far[i, j].astype(np.int64)))
            i, j, d = (np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64) for c in range(3))
            if not all_pairs:
                order = np.lexsort((d, component[q[j]], i))
                i, j, d = i[order], j[order], d[order]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (component[q[j]][1:] != component[q[j]][:-1])
                i, j, d = i[new], j[new], d[new]
            x, y = node[p[i]], node[q[j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d)], ["x", "y", "far"])

    cells = inner.unionByName(outer).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInArrow(run, "x long, y long, far long").distinct()


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Tables: documents with n and node, and components of the linked nodes as (node, component)."""
    with common.scope() as keep:
        known, merged = _links(docs, percent)
        keep(known, merged)
    common.free_memory(docs.sparkSession)
    return known, merged


def _links(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    keyed = common.materialize(sketched(docs, percent), "sketches")
    n_docs = keyed.count()
    known = common.materialize(keyed.select("doc_id", "text_hash", "n", "node"), "documents", n_docs)
    # A name for the other band than the node's own marks a visitor there.
    visitor = F.col("node") + (F.col("key").bitwiseAND(F.lit(1)) != F.col("parity")).cast("long")
    named = lambda c: keyed.where("node is not null").select(F.explode(c).alias("key"), "node", "parity").select("key", visitor.alias("node"))
    groups = common.materialize(groups_of(named("keys")), "groups")
    # One document stands for each node.
    some = F.min(F.struct("text_hash", "doc_id", "n", "sketch", "wide", "spare0", "spare1")).alias("s")
    nodes = common.materialize(keyed.where("sketch is not null").groupBy("node").agg(some).select("node", "s.*"), "nodes", 4 * n_docs)
    heavy = groups.where("key is not null").select("key", F.col("x").alias("node")).unionByName(named("more"))
    n_groups, n_more = groups.count(), keyed.agg(F.sum(F.size("more"))).first()[0] or 0
    heavy = common.materialize(heavy.distinct(), "heavy", n_groups + n_more)
    n_heavy = heavy.count()
    common.release(keyed)
    common.free_memory(spark)
    one = nodes.select("node", "n", "sketch")
    pairs = groups.where("key is null").select("x", "y", F.lit(False).alias("star"))
    left = None
    if n_heavy:
        left = leftovers(heavy, nodes, n_heavy)
        # A group's leader is the node with most in common with others, over all groups.
        weight = left.groupBy("node").agg(F.sum("size").alias("weight"))
        led = left.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("m")).select("key", F.col("m.node").alias("leader"))
        star = left.join(_alike(common.materialize(led, "leaders", n_heavy // LIGHT)), "key").where("node != leader")
        pairs = pairs.unionByName(star.select(F.least("node", "leader").alias("x"), F.greatest("node", "leader").alias("y"), F.lit(True).alias("star")))
    common.release(heavy)
    near, distance = _close(percent)
    pairs = pairs.groupBy("x", "y").agg(F.max("star").alias("star"))
    pairs = pairs.alias("p").join(one.alias("a"), F.col("p.x") == F.col("a.node")).join(one.alias("b"), F.col("p.y") == F.col("b.node")).where(near)
    pairs = common.materialize(pairs.select("p.x", "p.y", "p.star", F.col("a.n").alias("xn"), F.col("b.n").alias("yn"), distance.cast("long").alias("far")), "close-pairs", n_groups + n_heavy)
    common.release(groups)
    common.free_memory(spark)
    n_pairs = pairs.count()
    pairs = common.materialize(_not_far(pairs, nodes, percent), "candidates", 5 * n_pairs)
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node"))
    if left is not None:
        wanted = wanted.unionByName(left.select("node"))
    sets = _sets(docs, nodes.join(wanted.distinct(), "node", "left_semi"), min(n_docs, 2 * n_pairs + n_heavy))
    # First the pairs with leaders, and the closest pair of each node.
    apart = F.col("far") / (F.col("xn") + F.col("yn"))
    ends = pairs.select(F.explode(F.array("x", "y")).alias("node"), F.struct(apart.alias("apart"), "x", "y", "xn", "yn").alias("p"))
    first = ends.groupBy("node").agg(F.min("p").alias("p")).select("p.x", "p.y", "p.xn", "p.yn").unionByName(pairs.where("star").select("x", "y", "xn", "yn"))
    tested = common.materialize(first.distinct(), "first-pairs", n_pairs)
    merged = common.connected_components(_verified(tested, sets, percent), "x", "y", rows=PAIR_ROWS * n_pairs)
    # Then what still lies in different components.
    rest = _labelled(_labelled(pairs.join(tested, ["x", "y"], "left_anti"), merged, "x", "xc"), merged, "y", "yc").where("xc != yc").select("x", "y", "xn", "yn")
    rest = common.materialize(rest, "pairs-across", n_pairs)
    n_rest = rest.count()
    if n_rest:
        merged, tested = _extended(merged, _verified(rest, sets, percent), n_docs + PAIR_ROWS * n_rest), tested.unionByName(rest)
    if left is None:
        return known, merged
    left = common.materialize(left.select("key", "node").join(one, "node"), "group-rows", n_heavy)
    rows = _labelled(left, merged, "node", "component").withColumn("open", F.lit(True))
    some = common.materialize(across(rows, percent, False, n_heavy), "closest-across", n_heavy)
    n_some = some.count()
    if not n_some:
        return known, merged
    rest = common.materialize(_sized(some.join(tested, ["x", "y"], "left_anti"), nodes, percent), "closest-untested", n_some)
    n_rest = rest.count()
    if n_rest:
        merged, tested = _extended(merged, _verified(rest, sets, percent), n_docs + PAIR_ROWS * n_rest), tested.unionByName(rest)
    # A node without a close one in another component has none now either.
    ends = common.materialize(some.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "open-nodes", 2 * n_some)
    rows = _labelled(left.join(_alike(ends).withColumn("open", F.lit(True)), "node", "left"), merged, "node", "component").withColumn("open", F.coalesce("open", F.lit(False)))
    last = common.materialize(_sized(across(rows, percent, True, n_heavy).join(tested, ["x", "y"], "left_anti"), nodes, percent), "last-pairs", n_heavy)
    n_last = last.count()
    if n_last:
        merged = _extended(merged, _verified(last, sets, percent), n_docs + PAIR_ROWS * n_last)
    return known, merged


def _labelled(rows: DataFrame, merged: DataFrame, node: str, name: str) -> DataFrame:
    """Rows with the component of a node; one without links is its own."""
    return rows.join(merged.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _extended(merged: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """Components so far, joined by the new links: a component is an edge from each node to its least one."""
    return common.connected_components(merged.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(found), "x", "y", rows=rows)


def _not_far(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y, xn, yn, far), those that the wide sketches let through as well."""
    broad = nodes.where("wide is not null").select("node", "wide")
    big = F.least("xn", "yn") > 32 * WORDS64  # both have a wide sketch
    names = [c for c in pairs.columns if c != "far"]
    rows = pairs.where(big).drop("far").join(broad.select(F.col("node").alias("x"), F.col("wide").alias("xw")), "x").join(broad.select(F.col("node").alias("y"), F.col("wide").alias("yw")), "y")
    rows = rows.select(*names, hamming(F.col("xw"), F.col("yw")).alias("far")).where(F.col("far") * (100 + percent) <= (F.col("xn") + F.col("yn")) * (100 - percent))
    return pairs.where(~big).unionByName(rows)


def _sized(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, far) with their sizes, without those that the wide sketches reject."""
    n = nodes.select("node", "n")
    pairs = pairs.join(n.select(F.col("node").alias("x"), F.col("n").alias("xn")), "x").join(n.select(F.col("node").alias("y"), F.col("n").alias("yn")), "y")
    return _not_far(pairs.select("x", "y", "xn", "yn", "far"), nodes, percent).select("x", "y", "xn", "yn")


def _sets(docs: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """(node, shingles) of the given nodes, worked out anew from the texts that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = {node_of(own): own.view(np.int64) for own in shingle_sets(batch.column("text").slice(at, 1000)) if len(own)}
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.list_(pa.int64()))], ["node", "shingles"])
            workers.trim()

    wanted = common.materialize(nodes.select("doc_id", "text_hash"), "sets-wanted", rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    texts = texts.alias("t").join(_alike(wanted).alias("w"), (F.col("t.text_hash") == F.col("w.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi").select("text")
    return common.materialize(texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "shingle-sets", 20 * rows)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y) of pairs whose sets are similar enough. Other sets aren't shuffled, unless the wanted are too many to send to every task."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        sets = sets.join(F.broadcast(wanted), "node", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("xs")), "x").join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("ys")), "y")
    counted = both.select("x", "y", (F.col("xn") + F.col("yn")).alias("sum"), F.size(F.array_intersect("xs", "ys")).alias("shared"))
    return counted.where(100 * F.col("shared") >= percent * (F.col("sum") - F.col("shared"))).select("x", "y")


def joined(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_shingles, component_id."""
    rows = _with_components(docs, percent)
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "component", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_components(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, node, component) of each document; without shingles it has no component."""
    known, components = links(docs, percent)
    return known.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, but of each group of near duplicates only one row: that with the least doc_id (null ids last), and
    among those the least hash of the text. Of rows equal in doc_id and text one stays, whichever comes first. Documents
    without shingles link with nothing, so they all stay.
    """
    rows = common.materialize(_with_components(docs, percent).where("component is not null").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies")), "near-duplicates", docs.count())
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "copies")
    first = rows.groupBy("component").agg(F.min(me).alias("first"))
    marked = rows.join(first, "component").select("doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"), "copies")
    out = common.materialize(marked.where("not stays or copies > 1").select("doc_id", "text_hash", "stays"), "near-duplicates-out", rows.count())
    clash = {c.lower() for c in docs.columns}
    names = [common.unused(x, clash) for x in ("dup_id", "dup_hash", "dup_stays", "text_hash")]
    few = _alike(out).toDF(*names[:3])
    same = F.col(names[3]).eqNullSafe(F.col(names[1])) & F.col("doc_id").cast("long").eqNullSafe(F.col(names[0]))
    found = docs.withColumn(names[3], F.xxhash64(F.col("text").cast("string"))).join(few, same, "left")
    kept = found.where(F.col(names[2]).isNull()).select(*docs.columns)
    if out.where("stays").isEmpty():
        return kept
    return kept.unionByName(found.where(F.col(names[2])).dropDuplicates(["doc_id", names[3]]).select(*docs.columns))


def op8(spark, sf_dir):
    return joined(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = """
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
    from words
), items as (
    select doc_id, len(s) as n, unnest(s) as g from sets
), links as (
    select a.doc_id as x, b.doc_id as y
    from items a join items b on a.g = b.g and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
    select doc_id as x, doc_id as y from documents
    union
    select r.x, l.y from reach r join links l on r.y = l.x
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.component_id
from sets s join (select x, min(y) as component_id from reach group by x) r on r.x = s.doc_id
"""
