"""Conversation prefix trie by smallest-member ownership.

A node of the trie is a sequence of first turns that some conversations share; its owner is the smallest of them. A
conversation that owns a node owns every deeper node on its path too, so it owns a suffix of the path, and (owner,
depth) names each node once. What a node saves is then a plain sum over its members: the tokens of their turns from the
node on (occurrences) minus those of the turns whose nodes they own themselves. Leaves are counted alike, by a flag at
the owner of each childless node.

Turns are numbered by a range exchange over (conv_id, turn), windows run along each conversation in segments of a
bounded number of turns and give every prefix a digest and the tokens before it. Owners are least members by a group-by
(a window over a node's members would bring them all to one task), and a path is marked as owned from its conversation's
least owned depth on. One group-by over the prefixes sums up the rest. All groups are combined on the map side, so a first turn that a
third of the conversations share is no hot key, and a conversation of any length is spread over ranges and segments.
Texts are never shuffled: a turn travels as two hashes and its length in bytes. A prefix is named by 128 bits.

Rows with a null conv_id belong to no conversation; remainders of negative ones are negative, as in SQL. Null roles and texts are empty ones. Null turns come first; rows of a
conversation that share a turn are ordered by role, then by the MD5 digest of the text, so equal rows are one turn each.
A conversation whose rebuilt form has no turn is a member of the root, and ends there. An empty table gives no node,
not even a root. Texts of any length are hashed whole. Columns other than conv_id, turn, role and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import common

#: Turns of a conversation that a window runs over at once.
SEGMENT = 1024
#: Conversations are rebuilt from the first of their family of so many, with fewer than so many turns of it.
FAMILY, SHARED = 5, 9
#: Ids of a chunk of a node's ends; a chunk holds ids of one block of this many consecutive numbers.
IDS_AT_ONCE = 256
NODE = ["depth", "a", "b"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, x, y, bytes): each conversation's turns in order from 1, with two hashes of role and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.md5(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    # Places go up along the ranges and within them, so what is left to know is where a conversation begins in a range.
    order = ["c", "turn", "role", "digest"]
    placed = rows.repartitionByRange("c", "turn").sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = common.materialize(placed.select("c", F.shiftright("place", 33).alias("range"), "place", F.xxhash64("role", "digest").alias("x"), F.xxhash64("digest", F.lit(1), "role").alias("y"), "bytes"), "turns")
    starts = placed.groupBy("c", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("c", "range", (F.col("first") - before - 1).alias("base"))
    return placed.join(starts, ["c", "range"]).select("c", (F.col("place") - F.col("base")).alias("pos"), "x", "y", "bytes")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, pos, x, y, bytes) of the rebuilt conversations. convs: (c, h, shared, size) as families() gives them."""
    plain = ["c", "pos", "x", "y", "bytes"]
    own = turns.join(convs.select("c", "h", "shared"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "x", "y", "bytes")
    heads = turns.where(F.col("pos") < SHARED).withColumnRenamed("c", "first")
    lent = convs.select("c", "first", "h").join(heads, "first").where("pos <= h").select(*plain)
    return own.unionByName(lent)


def families(turns: DataFrame) -> DataFrame:
    """(c, first, h, shared, size): whose first turns a conversation takes, how many, and its turns once it is rebuilt."""
    sizes = turns.groupBy("c").agg(F.max("pos").alias("n"))
    convs = sizes.select("c", "n", (F.col("c") - F.col("c") % FAMILY).alias("first"), (F.crc32(F.col("c").cast("string").cast("binary")) % SHARED).alias("h"))
    lender = sizes.select(F.col("c").alias("first"), F.col("n").alias("lent"))
    shared = F.least("h", F.coalesce("lent", F.lit(0)))
    return convs.join(lender, "first", "left").select("c", "first", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (c, pos, x, y, bytes) with the digests (a, b) of their prefix, (up_a, up_b) of the one before, and the bytes before.

    A prefix's digest is made of four sums over its turns of hashes of place and turn, so windows can run it up within
    segments; long conversations add the sums of the segments before.
    """
    parts = ["s1", "s2", "s3", "s4"]
    one, two = F.xxhash64("pos", "x", "y"), F.xxhash64("y", "x", "pos", F.lit(2))
    rows = rows.withColumns({"s1": _low(one), "s2": F.shiftrightunsigned(one, 32), "s3": _low(two), "s4": F.shiftrightunsigned(two, 32), "segment": F.floor((F.col("pos") - 1) / SEGMENT)})
    along = W.partitionBy("c", "segment").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    sums = [*parts, "bytes"]
    local = rows.select("c", "pos", "segment", *sums, *(F.sum(s).over(along).alias(f"run_{s}") for s in sums))
    # Only conversations of more than one segment have anything to add.
    whole = rows.groupBy("c", "segment").agg(*(F.sum(s).alias(s) for s in sums))
    earlier = W.partitionBy("c").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    base = whole.select("c", "segment", *(F.sum(s).over(earlier).alias(f"base_{s}") for s in sums)).where("segment > 0")
    found = local.join(base, ["c", "segment"], "left")
    upto = {s: F.coalesce(F.col(f"base_{s}"), F.lit(0)) + F.col(f"run_{s}") for s in sums}
    name = lambda k, before: F.xxhash64(F.lit(k), *(upto[s] - (F.col(s) if before else 0) for s in (parts if k == 0 else parts[::-1])))
    return found.select("c", "pos", name(0, False).alias("a"), name(1, False).alias("b"), name(0, True).alias("up_a"), name(1, True).alias("up_b"), "bytes", (upto["bytes"] - F.col("bytes")).alias("before"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) from rows (depth, a, b, c): the SHA-256 of the ids c in order, joined by commas.

    Ids are joined in chunks by blocks of consecutive numbers; most nodes have one chunk and are hashed where they are. Of
    the others the chunks, not the ids, meet in order in a task, which feeds them one by one to a running hash.
    """
    chunks = ends.groupBy(*NODE, F.floor(F.col("c") / IDS_AT_ONCE).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    chunks = common.materialize(chunks, "trie-ends")
    blocks = chunks.groupBy(*NODE).agg(F.count("*").alias("blocks"), F.min("ids").alias("only"))
    one = blocks.where("blocks = 1").select(*NODE, F.sha2(F.col("only").cast("binary"), 256).alias("ends_sha256"))
    many = chunks.join(blocks.where("blocks > 1").select(*NODE), NODE)
    schema = "depth long, a long, b long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        node, digest = None, None
        row = lambda: pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in node), pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])
        for batch in batches:
            for depth, a, b, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids"))):
                if (depth, a, b) != node:
                    if node:
                        yield row()
                    node, digest = (depth, a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if node:
            yield row()

    return one.unionByName(many.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(run, schema))


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with common.scope() as keep:
        out = common.materialize(_trie(conversations), "trie")
        keep(out)
    return out


def _trie(conversations: DataFrame) -> DataFrame:
    turns = common.materialize(numbered_turns(conversations), "numbered-turns")
    convs = common.materialize(families(turns), "families")
    rows = prefixes(rebuilt(turns, convs))
    zeros = [F.lit(0).cast("long")] * 4
    root = [F.xxhash64(F.lit(0), *zeros).alias("a"), F.xxhash64(F.lit(1), *zeros).alias("b")]
    none = F.lit(None).cast("long")
    roots = convs.select("c", F.lit(0).cast("long").alias("pos"), *root, none.alias("up_a"), none.alias("up_b"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("before"))
    paths = rows.unionByName(roots).withColumnRenamed("pos", "depth").join(convs.select("c", "size"), "c")
    paths = common.materialize(paths, "paths")

    # Who owns a node, and whether all its members end there.
    owned = paths.groupBy(*NODE).agg(F.min("c").alias("c"), (F.count("*") == F.count_if(F.col("depth") == F.col("size"))).alias("leaf"), F.min("before").alias("before"))
    owned = common.materialize(owned, "owned")
    marks = owned.groupBy("c").agg(F.min("depth").alias("from"), F.min("before").alias("lent"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    totals = paths.where("depth = size").select("c", (F.col("before") + F.col("bytes")).alias("total"))
    # A conversation that owns nothing owns from beyond its end; `lent` is what its turns before its own ones hold.
    marks = totals.join(marks, "c", "left").select("c", F.col("from"), F.coalesce("lent", "total").alias("lent"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = paths.join(marks, "c")

    continued = (F.col("size") > F.col("depth")) & (F.col("from") <= F.col("depth") + 1)
    nodes = marked.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(continued).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("lent") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.min(F.when(F.col("from") < F.col("depth"), F.col("c"))).alias("inner"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
    )
    nodes = common.materialize(nodes, "trie-nodes")
    # The owner of a node owns the parent as well, but where its own suffix begins; there the parent is looked up.
    owner = owned.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("c").alias("above"))
    inside = F.col("inner").eqNullSafe(F.col("conv_id")) & (F.col("depth") > 0)
    first = nodes.where(~inside).join(owner, ["depth", "up_a", "up_b"], "left")
    named = nodes.where(inside).withColumn("above", F.col("conv_id")).unionByName(first)
    digests = ends_digests(paths.where("depth = size").select(*NODE, "c"))
    out = named.join(digests, NODE, "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def op11(spark, sf_dir):
    return trie(common.table(spark, sf_dir, "conversations"))


#: crc32 by bits, over the digits of an id.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast({0} as varchar), ''), lambda d: cast(ascii(d) as bigint))), lambda crc, d: list_reduce(list_prepend(xor(crc, d), [cast(0 as bigint) for i in range(8)]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"

ORACLE = f"""
with t as (
    select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null
), n as (
    select c, max(pos) as n, {_CRC.format("c")} % 9 as h from t group by c
), v as (
    select n.c, n.c - n.c % 5 as first, n.h, least(n.h, coalesce(m.n, 0)) as shared from n left join n m on m.c = n.c - n.c % 5
), r as (
    select v.c, t.pos, t.role, t.text from v join t on t.c = v.first and t.pos <= v.h
    union all
    select v.c, t.pos - v.h + v.shared, t.role, t.text from v join t on t.c = v.c and t.pos > v.h
), p as (
    select v.c, list({{'role': r.role, 'text': r.text}} order by r.pos) filter (where r.pos is not null) as path from v left join r on r.c = v.c group by v.c
), w as (
    select c, coalesce(path, []) as path from p
), o as (
    select c, path, unnest(range(0, len(path) + 1)) as depth from w
), k as (
    select c, depth, path[1:depth] as node, len(path) = depth as stops from o
), nodes as (
    select node, depth, min(c) as conv_id, count(*) as n_convs, count(*) = count(*) filter (where stops) as leaf, string_agg(case when stops then cast(c as varchar) end, ',' order by c) as ends,
        (count(*) - 1) * case when depth = 0 then 0 else strlen(node[depth].text) end as saved
    from k group by node, depth
), under as (
    select k.node, k.depth, sum(x.saved) as saved_tokens, count(*) filter (where x.leaf) as n_leaves
    from (select node, depth, min(c) as c from k group by node, depth) k join nodes x on x.depth >= k.depth and x.node[1:k.depth] = k.node group by k.node, k.depth
)
select a.conv_id, a.depth, u.conv_id as parent_conv_id, a.n_convs, (select count(*) from nodes y where y.depth = a.depth + 1 and y.node[1:a.depth] = a.node) as n_children,
    s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, sha256(coalesce(a.ends, '')) as ends_sha256
from nodes a join under s on s.node = a.node and s.depth = a.depth left join nodes u on u.depth = a.depth - 1 and u.node = a.node[1:a.depth - 1]
"""
