"""Maintenance of a knowledge store: clusters of queries, staleness, decay, pruning and merging of nodes.

Every setting that an ablation switches is a keyword argument; the present time is a parameter.
"""

from __future__ import annotations


import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom import scratch
from sparkloom.functions import vectors as V
from sparkloom.functions.batches import whole_groups

SAME_QUERY = 0.92
READY_HITS = 10
SCALE_DAYS, HIT_CAP, PRUNE_BELOW = 7.0, 10, 0.05
MERGE_ABOVE, MERGE_MOST = 0.88, 500
#: Centroids that are sent to the tasks at most; of more, so many pivots are, and cells hold so many of their rows or vectors.
CENTROIDS_AT_ONCE = 8192
PIVOTS = 1024
CELL_ROWS = 8192
#: What angles of equal similarities, rounded to twelve digits, may differ by.
ROUNDING = 3e-6
DEDUP_WITHIN, DEDUP_FROM = 0.15, 6
#: Items of a job that one task clusters, by a matrix of 128 MB; clusters of a block of larger jobs.
JOB_ROWS = 4096
LINKAGE_ROWS = 2048


def raw_ids(ids: Column, kinds: Column | None = None, prefix: str = "doc_") -> Column:
    """Ids of raw chunks: by a column of their kinds, or by how they begin."""
    if kinds is None:
        return F.filter(ids, lambda x: x.startswith(prefix))
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), kinds.alias("k")), lambda x: x["k"] == "raw"), lambda x: x["i"])


def assign(vectors: DataFrame, centroids: DataFrame, least: float = SAME_QUERY) -> DataFrame:
    """(item_id, cluster_id, similarity): each vector's nearest centroid; cluster_id null below `least`.

    vectors: (item_id, vector); centroids: (cluster_id, centroid). Ties go to the lesser cluster_id. Up to
    CENTROIDS_AT_ONCE centroids are sent to the tasks and nothing is shuffled; more stay where they are, in a tree of
    two levels (see `_by_tree`). Centroids and vectors that are null or of another length, or hold nulls or what isn't
    finite, are compared with nothing; zero vectors have similarity 0.
    """
    known = centroids.where("cluster_id is not null and centroid is not null").select("cluster_id", F.col("centroid").cast("array<double>").alias("centroid"))
    rows = vectors.select("item_id", F.col("vector").cast("array<double>").alias("vector"))
    few = known.limit(CENTROIDS_AT_ONCE + 1).toArrow()
    found = _at_once(rows, known, few) if len(few) <= CENTROIDS_AT_ONCE else _by_tree(rows, known)
    return found.select("item_id", F.when(F.col("similarity") >= least, F.col("cluster_id")).alias("cluster_id"), "similarity")


def _kinds(rows: DataFrame, known: DataFrame) -> tuple[list, str]:
    item, cluster = rows.schema["item_id"].dataType, known.schema["cluster_id"].dataType
    return [to_arrow_type(item), to_arrow_type(cluster), pa.float64()], f"item_id {item.simpleString()}, cluster_id {cluster.simpleString()}, similarity double"


def _lengths(table: pa.Table, vector: str) -> dict[int, pa.Table]:
    size = pc.list_value_length(table[vector])
    return {n.as_py(): table.filter(pc.equal(size, n)) for n in pc.unique(size) if n.is_valid and n.as_py()}


def _at_once(rows: DataFrame, known: DataFrame, few: pa.Table) -> DataFrame:
    kinds, schema = _kinds(rows, known)
    blocks = {}
    for dim, some in _lengths(few.sort_by("cluster_id"), "centroid").items():
        at, matrix = V.unit_rows(some["centroid"], dim, zeros=True)
        blocks[dim] = some["cluster_id"].combine_chunks().take(pa.array(at)), matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (names, matrix) in blocks.items():
                at, unit = V.unit_rows(batch.column("vector"), dim, zeros=True)
                if len(at) and len(names):
                    near = np.round(unit @ matrix.T, 12)
                    best = near.argmax(1)  # the first of equals, and names ascend
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)).cast(kinds[0]), names.take(pa.array(best)).cast(kinds[1]), pa.array(near[np.arange(len(at)), best])], ["item_id", "cluster_id", "similarity"])

    return rows.mapInArrow(run, schema)


def _by_tree(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Nearest centroids by a tree of two levels, exactly.

    The upper level are up to PIVOTS of the centroids of each length, the only ones that are sent to the tasks; every
    centroid stands below the pivot nearest to it. By the triangle inequality on angles a vector's nearest centroid lies
    only below pivots that are no farther from it than its nearest pivot, which is a centroid as well, plus the angle that
    the pivot's centroids lie within. So vectors are routed to those pivots in one pass, and meet their centroids there
    in cells of bounded numbers of both.
    """
    kinds, schema = _kinds(rows, known)
    nth = F.row_number().over(W.partitionBy(F.size("centroid")).orderBy(F.xxhash64("cluster_id"), "cluster_id"))
    pivots = {}
    for dim, some in _lengths(known.withColumn("n", nth).where(F.col("n") <= PIVOTS).select("centroid").toArrow(), "centroid").items():
        pivots[dim] = V.unit_rows(some["centroid"], dim, zeros=True)[1]
    angles = lambda x, dim: np.arccos(np.clip(x @ pivots[dim].T, -1, 1))
    listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in pivots:
                at, unit = V.unit_rows(batch.column("centroid"), dim, zeros=True)
                if len(at):
                    far = angles(unit, dim)
                    own = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim)), pa.array(own), batch.column("cluster_id").take(pa.array(at)).cast(kinds[1]), pa.array(far[np.arange(len(at)), own]), listed(unit)], ["dim", "pivot", "cluster_id", "far", "vector"])

    tree = scratch.written(known.mapInArrow(below, f"dim long, pivot long, cluster_id {known.schema['cluster_id'].dataType.simpleString()}, far double, vector array<double>"), "centroid-tree")
    reach = {dim: np.full(len(p), -np.inf) for dim, p in pivots.items()}
    for r in tree.groupBy("dim", "pivot").agg(F.max("far").alias("far")).collect():  # a row for each pivot
        reach[r["dim"]][r["pivot"]] = r["far"]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in pivots:
                at, unit = V.unit_rows(batch.column("vector"), dim, zeros=True)
                if len(at):
                    far = angles(unit, dim)
                    row, pivot = np.nonzero(far - reach[dim] <= far.min(1, keepdims=True) + ROUNDING)
                    for k in range(0, len(row), max(1, (1 << 22) // dim)):
                        r, p = (x[k : k + max(1, (1 << 22) // dim)] for x in (row, pivot))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), dim)), pa.array(p), batch.column("item_id").take(pa.array(at[r])).cast(kinds[0]), batch.column("n").take(pa.array(at[r])), listed(unit[r])], ["dim", "pivot", "item_id", "n", "vector"])

    item = rows.schema["item_id"].dataType.simpleString()
    # A zero vector is as far from all: its nearest is the least name, at similarity 0.
    zero = F.forall("vector", lambda x: x == 0)
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    asked = scratch.written(numbered.where(~zero).mapInArrow(routed, f"dim long, pivot long, item_id {item}, n long, vector array<double>"), "routed-vectors")
    keys = ["dim", "pivot"]
    blocks = lambda table, name: table.groupBy(*keys).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name))
    cells = F.broadcast(blocks(asked, "i_n").join(blocks(tree, "j_n"), keys))  # a row for each pivot
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    cluster = known.schema["cluster_id"].dataType
    left = asked.join(cells, keys).select(*keys, place("n", "i_n").alias("i"), every("j_n").alias("j"), "item_id", "n", F.lit(None).cast(cluster).alias("cluster_id"), "vector")
    right = tree.join(cells, keys).select(*keys, every("i_n").alias("i"), place("cluster_id", "j_n").alias("j"), F.lit(None).cast(item).alias("item_id"), F.lit(None).cast("long").alias("n"), "cluster_id", "vector")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, [*keys, "i", "j"]):
            for lo, hi in zip(starts[:-1], starts[1:]):
                cell = table.slice(lo, hi - lo)
                is_vector = pc.is_valid(cell["n"])
                own, centres = cell.filter(is_vector), cell.filter(pc.invert(is_vector)).sort_by("cluster_id")
                if len(own) and len(centres):
                    (_, x), (_, c) = (V.unit_rows(t["vector"], zeros=True) for t in (own, centres))
                    near = np.round(x @ c.T, 12)
                    best = near.argmax(1)
                    yield pa.RecordBatch.from_arrays([own["n"].combine_chunks(), own["item_id"].combine_chunks().cast(kinds[0]), centres["cluster_id"].combine_chunks().take(pa.array(best)).cast(kinds[1]), pa.array(near[np.arange(len(own)), best])], ["n", "item_id", "cluster_id", "similarity"])

    order = [*keys, "i", "j"]
    found = left.unionByName(right).repartition(*order).sortWithinPartitions(*order).mapInArrow(nearest, f"n long, {schema}")
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "cluster_id")).alias("b")
    found = found.groupBy("n").agg(F.first("item_id").alias("item_id"), best).select("item_id", "b.cluster_id", (-F.col("b.far")).alias("similarity"))
    least_name = tree.groupBy("dim").agg(F.min("cluster_id").alias("cluster_id"))
    zeros = rows.where(zero & (F.size("vector") > 0)).select("item_id", F.size("vector").cast("long").alias("dim")).join(F.broadcast(least_name), "dim")
    return found.unionByName(zeros.select("item_id", "cluster_id", F.lit(0.0).alias("similarity")))


def cluster_log(hits: DataFrame) -> DataFrame:
    """(cluster_id, hit_count, last_hit, chunk_ids) from logged queries (cluster_id, ts, chunk_ids)."""
    # Ids are told apart before they meet in a row, so a cluster holds each of them once however often it was hit.
    ids = hits.select("cluster_id", F.explode("chunk_ids").alias("id")).distinct().groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("chunk_ids"))
    counted = hits.groupBy("cluster_id").agg(F.count("*").alias("hit_count"), F.max("ts").alias("last_hit"))
    out = counted.join(ids.withColumnRenamed("cluster_id", "__id"), F.col("cluster_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    return out.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast(hits.schema["chunk_ids"].dataType)))


def centroids(vectors: DataFrame, by: str = "cluster_id", vector: str = "vector") -> DataFrame:
    """(by, pos, value): element-wise means of each group's vectors."""
    return vectors.select(by, F.posexplode(vector).alias("pos", "value")).groupBy(by, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))


def ready(clusters: DataFrame, hits: int = READY_HITS) -> DataFrame:
    return clusters.where((F.col("hit_count") >= hits) & ~F.coalesce("synthesized", F.lit(False)) & ~F.coalesce("synthesizing", F.lit(False)))


def staleness(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """(node_id, n_sources, n_alive, ratio, is_stale, gone): nodes (node_id, source_chunks) against raw (chunk_id)."""
    sources = nodes.select("node_id", F.explode_outer("source_chunks").alias("chunk_id"))
    alive = raw.select("chunk_id", F.lit(1).alias("alive")).distinct()
    counted = sources.join(alive, "chunk_id", "left").groupBy("node_id").agg(F.count("chunk_id").alias("n_sources"), F.count("alive").alias("n_alive"))
    ratio = F.coalesce(F.try_divide(F.col("n_alive").cast("double"), F.col("n_sources")), F.lit(0.0))
    return counted.withColumn("ratio", ratio).withColumns({"is_stale": F.col("ratio") < 1, "gone": F.col("ratio") == 0})


def decayed(nodes: DataFrame, clusters: DataFrame, now: Column, scale: float = SCALE_DAYS, cap: int = HIT_CAP, below: float = PRUNE_BELOW, linear: bool = False) -> DataFrame:
    """nodes (node_id, access_count, last_accessed, created_at) with hits, decay_score and pruned.

    Hits are those of the node's cluster (super_node_id, hit_count), else its accesses.
    """
    joined = nodes.join(clusters.select(F.col("super_node_id").alias("node_id"), "hit_count"), "node_id", "left")
    hits = F.coalesce("hit_count", "access_count", F.lit(0))
    score = hits / (V.whole_days(F.col("created_at"), now) + 1) if linear else V.decay(hits, V.whole_days(F.col("last_accessed"), now), scale, cap)
    return joined.withColumn("hits", hits).withColumn("decay_score", score).withColumn("pruned", F.col("decay_score") < below)


def similar_pairs(nodes: DataFrame, above: float = MERGE_ABOVE, most: int = MERGE_MOST) -> DataFrame:
    """(a, b, similarity) with a < b among the `most` most accessed nodes (node_id, vector, access_count, in_hierarchy).

    The nodes compared are at most `most`, so their vectors go to every task, and a task compares its own in one
    product. Zero vectors, and null ones, are similar to nothing.
    """
    free = nodes.where(~F.coalesce("in_hierarchy", F.lit(False)) & F.col("vector").isNotNull()).orderBy(F.desc("access_count"), "node_id").limit(most).select("node_id", "vector")
    kind, name = to_arrow_type(nodes.schema["node_id"].dataType), dict(nodes.dtypes)["node_id"]
    known = free.toArrow()
    names, unit = known["node_id"].to_pylist(), _unit(known["vector"].to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("node_id").to_pylist()
            near = _unit(batch.column("vector").to_pylist()) @ unit.T
            found = [(own[i], names[j], float(near[i, j])) for i, j in zip(*np.nonzero(near > above)) if own[i] < names[j]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.float64())], ["a", "b", "similarity"])

    if not names:
        return nodes.sparkSession.createDataFrame([], f"a {name}, b {name}, similarity double")
    return free.mapInArrow(run, f"a {name}, b {name}, similarity double")


def _unit(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    norms = np.sqrt((v * v).sum(1, keepdims=True)) if len(v) else v
    return v / np.where(norms > 0, norms, np.inf)


def merge_plan(pairs: DataFrame) -> DataFrame:
    """(parent_id, child_id): a matching of the pairs (a, b, similarity), most similar first; no node has two parents.

    It is the greedy one: pairs in the order of similarity, ties to the lesser (a, b), each taken if both ends are free.
    In a round, a pair that comes first at both ends is taken. One that comes first at one end and second at the
    other hangs on a single other pair: it is taken if that one isn't. Such chains, however long, are followed by pointer
    doubling, each step twice as far, and taken or not by the parity of their length. Then all pairs at taken ends go. So
    rounds follow neither chains nor sizes; each is a few joins of tables in the shared folder.
    """
    key = ["far", "a", "b"]
    name = F.concat_ws("_", F.lit("mn"), F.col("a").cast("string"), F.col("b").cast("string"))
    left = scratch.written(pairs.select((-F.round("similarity", 12)).alias("far"), "a", "b").distinct(), "pairs")
    taken = []
    while not left.isEmpty():
        p = F.struct(*key)
        ends = left.select(F.explode(F.array("a", "b")).alias("node"), p.alias("p"))
        # The two first pairs of each node: limits by rank, which tasks apply before anything is shuffled.
        two = ends.withColumn("nth", F.row_number().over(W.partitionBy("node").orderBy("p"))).where("nth <= 2")
        nodes = two.groupBy("node").agg(F.min("p").alias("first"), F.max(F.when(F.col("nth") == 2, F.col("p"))).alias("second"))
        of = F.array(F.struct(F.col("first").alias("p"), F.lit(None).cast(nodes.schema["first"].dataType).alias("up")), F.struct(F.col("second").alias("p"), F.col("first").alias("up")))
        seen = nodes.select(F.inline(of)).where("p is not null").groupBy("p").agg(F.count("*").alias("n"), F.count("up").alias("seconds"), F.max("up").alias("up"))
        best = scratch.written(seen.where("n = 2 and seconds < 2").select("p", F.coalesce("up", "p").alias("up"), F.col("up").isNull().alias("sure"), F.col("up").isNotNull().cast("int").alias("steps")), "first-pairs")
        while True:  # each pair looks from its forebear to that one's forebear
            above = best.select(F.col("p").alias("__p"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("sure").alias("__sure"))
            joined = best.join(above, F.col("up") == F.col("__p"), "left")
            reached = F.col("sure") | F.coalesce("__sure", F.lit(False))
            on = F.col("__p").isNotNull() & ~F.col("sure")
            moved = (on & (F.col("__up") != F.col("up"))).alias("moved")
            nxt = scratch.written(joined.select("p", F.when(on, F.col("__up")).otherwise(F.col("up")).alias("up"), reached.alias("sure"), ((F.col("steps") + F.when(on, F.col("__steps")).otherwise(0)) % 2).alias("steps"), moved), "chains")
            scratch.drop(best)
            best = nxt
            if best.where("moved").isEmpty():
                break
        new = scratch.written(best.where("sure and steps = 0").select("p.*"), "taken-pairs")
        scratch.drop(best)
        gone = new.select(F.explode(F.array("a", "b")).alias("gone"))
        rest = scratch.written(left.join(gone, F.col("a") == F.col("gone"), "left_anti").join(gone, F.col("b") == F.col("gone"), "left_anti"), "pairs")
        scratch.drop(left)
        taken.append(new)
        left = rest
    both = functools.reduce(DataFrame.unionAll, taken) if taken else left
    return both.select(name.alias("parent_id"), F.explode(F.array("a", "b")).alias("child_id"))


def meta_nodes(plan: DataFrame, nodes: DataFrame, now: Column, merge: Callable[[Column, Column], Column] | None = None, max_depth: int = 2) -> DataFrame:
    """(id, type, text, embedding, children, access_count, depth, created_at, in_hierarchy): a node above each matched pair.

    nodes: (node_id, text, vector, access_count) and, if there, in_hierarchy and depth (nulls count as false and 0).
    merge makes the text of two texts, by default one below the other; the embedding is the mean of the children's, the
    accesses their sum. Pairs with a child that is in a hierarchy already are left out, and those that would stand
    deeper than max_depth. A new node is no child itself.
    """
    merge = merge or (lambda x, y: F.concat_ws("\n\n", x, y))
    child = [F.col("node_id").alias("child_id"), "text", "vector", F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count")]
    child += [(F.coalesce("depth", F.lit(0)) if "depth" in nodes.columns else F.lit(0)).cast("int").alias("depth"), (F.coalesce("in_hierarchy", F.lit(False)) if "in_hierarchy" in nodes.columns else F.lit(False)).alias("locked")]
    members = F.array_sort(F.collect_list(F.struct("child_id", "text", "vector", "access_count", "depth", "locked")))  # two to a parent
    pairs = plan.join(nodes.select(*child), "child_id").groupBy("parent_id").agg(members.alias("c")).where((F.size("c") == 2) & ~F.exists("c", lambda x: x["locked"]))
    one, two = F.col("c")[0], F.col("c")[1]
    mean = F.zip_with(one["vector"], two["vector"], lambda x, y: (x + y) / 2)
    out = pairs.select(
        F.col("parent_id").alias("id"), F.lit("meta_node").alias("type"), merge(one["text"], two["text"]).alias("text"), mean.alias("embedding"), F.array(one["child_id"], two["child_id"]).alias("children"),
        (one["access_count"] + two["access_count"]).alias("access_count"), (F.greatest(one["depth"], two["depth"]) + 1).alias("depth"), now.alias("created_at"), F.lit(False).alias("in_hierarchy"),
    )
    return out.where(F.col("depth") <= max_depth)


def locked_children(nodes: DataFrame, metas: DataFrame) -> DataFrame:
    """nodes with in_hierarchy and parent_meta_id set for the children of new meta nodes, so that later merges pass them by."""
    parents = metas.select(F.explode("children").alias("node_id"), F.col("id").alias("__parent"))
    before = F.col("parent_meta_id") if "parent_meta_id" in nodes.columns else F.lit(None).cast("string")
    locked = F.coalesce("in_hierarchy", F.lit(False)) if "in_hierarchy" in nodes.columns else F.lit(False)
    return nodes.join(parents, "node_id", "left").withColumns({"in_hierarchy": locked | F.col("__parent").isNotNull(), "parent_meta_id": F.coalesce("__parent", before)}).drop("__parent")


def access_counts(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """nodes with the hits (node_id) of a batch added to access_count."""
    new = hits.groupBy("node_id").agg(F.count("*").alias("__new"))
    return nodes.join(new, "node_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("__new", F.lit(0))).drop("__new")


def average_linkage(vectors: np.ndarray, within: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers by average-linkage agglomeration on cosine distance, merged while no farther than `within`.

    sizes: the vectors are means of so many unit vectors each, clusters that have been formed before.
    """
    n = len(vectors)
    norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    unit = vectors / np.where(norms > 0, norms, 1.0) if sizes is None else vectors
    far = 1 - unit @ unit.T
    np.fill_diagonal(far, np.inf)
    size, label = np.ones(n) if sizes is None else sizes.astype(float), np.arange(n)
    # Each row's least distance and where it stands first, so that a merge looks again only at rows that it touches.
    nearest = far.argmin(1) if n else np.zeros(0, int)
    least = far[np.arange(n), nearest]
    for _ in range(n - 1):
        i = int(least.argmin())
        j = int(nearest[i])
        if least[i] > within:
            break
        i, j = min(i, j), max(i, j)
        row = (far[i] * size[i] + far[j] * size[j]) / (size[i] + size[j])
        far[i], far[:, i] = row, row
        far[j], far[:, j], far[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        nearest[j], least[j] = -1, np.inf
        again = (nearest == i) | (nearest == j)
        again[i] = True
        nearer = ~again & ((far[:, i] < least) | (far[:, i] == least) & (i < nearest))
        nearest[nearer], least[nearer] = i, far[nearer, i]
        again = np.flatnonzero(again)
        nearest[again] = far[again].argmin(1)
        least[again] = far[again, nearest[again]]
    return label


def semantic_dedup(items: DataFrame, within: float = DEDUP_WITHIN, least: int = DEDUP_FROM) -> DataFrame:
    """(job_id, item_id, cluster, kept): of each job's items (job_id, item_id, pos, vector) one for each cluster, the first.

    Clusters are those of average linkage on cosine distance, cut at `within`. Jobs with fewer than `least` items keep all
    of them. A job of up to JOB_ROWS items is clustered by one task; larger ones over many tasks, see `_linked_in_rounds`.
    `cluster` is the number, from 0, of the cluster's first item in the job.
    """
    kinds = dict(items.dtypes)
    schema = f"job_id {kinds['job_id']}, item_id {kinds['item_id']}, cluster int, kept boolean"

    def run(job: pd.DataFrame) -> pd.DataFrame:
        job = job.sort_values(["pos", "item_id"])
        label = np.arange(len(job)) if len(job) < least else average_linkage(np.array(job["vector"].tolist(), np.float64), within)
        first = pd.Series(label).drop_duplicates().index
        kept = np.zeros(len(job), bool)
        kept[first] = True
        return pd.DataFrame({"job_id": job["job_id"].to_numpy(), "item_id": job["item_id"].to_numpy(), "cluster": label.astype("int32"), "kept": kept})

    large = scratch.written(items.groupBy(F.col("job_id").alias("__job")).agg(F.count("*").alias("__n")).where(F.col("__n") > max(JOB_ROWS, least - 1)), "large-jobs")
    if large.isEmpty():
        return items.groupBy("job_id").applyInPandas(run, schema)
    same = F.col("job_id").eqNullSafe(F.col("__job"))
    small = items.join(large, same, "left_anti").groupBy("job_id").applyInPandas(run, schema)
    order = W.partitionBy("job_id").orderBy("pos", "item_id")
    numbered = items.join(large.select("__job"), same, "left_semi").select("job_id", "item_id", (F.row_number().over(order) - 1).cast("long").alias("n"), F.col("vector").cast("array<double>").alias("vector"))
    numbered = scratch.written(numbered, "large-items")
    roots = _linked_in_rounds(numbered.select("job_id", "n", "vector"), within)
    found = numbered.select(F.col("job_id"), "item_id", "n").join(roots.withColumnRenamed("job_id", "__job"), same & (F.col("n") == F.col("__n")), "left")
    root = F.coalesce("root", "n")
    return small.unionByName(found.select("job_id", "item_id", root.cast("int").alias("cluster"), (root == F.col("n")).alias("kept")))


def _nearest_clusters(clusters: DataFrame, within: float) -> DataFrame:
    """(job_id, cluster, size, total, other): each cluster's nearest one of its job, for those that have one within reach.

    clusters: (job_id, cluster, size, total), total being the sum of its unit vectors: the average distance of two
    clusters' items is one minus the product of their means. A job's clusters meet in a grid of blocks.
    """
    job = clusters.schema["job_id"].dataType
    blocks = clusters.groupBy("job_id").agg(F.ceil(F.count("*") / LINKAGE_ROWS).cast("int").alias("blocks")).withColumnRenamed("job_id", "__job")
    mine = F.pmod(F.xxhash64("cluster"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(mine, b).alias("i"), F.greatest(mine, b).alias("j")))
    rows = clusters.join(blocks, F.col("job_id").eqNullSafe(F.col("__job"))).select("job_id", F.xxhash64(F.col("job_id").cast("string")).alias("key"), "cluster", "size", "total", mine.alias("mine"), F.inline(cells))
    keys = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            for lo, hi in zip(starts[:-1], starts[1:]):
                cell = table.slice(lo, hi - lo).sort_by("cluster").combine_chunks()
                names, block = cell["cluster"].to_numpy(), cell["mine"].to_numpy()
                total = cell["total"].combine_chunks()
                mean = total.flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1) / cell["size"].to_numpy()[:, None]
                i, j = cell["i"][0].as_py(), cell["j"][0].as_py()
                for one, two in [(i, j)] if i == j else [(i, j), (j, i)]:
                    own, near = np.flatnonzero(block == one), np.flatnonzero(block == two)
                    if not len(own) or not len(near):
                        continue
                    far = np.round(1 - mean[own] @ mean[near].T, 12)
                    if one == two:
                        np.fill_diagonal(far, np.inf)
                    best = far.argmin(1)  # the first of equals
                    d = far[np.arange(len(own)), best]
                    ok = np.flatnonzero(d <= within)
                    yield pa.RecordBatch.from_arrays([cell["job_id"].combine_chunks().take(pa.array(own[ok])).cast(to_arrow_type(job)), pa.array(names[own[ok]]), pa.array(d[ok]), pa.array(names[near[best[ok]]])], ["job_id", "cluster", "far", "other"])

    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"job_id {job.simpleString()}, cluster long, far double, other long")
    found = found.groupBy("job_id", "cluster").agg(F.min(F.struct("far", "other")).alias("b")).select(F.col("job_id").alias("__job"), F.col("cluster").alias("__cluster"), "b.other")
    return clusters.join(found, F.col("job_id").eqNullSafe(F.col("__job")) & (F.col("cluster") == F.col("__cluster"))).select(*clusters.columns, "other")


def _linked_in_rounds(items: DataFrame, within: float) -> DataFrame:
    """(job_id, __n, root) of items (job_id, n, vector): average linkage by rounds of reciprocal nearest neighbours.

    Two clusters that are each other's nearest can be merged at once, whatever else is, as average linkage never brings
    clusters nearer than their parts were; for the same reason a cluster without another within reach is done. So each
    round merges many pairs, over many tasks, and the next one holds the rest only. Once no job has more than JOB_ROWS
    clusters left, a task each takes them on. Where distances are equal the lesser numbers go first; vectors that are null
    or hold what isn't a number stay alone.
    """
    job = items.schema["job_id"].dataType

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = V.unit_rows(batch.column("vector"), zeros=True)
            if len(at):
                total = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * unit.shape[1], pa.int32()), pa.array(unit.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("job_id").take(pa.array(at)).cast(to_arrow_type(job)), batch.column("n").take(pa.array(at)), pa.array(np.ones(len(at), np.int64)), total], ["job_id", "cluster", "size", "total"])

    clusters = scratch.written(items.mapInArrow(units, f"job_id {job.simpleString()}, cluster long, size long, total array<double>"), "clusters")
    roots = items.select("job_id", F.col("n").alias("__n"), F.col("n").alias("root"))

    def rest(left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("cluster")
        size = left["size"].to_numpy()
        label = average_linkage(np.array(left["total"].tolist(), np.float64) / size[:, None], within, size)
        names = left["cluster"].to_numpy()
        return pd.DataFrame({"__job": left["job_id"].to_numpy(), "was": names, "into": names[label]})

    def moved(gone: DataFrame) -> DataFrame:
        joined = roots.join(gone, F.col("job_id").eqNullSafe(F.col("__job")) & (F.col("root") == F.col("was")), "left")
        return scratch.written(joined.select("job_id", "__n", F.coalesce("into", "root").alias("root")), "roots")

    while True:
        near = scratch.written(_nearest_clusters(clusters, within), "nearest")
        scratch.drop(clusters)
        other = near.select(F.col("job_id").alias("__job"), F.col("cluster").alias("__cluster"), F.col("other").alias("__other"), F.col("size").alias("__size"), F.col("total").alias("__total"))
        both = F.col("job_id").eqNullSafe(F.col("__job")) & (F.col("other") == F.col("__cluster")) & (F.col("cluster") == F.col("__other"))
        joined = near.join(other, both, "left")
        paired = F.col("__cluster").isNotNull()
        total = F.when(paired, F.zip_with("total", "__total", lambda x, y: x + y)).otherwise(F.col("total"))
        # Of a pair the lesser name stays.
        after = joined.select("job_id", F.least("cluster", F.coalesce("__cluster", "cluster")).alias("cluster"), (F.col("size") + F.coalesce("__size", F.lit(0))).alias("size"), total.alias("total"), F.col("cluster").alias("was"), paired.alias("paired"))
        after = scratch.written(after, "merged")
        scratch.drop(near)
        gone = after.where("was != cluster").select(F.col("job_id").alias("__job"), "was", F.col("cluster").alias("into"))
        if gone.isEmpty():
            return roots
        roots = moved(gone)
        clusters = scratch.written(after.where("was = cluster").select("job_id", "cluster", "size", "total"), "clusters")
        scratch.drop(after)
        if clusters.groupBy("job_id").agg(F.count("*").alias("n")).where(F.col("n") > JOB_ROWS).isEmpty():
            return moved(clusters.groupBy("job_id").applyInPandas(rest, f"__job {job.simpleString()}, was long, into long"))


def super_nodes(synthesized: DataFrame, clusters: DataFrame, now: Column) -> DataFrame:
    """New nodes from passed summaries (cluster_id, text, coverage_score, passed): seeded with the cluster's hits."""
    stamp = F.date_format(now, "yyyyMMddHHmmss")
    passed = synthesized.where("passed").join(clusters.select("cluster_id", "canonical_query", "hit_count", "chunk_ids"), "cluster_id")
    return passed.select(
        F.concat_ws("_", F.lit("sn"), F.col("cluster_id").cast("string"), stamp).alias("id"),
        F.lit("super_node").alias("type"),
        "text",
        F.col("canonical_query").alias("source_query"),
        F.col("chunk_ids").alias("source_chunks"),
        F.col("hit_count").alias("access_count"),
        now.alias("created_at"),
        now.alias("last_accessed"),
        F.lit(1.0).alias("decay_score"),
        "cluster_id",
        F.col("coverage_score").alias("fact_coverage"),
        F.lit(False).alias("in_hierarchy"),
        F.lit(False).alias("is_stale"),
    )


class OnlineClusters:
    """Online clustering: a vector joins the nearest centroid if it is near enough, and moves it; else it starts a cluster.

    Centroids are rows of one matrix that grows by doubling. With `idle`, clusters that weren't hit for longer than that
    before a vector's time are closed first; numbers aren't used again.
    """

    def __init__(self, least: float = SAME_QUERY, moving: bool = True, idle: int | None = None):
        self.least, self.moving, self.idle = least, moving, idle
        self.numbers, self.hits, self.last, self.next = [], [], [], 0
        self.matrix = np.zeros((0, 0))
        self.closed: list[tuple] = []  # those that add() has closed

    @property
    def sums(self) -> np.ndarray:
        return self.matrix[: len(self.hits)]

    def restore(self, rows: list[tuple], following: int) -> None:
        """Take up the state that state() gave."""
        self.numbers, self.hits, self.last = ([r[k] for r in rows] for k in range(3))
        self.matrix, self.next = np.array([r[3] for r in rows], np.float64) if rows else np.zeros((0, 0)), following

    def state(self) -> list[tuple]:
        """(number, hits, last hit, centroid) of each cluster."""
        return [(n, h, t, c.tolist()) for n, h, t, c in zip(self.numbers, self.hits, self.last, self.sums)]

    def close(self, before: int) -> list[tuple]:
        """Drop the clusters last hit before a time; returns them as state() does."""
        gone = [k for k, t in enumerate(self.last) if t < before]
        if not gone:
            return []
        rows = self.state()
        self.restore([r for k, r in enumerate(rows) if k not in set(gone)], self.next)
        return [rows[k] for k in gone]

    def add(self, vector, at: int = 0) -> int:
        if self.idle is not None:
            self.closed += self.close(at - self.idle)
        v = np.asarray(vector, np.float64)
        if self.hits:
            c = self.sums
            norms = np.sqrt((c * c).sum(1)) * np.sqrt(v @ v)
            near = c @ v / np.where(norms > 0, norms, 1.0)
            k = int(near.argmax())
            if near[k] >= self.least:
                if self.moving:
                    c[k] = (c[k] * self.hits[k] + v) / (self.hits[k] + 1)
                self.hits[k] += 1
                self.last[k] = max(self.last[k], at)
                return self.numbers[k]
        n = len(self.hits)
        if n >= len(self.matrix):
            grown = np.zeros((max(16, 2 * n), len(v)))
            grown[:n] = self.matrix[:n] if n else 0
            self.matrix = grown
        self.matrix[n] = v
        self.numbers.append(self.next)
        self.hits.append(1)
        self.last.append(at)
        self.next += 1
        return self.next - 1


def online_clusters(rows: DataFrame, shard: str, least: float = SAME_QUERY, moving: bool = True, idle: str | None = None) -> DataFrame:
    """(shard, item_id, cluster): rows (shard, item_id, pos, vector) clustered online in the order of pos, each shard for itself.

    idle: clusters that weren't hit for so long ("1 hour") are closed; rows have a timestamp `ts` then, which comes before
    pos in their order.
    """
    kinds = dict(rows.dtypes)
    micros = None if idle is None else pd.Timedelta(idle).value // 1000
    timed = rows.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")) if idle else F.lit(0).cast("long"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__at", "pos", "item_id"])
        c = OnlineClusters(least, moving, micros)
        return pd.DataFrame({"shard": part[shard].to_numpy(), "item_id": part["item_id"].to_numpy(), "cluster": [c.add(v, t) for v, t in zip(part["vector"], part["__at"])]})

    return timed.groupBy(shard).applyInPandas(run, f"shard {kinds[shard]}, item_id {kinds['item_id']}, cluster int")
