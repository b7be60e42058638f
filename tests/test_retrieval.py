import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import embed as E
from sparkloom.operators import evaluate as EV
from sparkloom.operators import evolve as EO
from sparkloom.operators import generate as G
from sparkloom.operators import retrieve as RT
from sparkloom.operators import stats as S
from sparkloom.operators import upsert as U
from sparkloom.plans import corpus


@pytest.mark.parametrize("block, grid", [(4096, 32_768), (3, 25), (3, 1000)])
def test_top_k_against_numpy(spark, monkeypatch, block, grid):
    monkeypatch.setattr(RT, "QUERY_BLOCK", block)
    monkeypatch.setattr(RT, "GRID_ROWS", grid)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (501, [0.0] * 8)], "item_id int, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(7)], "query_id int, query_vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    # Queries of other lengths meet items of theirs.
    rows = rows.unionByName(spark.createDataFrame([(600, [1.0, 2.0]), (601, [2.0, 4.0])], rows.schema))
    asked = asked.unionByName(spark.createDataFrame([(90, [1.0, 2.0]), (91, None), (92, [0.0, 0.0]), (93, [1.0])], asked.schema))
    got = RT.top_k(asked, rows, 4).orderBy("query_id", "rank").collect()
    for q in range(7):
        own = [r["item_id"] for r in got if r["query_id"] == q]
        assert own == np.argsort(1 - unit @ unit[q], kind="stable")[:4].tolist()
    assert [r["item_id"] for r in got if r["query_id"] >= 90] == [600, 601]
    assert RT.top_k(asked.limit(0), rows, 4).count() == 0 == RT.top_k(asked, rows.limit(0), 4).count()


def test_top_k_settles_ties_by_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 7, 5)], "item_id int, vector array<double>")
    asked = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, query_vector array<double>")
    assert [r["item_id"] for r in RT.top_k(asked, rows, 2).orderBy("rank").collect()] == [3, 5]


def test_check_k_and_blank_queries(spark):
    with pytest.raises(ValueError):
        RT.check_k(0)
    with pytest.raises(ValueError):
        RT.check_k(11)
    assert RT.nonblank(spark.createDataFrame([("a",), ("  ",), (None,)], "query string")).count() == 1


def test_recall_and_mrr(spark):
    first = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "query_id int, first int")
    r = EV.recall_and_mrr(first).first()
    assert (r["recall_at_1"], r["recall_at_3"], r["recall_at_5"], r["mrr"]) == pytest.approx((1 / 3, 2 / 3, 2 / 3, 4 / 9))


def test_masking_and_boost(spark):
    raw = spark.createDataFrame([(1, "r", 0.5)], "query_id int, item_id string, distance double")
    sup = spark.createDataFrame([(1, "meta", 0.6), (1, "child", 0.1), (1, "free", 0.55)], "query_id int, item_id string, distance double")
    kids = spark.createDataFrame([("meta", "child")], "parent_id string, child_id string")
    got = RT.preferential(raw, sup, kids, F.lit(True), 5).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == ["free", "r", "meta"]
    got = RT.preferential(raw, sup, kids, F.lit(False), 5).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == ["r", "free", "meta"]


def test_decay(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    at = lambda days: dt.datetime(2024, 3, 1) - dt.timedelta(days=days)
    nodes = spark.createDataFrame([("a", 5, at(0), at(0)), ("b", 1, at(60), at(60)), ("c", 8, at(1), at(1))], "node_id string, access_count int, last_accessed timestamp, created_at timestamp")
    none = spark.createDataFrame([], "super_node_id string, hit_count bigint")
    got = {r["node_id"]: r for r in EO.decayed(nodes, none, now).collect()}
    assert got["a"]["decay_score"] == 5.0 and not got["a"]["pruned"]
    assert got["b"]["decay_score"] < 0.05 and got["b"]["pruned"]
    assert got["c"]["decay_score"] > 1.0


def test_staleness(spark):
    nodes = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3"]), ("c", ["1"]), ("d", [])], "node_id string, source_chunks array<string>")
    raw = spark.createDataFrame([("1",)], "chunk_id string")
    got = {r["node_id"]: (r["ratio"], r["is_stale"], r["gone"]) for r in EO.staleness(nodes, raw).collect()}
    assert got == {"a": (0.5, True, False), "b": (0.0, True, True), "c": (1.0, False, False), "d": (0.0, True, True)}


def test_ready_clusters(spark):
    rows = spark.createDataFrame([(1, 10, False), (2, 5, False), (3, 15, True)], "cluster_id int, hit_count int, synthesized boolean").withColumn("synthesizing", F.lit(False))
    assert [r["cluster_id"] for r in EO.ready(rows).collect()] == [1]


def test_semantic_dedup(spark):
    base = [float(v) for v in range(1, 9)]
    near = [(1, f"n{i}", i, [v + 0.01 * i for v in base]) for i in range(10)]
    few = [(2, f"f{i}", i, base) for i in range(4)]
    got = EO.semantic_dedup(spark.createDataFrame(near + few, "job_id int, item_id string, pos int, vector array<double>"))
    assert got.where("job_id = 1 and kept").count() == 1 and got.where("job_id = 2 and kept").count() == 4


def test_average_linkage_equals_brute_force():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 7, 60):
        v = rng.normal(size=(n, 3)) if n != 7 else np.ones((7, 3))
        unit = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
        far, groups = 1 - unit @ unit.T, [[i] for i in range(n)]
        while len(groups) > 1:
            d, x, y = min((round(float(far[np.ix_(a, b)].mean()), 9), a[0], b[0]) for k, a in enumerate(groups) for b in groups[k + 1 :])
            if d > 0.6:
                break
            a, b = (next(g for g in groups if g[0] == z) for z in (x, y))
            groups = sorted([*(g for g in groups if g not in (a, b)), sorted(a + b)])
        got = EO.average_linkage(v, 0.6)
        assert sorted([i for i in range(n) if got[i] == c] for c in set(got.tolist())) == groups


def test_semantic_dedup_compares_vectors_with_distant_ids(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist(), 1) for i in range(0, 1000, 100)]
    rows += [(i + 7050, v, 1) for i, v, _ in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = corpus.semantic_dedup(spark, str(tmp_path)).collect()
    assert len(got) == 20 and all(not r["kept"] for r in got if r["item_id"] >= 7050)


@pytest.mark.parametrize("at_once", [8192, 3])
def test_assign(spark, monkeypatch, at_once):
    monkeypatch.setattr(EO, "CENTROIDS_AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    x, c = rng.standard_normal((50, 6)), rng.standard_normal((9, 6))
    c[4] = c[2]  # a tie goes to the lesser id
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(98, [0.0] * 6), (99, None), (97, [1.0])], "item_id long, vector array<double>").repartition(3)
    centroids = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(c)] + [("none", None)], "cluster_id string, centroid array<double>")
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    got = {r["item_id"]: (r["cluster_id"], r["similarity"]) for r in EO.assign(vectors, centroids, 0.5).collect()}
    assert got.pop(98) == (None, 0.0) and set(got) == set(range(50))
    for i in range(50):
        k = int(np.round(near[i], 12).argmax())
        assert got[i][0] == (f"c{k}" if near[i, k] >= 0.5 else None) and got[i][1] == pytest.approx(near[i, k])
    assert EO.assign(vectors, centroids.limit(0)).count() == 0


@pytest.mark.parametrize("dim, n", [(3, 900), (24, 700)])
def test_assign_by_a_tree_is_exact(spark, monkeypatch, dim, n):
    """More centroids than are sent to the tasks: the same rows as by all pairs, in cells of a few rows."""
    rng = np.random.default_rng(dim)
    c = np.repeat(rng.standard_normal((n // 10, dim)), 10, 0) + 0.1 * rng.standard_normal((n // 10 * 10, dim))
    x = np.concatenate([c[::7] + 0.05 * rng.standard_normal(c[::7].shape), rng.standard_normal((60, dim)), [c[3], 2 * c[5]]])
    vectors = spark.createDataFrame([(f"i{i}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * dim), ("short", [1.0]), ("null", None), ("hole", [None] * dim), ("nan", [float("nan")] * dim), ("empty", [])], "item_id string, vector array<double>").repartition(3)
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(9000, c[3].tolist()), (9001, [0.0] * dim), (9002, [2.0, 1.0]), (None, c[0].tolist())], "cluster_id long, centroid array<double>").repartition(4)
    rows = lambda: sorted((r["item_id"], r["cluster_id"], round(r["similarity"], 9)) for r in EO.assign(vectors, centroids, 0.6).collect())
    expected = rows()
    assert len(expected) == len(x) + 1 and (f"i{len(x) - 2}", 3, 1.0) in expected
    monkeypatch.setattr(EO, "CENTROIDS_AT_ONCE", 50)
    monkeypatch.setattr(EO, "PIVOTS", 20)
    monkeypatch.setattr(EO, "CELL_ROWS", 16)
    assert rows() == expected


def greedy(pairs):
    used, out = set(), []
    for a, b, _ in sorted(pairs, key=lambda p: (-round(p[2], 12), p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            out += [(f"mn_{a}_{b}", a), (f"mn_{a}_{b}", b)]
    return sorted(out)


def test_merge_plan_is_greedy(spark):
    rng = np.random.default_rng(6)
    pairs = {(int(a), int(b)): round(float(s), 2) for a, b, s in zip(rng.integers(0, 40, 150), rng.integers(40, 60, 150), rng.random(150))}
    pairs = [(a, b, s) for (a, b), s in pairs.items()] + [(200, i, 0.5) for i in range(201, 230)]  # a star of ties
    plan = EO.merge_plan(spark.createDataFrame(pairs, "a long, b long, similarity double"))
    assert sorted(map(tuple, plan.collect())) == greedy(pairs)
    assert EO.merge_plan(spark.createDataFrame([], "a long, b long, similarity double")).count() == 0


def test_merge_plan_of_a_long_chain(spark):
    """Similarities that rise along a chain decide each pair by the next one; rounds don't follow it."""
    n = 100_000
    pairs = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") / n).alias("similarity"))
    written = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(EO.scratch, "written", lambda df, name, f=EO.scratch.written: written.append(name) or f(df, name))
        plan = EO.merge_plan(pairs)
        got = {r["child_id"] for r in plan.collect()}
    assert got == {i for k in range(n, 0, -2) for i in (k, k - 1)} and written.count("pairs") <= 3 and written.count("chains") <= 20


def test_meta_nodes_and_locks(spark):
    nodes = spark.createDataFrame([(1, "a", [1.0, 0.0], 2, False, 0), (2, "b", [0.0, 1.0], 3, None, 1), (3, "c", [1.0, 1.0], None, False, 2), (4, "d", [1.0, 0.0], 1, False, None), (5, "e", [1.0, 0.0], 1, True, 0), (6, "f", [1.0, 0.0], 1, False, 0)], "node_id int, text string, vector array<double>, access_count int, in_hierarchy boolean, depth int")
    plan = spark.createDataFrame([("m1", 1), ("m1", 2), ("m2", 3), ("m2", 4), ("m3", 5), ("m3", 6)], "parent_id string, child_id int")
    made = EO.meta_nodes(plan, nodes, F.current_timestamp())
    (r,) = made.collect()  # the second pair would stand too deep, the third is locked
    assert (r["id"], r["text"], r["embedding"], r["children"], r["access_count"], r["depth"], r["in_hierarchy"]) == ("m1", "a\n\nb", [0.5, 0.5], [1, 2], 5, 2, False)
    locked = {r["node_id"]: (r["in_hierarchy"], r["parent_meta_id"]) for r in EO.locked_children(nodes, made).collect()}
    assert locked == {1: (True, "m1"), 2: (True, "m1"), 3: (False, None), 4: (False, None), 5: (True, None), 6: (False, None)}


def test_query_log_becomes_super_nodes(spark):
    """From logged queries over clusters and summaries to new nodes, ids of raw chunks only."""
    hits = spark.createDataFrame([(1, dt.datetime(2024, 1, d), ["doc_1", "sn_9", f"doc_{d}"]) for d in range(1, 12)] + [(2, dt.datetime(2024, 1, 1), ["doc_5"]), (None, dt.datetime(2024, 1, 1), [])], "cluster_id int, ts timestamp, chunk_ids array<string>")
    log = EO.cluster_log(hits.withColumn("chunk_ids", EO.raw_ids(F.col("chunk_ids"))))
    assert {r["cluster_id"]: (r["hit_count"], len(r["chunk_ids"])) for r in log.collect()} == {1: (11, 11), 2: (1, 1), None: (1, 0)}
    jobs = EO.ready(log.withColumns({"synthesized": F.lit(False), "synthesizing": F.lit(False), "canonical_query": F.lit("q")}))
    source = jobs.select("cluster_id", F.concat_ws(" ", F.lit("Alpha has 12 of"), F.col("cluster_id")).alias("source"))
    made = EO.super_nodes(G.synthesize(source, lambda: lambda text, missing: text), jobs, F.lit("2024-02-01 00:00:00").cast("timestamp")).collect()
    assert [(r["id"], r["access_count"], len(r["source_chunks"]), r["fact_coverage"]) for r in made] == [("sn_1_20240201000000", 11, 11, 1.0)]


def test_budgets_and_sentences(spark):
    from sparkloom.operators import chunk as C

    rows = spark.createDataFrame([("One two. Three four five! \"Six?\" Seven 8.5 e.g. nine",), (None,), (" ",)], "t string")
    got = rows.select(C.sentences(F.col("t")).alias("s"), C.sentence_windows(F.col("t"), 7).alias("w"), G.within_budget(F.col("t"), 2).alias("b"), G.shortened(F.col("t"), 3).alias("c")).collect()
    assert got[0]["s"] == ["One two.", "Three four five!", '"Six?"', "Seven 8.5 e.g. nine"]
    assert [(w["text"], w["n_words"]) for w in got[0]["w"]] == [("One two. Three four five!", 5), ('"Six?" Seven 8.5 e.g. nine', 5)]
    assert (got[0]["b"], got[0]["c"]) == ("One two.", "One...") and got[1]["s"] == [] == got[2]["w"] and got[1]["b"] is None
    hits = spark.createDataFrame([(1, 1, "S", "u", "w" * 100)], "query_id int, rank int, section string, source_url string, text string")
    (answer,) = G.answers(spark.createDataFrame([(1, "q")], "query_id int, query string"), hits, max_tokens=10).collect()
    assert len(answer["prompt"]) == len("Context Information:" + "\n\nUser Question: q\n\nAnswer:") + 40


def test_overlap_summary(spark):
    rows = spark.createDataFrame([("success", 2, 0.5), ("success", 1, 0.2), ("failed", None, None)], "status string, questions_count int, avg_overlap double")
    r = EV.overlap_summary(rows).first()
    assert (r["n_urls"], r["n_success"], r["n_questions"]) == (3, 2, 3) and r["success_rate"] == pytest.approx(200 / 3) and r["avg_overlap"] == pytest.approx(0.4)
    assert EV.overlap_summary(rows.limit(0)).first()["success_rate"] == 0.0
    assert EV.timed(lambda: 5)[0] == 5 and EV.timed(lambda: 0) == (0, 0.0)


def test_merge_plan_takes_each_node_once(spark):
    nodes = spark.createDataFrame([(1, [1.0, 0.0], 1, False), (2, [1.0, 0.01], 1, False), (3, [1.0, 0.02], 1, False), (4, [1.0, 0.0], 1, True)], "node_id int, vector array<double>, access_count int, in_hierarchy boolean")
    plan = EO.merge_plan(EO.similar_pairs(nodes)).collect()
    assert sorted(r["child_id"] for r in plan) in ([1, 2], [2, 3])


def test_online_clusters_move_their_centroids():
    c = EO.OnlineClusters(0.9)
    assert [c.add(v) for v in ([1, 0], [0.95, 0.1], [0, 1], [1, 0.05])] == [0, 0, 1, 0]
    assert c.hits == [3, 1] and c.sums[0][1] == pytest.approx(0.05)


def test_prompt_and_answers(spark):
    hits = spark.createDataFrame([(1, 2, None, "u2", "two"), (1, 1, "S", None, "one")], "query_id int, rank int, section string, source_url string, text string")
    asked = spark.createDataFrame([(1, "q?"), (2, "none")], "query_id int, query string")
    got = {r["query_id"]: r for r in G.answers(asked, hits).collect()}
    assert got[1]["prompt"] == "Context Information:\n--- Source 1 (S - Unknown) ---\none\n\n--- Source 2 (General - u2) ---\ntwo\n\n\nUser Question: q?\n\nAnswer:"
    assert got[2]["answer"] == G.NOTHING_FOUND and got[1]["answer"].startswith("one")

    def broken():
        def fail(question, found):
            raise RuntimeError("down")

        return fail

    assert G.answers(asked, hits, broken).where("query_id = 1").first()["answer"] == G.FAILED + "down"


def test_synthesis_tries_again_with_missing_facts(spark):
    def load():
        return lambda source, missing: "Alpha" + (" " + " ".join(missing) if missing else "")

    got = G.synthesize(spark.createDataFrame([(1, "Alpha has 12 and Beta")], "cluster_id int, source string"), load).first()
    assert got["attempts"] == 2 and got["passed"] and got["coverage_score"] == 1.0


def test_text_measures():
    a = "the cat sat on the mat".split()
    assert EV.bleu(a, a) == pytest.approx(1.0) and EV.rouge_l(a, a) == 1.0
    assert EV.rouge_l("a b c".split(), "a c".split()) == pytest.approx(0.8)
    assert EV.bleu([], a) == 0.0 == EV.rouge_l(a, [])


def test_embedding_keeps_order(spark):
    rows = spark.createDataFrame([(i, f"word{i} common") for i in range(70)] + [(99, None)], "i int, t string")
    got = rows.withColumn("e", E.embedder(E.hashing_encoder)(F.col("t"))).collect()
    model = E.hashing_encoder()
    for r in got:
        assert np.allclose(r["e"], model([r["t"] or ""])[0], atol=1e-6)


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    pairs = lambda d: sorted((r["id"], r["v"]) for r in d.collect())
    assert pairs(U.upsert(old, new, "id")) == [("a", 1), ("b", 3), ("c", 4)]
    assert pairs(U.upsert(old, new, "id", "first")) == [("a", 1), ("b", 2), ("c", 4)]
    assert pairs(U.upsert(U.upsert(old, new, "id"), new, "id")) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(ValueError):
        U.upsert(old, new, "id", "other")


def test_islands_over_ranges(spark):
    values = list("aabbbabccca")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos int, v string").repartition(5)
    expected, n = [], 0
    for i, v in enumerate(values):
        n += i == 0 or v != values[i - 1]
        expected.append(n)
    assert [r["island"] for r in S.islands(rows, "pos", "v").orderBy("pos").collect()] == expected


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_islands_of_many_rows_with_further_columns(spark, adaptive):
    """Wide rows over many ranges, with nulls, as pandas numbers them."""
    n = 400_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("pos"), F.col("id").alias("x")).select("pos", F.lit("some text ").alias("t"), F.floor(F.col("pos") / 37).alias("k")).withColumn("v", F.when(F.col("k") % 11 < 2, None).otherwise(F.col("k") % 3)).withColumn("text", F.repeat("t", 20))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = S.islands(rows.select("pos", "v", "text").repartition(7), "pos", "v").select("pos", "v", F.length("text").alias("n"), "island").toPandas().sort_values("pos")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    value = got["v"].fillna(-1).to_numpy()
    assert len(got) == n and (got["pos"].to_numpy() == np.arange(n)).all() and (got["n"] == 200).all()
    assert (got["island"].to_numpy() == 1 + np.cumsum(np.append(False, value[1:] != value[:-1]))).all()


def test_islands_of_documents_with_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    got = S.islands(docs, "doc_id", "lang").select("doc_id", "lang", "island", F.length("text").alias("n")).toPandas().sort_values("doc_id")
    assert len(got) == docs.count()
    assert (got["island"].to_numpy() == 1 + np.cumsum(np.append(False, got["lang"].to_numpy()[1:] != got["lang"].to_numpy()[:-1]))).all()


def test_upsert_keeps_one_row_of_a_repeated_key(spark):
    old = spark.createDataFrame([("a", 1, 0)], "id string, v int, at int")
    new = spark.createDataFrame([("a", 2, 2), ("a", 3, 1), ("b", 4, 1), ("b", 5, 2)], old.schema)
    assert sorted(map(tuple, U.upsert(old, new, "id", order=["at"]).collect())) == [("a", 2, 2), ("b", 5, 2)]
    assert sorted(map(tuple, U.upsert(old, new, "id", "first", order=["at"]).collect())) == [("a", 1, 0), ("b", 4, 1)]


def test_max_sim(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "query_id int, position int, query_vector array<double>")
    d = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "item_id string, vector array<double>")
    got = {r["item_id"]: r["score"] for r in RT.max_sim(q, d).collect()}
    assert got == {"a": 2.0, "b": 1.0}


@pytest.mark.parametrize("n, rows", [(5000, 1024), (400, 2048)])
def test_average_linkage_over_many_tasks(spark, monkeypatch, n, rows):
    """A job beyond one task, in blocks, against the sequential clustering."""
    rng = np.random.default_rng(n)
    centre = rng.standard_normal((n // 12, 16))
    x = centre[rng.integers(0, len(centre), n)] + rng.choice([0.1, 0.3, 0.5], (n, 1)) * rng.standard_normal((n, 16))
    x[7] = 0
    x[20:23] = x[20]
    items = [("big", i, i, v.tolist()) for i, v in enumerate(x)] + [("small", i, -i, v.tolist()) for i, v in enumerate(x[:9])] + [(None, i, i, x[0].tolist()) for i in range(3)]
    frame = spark.createDataFrame(items, "job_id string, item_id long, pos long, vector array<double>").repartition(6)
    monkeypatch.setattr(EO, "JOB_ROWS", 100)
    monkeypatch.setattr(EO, "LINKAGE_ROWS", rows)
    got = EO.semantic_dedup(frame, 0.2).collect()
    big = {r["item_id"]: r["cluster"] for r in got if r["job_id"] == "big"}
    expected = EO.average_linkage(x, 0.2)
    assert [big[i] for i in range(n)] == expected.tolist() and len(set(expected)) < n / 2
    assert sum(r["kept"] for r in got if r["job_id"] == "big") == len(set(expected)) and len(got) == n + 12
    small = sorted((r["item_id"], r["cluster"]) for r in got if r["job_id"] == "small")
    assert [c for _, c in small[::-1]] == EO.average_linkage(x[8::-1], 0.2).tolist()
