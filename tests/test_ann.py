"""Indexed search and late interaction against exact search over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ann as A
from sparkloom.operators import retrieve as RT


def topical(seed, topics, each, dim):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((topics, dim))
    return np.repeat(centre, each, 0) + 0.6 * rng.standard_normal((topics * each, dim))


def frame(spark, x, name="item_id", vector="vector"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, {vector} array<double>")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = frame(spark, topical(0, 40, 50, 24)).repartition(4)
    odd = spark.createDataFrame([(9000, None), (9001, [0.0] * 24), (9002, [1.0]), (9003, [float("nan")] * 24)], rows.schema)
    return A.VectorIndex(spark, str(tmp_path_factory.mktemp("index"))).build(rows.unionByName(odd), cells=40, parts=8), rows


def test_recall_and_pruning(spark, index):
    index, rows = index
    asked = frame(spark, topical(0, 40, 50, 24)[::13] + 0.01, "query_id", "query_vector")
    found = index.search(asked, 5, probes=6, rerank=60)
    assert A.recall(found, RT.top_k(asked, rows, 5)) >= 0.95
    one = index.search(asked.limit(1), 5, probes=3)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell") or "PartitionFilters: [cell#" in plan
    read = set(map(int, np.unique(index.probed(np.array([[float(x) for x in asked.first()["query_vector"]]]), 3))))
    assert len(read) == 3 and {r["cell"] for r in index.read().where(F.col("cell").isin(list(read))).select("cell").distinct().collect()} <= read


def test_search_of_all_cells_is_exact(spark, index, monkeypatch):
    index, rows = index
    asked = frame(spark, topical(3, 5, 4, 24), "query_id", "query_vector").unionByName(spark.createDataFrame([(500, None), (501, [0.0] * 24), (502, [1.0])], "query_id long, query_vector array<double>"))
    exact = sorted(map(tuple, RT.top_k(asked, rows, 4).select("query_id", "item_id", "rank").collect()))
    for block in (4096, 6):
        monkeypatch.setattr(A, "QUERY_BLOCK", block)
        assert sorted(map(tuple, index.search(asked, 4, probes=40, rerank=2000).select("query_id", "item_id", "rank").collect())) == exact
    assert index.search(asked.limit(0), 4).count() == 0


def test_exact_search_misses_none_of_a_dense_topic(spark, tmp_path, monkeypatch):
    """Codes can't tell the rows of a dense topic apart, so the nearest aren't among the best by codes; most other rows are ruled out."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal(32) + 1e-3 * rng.standard_normal((600, 32)), topical(7, 30, 40, 32)])
    x[590:600] = x[5]  # ties
    rows = frame(spark, x).repartition(3)
    asked = rows.where("item_id % 50 = 0 or item_id = 5").selectExpr("item_id as query_id", "vector as query_vector")
    exact = sorted(map(tuple, RT.top_k(asked, rows, 5, skip_self=True).select("query_id", "item_id", "distance", "rank").collect()))
    index = A.VectorIndex(spark, str(tmp_path)).build(rows, cells=12, parts=4)
    found = lambda **how: sorted(map(tuple, index.search(asked, 5, probes=12, skip_self=True, **how).select("query_id", "item_id", "distance", "rank").collect()))
    assert found(rerank=20) != exact
    for matrix in (1 << 22, 300):
        monkeypatch.setattr(A, "MATRIX", matrix)
        before = index.compared.value
        got = found(rerank=20, exact=True)
        assert [g[:2] + g[3:] for g in got] == [e[:2] + e[3:] for e in exact] and np.allclose([g[2] for g in got], [e[2] for e in exact], atol=2e-12, rtol=0)
        assert index.compared.value - before < asked.count() * len(x) / 2
    few = asked.where("query_id = 1200")
    assert sorted(map(tuple, index.search(few, 5, probes=12, rerank=2, skip_self=True, exact=True).select("query_id", "item_id", "rank").collect())) == [(q, i, r) for q, i, _, r in exact if q == 1200]


def equals_sql(spark, where, x):
    import duckdb

    from sparkloom.plans import corpus

    spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(f"{where}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{where}/embeddings.parquet/*.parquet')")
    assert sorted(map(tuple, corpus.indexed_topk(spark, str(where)).collect())) == sorted(con.sql(corpus.SQL["indexed_topk"]).fetchall())


def test_indexed_query_equals_its_sql(spark, tmp_path):
    """On a table with more near neighbours than the codes' best that are compared."""
    rng = np.random.default_rng(8)
    equals_sql(spark, tmp_path, np.concatenate([rng.standard_normal(16) + 1e-2 * rng.standard_normal((1500, 16)), rng.standard_normal((300, 16))]))


@pytest.mark.parametrize("beyond", [-4e-11, 0, 4e-11])
def test_indexed_query_rounds_as_its_sql(spark, tmp_path, beyond):
    """Distances about halves of the last decimal, which are rounded twice."""
    cos = 1 - (np.array([0.1234565, 0.2198765, 0.3599985, 0.5198765, 0.5599985]) + beyond)
    equals_sql(spark, tmp_path, np.concatenate([[[1.0, 0.0]], np.stack([cos, np.sqrt(1 - cos * cos)], 1)]))


def test_insert_changes_its_cells_only(spark, tmp_path):
    x = topical(1, 20, 20, 16)
    index = A.VectorIndex(spark, str(tmp_path)).build(frame(spark, x), cells=20)
    files = lambda: {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "cells").glob("cell=*")}
    before = files()
    new = spark.createDataFrame([(5000, (x[7] * 3).tolist()), (3, x[50].tolist())], "item_id long, vector array<double>")
    index.insert(new)  # id 3 is there already
    after = files()
    assert [c for c in after if after[c] != before[c]] == [f"cell={index.read().where('item_id = 5000').first()['cell']}"]
    asked = spark.createDataFrame([(1, x[7].tolist())], "query_id long, query_vector array<double>")
    assert [r["item_id"] for r in index.search(asked, 2).orderBy("rank").collect()] == [7, 5000] and index.read().count() == 401


@pytest.mark.parametrize("centroids, matrix", [(30, 1 << 22), (3, 100)])
def test_late_interaction_equals_all_pairs(spark, monkeypatch, centroids, matrix):
    rng = np.random.default_rng(4)
    x = topical(2, 30, 20, 12)
    documents = spark.createDataFrame([(f"d{rng.integers(0, 120)}", v.tolist()) for v in x] + [("none", None), ("zero", [0.0] * 12), (None, x[0].tolist())], "item_id string, vector array<double>").repartition(3)
    tokens = [(int(q), p, (x[rng.integers(0, 600)] + 0.1 * rng.standard_normal(12)).tolist()) for q in range(9) for p in range(1 + q % 4)] + [(50, 0, None)]
    asked = spark.createDataFrame(tokens, "query_id long, position int, query_vector array<double>")
    all_pairs = RT.max_sim(asked, documents).toPandas()
    all_pairs["score"] = all_pairs["score"].round(9)
    expected = all_pairs.sort_values(["query_id", "score", "item_id"], ascending=[True, False, True]).groupby("query_id").head(5)
    index = A.LateInteraction(documents, centroids)
    monkeypatch.setattr(A, "MATRIX", matrix)
    for block in (4096, 8):
        monkeypatch.setattr(A, "QUERY_BLOCK", block)
        got = index.top_k(asked, 5).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["item_id"], round(r["score"], 9)) for r in got] == list(expected[["query_id", "item_id", "score"]].itertuples(index=False, name=None))
    assert index.top_k(asked.limit(0)).count() == 0


def test_late_interaction_compares_few_documents(spark, monkeypatch):
    """Bounds rule out the documents of other topics before any token of theirs is compared."""
    x = topical(5, 60, 30, 32)
    documents = spark.createDataFrame([(i // 3, v.tolist()) for i, v in enumerate(x / 3 + np.repeat(topical(5, 60, 1, 32), 30, 0))], "item_id int, vector array<double>")
    asked = spark.createDataFrame([(q, p, x[30 * q + p].tolist()) for q in (3, 40) for p in range(3)], "query_id int, position int, query_vector array<double>")
    index = A.LateInteraction(documents, 60)
    assert index.top_k(asked, 3).count() == 6 and index.compared.value < 2 * 600 / 5
