"""Fetching by host and in waves, staleness by deltas, and mergeable measures, against full computations."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import evaluate as EV
from sparkloom.operators import evolve as EO
from sparkloom.operators import freshness as FR
from sparkloom.sources import fetch as FE


def test_rate_is_kept_by_host(spark):
    """No host is asked faster than the rate, however many tasks there are, and hosts don't wait for each other."""
    load = lambda: lambda url, mode, date: (str(time.time()), "Live")
    urls = spark.createDataFrame([(f"https://h{h}.org/{i}", "live", None) for h in range(4) for i in range(6)] + [(None, "live", None), ("no host", "live", None)], "url string, fetch_mode string, archive_date string").repartition(8)
    rows = FE.fetched(urls, load, per_second=4).collect()
    assert len(rows) == 26
    for h in range(4):
        at = sorted(float(r["html"]) for r in rows if r["url"] and f"//h{h}." in r["url"])
        assert len(at) == 6 and min(np.diff(at)) >= 0.24
    spread = max(float(r["html"]) for r in rows) - min(float(r["html"]) for r in rows)
    assert spread < 6  # one host alone takes 1.25 s


def test_large_hosts_are_split(spark):
    urls = spark.createDataFrame([(f"https://big.org/{i}",) for i in range(100)] + [("https://small.org/1",)], "url string")
    dealt = FE.by_host(urls, rows=10).withColumn("task", F.spark_partition_id()).toPandas()
    big = dealt[dealt["host"] == "big.org"]
    assert len(dealt) == 101 and set(big["parts"]) == {10} and big["part"].nunique() == 10 and big.groupby("part")["task"].nunique().max() == 1
    assert all(sorted(g["nth"]) == list(range(1, len(g) + 1)) for _, g in big.groupby("part"))


def test_rescue_asks_no_further_than_the_first_year_with_chunks(spark):
    good = {"a": 2024, "b": 2026, "c": 2013}
    urls = spark.createDataFrame([(u, n) for n, u in enumerate([*good, "never"])], "url string, extra int")
    table = spark.createDataFrame(list(good.items()), "url string, good int")
    calls = []

    def attempt(wave):
        calls.append(wave.count())
        return wave.join(table, "url", "left").withColumn("n_chunks", F.when(F.col("year") <= F.col("good"), 3).otherwise(0)).drop("good")

    found, asked = FE.rescue(urls, attempt)
    assert {r["url"]: (r["year"], r["archive_date"], r["extra"]) for r in found.collect()} == {"a": (2024, "20240101", 0), "b": (2026, "20260101", 1), "c": (2013, "20130101", 2)}
    assert {r["url"]: r["count"] for r in asked.groupBy("url").count().collect()} == {"a": 3, "b": 1, "c": 14, "never": 14}
    assert calls[:4] == [4, 3, 3, 2] and len(calls) == 14
    assert [x.count() for x in FE.rescue(urls.limit(0), attempt)] == [0, 0]


def test_staleness_by_deltas_equals_the_full_one(spark, tmp_path):
    rng = random.Random(3)
    index = FR.SourceIndex(spark, str(tmp_path / "s"), buckets=8)
    alive, nodes = set(), []
    full = lambda: {tuple(r) for r in EO.staleness(spark.createDataFrame(nodes, "node_id string, source_chunks array<string>"), spark.createDataFrame([(c,) for c in alive], "chunk_id string")).collect()}
    for step in range(10):
        if step % 3 == 0:
            new = [(f"n{step}_{i}", [f"c{rng.randrange(60)}" for _ in range(rng.randrange(0, 4))]) for i in range(6)]
            nodes += new
            index.add_nodes(spark.createDataFrame(new, "node_id string, source_chunks array<string>"))
        delta = {f"c{rng.randrange(70)}": rng.random() < 0.6 for _ in range(12)}
        before = {r["node_id"]: r["n_alive"] for r in index.nodes.read().collect()}
        changed = {r["node_id"]: r["n_alive"] for r in index.apply(spark.createDataFrame(list(delta.items()), "chunk_id string, alive boolean")).collect()}
        alive = (alive | {c for c, a in delta.items() if a}) - {c for c, a in delta.items() if not a}
        after = {r["node_id"]: r["n_alive"] for r in index.nodes.read().collect()}
        assert changed == {n: a for n, a in after.items() if before[n] != a}  # touched nodes only
        if step in (4, 9):
            assert {tuple(r) for r in index.staleness().select("node_id", "n_sources", "n_alive", "ratio", "is_stale", "gone").collect()} == full()
    assert index.apply(spark.createDataFrame([(c, True) for c in alive], "chunk_id string, alive boolean")).count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_by_bits():
    rng = random.Random(1)
    for n, m, words in ((0, 5, 3), (7, 7, 1), (30, 200, 4), (150, 90, 12), (64, 64, 2)):
        a, b = rng.choices(range(words), k=n), rng.choices(range(words), k=m)
        assert EV.common_subsequence(a, b) == plain_lcs(a, b) == EV.common_subsequence(b, a)


def test_sketches_merge_in_any_order(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(3, 1, 30_000)
    rows = spark.createDataFrame([("a" if i % 3 else "b", i % 7, i % 9000, float(v), 1 + i % 8, i % 100) for i, v in enumerate(x)], "variant string, day int, query_id long, latency_ms double, first int, tokens int")
    parts = [EV.run_sketches(rows.where(F.col("day").isin(d)), ["variant", "day"]) for d in ([0, 1], [2, 3, 4], [5, 6])]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2])
    two = parts[2].unionByName(parts[0]).unionByName(parts[1])
    exact = {r["variant"]: r for r in EV.roll_up(rows).collect()}
    for stored in (one, two):
        for r in EV.report(stored).collect():
            e, own = exact[r["variant"]], np.sort(x[[i for i in range(len(x)) if (i % 3 == 0) == (r["variant"] == "b")]])
            assert (r["n"], r["recall_at_5"], r["avg_tokens"]) == pytest.approx((e["n"], e["recall_at_5"], e["avg_tokens"]))
            for p, column in ((0.5, "p50_ms"), (0.95, "p95_ms")):
                assert abs(np.searchsorted(own, r[column]) / len(own) - p) < 0.012
            assert r["n_queries"] == pytest.approx(6000 if r["variant"] == "a" else 3000, rel=0.05)
