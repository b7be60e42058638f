"""Operators on pairs and graphs, against brute force."""

import collections
import os
import re
import urllib.parse

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm import embed_dedup as E
from sparkloom.llm import ngram_join as J
from sparkloom.llm import url_filter as U


def components(n, pairs):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_connected_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(70, 90)] + [(100, i) for i in range(101, 130)]
    edges = spark.createDataFrame([*pairs, *pairs[:5], (None, 3), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    label = components(130, pairs)
    assert got == {i: label[i] for p in pairs for i in p if p[0] != p[1]}
    assert common.connected_components(edges.limit(0)).count() == 0


def test_connected_components_without_python(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 80, (70, 2))] + [(500, i) for i in range(501, 560)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in common.connected_components(edges, merge_first=False, rows=200).collect()}
    label = components(560, pairs)
    assert got == {i: label[i] for p in pairs for i in p if p[0] != p[1]}


def test_scope_deletes_what_is_not_kept(spark):
    with common.scope() as keep:
        gone, kept = (common.materialize(spark.range(3).toDF("x"), name, rows=3) for name in ("gone", "kept"))
        with common.scope() as inner:
            below = common.materialize(spark.range(4).toDF("x"), "below")
            inner(below)
        keep(kept)
    exists = lambda t: os.path.exists(t._scratch_path.removeprefix("file://"))
    assert exists(kept) and kept.count() == 3 and not exists(gone) and not exists(below)
    common.release(kept)
    assert not exists(kept)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with common.batches_of(spark, 7):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def shingles(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_texts():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choice(vocabulary, 60).tolist())
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b c d e", "a b c d e f", "one"]
    for size in (6, 9, 30, 90, 280, 700, 2500):
        base = rng.choice(vocabulary, size).tolist()
        for edits in (0, 0, 1, 2, 4, 8, max(1, size // 60), max(1, size // 45), max(1, size // 30)):
            w = list(base)
            for _ in range(edits):
                at = int(rng.integers(0, len(w)))
                kind = int(rng.integers(0, 3))
                w[at : at + (kind != 1)] = [] if kind == 0 and len(w) > 1 else [str(rng.choice(vocabulary))]
            texts.append(" ".join(w))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, int(n)).tolist()) for n in rng.integers(5, 150, 40)]
    chain = rng.choice(vocabulary, 200).tolist()
    for i in range(12):
        chain = [*chain[4:], *rng.choice(vocabulary, 4).tolist()]
        texts.append(" ".join(chain))
    return texts


def test_jaccard_join(spark, monkeypatch):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = components(len(texts), pairs)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
    for light, block in ((32, 1024), (2, 4)):  # where a group is heavy, and how it is cut, moves work only
        monkeypatch.setattr(J, "LIGHT", light)
        monkeypatch.setattr(J, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.joined(docs).collect()}
        assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))
    assert J.joined(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_jaccard_join_of_rows_without_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(J, "BROADCAST_IDS", sent)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text + " x"), (None, None)], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in J.joined(docs).collect())
    assert got == {(5, 5): 2, (None, 5): 1, (9, 5): 1, (None, None): 1}


def test_jaccard_join_of_a_large_cluster(spark, monkeypatch):
    """Copies at all distances from one text, more than a light group holds, some of which link with nothing."""
    monkeypatch.setattr(J, "BLOCK", 32)
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(140)], []
    for k in range(150):
        w = list(base)
        for at in rng.integers(0, len(w), k // 20):
            w[int(at)] = f"x{int(rng.integers(0, 10**6))}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = components(len(texts), pairs)
    assert 40 < label.count(0) < 130
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in J.joined(docs).collect()} == dict(enumerate(label))


def test_heavy_groups_across_batches():
    keys = np.array([1] * 3 + [2] * 100 + [3] * 2 + [4] * 34 + [5] * 2 + [6] * 33 + [7] * 3 + [8] * 2)
    nodes = 2 * np.concatenate([[7, 7, 8], np.arange(100), [5, 9], [*range(33), 32], [1, 2], np.arange(33) // 2, [50, 51, 52], [60, 61]])
    nodes[-5:] += [1, 0, 1, 1, 1]  # visitors
    frame = {}

    class Rows:
        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def mapInArrow(self, run, _):
            frame["run"] = run

    J.groups_of(Rows())
    for size in (1, 2, 7, 40, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(nodes[i : i + size])], ["key", "node"]) for i in range(0, len(keys), size)]
        out = pa.Table.from_batches(list(frame["run"](iter(batches)))).to_pylist()
        assert {(r["x"], r["y"]) for r in out if r["key"] is None} == {(2 * x, 2 * y) for x, y in [(7, 8), (5, 9), (1, 2), (50, 51), (51, 52), *((i, j) for j in range(17) for i in range(j))]}
        assert {(r["key"], r["x"]) for r in out if r["key"] is not None} == {(k, 2 * i) for k, n in ((2, 100), (4, 33)) for i in range(n)}


def test_one_of_each_keeps_one_row_of_a_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a, 0), (5, a, 0), (5, b, 0), (7, b + " y", 0), (8, None, 0), (8, "", 0), (2, "c c c", 1), (2, "c c c", 2), (None, "d d", 0), (None, "d d", 0), (None, "e e", 0), (1, "e E", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stays int").repartition(3)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (8, None), (8, ""), (2, "c c c"), (None, "d d"), (1, "e E")], key=str)
    assert J.one_of_each(docs.limit(0)).count() == 0


def test_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(0)
    for n, m in ((40, 38), (900, 850), (3000, 5000), (1200, 2500)):
        both = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in (n, m))
        apart = len(np.setxor1d(a, b))
        assert int(np.bitwise_count(J.folded(a).view(np.uint64) ^ J.folded(b).view(np.uint64)).sum()) <= apart
        if n > 600:
            x, y = (J.wide(s).view(np.uint64) for s in (a, b))
            x, y = (x, y) if len(x) < len(y) else (y, x)
            far = int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0) ^ x).sum())
            row = spark.createDataFrame([(J.wide(a).tolist(), J.wide(b).tolist())], "x array<long>, y array<long>")
            for p, q in (("x", "y"), ("y", "x")):
                assert row.select(J.hamming(F.col(p), F.col(q)).alias("d")).first()["d"] == far <= apart
    assert J.wide(both[:100]) is None


def test_urls(spark):
    pages = [
        (1, "https://a.example.org/es/1", None), (2, "http://x.net/p.html?q=1#f", ""), (3, None, None), (4, "nothing", None), (5, "HTTP://M.Example.COM/de/7/", None), (6, "https://example.com/fr/", None),
        (7, "https://blog.net/alias", '<link rel="canonical" href="https://www.example.com/de/9">'), (8, "https://blog.net/alias/", None), (9, "http://notexample.org/es/", None), (10, "http://org?x", None),
        (11, "https://both.net/", '<link href="https://example.com/de/1" rel=canonical>'), (12, "https://both.net", '<link rel=canonical href="//example.com/fr/2">'), (13, "http://b.example.org/en/1x", None),
        (14, "http://z.net/r", "<link rel=canonical href='/q'>"), (14, "http://z.net/r", None), (None, "http://z.net/q", None),
        # the query tells urls apart, but for utm_ parameters
        (20, "http://a.net/view?id=1", "<link rel=canonical href='http://example.com/de/2'>"), (21, "http://a.net/view?id=2", None), (22, "https://www.a.net:443/view/?utm_a=1&id=1&utm_b=2#x", None), (23, "https://a.net:80/view?id=1", None),
        # links in comments and scripts don't count; refreshes do; links are decoded and resolved
        (24, "http://b.net/1", "<!-- <link rel=canonical href='http://example.com/de/3'> --><script>'<link rel=canonical href=http://example.com/de/3>'</script>"),
        (25, "http://c.net/old/1", '<META content="0; URL=page?a=1&amp;b=2" http-equiv="refresh">'), (26, "http://c.net/old/page?a=1&b=2", "<link rel=canonical href='http://example.com/de/4'>"),
        (27, "http://d.net/a?x", "<link rel=canonical href='?y'>"), (28, "http://d.net/a?y", "<link rel=canonical href=//w.example.com/de/>"), (29, "http://e.net/a", "<link rel=canonical href='mailto:x@example.com/de/'>"),
    ]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    got = U.judged(rows, conventions=True).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and by[9] == ("notexample.org", "/es/", "org/", "allow")
    assert by[2] == ("x.net", "/p.html", None, "allow") and by[3] == ("", "", None, "allow") == by[4]
    assert by[5] == ("m.example.com", "/de/7/", "com/de/", "block") and by[6][2:] == ("com/fr/", "allow") and by[10] == ("org", "", None, "allow")
    assert by[7][3] == by[8][3] == "block" and by[11][3] == by[12][3] == "allow" and by[13][2] == "example.org/en/1"
    assert [by[k][3] for k in range(20, 30)] == ["block", "allow", "block", "allow", "allow", "block", "block", "block", "block", "allow"]
    # Without conventions only links that pages or redirects state count.
    declared = U.judged(rows).collect()
    strict = {r["page_id"]: r["verdict"] for r in declared}
    assert strict[7] == "block" and strict[8] == "allow" and strict[11] == "block" and strict[22] == "allow"
    bare = spark.createDataFrame([(1, "https://foo.com/de/", None), (2, "https://foo.com/de", None), (3, "https://foo.com/de?x=1", None)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["verdict"]) for r in U.judged(bare).collect()) == [(1, "block"), (2, "allow"), (3, "allow")]
    again = U.judged(rows, spark.createDataFrame([("http://z.net/q", "http://h.example.com/de/")], "from_url string, to_url string")).where("host = 'z.net'").collect()
    assert [r["verdict"] for r in again] == ["block"] * 3
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar, html varchar)")
    db.executemany("insert into pages values (?, ?, ?)", pages)
    expected = sorted(map(str, db.execute(U.ORACLE).fetchall()))
    assert sorted(str(tuple(r)[:5]) for r in declared) == expected
    assert U.judged(rows.limit(0), conventions=True).count() == 0


def test_resolved_links(spark):
    urls = ["http://h.net/p/q/r?x#y", "https://h.net", "http://h.net/"]
    links = ["page.html", "../x", "../../../x", "./a/./b", "?id=1", "/a/../b", "//k.net/z", "ftp://k.net/z", "https://k.net/?a", "..", ".", "a/b/..", "/", "g?x=../y"]
    rows = spark.createDataFrame([(u, x) for u in urls for x in links], "u string, x string")
    for r in rows.select("u", "x", U.resolved(F.col("x"), F.col("u")).alias("got")).collect():
        expected = urllib.parse.urljoin(r["u"], r["x"])
        tail = urllib.parse.urlsplit(expected)
        assert r["got"] == (expected if tail.path else expected.replace(tail.netloc, tail.netloc + "/", 1)) or r["got"] == expected, r
    for raw, decoded in (("a&amp;b", "a&b"), ("&#47;x&#x2F;y&#x2f;", "/x/y/"), ("&amp;lt;", "&lt;"), ("plain", "plain"), ("&quot;&apos;", "\"'")):
        assert spark.range(1).select(U.decoded(F.lit(raw)).alias("x")).first()["x"] == decoded


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    d = 16
    rows: list = []
    for _ in range(150):
        c = rng.standard_normal(d)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((c + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.12, 0.3])).tolist())
    rows += [rows[0]] * 5 + [(np.ones(d) * 2).tolist()] * 30 + [(np.ones(d) + rng.standard_normal(d) * 0.05).tolist() for _ in range(60)]
    odd = [None, [], [0.0] * d, [float("nan")] * d, [1.0] * 3, [None] * d, [float("inf")] + [1.0] * (d - 1)]
    x = np.array(rows)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= 0.95 - 1e-12
    np.fill_diagonal(near, False)
    pairs = list(zip(*np.nonzero(near)))
    label = components(len(rows), pairs)
    table = spark.createDataFrame([*((i, v, 0) for i, v in enumerate(rows)), *((1000 + i, v, 0) for i, v in enumerate(odd))], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r for r in E.near_duplicates(table).collect()}
    assert len(got) == len(rows) + len(odd)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert 0.9 * near.sum() <= found <= near.sum()
    # Links that are there bind all that brute force binds, but for what recall leaves out.
    same = np.mean([got[i]["component_id"] == label[i] for i in range(len(rows))])
    assert same >= 0.9 and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(rows)))
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["component_id"] == 1000 + i for i in range(len(odd)))
    assert E.near_duplicates(table.limit(0)).count() == 0


def test_each_length_has_its_own_links(spark):
    rows = [(1, [3.0, 4.0]), (2, [3.0, 4.0]), (3, [6.0, 8.1]), (4, [1.0, 0.0, 0.0, 0.1]), (5, [1.0, 0.0, 0.0, 0.0]), (6, [1.0]), (7, [2.0]), (8, [-1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("class", F.lit("clash"))).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (2, 4, True), 5: (2, 4, False), None: (2, 4, False), 6: (1, 6, True), 7: (1, 6, False), 8: (0, 8, True), 9: (0, 9, True)}


def test_recall_near_the_least_cosine(spark):
    """Pairs planted between cosine 0.95 and 0.96, each alone among 6,000 random vectors."""
    rng = np.random.default_rng(12)
    d, n = 64, 400
    x = rng.standard_normal((6000, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((n, d))
    side -= (side * x[:n]).sum(1, keepdims=True) * x[:n]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9502, 0.9598, (n, 1))
    x = np.concatenate([x, cosine * x[:n] + np.sqrt(1 - cosine**2) * side])
    got = {r["vec_id"]: r["n_links"] for r in E.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)).collect()}
    found = sum(got[6000 + i] for i in range(n))
    assert 0.9 * n <= found <= n and sum(got.values()) == 2 * found


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = np.ones(16) + rng.standard_normal((120, 16)) * 0.02
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = E.near_duplicates(table).collect()
    assert all(r["n_links"] == 119 and r["component_id"] == 0 for r in got)


def shuffled_rows(plan) -> int:
    """Rows that an executed plan wrote to shuffles."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    below = plan.children()
    return own + sum(shuffled_rows(below.apply(i)) for i in range(below.size()))


def test_few_pairs_shuffle_few_sets(spark):
    """Verifying a few pairs takes their sets only, not all that any step wants."""
    sets = spark.createDataFrame([(2 * i, list(range(i // 2 * 20, i // 2 * 20 + 10))) for i in range(400)], "node long, shingles array<long>")
    pairs = spark.createDataFrame([(0, 2, 10, 10), (4, 8, 10, 10)], "x long, y long, xn long, yn long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = J._verified(pairs, sets, 80)
        assert [tuple(r) for r in found.collect()] == [(0, 2)]
        assert shuffled_rows(found._jdf.queryExecution().executedPlan()) < 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
