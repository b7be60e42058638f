import collections
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.operators import evolve as EO
from sparkloom.operators import stats as S
from sparkloom.plans import ingest as I
from sparkloom.sources import fetch as FE
from sparkloom.sources import rows as Q
from sparkloom.sources import store as ST
from sparkloom.streaming import jobs as J


def test_guarded_rows_and_urls(spark):
    rows = spark.createDataFrame([("0000029", "http://h/a", None, None, "1", None, "q", None), ("2", None, "f", "g", "2", "t", "q", "a")], schemas.QA_ROW)
    got = Q.guarded(rows).first()
    assert (got["question_focus"], got["answer"], got["document_id"]) == ("", "", "0000029")
    assert Q.with_url(rows).count() == 1 and Q.with_url(rows, domain="x").count() == 0


def test_archive_url(spark):
    reply = '{"archived_snapshots":{"closest":{"url":"u1","timestamp":"20140102"}}}'
    rows = spark.createDataFrame([(reply, "x", None), (reply, "x", "20230101"), ("{}", "x", "20140101"), ("{}", "x", None)], "r string, u string, w string")
    got = [r["a"] for r in rows.select(Q.archive_url(F.col("r"), F.col("u"), F.col("w")).alias("a")).collect()]
    assert got == ["u1", None, "https://web.archive.org/web/20140101/x", None]


def test_snapshots_in_order(spark):
    snaps = spark.createDataFrame([("a", "This Page Has Moved", "Live", 0), ("a", "<p>old</p>", "Wayback", 1), ("a", "<p>older</p>", "Wayback", 2), ("b", "", "Live", 0)], "url string, html string, source string, priority int")
    got = {r["url"]: r["html"] for r in FE.from_snapshots(spark.createDataFrame([("a",), ("b",)], "url string"), snaps).collect()}
    assert got == {"a": "<p>old</p>", "b": None}


def test_fetch_tries_again_and_reports(spark):
    def load():
        seen: dict = {}

        def fetch(url, mode, date):
            seen[url] = seen.get(url, 0) + 1
            if url == "bad" or seen[url] < 2:
                raise OSError("no answer")
            return "<p>x</p>", "Live"

        return fetch

    urls = spark.createDataFrame([("good", "live", None), ("bad", "live", None)], "url string, fetch_mode string, archive_date string")
    got = {r["url"]: (r["html"], r["error"]) for r in FE.fetched(urls, load, per_second=0).collect()}
    assert got == {"good": ("<p>x</p>", None), "bad": (None, "no answer")}


def test_collection_and_keyed_table(spark, tmp_path):
    c = ST.Collection(spark, str(tmp_path / "c"))
    row = ("a", "t", "d", "u", "f", "g", "s", 1, [0.5])
    rows = spark.createDataFrame([row, ("b", "t", "d", "u", "f", "g", "s", 1, None), ("c", "t", "d", "u", "f", "g", "s", 1, [])], schemas.CHUNK)
    c.insert(rows)
    c.insert(rows)
    assert c.read().count() == 1 and c.peek().count() == 1 and "embedding" not in c.metadata().columns
    k = ST.Keyed(spark, str(tmp_path / "k"))
    make = lambda a: spark.createDataFrame([("1", "d", "q", a, "u")], schemas.BENCHMARK_QA)
    assert k.read().count() == 0
    k.save(make("x"))
    k.save(make("y"))
    assert [r["answer"] for r in k.read().collect()] == ["y"]
    assert ST.table_size(spark, str(tmp_path / "k")).first()["kilobytes"] > 0


def test_reports(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "pos int, line string")
    ST.save_report(lines, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]
    ST.save_jsonl(lines, str(tmp_path / "j"))
    assert ST.read_snapshot(spark, str(tmp_path / "j")).count() >= 1


def test_ingest_resumes_and_counts(spark):
    page = "<body><h2>About</h2><p>" + "word " * 60 + "</p></body>"
    qa = spark.createDataFrame(
        [
            ("1", "http://h.org/a", "f", "g", "1", "information", "q", None, 1),
            ("1", "http://h.org/a", "f", "g", "2", "causes", "q", None, 2),
            ("2", "http://h.org/b", "f", "g", "3", "causes", "q", None, 3),
            ("3", "http://nihseniorhealth.gov/c", "f", "g", "4", "stages", "q", "the answer", 4),
        ],
        schemas.QA_ROW + ", pos int",
    )
    snaps = spark.createDataFrame([("http://h.org/a", page, "Live")], schemas.RAW_PAGE)
    chunks, stats = I.ingest(qa, snaps)
    got = chunks.collect()
    assert sorted(r["chunk_id"] for r in got) == ["1_ABOUT_0", "3_General_0"] and all(r["umls_semantic_group"] == "Disorder" for r in got)
    assert next(r["text"] for r in got if r["document_id"] == "3") == "None the answer"
    s = {r["domain"]: r for r in stats.collect()}
    assert (s["h.org"]["live"], s["h.org"]["skipped"], s["h.org"]["avg_words"]) == (1, 1, 60.0)
    done = spark.createDataFrame([("http://h.org/a",)], "document_url string")
    assert I.ingest(qa, snaps, done=done)[0].count() == 1


def test_streams_equal_batches(spark, tmp_path):
    data = str(tmp_path / "in")
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 5, i % 60), i % 3, float(i)) for i in range(200)], "event_id int, ts timestamp_ntz, user_id int, value double")
    rows.repartition(3).write.parquet(data)
    stream = lambda: J.source(spark, data, rows.schema)
    got = J.complete_to_table(J.windowed(stream(), ["user_id"], "1 hour"), str(tmp_path / "c1"), str(tmp_path / "t1"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, J.windowed(rows, ["user_id"], "1 hour").collect()))
    got = J.to_table(J.deduplicated(stream().select("user_id"), "user_id"), str(tmp_path / "c2"), str(tmp_path / "t2"))
    assert sorted(r["user_id"] for r in got.collect()) == [0, 1, 2]
    table = ST.Keyed(spark, str(tmp_path / "k"), "id string, v int", "id")
    J.upsert_to(table, stream().select(F.col("user_id").cast("string").alias("id"), F.lit(1).alias("v")), str(tmp_path / "c3"))
    assert table.read().count() == 3


def test_online_clustering_keeps_its_state(spark, tmp_path):
    schema = "shard int, item_id int, pos int, vector array<double>"
    path = str(tmp_path / "in")
    for n, part in enumerate(([(0, 1, 1, [1.0, 0.0]), (0, 2, 2, [0.0, 1.0])], [(0, 3, 3, [0.99, 0.01])])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        got = J.to_table(J.online_clusters(J.source(spark, path, spark.createDataFrame([], schema).schema), "shard"), str(tmp_path / "c"), str(tmp_path / f"t{n}"))
    assert [(r["item_id"], r["cluster"]) for r in got.collect()] == [(3, 0)]


def test_second_archive_tries(spark):
    urls = spark.createDataFrame([("https://www.cdc.gov/a", "wayback", "20150101"), ("https://x.niddk.nih.gov/b", "wayback", None), ("https://www.cdc.gov/c", "live", None)], "url string, fetch_mode string, archive_date string")
    tries = sorted((r["url"], r["try_no"], r["archive_date"]) for r in FE.archive_tries(urls).collect())
    assert tries == [("https://www.cdc.gov/a", 0, "20150101"), ("https://www.cdc.gov/a", 1, "20140101"), ("https://www.cdc.gov/c", 0, None), ("https://x.niddk.nih.gov/b", 0, None)]
    moved, old = "<p>This Page Has Moved</p>", "<p>Redirect to first topic</p>"
    tried = spark.createDataFrame([("a", 0, moved, "Wayback"), ("a", 1, old, "Wayback"), ("b", 0, "<p>x</p>", "Wayback"), ("b", 1, "<p>y</p>", "Wayback"), ("c", 0, old, "Wayback"), ("c", 1, moved, "Wayback"), ("d", 0, None, None)], "url string, try_no int, html string, source string")
    got = {r["url"]: (r["html"], r["source"]) for r in FE.first_usable(tried).collect()}
    assert got == {"a": (old, "Wayback (2014)"), "b": ("<p>x</p>", "Wayback"), "c": (None, None), "d": (None, None)}


def test_answered_rows_and_first_documents(spark):
    rows = spark.createDataFrame([("d2", 1, "x"), ("d1", 2, None), ("d2", 3, ""), ("d3", 4, "y"), (None, 0, "z")], "document_id string, pos int, answer string")
    assert sorted(r["pos"] for r in Q.answered(rows).collect()) == [0, 1, 3, 4]
    assert sorted(r["pos"] for r in Q.first_documents(rows, 2).collect()) == [1, 2, 3] and Q.first_documents(rows, 0).count() == 0


def test_run_every(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    taken = []
    query = J.run_every(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint", lambda batch, n: taken.append(batch.count()), "1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(taken) == 5


def test_keyed_table_keeps_the_last_write(spark, tmp_path):
    k = ST.Keyed(spark, str(tmp_path / "k"), "id string, v string", "id", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "id string, v string, at int")
    got = lambda: {r["id"]: r["v"] for r in k.read().collect()}
    assert got() == {} and k.compact() == []
    k.save(frame([("a", "first", 1), ("a", "third", 3), ("a", "second", 2), ("b", "b", 1), (None, "n", 1), (None, "m", 2)]).repartition(3), order=["at"])
    assert got() == {"a": "third", "b": "b", None: "m"}
    assert k.save(frame([("a", "late", 1)])) == 2 and k.save(frame([("c", "c", 1)]), 7) == 7
    files = lambda n: {p.name for p in (tmp_path / "k" / "changes" / f"seq={n}").glob("bucket=*")}
    assert len(files(2)) == 1 and files(2) < files(1) | files(2)  # a save writes its own buckets only
    k.save(frame([("a", "replayed", 9), ("c", "replayed", 9)]), 7)
    k.save(frame([("a", "replayed", 9)]), 2)
    assert got() == {"a": "late", "b": "b", "c": "c", None: "m"}
    expected = got()
    own = int(next(iter(files(2)))[7:])
    assert own in k.compact() and got() == expected and k.compact() == []
    k.save(frame([("a", "later", 1)]), 8)
    assert got() == expected | {"a": "later"}
    assert sorted(k.compact(list(range(4)))) == [0, 1, 2, 3] and got() == expected | {"a": "later"}
    k.vacuum()
    assert k.changes() == [8] and got() == expected | {"a": "later"}
    k.save(frame([("a", "replayed", 9)]), 7)
    assert k.save(frame([("d", "d", 1)])) == 9 and got() == expected | {"a": "later", "d": "d"}
    # A change set that was never completed doesn't count.
    (tmp_path / "k" / "changes" / "seq=9" / "_SUCCESS").unlink()
    assert got() == expected | {"a": "later"}


def test_stream_into_keyed_table_replays(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([("a", n, 0), ("a", n, 1), (str(n), n, 0)], "id string, v int, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: J.source(spark, str(tmp_path / "in"), spark.createDataFrame([], "id string, v int, at int").schema)
    k = ST.Keyed(spark, str(tmp_path / "k"), "id string, v int, at int", "id")
    J.upsert_to(k, stream(), str(tmp_path / "c1"), ["at"])
    before = sorted(map(tuple, k.read().collect()), key=str)
    assert len(before) == 4 and next(r[2] for r in before if r[0] == "a") == 1
    J.upsert_to(k, stream(), str(tmp_path / "c2"), ["at"])  # all batches again
    assert sorted(map(tuple, k.read().collect()), key=str) == before


def test_inserts_keep_the_first_by_order(spark, tmp_path):
    c = ST.Collection(spark, str(tmp_path / "c"), "chunk_id string, text string, embedding array<float>")
    rows = spark.createDataFrame([("a", "two", [1.0], 2), ("a", "one", [1.0], 1), ("b", "none", None, 0)], "chunk_id string, text string, embedding array<float>, at int")
    c.insert(rows, order=["at"])
    c.insert(rows.where("at = 2"))
    assert [(r["chunk_id"], r["text"]) for r in c.read().collect()] == [("a", "one")]


def test_living_clusters_equal_the_batch_and_forget(spark, tmp_path):
    """Over three runs from one checkpoint: the batch's clusters, closings with their hits, and a state of few clusters."""
    rng = np.random.default_rng(0)
    schema = "shard string, item_id long, pos long, ts timestamp, vector array<double>"
    rows = []
    for i in range(180):
        topic = i // 20 if i % 4 else 50  # topics come and go; one is hit all the time
        v = np.eye(60)[topic] + 0.05 * rng.standard_normal(60)
        rows.append(("ab"[i % 2], i, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), v.tolist()))
    path, found = str(tmp_path / "in"), []
    for n in range(3):
        for at in range(60 * n, 60 * n + 60, 20):
            spark.createDataFrame(rows[at : at + 20], schema).coalesce(1).write.mode("append").parquet(path)
        stream = J.living_clusters(J.source(spark, path, spark.createDataFrame([], schema).schema), "shard", "30 minutes", 0.8)
        J.run_once(stream, str(tmp_path / "c"), lambda batch, m: found.extend(batch.collect()))
    batch = EO.online_clusters(spark.createDataFrame(rows, schema), "shard", 0.8, idle="30 minutes").collect()
    expected = {(r["shard"], r["item_id"]): r["cluster"] for r in batch}
    assert {(r["shard"], r["item_id"]): r["cluster"] for r in found if r["item_id"] is not None} == expected
    hits = collections.Counter((s, c) for (s, _), c in expected.items())
    closed = {(r["shard"], r["cluster"]): r["hits"] for r in found if r["item_id"] is None}
    assert len(closed) >= 12 and all(hits[k] == n for k, n in closed.items())
    living = spark.read.format("statestore").option("stateVarName", "living").load(str(tmp_path / "c"))
    assert len(hits) - len(closed) == living.count() <= 6 < len(hits)


def test_due_jobs(spark):
    runs = spark.createDataFrame([("staleness_check", dt.datetime(2024, 1, 1, 9)), ("staleness_check", dt.datetime(2024, 1, 1, 11, 30)), ("decay_scorer", dt.datetime(2024, 1, 1, 5))], "job string, ts timestamp")
    got = J.due(runs, F.lit("2024-01-01 12:00:00"))
    assert [r["job"] for r in got.collect()] == ["hierarchy_merger", "decay_scorer"]  # one never ran, one is an hour late
    assert J.due(runs.limit(0), F.current_timestamp()).count() == 3


def test_passing_collections_and_report_lines(spark, tmp_path):
    with ST.passing_collection(spark, "chunk_id string, embedding array<float>") as c:
        c.insert(spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<float>"))
        assert c.read().count() == 1
    assert c.read().count() == 0
    rows = spark.createDataFrame([("b.org", "u", "Live", 3, 1000), ("a.org", "v", None, 0, 0)], "domain string, url string, source string, n_topics int, n_words int")
    ST.save_report(S.report_lines(S.averages(S.domain_counters(rows))), str(tmp_path / "r"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[1] == "b.org: 1 links, 1 live, 0 wayback, 0 skipped, 3.0 topics and 1000.0 words a sample"
    assert [x.split(":")[0] for x in lines] == ["a.org", "b.org", "all"]
