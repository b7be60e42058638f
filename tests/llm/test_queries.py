"""Registered queries on the smoke tables, against their SQL where they have it."""

import collections
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
import test_joins as TJ
import test_text_operators as TT
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sparkloom.llm import queries as llm
from sparkloom.llm import textmodel as M
from sparkloom.llm import tokens as T

NAMES = sorted(llm.queries())


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(x) else x if isinstance(x, str) else float(x) for x in row) for row in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, smoke_dir, name):
    got = entry.queries()[name](spark, smoke_dir).toPandas()
    assert len(got)
    sql = entry.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for path in glob.glob(f"{smoke_dir}/*.parquet"):
            db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        assert normal(got) == normal(db.execute(sql).df())


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage by plain Python: verdicts of both models on what is left, near duplicates by sets, ids by the tokenizer."""
    rng = np.random.default_rng(9)
    common_words, junk = [f"{a}{b}" for a in "stone river house light".split() for b in "abcdefghijkl"], "$$$ ### WIN!! CLICK!! %%% *** FREE!!".split()
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choice(junk if i % 4 == 0 else common_words, 90).tolist()), f"site{i % 3}", "en"))
    rows += [(200, rows[1][1] + " more", "site0", "en"), (201, rows[1][1], "site1", "en"), (2, rows[2][1], "site2", "en"), (2, rows[3][1] + " x", "site2", "en"), (None, rows[5][1], None, None), (None, rows[6][1] + " y", "site1", "fr"), (202, None, "site0", "en"), (203, "", None, "en"), (204, "few words", "site0", "en"), (205, "again and again " * 40, "site1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(c) for c in ("kept", "node", "__n", "sequence_id", "text_hash")})
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 120, 2)] + [(7, 1), (None, 0)], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [dict(zip(("doc_id", "text", "source", "lang"), r)) for r in rows]
    frame = lambda: spark.createDataFrame([(r["doc_id"], r["text"], r["source"], r["lang"]) for r in left], "doc_id long, text string, source string, lang string")
    model = M.train(frame(), labels)
    good = TT.plain_good(left, {(r["doc_id"], r["text"]): TT.plain_odds(model, r["text"]) for r in left})
    left = [r for r, p in zip(left, good) if p >= 0.5]
    model = M.train(frame(), labels)
    counted = [TT.brute(r["text"]) for r in left]
    left = [r for r, (n, *_, repeated) in zip(left, counted) if n >= 50 and 100 * repeated <= 50 * n and TT.plain_odds(model, r["text"]) >= 0]
    sets = [TJ.shingles(r["text"]) for r in left]
    group = TJ.components(len(left), [(i, j) for i in range(len(left)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    first = {}
    for g, r in zip(group, left):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if g not in first or key < first[g][0]:
            first[g] = key, r
    kept = [r for _, r in first.values()]
    assert 60 < len(kept) < len(left) < 100

    tokenizer = Tokenizer.from_file(T.default_path("byte_bpe_50k.json"))
    expected = collections.Counter((r["doc_id"], T.crc32(np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]))) for r in kept)
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"]) == expected  # none is longer than a window
    fill = collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, docs, smoke_dir)
        assert kept.columns == docs.columns and 0 < kept.count() <= n
    pieces = corpus_pipeline.run(spark, smoke_dir)
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
