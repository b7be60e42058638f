import pytest
from pyspark.sql import functions as F

from sparkloom.functions import rules as R
from sparkloom.functions import text as T
from sparkloom.operators import chunk as C
from sparkloom.operators import clean as CL


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (1, [1]), (346, [346]), (347, [347, 1]), (384, [384, 38]), (385, [384, 39]), (730, [384, 384, 38]), (731, [384, 384, 39])])
def test_chunk_sizes(spark, n, sizes):
    text = " ".join(f"w{i}" for i in range(n))
    rows = C.chunk(spark.createDataFrame([("d", text, "S")], "document_id string, text string, section string")).orderBy("chunk_index").collect()
    assert [len(r["chunk_text"].split()) for r in rows] == sizes
    assert [r["chunk_id"] for r in rows] == [f"d_S_{i}" for i in range(len(sizes))]
    assert [r["token_count"] for r in rows] == [int(s * 1.3) for s in sizes]
    # The windows without what they share give the words back.
    joined = [w for i, r in enumerate(rows) for w in r["chunk_text"].split()[(38 if i else 0) :]]
    assert joined == text.split()[: len(joined)]


def test_chunk_without_step_gives_one(spark):
    docs = spark.createDataFrame([("d", " ".join("abcdefgh"), None)], "document_id string, text string, section string")
    assert C.chunk(docs, tokens=5, overlap=5).count() == 1
    assert C.chunk(docs, tokens=5, overlap=5).first()["chunk_id"] == "d_General_0"


def test_chunk_drops_contained_tail_and_tells_rows_apart(spark):
    docs = spark.createDataFrame([(1, "d", " ".join("x" * 384), "S"), (2, "d", "y", "S"), (3, "d", None, "S")], "pos int, document_id string, text string, section string")
    out = C.chunk(docs, row="pos", drop_contained_tail=True).collect()
    assert len(out) == 2 and len({r["chunk_key"] for r in out}) == 2 and len({r["chunk_id"] for r in out}) == 1


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("vertigo and impetigo", "verti and impeti"),
        ("keep. National Library of Medicine says\nlost tail", "keep."),
        ("heart muscle\n, fine", "heart muscle, fine"),
        ("a  \nb\t\n\n\n\nc", "a\nb\n\nc"),
        ("kept References lost Disclaimers", "kept"),
        ("", ""),
    ],
)
def test_clean_text(spark, text, expected):
    assert one(spark, text, CL.clean_text) == expected


def test_clean_text_without_legacy(spark):
    assert one(spark, "vertigo GO on", lambda x: CL.clean_text(x, legacy=False)) == "vertigo  on"


def test_words_and_strip(spark):
    text = "a b\x1cc d \x85e"
    assert one(spark, text, T.word_count) == len(text.split())
    assert one(spark, "  x y\x1f\n", T.strip) == "x y"
    assert one(spark, None, T.word_count) == 0


@pytest.mark.parametrize(("text", "expected"), [("SummarySummary", "Summary"), ("Papa", "Papa"), ("abab", "abab")])
def test_undouble(spark, text, expected):
    assert one(spark, text, T.undouble) == expected


@pytest.mark.parametrize(("a", "b", "expected"), [("a b c", "b c d D", 2 / 3), ("", "x", 0.0), ("x", "", 0.0), (None, "x", 0.0)])
def test_token_overlap(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.token_overlap(F.col("a"), F.col("b")).alias("o")).first()
    assert row["o"] == pytest.approx(expected)


@pytest.mark.parametrize(
    ("question", "section"),
    [("What causes the symptoms?", "Causes"), ("How common is the treatment?", "Frequency"), ("How many people have it", "Frequency"), ("because of it", "Causes"), ("What is X?", "Description"), ("Is it inherited", "Inheritance")],
)
def test_question_section(spark, question, section):
    assert one(spark, question, R.question_section) == section


@pytest.mark.parametrize(
    ("kind", "section"),
    [("Information", "[DEFINITIONS]"), ("prevention", "[RISK FACTORS AND PREVENTIONS]"), ("outlook", "[SYMPTOMS AND DIAGNOSIS AND TREATMENTS]"), ("FAQ", "[FAQ]"), ("stages", None)],
)
def test_senior_section(spark, kind, section):
    assert one(spark, kind, R.senior_section) == section


@pytest.mark.parametrize(
    ("url", "mode", "date"),
    [
        ("https://www.nlm.nih.gov/medlineplus/druginfo/natural/1.html", "wayback", None),
        ("https://ghr.nlm.nih.gov/condition/x", "live", None),
        ("https://www.cdc.gov/x", "wayback", "20140101"),
        ("https://rarediseases.info.nih.gov/gard/1", "browser", None),
        ("https://www.niddk.nih.gov/x", "wayback", None),
        ("https://elsewhere.org/x", "live", None),
    ],
)
def test_routing(spark, url, mode, date):
    d, p = (lambda x: R.authority(x)), (lambda x: R.path(x))
    assert one(spark, url, lambda x: R.fetch_mode(d(x), p(x))) == mode
    assert one(spark, url, lambda x: R.archive_date(d(x), p(x))) == date


def test_authority_keeps_user_and_port(spark):
    assert one(spark, "http://u@h.com:80/p?q", R.authority) == "u@h.com:80"
    assert one(spark, "not a url", R.authority) == ""
