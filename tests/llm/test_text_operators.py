"""Operators on single texts, against brute force."""

import collections
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import html_extract as H
from sparkloom.llm import license_scan as L
from sparkloom.llm import packing as P
from sparkloom.llm import quality_classifier as QC
from sparkloom.llm import quality_rules as Q
from sparkloom.llm import repair_codec as R
from sparkloom.llm import sp_codec as S
from sparkloom.llm import textmodel as M
from sparkloom.llm import tokens as T

TEXTS = [
    None, "", " \n ", "a b c a b c", "x\ny\nx\n \n \nx ", "a\x85b é", "Ünï cödé\x0bx", "  two  spaces ", "It's 'we're' ok", "\n\nlines\n\n", "a\tb", "İstanbul ΟΔΟΣ", "é combined",
    "<|endoftext|> literal", "123 4,567.8", "日本語 テキスト 🙂", "Licensed under the MIT License.", "word " * 3000, "THE END!! wow### a|b",
]


# --- html ---------------------------------------------------------------------------------------------------------


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, please accept all of them now.</div>
    <main><article><header><h1>Head &amp; line</h1><p>By someone</p></header><p>First&nbsp;para<br>goes   on <a href="x">with a link</a>.<p>Short.<form><p>Subscribe</p><input></form>
    <div class="ad">Buy things today at our very nice shop for little money.</div><aside>Related</aside><ul><li>one<li>two</ul></article>
    <section id="comments"><p>I liked this article a lot, thank you for writing it all down.</p></section></main><div id="sidebar"><p>Side text of some words here</p></div><footer>&copy; x</footer></body></html>"""
    assert H.main_text(page) == "Head & line\n\nFirst para goes on with a link.\n\nShort.\n\none\n\ntwo"


@pytest.mark.parametrize("page", [None, "", "<nav><a href=x>A</a></nav>", "<script>x", "<!-- open", "<article></article>"])
def test_pages_without_text(page):
    assert H.main_text(page) == ""


def test_page_without_marked_article():
    para = "many words of running text that say something of interest to a reader here"
    page = f"<body><div><a href=a>Home</a> <a href=b>About</a></div><div><h2>Title of it</h2><p>{para}</p><p>{para}</p></div><div><a href=c>Next</a></div></body>"
    assert H.main_text(page) == f"Title of it\n\n{para}\n\n{para}"


def test_very_long_page_and_broken_quotes():
    body = "<p>" + "word " * 50_000 + "</p>"
    assert len(H.main_text(f"<article>{body}</article>")) == 5 * 50_000 - 1
    assert H.main_text('<article><p class="x>broken</p><p>kept</p></article>').endswith("kept")


@pytest.mark.parametrize("long", ["data-props='" + '{"hidden": "no", "id": "sidebar"}' * 160 + "'", 'style="background:url(data:image/png;base64,' + "iVBORw0K" * 625 + ')"'])
def test_marks_after_long_attributes(long):
    assert len(long) > 5000
    para = "many words of running text that say something of interest to a reader here " * 3
    side = "other words of running text that stand beside what the page is about, and are long " * 3
    for mark in ('class="sidebar"', "id=comments", "hidden"):
        assert H.main_text(f"<body><div {long}><p>{para}</p></div><div {long} {mark}><p>{side}</p></div></body>") == para.strip()
    for mark in ('role="main"', "itemprop='articleBody'"):
        assert H.main_text(f"<body><div><p>{side}</p></div><div {long} {mark}><p>{para}</p></div></body>") == para.strip()


def test_extraction_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "<article><p>hi</p></article>", "keep"), (1, None, "x"), (None, "<article><p>hi</p></article>", None)], "page_id long, html string, words string")
    got = H.extract_main_text(pages).collect()
    assert [r["text"] for r in got] == ["hi", "", "hi"] and got[0]["words"] == "keep"
    again = H.extract_main_text(pages.withColumn("text", F.lit("old")))
    assert again.columns.count("text") == 1 and {r["text"] for r in again.collect()} == {"hi", ""}
    assert H.extract_main_text(pages.limit(0)).count() == 0


def test_tree_learns_its_table():
    rows = H.labelled_rows()
    assert all(H.classify(H.default_tree(), r[:-1]) == r[-1] for r in rows) and 0 < sum(r[-1] for r in rows) < len(rows)


def test_wrappers_with_boilerplate_words():
    para = "many words of running text that say something of interest to a reader here " * 4
    for mark in ("layout sidebar-right", "single comments-open", "legal-article", "site search-open"):
        for inner in ("article", "div"):
            page = f'<body><nav><a href=x>A</a></nav><div class="{mark}"><{inner}><h1>Head</h1><p>{para}</p><p>And <math><mi>x</mi></math> too.</p></{inner}></div><footer>Some firm</footer></body>'
            assert H.main_text(page) == f"Head\n\n{para.strip()}\n\nAnd x too.", (mark, inner)
    comments = "".join(f"<article><p>I liked it {i} times, thank you</p></article>" for i in range(9))
    assert H.main_text(f"<main><article><h1>Head</h1><p>{para}</p></article><section id=comments>{comments}</section></main>") == f"Head\n\n{para.strip()}"


def given_pages():
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    for page in pq.read_table(path)["html"].to_pylist():
        yield page, [b.text for b in H.blocks(re.search(r"<article>(.*?)</article>", page, re.S)[1])]


def test_marked_articles_of_the_given_pages():
    assert all(H.main_text(page) == "\n\n".join(article) for page, article in given_pages())


def test_given_pages_without_any_marks():
    """Neither container tags nor classes: blocks are told apart by their words, links, kind and neighbours."""
    right = wrong = 0
    for page, article in given_pages():
        plain = re.sub(r"<(/?)(nav|article|footer)\b[^>]*>", r"<\1div>", page).replace(' class="ad"', "")
        got, expected = (collections.Counter(x) for x in (H.main_text(plain).split("\n\n"), article))
        right += sum((got & expected).values())
        wrong += sum((got - expected).values()) + sum((expected - got).values())
    assert 2 * right / (2 * right + wrong) >= 0.97


# --- quality rules ------------------------------------------------------------------------------------------------


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts():
    rng = np.random.default_rng(3)
    texts = [*TEXTS, *(" ".join(rng.choice(list("abcd\n"), 200)) for _ in range(50))]
    texts = pa.array(texts)
    got = Q.counts(texts, M.Batch(texts))
    for i, t in enumerate(texts.to_pylist()):
        assert tuple(int(got[c][i]) for c in Q.COUNTS) == brute(t), t


def labelled(spark):
    """Clean texts of common words, and junk of signs and shouting."""
    rng = np.random.default_rng(5)
    clean, junk = "the of and to in is it for on with as was at by from house river stone".split(), "$$$ ### WIN!! CLICK!! %%% *** FREE!!".split()
    rows = [(i, " ".join(rng.choice(junk if i % 4 == 0 else clean, 120).tolist()), f"site{i % 3}", "en") for i in range(240)]
    docs = spark.createDataFrame([*rows, (1000, None, None, None), (1001, "", "site0", "en"), (1, rows[1][1], "site1", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 240, 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    return docs, labels


def test_rules_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = Q.judged(docs.withColumn("kept_by_hand", F.lit(1)), M.train(docs, labels)).collect()
    assert len(got) == 243 and "kept_by_hand" in got[0].asDict()
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 2:
            assert r["kept"] == (r["doc_id"] % 4 != 0 and not r["base_failed"])
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] >= 1000)


def plain_odds(model, text):
    """The model's log odds of one text, by the product of its sparse vector with the weights."""
    ((index, share),) = M.vectors(pa.array([text], pa.string()))
    return model.slope * (float(model.weights[index].astype(float) @ share.astype(float)) + model.bias) + model.offset


def plain_good(rows, odds):
    """The classifier's probability of each row (doc_id, text, source, lang), from plain sums over hosts and paths."""
    p = [1 / (1 + np.exp(-odds[r["doc_id"], r["text"]])) for r in rows]
    keys = [(r["source"] or "", r["lang"] or "") for r in rows]
    sites, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for key, x in zip(keys, p):
        sites[key].append(x)
        hosts[key[0]].append(x)
    n, mean = len(p), sum(p) / len(p)
    limit = lambda spread: min(max(mean * (1 - mean) / max(spread, 1e-12) - 1, 4.0), 1e6)
    within = max(0.0, sum(x * x for x in p) - n * mean * mean) / n
    between = sum(sum(v) ** 2 / len(v) for v in hosts.values()) - n * mean * mean
    strong = limit((between - (len(hosts) - 1) * within) / max(n - sum(len(v) ** 2 for v in hosts.values()) / n, 1e-9))
    rates = {h: (sum(v) + strong * mean) / (len(v) + strong) for h, v in hosts.items()}
    squares = sum(sum(v) ** 2 / len(v) for v in sites.values())
    inner = max(0.0, sum(x * x for x in p) - squares) / n
    spread = (squares - sum(sum(v) * sum(hosts[h]) / len(hosts[h]) for (h, _), v in sites.items()) - (len(sites) - len(hosts)) * inner) / max(n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in sites.items()), 1e-9)
    strength = limit(spread)
    logit = lambda x: np.log(x / (1 - x))
    out = []
    for key, own in zip(keys, p):
        rate = (sum(sites[key]) - own + strength * rates[key[0]]) / (len(sites[key]) - 1 + strength)
        out.append(1 / (1 + np.exp(-(logit(own) + logit(rate) - logit(mean)))))
    return out


def test_verdicts_against_sparse_vectors(spark):
    docs, labels = labelled(spark)
    model = M.train(docs, labels)
    rows = docs.collect()
    odds = {(r["doc_id"], r["text"]): plain_odds(model, r["text"]) for r in rows}
    for r in Q.judged(docs, model).collect():
        n, _, _, _, repeated = brute(r["text"])
        p = 1 / (1 + np.exp(-odds[r["doc_id"], r["text"]]))
        failed = n < 50 or 100 * repeated > 50 * n
        assert abs(r["p_good"] - p) < 1e-5 and r["base_failed"] == failed and (r["kept"] == (not failed and p >= 0.5) or abs(p - 0.5) < 1e-5)
    good = {(r["doc_id"], r["text"]): x for r, x in zip(rows, plain_good(rows, odds))}
    for carry_text in (True, False):
        for r in QC.classified(docs.withColumn("key", F.struct("doc_id", "text")), labels, carry_text=carry_text).collect():
            key = tuple(r["key"])
            assert abs(r["evidence"] - odds[key]) < 1e-4 and abs(r["p_good"] - good[key]) < 1e-4 and ("text" in r.asDict()) == carry_text


def test_columns_with_clashing_names(spark):
    docs, labels = labelled(spark)
    names = ["kept", "__kept", "new_kept", "judged", "__judged", "n_words", "host", "path", "n", "total", "__n", "__total", "evidence_of", "salt"]
    wide = docs.withColumns({c: F.lit(c) for c in names})
    for passing in (Q.passing, QC.passing):
        got = passing(wide, labels)
        assert got.columns == wide.columns
        assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, passing(docs, labels).collect()))
        assert all(r[c] == c for r in got.collect() for c in names)
    new = Q.judged(wide, M.train(docs, labels)).collect()
    assert all(isinstance(r["kept"], bool) and r["judged"] == "judged" for r in new)


def test_rules_without_labels(spark):
    docs, labels = labelled(spark)
    assert Q.judged(docs, M.train(docs, labels.limit(0))).count() == 243
    assert Q.judged(docs.limit(0), M.train(docs.limit(0), labels)).count() == 0


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = QC.classified(docs, labels)
    assert set(docs.columns) < set(got.columns)
    wrong = [r["doc_id"] for r in got.collect() if r["doc_id"] < 240 and r["doc_id"] % 2 and r["kept"] != (r["doc_id"] % 4 != 0)]
    assert not wrong
    assert QC.passing(docs.limit(0), labels).count() == 0
    assert QC.passing(docs, labels).columns == docs.columns


def test_posteriors_joined_by_shuffle(spark, monkeypatch):
    docs, labels = labelled(spark)
    key = lambda d: sorted((str(r["doc_id"]), str(r["text"]), round(r["p_good"], 9)) for r in d.collect())
    expected = key(QC.classified(docs, labels))
    monkeypatch.setattr(QC, "BROADCAST_PATHS", 0)
    assert key(QC.classified(docs, labels)) == expected


def test_labels_of_the_documents_at_hand(spark):
    docs, labels = labelled(spark)
    elsewhere = spark.range(10_000, 14_000).selectExpr("id as doc_id", "int(id % 8 = 0) as quality")
    rows, sizes = M.labelled_sample(docs, labels.unionByName(elsewhere), per_class=25)
    assert sizes == {0: 60, 1: 60} and [r[1] for r in rows].count(0) == [r[1] for r in rows].count(1) == 25
    got, expected = M.train(docs, labels.unionByName(elsewhere)), M.train(docs, labels)
    assert (got.weights == expected.weights).all() and (got.slope, got.offset) == (expected.slope, expected.offset)
    for some, odds in (("doc_id % 4 != 0", np.log(61)), ("doc_id % 4 = 0", -np.log(61)), ("doc_id >= 1000", 0.0)):
        model = M.train(docs.where(some), labels.unionByName(elsewhere))
        assert not model.weights.any() and model.offset == pytest.approx(odds)


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 0.9)] * 200 + [("bad", "a", 0.1)] * 200 + [("small", "a", 0.05)]
    got = {r["host"]: r for r in QC.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["big"]["host_rate"] > 0.8 and got["bad"]["host_rate"] < 0.2 and 0.1 < got["small"]["host_rate"] < 0.5


# --- licences -----------------------------------------------------------------------------------------------------


def brute_base(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    at = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_licences(spark):
    texts = [
        *TEXTS, "MIT license mit License, apache-license", "gnu general public license gnu general\npublic license", "cc by cc by", "É mit", "mit", "license mit", "CC BY-NC 4.0 is what this is licensed under",
        "x Licensed under the Apache License, Version 2.0 y", "This work is licensed under the very GNU General Public License, version 3", "Apache Licence", "K mİt license",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (3, "other"), (None, "mit license")], "doc_id long, text string")
    got = L.scanned(docs.withColumn("label", F.lit("x"))).collect()
    assert len(got) == len(texts) + 3
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    for i, t in enumerate(texts):
        if i != 3:
            r = by[i]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t), t
            assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(","))
    assert by[len(texts) - 4]["labels"] == "apache,apache-2.0" and "gpl-3.0" in by[len(texts) - 3]["labels"]
    assert L.scanned(docs.limit(0)).count() == 0


def test_licences_by_order_and_deciding_words(spark):
    gpl = "this work is licensed under the gnu general public license version 3"
    grams = [" ".join(p) for p in zip(gpl.split(), gpl.split()[1:])]
    texts = {
        "This work is licensed under the GNU General Public License version 2": "gpl",
        "This work is licensed under the GNU General Public License": "gpl",
        "This work is licensed under the GNU General Public License, version 3 or later": "gpl,gpl-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is now licensed under a Creative Commons Attribution 4.0 International Public License.": "cc-by",
        "Licensed under CC BY-NC-SA 4.0": "cc-by",  # the base phrase alone
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "Licensed under the Apache License, Version 1.1": "apache",
        "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
        " x ".join(reversed(grams)): "",  # each gram, in the wrong order
        " ".join(g + " x" * (i + 1) for i, g in enumerate(grams)): "",  # in order, but ever further apart
        " ".join(["x " * 40 + g for g in grams]): "",
    }
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scanned(docs).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == list(texts.values())
    assert got[4]["score"] == 1.0 and got[5]["score"] == round(10 / 12, 6)


def brute_labels(text):
    """(labels, score) by comparing every chain of matches, from the definitions alone."""
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    labels, score = set(), 0.0
    for phrase, label in L.PHRASES:
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels.add(label)
            score = 1.0
    for template, label in L.TEMPLATES:
        t = template.split()
        grams = [(i, (a, b)) for i, (a, b) in enumerate(zip(t, t[1:])) if not {a, b} <= L.COMMON]
        deciding = {i for i, g in grams if " ".join(g) in L.DECIDING.get(label, ())}
        matches = [(at, i) for at, g in enumerate(zip(w, w[1:])) for i, x in grams if g == x]
        diagonals = sorted({at - i for at, i in matches})
        runs = []
        for d in diagonals:
            if runs and d - runs[-1][-1] <= L.MERGE_WITHIN:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            own = sorted(m for m in matches if m[0] - m[1] in run)
            if len({i for _, i in own}) / len(grams) < L.MIN_COVERAGE:
                continue
            best = {}
            for at, i in own:  # (deciding grams, grams) of the best chain that ends here
                before = [best[a, j] for a, j in best if a < at and j < i and abs((a - j) - (at - i)) <= L.MERGE_WITHIN]
                d, n = max(before, default=(0, 0))
                best[at, i] = (d + (i in deciding), n + 1)
            d, n = max(best.values())
            if d == len(deciding) and n / len(grams) >= L.MIN_COVERAGE:
                labels.add(label)
                score = max(score, min(1.0, round(n / len(grams), 6)))
    return ",".join(sorted(labels)), score


def test_licence_labels_against_brute_force(spark):
    rng = np.random.default_rng(17)
    texts = ["4 0 nc 4 by nc cc by under cc licensed under"]
    for template, _ in L.TEMPLATES:
        w = template.split()
        for edits in range(8):
            x = list(w)
            for _ in range(edits):
                at, kind = int(rng.integers(0, len(x))), int(rng.integers(0, 4))
                if kind == 0:
                    x.insert(at, "very")
                elif kind == 1 and len(x) > 2:
                    del x[at]
                elif kind == 2:
                    x.insert(at, x[int(rng.integers(0, len(x)))])
                else:
                    at = min(at, len(x) - 2)
                    x[at], x[at + 1] = x[at + 1], x[at]
            texts.append(" ".join(rng.choice(["a", "of", "license", "the"], 5)) + " " + " ".join(x))
        grams = list(zip(w, w[1:]))
        rng.shuffle(grams)
        texts.append(" ".join(" ".join(g) for g in grams))
    texts.append(" ".join(texts))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scanned(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert got[0][0] == "cc-by" and sum("gpl-3.0" in x for x, _ in got.values()) > 3


# --- token ids ----------------------------------------------------------------------------------------------------


def test_grammars_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 49000, int(n)) for n in rng.integers(1, 9, 3000)]
    ids = np.concatenate([words[i] for i in np.minimum(rng.zipf(1.3, 30_000), 3000) - 1] + [np.full(301, 7), rng.integers(0, 49000, 5000)]).astype(np.int32)
    rules, symbols = R.compress(ids, 49408)
    assert (R.expand(symbols, rules, 49408) == ids).all() and len(rules) > 500 and len(symbols) < len(ids) / 3
    counts = collections.Counter()
    last = None
    for pair in zip(symbols.tolist(), symbols.tolist()[1:]):
        last = None if pair == last and pair[0] == pair[1] else pair  # every second place of a run
        counts[pair] += last is not None
    assert max(counts.values()) < R.MIN_COUNT


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    from tokenizers import Tokenizer

    path = T.default_path(name)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = [x.tolist() for x in T.encode_documents(TEXTS, path, 7)]
    assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 7] for x in TEXTS]
    small = T.WordEncoder(path, cache_words=3)
    for _ in range(3):
        ids, n = small.encode(pa.array(TEXTS, pa.string()))
        assert ids.tolist() == [i for x in got for i in x[:-1]] and n.tolist() == [len(x) - 1 for x in got]


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y\nz <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>", "  <|endoftext|>\n", "é́ <|endoftext|>", "<|endoftext |>", "<| endoftext|>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_are_the_librarys(name):
    from tokenizers import Tokenizer

    path = T.default_path(name)
    t = Tokenizer.from_file(path)
    got = [x.tolist() for x in T.encode_documents([*TEXTS, *ADDED], path, 7, added_tokens=True)]
    assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 7] for x in [*TEXTS, *ADDED]]


def test_queries_match_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame([*enumerate([*TEXTS, *ADDED])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for op, file, end_id, n_tokens in ((R.op4, R.TOKENIZER, R.END_ID, "n_tokens"), (P.op6, P.TOKENIZER, P.END_ID, "doc_tokens")):
        t = Tokenizer.from_file(T.default_path(file))
        ids = [[*t.encode(x or "", add_special_tokens=False).ids, end_id] for x in [*TEXTS, *ADDED]]
        got = op(spark, str(tmp_path)).where(f"{n_tokens} < 2048").collect()
        assert len(got) >= len(ids) - 1 and all((r[n_tokens], r["ids_crc32"]) == (len(ids[r["doc_id"]]), T.crc32(np.array(ids[r["doc_id"]]))) for r in got)


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, int), np.array([5]), np.full(5000, 9), rng.integers(0, 20, 30_000), np.tile(rng.integers(0, 49000, 50), 400), rng.integers(0, 49000, 20_000)):
        payload = R.pack_block([1, None], [len(ids) // 3, len(ids) - len(ids) // 3], ids.astype(np.int32), 49408, segment=7000)
        r = R.BlockReader(payload)
        whole = np.concatenate([np.zeros(0, np.uint32), *r])
        assert (whole == ids).all() and len(whole) == len(ids) and r.doc_ids == [1, None]
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (r.stretch(a, b) == ids[a:b]).all()
        assert (r.document(1) == ids[len(ids) // 3 :]).all()
    assert len(R.pack_block([1], [20_000], np.tile(rng.integers(0, 49000, 50), 400).astype(np.int32), 49408)) < 4000
    with pytest.raises(ValueError):
        R.BlockReader(b"nope")


def test_files_of_ids(spark, tmp_path):
    docs = spark.createDataFrame([*((100 - i, t) for i, t in enumerate(TEXTS)), (None, "no id"), (90, TEXTS[10])], "doc_id long, text string").repartition(3)
    path = T.default_path(R.TOKENIZER)
    blocks = R.encode(docs, path, 2, 49408, str(tmp_path / "ids"), block_ids=500)
    got = sorted(R.decode(blocks).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in got], key=lambda x: (x is not None, x))
    start = 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        ids = next(iter(T.encode_documents([texts[r["doc_id"]]], path, 2)))
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (start, len(ids), ids.tolist(), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    assert R.decode(R.encode(docs.limit(0), path, 2, 49408, str(tmp_path / "none"))).count() == 0


# --- packing ------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([*enumerate(TEXTS), *((100 + i, "word " * int(rng.integers(1, 400))) for i in range(150)), (100, "twice"), (None, "x")], "doc_id long, text string").repartition(4)
    path = T.default_path(P.TOKENIZER)
    for window, open_windows in ((64, 4), (2048, 128)):
        rows = P.pack(docs, path, 1, window, open_windows).collect()
        held = collections.defaultdict(list)
        for r in rows:
            assert len(r["ids"]) == r["length"] <= window and r["ids_crc32"] == T.crc32(np.array(r["ids"]))
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in held.values():
            places.sort()
            assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist() and sum(n for _, n in places) <= window
        assert sum(r["length"] for r in rows) == sum(len(x) for x in T.encode_documents([r["text"] for r in docs.collect()], path, 1))
        assert sum(r["length"] for r in rows) / (len(held) * window) > (0.85 if window == 64 else 0.75)
    assert P.pack(docs.limit(0), path).count() == 0


def test_open_windows_are_bounded():
    w = P.OpenWindows(10, 3)
    rng = np.random.default_rng(1)
    for n in rng.integers(1, 11, 500).tolist():
        _, offset, _ = w.place(n)
        assert offset + n <= 10 and len(w.free) <= 3
    assert w.place(10)[1:] == (0, None)


# --- sentencepiece ------------------------------------------------------------------------------------------------


def test_pieces_are_the_librarys():
    import sentencepiece

    path = T.default_path(S.MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in TEXTS] + ["▁▁a ▁", "aaaaaaaaaaaaaaaa", "hello<0x41>", "the<s>the", "=====-----....,,,,", " ", "internationalization antidisestablishmentarianism"]
    got = S.encoder(path).encode(texts)
    assert [x.tolist() for x in got] == lib.encode(texts)
    assert [S.encoder(path).model.decode(x.tolist()) for x in got] == [lib.decode(x.tolist()) for x in got]


def toy_model(pieces, unigram=True):
    def number(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    data = b""
    for piece, score, kind in pieces:
        body = b"\x0a" + number(len(piece.encode())) + piece.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + number(kind)
        data += b"\x0a" + number(len(body)) + body
    trainer = b"\x18" + number(1 if unigram else 2)
    return data + b"\x12" + number(len(trainer)) + trainer


def test_unigram_takes_the_best_sum():
    rng = np.random.default_rng(4)
    pieces = sorted({"".join(rng.choice(list("abc▁"), int(rng.integers(1, 5)))) for _ in range(60)} | set("abc▁"))
    pieces = [p for p in pieces if "▁" not in p[1:]]
    scores = -rng.random(len(pieces)) * 10
    e = S.Encoder(toy_model([("<unk>", 0, 2), *((p, s, 1) for p, s in zip(pieces, scores))]))
    value = dict(zip(pieces, map(float, map(np.float32, scores))))

    def best(word):
        top = [0.0] + [-1e9] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - 4), j):
                if word[i:j] in value:
                    top[j] = max(top[j], top[i] + value[word[i:j]])
        return top[-1]

    words = ["".join(rng.choice(list("abc"), int(rng.integers(1, 12)))) for _ in range(200)]
    for w, ids in zip(words, e.encode(words)):
        assert "".join(e.model.pieces[i] for i in ids) == "▁" + w
        assert sum(value[e.model.pieces[i]] for i in ids) == pytest.approx(best("▁" + w))
    assert e.encode(["axb"])[0].tolist().count(0) == 1


def test_encoding_columns(spark):
    path = T.default_path(S.MODEL)
    docs = spark.createDataFrame([(1, "a small text"), (2, None), (2, ""), (None, "é 🙂")], "doc_id long, text string")
    ids = S.encoded(docs, path)
    assert [r["back"] for r in S.decoded(ids, path, out="back").collect()] == ["a small text", "", "", "é 🙂"]
    assert S.encoded(docs.limit(0), path).count() == 0
