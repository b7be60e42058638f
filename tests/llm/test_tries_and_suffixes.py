"""Conversation tries, source divergence and suffix deduplication against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import prefix_trie as P
from sparkloom.llm import source_divergence as D
from sparkloom.llm import suffix_dedup as S

TURNS = "conv_id long, turn int, role string, text string"


def plain_trie(rows):
    """{path: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)} by walking every path."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below = {v: [u for u in members if u[: len(v)] == v] for v in members}
    out = {}
    for v, who in members.items():
        kids = [u for u in below[v] if len(u) == len(v) + 1]
        leaves = sum(not any(len(w) == len(u) + 1 for w in below[u]) for u in below[v])
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below[v] if u)
        ends = ",".join(str(c) for c in sorted(c for c in who if paths[c] == v))
        out[v] = (min(who), len(v), min(members[v[:-1]]) if v else None, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def got_trie(frame):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in P.trie(frame).collect()), key=str)


def test_trie_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["hé", "yo", "a" * 40])) for c in range(60) for t in range(rng.randrange(0, 7))]
    rows += [(c, t, "user", f"same {t}") for c in range(700, 760) for t in range(4)]  # copies
    rows += [(90, None, "user", "null first"), (90, 2, None, None), (90, 2, "", ""), (90, 2, "user", "tie b"), (90, 2, "user", "tie a"), (90, 2, "user", "tie a"), (None, 1, "user", "nobody's"), (-7, 0, "user", "negative"), (-5, 1, "bot", "x" * 100_000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("pos", "segment", "c", "size", "bytes")}).repartition(3)
    assert got_trie(frame) == plain_trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    """Conversations over several segments and ranges."""
    monkeypatch.setattr(P, "SEGMENT", 7)
    rows = [(c, t, "user", f"turn {t}" if t < 20 * (1 + c % 3) else f"own {c} {t}") for c in (0, 1, 2, 3, 4, 11) for t in range(75)]
    assert got_trie(spark.createDataFrame(rows, TURNS).repartition(4)) == plain_trie(rows)


def test_trie_of_many_ends_and_of_nothing(spark):
    """A node's ends in several chunks are hashed in order; conversations without a turn end at the root."""
    rows = [(c, 0, "user", "hello") for c in range(0, 3000, 7)] + [(c, 0, "user", "hello") for c in (10**15, -(10**15))]
    assert got_trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
    assert P.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert P.trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


DOCS = "doc_id long, text string, lang string, source string"


def plain_audit(rows, least=3, top=200):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, df, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w.translate(low) for w in term.findall(text or "")]
        for w in words:
            n[lang, source, w] += 1
        for w in set(words):
            df[lang, w] += 1
    out = []
    floor = lambda x: x.numerator // x.denominator
    for lang in {g[0] for g in groups}:
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)
        kept = [w for (g, w), k in df.items() if g == lang and k >= least]
        total = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        p = {(s, w): 1 + floor(Fraction(10**9 * (n[lang, s, w] + 1), total[s] + len(kept))) for s in sources for w in kept}
        q = {w: 1 + floor(Fraction(10**9 * (sum(n[lang, s, w] for s in sources) + 1), sum(total.values()) + len(kept))) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(t, sum(f(p[s, w], p[t, w]) for w in kept)) for t in sources if t != s]
            terms = [(w, f(p[s, w], q[w])) for w in kept if n[lang, s, w] and p[s, w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for r, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, r))
    return sorted(out)


def got_audit(frame):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in D.audit(frame).collect())


def test_audit_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "The", "été", "ÉTÉ", "naïve", "x", "straße", "日本", "zebra", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(i, rng.choice([" ", "\n", "--", "1"]).join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", None, "B"])) for i in range(150)]
    rows += [(900, None, "de", "only null"), (901, "", "de", "empty"), (902, "alone", "it", "one"), (903, "zebra " * 50_000, "en", "a"), *[rows[5]] * 3]
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "value", "rank", "p")}).repartition(3)
    expected = plain_audit(rows)
    assert got_audit(frame) == expected and {r[0] for r in expected if r[2] == "pair" and r[4] == 0} == {"de"}
    monkeypatch.setattr(D, "BROADCAST_GROUPS", 0)
    assert got_audit(frame) == expected
    assert got_audit(frame.limit(0)) == []


def test_audit_is_exact_for_large_counts(spark):
    count, total = 3 * 10**15 + 7, 10**16 + 9
    row = spark.createDataFrame([(count, total, 5)], "n long, total long, v long")
    assert row.select(D.rate(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (count + 1) // (total + 5)


def plain_removed(rows):
    """By (doc_id nulls last, hash of text): rows in the order judged, each beside what is removed."""
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((doc_id, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_removed(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in S.removed(frame).collect()), key=str)


def letters(rng, n):
    return "".join(rng.choices("abcdefgh é", k=n))


def test_removed_against_brute_force(spark):
    rng = random.Random(2)
    passages = [letters(rng, n) for n in (60, 101, 130, 400, 2000)]
    rows = [(i, "".join(rng.choice([letters(rng, rng.randrange(1, 90)), rng.choice(passages)]) for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    rows += [(200, "a" * 1000), (201, "ab" * 700), (202, None), (203, ""), (204, passages[3]), (205, passages[3]), (206, passages[1][:99]), (207, passages[4] * 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "tie", "start", "bucket", "part")}).repartition(5)
    assert got_removed(frame) == plain_removed(rows)
    assert got_removed(frame.limit(0)) == []


def test_removed_with_common_passages(spark):
    """A bucket of more runs than one part holds: all share a passage, each between bytes of its own."""
    rng = random.Random(3)
    passage = letters(rng, 150)
    rows = [(i, letters(rng, 90) + passage + letters(rng, 90)) for i in range(700)]
    assert got_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain_removed(rows)


def test_removed_of_long_texts_and_repeated_rows(spark):
    rng = random.Random(5)
    long_text = letters(rng, 1 << 20) + "".join(rng.choices("xyz", k=1 << 20))
    rows = [(1, long_text), (2, "q" + long_text[1_048_000:1_049_900] + "r"), (3, "short"), (3, "short"), (4, long_text[5000:5500]), (4, long_text[5000:5500])]
    assert got_removed(spark.createDataFrame(rows, "doc_id long, text string")) == plain_removed(rows)
    # Of texts that share an id, one comes first; null ids come last.
    a, b = letters(rng, 300), letters(rng, 50)
    got = S.removed(spark.createDataFrame([(None, a), (None, a), (7, a + b), (7, b + a)], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 7) == [0, len(a.encode())]
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [len(a.encode())] * 2


@pytest.mark.parametrize("seed, size, alphabet", [(0, 4000, 2), (1, 3000, 256), (2, 2000, 1), (3, 0, 3)])
def test_deep_shallow_sorting(seed, size, alphabet):
    """Order and classes of suffixes, cut to the full length, against Python's own order."""
    rng = np.random.default_rng(seed)
    data = rng.integers(0, alphabet, size + S.LENGTH + 16).astype(np.uint8)
    data[size // 2 : size // 2 + size // 4] = data[: size // 4]
    at = np.sort(rng.integers(0, max(1, size), size))
    group = np.sort(rng.integers(0, 5, size))
    eight = S._words(data)
    word = lambda k, d: eight[at[k] + d].byteswap()
    order, starts = S.quicksorted(word, group, S.SHALLOW)
    leader = S.tried(lambda k, d: S._limited(word(k, d), d), lambda k, d: data[at[k] + d], order, starts, S.SHALLOW, S.LENGTH)
    text = [(int(group[k]), data[at[k] : at[k] + S.LENGTH].tobytes()) for k in range(size)]
    assert [text[k] for k in order] == sorted(text)
    first = {}
    assert [first.setdefault(text[k], k) for k in range(size)] == leader.tolist()
