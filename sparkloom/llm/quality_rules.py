"""Quality rules: counts over the words and lines of whole texts, and a trained n-gram model's verdict.

The counts take words between ASCII white space. A document fails the base rules with too few words, or if more
than half of its words stand in 3-word windows that the text holds twice or more. Those that pass are judged by
hashed word and character n-gram logistic regression (see textmodel), calibrated to a probability and held
against a fixed threshold, in Arrow batches.

Null and empty texts count as texts without words and fail the base rules. Repeated rows, ties and extra columns
need no care: each row is judged on its own, and columns other than the text are carried along, but for those named as
a new one is, which it replaces; passing() replaces none. Empty tables give empty results. Windows are compared by
64-bit hashes of their words, lines by their text.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common, textmodel, workers

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least calibrated probability of good quality.
MIN_PROBABILITY = 0.5
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def counts(texts: pa.Array, batch: textmodel.Batch) -> dict[str, np.ndarray]:
    texts = pc.fill_null(texts, "")
    data, bounds, begin, owner = batch.data, batch.bounds, batch.begin, batch.owner
    n = len(texts)
    out = {
        "n_words": np.bincount(owner, minlength=n).astype(np.int64),
        "word_chars": _per_text(((data & 0xC0) != 0x80) & ~_SPACE[data], bounds),
        "n_symbols": _per_text(_SYMBOL[data], bounds),
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": np.zeros(n, np.int64),
    }
    lines = pc.split_pattern(texts, "\n")
    of = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    coded = lines.flatten().dictionary_encode()
    wordy = pc.match_substring_regex(coded.dictionary, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy().astype(np.int64)
    solid = wordy[codes] if len(codes) else np.zeros(0, bool)
    keys = of[solid] * (len(wordy) + 1) + codes[solid]
    distinct = np.unique(keys)
    out["n_dup_lines"] = np.bincount(of[solid], minlength=n) - np.bincount(distinct // (len(wordy) + 1), minlength=n).astype(np.int64)
    if len(begin) >= 3:
        w = batch.hashes
        h = textmodel.mix((w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + w[2:])
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        h = textmodel.mix(h[inside] + owner[inside].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(begin), bool)
        at = inside[twice]
        covered[at] = covered[at + 1] = covered[at + 2] = True
        out["n_repeat_words"] = np.bincount(owner[covered], minlength=n).astype(np.int64)
    return out


def judge_udf(model: textmodel.TextModel):
    frozen = pickle.dumps(model)
    kind = pa.struct([*((c, pa.int64()) for c in COUNTS), ("log_odds", pa.float64())])

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",log_odds:double>")
    def judge(text: pa.Array) -> pa.Array:
        workers.forget()
        m = textmodel._thawed(frozen)
        parts = []
        for part in textmodel.slices(text):
            batch = textmodel.Batch(part)
            found = counts(part, batch)
            parts.append(pa.StructArray.from_arrays([*(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(m.log_odds(batch), pa.float64())], fields=list(kind)))
        workers.trim()
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return judge


def judged(docs: DataFrame, model: textmodel.TextModel, text: str = "text", min_probability: float = MIN_PROBABILITY, prefix: str = "") -> DataFrame:
    """Add the counts, base_failed, p_good and kept to every row, each name after `prefix`."""
    held = common.unused("judged", {c.lower() for c in docs.columns})
    out = docs.withColumn(held, judge_udf(model)(F.col(text).cast("string")))
    f = F.col(held)
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    p = 1 / (1 + F.exp(-f["log_odds"]))
    return out.withColumns({**{prefix + c: f[c] for c in COUNTS}, prefix + "base_failed": failed, prefix + "p_good": p, prefix + "kept": ~failed & (p >= min_probability)}).drop(held)


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    names = docs.columns
    taken = {c.lower() for c in names}
    prefix = "new_"
    while any((prefix + c).lower() in taken for c in (*COUNTS, "base_failed", "p_good", "kept")):
        prefix = "_" + prefix
    return judged(docs, textmodel.train(docs, labels), prefix=prefix).where(F.col(prefix + "kept")).select(*names)


def op2(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = judged(docs.select("doc_id", "text"), textmodel.train(docs, labels))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
