"""Retrieval and text quality measures."""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

CUTS = (1, 3, 5)


def first_relevant(hits: DataFrame, relevant: Column, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query_id, first): rank of each query's first relevant hit; null without one."""
    return hits.groupBy(query_id).agg(F.min(F.when(relevant, F.col(rank))).alias("first"))


def id_relevant(item_id: Column, document_id: Column, section: Column) -> Column:
    """A hit is relevant if its id begins with {document}_{section}."""
    return F.startswith(item_id, F.concat_ws("_", document_id, section))


def recall_and_mrr(first: DataFrame, cuts=CUTS) -> DataFrame:
    """One row: n_queries, recall_at_k for each cut, mrr. Queries without a relevant hit stay in the denominator."""
    hit = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}")
    mrr = F.avg(F.when(F.col("first") <= max(cuts), 1.0 / F.col("first")).otherwise(0.0)).alias("mrr")
    return first.agg(F.count("*").alias("n_queries"), *(hit(k) for k in cuts), mrr)


def overlap_by_url(pairs: DataFrame, url: str = "url", extracted: str = "extracted", native: str = "native") -> DataFrame:
    """(url, questions_count, avg_overlap)."""
    scored = pairs.withColumn("overlap", T.token_overlap(F.col(extracted), F.col(native)))
    return scored.groupBy(url).agg(F.count("*").alias("questions_count"), F.avg("overlap").alias("avg_overlap"))


def overlap_summary(by_url: DataFrame, status: str = "status", ok: str = "success") -> DataFrame:
    """One row: n_urls, n_success, success_rate in percent, n_questions, avg_overlap over all questions.

    by_url: (status, questions_count, avg_overlap) of each url; without questions the average is 0.
    """
    good = F.col(status) == ok
    questions = F.sum(F.coalesce("questions_count", F.lit(0)))
    total = F.sum(F.coalesce(F.col("avg_overlap") * F.col("questions_count"), F.lit(0.0)))
    rate = F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(good), F.count("*")), F.lit(0.0))
    return by_url.agg(F.count("*").alias("n_urls"), F.count_if(good).alias("n_success"), rate.alias("success_rate"), F.coalesce(questions, F.lit(0)).alias("n_questions"), F.coalesce(F.try_divide(total, questions), F.lit(0.0)).alias("avg_overlap"))


def timed(run: Callable[[], int]) -> tuple[int, float]:
    """(what run() gives, the number of items, and the mean milliseconds of an item) by the wall clock of the driver."""
    began = time.perf_counter()
    n = run()
    return n, 1000 * (time.perf_counter() - began) / n if n else 0.0


def bleu(candidate: list[str], reference: list[str], order: int = 4) -> float:
    if not candidate or not reference:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        c = Counter(zip(*(candidate[i:] for i in range(n))))
        r = Counter(zip(*(reference[i:] for i in range(n))))
        same, total = sum((c & r).values()), max(sum(c.values()), 1)
        logs += math.log((same + (n > 1)) / (total + (n > 1))) if same or n > 1 else -math.inf
    brevity = min(0.0, 1 - len(reference) / len(candidate))
    return math.exp(brevity + logs / order)


def common_subsequence(one: list, two: list) -> int:
    """Length of the longest common subsequence, by bits: a word of the longer list updates a row of all of the shorter one."""
    if len(one) > len(two):
        one, two = two, one
    at: dict = {}
    for i, x in enumerate(one):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(one)) - 1
    row = full  # a bit is 0 where the length grows
    for x in two:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(one) - row.bit_count()


def rouge_l(candidate: list[str], reference: list[str]) -> float:
    """F1 of the longest common subsequence."""
    common = common_subsequence(candidate, reference)
    return 2 * common / (len(candidate) + len(reference)) if common else 0.0


def text_scores(candidate: Column, reference: Column) -> Column:

    @F.arrow_udf("struct<bleu:double,rouge_l:double>")
    def _text_scores(candidate: pa.Array, reference: pa.Array) -> pa.Array:
        out = []
        for c, r in zip(candidate.to_pylist(), reference.to_pylist()):
            c, r = (c or "").lower().split(), (r or "").lower().split()
            out.append({"bleu": bleu(c, r), "rouge_l": rouge_l(c, r)})
        return pa.array(out, pa.struct([("bleu", pa.float64()), ("rouge_l", pa.float64())]))

    return _text_scores(candidate, reference)


def roll_up(runs: DataFrame, by: str = "variant") -> DataFrame:
    """Compare variants of a system over rows (variant, first) and any of latency_ms, tokens, bleu, rouge_l, coverage, explored.

    Measures whose column isn't there are left out.
    """
    pct = lambda p: F.percentile("latency_ms", p)
    measures = {
        "latency_ms": [pct(0.5).alias("p50_ms"), pct(0.95).alias("p95_ms")],
        "tokens": [F.avg("tokens").alias("avg_tokens")],
        "bleu": [F.avg("bleu").alias("bleu")],
        "rouge_l": [F.avg("rouge_l").alias("rouge_l")],
        "coverage": [F.avg("coverage").alias("coverage")],
        "explored": [F.avg(F.col("explored").cast("double")).alias("exploration_rate")],
    }
    return runs.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(F.col("first") <= 5, 1.0).otherwise(0.0)).alias("recall_at_5"), *(m for c, ms in measures.items() if c in runs.columns for m in ms))


#: Measures of a run that are averaged, and the size parameter of latency sketches.
MEANS = ("tokens", "bleu", "rouge_l", "coverage", "explored")
SKETCH = 400


def run_sketches(runs: DataFrame, by: list[str]) -> DataFrame:
    """Measures of runs by (variant, day, ...), small rows to store: counts, sums, and mergeable sketches of latencies and queries.

    runs: `by`, first (rank of the first relevant result), and any of query_id, latency_ms and MEANS.
    """
    have = [c for c in MEANS if c in runs.columns]
    out = [F.count("*").alias("n"), F.count_if(F.col("first") <= 5).alias("found")]
    out += [x for c in have for x in (F.sum(F.col(c).cast("double")).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
    if "latency_ms" in runs.columns:
        out.append(F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), SKETCH).alias("latencies"))
    if "query_id" in runs.columns:
        out.append(F.hll_sketch_agg("query_id").alias("queries"))
    return runs.groupBy(*by).agg(*out)


def report(sketches: DataFrame, by: str = "variant") -> DataFrame:
    """One row for each variant from stored rows of run_sketches(), in any number and order: recall, means, p50 and p95, distinct queries.

    The percentiles' ranks are within the sketch's error (about 1 % at SKETCH) of the exact ones.
    """
    have = [c for c in MEANS if f"sum_{c}" in sketches.columns]
    sums = [F.sum("n").alias("n"), F.sum("found").alias("found"), *(F.sum(x).alias(x) for c in have for x in (f"sum_{c}", f"n_{c}"))]
    out = [by, "n", (F.col("found") / F.col("n")).alias("recall_at_5"), *(F.try_divide(f"sum_{c}", f"n_{c}").alias(f"avg_{c}") for c in have)]
    if "latencies" in sketches.columns:
        sums.append(F.kll_merge_agg_double("latencies").alias("latencies"))
        out += [F.kll_sketch_get_quantile_double("latencies", F.lit(p)).alias(f"p{int(100 * p)}_ms") for p in (0.5, 0.95)]
    if "queries" in sketches.columns:
        sums.append(F.hll_union_agg("queries").alias("queries"))
        out.append(F.hll_sketch_estimate("queries").alias("n_queries"))
    return sketches.groupBy(by).agg(*sums).select(*out)
