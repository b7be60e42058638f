"""Prompts from retrieved chunks, and answers by a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# The words of the prompt and of the answers given without a model.
NOTHING_FOUND = "I couldn't find any relevant medical information in the database to answer your question."
FAILED = "An error occurred while communicating with the LLM: "


def context(hits: DataFrame, query_id: str = "query_id", rank: str = "rank", section: str = "section", url: str = "source_url", text: str = "text") -> DataFrame:
    """(query_id, context): the hits of each query in rank order, each under a line that names its source."""
    part = F.format_string("\n--- Source %d (%s - %s) ---\n%s\n", F.col("r"), F.coalesce(F.col("s"), F.lit("General")), F.coalesce(F.col("u"), F.lit("Unknown")), F.coalesce(F.col("t"), F.lit("")))
    parts = hits.select(query_id, F.col(rank).cast("int").alias("r"), F.col(section).alias("s"), F.col(url).alias("u"), F.col(text).alias("t")).select(query_id, "r", part.alias("p"))
    return parts.groupBy(query_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda x: x["p"]), "").alias("context"))


def prompt(question: Column, found: Column) -> Column:
    return F.concat(F.lit("Context Information:"), found, F.lit("\n\nUser Question: "), question, F.lit("\n\nAnswer:"))


#: Characters that a token of a model's budget is taken for.
CHARS_PER_TOKEN = 4


def within_budget(text: Column, max_tokens: int) -> Column:
    """The beginning of a text that a model's budget holds."""
    return F.left(text, F.lit(max_tokens * CHARS_PER_TOKEN))


def shortened(text: Column, chars: int, mark: str = "...") -> Column:
    """A text for display: cut to so many characters, with a mark where something was cut."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit(mark))).otherwise(text)


def extractive_model(most_words: int = 60) -> Callable[[str, str], str]:
    """A deterministic stand-in: the first words of the first source."""

    def answer(question: str, found: str) -> str:
        body = found.split("---\n", 1)[-1]
        return " ".join(body.split()[:most_words])

    return answer


def answers(queries: DataFrame, hits: DataFrame, load: Callable[[], Callable[[str, str], str]] = extractive_model, query_id: str = "query_id", query: str = "query", max_tokens: int | None = None, **columns: str) -> DataFrame:
    """(query_id, query, prompt, answer). Without hits a fixed answer; a model's error becomes the answer's text.

    With max_tokens the context is cut to what that budget holds.
    """

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()

        def one(question: str, found: str) -> str:
            if not found:
                return NOTHING_FOUND
            try:
                return model(question, found).strip()
            except Exception as e:  # the caller sees the failure as text, whatever it was
                return FAILED + str(e)

        for question, found in parts:
            yield pd.Series([one(q, c) for q, c in zip(question, found)])

    found = queries.select(query_id, query).join(context(hits, query_id, **columns), query_id, "left").withColumn("context", F.coalesce("context", F.lit("")))
    if max_tokens is not None:
        found = found.withColumn("context", within_budget(F.col("context"), max_tokens))
    return found.select(query_id, query, prompt(F.col(query), F.col("context")).alias("prompt"), ask(F.col(query), F.col("context")).alias("answer"))


def judged(rows: DataFrame, source: str = "source", summary: str = "summary", least: float = 0.90) -> DataFrame:
    """Add coverage_score and passed: the share of the source's facts that the summary holds, and whether it's enough."""
    coverage = T.fact_coverage(F.col(source), F.col(summary))
    return rows.withColumns({"coverage_score": coverage, "passed": coverage >= least})


def missing_facts(source: Column, summary: Column) -> Column:
    return F.array_except(T.facts(source), T.facts(summary))


def synthesize(jobs: DataFrame, load: Callable[[], Callable[[str, list[str]], str]], least: float = 0.90, retries: int = 3) -> DataFrame:
    """(cluster_id, text, attempts, coverage_score, passed): a summary of each job's source, tried again with the facts it missed.

    jobs: (cluster_id, source). The model gets the source and the facts missing from its last try.
    """

    @F.pandas_udf("struct<text:string,attempts:int,coverage_score:double,passed:boolean>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import re

        model = load()
        pattern = re.compile(r"[0-9][0-9.,/-]*[0-9]|[0-9]|[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*")
        for sources in parts:
            out = []
            for source in sources.fillna(""):
                wanted, missing, best = set(pattern.findall(source)), [], None
                for attempt in range(1, retries + 1):
                    text = model(source, missing)
                    held = wanted & set(pattern.findall(text))
                    score = len(held) / len(wanted) if wanted else 1.0
                    best = (text, attempt, score, score >= least)
                    if score >= least:
                        break
                    missing = sorted(wanted - held)
                out.append(best)
            yield pd.DataFrame(out, columns=["text", "attempts", "coverage_score", "passed"])

    return jobs.select("cluster_id", run("source").alias("r")).select("cluster_id", "r.*")
