"""Corpus statistics by site, and the ordered selections that go with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkloom import scratch
from sparkloom.functions import rules as R
from sparkloom.functions import text as T


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows with a null key are a key of their own."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def domain_counters(rows: DataFrame) -> DataFrame:
    """Per domain: distinct links, live, wayback and skipped pages, samples, topics and words.

    rows: (domain, url, source, n_topics, n_words), source null for pages that couldn't be read.
    """
    status = R.reach_status(F.col("source"))
    count = lambda s: F.count_if(status == s)
    return rows.groupBy("domain").agg(
        F.count_distinct("url").alias("total_dataset_links"),
        count("live").alias("live"),
        count("wayback").alias("wayback"),
        count("skipped").alias("skipped"),
        F.count_if(status != "skipped").alias("samples"),
        F.sum(F.when(status != "skipped", F.col("n_topics")).otherwise(0)).alias("topics"),
        F.sum(F.when(status != "skipped", F.col("n_words")).otherwise(0)).alias("words"),
    )


def averages(counters: DataFrame) -> DataFrame:
    """Topics and words a sample, 0 where a domain has none, and a row of totals (domain null)."""
    sums = counters.rollup("domain").agg(*(F.sum(c).alias(c) for c in ("total_dataset_links", "live", "wayback", "skipped", "samples", "topics", "words")))
    mean = lambda c: F.bround(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("samples")), F.lit(0.0)), 1)
    return sums.withColumns({"avg_topics": mean("topics"), "avg_words": mean("words")})


def first_urls(rows: DataFrame, n: int = 5, key: str = "domain", url: str = "url", order: str = "pos") -> DataFrame:
    """(key, urls): up to n distinct urls of each key, in the order first seen."""
    seen = rows.groupBy(key, url).agg(F.min(order).alias("__at"))
    w = W.partitionBy(key).orderBy("__at", url)
    kept = seen.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", url))), lambda x: x[url]).alias("urls"))


#: Sites whose pages are told apart by more than one path segment.
DEEPER = {"nlm.nih.gov": 2}


def subpath_stats(rows: DataFrame, url: str = "url", focus: str = "focus", answer: str = "answer", deeper: dict[str, int] | None = None) -> DataFrame:
    """Per domain and first path segment: rows, null answers and their share, distinct topics, rows a topic.

    deeper: how many segments count for sites whose domain holds a name, by default those of DEEPER; fewer if there are fewer.
    """
    domain, segments = R.authority(F.col(url)), F.slice(F.split(R.path(F.col(url)), "/"), 2, 99)
    depth = F.lit(1)
    for name, n in (DEEPER if deeper is None else deeper).items():
        depth = F.when(domain.contains(name), F.lit(n)).otherwise(depth)
    segment = F.array_join(F.slice(segments, F.lit(1), depth), "/")
    found = rows.select(domain.alias("domain"), segment.alias("sub_path"), F.col(focus).alias("focus"), F.col(answer).alias("answer"))
    out = found.groupBy("domain", "sub_path").agg(F.count("*").alias("n_rows"), F.count_if(F.col("answer").isNull() | (F.col("answer") == "")).alias("null_answers"), F.count_distinct("focus").alias("topics"))
    return out.withColumns({"null_percent": F.round(100 * F.try_divide(F.col("null_answers").cast("double"), F.col("n_rows")), 2), "rows_per_topic": F.round(F.coalesce(F.try_divide(F.col("n_rows").cast("double"), F.col("topics")), F.lit(0.0)), 2)})


def report_lines(averages: DataFrame) -> DataFrame:
    """(pos, line): the rows of averages() as lines of a report, with numbers formatted here and not before."""
    order = W.orderBy(F.col("domain").isNull(), "domain")  # a row for each site
    name = F.coalesce("domain", F.lit("all"))
    line = F.format_string("%s: %d links, %d live, %d wayback, %d skipped, %.1f topics and %.1f words a sample", name, "total_dataset_links", "live", "wayback", "skipped", "avg_topics", "avg_words")
    return averages.select(F.row_number().over(order).alias("pos"), line.alias("line"))


def _local_runs(value: str):
    """Adds to batches of a range, in order: the range's number and the number of value changes so far in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(value)
            before = pa.concat_arrays([column.slice(0, 1) if last is None else last, column.slice(0, batch.num_rows - 1)])
            # Null-safe: a null follows a null without a change.
            differ = pc.fill_null(pc.not_equal(column, before), False).to_numpy(zero_copy_only=False) | (column.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
            runs = at + np.cumsum(differ)
            at, last = int(runs[-1]), column.slice(batch.num_rows - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int64()), pa.array(runs, pa.int64())], [*batch.schema.names, "__part", "__run"])

    return run


def islands(rows: DataFrame, order: str, value: str, within: str | None = None) -> DataFrame:
    """Number the runs of equal values in order, from 1. Without `within` the whole table is one sequence.

    The sequence is cut into ranges of the order by one exchange. Each range numbers its own runs as its rows pass by and
    is written with the numbers; the ranges' heads, tails and totals, a short row each, come from what was written and are
    summed up in order. So no task holds more than a batch, and rows are moved once. Rows that share a place in the order
    stand by their values; nulls come first in both.
    """
    if within is not None:
        w = W.partitionBy(within).orderBy(order)
        change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("long")
        return rows.withColumn("__c", change).withColumn("island", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__c")
    schema = StructType([*rows.schema.fields, StructField("__part", LongType()), StructField("__run", LongType())])
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order, value)
    local = scratch.written(ranged.mapInArrow(_local_runs(value), schema), "islands")
    ends = local.groupBy("__part").agg(F.max("__run").alias("runs"), F.min_by(value, "__run").alias("head"), F.max_by(value, "__run").alias("tail"))
    over = W.orderBy("__part")  # a row for each range
    joins = F.when(F.lag("__part").over(over).isNull(), 1).otherwise((~F.col("head").eqNullSafe(F.lag("tail").over(over))).cast("long"))
    base = ends.withColumn("__joins", joins).withColumn("__base", F.sum("__joins").over(over.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("runs").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(F.broadcast(base.select("__part", "__base")), "__part")
    return out.withColumn("island", F.col("__run") + F.col("__base")).drop("__part", "__run", "__base")


def skip_take(rows: DataFrame, key: str, order: str, usable: Column, skip: int = 5, take: int = 2) -> DataFrame:
    """Of each key's rows in order: leave out the first `skip`, then the first `take` usable ones.

    `order` tells a key's rows apart. Both bounds are limits by rank, which tasks apply before anything is shuffled, so a
    key of any size sends a few rows only.
    """
    w = W.partitionBy(key).orderBy(order)
    rest = rows
    if skip:
        first = rows.select(F.col(key).alias("__key"), F.col(order).alias("__order"))
        nth = F.row_number().over(W.partitionBy("__key").orderBy("__order"))
        cut = first.withColumn("__n", nth).where(F.col("__n") <= skip).groupBy("__key").agg(F.max("__order").alias("__cut"), F.count("*").alias("__c")).where(F.col("__c") == skip)
        rest = rows.join(cut, F.col(key).eqNullSafe(F.col("__key")) & (F.col(order) > F.col("__cut"))).select(*rows.columns)
    return rest.where(usable).withColumn("__m", F.row_number().over(w)).where(F.col("__m") <= take).drop("__m")


def section_pivot(rows: DataFrame, key: str, section: str, text: str, order: str, complete: int = 3) -> DataFrame:
    """(key, sections, n_sections, is_complete): a map of each key's sections; the last text of a section wins."""
    last = rows.groupBy(key, section).agg(F.max_by(text, order).alias("__t"))
    out = last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(section, "__t")))).alias("sections"), F.count("*").alias("n_sections"))
    return out.withColumn("is_complete", F.col("n_sections") >= complete)


def top_topics(rows: DataFrame, focus: str, n: int = 50) -> DataFrame:
    return rows.groupBy(focus).agg(F.count("*").alias("n_questions")).orderBy(F.desc("n_questions"), focus).limit(n)


def samples(rows: DataFrame, by: list[str], order: str, n: int = 10) -> DataFrame:
    w = W.partitionBy(*by).orderBy(order)
    return rows.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def section_counts(chunks: DataFrame, section: str = "section") -> DataFrame:
    return chunks.groupBy(F.coalesce(F.col(section), F.lit("Unknown")).alias("section")).agg(F.count("*").alias("n_chunks"))


def word_total(sections: Column) -> Column:
    """Words of an array of sections."""
    return F.aggregate(sections, F.lit(0), lambda n, s: n + T.word_count(s["text"]))
