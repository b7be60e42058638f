"""Question-and-answer rows and page snapshots as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import schemas
from sparkloom.functions import rules as R

GUARDED = ("question_focus", "umls_semantic_group", "question_type", "answer")


def qa_rows(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Rows of a Q&A table; four columns that may be null read as empty strings."""
    reader = spark.read.options(**options).format(kind)
    rows = (reader if kind == "parquet" else reader.schema(schemas.QA_ROW)).load(path)
    return guarded(rows)


def guarded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in GUARDED if c in rows.columns})


def routed(rows: DataFrame, url: str = "document_url") -> DataFrame:
    """Add domain, fetch_mode and archive_date."""
    domain, path = R.authority(F.col(url)), R.path(F.col(url))
    return rows.withColumns({"domain": domain, "fetch_mode": R.fetch_mode(domain, path), "archive_date": R.archive_date(domain, path)})


def with_url(rows: DataFrame, url: str = "document_url", domain: str | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows that have a url, of a domain if one is named; the first `limit` by `order`."""
    out = rows.where(F.col(url).isNotNull() & (F.col(url) != ""))
    if domain:
        out = out.where(R.authority(F.col(url)).contains(domain))
    return out if limit is None else out.orderBy(order or url).limit(limit)


def answered(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Rows whose answer is there: those that a benchmark can use."""
    return rows.where(F.col(answer).isNotNull())


def first_documents(rows: DataFrame, n: int, document: str = "document_id", order: str = "pos") -> DataFrame:
    """Rows of the first n documents, in the order of their first rows."""
    first = rows.where(F.col(document).isNotNull()).groupBy(document).agg(F.min(order).alias("__first")).orderBy("__first", document).limit(n).select(document)
    return rows.join(first, document, "left_semi")


def secure_url(url: Column) -> Column:
    return F.regexp_replace(url, "^http:", "https:")


def disease_url(url: Column) -> Column:
    return F.replace(url, F.lit("/gard/"), F.lit("/diseases/"))


def archive_url(reply: Column, url: Column, wanted: Column) -> Column:
    """The snapshot named by an availability reply (JSON), or one made up from the wanted date.

    A reply of before 2023 doesn't count where a date from 2023 on is wanted. Null without either.
    """
    closest = F.get_json_object(reply, "$.archived_snapshots.closest.url")
    stamp = F.get_json_object(reply, "$.archived_snapshots.closest.timestamp")
    too_old = F.coalesce(F.startswith(wanted, F.lit("2023")) & (F.substring(stamp, 1, 4) < "2023"), F.lit(False))
    made = F.when(wanted.isNotNull(), F.concat(F.lit("https://web.archive.org/web/"), wanted, F.lit("/"), url))
    return F.when(closest.isNull(), made).when(~too_old, closest)
