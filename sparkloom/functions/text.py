"""Column expressions over text that behave alike for every kind of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that Java leaves out.
SPACE = "(?U)[\\s\\x1c-\\x1f]"


def words(text: Column) -> Column:
    """The words between white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+", ""), "(?U)[\\s\\x1c-\\x1f]+\\z", "")


def token_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def token_overlap(extracted: Column, native: Column) -> Column:
    """Share of the native text's distinct lower-case tokens that the extracted text has; 0 if either has none."""
    a, b = token_set(extracted), token_set(native)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(b)), F.lit(0.0)))


def undouble(text: Column) -> Column:
    """SummarySummary -> Summary: a heading of an even length above 4 whose halves are equal."""
    half = F.floor(F.length(text) / 2).cast("int")
    twice = (F.length(text) > 4) & (F.length(text) % 2 == 0) & (F.left(text, half) == F.right(text, half))
    return F.when(twice, F.left(text, half)).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[/.-]", "_")


def facts(text: Column) -> Column:
    """Numbers, dates and capitalised spans: what a deterministic judge compares."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9][0-9.,/-]*[0-9]|[0-9]|[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)"), 1))


def fact_coverage(source: Column, summary: Column) -> Column:
    a, b = facts(source), facts(summary)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
