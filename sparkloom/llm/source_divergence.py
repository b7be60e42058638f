"""Source divergence audit: how far the word use of each source of a language lies from that of every other.

Terms are counted within the tasks that hold the texts, a row for each term of a batch and group, and summed by Spark.
Each term that enough documents of its language hold is then one wide row: an array over the language's sources, in
order, with the term's smoothed rate in each. Higher-order functions give, for each source that has the term, its
contributions to the pairs with all other sources; pairs in which neither source has the term have one common value,
which is added as often as it occurs. So the work grows with the occurrences of terms in sources times the sources of
a language, which is what the pairs asked for need, and sums by pair are combined before they are shuffled. The largest
terms of a source are kept by rank limits, which tasks apply before anything is shuffled.

Counts and sums of counts are longs. A rate is floor(10^9 (count + 1) / (N + V)) + 1, worked out in decimals of 38 digits,
so counts up to 10^18 are exact; rates are below 2 * 10^9 and divergences are whole divisions of longs.

Null texts, langs and sources are empty ones. A document is a row; repeated rows count each. Texts of any length are
counted whole; a batch's arrays are of some ten times its texts' size. Groups without kept terms have pairs of value 0; a
language with one source has none. Ties in value go by the item's UTF-8 bytes. Empty tables give no rows. Columns other
than text, lang and source don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import common

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Documents that a worker gets at once, and bytes of text that it counts at once (one document at least).
DOCUMENTS_AT_ONCE = 2000
BYTES_AT_ONCE = 8 << 20
#: Groups sent to every task at most, with their sizes; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000

#: Bytes of terms (letters and all of what isn't ASCII), lower-cased; 0 for others.
_BYTE = np.zeros(256, np.uint8)
_BYTE[128:] = np.arange(128, 256)
_BYTE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(document number of each term, the terms) of an array of texts, in order."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    byte = _BYTE[data]
    inside = byte != 0
    # A term begins where the byte before is none of its own, or of another document.
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0] - offsets[0]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    kept = byte[inside]
    ends = np.append((np.cumsum(inside) - 1)[starts], len(kept)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept))
    document = np.searchsorted(offsets - offsets[0], starts, "right") - 1
    return document, words.dictionary_encode()


COUNTED = "lang string, source string, term string, n long, docs long"


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many bytes of a text column, of one row at least."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", BYTES_AT_ONCE):
        lang, source = (batch.column(k).fill_null("") for k in ("lang", "source"))
        pair = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
        names: dict[tuple, int] = {}
        owner = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in pair.to_pylist()], np.int64)
        document, words = terms_of(batch.column("text"))
        size = max(1, len(words.dictionary))
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # Equal terms of a document come together, then those of a group.
        key, n = np.unique(document * size + code, return_counts=True)
        cell, at = np.unique(owner[key // size] * size + key % size, return_inverse=True)
        total, docs = np.bincount(at, n, len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell)).astype(np.int64)
        known = list(names)
        # Each group has a row without a term, so that those without any are known too.
        g = np.concatenate([np.arange(len(known)), cell // size])
        term = pa.concat_arrays([pa.nulls(len(known), pa.string()), words.dictionary.take(pa.array(cell % size)).cast(pa.string())])
        zero = np.zeros(len(known), np.int64)
        columns = [pa.array([x[k] for x in known], pa.string()).take(pa.array(g)) for k in range(2)]
        yield pa.RecordBatch.from_arrays([*columns, term, pa.array(np.concatenate([zero, total])), pa.array(np.concatenate([zero, docs]))], ["lang", "source", "term", "n", "docs"])


def counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by group, and a row with a null term for each group."""
    rows = documents.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    with common.batches_of(documents.sparkSession, DOCUMENTS_AT_ONCE):
        found = rows.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        return common.materialize(found, "term-counts")


def rate(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term, in billionths."""
    above = (count.cast("decimal(19,0)") + F.lit(1)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, (total + terms).cast("decimal(19,0)")) + F.lit(1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for all other sources, part `term` for the terms most above the language's rate."""
    with common.scope() as keep:
        out = common.materialize(_audit(documents, least, top), "divergence")
        keep(out)
    return out


def _audit(documents: DataFrame, least: int, top: int) -> DataFrame:
    counted = counts(documents)
    # A term's row: its count in each source that has it, of which there are as many as sources at most.
    having = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("has"))
    kept = common.materialize(having.where(F.col("docs") >= least).select("lang", "term", "has"), "kept-terms")

    # Sources of each language in order, with the kept terms' occurrences there.
    sizes = kept.select("lang", F.explode("has").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left")
    sources = F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))))
    langs = groups.groupBy("lang").agg(sources.alias("sources"), F.coalesce(F.sum("total"), F.lit(0)).alias("all"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    absent = F.transform("sources", lambda s: F.when(F.col("terms") > 0, rate(F.lit(0), s["total"], F.col("terms"))))
    langs = common.materialize(langs.withColumn("absent", absent), "langs")
    few = groups.count() <= BROADCAST_GROUPS
    at_hand = F.broadcast(langs) if few else langs

    # The wide vectors: rates in source order, and which sources have the term.
    in_source = F.map_from_entries("has")
    n = F.transform("sources", lambda s: F.coalesce(F.try_element_at(F.col("in_source"), s["source"]), F.lit(0)))
    rates = F.transform(F.arrays_zip("n", "sources"), lambda x: rate(x["n"], x["sources"]["total"], F.col("terms")))
    wide = kept.withColumn("in_source", in_source).join(at_hand, "lang").withColumn("n", n).withColumn("p", rates)
    of_lang = rate(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x), F.col("all"), F.col("terms"))
    wide = wide.select("lang", "term", "n", "p", of_lang.alias("q"))
    wide = common.materialize(wide, "term-vectors")

    # Each source i that has the term, against every other; if the other has it too, that one gives its own side.
    mine = wide.select("lang", "n", "p", F.posexplode("n").alias("i", "n_i")).where("n_i > 0").withColumn("p_i", F.get("p", F.col("i")))

    def given(p: Column, j: Column) -> Column:
        there = F.get("n", j) > 0
        back = F.when(there, F.lit(None)).otherwise(divergence(p, F.col("p_i")))
        return F.struct(j.alias("j"), divergence(F.col("p_i"), p).alias("out"), back.alias("back"))

    other = mine.select("lang", "i", F.inline(F.filter(F.transform("p", given), lambda x: x["j"] != F.col("i"))))
    sums = other.groupBy("lang", "i", "j").agg(F.sum("out").alias("out"), F.count("*").alias("n_out"), F.sum("back").alias("back"), F.count("back").alias("n_back"))
    # Either side of a pair, of one pass over the vectors.
    sides = F.array(
        F.struct("i", "j", F.col("out").alias("value"), F.col("n_out").alias("seen")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.coalesce("back", F.lit(0)).alias("value"), F.col("n_back").alias("seen")),
    )
    sums = sums.select("lang", F.inline(sides)).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))

    each = langs.select("lang", "terms", "sources", "absent", F.posexplode("sources").alias("i", "s")).select("lang", "terms", "i", F.col("s.source").alias("source"), F.get("absent", F.col("i")).alias("p"), F.posexplode(F.arrays_zip("sources", "absent")).alias("j", "o"))
    each = each.where("i != j").select("lang", "terms", "i", "j", "source", F.col("o.sources.source").alias("item"), F.coalesce(divergence(F.col("p"), F.col("o.absent")), F.lit(0)).alias("both_absent"))
    value = F.coalesce("value", F.lit(0)) + (F.col("terms") - F.coalesce("seen", F.lit(0))) * F.col("both_absent")
    pairs = each.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    names = langs.select("lang", F.posexplode(F.col("sources.source")).alias("i", "source"))
    names = F.broadcast(names) if few else names
    terms = wide.select("lang", "term", "q", F.posexplode(F.arrays_zip("n", "p")).alias("i", "x")).where((F.col("x.n") > 0) & (F.col("x.p") > F.col("q")))
    terms = terms.join(names, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("x.p"), F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def op12(spark, sf_dir):
    return audit(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (
    select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents
), o as (
    select doc, lang, source, unnest(w) as term from d
), kept as (
    select lang, term from o group by lang, term having count(distinct doc) >= 3
), c as (
    select lang, source, term, count(*) as n from o join kept using (lang, term) group by all
), v as (
    select lang, count(*) as v from kept group by lang
), g as (
    select distinct lang, source from d
), t as (
    select g.lang, g.source, coalesce(sum(c.n), 0) as total from g left join c using (lang, source) group by all
), p as (
    select t.lang, t.source, kept.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (t.total + v.v)::hugeint as p
    from t join kept using (lang) join v using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = kept.term
), q as (
    select lang, term, 1 + 1000000000::hugeint * (sum(n)::hugeint + 1) // (any_value(l.total) + any_value(v.v))::hugeint as q
    from p join v using (lang) join (select lang, sum(total) as total from t group by lang) l using (lang) group by lang, term
), pairs as (
    select a.lang, a.source, b.source as item, coalesce(sum(x.f), 0) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (select x.lang, x.source, y.source as other, sum((x.p - y.p) * (x.p - y.p) // y.p) as f from p x join p y on x.lang = y.lang and x.term = y.term group by all) x on x.lang = a.lang and x.source = a.source and x.other = b.source
    group by all
), terms as (
    select lang, source, term as item, (p - q) * (p - q) // q as value from p join q using (lang, term) where n > 0 and p > q
)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200
"""
