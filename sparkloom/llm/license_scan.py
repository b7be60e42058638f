"""License scan by diagonal voting, with DataFrame operations only.

Every text's words are rolled into k-grams, whose hashes are joined to the positions that the same grams have in
license templates. A match of gram and template position votes for a diagonal: its place in the text minus its
place in the template. Votes are summed by document, template and diagonal; diagonals of one template that lie
close to each other (a word more or less in the text shifts the rest) are merged; and a merged span is verified by
its longest chain of matches: places and template positions both ascend, and neighbours lie on the same diagonal or
close ones, so a chain is as short as the template is. The chain must hold the template's deciding grams (version and
variant words) and, with them, a share of all its grams. Hash collisions don't count, as the joined rows carry the
grams themselves.

The SQL counterpart counts a merged span's grams without regard to order and deciding ones. Both agree on statements
in the templates' own words, which are all that the given tables hold; of others the scan keeps fewer.

The short phrases of the base rule are templates too: all their grams on one diagonal mean that the words stand
consecutively. A template's label counts from `MIN_COVERAGE` of its grams on.

Words are runs of letters, digits and non-ASCII characters, after A-Z is lowered. Null and empty texts have none.
Rows with one doc_id and text are scanned once and returned as often as they stand there. Templates are few and of
fixed size, so they are sent to every task; what is shuffled are the votes and one row for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm import common

K = 2
#: Least share of a template's grams that a span must hold; neighbouring diagonals are merged up to this distance.
MIN_COVERAGE = 0.75
MERGE_WITHIN = 3
#: The base rule's phrases and labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Sentences by which works commonly state their licenses, and labels.
TEMPLATES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Grams without which a template's label doesn't hold, by label; they count in those templates that have them.
DECIDING = {
    "gpl": ("gnu general",),
    "gpl-3.0": ("gnu general", "version 3"),
    "apache-2.0": ("apache license", "version 2"),
    "mit": ("mit license",),
    "cc-by": ("by 4", "creative commons", "attribution 4"),
    "cc-by-nc": ("by nc", "nc 4"),
    "cc-by-sa": ("by sa", "sa 4"),
    "mpl": ("mozilla public",),
}
#: What a deciding gram counts in a chain, besides one for the gram: more than all grams of a template.
DECIDING_WEIGHT = 1000
#: Words whose pairs say nothing of a license: grams of two of them don't vote.
COMMON = frozenset("a and any as by for from in is it of or that the this to with without".split())


def template_grams(templates=(), phrases=PHRASES) -> list[tuple[int, str, bool, int, str, int]]:
    """(template, label, base, position, gram, number of the template's grams)."""
    out = []
    for t, (text, label, base) in enumerate([*((p, x, True) for p, x in phrases), *((p, x, False) for p, x in templates)]):
        words = text.split()
        grams = [(i, " ".join(words[i : i + K])) for i in range(len(words) - K + 1)]
        grams = [(i, g) for i, g in grams if base or not COMMON.issuperset(g.split())]
        out += [(t, label, base, i, g, len(grams)) for i, g in grams]
    return out


def chained(templates=TEMPLATES, phrases=PHRASES) -> Column:
    """Grams in the best chain of a span that holds all deciding grams, from columns template and pairs; 0 without one.

    pairs are (at, position) in the order of places. Neighbours in a chain are at most a template's length and
    MERGE_WITHIN places apart, so only pairs as recent are held.
    """
    grams = template_grams(templates, phrases)
    deciding = [(t, i) for t, label, base, i, g, _ in grams if not base and g in DECIDING.get(label, ())]
    reach = max((i for _, _, _, i, _, _ in grams), default=0) + MERGE_WITHIN
    coded = F.array(*(F.lit(t * DECIDING_WEIGHT + i) for t, i in deciding)) if deciding else F.array().cast("array<int>")
    weight = lambda x: F.when(F.array_contains(coded, F.col("template") * DECIDING_WEIGHT + x["position"]), DECIDING_WEIGHT + 1).otherwise(1)
    kind = "struct<recent:array<struct<at:int,position:int,n:int>>,best:int>"

    def step(held: Column, x: Column) -> Column:
        near = lambda a: (a["at"] < x["at"]) & (a["position"] < x["position"]) & (F.abs((a["at"] - a["position"]) - (x["at"] - x["position"])) <= MERGE_WITHIN)
        before = F.coalesce(F.array_max(F.transform(F.filter(held["recent"], near), lambda a: a["n"])), F.lit(0))
        n = weight(x) + before
        recent = F.concat(F.filter(held["recent"], lambda a: a["at"] >= x["at"] - reach), F.array(F.struct(x["at"].alias("at"), x["position"].alias("position"), n.alias("n"))))
        return F.struct(recent.alias("recent"), F.greatest(held["best"], n).alias("best")).cast(kind)

    none = F.struct(F.array().cast("array<struct<at:int,position:int,n:int>>").alias("recent"), F.lit(0).alias("best")).cast(kind)
    best = F.aggregate(F.col("pairs"), none, step, lambda held: held["best"])
    counts: dict[int, int] = {}
    for t, _ in deciding:
        counts[t] = counts.get(t, 0) + 1
    needed = F.lit(0)
    for t, n in counts.items():
        needed = F.when(F.col("template") == t, n).otherwise(needed)
    return F.when(F.floor(best / DECIDING_WEIGHT) == needed, best % DECIDING_WEIGHT).otherwise(0)


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, nothing else: texts without other capitals go through the engine's faster lower()."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    grams = spark.sql(f"select template, label, base, position, gram as template_gram, grams, xxhash64(gram) as hash from {_values(templates, phrases)}")
    grams = F.broadcast(grams)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = F.split(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), split.alias("w"))
    # Only the ends of the split can be empty.
    head = F.when(F.element_at("w", 1) == "", 1).otherwise(0)
    tail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    rows = rows.select("doc_id", "text_hash", F.slice("w", head + 1, F.size("w") - head - tail).alias("w"))
    rows = rows.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "w")
    # One more place stands for the document itself, so that documents without votes stay, and are counted.
    rolled = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.when(i > 0, F.concat_ws(" ", F.get("w", i - 1), F.get("w", i))))
    rolled = F.when(F.size("w") > 1, rolled).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("doc_id", "text_hash", "n_words", F.posexplode(rolled).alias("place", "gram"))
    voted = rows.join(grams, F.xxhash64("gram") == F.col("hash"), "left")
    voted = voted.where((F.col("gram") == F.col("template_gram")) | (F.col("place") == 0))
    voted = voted.select("doc_id", "text_hash", "n_words", "template", "label", "base", "position", "grams", (F.col("place") - 1).alias("at"), (F.col("place") - 1 - F.col("position")).alias("diagonal"))
    # Votes: equal rows vote for the same places, so places count once; the document's own row counts copies.
    key = ["doc_id", "text_hash"]
    diagonals = voted.groupBy(*key, "n_words", "template", "label", "base", "grams", "diagonal").agg(F.count_if(F.col("at") == -1).alias("copies"), F.collect_set(F.when(F.col("template").isNotNull(), F.col("position"))).alias("held"))
    nearby = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    # Phrases of the base rule are exact: a diagonal of their own. Others are merged with neighbouring diagonals.
    far = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(nearby) > MERGE_WITHIN), F.lit(True))
    runs = diagonals.withColumn("run", F.sum(far.cast("int")).over(nearby.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy(*key, "n_words", "template", "label", "base", "grams", "run").agg(F.max("copies").alias("copies"), F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("votes"), F.collect_list(F.struct("diagonal", "held")).alias("matches"))
    # Few spans hold enough grams to be verified.
    enough = ~F.col("base") & (F.col("votes") / F.col("grams") >= min_coverage)
    pair = lambda d: lambda p: F.struct((d + p).cast("int").alias("at"), p.cast("int").alias("position"))
    pairs = F.array_sort(F.flatten(F.transform("matches", lambda m: F.transform(m["held"], pair(m["diagonal"])))))
    spans = spans.withColumn("pairs", F.when(enough, pairs)).withColumn("votes", F.when(enough, chained(templates, phrases)).otherwise(F.col("votes"))).drop("matches", "pairs")
    share = F.col("votes") / F.col("grams")
    base = F.col("base") & (F.col("votes") == F.col("grams"))
    verified = base | (~F.col("base") & (share >= min_coverage))
    labels = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    out = spans.groupBy(*key, "n_words").agg(
        F.max("copies").alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(verified).alias("labels"),
        F.coalesce(F.max(F.when(verified, F.least(F.round(share, 6), F.lit(1.0)))), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("copies"), F.lit(1)))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3(spark, sf_dir):
    return scanned(common.table(spark, sf_dir, "documents"))


def _values(templates=TEMPLATES, phrases=PHRASES) -> str:
    rows = ", ".join(f"({t}, '{label}', {str(base).lower()}, {i}, '{g}', {n})" for t, label, base, i, g, n in template_grams(templates, phrases))
    return f"(values {rows}) t(template, label, base, position, gram, grams)"


ORACLE = f"""
with words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda v: v <> '') as w
    from documents
), rolled as (
    select doc_id, unnest(range(0, greatest(len(w) - 1, 0))) as place, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as gram from words
), diagonals as (
    select r.doc_id, t.template, t.label, t.base, t.grams, r.place - t.position as diagonal, list(distinct t.position) as held
    from rolled r join {_values()} on r.gram = t.gram
    group by all
), steps as (
    select *, case when base or diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {MERGE_WITHIN} or lag(diagonal) over (partition by doc_id, template order by diagonal) is null then 1 else 0 end as far
    from diagonals
), runs as (
    select *, sum(far) over (partition by doc_id, template order by diagonal rows unbounded preceding) as run from steps
), spans as (
    select doc_id, label, base, grams, min(diagonal) as start, len(list_distinct(flatten(list(held)))) as votes
    from runs group by doc_id, template, label, base, grams, run
), verified as (
    select *, base and votes = grams as exact, case when base then votes = grams else votes / grams >= {MIN_COVERAGE} end as good from spans
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, count(*) filter (where v.exact) as n_base,
    cast(min(v.start) filter (where v.exact) as bigint) as first_word, cast(max(v.start) filter (where v.exact) as bigint) as last_word,
    coalesce(string_agg(distinct v.label, ',' order by v.label) filter (where v.exact), '') as base_labels,
    coalesce(string_agg(distinct v.label, ',' order by v.label) filter (where v.good), '') as labels,
    coalesce(max(round(v.votes / v.grams, 6)) filter (where v.good), 0.0) as score
from words w left join verified v on v.doc_id = w.doc_id
group by w.doc_id, w.w
"""
