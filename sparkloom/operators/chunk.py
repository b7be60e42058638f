"""Overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

#: Tokens to a chunk and of overlap, and tokens to a word.
TOKENS, OVERLAP, TOKENS_PER_WORD = 500, 50, 1.3


def windows(text: Column, tokens: int = TOKENS, overlap: int = OVERLAP, drop_contained_tail: bool = False) -> Column:
    """array<struct<text, n_words>>: windows of int(tokens/1.3) words, each overlapping the last by int(overlap/1.3).

    A step of no words gives one window. A text without words gives none. `drop_contained_tail` leaves out a last
    window that lies wholly inside the one before.
    """
    size, shared = int(tokens / TOKENS_PER_WORD), int(overlap / TOKENS_PER_WORD)
    step = size - shared
    # The words are bound once, as the only element of an array.
    bound = F.array(T.words(text))

    def cut(w: Column) -> Column:
        last = F.size(w) - 1 if not drop_contained_tail else F.greatest(F.size(w) - 1 - shared, F.lit(0))
        starts = F.sequence(F.lit(0), last, F.lit(step)) if step > 0 else F.array(F.lit(0))
        made = F.transform(starts, lambda s: F.slice(w, s + 1, size))
        made = F.transform(made, lambda x: F.struct(F.array_join(x, " ").alias("text"), F.size(x).alias("n_words")))
        return F.when(F.size(w) > 0, made).otherwise(F.slice(made, 1, 0))

    return F.flatten(F.transform(F.filter(bound, lambda w: F.size(w) > 0), cut))


#: Where a sentence ends: after its mark and closing quotes, before white space and what may begin another.
_SENTENCE_END = "(?<=[.!?][\"'\u201d\u2019)]{0,2})\\s+(?=[\"'\u201c\u2018(]?[\\p{Lu}\\p{N}])"


def sentences(text: Column) -> Column:
    """array<string>: the sentences of a text, without white space about them; none of a null or blank text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _SENTENCE_END), T.strip), lambda x: x != "")


def sentence_windows(text: Column, tokens: int = TOKENS) -> Column:
    """array<struct<text, n_words>>: whole sentences, as many as int(tokens/1.3) words hold. Longer ones stand alone."""
    size = int(tokens / TOKENS_PER_WORD)
    kind = "struct<text:string,n_words:int>"

    def add(made: Column, sentence: Column) -> Column:
        n, last = F.size(T.words(sentence)), F.try_element_at(made, F.lit(-1))
        fits = (F.size(made) > 0) & (last["n_words"] + n <= size)
        joined = F.struct(F.concat(last["text"], F.lit(" "), sentence).alias("text"), (last["n_words"] + n).alias("n_words")).cast(kind)
        alone = F.struct(sentence.alias("text"), n.alias("n_words")).cast(kind)
        return F.when(fits, F.concat(F.slice(made, 1, F.size(made) - 1), F.array(joined))).otherwise(F.concat(made, F.array(alone)))

    return F.aggregate(sentences(text), F.array().cast(f"array<{kind}>"), add)


def token_count(n_words: Column) -> Column:
    return (n_words * F.lit(TOKENS_PER_WORD)).cast("int")


def chunk(docs: DataFrame, document_id: str = "document_id", text: str = "text", section: str = "section", row: str | None = None, tokens: int = TOKENS, overlap: int = OVERLAP, drop_contained_tail: bool = False) -> DataFrame:
    """One row for each chunk: chunk_id, chunk_index, chunk_text, token_count beside the document's other columns.

    chunk_id is {document_id}_{section}_{index}. Document ids are used again across sites, so with `row` (a column
    that tells rows apart) a chunk_key is added that no two chunks share.
    """
    made = docs.select("*", F.posexplode(windows(F.col(text), tokens, overlap, drop_contained_tail)).alias("chunk_index", "c"))
    name = F.coalesce(F.col(section), F.lit("General")) if section in docs.columns else F.lit("General")
    out = made.withColumns({"chunk_id": F.concat_ws("_", F.col(document_id).cast("string"), name, F.col("chunk_index").cast("string")), "chunk_text": F.col("c.text"), "token_count": token_count(F.col("c.n_words"))}).drop("c")
    if row:
        out = out.withColumn("chunk_key", F.sha2(F.concat_ws("|", F.col(row).cast("string"), name, F.col("chunk_index").cast("string")), 256))
    return out
