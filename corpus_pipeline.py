"""From documents to training sequences: classify, apply quality rules, drop near duplicates, pack.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with all their columns; the last one
gives the pieces of the packed sequences. A stage's rows are written in the shared folder and read back as the next
stage's documents, and deleted after the stage after it is written.

Null and empty texts have no words, so the quality rules drop them; rows without doc_id and rows that share one are
documents of their own, and of rows equal in id and text one stays. An empty table gives no pieces. Further columns
are carried along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, ngram_join, packing, quality_classifier, quality_rules


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.passing(docs, common.table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, frugal=True)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("packing", pack),
]

#: The classifiers are trained and the tokenizer is a file: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(*before)
        before = [docs]
    return docs
