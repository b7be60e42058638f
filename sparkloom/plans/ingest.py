"""From Q&A rows and page snapshots to embedded chunks, and the answers drawn from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import rules as R
from sparkloom.functions import text as T
from sparkloom.operators import chunk as C
from sparkloom.operators import embed as E
from sparkloom.operators import extract as X
from sparkloom.operators import generate as G
from sparkloom.operators import retrieve as V
from sparkloom.operators import stats as S
from sparkloom.operators import upsert as U
from sparkloom.sources import rows as Q

GROUP = "Disorder"
SENIOR = "nihseniorhealth"
#: Urls that are sent to the pages at most; beyond, pages and urls meet by a shuffle.
WANTED_URLS = 1_000_000


def senior_documents(rows: DataFrame) -> DataFrame:
    """Rows of the site whose answers are the documents: one document for each row."""
    section = R.senior_section(F.col("question_type"))
    return rows.where(F.col("domain").contains(SENIOR)).select("document_id", "document_url", "question_focus", "pos", section.alias("section"), F.concat_ws("\n", F.coalesce(section, F.lit("None")), "answer").alias("text"))


def page_documents(rows: DataFrame, snapshots: DataFrame, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections as documents, status of each url): pages are deduplicated before they are read and extracted.

    Pages are extracted where they lie; up to WANTED_URLS urls are sent there, so that no html is shuffled, and only what
    is found goes to the urls.
    """
    wanted = rows.where(~F.col("domain").contains(SENIOR) & F.col("document_url").isNotNull())
    if done is not None:
        wanted = U.resume(wanted, done, "document_url")
    urls = S.first_rows(wanted, "document_url", "pos").select("document_id", "document_url", "question_focus", "domain", "pos")
    asked = urls.select(F.col("document_url").alias("url"))
    few = asked.limit(WANTED_URLS + 1).count() <= WANTED_URLS
    pages = snapshots.where(R.usable_page(F.col("html"))).join(F.broadcast(asked) if few else asked, "url", "left_semi")
    read = pages.select(F.col("url").alias("document_url"), F.col("source").alias("page_source"), X.extract(F.col("html"), R.authority(F.col("url")))["sections"].alias("sections"))
    found = urls.join(read, "document_url", "left").withColumn("sections", F.coalesce("sections", F.array().cast(read.schema["sections"].dataType)))
    status = found.select("domain", F.col("document_url").alias("url"), F.when(F.size("sections") > 0, F.col("page_source")).alias("source"), F.size("sections").alias("n_topics"), S.word_total(F.col("sections")).alias("n_words"), "pos")
    documents = found.select("document_id", "document_url", "question_focus", "pos", F.explode("sections").alias("s")).select("document_id", "document_url", "question_focus", "pos", F.col("s.section").alias("section"), F.col("s.text").alias("text"))
    return documents, status


def ingest(qa: DataFrame, snapshots: DataFrame, load: Callable = E.hashing_encoder, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, statistics by domain). qa: Q&A rows with pos, their order."""
    rows = Q.routed(Q.guarded(qa))
    pages, status = page_documents(rows, snapshots, done)
    documents = pages.unionByName(senior_documents(rows))
    made = C.chunk(documents, section="section", row="pos")
    chunks = made.select("chunk_id", "chunk_key", F.col("chunk_text").alias("text"), "document_id", F.col("document_url").alias("source_url"), "question_focus", F.lit(GROUP).alias("umls_semantic_group"), F.coalesce("section", F.lit("General")).alias("section"), "token_count")
    return E.embed_chunks(chunks, load, "text"), S.averages(S.domain_counters(status))


def answer(queries: DataFrame, collection: DataFrame, load: Callable = E.hashing_encoder, model: Callable = G.extractive_model, k: int = 3) -> DataFrame:
    """(query_id, query, prompt, answer): retrieve k chunks for each query that isn't blank, and ask the model."""
    V.check_k(k)
    asked = V.nonblank(queries)
    vectors = asked.select("query_id", E.embedder(load)(F.col("query")).alias("query_vector"))
    hits = V.top_k(vectors, collection.select(F.col("chunk_key").alias("item_id"), F.col("embedding").alias("vector")), k)
    described = hits.join(collection.select(F.col("chunk_key").alias("item_id"), "section", "source_url", "text"), "item_id")
    return G.answers(asked, described, model)


def thin(documents: DataFrame, least: int = 100) -> DataFrame:
    """Documents with at least so many characters."""
    return documents.where(F.length(T.strip(F.col("text"))) >= least)
