"""Queries of the corpus and retrieval operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import scratch
from sparkloom.functions import rules as R
from sparkloom.functions import text as T
from sparkloom.functions import vectors as V
from sparkloom.operators import ann as AN
from sparkloom.operators import chunk as C
from sparkloom.operators import clean as CL
from sparkloom.operators import embed as E
from sparkloom.operators import evaluate as EV
from sparkloom.operators import evolve as EO
from sparkloom.operators import extract as X
from sparkloom.operators import freshness as FR
from sparkloom.operators import generate as G
from sparkloom.operators import html as H
from sparkloom.operators import retrieve as RT
from sparkloom.operators import stats as S
from sparkloom.operators import upsert as U
from sparkloom.plans import ingest as I
from sparkloom.sources import fetch as FE
from sparkloom.sources import store as ST
from sparkloom.streaming import jobs as J

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The hosts of the page table stand for the sites that the routing rules know.
SITES = (("example.com", "cdc.gov"), ("example.org", "niddk.nih.gov"), ("example.net", "rarediseases.info.nih.gov"))
NOW = "2024-03-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The words of a text, in SQL.
_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda v: v <> '')"
_AUTHORITY = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""
with d as (select doc_id, source, {_WORDS.format("text")} as w from documents),
c as (select doc_id, source, w, unnest(range(0, len(w), 346)) as s from d)
select doc_id, source || '' as source, cast(s // 346 as bigint) as chunk_index, concat_ws('_', cast(doc_id as varchar), source, cast(s // 346 as varchar)) as chunk_id,
    array_to_string(w[s + 1:s + 384], ' ') as chunk_text, cast(floor(len(w[s + 1:s + 384]) * 1.3::double) as bigint) as token_count
from c""")
def chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = C.chunk(docs, "doc_id", "text", "source")
    return out.select("doc_id", "source", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", "chunk_text", F.col("token_count").cast("long").alias("token_count"))


def _asked(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


_TOPK = """
with e as (select vec_id, label, embedding::double[] as v from embeddings),
p as (select q.vec_id as query_id, e.vec_id as item_id, q.label as asked, e.label as found, round(1 - list_cosine_similarity(e.v, q.v), 9) as d from e join e q on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id),
r as (select *, row_number() over (partition by query_id order by d, item_id) as rank from p)
"""


@query(_TOPK + "select query_id, item_id, round(d, 6) as distance, cast(rank as bigint) as rank from r where rank <= 5")
def vector_topk(spark, sf_dir):
    rows, asked = _asked(spark, sf_dir)
    hits = RT.top_k(asked, rows, 5, item_id="vec_id", vector="embedding", skip_self=True)
    return hits.select("query_id", "item_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_TOPK + "select query_id, item_id, round(d, 6) as distance, cast(rank as bigint) as rank from r where rank <= 5")
def indexed_topk(spark, sf_dir):
    """The same by an inverted-file index, half of it inserted later; all cells are read and the search is exact."""
    rows, asked = _asked(spark, sf_dir)
    index = AN.VectorIndex(spark, scratch.path(spark, "index"), "vec_id", "embedding").build(rows.where("vec_id % 2 = 0"))
    index.insert(rows)
    hits = index.search(asked, 5, probes=len(index.model[0]), rerank=200, skip_self=True, exact=True)
    # As the SQL rounds: to 9 decimals first, then by double arithmetic, which takes halves as they are in binary.
    distance = F.round(F.round("distance", 9) * 1e6) / 1e6
    return hits.select("query_id", "item_id", distance.alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""
with e as (select vec_id, vec_id // 8 as item_id, embedding::double[] as v from embeddings),
n as (select q.item_id as query_id, q.vec_id as token, e.item_id, max(list_cosine_similarity(q.v, e.v)) as best from e q join e on true where q.item_id % 25 = 0 group by all),
s as (select query_id, item_id, round(sum(best), 9) as score from n group by all)
select query_id, item_id, round(score, 6) as score, cast(rank as bigint) as rank from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s) where rank <= 5""")
def late_interaction(spark, sf_dir):
    """Documents of eight token vectors each, and every 25th of them as a query."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("item_id"), (F.col("vec_id") % 8).alias("position"), F.col("embedding").alias("vector"))
    asked = rows.where("item_id % 25 = 0").select(F.col("item_id").alias("query_id"), "position", F.col("vector").alias("query_vector"))
    hits = AN.LateInteraction(rows.select("item_id", "vector")).top_k(asked, 5)
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_TOPK + """, f as (select query_id, min(rank) filter (where asked = found) as first from r where rank <= 5 group by query_id)
select count(*) as n_queries, round(avg(case when first <= 1 then 1.0 else 0.0 end), 6) as recall_at_1, round(avg(case when first <= 3 then 1.0 else 0.0 end), 6) as recall_at_3,
    round(avg(case when first <= 5 then 1.0 else 0.0 end), 6) as recall_at_5, round(avg(coalesce(1.0::double / first, 0.0)), 6) as mrr from f""")
def retrieval_metrics(spark, sf_dir):
    rows, asked = _asked(spark, sf_dir)
    hits = RT.top_k(asked, rows, 5, item_id="vec_id", vector="embedding", skip_self=True)
    label = rows.select("vec_id", "label")
    known = hits.join(label.withColumnsRenamed({"vec_id": "query_id", "label": "asked"}), "query_id").join(label.withColumnsRenamed({"vec_id": "item_id", "label": "found"}), "item_id")
    out = EV.recall_and_mrr(EV.first_relevant(known, F.col("asked") == F.col("found")))
    return out.select("n_queries", *(F.round(c, 6).alias(c) for c in out.columns if c != "n_queries"))


@query("""
with t as (select conv_id, turn, role, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda v: v <> '')) as w from conversations)
select a.conv_id, count(*) as questions_count, round(avg(case when len(a.w) = 0 or len(u.w) = 0 then 0.0 else len(list_intersect(u.w, a.w)) / len(a.w)::double end), 6) as avg_overlap
from t u join t a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant' group by a.conv_id""")
def token_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("extracted"))
    said = rows.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("native"))
    return EV.overlap_by_url(asked.join(said, ["conv_id", "turn"]), "conv_id").select("conv_id", "questions_count", F.round("avg_overlap", 6).alias("avg_overlap"))


def _clean_sql() -> str:
    text = "text"
    for stop in CL.STOPS:
        text = f"split_part({text}, '{stop}', 1)"
    text = f"replace({text}, chr(9), ' ')"
    for p in CL.DELETED:
        # This engine's word boundary knows ASCII only.
        text = f"regexp_replace({text}, '(?is)go([^\\pL\\pN_]|\\z)', '\\1', 'g')" if p == "GO\\b" else f"regexp_replace({text}, '(?is){p}', '', 'g')"
    text = f"regexp_replace({text}, '(?m)[ \\t]+$', '', 'g')"
    text = f"regexp_replace({text}, '\\n\\s*([,.;:!?])', '\\1', 'g')"
    text = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"select doc_id, regexp_replace({text}, '\\A\\s+|\\s+\\z', '', 'g') as cleaned from documents"


@query(_clean_sql())
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", CL.clean_text(F.col("text")).alias("cleaned"))


def _any_sql(words) -> str:
    return " or ".join(f"contains(lower(text), '{w}')" for w in words)


@query("select conv_id, turn, case " + " ".join(f"when {_any_sql(w)} then '{s}'" for w, s in R.SECTION_WORDS) + " else 'Description' end as section from conversations where role = 'user'")
def question_section(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", R.question_section(F.col("text")).alias("section"))


_TYPES = ("information", "Causes", "treatment", "FAQ", "outlook", "stages", "Prevention")


@query(f"""
with t as (select event_id, (['{"', '".join(_TYPES)}'])[event_id % {len(_TYPES)} + 1] as question_type from events)
select event_id, question_type, case """ + " ".join("when lower(question_type) in (" + ", ".join(f"'{x}'" for x in t) + f") then '{s}'" for t, s in R.SENIOR_TYPES) + " end as section from t")
def question_type_map(spark, sf_dir):
    kinds = F.array(*(F.lit(t) for t in _TYPES))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(kinds, F.col("event_id") % len(_TYPES)).alias("question_type"))
    return rows.withColumn("section", R.senior_section(F.col("question_type")))


def _sited(url):
    for host, site in SITES:
        url = F.replace(url, F.lit(host), F.lit(site))
    return url


_SITED = "replace(replace(replace(url, 'example.com', 'cdc.gov'), 'example.org', 'niddk.nih.gov'), 'example.net', 'rarediseases.info.nih.gov')"


@query(f"""
with p as (select page_id, {_SITED} as url from pages), d as (select page_id, {_AUTHORITY} as domain, {_PATH} as path from p)
select page_id, domain, path,
    case when contains(domain, 'ghr.nlm.nih.gov') or contains(domain, 'cancer.gov') or contains(domain, 'nhlbi.nih.gov') then 'live'
        when contains(domain, 'nlm.nih.gov') and contains(path, 'medlineplus') and contains(path, 'natural') then 'wayback'
        when contains(domain, 'niddk.nih.gov') or contains(domain, 'ninds.nih.gov') then 'wayback'
        when contains(domain, 'rarediseases.info.nih.gov') then 'browser' when contains(domain, 'cdc.gov') then 'wayback' else 'live' end as fetch_mode,
    case when contains(domain, 'cdc.gov') then '20140101' end as archive_date,
    case when contains(domain, 'cdc.gov') then 'cdc.gov' when contains(domain, 'niddk.nih.gov') then 'niddk.nih.gov' end as bucket
from d""")
def route_fetch(spark, sf_dir):
    url = _sited(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", R.authority(url).alias("domain"), R.path(url).alias("path"))
    d, p = F.col("domain"), F.col("path")
    return rows.select("page_id", "domain", "path", R.fetch_mode(d, p).alias("fetch_mode"), R.archive_date(d, p).alias("archive_date"), R.bucket(d, ("cdc.gov", "niddk.nih.gov")).alias("bucket"))


def _status(spark, sf_dir):
    """Pages with a made-up source: some couldn't be read, some came from an archive."""
    source = F.when(F.col("page_id") % 5 == 0, F.lit(None)).when(F.col("page_id") % 3 == 0, F.lit("Wayback")).otherwise(F.lit("Live"))
    topics = F.floor((F.length("html") - F.length(F.replace("html", F.lit("<p>"), F.lit("")))) / 3)
    return table(spark, sf_dir, "pages").select("page_id", R.authority(F.col("url")).alias("domain"), "url", source.alias("source"), topics.alias("n_topics"), T.word_count(F.col("html")).alias("n_words"))


_STATUS = f"""
with s as (select page_id, {_AUTHORITY} as domain, url, case when page_id % 5 = 0 then null when page_id % 3 = 0 then 'Wayback' else 'Live' end as source,
    (length(html) - length(replace(html, '<p>', ''))) // 3 as n_topics, len({_WORDS.format("html")}) as n_words from pages),
c as (select domain, count(distinct url) as total_dataset_links, count(*) filter (where source = 'Live') as live, count(*) filter (where source = 'Wayback') as wayback, count(*) filter (where source is null) as skipped,
    count(source) as samples, sum(case when source is null then 0 else n_topics end) as topics, sum(case when source is null then 0 else n_words end) as words from s group by domain)
"""


@query(_STATUS + "select domain, total_dataset_links, live, wayback, skipped, samples, cast(topics as bigint) as topics, cast(words as bigint) as words from c")
def domain_counters(spark, sf_dir):
    return S.domain_counters(_status(spark, sf_dir))


@query(_STATUS + """, r as (select domain, sum(total_dataset_links) as total_dataset_links, sum(live) as live, sum(wayback) as wayback, sum(skipped) as skipped, sum(samples) as samples, sum(topics) as topics, sum(words) as words from c group by rollup (domain))
select domain, cast(total_dataset_links as bigint) as total_dataset_links, cast(samples as bigint) as samples, cast(topics as bigint) as topics, cast(words as bigint) as words,
    round_even(case when samples = 0 then 0.0 else topics::double / samples end, 1) as avg_topics, round_even(case when samples = 0 then 0.0 else words::double / samples end, 1) as avg_words from r""")
def domain_averages(spark, sf_dir):
    return S.averages(S.domain_counters(_status(spark, sf_dir))).select("domain", "total_dataset_links", "samples", "topics", "words", "avg_topics", "avg_words")


@query(_STATUS + """, f as (select domain, url, min(page_id) as pos from s where source is null group by domain, url),
r as (select *, row_number() over (partition by domain order by pos, url) as n from f)
select domain, string_agg(url, ' ' order by n) as urls from r where n <= 5 group by domain""")
def skipped_samples(spark, sf_dir):
    rows = _status(spark, sf_dir).where("source is null").withColumnRenamed("page_id", "pos")
    return S.first_urls(rows).select("domain", F.array_join("urls", " ").alias("urls"))


@query("select coalesce(lang, 'Unknown') as section, count(*) as n_chunks from documents group by all")
def section_counts(spark, sf_dir):
    return S.section_counts(table(spark, sf_dir, "documents"), "lang")


@query("select count(*) as n_rows, count(distinct source) as n_sources from documents")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_sources"))


@query("select source, lang, count(*) as n_docs, cast(sum(n_chars) as bigint) as chars, round(avg(n_chars), 6) as avg_chars from documents group by rollup (source, lang)")
def source_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query(f"select page_id, domain, url from (select page_id, {_AUTHORITY} as domain, url, row_number() over (partition by {_AUTHORITY} order by page_id) as n from pages) where n = 1")
def url_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", R.authority(F.col("url")).alias("domain"), "url")
    return S.first_rows(rows, "domain", "page_id")


@query("""
with c as (select doc_id, lang, text, case when lang is not distinct from lag(lang) over (order by doc_id) and lag(doc_id) over (order by doc_id) is not null then 0 else 1 end as c from documents)
select doc_id, lang, md5(coalesce(text, '')) as digest, cast(sum(c) over (order by doc_id rows unbounded preceding) as bigint) as island from c""")
def run_islands(spark, sf_dir):
    """Runs of a language in the order of ids, with the texts carried along."""
    rows = S.islands(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", "lang")
    return rows.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "island")


@query("""
with r as (select doc_id, source, n_chars, row_number() over (partition by source order by doc_id) as n from documents), u as (select *, row_number() over (partition by source order by doc_id) as m from r where n > 5 and n_chars >= 1000)
select doc_id, source, n_chars from u where m <= 2""")
def skip_take_per_domain(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return S.skip_take(rows, "source", "doc_id", F.col("n_chars") >= 1000)


@query(f"""
with r as (select {_AUTHORITY} as domain, split_part({_PATH}, '/', 2) as sub_path, page_id % 7 as focus, case when length(html) < 2000 then null else 'x' end as answer from pages),
c as (select domain, sub_path, count(*) as n_rows, count(*) - count(answer) as null_answers, count(distinct focus) as topics from r group by all)
select *, round(100.0::double * null_answers / n_rows, 2) as null_percent, round(n_rows::double / topics, 2) as rows_per_topic from c""")
def subpath_stats(spark, sf_dir):
    answer = F.when(F.length("html") >= 2000, F.lit("x"))
    return S.subpath_stats(table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 7).alias("focus"), answer.alias("answer")))


@query(f"""
with r as (select {_AUTHORITY} as domain, string_split({_PATH}, '/') as p, page_id % 7 as focus, case when length(html) < 2000 then null else 'x' end as answer from pages),
d as (select domain, array_to_string(p[2:case when contains(domain, 'example.com') then 3 when contains(domain, 'example.org') then 4 else 2 end], '/') as sub_path, focus, answer from r),
c as (select domain, sub_path, count(*) as n_rows, count(*) - count(answer) as null_answers, count(distinct focus) as topics from d group by all)
select *, round(100.0::double * null_answers / n_rows, 2) as null_percent, round(n_rows::double / topics, 2) as rows_per_topic from c""")
def deeper_subpaths(spark, sf_dir):
    answer = F.when(F.length("html") >= 2000, F.lit("x"))
    return S.subpath_stats(table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 7).alias("focus"), answer.alias("answer")), deeper={"example.com": 2, "example.org": 3})


@query("""
with e as (select user_id as job, max(ts) as last_run from events group by 1),
c as (select unnest(range(0, 400, 10)) as job), n as (select max(ts) as now from events)
select c.job::varchar as job, strftime(last_run, '%Y-%m-%d %H:%M:%S') as last_run from c left join e using (job), n where last_run is null or last_run + (1 + c.job % 7) * interval 1 hour <= n.now""")
def due_jobs(spark, sf_dir):
    """Users as jobs that an event runs, each with an interval of its own, due at the time of the last event."""
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    found = J.due(events.select(F.col("user_id").cast("string").alias("job"), "ts"), now, {str(u): 1 + u % 7 for u in range(0, 400, 10)})
    return found.select("job", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query("select source as focus, count(*) as n_questions from documents group by source order by n_questions desc, focus limit 10")
def top_topics(spark, sf_dir):
    return S.top_topics(table(spark, sf_dir, "documents").withColumnRenamed("source", "focus"), "focus", 10)


@query("select doc_id, source, lang, sample_rank from (select doc_id, source, lang, row_number() over (partition by source, lang order by doc_id) as sample_rank from documents) where sample_rank <= 3")
def samples_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return S.samples(rows, ["source", "lang"], "doc_id", 3).withColumn("sample_rank", F.col("sample_rank").cast("long"))


@query("""
with l as (select conv_id, role, max_by(text, turn) as t from conversations group by all)
select conv_id, count(*) as n_sections, count(*) >= 2 as is_complete, max(t) filter (where role = 'user') as user_text, max(t) filter (where role = 'assistant') as assistant_text from l group by conv_id""")
def section_pivot(spark, sf_dir):
    out = S.section_pivot(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", "turn", 2)
    return out.select("conv_id", "n_sections", "is_complete", F.try_element_at("sections", F.lit("user")).alias("user_text"), F.try_element_at("sections", F.lit("assistant")).alias("assistant_text"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def resume_anti_join(spark, sf_dir):
    return U.resume(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels)")
def processed_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("select d.source, l.quality, count(*) as n_docs, cast(sum(d.n_chars) as bigint) as chars from documents d join labels l on l.doc_id = d.doc_id group by all")
def qa_equi_join(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source", "quality").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return U.latest(rows, "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type", "value")


@query("""
with n as (select doc_id, 'label' as origin, quality as v from labels), o as (select doc_id, 'document' as origin, 9 as v from documents)
select doc_id, origin, v from n union all select doc_id, origin, v from o where doc_id not in (select doc_id from n)""")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("origin"), F.lit(9).alias("v"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin"), F.col("quality").cast("int").alias("v"))
    return U.upsert(old, new, "doc_id")


@query("""
with w as (select user_id, event_id, event_type, value, event_id % 3 as batch from events where event_id % 3 <> 2 or event_id % 2 = 0)
select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by batch desc, ts desc, event_id desc) as n from (select w.*, e.ts from w join events e using (event_id))) where n = 1""")
def keyed_table(spark, sf_dir):
    """Each user's last write of three saves, with several writes in each, a replay and a compaction between them."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts").where("event_id % 3 <> 2 or event_id % 2 = 0")
    kept = ST.Keyed(spark, scratch.path(spark, "keyed"), "user_id bigint, event_id bigint, event_type string, value double", "user_id")
    for n in (0, 1, 1, 2):
        kept.save(events.where(F.col("event_id") % 3 == n), n, ["ts", "event_id"])
        if n == 1:
            kept.compact(range(0, kept.buckets, 2))
    return kept.read()


@query("""
with c as (select page_id, url, y.year, (page_id * 31 + y.year * 17) % 5 as n_chunks from pages, (select unnest(range(2013, 2027)) as year) y)
select page_id, url, max(year) as year, cast(max(year) as varchar) || '0101' as archive_date, max_by(n_chunks, year) as n_chunks from c where n_chunks > 0 group by page_id, url""")
def snapshot_candidates(spark, sf_dir):
    tried = FE.rescue_candidates(table(spark, sf_dir, "pages").select("page_id", "url")).withColumn("n_chunks", (F.col("page_id") * 31 + F.col("year") * 17) % 5)
    out = FE.rescued(tried.withColumn("key", F.concat_ws("|", "page_id", "url")), "key")
    return out.select("page_id", "url", F.col("year").cast("long").alias("year"), "archive_date", "n_chunks")


@query("""
with c as (select page_id, url, y.year, (page_id * 31 + y.year * 17) % 7 - 3 as n_chunks from pages, (select unnest(range(2013, 2027)) as year) y),
r as (select page_id, max(year) filter (where n_chunks > 0) as year from c group by page_id)
select r.page_id, r.year, max_by(c.n_chunks, c.year) filter (where c.year = r.year) as n_chunks, count(*) filter (where c.year >= coalesce(r.year, 0)) as asked from r join c using (page_id) group by r.page_id, r.year""")
def rescue_waves(spark, sf_dir):
    """Each page's latest snapshot with chunks, and how many snapshots were asked for until it was found."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    made = lambda c: c.withColumn("n_chunks", (F.col("page_id") * 31 + F.col("year") * 17) % 7 - 3)
    _, asked = FE.rescue(pages, made, "page_id")
    good = F.when(F.col("n_chunks") > 0, F.struct(F.col("year").cast("long").alias("year"), "n_chunks"))
    out = asked.groupBy("page_id").agg(F.max(good).alias("b"), F.count("*").alias("asked"))
    return out.select("page_id", "b.year", "b.n_chunks", "asked")


@query("""
with s as (select d.source as node_id, count(*) as n_sources, count(l.doc_id) as n_alive from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id group by d.source)
select node_id, n_sources, n_alive, round(n_alive::double / n_sources, 6) as ratio, n_alive < n_sources as is_stale, n_alive = 0 as gone from s""")
def staleness_ratio(spark, sf_dir):
    nodes = table(spark, sf_dir, "documents").select(F.col("source").alias("node_id"), F.array("doc_id").alias("source_chunks"))
    out = EO.staleness(nodes, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("""
with n as (select doc_id % 97 as node_id, doc_id as chunk_id from documents),
a as (select doc_id as chunk_id from labels where quality = 1 or toxic = 1)
select node_id, count(*) as n_sources, count(a.chunk_id) as n_alive, round(count(a.chunk_id)::double / count(*), 6) as ratio, count(a.chunk_id) < count(*) as is_stale, count(a.chunk_id) = 0 as gone from n left join a using (chunk_id) group by node_id""")
def staleness_by_deltas(spark, sf_dir):
    """All labelled documents come in, then those that are neither good nor toxic go: counts follow the deltas."""
    nodes = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 97).alias("node_id")).agg(F.collect_list("doc_id").alias("source_chunks"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), ((F.col("quality") == 1) | (F.col("toxic") == 1)).alias("good"))
    index = FR.SourceIndex(spark, scratch.path(spark, "sources"), "long", "long", 16)
    index.apply(labels.select("chunk_id", F.lit(True).alias("alive")).distinct())
    index.add_nodes(nodes)
    index.apply(labels.where("not good").select("chunk_id", F.lit(False).alias("alive")).distinct())
    return index.staleness().withColumn("ratio", F.round("ratio", 6))


@query(f"""
with u as (select user_id as node_id, count(*) as hits, max(ts) as last_accessed from events group by user_id)
select node_id, hits, round(least(hits, 10) * exp(-floor((epoch(timestamp '{NOW}') - floor(epoch(last_accessed))) / 86400) / 7.0), 6) as decay_score,
    least(hits, 10) * exp(-floor((epoch(timestamp '{NOW}') - floor(epoch(last_accessed))) / 86400) / 7.0) < 0.05 as pruned from u""")
def decay_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    nodes = rows.groupBy(F.col("user_id").alias("node_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_accessed"), F.lit(0).alias("access_count"), F.max(F.col("ts").cast("timestamp")).alias("created_at"))
    clusters = rows.groupBy(F.col("user_id").alias("super_node_id")).agg(F.count("*").alias("hit_count"))
    out = EO.decayed(nodes, clusters, F.lit(NOW).cast("timestamp"))
    return out.select("node_id", "hits", F.round("decay_score", 6).alias("decay_score"), "pruned")


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"), (F.col("vec_id") * 37 % 101).alias("access_count"), F.lit(False).alias("in_hierarchy"))


@query("""
with t as (select vec_id, embedding::double[] as v from embeddings order by vec_id * 37 % 101 desc, vec_id limit 500)
select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as similarity from t a join t b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) > 0.3""")
def similar_pairs(spark, sf_dir):
    return EO.similar_pairs(_nodes(spark, sf_dir), 0.3).withColumn("similarity", F.round("similarity", 6))


_MERGED = """
with recursive t as (select vec_id, embedding::double[] as v from embeddings order by vec_id * 37 % 101 desc, vec_id limit 500),
p as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 12) as s from t a join t b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) > 0.3),
o as (select a, b, row_number() over (order by s desc, a, b) as n from p),
m as (
    select cast(0 as bigint) as n, cast([] as bigint[]) as used
    union all
    select x.n, list_concat(m.used, [o.a, o.b]) from m, lateral (select min(q.n) as n from o q where q.n > m.n and not list_contains(m.used, q.a) and not list_contains(m.used, q.b)) x join o on o.n = x.n
), taken as (select o.a, o.b from m join o on o.n = m.n)
"""


@query(_MERGED + "select 'mn_' || a || '_' || b as parent_id, unnest([a, b]) as child_id from taken")
def merge_plan(spark, sf_dir):
    return EO.merge_plan(EO.similar_pairs(_nodes(spark, sf_dir), 0.3))


@query(_MERGED + """
select 'mn_' || a || '_' || b as id, a::varchar || ' ' || b::varchar as children, cast(a * 37 % 101 + b * 37 % 101 as bigint) as access_count, a::varchar || chr(10) || chr(10) || b::varchar as text,
    round((x.embedding[1]::double + y.embedding[1]::double) / 2, 6) as first_value, 1 as depth
from taken join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b""")
def meta_nodes(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumns({"text": F.col("node_id").cast("string"), "vector": F.col("vector").cast("array<double>")})
    made = EO.meta_nodes(EO.merge_plan(EO.similar_pairs(nodes, 0.3)), nodes, F.lit(NOW).cast("timestamp"))
    return made.select("id", F.array_join(F.col("children").cast("array<string>"), " ").alias("children"), "access_count", "text", F.round(F.col("embedding")[0], 6).alias("first_value"), "depth")


@query("""
with c as (select label, p.i as pos, round(avg(embedding[p.i + 1]::double), 6) as value from embeddings, (select unnest(range(0, 64)) as i) p group by all)
select label, cast(pos as bigint) as pos, value from c""")
def centroids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector"))
    return EO.centroids(rows, "label").select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("""
with c as (select label, list(m order by i) as v from (select label, p.i, avg(embedding[p.i + 1]::double) as m from embeddings, (select unnest(range(0, 64)) as i) p group by label, p.i) group by label),
s as (select e.vec_id, c.label, round(list_cosine_similarity(e.embedding::double[], c.v), 9) as sim from embeddings e, c),
b as (select vec_id, max_by(label, (sim, -label)) as label, max(sim) as sim from s group by vec_id)
select vec_id as item_id, case when sim >= 0.4 then label end as cluster_id, round(sim, 6) as similarity from b""")
def cluster_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    means = EO.centroids(rows.select("label", F.col("embedding").alias("vector")), "label")
    cs = means.groupBy(F.col("label").alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("centroid"))
    out = EO.assign(rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), cs, 0.4)
    return out.withColumn("similarity", F.round("similarity", 6))


_RERANKED = _TOPK + """, h as (select query_id, item_id, d, item_id % 2 = 1 as super from r where rank <= 10),
k as (select * from h where super and not exists (select 1 from h p where p.query_id = h.query_id and p.super and p.item_id = h.item_id - 2 and p.item_id % 4 = 1)),
u as (select query_id, item_id, 'raw' as type, d as score from h where not super union all select query_id, item_id, 'super_node', case when query_id % 10 <> 0 or query_id % 100 = 0 then d * 0.85 else d end from k),
n as (select *, row_number() over (partition by query_id order by round(score, 9), item_id, type) as rank from u)
"""


@query(_RERANKED + "select query_id, item_id, type, round(score, 6) as score, cast(rank as bigint) as rank from n where rank <= 5")
def masked_rerank(spark, sf_dir):
    out = _reranked(*_asked(spark, sf_dir))
    return out.select("query_id", "item_id", "type", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _reranked(rows, asked):
    hits = RT.top_k(asked, rows, 10, item_id="vec_id", vector="embedding", skip_self=True).withColumn("distance", F.round("distance", 9))
    ids = rows.select(F.col("vec_id").alias("parent_id"), (F.col("vec_id") + 2).alias("child_id")).where("parent_id % 4 = 1")
    exploit = (F.col("query_id") % 10 != 0) | (F.col("query_id") % 100 == 0)
    return RT.preferential(hits.where("item_id % 2 = 0"), hits.where("item_id % 2 = 1"), ids, exploit, 5)


@query("select c_custkey as node_id, cast(c_custkey % 5 + coalesce(n, 0) as bigint) as access_count from customer left join (select user_id, count(*) as n from events group by user_id) on user_id = c_custkey")
def hit_counts(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), (F.col("c_custkey") % 5).alias("access_count"))
    return EO.access_counts(nodes, table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id")))


@query("select user_id as cluster_id, count(*) as hit_count from events group by user_id having count(*) >= 10 and user_id % 3 <> 0")
def ready_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cluster_id")).agg(F.count("*").alias("hit_count"))
    return EO.ready(rows.withColumns({"synthesized": F.col("cluster_id") % 3 == 0, "synthesizing": F.lit(None).cast("boolean")})).select("cluster_id", "hit_count")


@query("select event_type as cluster_id, count(*) as hit_count, max(ts)::timestamp as last_hit, string_agg(distinct user_id::varchar, ' ' order by user_id::varchar) as chunk_ids from events group by event_type")
def cluster_log(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("cluster_id"), "ts", F.array(F.col("user_id").cast("string")).alias("chunk_ids"))
    return EO.cluster_log(rows).withColumn("chunk_ids", F.array_join("chunk_ids", " "))


_FACTS = "list_distinct(regexp_extract_all(coalesce({0}, ''), '([0-9][0-9.,/-]*[0-9]|[0-9]|[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)', 1))"


@query(f"""
with t as (select conv_id, turn, role, {_FACTS.format("text")} as f from conversations),
c as (select u.conv_id, u.turn, case when len(u.f) = 0 then 1.0 else len(list_intersect(u.f, a.f)) / len(u.f)::double end as c from t u join t a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user')
select conv_id, turn, round(c, 6) as coverage_score, c >= 0.9 as passed from c""")
def fact_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    said = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("summary"))
    pairs = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source")).join(said, ["conv_id", "turn"])
    return G.judged(pairs).select("conv_id", "turn", F.round("coverage_score", 6).alias("coverage_score"), "passed")


@query("""
with p as (select conv_id, turn, chr(10) || '--- Source ' || cast(turn + 1 as varchar) || ' (' || role || ' - ' || 'conv/' || cast(conv_id as varchar) || ') ---' || chr(10) || coalesce(text, '') || chr(10) as p from conversations)
select conv_id as query_id, string_agg(p, '' order by turn, p) as context from p group by conv_id""")
def prompt_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("section"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("source_url"), "text")
    return G.context(rows)


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, cast(len(json_keys(props)) as bigint) as n_keys from events")
def json_props(spark, sf_dir):
    keys = F.json_object_keys("props")
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(props, F.get(keys, F.lit(0))).alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


#: Of character references, those that the given pages hold.
@query(r"""
with b as (select page_id, regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<main\b[^>]*>(.*)</main>', 1), ''), regexp_extract(html, '(?is)<body\b[^>]*>(.*)', 1)),
    '(?is)<!--.*?-->|<nav\b.*?</nav>|<footer\b.*?</footer>|<script\b.*?</script>|<style\b.*?</style>|<aside\b.*?</aside>|<header\b.*?</header>', '', 'g') as t from pages),
l as (select page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '(?i)</?(?:a|span|i|b|strong|em|u)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as w from b)
select page_id, list_reduce(list_prepend(array_to_string(w, chr(10)), [['&lt;', '<'], ['&gt;', '>'], ['&quot;', '"'], ['&#39;', ''''], ['&nbsp;', chr(160)], ['&copy;', chr(169)], ['&middot;', chr(183)], ['&eacute;', chr(233)], ['&amp;', '&'], ['&amp', '&']].list_transform(lambda p: p[1] || chr(1) || p[2])), lambda t, p: replace(t, split_part(p, chr(1), 1), split_part(p, chr(1), 2))) as text from l""")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.html_to_text(F.col("html")).alias("text"))


@query()
def parse_sections(spark, sf_dir):
    text = H.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(H.parse_sections(text)).alias("n", "s")).select("page_id", "s.pos", "s.section", "s.text")


@query()
def extract_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", X.extract(F.col("html"), R.authority(_sited(F.col("url")))).alias("x"))
    return rows.select("page_id", "x.status", F.explode_outer("x.sections").alias("s")).select("page_id", "status", "s.pos", "s.section", "s.text")


def _qa(spark, sf_dir):
    """Pages as Q&A rows of their sites."""
    pages = table(spark, sf_dir, "pages").where("page_id is not null")
    rows = pages.select(F.lpad(F.col("page_id").cast("string"), 7, "0").alias("document_id"), _sited(F.col("url")).alias("document_url"), F.concat(F.lit("topic "), (F.col("page_id") % 7).cast("string")).alias("question_focus"), F.lit("T047").alias("umls_semantic_group"), F.col("page_id").cast("string").alias("question_id"), F.lit("information").alias("question_type"), F.lit("What is it?").alias("question"), F.lit(None).cast("string").alias("answer"), F.col("page_id").alias("pos"))
    # The page of each url is chosen by short rows before its html is read.
    first = pages.groupBy(_sited(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))
    snapshots = pages.select("page_id", "html").join(first, "page_id").select("url", "html", F.lit("Live").alias("source"))
    return rows, snapshots


@query()
def ingest_chunks(spark, sf_dir):
    chunks, _ = I.ingest(*_qa(spark, sf_dir))
    return chunks.select("chunk_key", "chunk_id", "section", "token_count", F.size("embedding").alias("dim"))


@query()
def ingest_statistics(spark, sf_dir):
    return I.ingest(*_qa(spark, sf_dir))[1]


@query()
def grounded_answers(spark, sf_dir):
    chunks, _ = I.ingest(*_qa(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return I.answer(asked, chunks).select("query_id", "query", "answer", F.length("prompt").alias("prompt_chars"))


#: crc32 by bits, over the bytes of a word.
_WORD_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex(encode(word))) // 2), lambda i: cast('0x' || substr(hex(encode(word)), cast(2 * i + 1 as bigint), 2) as bigint))), lambda crc, d: list_reduce(list_prepend(xor(crc, d), [cast(0 as bigint) for z in range(8)]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"


@query(f"""
with w as (select doc_id, unnest({_WORDS.format("lower(text)")}) as word from documents),
h as (select word, {_WORD_CRC} as h from (select distinct word from w)),
v as (select doc_id, h % 64 as pos, sum(case when (h >> 16) & 1 = 1 then 1 else -1 end) as s from w join h using (word) group by all),
n as (select *, sqrt(sum(s * s) over (partition by doc_id)) as norm from v)
select doc_id, cast(pos as integer) as pos, round((s / norm)::float::double, 6) as value from n where s <> 0""")
def embed_documents(spark, sf_dir):
    """The components of each document's vector that aren't zero."""
    made = E.embed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), text="text")
    return made.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value != 0").select("doc_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


@query()
def text_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    said = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = rows.where("role = 'user'").select("conv_id", "turn", "text").join(said, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", EV.text_scores(F.col("answer"), F.col("text")).alias("s")).select("conv_id", "turn", F.round("s.bleu", 6).alias("bleu"), F.round("s.rouge_l", 6).alias("rouge_l"))


@query("""
with recursive e as (select label as job_id, vec_id as item_id, embedding::double[] as v, row_number() over (partition by label order by vec_id) as n from embeddings),
d as (select a.job_id, a.n as i, b.n as j, 1 - coalesce(list_cosine_similarity(a.v, b.v), 0) as far from e a join e b on a.job_id = b.job_id and a.n < b.n),
s as (
    select job_id, cast(0 as bigint) as step, list(n order by n) as labels from e group by job_id
    union all
    select job_id, step + 1, list_transform(labels, lambda x: case when x = hi then lo else x end)
    from (
        select *, row_number() over (partition by job_id order by a, lo, hi) as r
        from (
            select s.job_id, any_value(s.step) as step, any_value(s.labels) as labels, least(s.labels[d.i], s.labels[d.j]) as lo, greatest(s.labels[d.i], s.labels[d.j]) as hi, avg(d.far) as a
            from s join d on d.job_id = s.job_id where s.labels[d.i] <> s.labels[d.j] and len(s.labels) >= 6 group by s.job_id, lo, hi
        )
    ) where r = 1 and a <= 0.6
), l as (select job_id, max_by(labels, step) as labels from s group by job_id)
select e.job_id, e.item_id, cast(l.labels[e.n] - 1 as integer) as cluster, l.labels[e.n] = e.n as kept from e join l on l.job_id = e.job_id""")
def semantic_dedup(spark, sf_dir):
    # A job is a cluster of vectors that belong together, whatever their ids are.
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("job_id"), F.col("vec_id").alias("item_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return EO.semantic_dedup(rows, 0.6)


@query("""
with recursive e as (select label as shard, vec_id as item_id, embedding::double[] as v, row_number() over (partition by label order by vec_id) as n from embeddings),
s as (
    select distinct shard, cast(0 as bigint) as n, cast(null as bigint) as item_id, cast(null as bigint) as cluster, cast([] as double[][]) as sums, cast([] as bigint[]) as hits from e
    union all
    select shard, n, item_id, coalesce(k, len(sums) + 1) - 1,
        case when k is null then list_append(sums, v) else list_transform(sums, lambda c, i: case when i = k then list_transform(c, lambda x, j: (x * hits[k] + v[j]) / (hits[k] + 1)) else c end) end,
        case when k is null then list_append(hits, 1) else list_transform(hits, lambda h, i: case when i = k then h + 1 else h end) end
    from (
        select e.shard, e.n, e.item_id, e.v, s.sums, s.hits, list_transform(s.sums, lambda c: list_cosine_similarity(c, e.v)) as near,
            case when list_max(near) >= 0.35 then list_position(near, list_max(near)) end as k
        from s join e on e.shard = s.shard and e.n = s.n + 1
    )
)
select shard, item_id, cast(cluster as integer) as cluster from s where item_id is not null""")
def online_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("shard"), F.col("vec_id").alias("item_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return EO.online_clusters(rows, "shard", 0.35)


@query(_RERANKED + f""", a as (select 'baseline' as variant, query_id, item_id, rank, false as explored from r where rank <= 5
    union all select 'evolved', query_id, item_id, rank, not (query_id % 10 <> 0 or query_id % 100 = 0) from n where rank <= 5),
w as (select doc_id, len({_WORDS.format("text")}) as tokens from documents),
q as (select a.variant, a.query_id, min(a.rank) filter (where x.label = y.label) as first, coalesce(sum(w.tokens), 0) as tokens, bool_or(a.explored) as explored
    from a join embeddings x on x.vec_id = a.query_id join embeddings y on y.vec_id = a.item_id left join w on w.doc_id = a.item_id group by all)
select variant, count(*) as n, round(avg(case when first <= 5 then 1.0 else 0.0 end), 6) as recall_at_5, round(avg(tokens), 6) as avg_tokens, round(avg(case when explored then 1.0 else 0.0 end), 6) as exploration_rate from q group by variant""")
def system_comparison(spark, sf_dir):
    """Plain retrieval against re-ranking with super nodes, over the same questions; tokens are the words of what is retrieved."""
    rows, asked = _asked(spark, sf_dir)
    plain = RT.top_k(asked, rows, 5, item_id="vec_id", vector="embedding", skip_self=True).select("query_id", "item_id", "rank", F.lit("baseline").alias("variant"), F.lit(False).alias("explored"))
    exploit = (F.col("query_id") % 10 != 0) | (F.col("query_id") % 100 == 0)
    evolved = _reranked(rows, asked).select("query_id", "item_id", "rank", F.lit("evolved").alias("variant"), (~exploit).alias("explored"))
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.size(T.words(F.col("text"))).alias("tokens"))
    label = rows.select("vec_id", "label")
    known = plain.unionByName(evolved).join(label.withColumnsRenamed({"vec_id": "query_id", "label": "asked"}), "query_id").join(label.withColumnsRenamed({"vec_id": "item_id", "label": "found"}), "item_id").join(words, "item_id", "left")
    runs = known.groupBy("variant", "query_id").agg(F.min(F.when(F.col("asked") == F.col("found"), F.col("rank"))).alias("first"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.bool_or("explored").alias("explored"))
    out = EV.roll_up(runs)
    return out.select("variant", "n", *(F.round(c, 6).alias(c) for c in ("recall_at_5", "avg_tokens", "exploration_rate")))
