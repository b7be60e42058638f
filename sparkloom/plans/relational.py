"""Relational and streaming queries over the star schema and the event stream, each beside its SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans.corpus import table
from sparkloom.streaming import jobs as J

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as orders
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name""")
def revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("select coalesce(c.c_nationkey, s.s_nationkey) as nation, count(distinct c_custkey) as customers, count(distinct s_suppkey) as suppliers from (select * from customer where c_acctbal > 0) c full join (select * from supplier where s_acctbal > 5000) s on c.c_nationkey = s.s_nationkey group by all")
def full_outer_counts(spark, sf_dir):
    # Both sides are counted by nation before they meet.
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count_distinct("c_custkey").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)")
def order_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
select p_partkey, p_brand, p_retailprice, cast(rank() over w as bigint) as price_rank, cast(dense_rank() over w as bigint) as dense, cast(ntile(4) over (partition by p_brand order by p_retailprice desc, p_partkey) as bigint) as quartile,
    lag(p_retailprice) over (partition by p_brand order by p_retailprice desc, p_partkey) as before from part window w as (partition by p_brand order by p_retailprice desc)""")
def part_ranks(spark, sf_dir):
    w = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    u = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", F.rank().over(w).cast("long").alias("price_rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(u).cast("long").alias("quartile"), F.lag("p_retailprice").over(u).alias("before"))


@query("select k, side from (select o_custkey as k, 'buyer' as side from orders intersect select c_custkey, 'buyer' from customer) union all (select c_custkey, 'idle' from customer except select o_custkey, 'idle' from orders)")
def buyers_and_idle(spark, sf_dir):
    buys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    all_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return buys.intersect(all_).withColumn("side", F.lit("buyer")).unionAll(all_.exceptAll(buys.distinct()).distinct().withColumn("side", F.lit("idle")))


@query("select event_id, user_id, value, round(sum(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6) as moving from events")
def moving_sums(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.round(F.sum("value").over(w), 6).alias("moving"))


_DAYS = "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"


@query(_DAYS)
def daily_event_windows(spark, sf_dir):
    rows = J.windowed(table(spark, sf_dir, "events"), ["event_type"], "1 day")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts range unbounded preceding) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from s group by user_id, k""")
def user_sessions(spark, sf_dir):
    out = J.sessions(table(spark, sf_dir, "events").select("ts", "user_id"), "user_id", "30 minutes")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def _scratch(spark, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        import uuid

        return f"{base.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"stream-{name}-")


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return J.source(spark, sf_dir, schema, "events.parquet")


@query(_DAYS)
def stream_daily_windows(spark, sf_dir):
    where = _scratch(spark, "days")
    out = J.complete_to_table(J.windowed(_events(spark, sf_dir), ["event_type"], "1 day"), where + "/checkpoint", where + "/table")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select distinct user_id from events")
def stream_dedupe(spark, sf_dir):
    where = _scratch(spark, "dedupe")
    return J.to_table(J.deduplicated(_events(spark, sf_dir).select("user_id"), "user_id"), where + "/checkpoint", where + "/table")
