"""Windows over events and classical relational queries on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("select b - interval (30 * i) minute as start, count(*) as n, round(avg(value), 6) as mean from (select time_bucket(interval '30 minutes', ts) as b, value, unnest(range(0, 2)) as i from events) group by 1")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "60 minutes", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return e.select(F.col("w.start").alias("start"), "n", "mean")


@query("""with g as (select user_id, ts, event_id, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from g) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n, round(sum(value), 4) as total from s group by user_id, session""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


@query("select p.event_id, (select max_by(c.event_id, row(c.ts, c.event_id)) from events c where c.user_id = p.user_id and c.event_type = 'click' and c.ts <= p.ts) as last_click from events p where p.event_type = 'purchase'")
def events_asof(spark: SparkSession, d: str) -> DataFrame:
    """The last click before every purchase: one ordered window, no join of all pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") != "click").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").where("event_type in ('click', 'purchase')")
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_click", last).where("event_type = 'purchase'").select("event_id", "last_click")


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def q1_pricing(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1995-03-15' and l_shipdate > timestamp '1995-03-15' group by 1, 3 order by revenue desc, o_orderkey limit 10")
def q3_shipping(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").where("o_orderdate < timestamp '1995-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").where("l_shipdate > timestamp '1995-03-15'").select("l_orderkey", "l_extendedprice", "l_discount")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    r = j.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return r.orderBy(F.desc("revenue"), "o_orderkey").limit(10).select("o_orderkey", "revenue", "o_orderdate")


@query("select n_name, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by rollup (n_name, o_orderpriority)")
def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
