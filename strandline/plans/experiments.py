"""Summaries of the experiment results and samples drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import experiments as X
from ..registry import query, table
from .texts import EXPERIMENT_NORM

R_SQL = "r as (select distinct on (result_id) * from per_question_metrics order by result_id, ingested_at)"
OK = "coalesce(trim(error), '') = ''"


def _fin(c: str) -> str:
    return f"case when isfinite({c}) then {c} end"


def _mean(c: str, where: str = "true") -> str:
    return f"coalesce(avg({_fin(c)}) filter ({OK} and {where}), 0.0)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Each result once; repeated rows differ in their time of arrival only."""
    return table(spark, d, "per_question_metrics").drop("ingested_at").dropDuplicates(["result_id"])


def _summary_sql(by: str) -> str:
    cells = ["count(*) as samples", f"count(*) filter (not ({OK})) as errors", *[f"round({_mean(c)}, 10) as {c}_avg" for c in X.MEANS]]
    for c in X.LATENCIES:
        x = f"case when {OK} and isfinite({c}) and {c} >= 0 then {c} end"
        cells += [f"round(avg({x}), 9) as {c}_avg", f"round(quantile_cont({x}, 0.5), 9) as {c}_p50", f"round(quantile_cont({x}, 0.95), 9) as {c}_p95"]
    return f"with {R_SQL} select {by}, {', '.join(cells)} from r group by {by}"


@query(_summary_sql("condition"))
def condition_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.summary(_results(spark, d), ["condition"])


@query(_summary_sql("condition, category"))
def condition_category_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.summary(_results(spark, d), ["condition", "category"])


@query(f"with {R_SQL} select condition, round({_mean('f1', 'label_true')}, 6) as f1_true, round({_mean('f1', 'not label_true')}, 6) as f1_false, count(*) filter (label_true) as labelled_true, count(*) filter (not label_true) as labelled_false from r group by 1")
def label_aware_summary(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("label_true")
    cells = [F.round(X.mean("f1", t), 6).alias("f1_true"), F.round(X.mean("f1", ~t), 6).alias("f1_false"), F.count(F.when(t, 1)).alias("labelled_true"), F.count(F.when(~t, 1)).alias("labelled_false")]
    return _results(spark, d).groupBy("condition").agg(*cells)


@query(f"with {R_SQL}, m as (select condition, category, {_mean('f1')} as m from r group by 1, 2) select condition, round(avg(m), 6) as f1_macro, count(*) as categories from m group by 1")
def category_macro(spark: SparkSession, d: str) -> DataFrame:
    return X.macro(_results(spark, d), ["condition"], "category", "f1")


@query(f"""with {R_SQL}, p as (select condition, not label_true as label_unknown, coalesce(regexp_matches({EXPERIMENT_NORM.format(x='prediction')}, '{T.UNKNOWN_PATTERN}'), false) as predicted from r),
n as (select condition, count(*) filter (predicted and label_unknown) as tp, count(*) filter (predicted and not label_unknown) as fp, count(*) filter (not predicted and label_unknown) as fn from p where label_unknown is not null group by 1)
select condition, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0.0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1 from n""")
def unknown_detection(spark: SparkSession, d: str) -> DataFrame:
    said = F.coalesce(T.is_unknown(F.col("prediction")), F.lit(False))
    return X.unknown_detection(_results(spark, d).select("condition", (~F.col("label_true")).alias("label_unknown"), said.alias("predicted")), ["condition"])


@query(f"""with {R_SQL}, a as (select sample_id, avg({_fin('f1')}) as f1, avg({_fin('recall')}) as recall from r where condition = 'graph_basic' and {OK} group by 1), b as (select sample_id, avg({_fin('f1')}) as f1, avg({_fin('recall')}) as recall from r where condition = 'graph_local' and {OK} group by 1),
j as (select a.sample_id as l, b.sample_id as rr, abs(a.f1 - b.f1) as d1, abs(a.recall - b.recall) as d2 from a full join b using (sample_id)), u as (select 'f1' as metric, l, rr, d1 as d from j union all select 'recall', l, rr, d2 from j)
select metric, count(*) filter (rr is null) as only_left, count(*) filter (l is null) as only_right, round(avg(d), 6) as mean_diff, round(max(d), 6) as max_diff from u group by 1""")
def parity_report(spark: SparkSession, d: str) -> DataFrame:
    """Two conditions compared over the samples."""
    r = _results(spark, d).where(X.ok())
    side = lambda c: r.where(F.col("condition") == c).groupBy("sample_id").agg(F.avg(X.finite("f1")).alias("f1"), F.avg(X.finite("recall")).alias("recall"))
    return X.parity(side("graph_basic"), side("graph_local"), ["sample_id"], ["f1", "recall"])


@query("with m as (select id, any_value(lexical_overlap_score) as x from example_meta group by id), q as (select quantile_cont(x, 1.0 / 3) as a, quantile_cont(x, 2.0 / 3) as b from m) select id, case when x <= a then 'low' when x <= b then 'mid' when x is not null then 'high' end as bucket from m, q")
def overlap_tertiles(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "example_meta").groupBy("id").agg(F.first("lexical_overlap_score", ignorenulls=True).alias("x"))
    return X.tertiles(m, "x").select("id", "bucket")


@query("""with m as (select id, any_value(lower(trim(category))) as category from causal_rows where category is not null group by id), s as (select *, row_number() over (partition by category order by md5('5|' || id), id) as place, count(*) over (partition by category) as n from m),
c as (select n, category, place::int as place, id from s) select category, id, place from c where place <= 5""")
def balanced_subset(spark: SparkSession, d: str) -> DataFrame:
    """Five of every category, in the order of a hash."""
    m = table(spark, d, "causal_rows").where("category is not null").groupBy("id").agg(F.first(F.lower(F.trim("category"))).alias("category"))
    w = Window.partitionBy("category").orderBy(F.md5(F.concat(F.lit("5|"), F.col("id"))), "id")
    return m.withColumn("place", F.row_number().over(w)).where("place <= 5").select("category", "id", "place")


@query("""with n as (select field, count(*) as n from documents group by 1), t as (select doc_id, field, row_number() over (partition by field order by publication_year desc nulls last, doc_id) as turn from documents)
select doc_id, turn::int as turn from t join n on t.field is not distinct from n.field where t.field is not null order by turn, n desc, t.field limit 40""")
def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("field is not null")
    return X.round_robin(docs, "field", [F.col("publication_year").desc_nulls_last(), F.col("doc_id")], 40).select("doc_id", "turn")


@query("select source, lang, count(*) as n, count(*) filter (text is null or trim(text) = '') as blank, sum(n_chars)::bigint as chars, grouping(source, lang)::int as level from documents group by grouping sets ((source, lang), (source), ())")
def scan_statistics(spark: SparkSession, d: str) -> DataFrame:
    blank = F.count(F.when(F.col("text").isNull() | (F.trim("text") == ""), 1))
    docs = table(spark, d, "documents")
    return docs.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("n"), blank.alias("blank"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("level"))


@query(f"with {R_SQL}, m as (select run_id, condition, {_mean('f1')} as m from r group by 1, 2), k as (select *, rank() over (partition by run_id order by round(m, 9) desc) as k from m) select condition, round(avg(m), 6) as mean, round(stddev_pop(m), 6) as spread, round(min(m), 6) as worst, round(avg(k), 6) as mean_rank, round(case when avg(m) <> 0 then stddev_pop(m) / avg(m) end, 6) as variation from k group by 1")
def stability(spark: SparkSession, d: str) -> DataFrame:
    m = _results(spark, d).groupBy("run_id", "condition").agg(X.mean("f1").alias("m"))
    k = m.withColumn("k", F.rank().over(Window.partitionBy("run_id").orderBy(F.round("m", 9).desc())))
    spread = F.stddev_pop("m")
    return k.groupBy("condition").agg(
        F.round(F.avg("m"), 6).alias("mean"), F.round(spread, 6).alias("spread"), F.round(F.min("m"), 6).alias("worst"), F.round(F.avg("k"), 6).alias("mean_rank"),
        F.round(F.try_divide(spread, F.avg("m")), 6).alias("variation"),
    )


@query(f"with {R_SQL} select sample_id, arg_min(prediction, row(-n, prediction)) as rating, max(n) as votes from (select sample_id, lower(trim(prediction)) as prediction, count(*) as n from r where prediction is not null group by 1, 2) group by 1")
def rating_mode(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent answer over repeats, of equals the first in order."""
    n = _results(spark, d).where("prediction is not null").groupBy("sample_id", F.lower(F.trim("prediction")).alias("p")).agg(F.count("*").alias("n"))
    return n.groupBy("sample_id").agg(F.min_by("p", F.struct(-F.col("n"), F.col("p"))).alias("rating"), F.max("n").alias("votes"))


@query("""with s as (select id, any_value(question_decomposition) as q from experiment_samples group by id), m as (select id, any_value(hop_count) as h from example_meta group by id)
select s.id, coalesce(case when len(q) > 0 then len(q)::int end, m.h, try_cast(nullif(regexp_extract(s.id, '^([2-9])hop', 1), '') as int)) as hops from s left join m using (id)""")
def hop_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "experiment_samples").groupBy("id").agg(F.first("question_decomposition").alias("q"))
    m = table(spark, d, "example_meta").groupBy("id").agg(F.first("hop_count", ignorenulls=True).alias("h"))
    named = F.regexp_extract("id", "^([2-9])hop", 1).try_cast("int")
    return s.join(m, "id", "left").select("id", F.coalesce(F.when(F.size("q") > 0, F.size("q")), "h", named).alias("hops"))


@query(f"with {R_SQL} select condition, run_id, count(*) as calls, sum(length(prediction))::bigint as characters from r group by 1, 2")
def call_accounting(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy("condition", "run_id").agg(F.count("*").alias("calls"), F.sum(F.length("prediction")).alias("characters"))


