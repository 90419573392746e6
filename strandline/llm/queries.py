"""Queries over the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from .proportions import proportion_sample

    targets = _read(spark, d, "sampling_targets")
    samples, reports = [], []
    for dataset, dims in (("example_meta", ["overlap_bucket", "hop_count"]), ("causal_rows", ["category"])):
        sample, report = proportion_sample(_read(spark, d, dataset), targets.where(F.col("dataset") == dataset), dims)
        cell = F.concat_ws(" / ", *dims).alias("cell")
        samples.append(sample.select("target_set", F.lit(dataset).alias("dataset"), "id", cell))
        reports.append(report.select("target_id", "target_set", F.lit(dataset).alias("dataset"), cell, "target_permille", "min_rows", "wanted", "available", "sampled", "gap"))
    return samples[0].unionByName(samples[1]), reports[0].unionByName(reports[1])


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].where("gap > 0").select("target_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "vector_records")
    return rows.select(F.col("vec_id").alias("id"), F.coalesce("embedding", "vector").alias("v"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from .neighbours import most_similar

    return most_similar(_vectors(spark, d)).withColumn("similarity", F.round("similarity", 9))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .neighbours import most_similar

    pairs = most_similar(_vectors(spark, d)).select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b"))
    return pairs.distinct()


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    a = _read(spark, d, "llm_entities").select(F.col("entity_name").alias("name"), F.col("entity_type").alias("type"))
    return a.unionByName(_read(spark, d, "extracted_entities").select("name", "type"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    from .names import variants

    """Every spelling with its entity and the number of the entity's spellings."""
    members = variants(_mentions(spark, d))
    return members.join(members.groupBy("entity").agg(F.count("*").alias("spellings")), "entity").select("name", "entity", "spellings")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .names import variant_pairs, variants

    return variant_pairs(variants(_mentions(spark, d)))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """A row ``over`` each day (null: answers without a time) and one over all days; the sketches of days can be combined with ``quantiles.merged``."""
    from ..session import checkpointed
    from . import quantiles as Q

    metrics = ["query_latency_ms", "index_latency_ms"]
    rows = _read(spark, d, "per_question_metrics").select("result_id", "condition", F.to_date("finished_at").alias("day"), *metrics)
    rows = rows.dropDuplicates(["result_id"]).drop("result_id")
    days = checkpointed(Q.sketches(rows, ["condition", "day"], metrics))  # used for days and totals
    ps = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    by_day = Q.percentiles(days, ps).withColumn("over", F.lit("day"))
    over_all = Q.percentiles(Q.merged(days, ["condition", "metric"]), ps).withColumns({"day": F.lit(None).cast("date"), "over": F.lit("all days")})
    out = by_day.unionByName(over_all).withColumn("error_of_ranks_above", F.lit(Q.ERROR))
    return out.select("condition", "over", "day", "metric", "n", *ps, "error_of_ranks_above", "sketch")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    from .packing import packed

    return packed(_read(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size")), 4_096)


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """What the packing has divided: documents that stand in more than one container."""
    containers = _packed(spark, d).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return containers.where("a <> b").select("doc_id")


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cache = _read(spark, d, "llm_cache").select(F.lit("llm_cache").alias("origin"), F.col("args_hash").alias("pair_key"), F.col("prompt").alias("question"), "content")
    samples = _read(spark, d, "experiment_samples")
    asked = samples.groupBy(F.col("id").alias("sample_id")).agg(F.min("question").alias("question"))
    answers = (
        _read(spark, d, "per_question_metrics")
        .select("sample_id", F.lit("per_question_metrics").alias("origin"), F.col("result_id").cast("string").alias("pair_key"), F.col("prediction").alias("content"))
        .join(asked, "sample_id")
        .select("origin", "pair_key", "question", "content")
    )
    contents = cache.select("content").unionByName(_read(spark, d, "per_question_metrics").select(F.col("prediction").alias("content")))
    return cache.unionByName(answers), samples, contents


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    from .pairs import defects

    return defects(*_pairs(spark, d)).select("origin", "pair_key", "defect", F.round("posterior", 3).alias("posterior"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .pairs import defects, one_defect

    return one_defect(defects(*_pairs(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .leaks import leaks

    return leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from .sentences import sentence_units

    return sentence_units(_read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_VALID = "(select vec_id, any_value(coalesce(embedding, vector)) as v from vector_records group by 1)"
SQL = {
    "p1_found": """with e as (select lower(trim(overlap_bucket)) as a, hop_count::varchar as b, count(distinct id) as n from example_meta group by 1, 2),
c as (select lower(trim(category)) as a, count(distinct id) as n from causal_rows group by 1),
t as (select target_id, greatest(min_rows, ceil(target_permille * sample_size / 1000.0)) as wanted, coalesce(e.n, c.n, 0) as n from sampling_targets s
left join e on s.dataset = 'example_meta' and e.a = lower(trim(s.overlap_bucket)) and e.b = s.hop_count::varchar left join c on s.dataset = 'causal_rows' and c.a = lower(trim(s.category)))
select target_id from t where n < wanted""",
    "p2_found": f"""with r as (select vec_id, v from {_VALID} where len(v) = 64), g as (select * from r where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
s as (select a.vec_id as a, b.vec_id as b, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.v, b.v) desc, b.vec_id) as k from g a join g b on a.vec_id <> b.vec_id)
select distinct least(a, b) as vec_a, greatest(a, b) as vec_b from s where k <= 5""",
    "p6_found": "select doc_id from documents where strlen(text) > 4096",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
