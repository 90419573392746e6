"""Document status, incremental ingestion and record stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import merging as M
from ..registry import query, table

STATUS_SQL = "st as (select doc_id, source, case when text is null then 'FAILED' when trim(text) = '' then 'PENDING' when doc_id % 7 = 0 then 'PROCESSING' else 'PROCESSED' end as status, ingested_at from documents)"


def _status(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("text").isNull(), "FAILED").when(F.trim("text") == "", "PENDING").when(F.col("doc_id") % 7 == 0, "PROCESSING").otherwise("PROCESSED")
    return table(spark, d, "documents").select("doc_id", "source", state.alias("status"), "ingested_at")


@query(f"with {STATUS_SQL} select status, count(*) as n from st group by 1")
def document_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {STATUS_SQL} select doc_id, status, page from (select *, ((row_number() over (order by ingested_at desc, doc_id) - 1) // 20)::int as page from st where status = 'PROCESSED') where page = 1")
def status_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty, the latest first."""
    return _status(spark, d).where("status = 'PROCESSED'").orderBy(F.desc("ingested_at"), "doc_id").offset(20).limit(20).select("doc_id", "status", F.lit(1).alias("page"))


@query("""with o as (select doc_id, lang, field from documents where publication_year < 2010 or publication_year is null), n as (select doc_id, null::varchar as lang, upper(field) as field from documents where publication_year >= 2005)
select coalesce(o.doc_id, n.doc_id) as doc_id, coalesce(n.lang, o.lang) as lang, coalesce(n.field, o.field) as field from o full join n using (doc_id)""")
def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.where("publication_year < 2010 or publication_year is null").select("doc_id", "lang", "field")
    new = docs.where("publication_year >= 2005").select("doc_id", F.lit(None).cast("string").alias("lang"), F.upper("field").alias("field"))
    return M.upsert(old, new, "doc_id")


@query("select distinct md5(text) as hash from documents where text is not null and trim(text) <> '' and md5(text) not in (select md5(text) from documents where text_source = 'abstract' and text is not null)")
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    """Texts by content that the store (here, of the abstracts) does not hold yet."""
    docs = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("hash"), "text", "text_source")
    stored = docs.where("text_source = 'abstract'").select("hash")
    return docs.where("trim(text) <> ''").select("hash").distinct().join(stored, "hash", "left_anti")


@query("with r as (select vec_id, any_value(id) as id, any_value(engine) as engine, any_value(metadata) as metadata from vector_records group by 1) select vec_id, id, coalesce(map_extract(metadata, 'doc_id')[1], 'none') as doc_id, coalesce(map_extract(metadata, 'model')[1], 'none') as model from r")
def vector_metadata(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "vector_records").groupBy("vec_id").agg(F.first("id").alias("id"), F.first("metadata").alias("metadata"))
    at = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("none")).alias(k)
    return r.select("vec_id", "id", at("doc_id"), at("model"))


@query("with r as (select vec_id, any_value(coalesce(embedding, vector)) as v, any_value(engine) as engine from vector_records group by 1) select engine, count(*) as n, count(*) filter (v is null) as missing, count(*) filter (v is not null and len(v) <> 64) as wrong_size, count(*) filter (len(v) = 64 and len(list_filter(v, lambda x: not isfinite(x))) > 0) as not_finite from r group by 1")
def vector_consistency(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "vector_records").groupBy("vec_id").agg(F.first(F.coalesce("embedding", "vector"), ignorenulls=True).alias("v"), F.first("engine").alias("engine"))
    v = F.col("v")
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return r.groupBy("engine").agg(
        F.count("*").alias("n"), F.count(F.when(v.isNull(), 1)).alias("missing"), F.count(F.when(F.size(v) != 64, 1)).alias("wrong_size"),
        F.count(F.when((F.size(v) == 64) & bad, 1)).alias("not_finite"),
    )


@query("with m as (select mention_id, min(lower(trim(name))) as name, min(chunk_id) as source from extracted_entities where trim(name) <> '' group by 1), f as (select name, count(distinct source) as refs, min(source) as only_source from m where source is not null group by 1) select name, refs, case when refs = 1 then only_source end as deletable_with from f")
def procedural_references(spark: SparkSession, d: str) -> DataFrame:
    """How many passages a name stands in, and the passage with which it may go."""
    m = table(spark, d, "extracted_entities").where("trim(name) <> ''").groupBy("mention_id").agg(F.min(F.lower(F.trim("name"))).alias("name"), F.min("chunk_id").alias("source"))
    f = m.where("source is not null").select("name", "source").distinct().groupBy("name").agg(F.count("*").alias("refs"), F.min("source").alias("s"))
    return f.select("name", "refs", F.when(F.col("refs") == 1, F.col("s")).alias("deletable_with"))


@query("""with l as (select doc_id as k, md5(text) as h, 0 as side from documents where text_source = 'full' and text is not null), g as (select doc_id as k, md5(text) as h, 1 as side from documents where text_source = 'abstract' and text is not null),
u as (select * from l union all select * from g) select h, k, side from (select *, row_number() over (partition by h order by side, k) as r from u) where r = 1""")
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    """Two lists in order; of equal texts the first stays."""
    docs = table(spark, d, "documents").where("text is not null and text_source in ('full', 'abstract')")
    u = docs.select(F.md5("text").alias("h"), F.col("doc_id").alias("k"), F.when(F.col("text_source") == "full", 0).otherwise(1).alias("side"))
    return M.keep_best(u, ["h"], [F.col("side"), F.col("k")]).select("h", "k", "side")


@query("select doc_id, lag(doc_id) over (partition by source order by ingested_at, doc_id) as before, row_number() over (partition by source order by ingested_at, doc_id)::int as turn from documents")
def arrival_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("ingested_at", "doc_id")
    return table(spark, d, "documents").select("doc_id", F.lag("doc_id").over(w).alias("before"), F.row_number().over(w).alias("turn"))
