"""Queries over entities, relations, communities and claims, and heuristic judgements of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import judgements as J
from ..operators import graph as G
from ..operators import merging as M
from ..operators.chunking import sentences
from ..registry import query, table
from .evaluation import CONTEXTS_SQL, _cov, _ct, _samples
from .graphs import CAUSAL_SQL, MENTIONS_SQL, SEED, _causal, _lpa_sql, _mentions

CONTEXTS = lambda: F.transform("paragraphs", lambda x: x["paragraph_text"])


@query(f"with {MENTIONS_SQL}, g as (select name, array_to_string(list_sort(list_distinct(list(source))), '<SEP>') as sources from u where source is not null group by 1), x as (select name, unnest(string_split(sources, '<SEP>')) as chunk from g), v as (select id, min(vec_id) as vec_id from vector_records group by 1) select name, chunk, vec_id from x left join v on v.id = x.chunk")
def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The passages in an entity's joined source ids."""
    g = _mentions(spark, d).where("source is not null").groupBy("name").agg(M.distinct_joined(F.col("source")).alias("sources"))
    x = g.select("name", F.explode(F.split("sources", M.SEPARATOR)).alias("chunk"))
    v = table(spark, d, "vector_records").groupBy(F.col("id").alias("chunk")).agg(F.min("vec_id").alias("vec_id"))
    return x.join(v, "chunk", "left").select("name", "chunk", "vec_id")


@query(f"with {MENTIONS_SQL}, {CAUSAL_SQL}, r as (select name as src, 'has_attribute' as kind, type as dst from u where type is not null union select name, 'mentioned_in', source from u where source is not null union select src, 'causes', dst from e) select src, kind, dst from r")
def relationship_emission(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    of = lambda kind, dst: m.where(F.col(dst).isNotNull()).select(F.col("name").alias("src"), F.lit(kind).alias("kind"), F.col(dst).alias("dst"))
    return of("has_attribute", "type").unionByName(of("mentioned_in", "source")).unionByName(_causal(spark, d).select("src", F.lit("causes").alias("kind"), "dst")).distinct()


COMMUNITY_SQL = _lpa_sql(4).replace(" select node, label as community from l4", ", c as (select node, label as community from l4)")


@query(f"{COMMUNITY_SQL}, s as (select community, count(*) as members from c group by 1), i as (select a.community, count(*) as inner_edges from e join c a on a.node = src join c b on b.node = dst where a.community = b.community group by 1) select s.community, members, coalesce(inner_edges, 0) as inner_edges, row_number() over (order by members desc, s.community)::int as place from s left join i using (community)")
def community_table(spark: SparkSession, d: str) -> DataFrame:
    e = _causal(spark, d)
    c = G.checkpointed(G.label_propagation(e, 4))
    size = c.groupBy("community").agg(F.count("*").alias("members"))
    inner = e.join(c.toDF("src", "community"), "src").join(c.toDF("dst", "other"), "dst").where("community = other").groupBy("community").agg(F.count("*").alias("inner_edges"))
    rows = size.join(inner, "community", "left").select("community", "members", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"))
    return M.numbered(rows, [F.desc("members"), F.col("community")])


@query(f"{COMMUNITY_SQL}, dg as (select node, count(*) as k from (select src as node from e union all select dst from e) group by 1) select community, node, place from (select community, c.node, row_number() over (partition by community order by k desc, c.node)::int as place from c join dg using (node)) where place <= 5")
def community_representatives(spark: SparkSession, d: str) -> DataFrame:
    e = _causal(spark, d)
    dg = G.degrees(e).select("node", (F.col("indegree") + F.col("outdegree")).alias("k"))
    c = G.label_propagation(e, 4).join(dg, "node")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("k"), "node"))).where("place <= 5").select("community", "node", "place")


@query("with c as (select id, min(lower(trim(e1))) as cause, min(lower(trim(e2))) as effect, bool_or(label_true) as label from causal_rows group by id) select id, cause, effect, case when label then 'supported' when not label then 'refuted' else 'open' end as status from c where cause in ('road salt', 'poor sleep') or effect in ('road salt', 'poor sleep')")
def claims_of_entities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "causal_rows").groupBy("id").agg(F.min(F.lower(F.trim("e1"))).alias("cause"), F.min(F.lower(F.trim("e2"))).alias("effect"), F.bool_or("label_true").alias("label"))
    chosen = ("road salt", "poor sleep")
    status = F.when(F.col("label"), "supported").when(~F.col("label"), "refuted").otherwise("open")
    return c.where(F.col("cause").isin(*chosen) | F.col("effect").isin(*chosen)).select("id", "cause", "effect", status.alias("status"))


@query(f"with {MENTIONS_SQL}, n as (select name, count(*) as n from u group by 1), o as (select name, row_number() over (order by n desc, name) as ord from n), x as (select u.source as chunk, min(ord)::int as first, count(distinct u.name) as names from u join o using (name) where u.source is not null group by 1) select chunk, first, names from x")
def passages_of_entities(spark: SparkSession, d: str) -> DataFrame:
    """Passages by the rank of their most mentioned entity and by how many they name."""
    m = _mentions(spark, d)
    n = m.groupBy("name").agg(F.count("*").alias("n"))
    # ranks without one window over all names: ranks of counts, then of names within a count
    sizes = n.groupBy("n").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    o = n.join(sizes, "n").select("name", (F.col("before") + F.row_number().over(Window.partitionBy("n").orderBy("name"))).alias("ord"))
    x = m.where("source is not null").join(o, "name")
    return x.groupBy(F.col("source").alias("chunk")).agg(F.min("ord").cast("int").alias("first"), F.countDistinct("name").alias("names"))


@query("with s as (select doc_id, coalesce(n_chars, 0) + 1 as w, ('0x' || substr(md5('7|' || doc_id::varchar), 1, 8))::bigint / 4294967296.0 as u from documents) select doc_id, place from (select doc_id, row_number() over (order by round(ln(u + 1e-12) / w, 12) desc, doc_id)::int as place from s) where place <= 25")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """Without replacement, by keys ln(u) / w; 25 rows are the sample's size."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    s = table(spark, d, "documents").select("doc_id", F.round(F.log(u + 1e-12) / (F.coalesce("n_chars", F.lit(0)) + 1), 12).alias("key"))
    best = s.orderBy(F.desc("key"), "doc_id").limit(25)
    return best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("key"), "doc_id")).alias("place"))


@query(f"with recursive {CAUSAL_SQL}, w as (select node, 0 as depth from ({SEED}) union select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 2), n as (select node, min(depth) as depth from w group by 1), k as (select node, depth, row_number() over (order by depth, node) as r from n) select src, dst, weight from e where src in (select node from k where r <= 12) and dst in (select node from k where r <= 12)")
def bounded_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """At most twelve nodes within two steps of a stated cause, and the edges among them."""
    e = _causal(spark, d)
    near = G.reachable(e, spark.sql(SEED), 2).orderBy("hops", "node").limit(12)
    return G.induced(e, near).select("src", "dst", "weight")


@query(f"with {MENTIONS_SQL}, a as (select name, source from u where source is not null group by 1, 2), s as (select source, count(*) as n from a group by 1) select name, count(*) as passages, round(sum(1.0 / n), 6) as weight from a join s using (source) group by 1")
def bridge_scores(spark: SparkSession, d: str) -> DataFrame:
    """An entity's weight: every passage gives its own to the names in it in equal parts."""
    a = _mentions(spark, d).where("source is not null").select("name", "source").distinct()
    s = a.groupBy("source").agg(F.count("*").alias("n"))
    return a.join(s, "source").groupBy("name").agg(F.count("*").alias("passages"), F.round(F.sum(1.0 / F.col("n")), 6).alias("weight"))


ENT = "list_distinct(list_transform(list_concat(list_concat(regexp_extract_all({x}, '\\b([0-9]{{4}})\\b', 1), regexp_extract_all({x}, '([0-9]{{1,3}}(?:,[0-9]{{3}})+)', 1)), regexp_extract_all({x}, '([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1)), lambda z: lower(z)))"


@query(f"with {CONTEXTS_SQL}, t as (select id, {ENT.format(x='question')} as e, {ENT.format(x=chr(39).join(['array_to_string(ctx, ', ' ', ')']))} as c from c) select id, round({_cov('e', 'c')}, 6) as entity_recall from t")
def entity_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).select("id", "question", CONTEXTS().alias("ctx"))
    return rows.select("id", F.round(J.entity_recall(F.col("question"), F.col("ctx")), 6).alias("entity_recall"))


@query(f"""with {CONTEXTS_SQL}, t as (select id, {_ct('question')} as q, {_ct('answer')} as a, {ENT.format(x='answer')} as e, list_transform(ctx, lambda x: {{'t': {_ct('x')}, 'e': {ENT.format(x='x')}}}) as k from c where answer is not null),
v as (select id, list_transform(k, lambda z: case when 0.5 * {_cov('a', 'z.t')} + 0.3 * {_cov('e', 'z.e')} + 0.2 * {_cov('q', 'z.t')} >= 0.35 then 1 else 0 end) as v from t)
select id, coalesce(list_sum(v), 0)::int as useful, round(case when list_sum(v) > 0 then list_sum(list_transform(range(1, len(v) + 1), lambda i: case when v[i] = 1 then list_sum(v[1:i]) / i else 0.0 end)) / list_sum(v) else 0.0 end, 6) as average_precision from v""")
def context_precision(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).where("answer is not null").select("id", J.verdicts(F.col("question"), F.col("answer"), CONTEXTS()).alias("v"))
    return rows.select("id", F.coalesce(F.aggregate("v", F.lit(0), lambda s, x: s + x), F.lit(0)).alias("useful"), F.round(J.average_precision(F.col("v")), 6).alias("average_precision"))


SENT = "list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"""with {CONTEXTS_SQL}, t as (select id, {_ct('answer')} as a, list_transform(ctx, lambda x: {_ct('x')}) as each from c where answer is not null)
select id, round(coalesce(list_max(list_transform(each, lambda e: case when len(a) > 0 and len(e) > 0 then len(list_intersect(a, e)) / len(list_distinct(list_concat(a, e))) else 0.0 end)), 0.0), 6) as best_match from t""")
def best_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).where("answer is not null").select("id", "answer", CONTEXTS().alias("ctx"))
    return rows.select("id", F.round(J.best_match(F.col("answer"), F.col("ctx")), 6).alias("best_match"))


@query("with p as (select doc_id, list_filter(list_transform(string_split_regex(lower(title), '[.!?]\\s*|,\\s*| (?:and|but|while|whereas|although) '), lambda x: trim(x)), lambda x: len(list_filter(string_split_regex(trim(x), '\\s+'), lambda y: y <> '')) >= 2) as p from documents where title is not null) select doc_id, len(p)::int as clauses, coalesce(p[1], '') as first from p")
def statement_clauses(spark: SparkSession, d: str) -> DataFrame:
    c = J.clauses(F.col("title"))
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.size(c).alias("clauses"), F.coalesce(F.get(c, 0), F.lit("")).alias("first"))


@query("with s as (select id, any_value(question) as q, any_value(answer) as a, any_value(paragraphs) as p from experiment_samples group by id), k as (select id, a, unnest(p) as x from s), h as (select id, x.idx as idx, x.is_supporting as gold, contains(lower(x.paragraph_text), lower(a)) as hit from k where a is not null) select id, count(*) filter (gold) as gold, count(*) filter (hit) as hits, count(*) filter (gold and hit) as both, min(idx) filter (hit) as first_hit from h group by 1")
def supporting_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages that name the answer, against those marked as supporting it."""
    s = _samples(spark, d).where("answer is not null").select("id", "answer", F.explode("paragraphs").alias("x"))
    gold, hit = F.col("x.is_supporting"), F.contains(F.lower("x.paragraph_text"), F.lower("answer"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return s.groupBy("id").agg(n(gold, "gold"), n(hit, "hits"), n(gold & hit, "both"), F.min(F.when(hit, F.col("x.idx"))).alias("first_hit"))


