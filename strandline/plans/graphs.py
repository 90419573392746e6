"""Entity records and graphs: merges, degrees, ranks, paths, components.

Two graphs: causes and effects of the causal statements, and names with the
passages that mention them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import merging as M
from ..registry import query, table

MENTIONS_SQL = """m as (select mention_id, lower(trim(entity_name)) as name, upper(entity_type) as type, description, source_id as source from llm_entities where trim(entity_name) <> ''
union all select mention_id, lower(trim(name)), upper(type), description, chunk_id from extracted_entities where trim(name) <> ''),
u as (select mention_id, min(name) as name, min(type) as type, min(description) as description, min(source) as source from m group by 1)"""
CAUSAL_SQL = """cr as (select id, min(lower(trim(e1))) as src, min(lower(trim(e2))) as dst from causal_rows where trim(e1) <> '' and trim(e2) <> '' group by id),
e as (select src, dst, count(*)::double as weight from cr where src <> dst group by 1, 2)"""


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "llm_entities").select("mention_id", F.lower(F.trim("entity_name")).alias("name"), F.upper("entity_type").alias("type"), "description", F.col("source_id").alias("source"))
    b = table(spark, d, "extracted_entities").select("mention_id", F.lower(F.trim("name")).alias("name"), F.upper("type").alias("type"), "description", F.col("chunk_id").alias("source"))
    return a.unionByName(b).where("name <> ''").groupBy("mention_id").agg(*[F.min(c).alias(c) for c in ("name", "type", "description", "source")])


def _causal(spark: SparkSession, d: str) -> DataFrame:
    """Each statement once; loops dropped."""
    rows = table(spark, d, "causal_rows").select("id", F.lower(F.trim("e1")).alias("src"), F.lower(F.trim("e2")).alias("dst")).where("src <> '' and dst <> ''")
    once = rows.groupBy("id").agg(F.min("src").alias("src"), F.min("dst").alias("dst")).where("src <> dst").withColumn("weight", F.lit(1.0))
    return M.edges(once).select("src", "dst", "weight")


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).where("source is not null").select(F.col("name").alias("src"), F.col("source").alias("dst")).distinct().withColumn("weight", F.lit(1.0))


PASSAGES_SQL = MENTIONS_SQL + ", e as (select distinct name as src, source as dst, 1.0::double as weight from u where source is not null)"
TYPES_SQL = "ty as (select name, arg_min(type, row(-n, type)) as type from (select name, type, count(type) as n from u where type is not null group by 1, 2) group by 1)"
JOINED = "array_to_string(list_sort(list_distinct(list({0}) filter (trim({0}) <> ''))), '<SEP>')"


@query(f"""with {MENTIONS_SQL}, {TYPES_SQL}, g as (select name, arg_min(description, row(-length(description), description)) filter (trim(description) <> '') as description, coalesce({JOINED.format('source')}, '') as sources, count(*) as n from u group by 1)
select g.name, description, sources, n, type from g left join ty using (name)""")
def entity_merge_longest(spark: SparkSession, d: str) -> DataFrame:
    return M.entities(_mentions(spark, d))


@query(f"""with {MENTIONS_SQL}, {TYPES_SQL}, g as (select name, coalesce({JOINED.format('description')}, '') as description, coalesce({JOINED.format('source')}, '') as sources, count(*) as n from u group by 1)
select g.name, description, sources, n, type from g left join ty using (name)""")
def entity_merge_sorted(spark: SparkSession, d: str) -> DataFrame:
    return M.entities(_mentions(spark, d), longest=False)


@query(f"with {CAUSAL_SQL} select * from e")
def edge_merge_sum(spark: SparkSession, d: str) -> DataFrame:
    return _causal(spark, d)


@query(f"with {CAUSAL_SQL} select least(src, dst) as src, greatest(src, dst) as dst, max(weight) as weight, count(*) as n from e group by 1, 2")
def edge_merge_undirected(spark: SparkSession, d: str) -> DataFrame:
    return M.edges(_causal(spark, d), "max", directed=False)


@query(f"with {CAUSAL_SQL}, {MENTIONS_SQL}, {TYPES_SQL}, n as (select distinct u.name, ty.type from u left join ty using (name)) select name, type from n union all select distinct x, 'UNKNOWN' from (select src as x from e union select dst from e) where x not in (select name from n)")
def placeholder_nodes(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    return M.with_placeholders(m.select("name").distinct().join(M.majority(m, ["name"], "type"), "name"), _causal(spark, d))


@query("with t as (select id, min(lower(trim(e1))) as cause, min(lower(trim(e2))) as effect, bool_or(label_true) as label from causal_rows where trim(e1) <> '' group by id), c as (select *, case when label then 0.9::double when label is null then 1.0::double else 0.4::double end as confidence from t) select cause, effect, id, confidence from (select *, row_number() over (partition by cause, effect order by confidence desc, id) as r from c where confidence >= 0.5) where r = 1")
def triple_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "causal_rows").where("trim(e1) <> ''").groupBy("id").agg(F.min(F.lower(F.trim("e1"))).alias("cause"), F.min(F.lower(F.trim("e2"))).alias("effect"), F.bool_or("label_true").alias("label"))
    scored = rows.withColumn("confidence", F.when(F.col("label"), 0.9).when(F.col("label").isNull(), 1.0).otherwise(0.4)).where("confidence >= 0.5")
    return M.keep_best(scored, ["cause", "effect"], [F.desc("confidence"), F.col("id")]).select("cause", "effect", "id", "confidence")


@query(f"with {CAUSAL_SQL}, b as (select src, dst, weight from e union all select dst, src, weight from e) select src, dst, sum(weight) as n from b group by 1, 2")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return M.edges(G.both_ways(_causal(spark, d))).select("src", "dst", F.col("weight").alias("n"))


@query(f"with {PASSAGES_SQL} select node, sum(i)::bigint as indegree, sum(o)::bigint as outdegree from (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by 1")
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_passages(spark, d))


@query(f"with {CAUSAL_SQL}, n as (select count(*) as n from (select src from e union select dst from e)), m as (select count(*) as m from e), dg as (select node, count(*) as k from (select src as node from e union all select dst from e) group by 1) select n as nodes, m as edges, round(m / (n * (n - 1.0)), 6) as density, (select max(k) from dg) as largest, round((select avg(k) from dg), 6) as mean from n, m")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    dg = G.degrees(_causal(spark, d)).withColumn("k", F.col("indegree") + F.col("outdegree"))
    s = dg.agg(F.count("*").alias("nodes"), F.sum("outdegree").alias("edges"), F.max("k").alias("largest"), F.round(F.avg("k"), 6).alias("mean"))
    return s.select("nodes", "edges", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)), 6).alias("density"), "largest", "mean")


@query(f"with {PASSAGES_SQL}, dg as (select node, count(*) as degree from (select src as node from e union all select dst from e) group by 1) select node, degree from dg order by degree desc, node limit 20")
def popular_labels(spark: SparkSession, d: str) -> DataFrame:
    return G.popular(_passages(spark, d), 20)


def _rank_sql(edges: str, rounds: int, damping: float, reset: str | None = None, dangling: bool = False) -> str:
    """The power iteration written out round by round."""
    sql = [edges, "o as (select src, sum(weight) as total from e group by 1)", "s as (select e.src, e.dst, e.weight / o.total as share from e join o using (src))", "n as (select src as node from e union select dst from e)"]
    if reset:
        sql.append(f"b as (select n.node, coalesce(w, 0) as restart from n left join ({reset}) r using (node))")
    else:
        sql.append("b as (select node, 1.0 / (select count(*) from n) as restart from n)")
    sql.append("r0 as (select node, 1.0 / (select count(*) from n) as rank from n)")
    for i in range(rounds):
        lost = f"coalesce((select sum(rank) from r{i} where node not in (select src from o)), 0)" if dangling else "0.0"
        sql.append(f"r{i + 1} as (select b.node, {1 - damping} * restart + {damping} * (coalesce(c.came, 0) + {lost} * restart) as rank from b left join (select dst as node, sum(rank * share) as came from s join r{i} on s.src = r{i}.node group by 1) c using (node))")
    return f"with {', '.join(sql)} select node, round(rank, 6) as rank from r{rounds}"


BOTH_SQL = PASSAGES_SQL.replace(", e as (", ", e0 as (") + ", e as (select src, dst, weight from e0 union all select dst, src, weight from e0)"


@query(_rank_sql(BOTH_SQL, 6, 0.85))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(G.both_ways(_passages(spark, d)), 6).withColumn("rank", F.round("rank", 6))


@query(_rank_sql(CAUSAL_SQL, 6, 0.5, "select 'road salt' as node, 0.75::double as w union all select 'cheap credit', 0.25::double", True))
def personalised_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Restarts at two stated causes; the rank of nodes without an effect goes back to them."""
    reset = spark.createDataFrame([("road salt", 3.0), ("cheap credit", 1.0)], "node string, weight double")
    return G.pagerank(_causal(spark, d), 6, 0.5, reset, return_dangling=True).withColumn("rank", F.round("rank", 6))


SEED = "select 'road salt' as node"


@query(f"with recursive {CAUSAL_SQL}, w as (select node, 0 as hops from ({SEED}) union select e.dst, w.hops + 1 from w join e on e.src = w.node where w.hops < 3) select 'road salt' as seed, node, min(hops)::int as hops from w group by 2")
def khop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.reachable(_causal(spark, d), spark.sql(SEED), 3)


@query(f"with recursive {CAUSAL_SQL}, p as (select [node] as path, node from ({SEED}) union all select list_append(path, e.dst), e.dst from p join e on e.src = p.node where len(path) <= 2 and not list_contains(path, e.dst)) select array_to_string(path, ' > ') as path, len(path)::int as nodes from p where len(path) > 1")
def causal_paths(spark: SparkSession, d: str) -> DataFrame:
    """Simple directed paths of one or two steps from a stated cause."""
    return G.simple_paths(_causal(spark, d), spark.sql(SEED), 2).select(F.array_join("path", " > ").alias("path"), F.size("path").alias("nodes"))


@query(f"""with {CAUSAL_SQL}, p1 as (select [src, dst] as path from e where src = 'road salt'), p2 as (select [a.src, a.dst, b.dst] as path from e a join e b on a.dst = b.src where a.src = 'road salt' and b.dst <> a.src and b.dst <> a.dst), p as (select * from p1 union all select * from p2),
l0 as (select distinct path[1] as a, path[2] as b from p), l1 as (select distinct path[2] as a, path[3] as b from p where len(path) = 3),
fo as (select a, count(*) as n from (select * from l0 union select * from l1) group by 1),
f0 as (select a, b, 1.0 / n as flow from l0 join fo using (a)), g as (select b as a, sum(flow) as got from f0 group by 1 having sum(flow) > 0.01), f1 as (select l1.a, l1.b, got * 0.8 / n as flow from l1 join fo using (a) join g using (a)),
t as (select a, b, sum(flow) as flow from (select * from f0 union all select * from f1) group by 1, 2)
select array_to_string(path, ' > ') as path, round(case when len(path) = 2 then coalesce(x.flow, 0) else (coalesce(x.flow, 0) + coalesce(y.flow, 0)) / 2 end, 6) as score from p left join t x on x.a = path[1] and x.b = path[2] left join t y on len(path) = 3 and y.a = path[2] and y.b = path[3]""")
def path_flows(spark: SparkSession, d: str) -> DataFrame:
    paths = G.simple_paths(_causal(spark, d), spark.sql(SEED), 2)
    return G.path_flow(paths, 0.8, 0.01).select(F.array_join("path", " > ").alias("path"), F.round("score", 6).alias("score"))


@query(f"""with recursive {PASSAGES_SQL}, b as (select src, dst from e union select dst, src from e), n as (select distinct src as node from b),
l(node, label, i) as (select node, node, 0 from n union all select node, label, i from (select l.node, least(min(l.label), min(m.label)) as label, min(l.i) + 1 as i from l join b on b.src = l.node join l m on m.node = b.dst where l.i < 14 group by l.node) z)
select node, min(label) as component from l group by 1""")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """The oracle passes labels 14 times, enough for these tables."""
    return G.components(_passages(spark, d))


def _lpa_sql(rounds: int) -> str:
    sql = [CAUSAL_SQL, "b as (select src, dst from e union select dst, src from e)", "l0 as (select src as node, src as label from (select distinct src from b))"]
    for i in range(rounds):
        sql.append(f"l{i + 1} as (select node, arg_min(label, row(-n, label)) as label from (select b.src as node, l.label, count(*) as n from b join l{i} l on l.node = b.dst group by 1, 2) group by 1)")
    return f"with {', '.join(sql)} select node, label as community from l{rounds}"


@query(_lpa_sql(4))
def label_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(_causal(spark, d), 4)


@query(f"with {CAUSAL_SQL}, k as (select dst as node, sum(weight) as w from e group by 1 having sum(weight) >= 2) select src, dst, weight from e where src in (select node from k) and dst in (select node from k)")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    e = _causal(spark, d)
    keep = e.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("w")).where("w >= 2")
    return G.induced(e, keep).select("src", "dst", "weight")


@query(f"with {CAUSAL_SQL} select src, dst, weight from e where src not in ('road salt', 'poor sleep') and dst not in ('road salt', 'poor sleep')")
def vertex_deletion(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([("road salt",), ("poor sleep",)], "node string")
    return G.without(_causal(spark, d), gone).select("src", "dst", "weight")


@query(f"with {CAUSAL_SQL}, r as (select case when src = 'poor sleep' then 'insomnia' else src end as src, case when dst = 'poor sleep' then 'insomnia' else dst end as dst, weight from e) select src, dst, sum(weight) as weight, count(*) as n from r where src <> dst group by 1, 2")
def entity_rename(spark: SparkSession, d: str) -> DataFrame:
    return M.renamed(_causal(spark, d), spark.createDataFrame([("poor sleep", "insomnia")], "old string, new string"))


@query(f"""with {CAUSAL_SQL}, s as (select src as node from e group by 1 having count(*) >= 3), x as (select src, dst, weight, (src in (select node from s))::int + (dst in (select node from s))::int as inside from e)
select src, dst, weight, case inside when 2 then 'in' else 'out' end as network, case when inside = 1 then count(*) over (partition by inside, case when src in (select node from s) then dst else src end) else 0 end as links from x where inside > 0""")
def network_split(spark: SparkSession, d: str) -> DataFrame:
    """Relations with both ends, and with exactly one end, among the selected causes."""
    from pyspark.sql import Window

    e = _causal(spark, d)
    s = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n >= 3").select("node", F.lit(1).alias("y"))
    x = e.join(s.toDF("src", "a"), "src", "left").join(s.toDF("dst", "b"), "dst", "left").fillna(0, ["a", "b"]).withColumn("inside", F.col("a") + F.col("b")).where("inside > 0")
    outside = F.when(F.col("a") == 1, F.col("dst")).otherwise(F.col("src"))
    links = F.when(F.col("inside") == 1, F.count("*").over(Window.partitionBy("inside", outside))).otherwise(0)
    return x.select("src", "dst", "weight", F.when(F.col("inside") == 2, "in").otherwise("out").alias("network"), links.alias("links"))


@query(f"with {CAUSAL_SQL}, dg as (select node, count(*) as k from (select src as node from e union all select dst from e) group by 1) select src, dst, weight, a.k + b.k as degrees, row_number() over (partition by src order by a.k + b.k desc, weight desc, dst)::int as rank from e join dg a on a.node = src join dg b on b.node = dst")
def ranked_edges(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = _causal(spark, d)
    dg = G.degrees(e).select("node", (F.col("indegree") + F.col("outdegree")).alias("k"))
    x = e.join(dg.toDF("src", "ka"), "src").join(dg.toDF("dst", "kb"), "dst").withColumn("degrees", F.col("ka") + F.col("kb"))
    return x.select("src", "dst", "weight", "degrees", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("degrees"), F.desc("weight"), "dst")).alias("rank"))
