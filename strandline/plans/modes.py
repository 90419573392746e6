"""Query modes over the causal graph: local, global, hybrid, path-based and fused retrieval for every sample's question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..registry import query, table
from ..session import checkpointed
from .evaluation import _ct
from .graphs import CAUSAL_SQL, _causal

LONGEST_NAME = 4  # words of a node's name that is found in a question
_GRAMS = "list_concat(" * (LONGEST_NAME - 1) + "t" + "".join(f", list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' ')))" for n in range(2, LONGEST_NAME + 1))
MODES_SQL = f"""{CAUSAL_SQL}, s as (select id as query, min(question) as question from experiment_samples where question is not null group by 1),
g as (select query, unnest(list_distinct({_GRAMS})) as name from (select query, regexp_extract_all(lower(question), '[a-z0-9_]+') as t from s)),
nn as (select node, array_to_string(regexp_extract_all(node, '[a-z0-9_]+'), ' ') as name from (select src as node from e union select dst from e)),
hit as (select distinct query, node from g join nn using (name) where name <> ''),
lo as (select query, src, dst, weight, row_number() over (partition by query order by weight desc, src, dst) as rank from (select distinct query, e.src, e.dst, weight from hit join e on e.src = node or e.dst = node)),
rt as (select src, dst, weight, list_distinct(list_concat({_ct('src')}, {_ct('dst')})) as t from e), ru as (select src, dst, weight, len(t) as n, unnest(t) as w from rt), qu as (select query, unnest({_ct('question')}) as w from s),
gc as (select query, src, dst, weight, count(*) / any_value(n) as share from ru join qu using (w) group by 1, 2, 3, 4),
gl as (select query, src, dst, share, row_number() over (partition by query order by round(share, 9) desc, weight desc, src, dst) as rank from gc where share >= 0.5)"""


def word_runs(tokens: Column, most: int = LONGEST_NAME) -> Column:
    """All runs of up to ``most`` tokens, each once."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.array_distinct(F.flatten(F.array(tokens, *map(runs, range(2, most + 1)))))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "experiment_samples").where("question is not null").groupBy(F.col("id").alias("query")).agg(F.min("question").alias("question"))


def _hits(spark: SparkSession, d: str, e: DataFrame) -> DataFrame:
    """(query, node): nodes that a question names; an equi-join over its runs of words."""
    q = _questions(spark, d).withColumn("t", T.ascii_tokens(F.col("question"))).select("query", F.explode(word_runs(F.col("t"))).alias("name"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("name", F.array_join(T.ascii_tokens(F.col("node")), " ")).where("name <> ''")
    return q.join(nodes, "name").select("query", "node").distinct()


def _local(spark: SparkSession, d: str, e: DataFrame, k: int) -> DataFrame:
    hits = checkpointed(_hits(spark, d, e))
    ends = e.join(hits.withColumnRenamed("node", "src"), "src").select("query", "src", "dst", "weight").unionByName(e.join(hits.withColumnRenamed("node", "dst"), "dst").select("query", "src", "dst", "weight"))
    w = Window.partitionBy("query").orderBy(F.desc("weight"), "src", "dst")
    return ends.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _global(spark: SparkSession, d: str, e: DataFrame, k: int) -> DataFrame:
    terms = F.array_union(T.content_tokens(F.col("src")), T.content_tokens(F.col("dst")))
    rels = e.withColumn("t", terms).select("src", "dst", "weight", F.size("t").alias("n"), F.explode("t").alias("w"))
    asked = _questions(spark, d).select("query", F.explode(T.content_tokens(F.col("question"))).alias("w"))
    shares = rels.join(asked, "w").groupBy("query", "src", "dst", "weight").agg((F.count("*") / F.first("n")).alias("share")).where("share >= 0.5")
    w = Window.partitionBy("query").orderBy(F.round("share", 9).desc(), F.desc("weight"), "src", "dst")
    return shares.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query(f"with {MODES_SQL} select query, src, dst, weight, rank::int as rank from lo where rank <= 10")
def local_search(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the nodes that a question names, the heaviest first."""
    return _local(spark, d, _causal(spark, d), 10)


@query(f"with {MODES_SQL} select query, src, dst, round(share, 6) as share, rank::int as rank from gl where rank <= 10")
def global_search(spark: SparkSession, d: str) -> DataFrame:
    """Relations of whose words a question has half at least."""
    return _global(spark, d, _causal(spark, d), 10).select("query", "src", "dst", F.round("share", 6).alias("share"), "rank")


@query(f"""with {MODES_SQL}, u as (select query, src, dst, rank, 0 as m from lo where rank <= 10 union all select query, src, dst, rank, 1 from gl where rank <= 10), b as (select query, src, dst, min(rank * 2 + m) as turn from u group by 1, 2, 3)
select query, src, dst, place from (select *, row_number() over (partition by query order by turn)::int as place from b) where place <= 10""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Local and global relations in turn, each once."""
    e = checkpointed(_causal(spark, d))
    u = _local(spark, d, e, 10).select("query", "src", "dst", (F.col("rank") * 2).alias("turn")).unionByName(_global(spark, d, e, 10).select("query", "src", "dst", (F.col("rank") * 2 + 1).alias("turn")))
    b = u.groupBy("query", "src", "dst").agg(F.min("turn").alias("turn"))
    return b.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("turn"))).where("place <= 10").select("query", "src", "dst", "place")


@query(f"""with {MODES_SQL}, p1 as (select query, e.src as a, e.dst as b, e.weight as w from hit join e on e.src = node), p as (select query, a || ' > ' || b as path, w::double as score from p1 union all select query, a || ' > ' || b || ' > ' || e.dst, (w + e.weight) / 2 from p1 join e on e.src = b where e.dst <> a),
b as (select query, path, max(score) as score from p group by 1, 2)
select query, path, round(score, 6) as score, rank from (select *, row_number() over (partition by query order by round(score, 9) desc, path)::int as rank from b) where rank <= 8""")
def path_search(spark: SparkSession, d: str) -> DataFrame:
    """Paths of one or two steps from the nodes that a question names, by the mean weight of their steps."""
    e = checkpointed(_causal(spark, d))
    one = checkpointed(_hits(spark, d, e).withColumnRenamed("node", "src").join(e, "src").select("query", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")))
    two = one.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c"), "weight"), "b").where("c <> a")
    p = one.select("query", F.concat_ws(" > ", "a", "b").alias("path"), F.col("w").alias("score")).unionByName(two.select("query", F.concat_ws(" > ", "a", "b", "c").alias("path"), ((F.col("w") + F.col("weight")) / 2).alias("score")))
    w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "path")
    best = p.groupBy("query", "path").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where("rank <= 8")
    return best.select("query", "path", F.round("score", 6).alias("score"), "rank")


@query(f"""with {MODES_SQL}, u as (select 'node' as strategy, query, src || ' > ' || dst as doc, weight as score from lo where rank <= 20 union all select 'words', query, src || ' > ' || dst, share from gl where rank <= 20),
m as (select strategy, query, doc, score / max(score) over (partition by strategy, query) * case strategy when 'words' then 0.8 else 1.0 end as part from u),
f as (select query, doc, sum(part) as score, array_to_string(list_sort(list_distinct(list(strategy))), ',') as strategies from m group by 1, 2)
select query, doc as triple, round(score, 6) as score, strategies, rank from (select *, row_number() over (partition by query order by round(score, 9) desc, doc)::int as rank from f) where rank <= 5""")
def triple_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Triples by several strategies, each scaled by its best, weighted and added up."""
    e = checkpointed(_causal(spark, d))
    doc = F.concat_ws(" > ", "src", "dst").alias("doc")
    a = _local(spark, d, e, 20).select(F.lit("node").alias("strategy"), "query", doc, F.col("weight").alias("score"))
    b = _global(spark, d, e, 20).select(F.lit("words").alias("strategy"), "query", doc, F.col("share").alias("score"))
    top = R.ranked(R.fused(a.unionByName(b), {"words": 0.8}), 5)
    return top.select("query", F.col("doc").alias("triple"), F.round("score", 6).alias("score"), "strategies", "rank")
