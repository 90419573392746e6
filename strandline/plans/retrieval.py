"""Ranked retrieval over documents, passages and vectors.

The query set is every evaluation question whose id is divisible by 20, and
every stored vector whose id is, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import retrieval as R
from ..registry import query, table
from ..session import checkpointed

POSTINGS_SQL = """t as (select doc_id as doc, regexp_extract_all(lower(text), '[a-z0-9_]+') as t from documents where text is not null),
p as (select doc, term, count(*) as tf, any_value(dl) as dl from (select doc, len(t) as dl, unnest(t) as term from t where len(t) > 0) group by 1, 2)"""
QUERIES_SQL = """q as (select query, term, count(*) as qn from (select item_id as query, unnest(regexp_extract_all(lower(question), '[a-z0-9_]+')) as term from eval_items where item_id % 20 = 0) group by 1, 2)"""
BM25_SQL = f"""{POSTINGS_SQL}, {QUERIES_SQL},
st as (select count(*) as n, avg(dl) as av from (select doc, any_value(dl) as dl from p group by 1)),
df as (select term, count(*) as df from p group by 1),
bm as (select query, doc, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) as score from p join q using (term) join df using (term), st group by 1, 2)"""


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(table(spark, d, "documents").where("text is not null"), "doc_id", T.ascii_tokens(F.col("text")))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query"), F.explode(T.ascii_tokens(F.col("question"))).alias("term"))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The questions' terms, their postings and the corpus statistics."""
    asked = _questions(spark, d)
    docs = table(spark, d, "documents").where("text is not null")
    return asked, *R.asked_postings(docs, "doc_id", T.ascii_tokens(F.col("text")), asked)


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(*_asked(spark, d))


@query(f"with {BM25_SQL} select query, doc, round(score, 6) as score, rank from (select *, row_number() over (partition by query order by round(score, 9) desc, doc)::int as rank from bm) where rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(_bm25(spark, d), 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"with {POSTINGS_SQL} select term, count(*) as df, sum(tf)::bigint as cf, max(tf) as max_tf from p group by 1")
def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query(f"with {BM25_SQL}, a as (select query, max(score) filter (rank = 1) as a, max(score) filter (rank = 2) as b from (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from bm) group by 1) select query, round(case when b is null then 1 - a when a > 0 then 1 - (a - b) / a else 1.0 end, 6) as ambiguity from a")
def query_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return R.ambiguity(_bm25(spark, d)).withColumn("ambiguity", F.round("ambiguity", 6))


VECTORS_SQL = "v as (select vec_id as id, embedding::double[] as v from embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"))


def _vector_sql(score: str, extra: str = "") -> str:
    return f"with {VECTORS_SQL}, s as (select q.id as query, c.id as doc, {score} as score from v q, v c where q.id % 20 = 0 {extra}) select query, doc, round(score, 6) as score, rank from (select *, row_number() over (partition by query order by round(score, 9) desc, doc)::int as rank from s) where rank <= 5"


@query(_vector_sql("list_cosine_similarity(q.v, c.v)"))
def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.search(v.where("id % 20 = 0"), v, 5).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(_vector_sql("list_inner_product(q.v, c.v)"))
def vector_topk_dot(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return R.search(v.where("id % 20 = 0"), v, 5, "dot").select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(_vector_sql("-list_distance(q.v, c.v)", "and q.id <> c.id"))
def vector_topk_euclidean(spark: SparkSession, d: str) -> DataFrame:
    """Nearest others; the vector itself is left out after one place more was taken."""
    v = _vectors(spark, d)
    near = R.search(v.where("id % 20 = 0"), v, 6, "euclidean").where("query <> doc").drop("rank")
    return R.ranked(near, 5).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"with {VECTORS_SQL}, s as (select q.id as query, c.id as doc, list_cosine_similarity(q.v, c.v) as score from v q, v c where q.id % 20 = 0 and q.id <> c.id) select least(query, doc) as src, greatest(query, doc) as dst, round(max(score), 6) as weight from s where score >= 0.3 group by 1, 2")
def synonym_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between vectors of high similarity, undirected."""
    v = _vectors(spark, d)
    near = R.search(v.where("id % 20 = 0"), v, 1_000_000_000, threshold=0.3).where("query <> doc")
    return near.groupBy(F.least("query", "doc").alias("src"), F.greatest("query", "doc").alias("dst")).agg(F.round(F.max("score"), 6).alias("weight"))


@query(f"with {VECTORS_SQL} select q.id as src, c.id as dst, round(list_cosine_similarity(q.v, c.v), 6) as weight from v q join v c on q.id < c.id where list_cosine_similarity(q.v, c.v) >= 0.3")
def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between all vectors of high similarity, undirected: the self join in full, in blocks."""
    return R.similar_pairs(_vectors(spark, d), 0.3).select("src", "dst", F.round("score", 6).alias("weight"))


@query("with e as (select label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as pos from embeddings) select label, pos::int as pos, round(avg(x), 6) as mean from e group by 1, 2")
def mean_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("with e as (select vec_id, embedding::double[] as v, list_min(embedding::double[]) as lo, list_max(embedding::double[]) as hi from embeddings) select vec_id, round(list_max(list_transform(v, lambda x: abs(x - (lo + floor((x - lo) / ((hi - lo) / 255) + 0.5) * ((hi - lo) / 255))))), 6) as loss, round(sqrt(list_inner_product(v, v)), 6) as norm from e")
def quantisation_loss(spark: SparkSession, d: str) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    codes, lo, step = V.quantised(v)
    back = V.dequantised(codes, lo, step)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(F.zip_with(v, back, lambda a, b: F.abs(a - b))), 6).alias("loss"), F.round(V.norm(v), 6).alias("norm"))


@query(f"with {BM25_SQL}, m as (select query, min(score) as lo, max(score) as hi from bm group by 1) select query, doc, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as score from bm join m using (query)")
def min_max_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.normalised(_bm25(spark, d)).withColumn("score", F.round("score", 6))


TITLE_SQL = """ti as (select query, doc, count(*)::double as score from (select distinct doc_id as doc, unnest(regexp_extract_all(lower(title), '[a-z0-9_]+')) as term from documents) join q using (term) group by 1, 2)"""


def _title_hits(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(T.ascii_tokens(F.col("title"))).alias("term")).distinct()
    return terms.join(_questions(spark, d).distinct(), "term").groupBy("query", "doc").agg(F.count("*").cast("double").alias("score"))


@query(f"""with {BM25_SQL}, {TITLE_SQL}, u as (select 'text' as strategy, * from bm union all select 'title', * from ti),
m as (select strategy, query, doc, score / max(score) over (partition by strategy, query) * case strategy when 'title' then 0.6 else 1.0 end as part from u where score > 0),
f as (select query, doc, sum(part) as score, array_to_string(list_sort(list_distinct(list(strategy))), ',') as strategies, arg_min(strategy, row(-round(part, 9), strategy)) as main from m group by 1, 2)
select query, doc, round(score, 6) as score, strategies, main from (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as r from f) where r <= 10""")
def score_fusion(spark: SparkSession, d: str) -> DataFrame:
    both = _bm25(spark, d).withColumn("strategy", F.lit("text")).unionByName(_title_hits(spark, d).withColumn("strategy", F.lit("title")))
    return R.ranked(R.fused(both, {"title": 0.6}), 10).select("query", "doc", F.round("score", 6).alias("score"), "strategies", "main")


@query(f"with {BM25_SQL}, {TITLE_SQL} select query, doc, round(coalesce(bm.score, 0), 6) as text_score, round(coalesce(ti.score, 0), 6) as title_score from bm full join ti using (query, doc)")
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    m = R.outer_merge(_bm25(spark, d), _title_hits(spark, d), ("text_score", "title_score"))
    return m.select("query", "doc", F.round("text_score", 6).alias("text_score"), F.round("title_score", 6).alias("title_score"))


HYBRID_CTES = f"""{BM25_SQL}, r as (select * from (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from bm) where rank <= 50),
am as (select query, case when b is null then 1 - a when a > 0 then 1 - (a - b) / a else 1.0 end as ambiguity from (select query, max(score) filter (rank = 1) as a, max(score) filter (rank = 2) as b from r group by 1)),
qs as (select query, count(*) as nq from q group by 1), cm as (select query, doc, count(*) as common from p join q using (term) group by 1, 2), dd as (select doc, len(list_distinct(t)) as dd from t),
lh as (select query, min(score) as lo, max(score) as hi from r group by 1),
nd as (select item_id as query, list_sort(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), lambda w: length(w) >= 3 and not list_contains([{', '.join(f"'{w}'" for w in T.STOP_WORDS)}], w))) as nodes from eval_items where item_id % 20 = 0),
x as (select query, doc, lower(d.text) as t, common / sqrt(nq * dd) as semantic, case when hi = lo then 1.0 else (score - lo) / (hi - lo) end as lexical, nodes, ambiguity,
list_transform(range(1, len(nodes)), lambda i: [instr(lower(d.text), nodes[i]), instr(lower(d.text), nodes[i + 1])]) as ps
from r join lh using (query) join qs using (query) join cm using (query, doc) join dd using (doc) join nd using (query) join am using (query) join documents d on d.doc_id = r.doc),
f as (select query, doc, semantic, lexical, nodes, ambiguity, case when len(nodes) > 0 then len(list_filter(nodes, lambda k: contains(t, k))) / len(nodes) else 0.0 end as node,
case when len(ps) > 0 then len(list_filter(ps, lambda a: a[1] > 0 and a[2] > a[1])) / len(ps) else 0.0 end as pair,
case when len(ps) > 0 then list_sum(list_transform(ps, lambda a: case when a[1] > 0 and a[2] > a[1] then 1.5 when a[1] > 0 and a[2] > 0 then 0.5 else 0.0 end)) / len(ps) else 0.0 end as structure from x)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best passages of every question by BM25, with their semantic, lexical and causal features.

    Semantic is the cosine of the two texts' sets of words; a question's nodes
    are its content words, and its paths lead from each to the next.
    """
    asked, posts, stats = _asked(spark, d)
    best = checkpointed(R.ranked(R.bm25(asked, posts, stats), 50))
    terms = asked.distinct()
    common = posts.join(terms, "term").join(best.select("query", "doc"), ["query", "doc"], "left_semi").groupBy("query", "doc").agg(F.count("*").alias("common"), F.first("dd").alias("dd"))
    nodes = F.array_sort(F.filter(T.content_tokens(F.col("question")), lambda w: F.length(w) >= 3))
    steps = F.when(F.size("nodes") > 1, F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.get("nodes", i - 1).alias("cause"), F.get("nodes", i).alias("effect"))))
    questions = table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query"), nodes.alias("nodes"))
    questions = questions.withColumn("paths", F.coalesce(steps, F.array().cast("array<struct<cause:string,effect:string>>")))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    rows = R.normalised(best).withColumnRenamed("score", "lexical").join(common, ["query", "doc"]).join(terms.groupBy("query").agg(F.count("*").alias("nq")), "query")
    rows = rows.join(questions, "query").join(R.ambiguity(best), "query").join(texts, "doc")
    return rows.select(
        "query", "doc", "lexical", "ambiguity", F.size("nodes").alias("n_nodes"), (F.col("common") / F.sqrt(F.col("nq") * F.col("dd"))).alias("semantic"),
        R.node_match(F.col("text"), F.col("nodes")).alias("node"), R.ordered_pairs(F.col("text"), F.col("paths")).alias("pair"), R.path_structure(F.col("text"), F.col("paths")).alias("structure"),
    )


@query(f"""with {HYBRID_CTES} select query, doc, round(semantic, 6) as semantic, round(lexical, 6) as lexical, round(node, 6) as node, round(pair, 6) as pair,
round(0.4 * semantic + 0.5 * (0.7 * node + 0.3 * pair) + 0.1 * lexical, 6) as score, round(1 / (1 + exp(-(2.0 * pair + 2.0 * node - 1.5 * ambiguity - 0.5))), 6) as gate from f""")
def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    """Semantic, causal and lexical score of the candidates, and the causal share of the budget."""
    f = _features(spark, d)
    score = R.hybrid_score(F.col("semantic"), F.col("node"), F.col("pair"), F.col("lexical"))
    gate = R.gate(F.col("pair"), F.col("node"), F.col("ambiguity"))
    return f.select("query", "doc", *[F.round(c, 6).alias(c) for c in ("semantic", "lexical", "node", "pair")], F.round(score, 6).alias("score"), F.round(gate, 6).alias("gate"))


@query(f"""with {HYBRID_CTES}, w as (select *, 1 / (1 + exp(-(2.0 * pair + 2.0 * node - 1.5 * ambiguity - 0.5))) as gate from f), c as (select *, 0.9 * gate * (node + pair) / 2 as causal from w),
tops as (select query, avg(k) as first from (select query, 0.7 * node + 0.3 * pair as k, row_number() over (partition by query order by round(semantic, 9) desc, doc) as r from c) where r <= 5 group by 1),
m as (select c.*, causal + (0.9 - causal) * 0.5 * first as adapted from c join tops using (query))
select query, doc, round(causal, 6) as causal, round(0.9 - causal, 6) as semantic_weight, round(adapted, 6) as adapted, round((0.9 - adapted) * semantic + adapted * (0.7 * node + 0.3 * pair) + 0.1 * lexical, 6) as score from m""")
def adaptive_weights(spark: SparkSession, d: str) -> DataFrame:
    """The gate's share switched by the confidence of nodes and paths, then led by the causal score of the first five by meaning."""
    f = _features(spark, d)
    match = 0.7 * F.col("node") + 0.3 * F.col("pair")
    causal = 0.9 * R.gate(F.col("pair"), F.col("node"), F.col("ambiguity")) * (F.col("node") + F.col("pair")) / 2
    first = R.ranked(f.withColumn("k", match), 5, by="semantic").groupBy("query").agg(F.avg("k").alias("first"))
    m = f.join(first, "query").withColumn("causal", causal).withColumn("adapted", F.col("causal") + (0.9 - F.col("causal")) * 0.5 * F.col("first"))
    score = (0.9 - F.col("adapted")) * F.col("semantic") + F.col("adapted") * match + 0.1 * F.col("lexical")
    return m.select("query", "doc", F.round("causal", 6).alias("causal"), F.round(0.9 - F.col("causal"), 6).alias("semantic_weight"), F.round("adapted", 6).alias("adapted"), F.round(score, 6).alias("score"))


@query(f"""with {HYBRID_CTES}, raw as (select *, 1.0 * node + 2.0 * structure + 0.5 * semantic as raw from f), m as (select query, min(raw) as lo, max(raw) as hi from raw group by 1)
select query, doc, round(case when len(nodes) = 0 then 0.1 when hi = lo then 1.0 else (raw - lo) / (hi - lo) end, 6) as score from raw join m using (query)""")
def causal_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of nodes, twice the structure of paths and half the semantic score, scaled to [0, 1]; 0.1 for a question without nodes."""
    f = _features(spark, d)
    raw = f.withColumn("score", F.col("node") + 2.0 * F.col("structure") + 0.5 * F.col("semantic"))
    scaled = R.normalised(raw)
    return scaled.select("query", "doc", F.round(F.when(F.col("n_nodes") == 0, 0.1).otherwise(F.col("score")), 6).alias("score"))


@query(f"""with {HYBRID_CTES} select query, doc, 'Matched ' || (node * len(nodes))::int || ' of ' || len(nodes) || ' nodes' || case when pair > 0 then '; paths in order' else '' end || case when lexical >= 0.5 then '; words agree' else '' end as explanation from f""")
def explanations(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for a passage, in words."""
    f = _features(spark, d)
    text = F.concat(
        F.lit("Matched "), F.round(F.col("node") * F.col("n_nodes")).cast("int").cast("string"), F.lit(" of "), F.col("n_nodes").cast("string"), F.lit(" nodes"),
        F.when(F.col("pair") > 0, "; paths in order").otherwise(""), F.when(F.col("lexical") >= 0.5, "; words agree").otherwise(""),
    )
    return f.select("query", "doc", text.alias("explanation"))


@query(f"""with {BM25_SQL}, r as (select query, doc, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from bm),
c as (select r.*, coalesce(d.n_chars, 0) as cost from r join documents d on r.doc = d.doc_id)
select * from (select query, doc, rank::int as rank, sum(cost) over (partition by query order by rank)::bigint + 100 as spent from c) where spent <= 8000""")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    cost = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("n_chars", F.lit(0)).alias("cost"))
    # a passage that is found costs a character at least, so no more than the budget can be in it
    rows = R.ranked(_bm25(spark, d), 8_000).join(cost, "doc")
    return R.within_budget(rows, ["query"], [F.col("rank")], "cost", 8_000, 100).select("query", "doc", "rank", "spent")


@query(f"""with {BM25_SQL}, r as (select query, doc, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from bm),
c as (select r.*, d.source, row_number() over (partition by query, d.source order by rank) > 2 as over from r join documents d on r.doc = d.doc_id)
select query, doc, place from (select *, row_number() over (partition by query order by over, rank)::int as place from c) where place <= 8""")
def per_source_cap(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    rows = R.ranked(_bm25(spark, d)).join(source, "doc")
    return R.capped(rows, ["query"], "source", [F.col("rank")], 2, 8).select("query", "doc", "place")


@query(f"""with {BM25_SQL}, r as (select query, doc, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from bm),
c as (select query, rank, d.source from r join documents d on r.doc = d.doc_id where rank <= 20), f as (select query, source, min(rank) as first from c group by 1, 2)
select query, source, row_number() over (partition by query order by first)::int as reference from f""")
def reference_list(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the order of their first passage."""
    source = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    first = R.ranked(_bm25(spark, d), 20).join(source, "doc").groupBy("query", "source").agg(F.min("rank").alias("first"))
    return first.select("query", "source", F.row_number().over(Window.partitionBy("query").orderBy("first")).alias("reference"))


TERMS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""with s as (select id, any_value(paragraphs) as p from experiment_samples group by id),
qt as (select distinct id, term from (select item_id as id, unnest({TERMS.format(x='question')}) as term from eval_items where item_id % 20 = 0) where term not in ({STOP})),
pa as (select distinct id as other, md5(x.paragraph_text) as para, x.paragraph_text as body from (select id, unnest(p) as x from s) where not x.is_supporting),
pt as (select distinct other, para, unnest({TERMS.format(x='body')}) as term from pa),
n as (select id, count(*) as n from qt group by 1),
m as (select qt.id, pt.other, pt.para, count(*) / any_value(n)::double as score from qt join pt using (term) join n using (id) group by 1, 2, 3)
select id, other, para, round(score, 6) as score, rank from (select *, row_number() over (partition by id order by round(score, 9) desc, other, para)::int as rank from m) where rank <= 3""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Passages that support nothing and share most words with a question of the query set."""
    s = table(spark, d, "experiment_samples").groupBy("id").agg(F.first("paragraphs").alias("p"))
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    q = table(spark, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("id"), F.explode(T.content_tokens(F.col("question"))).alias("term")).distinct()
    p = s.select(F.col("id").alias("other"), F.explode("p").alias("x")).where("not x.is_supporting").select("other", F.md5("x.paragraph_text").alias("para"), F.col("x.paragraph_text").alias("body")).distinct()
    pt = p.select("other", "para", F.explode(F.array_distinct(terms(F.col("body")))).alias("term"))
    n = q.groupBy("id").agg(F.count("*").alias("n"))
    m = pt.join(q, "term").groupBy("id", "other", "para").agg(F.count("*").alias("c")).join(n, "id")
    w = Window.partitionBy("id").orderBy(F.round("score", 9).desc(), "other", "para")
    return m.withColumn("score", F.col("c") / F.col("n")).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("id", "other", "para", F.round("score", 6).alias("score"), "rank")
