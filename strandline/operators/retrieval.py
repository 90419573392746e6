"""Ranked retrieval: BM25, exact vector search, score fusion, hybrid scores, budgets and caps.

Results have (query, doc, score) and are ranked by score, then by doc.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import sigmoid
from ..session import checkpointed

QUERY_BLOCK = 4_096  # query vectors that are broadcast at once


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(doc, term, tf, dl): occurrences of every term, with the document's length.

    One aggregation per document and term; the length is carried along, so that
    no join brings it back.
    """
    t = docs.select(F.col(key).alias("doc"), tokens.alias("t"))
    return t.select("doc", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def asked_postings(docs: DataFrame, key: str, tokens: Column, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of the terms in ``asked`` (term) only, number and mean length of the documents that have tokens).

    Documents are tokenised once: every document also stands under an empty
    term, from which the statistics come, and only asked terms and that one are
    shuffled and written.  Besides dl the postings have dd, the document's
    number of different terms.
    """
    t = docs.select(F.col(key).alias("doc"), tokens.alias("t"))
    # in a step of its own: beside the explode it would be computed for every term
    t = t.select("doc", "t", F.size("t").alias("dl"), F.size(F.array_distinct("t")).alias("dd"))
    rows = t.select("doc", "dl", "dd", F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    wanted = asked.select("term").unionByName(asked.sparkSession.createDataFrame([("",)], "term string")).distinct()
    counted = rows.join(wanted, "term", "left_semi").groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("dd").alias("dd"))
    posts = checkpointed(counted)
    return posts.where("term <> ''"), posts.where("term = '' and dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))


def ranked(scores: DataFrame, k: int | None = None, by: str = "score", digits: int = 9) -> DataFrame:
    """Adds ``rank``; equal scores (to ``digits``) stand in the order of doc."""
    w = Window.partitionBy("query").orderBy(F.round(F.col(by), digits).desc(), "doc")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def bm25(queries: DataFrame, posts: DataFrame, stats: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of documents that score above 0.

    ``queries`` has (query, term), a repeated term as often as it stands.  Only
    postings of terms that occur in a query are joined.  ``stats`` is as from
    lengths(); without it, it is taken from the postings of all terms.
    """
    wanted = queries.groupBy("query", "term").agg(F.count("*").alias("qn"))
    if stats is None:
        stats = posts.groupBy("doc").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    used = posts.join(wanted.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    weighted = used.join(df, "term").crossJoin(F.broadcast(stats)).select("doc", "term", part.alias("part"))  # stats is one row
    return weighted.join(wanted, "term").groupBy("query", "doc").agg(F.sum(F.col("part") * F.col("qn")).alias("score")).where("score > 0")


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 2_000) -> DataFrame:
    """(src, dst, score), src < dst: all pairs of (id, v) whose cosine is at least the threshold.

    The vectors are dealt into blocks and every two blocks meet in a task of
    their own; nothing is collected.  Null vectors and those of no length have
    no pairs, nor have vectors of unequal lengths.
    """
    vectors = vectors.where("v is not null and size(v) > 0").select("id", "v")
    blocks = max(1, -(-vectors.count() // block))
    kind = vectors.schema["id"].dataType.simpleString()
    dealt = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(pdf["v"].map(len)):
            e = np.array(g["v"].tolist(), dtype=np.float64)
            norm, ids, b = np.linalg.norm(e, axis=1), g["id"].to_numpy(), g["b"].to_numpy()
            x, y = (b == b.min(), b == b.max())
            if b.min() == b.max() and pdf["i"].iat[0] != pdf["j"].iat[0]:
                continue
            scale = norm[x][:, None] * norm[y][None]
            s = np.divide(e[x] @ e[y].T, scale, out=np.full(scale.shape, -np.inf), where=scale > 0)
            r, c = np.nonzero(s >= threshold)
            left, right = ids[x][r], ids[y][c]
            ok = left < right if b.min() == b.max() else left != right
            out.append(pd.DataFrame({"src": np.minimum(left, right)[ok], "dst": np.maximum(left, right)[ok], "score": s[r, c][ok]}))
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "score": []}).astype({"src": pdf["id"].dtype, "dst": pdf["id"].dtype})

    met = dealt.select("id", "v", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    return met.groupBy("i", "j").applyInPandas(pairs, f"src {kind}, dst {kind}, score double")


def search(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(query, doc, score): exact search of a stated query set (id, v) in a corpus (id, v).

    The corpus is read once; within a batch of it query vectors are taken in
    blocks of bounded size.  Every partition of the corpus keeps its own k best
    of each, and only those are shuffled.  Vectors that are null, of another
    length or (for cosine) of no length are not found.
    """
    spark = queries.sparkSession
    rows = [(r.id, r.v) for r in queries.where("v is not null").select("id", "v").toLocalIterator()]
    kind = corpus.schema["id"].dataType.simpleString()
    qkind = queries.schema["id"].dataType.simpleString()
    blocks = [spark.sparkContext.broadcast(rows[lo : lo + QUERY_BLOCK]) for lo in range(0, max(1, len(rows)), QUERY_BLOCK)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [(np.array([i for i, _ in b.value]), np.array([v for _, v in b.value], dtype=np.float64)) for b in blocks]
        for pdf in batches:
            lengths = pdf["v"].map(lambda v: -1 if v is None else len(v)).to_numpy()
            for names, q in asked:
                good = np.nonzero(lengths == q.shape[1])[0] if q.ndim == 2 else []
                if not len(good):
                    continue
                e = np.array([pdf["v"].iat[i] for i in good], dtype=np.float64)
                ids = pdf["id"].to_numpy()[good]
                s = q @ e.T
                if metric == "cosine":
                    scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(e, axis=1)[None]
                    s = np.divide(s, scale, out=np.full(s.shape, -np.inf), where=scale > 0)
                elif metric == "euclidean":
                    s = -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] - 2 * s + (e * e).sum(1)[None]))
                if threshold is not None:
                    s[s < threshold] = -np.inf
                top = min(k, s.shape[1])
                bound = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]
                r, c = np.nonzero((s >= bound[:, None] - 1e-9) & np.isfinite(s))
                yield pd.DataFrame({"query": names[r], "doc": ids[c], "score": s[r, c]})

    return ranked(corpus.select("id", "v").mapInPandas(scan, f"query {qkind}, doc {kind}, score double"), k)


def fused(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query, doc, score, strategies, main) from (strategy, query, doc, score).

    Every strategy's positive scores are divided by their largest; strategies
    without a weight count 1; of equal contributions the first name is the main one.
    """
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("strategy")), F.lit(1.0))
    tops = scores.where("score > 0").groupBy("strategy", "query").agg(F.max("score").alias("top"))
    parts = scores.where("score > 0").join(tops, ["strategy", "query"]).withColumn("part", F.col("score") / F.col("top") * weight)
    return parts.groupBy("query", "doc").agg(
        F.sum("part").alias("score"),
        F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"),
        F.min_by("strategy", F.struct(-F.round("part", 9), F.col("strategy"))).alias("main"),
    )


def outer_merge(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Candidates of either side, 0 where one has no score."""
    x = a.select("query", "doc", F.col("score").alias(names[0]))
    y = b.select("query", "doc", F.col("score").alias(names[1]))
    return x.join(y, ["query", "doc"], "full_outer").fillna(0.0, list(names))


def node_match(text: Column, nodes: Column, least: int = 3) -> Column:
    """Share of a query's nodes that the text contains."""
    n = F.filter(nodes, lambda x: F.length(x) >= least)
    return F.when(F.size(n) > 0, F.size(F.filter(n, lambda x: F.contains(F.lower(text), x))) / F.size(n)).otherwise(0.0)


def ordered_pairs(text: Column, pairs: Column) -> Column:
    """Share of (cause, effect) pairs of which the text names the cause before the effect."""
    low = F.lower(text)
    good = F.filter(pairs, lambda p: (F.position(p["cause"], low) > 0) & (F.position(p["effect"], low) > F.position(p["cause"], low)))
    return F.when(F.size(pairs) > 0, F.size(good) / F.size(pairs)).otherwise(0.0)


def hybrid_score(semantic: Column, node: Column, pair: Column, lexical: Column, weights: tuple[float, float, float] = (0.4, 0.5, 0.1)) -> Column:
    return weights[0] * semantic + weights[1] * (0.7 * node + 0.3 * pair) + weights[2] * lexical


def gate(path: Column, covered: Column, ambiguity: Column) -> Column:
    """Share of the budget that goes to the causal part."""
    return sigmoid(2.0 * path + 2.0 * covered - 1.5 * ambiguity - 0.5)


def ambiguity(scores: DataFrame) -> DataFrame:
    """(query, ambiguity): 1 less the relative lead of the first over the second; 1 less the score if alone."""
    top = ranked(scores, 2).groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    alone = 1 - F.col("a")
    both = F.when(F.col("a") > 0, 1 - (F.col("a") - F.col("b")) / F.col("a")).otherwise(1.0)
    return top.select("query", F.when(F.col("b").isNull(), alone).otherwise(both).alias("ambiguity"))


def within_budget(rows: DataFrame, group: list[str], order: list[Column], cost: str, budget: int, already: int = 0) -> DataFrame:
    """The longest prefix of every group whose running cost stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("spent", F.sum(cost).over(w) + already).where(F.col("spent") <= budget)


def capped(rows: DataFrame, group: list[str], by: str, order: list[Column], most: int, k: int) -> DataFrame:
    """k rows of every group with at most ``most`` of each ``by``; filled up from the rest where they are too few."""
    inner = Window.partitionBy(*group, by).orderBy(*order)
    # the k best of each ``by`` are enough, so that partitions give up the rest before the shuffle
    first = rows.withColumn("turn", F.row_number().over(inner)).where(F.col("turn") <= max(k, most))
    outer = Window.partitionBy(*group).orderBy("over", *order)
    return first.withColumn("over", F.col("turn") > most).drop("turn").withColumn("place", F.row_number().over(outer)).where(F.col("place") <= k)


def normalised(scores: DataFrame) -> DataFrame:
    """Scores of every query brought to [0, 1]; 1 where all are equal.  The bounds are aggregated and joined, not windowed."""
    bounds = scores.groupBy("query").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return scores.join(bounds, "query").withColumn("score", scaled).drop("lo", "hi")


def path_structure(text: Column, pairs: Column) -> Column:
    """Mean over (cause, effect) pairs: 1.5 where the text names the cause first, 0.5 where the effect, 0 where not both."""
    low = F.lower(text)

    def value(p: Column) -> Column:
        c, e = F.position(p["cause"], low), F.position(p["effect"], low)
        return F.when((c > 0) & (e > c), 1.5).when((c > 0) & (e > 0), 0.5).otherwise(0.0)

    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, p: s + value(p)) / F.size(pairs)).otherwise(0.0)
