"""Searches that combine levels: local context, global map and reduce over reports, iterative retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hooks
from ..functions import text as T
from ..operators import communities as C
from ..operators import graph as G
from ..operators import retrieval as R
from .engine import Engine


def local_context(engine: Engine, queries: DataFrame, budget: int = 600, shares: tuple[float, float] = (0.25, 0.5), k: int = 10) -> DataFrame:
    """(query, section, rank, text, spent) within a budget of words: reports, then relations, then passages.

    Reports get the first share and passages the second; relations get the rest.
    A section that needs less gives nothing to the others, so the parts stay in proportion.
    """
    t = engine.store.read("triples")
    edges = t.groupBy(F.col("cause").alias("src"), F.col("effect").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.explode(T.content_tokens(F.col("node"))).alias("w"))
    asked = queries.select("query", F.explode(T.content_tokens(F.col("question"))).alias("w"))
    hits = nodes.join(asked, "w").groupBy("query", "node").agg(F.count("*").alias("score"))
    chosen = hits.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("r") <= k)
    communities = G.label_propagation(edges, 3)
    of = chosen.join(communities, "node").groupBy("query", "community").agg(F.count("*").alias("score"))
    reports = of.join(C.reports(edges, communities), "community").select("query", F.lit("report").alias("section"), "score", F.col("report").alias("text"))
    d = G.degrees(edges).select("node", (F.col("indegree") + F.col("outdegree")).alias("k"))
    ends = edges.select("src", "dst", "weight", F.explode(F.array("src", "dst")).alias("node")).join(chosen.select("query", "node"), "node")
    relations = ends.join(d, "node").groupBy("query", "src", "dst").agg(F.max("k").alias("score")).select("query", F.lit("relation").alias("section"), "score", F.concat_ws(" ", "src", F.lit("causes"), "dst").alias("text"))
    passages = engine.query(queries, "hybrid", k).select("query", F.lit("source").alias("section"), (-F.col("rank")).alias("score"), "text")
    every = [x.select("query", "section", F.col("score").cast("double").alias("score"), "text") for x in (reports, relations, passages)]
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", "section").orderBy(F.desc("score"), "text"))).withColumn("cost", F.size(T.words(F.col("text"))))
    w = Window.partitionBy("query", "section").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    most = F.when(F.col("section") == "report", int(budget * shares[0])).when(F.col("section") == "source", int(budget * shares[1])).otherwise(budget - int(budget * shares[0]) - int(budget * shares[1]))
    return rows.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= most).select("query", "section", "rank", "text", "spent")


def rated_points(texts: Sequence[str]) -> list[str]:
    """The default map step: every sentence after ``Context:`` that shares a word with the question is a point, rated by how many."""
    out = []
    for t in texts:
        question, _, context = t.partition("\nContext:\n")
        q = {w for w in question.lower().replace("?", " ").split() if len(w) > 3}
        points = [(sum(w in s.lower() for w in q), s.strip()) for s in context.replace("\n", ". ").split(". ")]
        out.append("\n".join(f"{n}\t{s}" for n, s in points if n))
    return out


def global_search(reports: DataFrame, queries: DataFrame, words: int = 200, budget: int = 200, model: hooks.Model = rated_points) -> DataFrame:
    """(query, answer): reports are packed into contexts, each is mapped to rated points, the best points within a budget are the answer.

    ``reports`` has (community, report); every question is asked of every context, in the stated query set.
    """
    costed = reports.withColumn("cost", F.size(T.words(F.col("report")))).withColumn("part", F.pmod(F.xxhash64("community"), F.lit(64)))
    binned = C.greedy_bins(costed, ["part"], ["community"], "cost", words)
    contexts = binned.groupBy("part", "bin").agg(F.array_join(F.array_sort(F.collect_list("report")), "\n").alias("context"))
    prompts = contexts.crossJoin(F.broadcast(queries)).select("query", F.concat("question", F.lit("\nContext:\n"), "context").alias("prompt"))  # a stated query set
    points = prompts.select("query", F.explode(F.split(hooks.answered(F.col("prompt"), model), "\n")).alias("p")).select("query", F.split("p", "\t").alias("x")).where("size(x) = 2")
    rated = points.select("query", F.col("x")[0].try_cast("double").alias("score"), F.col("x")[1].alias("text")).where("score > 0").distinct()
    kept = R.within_budget(rated.withColumn("cost", F.size(T.words(F.col("text")))), ["query"], [F.desc("score"), F.col("text")], "cost", budget)
    return kept.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spent", "text"))), lambda x: x["text"]), ". ").alias("answer"))


def iterative_search(engine: Engine, queries: DataFrame, steps: int = 2, k: int = 3, mode: str = "hybrid") -> DataFrame:
    """(query, step, rank, doc, text): questions are split into parts, and each later step asks with words of what was found.

    A step that would repeat the question before it stops for that query.
    """
    asked = queries.select("query", F.explode(T.sub_questions(F.col("question"))).alias("question"))
    out = None
    for step in range(steps):
        keyed = asked.withColumn("part", F.xxhash64("query", "question"))
        found = engine.query(keyed.select(F.col("part").alias("query"), "question"), mode, k).withColumnRenamed("query", "part").join(keyed.select("part", "query", "question"), "part")
        best = found.groupBy("query", "doc", "text").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc")
        best = G.checkpointed(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("step", F.lit(step)))
        got = best.select("query", "step", "rank", "doc", "text")
        out = got if out is None else out.unionByName(got)
        thought = best.where("rank = 1").select("query", T.content_tokens(F.col("text")).alias("t"))
        more = keyed.join(thought, "query").select("query", "question", F.concat_ws(" ", "question", F.array_join(F.slice(F.array_except("t", T.content_tokens(F.col("question"))), 1, 5), " ")).alias("next"))
        asked = G.checkpointed(more.where("lower(trim(next)) <> lower(trim(question))").select("query", F.col("next").alias("question")).distinct())
    return out


def drift_search(engine: Engine, reports: DataFrame, queries: DataFrame, rounds: int = 2, k: int = 3) -> DataFrame:
    """(query, round, doc, text): a primer from the reports, then local steps with the words of what the round before found."""
    primer = global_search(reports, queries, budget=40)
    first = queries.join(primer, "query", "left").select("query", F.concat_ws(" ", "question", F.array_join(F.slice(T.content_tokens(F.coalesce("answer", F.lit(""))), 1, 8), " ")).alias("question"))
    return iterative_search(engine, first, rounds, k).withColumnRenamed("step", "round").select("query", "round", "doc", "text")
