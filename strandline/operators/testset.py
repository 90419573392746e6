"""Making test questions from documents: extractors, relations between chunks, candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import sentences

Transform = Callable[[DataFrame], DataFrame]


def capitalised(c: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-zA-Z]+)\b"), 1)), 1, most)


def lead(c: Column, sentences_: int = 2, words: int = 24) -> Column:
    text = F.array_join(F.slice(sentences(c), 1, sentences_), " ")
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, words), " ")


def topics(nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, topic): the most frequent word of four letters at least; of equals the longer, then the first in order."""
    w = nodes.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{4,})"), 1)).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    return w.groupBy(key).agg(F.min_by("w", F.struct(-F.col("n"), -F.length("w"), F.col("w"))).alias("topic"))


def applied(nodes: DataFrame, *steps: Transform) -> DataFrame:
    """Transforms one after another."""
    for s in steps:
        nodes = nodes.transform(s)
    return nodes


def next_edges(nodes: DataFrame, doc: str, order: str, key: str) -> DataFrame:
    """(src, dst, kind) of neighbours within a document."""
    n = nodes.select(F.col(key).alias("src"), F.lead(key).over(Window.partitionBy(doc).orderBy(order)).alias("dst"))
    return n.where("dst is not null").withColumn("kind", F.lit("next"))


def shared_edges(nodes: DataFrame, key: str, words: str, least: int = 2, common: int = 1000) -> DataFrame:
    """(src, dst, kind, shared) of nodes that share at least so many words.

    Of each node's words, from the rarest on, all but the last ``least`` - 1 make
    pairs: two nodes that share ``least`` words share one of these.  The words of
    more than ``common`` nodes are dealt into parts, so that no task holds all
    pairs of a word.
    """
    w = nodes.select(F.col(key).alias("node"), F.explode(F.array_distinct(words)).alias("w")).distinct()
    df = w.groupBy("w").agg(F.count("*").alias("df"))
    w = w.join(df, "w")
    order, of_node = Window.partitionBy("node").orderBy("df", "w"), Window.partitionBy("node")
    first = w.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(of_node)).where(F.col("r") <= F.col("n") - (least - 1))
    first = first.withColumn("parts", F.ceil(F.col("df") / common))
    dealt = first.select(F.col("node").alias("src"), "w", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    whole = first.select(F.col("node").alias("dst"), "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pairs = dealt.join(whole, ["w", "part"]).where("src < dst").select("src", "dst").distinct()
    left, right = w.select(F.col("node").alias("src"), "w"), w.select(F.col("node").alias("dst"), "w")
    n = pairs.join(left, "src").join(right, ["dst", "w"]).groupBy("src", "dst").agg(F.count("*").alias("shared"))
    return n.where(F.col("shared") >= least).withColumn("kind", F.lit("shared"))


def single_hop_score(text: Column, summary: Column, entities: Column, topic: Column, degree: Column, tokens: Column) -> Column:
    """How much a chunk gives to ask about."""
    unique = F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)
    has = lambda c: F.when(c, 1.0).otherwise(0.0)
    return (
        F.least(F.length(text), F.lit(320)) / 320.0 + 0.25 * has(F.length(summary) > 0) + 0.2 * has(F.size(entities) > 0) + 0.15 * has(topic.isNotNull())
        + 0.05 * F.least(degree, F.lit(4)) + 0.2 * unique + 0.08 * has(F.size(tokens).between(12, 80))
    )


def multi_hop_score(a: Column, b: Column, kind: Column, shared: Column, other_topic: Column, summaries: Column) -> Column:
    bonus = F.when(kind == "shared", 0.25 + 0.08 * shared).otherwise(0.22)
    return (a + b) / 2 + bonus + F.when(other_topic, 0.1).otherwise(0.0) + 0.06 * summaries
