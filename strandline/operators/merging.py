"""Merging of entity and edge records, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

SEPARATOR = "<SEP>"


def distinct_joined(c: Column, sep: str = SEPARATOR) -> Column:
    """Distinct values that are not blank, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(c) != "", c))), sep)


def majority(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value): the most frequent value, of equals the first in order; null if all are."""
    n = rows.groupBy(*key, value).agg(F.count(value).alias("n"))
    return n.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def entities(mentions: DataFrame, longest: bool = True) -> DataFrame:
    """(name, type, description, sources, n) of (name, type, description, source).

    The description is the longest, of equals the first in order, or all distinct ones joined.
    """
    d = F.when(F.trim("description") != "", F.col("description"))
    kept = F.min_by(d, F.when(d.isNotNull(), F.struct(-F.length(d), d))) if longest else distinct_joined(F.col("description"))
    made = mentions.groupBy("name").agg(kept.alias("description"), distinct_joined(F.col("source")).alias("sources"), F.count("*").alias("n"))
    return made.join(majority(mentions, ["name"], "type"), "name")


def edges(rows: DataFrame, how: str = "sum", directed: bool = True) -> DataFrame:
    """(src, dst, weight, n): parallel edges merged by the sum or the largest of their weights."""
    w = F.sum("weight") if how == "sum" else F.max("weight")
    if not directed:
        rows = rows.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return rows.groupBy("src", "dst").agg(w.alias("weight"), F.count("*").alias("n"))


def with_placeholders(nodes: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Adds (name, type) UNKNOWN for endpoints without a record."""
    ends = edge_rows.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return nodes.select("name", "type").unionByName(ends.join(nodes, "name", "left_anti").withColumn("type", F.lit("UNKNOWN")))


def keep_best(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of every key, the first in the order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge: a new value where there is one, else the old."""
    columns = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def renamed(edge_rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by (old, new) of ``mapping``; loops dropped, doubles merged."""
    a = mapping.select(F.col("old").alias("src"), F.col("new").alias("_s"))
    b = mapping.select(F.col("old").alias("dst"), F.col("new").alias("_d"))
    out = edge_rows.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "weight")
    return edges(out.where("src <> dst"))


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of every row in an order over the whole table, from 1, without one task for all of it.

    The table is sorted by ranges; rows are numbered within their range, and
    the sizes of the ranges (one row each) are added up before them.
    """
    ranges = checkpointed(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = ranges.withColumn("_within", within).join(F.broadcast(sizes.select("_range", "_before")), "_range")
    return placed.withColumn(name, (F.col("_within") + F.col("_before")).cast("int")).drop("_range", "_within", "_before")
