"""Community hierarchies, their reports, and the selection of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .graph import both_ways, degrees, label_propagation
from .merging import edges as merged_edges


def hierarchy(edges: DataFrame, levels: int = 3, rounds: int = 4) -> DataFrame:
    """(level, node, community): label propagation on the graph, then on the graph of its communities, and so on.

    At every level ``node`` is a community of the level below (a vertex at level
    0), so (community, node) is the tree's parent and child.
    """
    made, now = None, edges.select("src", "dst", "weight")
    for level in range(levels):
        c = checkpointed(label_propagation(now, rounds))
        part = c.withColumn("level", F.lit(level)).select("level", "node", "community")
        made = part if made is None else made.unionByName(part)
        to = c.select(F.col("node").alias("src"), F.col("community").alias("a"))
        of = c.select(F.col("node").alias("dst"), F.col("community").alias("b"))
        up = now.join(to, "src").join(of, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
        now = checkpointed(merged_edges(up).select("src", "dst", "weight"))
        if not now.limit(1).count():
            break
    return made


def reports(edges: DataFrame, assignment: DataFrame, members: int = 5) -> DataFrame:
    """(community, size, inner_weight, report): a plain report of every community, its best-linked members first."""
    d = degrees(edges).select("node", (F.col("indegree") + F.col("outdegree")).alias("k"))
    a = assignment.select("node", "community")
    best = a.join(d, "node").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("k"), "node"))).where(F.col("r") <= members)
    names = best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]), ", ").alias("names"))
    size = a.groupBy("community").agg(F.count("*").alias("size"))
    inner = edges.join(a.toDF("src", "community"), "src").join(a.toDF("dst", "other"), "dst").where("community = other").groupBy("community").agg(F.sum("weight").alias("inner_weight"))
    text = F.format_string("%d members, among them %s. Links within: %.1f.", "size", "names", "inner_weight")
    return size.join(names, "community").join(inner, "community", "left").fillna(0.0, ["inner_weight"]).select("community", "size", "inner_weight", text.alias("report"))


def selected_reports(tree: DataFrame, rating: DataFrame, top: int, threshold: float, keep_parent: bool = False) -> DataFrame:
    """(level, community) from the top down: children of communities rated at least ``threshold`` are rated in turn.

    ``tree`` is (level, node, community), ``rating`` (level, community, rating).
    A parent gives way to its good children unless it is to be kept.
    """
    good = rating.where(F.col("rating") >= threshold).select("level", "community")
    now = good.where(F.col("level") == top)
    out = None
    for level in range(top, -1, -1):
        children = tree.where(F.col("level") == level).join(now.select("community"), "community").select("community", F.col("node").alias("child"))
        below = good.where(F.col("level") == level - 1).select(F.col("community").alias("child"))
        going = checkpointed(children.join(below, "child")) if level else None
        stay = now if keep_parent or going is None else now.join(going.select("community").distinct(), "community", "left_anti")
        stay = stay.select(F.lit(level).alias("level"), "community")
        out = stay if out is None else out.unionByName(stay)
        if going is None:
            break
        now = going.select(F.col("child").alias("community")).distinct()
    return out


def greedy_bins(rows: DataFrame, group: list[str], order: list[str], cost: str, most: int) -> DataFrame:
    """Adds ``bin``: rows in order, a new bin where the cost would exceed ``most``; a group is a query's rows."""
    item = F.struct(*order, F.col(cost).cast("long").alias("_cost"), F.struct(*[c for c in rows.columns]).alias("_row"))
    start = F.struct(F.array().cast("array<int>").alias("bins"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("spent"))

    def add(acc: Column, x: Column) -> Column:
        close = (acc["spent"] > 0) & (acc["spent"] + x["_cost"] > most)
        b = acc["bin"] + close.cast("int")
        return F.struct(F.array_append(acc["bins"], b).alias("bins"), b.alias("bin"), F.when(close, x["_cost"]).otherwise(acc["spent"] + x["_cost"]).alias("spent"))

    g = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    g = g.withColumn("_bins", F.aggregate("_items", start, add, lambda acc: acc["bins"]))
    return g.select(F.explode(F.arrays_zip("_items", "_bins")).alias("x")).select("x._items._row.*", F.col("x._bins").alias("bin"))


def undirected(edges: DataFrame) -> DataFrame:
    return merged_edges(both_ways(edges)).select("src", "dst", "weight")
