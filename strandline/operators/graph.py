"""Graph algorithms over edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

CUT_EVERY = 3  # rounds between checkpoints of an iteration


def both_ways(edges: DataFrame) -> DataFrame:
    other = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(other)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, indegree, outdegree)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("indegree"), F.sum("x.o").alias("outdegree"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, reset: DataFrame | None = None, return_dangling: bool = False, tolerance: float | None = None) -> DataFrame:
    """(node, rank) over directed weighted edges, after so many rounds or once the ranks settle.

    ``reset`` (node, weight) makes it personalised; with ``return_dangling`` the rank of
    nodes without an edge goes back to the reset distribution, else it is lost.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if reset is None:
        n = nodes.count()
        base = nodes.withColumn("restart", F.lit(1.0 / max(n, 1)))
        start = base.withColumn("rank", F.col("restart"))
    else:
        total = reset.agg(F.sum("weight")).first()[0] or 1.0
        given = reset.groupBy("node").agg((F.sum("weight") / total).alias("restart"))
        base = nodes.join(given, "node", "left").fillna(0.0, ["restart"])
        n = nodes.count()
        start = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    base, ranks = checkpointed(base), checkpointed(start.select("node", "rank"))
    dead = checkpointed(nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti")) if return_dangling else None
    for i in range(rounds):
        came = shares.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        lost = F.lit(0.0)
        if dead is not None:
            lost = F.lit(ranks.join(dead, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0])
        new = base.join(came, "node", "left").select("node", ((1 - damping) * F.col("restart") + damping * (F.coalesce("came", F.lit(0.0)) + lost * F.col("restart"))).alias("rank"))
        if tolerance is not None or (i + 1) % CUT_EVERY == 0:
            new = checkpointed(new)
        if tolerance is not None:
            moved = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
            ranks = new
            if moved < tolerance:
                break
        ranks = new
    return ranks


def reachable(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hops): nodes within so many directed steps, with the least number; the seed itself at 0."""
    found = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"))
    edge = edges.select(F.col("src").alias("node"), "dst").distinct()
    front = found
    for h in range(1, hops + 1):
        step = front.select("seed", "node").join(edge, "node").select("seed", F.col("dst").alias("node")).distinct()
        front = step.join(found.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(h))
        if h % CUT_EVERY == 0:
            front = checkpointed(front)
        found = found.unionByName(front)
    return found


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each weakly connected part.

    Labels are passed over edges, and then to the label's own label, so that
    chains shorten by more than half in every round.
    """
    e = checkpointed(both_ways(edges.select("src", "dst")).where("src <> dst").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = checkpointed(nodes.withColumn("label", F.col("node")))
    for _ in range(most_rounds):
        near = e.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        over = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = checkpointed(step.join(over, "label").select("node", F.least("label", "next").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"labels still move after {most_rounds} rounds")


def simple_paths(edges: DataFrame, seeds: DataFrame, most: int, targets: DataFrame | None = None) -> DataFrame:
    """(path) of 1 to ``most`` directed edges from the seeds without a repeated node; a path that meets a target stops."""
    edge = edges.select("src", "dst").distinct()
    now = seeds.select(F.array("node").alias("path"), F.col("node").alias("src"), F.lit(False).alias("done"))
    found = None
    for _ in range(most):
        step = now.where(~F.col("done")).join(edge, "src").where(~F.array_contains("path", F.col("dst")))
        now = step.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("src"))
        if targets is None:
            now = now.withColumn("done", F.lit(False))
        else:
            hit = targets.select(F.col("node").alias("src"), F.lit(True).alias("hit")).distinct()
            now = now.join(hit, "src", "left").select("path", "src", F.coalesce("hit", F.lit(False)).alias("done"))
        kept = now.select("path") if targets is None else now.where("done").select("path")
        found = kept if found is None else found.unionByName(kept)
    return found


def path_flow(paths: DataFrame, decay: float = 0.8, threshold: float = 0.3) -> DataFrame:
    """(path, score): resources flow from a source over the union of its paths.

    A source gives each successor an equal part; what a node received, if above
    the threshold, goes on with the decay.  A path's score is the mean of its
    edges' flows.
    """
    p = paths.select("path", F.col("path")[0].alias("s"))
    steps = p.select("s", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))).alias("level", "e"))
    edges = steps.select("s", "level", "e.a", "e.b").distinct()
    follow = edges.select("s", "a", "b").distinct().groupBy("s", "a").agg(F.count("*").alias("n"))
    by_level = edges.join(follow, ["s", "a"])
    flow = by_level.where("level = 0").select("s", "level", "a", "b", (1.0 / F.col("n")).alias("flow"))
    total = flow
    deepest = paths.agg(F.max(F.size("path"))).first()[0] or 2
    for level in range(1, deepest - 1):
        got = flow.groupBy("s", F.col("b").alias("a")).agg(F.sum("flow").alias("got")).where(F.col("got") > threshold)
        flow = by_level.where(F.col("level") == level).join(got, ["s", "a"]).select("s", "level", "a", "b", (F.col("got") * decay / F.col("n")).alias("flow"))
        total = total.unionByName(flow)
    edge_flow = total.groupBy("s", "a", "b").agg(F.sum("flow").alias("flow"))
    at = p.select("path", "s", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))).alias("e")).select("path", "s", "e.a", "e.b")
    return at.join(edge_flow, ["s", "a", "b"], "left").groupBy("path").agg(F.avg(F.coalesce("flow", F.lit(0.0))).alias("score"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_anti").join(n.withColumnRenamed("node", "dst"), "dst", "left_anti")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): every round all nodes take their neighbours' most frequent label, the least of equals."""
    e = checkpointed(both_ways(edges.select("src", "dst")).distinct())
    labels = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node"))
    for i in range(rounds):
        votes = e.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
        labels = checkpointed(best) if (i + 1) % CUT_EVERY == 0 else best
    return labels.select("node", F.col("label").alias("community"))


def has_cycle(edges: DataFrame) -> bool:
    """Nodes without an incoming edge are peeled off until none is left, or none can be."""
    left = checkpointed(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        left = checkpointed(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        m = left.count()
        if m == n:
            return True
        n = m
    return False


def depths(children: DataFrame, most: int = 64) -> DataFrame:
    """(child, depth) of a hierarchy (child, parent): steps to the root.  A cycle, or more than ``most`` levels, is an error."""
    up = children.select("child", "parent")
    now = up.select("child", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    for i in range(most):
        above = up.select(F.col("child").alias("at"), F.col("parent").alias("next"))
        new = now.join(above, "at", "left").select("child", F.col("next").alias("at"), (F.col("depth") + F.col("next").isNotNull().cast("int")).alias("depth"))
        now = checkpointed(new)
        if not now.where("at is not null").limit(1).count():
            return now.select("child", "depth")
    raise RuntimeError(f"a hierarchy of more than {most} levels, or a cycle")


def popular(edges: DataFrame, k: int) -> DataFrame:
    d = degrees(edges).withColumn("degree", F.col("indegree") + F.col("outdegree"))
    return d.orderBy(F.desc("degree"), "node").limit(k).select("node", "degree")


def expanded(pool: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(src, dst): seed triples, and those of the pool that share an end with one of the step before, ``hops`` times."""
    pool = pool.select("src", "dst").distinct()
    found = seeds.select("src", "dst").distinct()
    for i in range(hops):
        ends = found.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        near = pool.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(pool.join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        found = found.unionByName(near).distinct()
        if (i + 1) % CUT_EVERY == 0:
            found = checkpointed(found)
    return found


def children(edges: DataFrame, seeds: DataFrame, kind: str, levels: int) -> DataFrame:
    """(node, level): nodes that edges of a kind lead to within so many levels, with the first."""
    down = reachable(edges.where(F.col("kind") == kind), seeds, levels)
    return down.where("hops > 0").groupBy("node").agg(F.min("hops").alias("level"))


def alternating(a: Column, b: Column, dim: int) -> Column:
    """A vector of two numbers in turn."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, a.cast("double")).otherwise(b.cast("double")))
