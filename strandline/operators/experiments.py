"""Aggregation of experiment results: summaries, percentiles, unknown detection, parity, allocation, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Results that failed count as rows and not in means.
MEANS = ("exact_match", "precision", "recall", "f1", "bert_score_f1", "support_recall_at5", "bridge_coverage_at5", "mrr_at5", "ndcg_at5", "faithfulness", "response_groundedness")
LATENCIES = ("index_latency_ms", "query_latency_ms")


def finite(c: str) -> Column:
    x = F.col(c)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ok() -> Column:
    return F.coalesce(F.trim("error"), F.lit("")) == ""


def mean(c: str, where: Column | None = None) -> Column:
    """Mean of the finite values of rows without an error; 0 where there are none."""
    good = ok() if where is None else ok() & where
    return F.coalesce(F.avg(F.when(good, finite(c))), F.lit(0.0))


BUCKETS = 256  # of a factor of e


def exact_percentiles(rows: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """(by, one column for each of ``ps``): percentiles with linear interpolation, without a group in one task.

    Values are counted in buckets that keep their order; from the running
    counts follows in which buckets the wanted ranks lie, and only the values
    of those are put in order.  Null and NaN are left out.
    """
    x = F.col(value)
    bucket = (F.signum(x) * (F.floor(F.log(F.abs(x)) * BUCKETS) + 1_000_000)).cast("long")
    given = rows.where(x.isNotNull() & ~F.isnan(x)).select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], x.alias("x"), F.when(x == 0, 0).otherwise(bucket).alias("bucket"))
    keys = [f"g{i}" for i in range(len(by))]
    values = given.groupBy(*keys, "bucket", "x").agg(F.count("*").alias("c"))
    counts = values.groupBy(*keys, "bucket").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # buckets of a group, bounded by the range of doubles
    running = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("c").over(running)).withColumn("n", F.sum("c").over(w)).withColumn("before", F.col("upto") - F.col("c"))
    ranks = F.array(*[F.struct(F.lit(name).alias("p"), ((F.col("n") - 1) * q).alias("at")) for name, q in ps.items()])
    wanted = counts.withColumn("r", F.explode(ranks)).select(*keys, "bucket", "before", "upto", "r.p", "r.at")
    wanted = wanted.where((F.col("upto") > F.floor("at")) & (F.col("before") <= F.ceil("at")))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    hot = values.alias("v").join(F.broadcast(wanted.select(*keys, "bucket", "before").distinct()).alias("w"), [*same("v", "w"), F.col("v.bucket") == F.col("w.bucket")])
    order = Window.partitionBy(*[f"v.{k}" for k in keys], "v.bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hot.select(*[f"v.{k}" for k in keys], F.col("v.bucket").alias("bucket"), "x", (F.sum("v.c").over(order) + F.col("before")).alias("upto"), F.col("v.c").alias("c"))
    at = ranked.alias("r").join(F.broadcast(wanted.drop("before", "upto")).alias("w"), [*same("r", "w"), F.col("r.bucket") == F.col("w.bucket")])
    holds = lambda rank: (F.col("r.upto") > rank) & (F.col("r.upto") - F.col("r.c") <= rank)
    lo, hi = F.max(F.when(holds(F.floor("at")), F.col("x"))), F.max(F.when(holds(F.ceil("at")), F.col("x")))
    share = F.first("at") - F.floor(F.first("at"))
    each = at.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys], "p").agg((lo + (hi - lo) * share).alias("q"))
    out = each.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == name, F.col("q"))).alias(name) for name in ps])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *ps)


def summary(results: DataFrame, by: list[str], percentiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Counts, means and latency percentiles (linear interpolation) of every group."""
    cells = [F.count("*").alias("samples"), F.count(F.when(~ok(), 1)).alias("errors")]
    cells += [F.round(mean(c), 10).alias(f"{c}_avg") for c in MEANS]
    good = lambda c: F.when(ok() & (finite(c) >= 0), finite(c))
    cells += [F.round(F.avg(good(c)), 9).alias(f"{c}_avg") for c in LATENCIES]
    out = results.groupBy(*by).agg(*cells)
    for c in LATENCIES:
        names = {f"{c}_p{round(100 * p)}": p for p in percentiles}
        q = exact_percentiles(results.select(*by, good(c).alias(c)), by, c, names).select(*[F.col(b).alias(f"_{b}") for b in by], *[F.round(n, 9).alias(n) for n in names])
        match = F.lit(True)
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_{b}"))
        out = out.join(q, match, "left").drop(*[f"_{b}" for b in by])
    return out


def unknown_detection(rows: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of saying unknown where the label says so (``predicted``, ``label_unknown``)."""
    tp = F.count(F.when(F.col("predicted") & F.col("label_unknown"), 1))
    fp = F.count(F.when(F.col("predicted") & ~F.col("label_unknown"), 1))
    fn = F.count(F.when(~F.col("predicted") & F.col("label_unknown"), 1))
    n = rows.where("label_unknown is not null").groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return n.select(*by, "tp", "fp", "fn", *[F.round(F.coalesce(x, F.lit(0.0)), 6).alias(c) for c, x in (("precision", p), ("recall", r), ("f1", f1))])


def macro(rows: DataFrame, by: list[str], within: str, value: str) -> DataFrame:
    """Mean over categories of the mean within each."""
    inner = rows.groupBy(*by, within).agg(mean(value).alias("m"))
    return inner.groupBy(*by).agg(F.round(F.avg("m"), 6).alias(f"{value}_macro"), F.count("*").alias("categories"))


def parity(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row per value: rows on either side only, mean and largest absolute difference of the others."""
    a = left.select(*key, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("in_a"))
    b = right.select(*key, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("in_b"))
    j = a.join(b, key, "full_outer")
    kinds = F.array(*[F.struct(F.lit(v).alias("metric"), F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")).alias("diff")) for v in values])
    long = j.select("in_a", "in_b", F.explode(kinds).alias("x"))
    return long.groupBy("x.metric").agg(
        F.count(F.when(F.col("in_b").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("only_right"),
        F.round(F.avg("x.diff"), 6).alias("mean_diff"), F.round(F.max("x.diff"), 6).alias("max_diff"),
    )


def tertiles(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``bucket``: low up to the first tertile, mid up to the second, else high; null for null."""
    cuts = exact_percentiles(rows, [], value, {"_lo": 1 / 3, "_hi": 2 / 3})  # one row
    x = rows.join(F.broadcast(cuts), F.lit(True), "left")
    return x.withColumn("bucket", F.when(F.col(value) <= F.col("_lo"), "low").when(F.col(value) <= F.col("_hi"), "mid").when(F.col(value).isNotNull(), "high")).drop("_lo", "_hi")


def quotas(capacity: dict[str, int], wanted: int) -> dict[str, int]:
    """Equal parts by water filling: what a small group cannot give goes to the others, in name order."""
    out = dict.fromkeys(sorted(capacity), 0)
    left = min(wanted, sum(capacity.values()))
    while left:
        free = [g for g in out if out[g] < capacity[g]]
        share = max(1, left // len(free))
        for g in free:
            take = min(share, capacity[g] - out[g], left)
            out[g] += take
            left -= take
            if not left:
                break
    return out


def balanced(rows: DataFrame, group: str, key: str, wanted: int, seed: int = 5) -> DataFrame:
    """An equal-quota sample over the groups, by the order of a hash."""
    sizes = {r[group]: r["n"] for r in rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).collect()}
    spark = rows.sparkSession
    q = spark.createDataFrame(list(quotas(sizes, wanted).items()), f"`{group}` string, quota int")
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return rows.withColumn("place", F.row_number().over(w)).join(F.broadcast(q), group).where("place <= quota").drop("quota")


def round_robin(rows: DataFrame, group: str, order: list[Column], wanted: int) -> DataFrame:
    """One row of every group per round, larger groups first, until there are enough."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", place).where(F.col("turn") <= wanted).join(sizes, group).orderBy("turn", F.desc("n"), group).limit(wanted).drop("n")
