"""A sample whose categories have wanted shares.

The table of cells (combinations of labels) is small and made by a partial
aggregation; raking, allocation and repair work on it, one target set at a
time.  Rows only ever meet a per-cell weight and a threshold: weighted
exponential keys are histogrammed, the threshold is read from the running sum
of the histogram, and only rows in the threshold's own bucket are ranked, so
that a category with a third of all rows is never sorted in one task.

Defined results: ids count once; labels are compared ignoring case and blanks
at the ends; rows with a null label are in no cell; a cell that has fewer rows
than wanted gives all of them and is reported; an empty table gives an empty
sample and a report of gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

BUCKETS = 64  # of the histogram, per unit of the keys' logarithm


def label(c: str) -> Column:
    return F.lower(F.trim(F.col(c).cast("string")))


def rake(cells: pd.DataFrame, dims: list[str], rounds: int = 200) -> np.ndarray:
    """Expected rows of every cell by iterative proportional fitting.

    The weights begin at the rows there are and are fitted in turn to the margin
    of every label: the sum of the target shares of its cells.  A cell cannot
    give more than it has: full cells are fixed, and the rest is fitted again.
    """
    have = cells["available"].to_numpy(dtype=float)
    share = cells["target_permille"].to_numpy(dtype=float)
    share = share / max(share.sum(), 1e-12)
    size = min(float(cells["sample_size"].max()), have.sum())
    margins = [cells.groupby(d, dropna=False).ngroup().to_numpy() for d in dims]
    full = np.zeros(len(cells), dtype=bool)
    w = np.zeros(len(cells))
    while True:
        free = ~full & (have > 0) & (share > 0)
        left = size - have[full].sum()
        if left <= 1e-9 or not free.any():
            break
        w = np.where(free, have, 0.0)
        w *= left / w.sum()
        want = np.where(free, share, 0)
        want = want / want.sum() * left
        for _ in range(rounds):
            worst = 0.0
            for m in margins:
                target, now = np.bincount(m, want), np.bincount(m, w)
                scale = np.divide(target, now, out=np.ones_like(target), where=now > 0)
                worst = max(worst, float(np.abs(scale - 1).max()))
                w = w * scale[m]
            if worst < 1e-9:
                break
        over = free & (w > have + 1e-9)
        if not over.any():
            break
        full |= over
    return np.where(full, have, np.minimum(w, have))


def repair(cells: pd.DataFrame) -> np.ndarray:
    """Final rows of every cell: the drawn ones, filled up to what is wanted; the sum is brought to the sample's size at one level.

    Every cell gets its drawn rows and the level, between what is wanted of it
    and what it has.  Only where the wanted rows alone (they are rounded up)
    exceed the sample's size is it exceeded.
    """
    have = cells["available"].to_numpy(dtype=int)
    drawn = np.minimum(cells["drawn"].to_numpy(dtype=int), have)
    least = np.minimum(cells["wanted"].to_numpy(dtype=int), have)
    size = max(min(int(cells["sample_size"].max()), int(have.sum())), int(least.sum()))

    def at(level: int) -> np.ndarray:
        return np.clip(drawn + level, least, have)

    lo, hi = -int(drawn.max(initial=0)) - 1, int(have.max(initial=0)) + 1
    while hi - lo > 1:  # the highest level that does not exceed the size
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if at(mid).sum() <= size else (lo, mid)
    n, more = at(lo), at(lo + 1)
    room = np.nonzero(more > n)[0]
    n[room[: max(0, size - int(n.sum()))]] += 1
    return n


def _lowest(rows: DataFrame, group: list[str], quota: DataFrame, key: str) -> DataFrame:
    """The ``quota`` rows of least ``key`` in every group, exactly, ranking one bucket of each only."""
    rows = rows.withColumn("bucket", F.floor(F.log(F.col(key)) * BUCKETS))
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        rows.groupBy(*group, "bucket").agg(F.count("*").alias("c"))
        .withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))
        .join(F.broadcast(quota), group)
        .where("before < quota")
        .select(*group, "bucket", "before", "quota", (F.col("before") + F.col("c") <= F.col("quota")).alias("whole"))
    )
    kept = rows.join(cut, [*group, "bucket"])
    last = Window.partitionBy(*group, "bucket").orderBy(key, "id")
    edge = kept.where("not whole").withColumn("r", F.row_number().over(last)).where("r <= quota - before").drop("r")
    return kept.where("whole").unionByName(edge).drop("bucket", "before", "quota", "whole")


def proportion_sample(rows: DataFrame, targets: DataFrame, dims: list[str], id_col: str = "id", seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    ``targets`` has target_id, target_set, ``dims``, target_permille, min_rows and sample_size.
    The sample has target_set, id and the labels; the report, of every target cell,
    what was wanted, available and sampled, and the gap that remains.
    """
    names, dims = dims, [f"dim{i}" for i in range(len(dims))]  # whatever the labels are called
    members = rows.select(F.col(id_col).cast("string").alias("id"), *[label(d).alias(i) for d, i in zip(names, dims, strict=True)]).dropna().distinct()
    available = members.groupBy(*dims).agg(F.count("*").alias("available"))
    wanted = F.greatest("min_rows", F.expr("cast((target_permille * sample_size + 999) div 1000 as int)"))
    goals = targets.select("target_id", "target_set", *[label(d).alias(i) for d, i in zip(names, dims, strict=True)], "target_permille", "min_rows", "sample_size", wanted.alias("wanted"))
    cells = goals.join(available, dims, "left").fillna(0, ["available"])
    cell_schema = ", ".join(f"{n} {t}" for n, t in cells.dtypes)

    def raked(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(expected=rake(pdf, dims))

    planned = checkpointed(cells.groupBy("target_set").applyInPandas(raked, cell_schema + ", expected double"))

    # weighted exponential keys: -ln(u) / weight, u from the id and the target set
    weights = F.broadcast(planned.select("target_set", *dims, "sample_size", "expected", "available").where("expected > 0 or min_rows > 0"))
    u = (F.pmod(F.xxhash64("id", "target_set", F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    drawn_from = members.join(weights, dims).withColumn("e", -F.log(u) + 1e-300)
    keyed = drawn_from.where("expected > 0").withColumn("key", F.col("e") * F.col("available") / F.col("expected"))
    sizes = planned.groupBy("target_set").agg(F.max("sample_size").alias("quota"))
    drawn = _lowest(keyed.select("target_set", "id", *dims, "key"), ["target_set"], sizes, "key")
    counts = drawn.groupBy("target_set", *dims).agg(F.count("*").alias("drawn"))
    with_counts = planned.join(counts, ["target_set", *dims], "left").fillna(0, ["drawn"])

    def repaired(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(quota=repair(pdf))

    final = checkpointed(with_counts.groupBy("target_set").applyInPandas(repaired, ", ".join(f"{n} {t}" for n, t in with_counts.dtypes) + ", quota long"))
    quotas = final.where("quota > 0").select("target_set", *dims, "quota")
    sample = _lowest(drawn_from.select("target_set", "id", *dims, "e"), ["target_set", *dims], quotas, "e").drop("e")
    got = sample.groupBy("target_set", *dims).agg(F.count("*").alias("sampled"))
    report = final.join(got, ["target_set", *dims], "left").fillna(0, ["sampled"]).withColumn("gap", F.greatest(F.lit(0), F.col("wanted") - F.col("sampled")))
    back = [F.col(i).alias(d) for d, i in zip(names, dims, strict=True)]
    return sample.select("target_set", "id", *back), report.select("target_id", "target_set", *back, "target_permille", "sample_size", "min_rows", "wanted", "available", "drawn", "sampled", "gap")
