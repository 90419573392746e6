"""Filling containers of fixed capacity with items of varying length.

Harmonic packing: lengths in (C / (j + 1), C / j] are class j, and a container
of class j takes j of them, whatever they are; the last class (of at most
C / ``CLASSES``) fills its containers one after another.  Which container an
item goes to depends on its class and its number within the class only, so
workers pack their own items without knowing of the others.

Harmonic classes alone leave a fifth of the space empty.  An extra step, gap
filling, comes before the classes for items of at most C / ``GAP_CLASS``: such an
item goes into the smallest gap of the worker's finished containers that takes
it, and only otherwise to a container of its class.  ``fill_gaps=False`` leaves
the step out.

An item larger than a container is divided into full pieces and a rest, which
is packed like any other; nothing else is ever divided.

Defined results: items of length 0 or null are packed nowhere; equal lengths
and repeated rows are separate items; every worker leaves at most one container
of every class unfinished for each ``ROUND_ROWS`` of its items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 12  # the last takes all that is smaller
GAP_CLASS = 4  # items of this class and smaller ones fill gaps first
ROUND_ROWS = 1_000_000  # items that a worker packs at once, largest first


def packed(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "size", fill_gaps: bool = True) -> DataFrame:
    """(key, piece, size, container) of every item; items that were divided have pieces 0, 1, ...

    ``container`` is a string, the same for all that is in one.
    """
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("k"), F.col(size).cast("long").alias("s"), F.spark_partition_id().alias("p")).where("s > 0")

    def rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            while len(pdf):
                part = pdf.iloc[: ROUND_ROWS - n]
                pdf = pdf.iloc[len(part) :]
                held.append(part)
                n += len(part)
                if n == ROUND_ROWS:
                    yield pd.concat(held, ignore_index=True)
                    held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = 0
        for pdf in rounds(batches):
            open_ = {j: [0, 0, 0] for j in range(1, CLASSES + 1)}  # container, items in it, free space
            gaps: list[tuple[int, int]] = []  # (free space, container) of finished containers
            out, rest = [], []
            p = int(pdf["p"].iloc[0])
            for k, s in zip(pdf["k"].tolist(), pdf["s"].tolist(), strict=True):
                piece = 0
                while s > capacity:
                    made += 1
                    out.append((k, piece, capacity, made))
                    s -= capacity
                    piece += 1
                rest.append((s, k, piece))
            rest.sort(key=lambda r: -r[0])  # gaps are there before what is to fill them
            for s, k, piece in rest:
                j = min(capacity // s, CLASSES)
                if fill_gaps and j >= GAP_CLASS:
                    i = bisect_left(gaps, (s, 0))
                    if i < len(gaps):
                        free, container = gaps.pop(i)
                        out.append((k, piece, s, container))
                        if free > s:
                            insort(gaps, (free - s, container))
                        continue
                at = open_[j]
                if at[1] and at[2] < s:  # the last class: full
                    if at[2]:
                        insort(gaps, (at[2], at[0]))
                    at[1] = 0
                if at[1] == 0:
                    made += 1
                    at[0], at[2] = made, capacity
                at[1] += 1
                at[2] -= s
                out.append((k, piece, s, at[0]))
                if j < CLASSES and at[1] == j:
                    if at[2]:
                        insort(gaps, (at[2], at[0]))
                    at[1] = 0
            done = pd.DataFrame(out, columns=["k", "piece", "size", "c"])
            yield pd.DataFrame({"k": done["k"].astype(pdf["k"].dtype), "piece": done["piece"].astype("int32"), "size": done["size"].astype("int64"), "container": f"{p}-" + done["c"].astype(str)})

    return rows.mapInPandas(pack, f"k {kind}, piece int, size long, container string").withColumnRenamed("k", key)
