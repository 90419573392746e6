"""Percentiles of very large numeric columns, mergeable over partitions and days.

Relative-rank compactors: every level keeps a buffer; when it is full, some of
its smallest values are halved and what remains goes up a level with twice the
weight.  The largest values of a level are protected, so the error of a rank is
a fraction of the number of values *above* it: percentiles near the maximum are
nearly exact, at any size.

Sketches are made per partition, merged in two steps (so that no task merges
the sketches of all partitions), kept as bytes, and merged again over days.

Defined results: null, NaN, infinite and negative values are left out; a
repeated id counts once; a group without values has no row; a null group label
is a group.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = 32
#: |estimated rank - rank| <= ERROR * (n - rank), in all but one of a thousand cases.
ERROR = 0.03
FLUSH_ROWS, SALTS = 200_000, 32


class Sketch:
    """Relative-rank compactors that protect the upper tail."""

    __slots__ = ("n", "levels", "states")

    def __init__(self) -> None:
        self.n = 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.states = [0]

    def _capacity(self, h: int) -> int:
        return 2 * SECTION * max(3, self.states[h].bit_length() + 1)

    def add(self, values: np.ndarray) -> Sketch:
        step = 1 << 14
        for i in range(0, len(values), step):
            part = values[i : i + step]
            self.n += len(part)
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._compress()
        return self

    def merge(self, other: Sketch) -> Sketch:
        self.n += other.n
        for h, (buffer, state) in enumerate(zip(other.levels, other.states, strict=True)):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
                self.states.append(0)
            self.levels[h] = np.concatenate([self.levels[h], buffer])
            self.states[h] |= state
        self._compress()
        return self

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= self._capacity(h):
                buffer = np.sort(self.levels[h])
                state = self.states[h]
                protected = self._capacity(h) // 2
                # sections by the trailing ones of the state; what lies beyond the capacity goes as well
                sections = (~state & (state + 1)).bit_length()
                low = len(buffer) - protected - max(0, protected - sections * SECTION)
                low -= low % 2
                if low <= 0:
                    break
                coin = ((state + 1) * 0x9E3779B97F4A7C15 + h * 0x632BE59BD9B4E019 + self.n * 0xD1B54A32D192ED03 >> 33) & 1
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], buffer[:low][coin::2]])
                self.levels[h] = buffer[low:]
                self.states[h] += 1
            h += 1

    def quantiles(self, ps: list[float]) -> list[float]:
        values = np.concatenate(self.levels)
        weights = np.repeat(2.0 ** np.arange(len(self.levels)), [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        values, above = values[order], np.cumsum(weights[order])
        at = np.searchsorted(above, np.maximum(1, np.ceil(np.array(ps) * above[-1])))
        return values[np.minimum(at, len(values) - 1)].tolist()

    def to_bytes(self) -> bytes:
        head = struct.pack("<qi", self.n, len(self.levels)) + b"".join(struct.pack("<iq", len(b), s) for b, s in zip(self.levels, self.states, strict=True))
        return head + np.concatenate(self.levels).tobytes()

    @classmethod
    def of(cls, data: bytes) -> Sketch:
        s = cls()
        s.n, k = struct.unpack_from("<qi", data)
        heads = [struct.unpack_from("<iq", data, 12 + 12 * i) for i in range(k)]
        values = np.frombuffer(data, offset=12 + 12 * k)
        cuts = np.cumsum([0] + [c for c, _ in heads])
        s.levels = [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        s.states = [x for _, x in heads]
        return s


def sketches(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, metric, sketch) of every group and value column; ``rows`` has keys and values."""
    types = dict(rows.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def made() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.concatenate([[0], np.nonzero(np.diff(codes[order]))[0] + 1, [len(order)]])
            firsts = order[starts[:-1]]
            out = []
            for v in values:
                x = pdf[v].to_numpy(dtype=float, na_value=np.nan)[order]
                for g, a, b in zip(firsts, starts, starts[1:], strict=False):
                    part = x[a:b]
                    part = part[np.isfinite(part) & (part >= 0)]
                    if len(part):
                        out.append((g, v, Sketch().add(part).to_bytes()))
            some = pd.DataFrame(out, columns=["g", "metric", "sketch"])
            return pd.concat([pdf[keys].iloc[some["g"]].reset_index(drop=True), some[["metric", "sketch"]]], axis=1)

        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= FLUSH_ROWS:
                yield made()
                held, n = [], 0
        if n:
            yield made()

    partial = rows.select(*keys, *values).mapInPandas(build, f"{head}, metric string, sketch binary")
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return merged(merged(salted, [*keys, "metric", "salt"]).drop("salt"), [*keys, "metric"])


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch of every group of sketches."""
    types = dict(parts.dtypes)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows: equal keys follow one another, over batches too."""
        last: tuple | None = None
        sketch = Sketch()
        for pdf in batches:
            out = []
            rows = zip(*(pdf[k].tolist() for k in keys), pdf["sketch"].tolist(), strict=True)
            for *key, data in rows:
                key = tuple(None if k is None or k != k else k for k in key)
                if key == last:
                    sketch.merge(Sketch.of(data))
                    continue
                if last is not None:
                    out.append((*last, sketch.to_bytes()))
                last, sketch = key, Sketch.of(data)
            yield pd.DataFrame(out, columns=[*keys, "sketch"])
        if last is not None:
            yield pd.DataFrame([(*last, sketch.to_bytes())], columns=[*keys, "sketch"])

    at = parts.select(*keys, "sketch").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return at.mapInPandas(merge, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", sketch binary")


def percentiles(sketched: DataFrame, ps: dict[str, float]) -> DataFrame:
    """The sketches' columns with n and a column for every percentile; the sketch stays, so that rows can be merged again."""
    schema = ", ".join(f"`{k}` {t}" for k, t in sketched.dtypes if k != "sketch") + ", n long, " + ", ".join(f"{c} double" for c in ps) + ", sketch binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            all_ = [Sketch.of(b) for b in pdf["sketch"]]
            q = np.array([s.quantiles(list(ps.values())) for s in all_]).reshape(-1, len(ps))
            yield pdf.assign(n=[s.n for s in all_], **{c: q[:, i] for i, c in enumerate(ps)})

    return sketched.mapInPandas(read, schema)
