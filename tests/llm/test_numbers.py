"""Sampling, neighbours, percentiles and packing."""

import datetime
from collections import Counter

import numpy as np
import pandas as pd

from strandline.llm import neighbours as N
from strandline.llm import packing as K
from strandline.llm import proportions as S
from strandline.llm import quantiles as Q
from strandline.llm import queries


def test_raking_fits_every_margin():
    rng = np.random.default_rng(3)
    cells = pd.DataFrame([(a, b) for a in "xyz" for b in range(4)], columns=["a", "b"]).assign(available=rng.integers(400, 900, 12), sample_size=500, min_rows=1)
    share = rng.integers(1, 100, 12)
    cells["target_permille"] = share * 1000 // share.sum()
    w = S.rake(cells, ["a", "b"])
    want = cells["target_permille"] / cells["target_permille"].sum() * 500
    for d in ("a", "b"):
        assert np.allclose(pd.Series(w).groupby(cells[d]).sum(), want.groupby(cells[d]).sum(), atol=1e-5)
    # the weights keep the odds ratios of the rows there are: the cells themselves are no margin
    odds = lambda v: v[0] * v[5] / (v[1] * v[4])
    assert abs(odds(w) / odds(cells["available"].to_numpy(float)) - 1) < 1e-6


def test_raking_and_repair():
    cells = pd.DataFrame({"a": ["x", "x", "y", "y"], "b": [1, 2, 1, 2], "available": [100, 100, 100, 3], "target_permille": [100, 200, 300, 400], "sample_size": 100, "min_rows": 5})
    w = S.rake(cells, ["a", "b"])
    assert abs(w.sum() - 100) < 1e-6 and w[3] == 3
    n = S.repair(cells.assign(expected=w, drawn=[40, 30, 27, 3], wanted=[10, 20, 30, 40]))
    assert n.sum() == 100 and (n[:3] >= [10, 20, 30]).all() and n[3] == 3
    # wanted rows alone exceed the size; nothing is there
    assert S.repair(cells.assign(expected=w, drawn=[50, 50, 0, 0], wanted=[60, 60, 0, 0])).tolist() == [60, 60, 0, 0]
    assert S.repair(cells.assign(expected=w, drawn=0, wanted=5, available=0)).tolist() == [0, 0, 0, 0]


def test_sample_meets_targets_or_reports(spark):
    rows = [(f"i{k}", " Hot " if k % 3 else "hot", 2) for k in range(900)] + [(f"j{k}", "rare", 3) for k in range(7)] + [("n", None, 2), ("i0", "HOT", 2)]
    df = spark.createDataFrame(rows, "id string, bucket string, hops int").withColumn("available", S.F.lit("x"))
    targets = spark.createDataFrame([(1, 1, "hot", 2, 600, 5, 50), (2, 1, "RARE", 3, 300, 5, 50), (3, 1, "rare", 2, 100, 2, 50)], "target_id long, target_set int, bucket string, hops int, target_permille int, min_rows int, sample_size int")
    sample, report = S.proportion_sample(df, targets, ["bucket", "hops"])
    got = {r.target_id: (r.wanted, r.available, r.sampled, r.gap) for r in report.collect()}
    assert got == {1: (30, 900, 43, 0), 2: (15, 7, 7, 8), 3: (5, 0, 0, 5)}
    ids = [r.id for r in sample.collect()]
    assert len(ids) == len(set(ids)) == 50
    none, gaps = S.proportion_sample(df.where("false"), targets, ["bucket", "hops"])
    assert none.count() == 0 and {r.sampled for r in gaps.collect()} == {0}


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 8))
    x = centre[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 8))
    x[:1000] = x[0] + 0.01 * rng.normal(size=(1000, 8))  # a third in one place
    rows = [(int(i), v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(0, x[0].tolist(), "x"), (5000, None, "x"), (5001, [], None), (5002, [0.0] * 8, "x"), (5003, [float("nan")] * 8, "x"), (5004, [1.0] * 7, "x"), (5005, [None] * 8, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, cell string")
    old = N.SLICE_Q, N.SLICE_C
    N.SLICE_Q, N.SLICE_C = 300, 700  # many slices of a block
    try:
        got = {(r.id, r.other) for r in N.most_similar(df, 5, 8, 300).collect()}
    finally:
        N.SLICE_Q, N.SLICE_C = old
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i, r in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in r}
    assert len(got & want) >= 0.95 * len(want) and len(got) == len(want)


def test_neighbours_leave_the_cells_on_the_executors(spark, monkeypatch):
    """Neither the cells nor which blocks want them become rows of the driver, or a broadcast where they are many."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))], "id long, v array<double>")
    monkeypatch.setattr(N, "SLICE_Q", 100)
    want = {tuple(r) for r in N.most_similar(df, 5, 8, 50).collect()}
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    found = N.most_similar(df, 5, 8, 50)
    assert {tuple(r) for r in found.collect()} == want and len(want) == 4500


def test_neighbours_small_and_tied(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0])], "id long, v array<double>")
    assert sorted((r.id, r.other, r["rank"]) for r in N.most_similar(df, 1, 2).collect()) == [(1, 2, 1), (2, 1, 1), (3, 1, 1)]
    assert N.most_similar(df, 5, 2).count() == 6 and N.most_similar(df.where("id = 1"), 5, 2).count() == 0


def test_neighbours_of_equal_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8))
    x[:200] = x[0]
    x[200:203] = x[300]
    x[400:402] = 2.0 * x[400]  # of another length, the same direction
    order = rng.permutation(600)
    rows = [(int(i), x[i].tolist()) for i in order]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in N.most_similar(df, 5, 8).collect():
        got.setdefault(r.id, {})[r.rank] = (r.other, r.similarity)
    assert len(got) == 600 and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    assert [o for o, _ in (got[150][k] for k in range(1, 6))] == [0, 1, 2, 3, 4] and [got[2][k][0] for k in range(1, 6)] == [0, 1, 3, 4, 5]
    assert {got[200][k][0] for k in (1, 2, 3)} == {201, 202, 300}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(0, 600, 7):
        want = np.sort(s[i])[::-1][:5]
        assert np.allclose([got[i][k][1] for k in range(1, 6)], want, atol=1e-9), i


def relative_error(values, got, p):
    v = np.sort(values)
    at = np.ceil(p * len(v))
    lo, hi = np.searchsorted(v, got, "left"), np.searchsorted(v, got, "right")
    return 0 if lo < at <= hi else min(abs(lo + 1 - at), abs(hi - at)) / max(1, len(v) - at)


def test_sketch_error_and_merge():
    rng = np.random.default_rng(2)
    x = rng.pareto(1.1, 300_000)
    whole = Q.Sketch().add(x)
    parts = [Q.Sketch.of(Q.Sketch().add(p).to_bytes()) for p in np.array_split(x, 37)]
    merged = parts[0]
    for p in parts[1:]:
        merged.merge(p)
    for s in (whole, merged):
        assert s.n == len(x) and sum(map(len, s.levels)) < 9_000
        assert sum(len(b) << h for h, b in enumerate(s.levels)) == len(x)
        for p in (0.5, 0.9, 0.99, 0.999, 0.9999):
            assert relative_error(x, s.quantiles([p])[0], p) <= Q.ERROR


def test_percentiles_of_dirty_values(spark):
    rows = [("a", "d1", float(i)) for i in range(100)] + [("a", "d2", 1000.0), ("a", "d2", None), ("a", "d1", float("nan")), ("a", "d1", float("inf")), ("a", "d1", -1.0), (None, "d1", 5.0)]
    df = spark.createDataFrame(rows, "g string, day string, x double")
    days = Q.sketches(df, ["g", "day"], ["x"])
    got = {(r.g, r.day): (r.n, r.p50, r.p99) for r in Q.percentiles(days, {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {("a", "d1"): (100, 49.0, 98.0), ("a", "d2"): (1, 1000.0, 1000.0), (None, "d1"): (1, 5.0, 5.0)}
    over = {r.g: (r.n, r.p99) for r in Q.percentiles(Q.merged(days, ["g", "metric"]), {"p99": 0.99}).collect()}
    assert over == {"a": (101, 99.0), None: (1, 5.0)}
    assert Q.sketches(df.where("false"), ["g", "day"], ["x"]).count() == 0


def test_days_of_the_result_can_be_combined(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.pareto(1.1, 12_000)
    at = [datetime.datetime(2025, 3, 1 + i // 2 % 4, 12) if i % 5 else None for i in range(len(x))]  # some have no time
    rows = [(i, "ab"[i % 2], t, float(v), None) for i, (t, v) in enumerate(zip(at, x, strict=True))]
    table = spark.createDataFrame(rows, "result_id long, condition string, finished_at timestamp, query_latency_ms double, index_latency_ms double")
    table.write.parquet(f"{tmp_path}/per_question_metrics.parquet")
    queries.p4_percentiles(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")  # what came out is all there is
    keys = [(r.condition, r.over, r.day) for r in out.collect()]
    assert len(keys) == len(set(keys)) == 12 and sum(r[1:] == ("day", None) for r in keys) == 2

    def check(days, wanted):
        ps = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
        got = Q.percentiles(Q.merged(days, ["condition", "metric"]), ps).collect()
        assert {r.condition for r in got} == {"a", "b"}
        for r in got:
            own = np.array([v for i, (t, v) in enumerate(zip(at, x, strict=True)) if "ab"[i % 2] == r.condition and wanted(t)])
            assert r.n == len(own) and all(relative_error(own, r[c], p) <= Q.ERROR for c, p in ps.items())

    check(out.where("over = 'day'"), lambda t: True)
    check(out.where("day in ('2025-03-01', '2025-03-02', '2025-03-03')"), lambda t: t and t.day < 4)
    check(out.where("over = 'all days'"), lambda t: True)


def test_packing_invariants(spark):
    rng = np.random.default_rng(6)
    sizes = [int(s) for s in rng.lognormal(6, 1.2, 4000)] + [4096, 4097, 8192, 0, None, 40_000, 2048, 2048]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, size long, container string").repartition(3)
    out = K.packed(items, 4096).toPandas()
    fill = out.groupby("container")["size"].sum()
    assert fill.max() <= 4096 and fill.sum() / (len(fill) * 4096) > 0.97
    total = out.groupby("doc_id")["size"].sum().to_dict()
    assert total == {i: s for i, s in enumerate(sizes) if s}
    pieces = Counter(out.doc_id)
    assert all((pieces[i] > 1) == (s > 4096) for i, s in enumerate(sizes) if s)
    assert K.packed(items.where("false"), 4096).count() == 0
    # the classes alone: containers of class j take j items each
    plain = K.packed(items, 4096, fill_gaps=False).toPandas()
    assert plain.groupby("container")["size"].sum().max() <= 4096 and plain["size"].sum() == out["size"].sum()
    for _, c in plain.groupby("container"):
        classes = {min(4096 // s, K.CLASSES) for s in c["size"]}
        assert len(classes) == 1 and (len(c) <= min(classes) or classes == {K.CLASSES})
    # what comes out does not depend on how the rows are batched
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    again = K.packed(items, 4096).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again.sort_values(["doc_id", "piece"]).reset_index(drop=True).equals(out.sort_values(["doc_id", "piece"]).reset_index(drop=True))
