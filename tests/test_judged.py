"""Evaluation driver, exact percentiles, extraction and ingestion of documents that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import judged as J
from strandline.functions.judgements import fact_entities
from strandline.operators import chunking, experiments, extraction, graph
from strandline.sources.store import TableStore
from strandline.streaming import ingest


def test_evaluate_checks_columns_and_leaves_nulls(spark):
    rows = spark.createDataFrame([("Why rust?", "Road salt.", ["Road salt causes rust."]), (None, "Road salt.", ["x"])], "question string, response string, contexts array<string>")
    got = [tuple(r)[3:] for r in J.evaluate(rows, "default").collect()]
    assert got[0][1:] == (1.0, 1.0) and got[1][0] is None
    with pytest.raises(ValueError, match="accuracy needs reference"):
        J.evaluate(rows, ("accuracy",))
    with pytest.raises(ValueError):
        J.evaluate(rows, ("nothing",))


def test_words_end_at_letters_of_other_scripts(spark):
    """As in SQL: a name or figure beside a letter that is not ASCII stands alone."""
    rows = [("原因は霜であり、Penefolt付近で67.68を見た", ["Penefolt and mills"]), ("Mumibu Nierenschäden", ["Mumibu late"]), ("x é12é", ["x"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, p string, c array<string>")
    got = {r.i: (r.g, r.n, r.e) for r in df.select("i", F.round(J.penalised_groundedness(F.col("p"), F.col("c")), 6).alias("g"), J.numbers(F.col("p")).alias("n"), fact_entities(F.col("p")).alias("e")).collect()}
    assert got == {0: (0.6, ["67.68"], ["penefolt"]), 1: (0.183333, [], ["mumibu nierensch"]), 2: (0.0, ["12"], [])}
    assert [r.f for r in spark.createDataFrame([("é sorry",), ("ésorryé",), ("sorry_",)], "c string").select(J.failed(F.col("c")).alias("f")).collect()] == [True, True, False]


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.pareto(1.2, 500), -rng.pareto(1.2, 300), np.zeros(400), np.full(600, 7.5)])
    rows = [("a" if i % 3 else None, float(v)) for i, v in enumerate(x)] + [("a", None), ("a", float("nan")), ("b", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in experiments.exact_percentiles(df, ["g"], "x", {"lo": 0.05, "mid": 0.5, "hi": 0.99}).collect()}
    for g in ("a", None):
        want = np.percentile([v for k, v in rows if k == g and v is not None and v == v], [5, 50, 99])
        assert np.allclose(got[g], want)
    assert got["b"] == (1.0, 1.0, 1.0) and "c" not in got
    assert experiments.exact_percentiles(df.where("false"), ["g"], "x", {"p": 0.5}).count() == 0


def test_model_output_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(1, '```json\n[{"from": "A", "to": " B "}, {"subject": "c", "object": ""}]\n```'), (2, "no list"), (3, "[{"), (4, None), (5, '[{"cause": "x", "effect": "y", "confidence": "-3"}]')], "id int, out string")
    assert {tuple(r) for r in extraction.triples_of(rows, "id", F.col("out")).collect()} == {(1, "a", "b", 0.7), (5, "x", "y", 0.0)}


def test_delimited_windows_and_only_mode(spark):
    docs = spark.createDataFrame([(1, "a b|c d e f g| |"), (2, None), (3, "")], "id int, text string")
    assert [(r.ord, r.content) for r in chunking.delimited_windows(docs, "id", F.col("text"), "|", 3, 1).orderBy("ord").collect()] == [(0, "a b"), (1, "c d e"), (2, "e f g"), (3, "g")]
    with pytest.raises(Exception, match="longer than a chunk"):
        chunking.delimited_windows(docs, "id", F.col("text"), "|", 3, 1, only=True).collect()


def test_unfinished_iterations_are_errors(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(12)], "src string, dst string")
    with pytest.raises(RuntimeError):
        graph.components(chain, most_rounds=1)
    with pytest.raises(RuntimeError):
        graph.depths(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), most=3)


def test_one_document_that_fails(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))

    def process(docs):
        bad = F.when(F.contains("text", F.lit("bad")), F.raise_error(F.lit("cannot be read")).cast("string")).otherwise(F.col("text"))
        return docs.select("doc_key", bad.alias("chunk")).where("chunk <> 'silent'")

    docs = spark.createDataFrame([("p1", "good"), ("p2", "bad"), ("p3", " "), ("p4", "silent")], "path string, text string")
    got = {r.path: (r.status, r.error) for r in ingest.ingest_batch(store, docs, process).collect()}
    assert got["p1"] == ("PROCESSED", None) and got["p3"] == ("FAILED", "blank text") and got["p4"] == ("FAILED", "no chunks")
    assert got["p2"][0] == "FAILED" and got["p2"][1]
    assert [r.chunk for r in store.read("chunks").collect()] == ["good"]


def test_append_keeps_what_is_stored(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    calls = []

    def compute(df):
        calls.append(1)
        return df.withColumn("v", F.length("k"))

    row = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert store.append_new("t", row("a", "b", "b"), "k", compute) == 2
    assert store.append_new("t", row("b", "ccc"), "k", compute) == 1
    assert store.append_new("t", row("a"), "k", compute) == 0
    assert sorted(tuple(r) for r in store.read("t").collect()) == [("a", 1), ("b", 1), ("ccc", 3)]


def test_index_readers_and_context_blocks(spark, tmp_path):
    from strandline.functions import text as T
    from strandline.sources import readers

    spark.createDataFrame([("c1", "a causes b", "d1")], "chunk_id string, content string, document_id string").write.parquet(str(tmp_path / "u"))
    assert [tuple(r) for r in readers.text_units(spark, str(tmp_path / "u")).collect()] == [("c1", "a causes b", "d1", None)]
    spark.createDataFrame([("k", "x", "y", "open")], "id string, subject_id string, object_id string, claim_status string").write.parquet(str(tmp_path / "k"))
    got = readers.claims(spark, str(tmp_path / "k")).first()
    assert (got.subject, got.object, got.status, got.type) == ("x", "y", "open", None)
    (tmp_path / "e.json").write_text('[{"question": "Why?", "ground_truth": "salt"}, {"question": " "}]')
    assert [tuple(r) for r in readers.evaluation_examples(spark, str(tmp_path / "e.json")).collect()] == [("Why?", "salt")]
    texts = ['x\n```csv\nid,context\n1,"a ""b"", c"\n2, \n```\n```csv\nid,content,context\n3,d,e\n```', "no block", "```csv\nid,name\n1,z\n```", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.context_values(F.col("t")).alias("v"))
    assert {r.i: r.v for r in rows.collect()} == {0: ['a "b", c', "d"], 1: [], 2: [], 3: None}


def test_numbered_over_ranges(spark):
    from strandline.operators.merging import numbered

    rows = spark.range(0, 500, numPartitions=7).select((F.col("id") * 37 % 101).alias("a"), "id")
    got = numbered(rows, [F.desc("a"), F.col("id")]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 501)) and [(-r.a, r.id) for r in got] == sorted((-r.a, r.id) for r in got)
    assert numbered(rows.where("false"), [F.col("id")]).count() == 0
