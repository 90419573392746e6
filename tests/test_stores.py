"""Sources, stores, streaming and the engine on small files."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions.text import words
from strandline.operators.chunking import token_windows
from strandline.plans.engine import MODES, Engine
from strandline.sources import readers
from strandline.sources.store import BACKENDS, TableStore, write_csv, write_jsonl
from strandline.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id": "1", "question": "q", "answerable": true}\n\nnot json\n{"id": "2", "answerable": false}\n')
    assert [r.id for r in readers.samples(spark, str(tmp_path / "s.jsonl")).collect() if r.id] == ["1"]
    (tmp_path / "c.csv").write_text('salt,rust,"<e1>Salt</e1>, then <e2>rust</e2>.",yes,road\n,,,,\n')
    rows = readers.causal_csv(spark, str(tmp_path / "c.csv")).collect()
    assert len(rows) == 1 and rows[0].paragraph == "Salt, then rust."
    (tmp_path / "q_train_1.csv").write_text("question,question_processed,answer,context\n,why?,salt,text\nwho?,,,text\n")
    got = readers.question_csv(spark, str(tmp_path / "q_train_1.csv"), ("question", "question_processed"), ("answer",), ("context",)).collect()
    assert [(r.question, r.file) for r in got] == [("why?", "q_train_1.csv")]
    (tmp_path / "chunks.txt").write_text("id: a\tChunk: one\nnoise\nid: a\tChunk: two\nid: b\tChunk: x\n")
    assert {(r.id, r.text) for r in readers.tagged_chunks(spark, str(tmp_path / "chunks.txt")).collect()} == {("a", "two"), ("b", "x")}
    rel = [{"start_node": {"label": "E", "properties": {"name": "salt"}}, "relation": "causes", "end_node": {"label": "rust", "properties": {}}}]
    (tmp_path / "g.json").write_text(json.dumps(rel))
    assert [tuple(r) for r in readers.graph_json(spark, str(tmp_path / "g.json")).collect()] == [("salt", "causes", "rust")]
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus/a.json").write_text('["one", {"title": "T", "text": "two"}]')
    (tmp_path / "corpus/b.json").write_text('{"title": "U", "content": "three"}')
    assert {(r.title, r.text) for r in readers.corpus_json(spark, str(tmp_path / "corpus")).collect()} == {("document_0", "one"), ("T", "two"), ("U", "three")}
    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.md").write_bytes("straße".encode("utf-16"))
    (tmp_path / "up/b.pdf").write_bytes(b"%PDF")
    got = {r.file: (r.kind, r.text) for r in readers.uploads(spark, str(tmp_path / "up")).collect()}
    assert got == {"a.md": ("text", "straße"), "b.pdf": ("unsupported", None)}
    m = spark.createDataFrame([({"salt": [1], "the": [0, 2]},)], "m map<string,array<int>>").select(readers.inverted_index_text(F.col("m")).alias("t"))
    assert m.first().t == "the salt the"


def test_aliases_discovery_and_merge(spark, tmp_path):
    df = spark.createDataFrame([("1", "salt", 3)], "entity_id string, title string, community int")
    df.write.parquet(str(tmp_path / "x/run/entities.parquet"))
    assert [d.rsplit("/", 1)[-1] for d in readers.index_directories(spark, str(tmp_path))] == ["run"]
    got = readers.entities(spark, str(tmp_path / "x/run/entities.parquet")).first()
    assert (got.id, got.name, got.type) == ("1", "salt", None)
    m = readers.merged_indexes({"a": df, "b": df}, "entity_id", "community")
    assert {(r.entity_id, r.community) for r in m.collect()} == {("a:1", 3), ("b:1", 7)}


def test_store(spark, tmp_path):
    s = BACKENDS.create("local", spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert s.append_new("t", rows, "k") == 2 and s.append_new("t", rows, "k") == 0
    s.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert [r.v for r in s.get("t", [3, 9, 1], "k").collect()] == ["d", None, "a"]
    s.delete("t", spark.createDataFrame([(1,)], "k int"), "k")
    assert s.checkpoint(str(tmp_path / "snap")) == {"version": 1, "tables": {"t": 2}}
    s.drop("t")
    assert s.names() == []
    s.restore(str(tmp_path / "snap"))
    assert s.names() == ["t"] and s.read("t").count() == 2
    with pytest.raises(KeyError):
        BACKENDS.create("nothing")
    write_csv(spark.createDataFrame([("x", 0.5)], "a string, b double"), str(tmp_path / "csv"), 3)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "0.500"
    write_jsonl(rows.withColumn("at", F.monotonically_increasing_id()), str(tmp_path / "jl"), "at")
    assert readers.jsonl_dataset(spark, str(tmp_path / "jl")).count() == 3


def test_streaming_ingestion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one two three")
    (tmp_path / "in/b.txt").write_text("   ")
    s = TableStore(spark, str(tmp_path / "store"))

    def process(docs):
        return token_windows(docs, "doc_key", words(F.col("text")), 2, 0)

    ingest.ingest_stream(spark, str(tmp_path / "in"), s, process, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.status for r in s.read("status").collect()) == ["FAILED", "PROCESSED"] and s.read("chunks").count() == 2
    (tmp_path / "in/c.txt").write_text("four")
    (tmp_path / "in/d.txt").write_text("one two three")  # the same content again
    ingest.ingest_stream(spark, str(tmp_path / "in"), s, process, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.status for r in s.read("status").collect()) == ["FAILED", "PROCESSED", "PROCESSED"] and s.read("chunks").count() == 3


def test_windowed_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = ingest.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = ingest.windowed(events)
    assert spark.table("w").select("start", "event_type", "n").exceptAll(want.select("start", "event_type", "n")).count() == 0
    assert spark.table("w").count() == want.count()


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Road salt leads to rusting bridges. The town was told."), (2, "Poor sleep causes weight gain."), (3, ""), (4, None)], "doc_id long, text string")
    e = Engine(spark, str(tmp_path / "e"), window=50, overlap=5)
    e.index(docs)
    q = spark.createDataFrame([(7, "What leads to rusting bridges?"), (8, "weight gain?")], "query int, question string")
    for mode in MODES:
        best = {r.query: r.text for r in e.query(q, mode, 1).collect()}
        assert best[7].startswith("Road salt") and best[8].startswith("Poor sleep"), mode
    assert {r.query: r.answer for r in e.answer(q, "lexical", 1).collect()}[8] == "Poor sleep causes weight gain."
    assert [tuple(r.path) for r in e.causal_paths("road salt").collect()] == [("road salt", "rusting bridges")]
    with pytest.raises(ValueError):
        e.query(q, "nothing")
