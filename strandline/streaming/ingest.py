"""Structured Streaming: incremental ingestion with document status, and windowed events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpointed
from ..sources.store import TableStore

#: A document passes PENDING, PROCESSING and PROCESSED, or ends as FAILED with its error.
STATES = ("PENDING", "PROCESSING", "PROCESSED", "FAILED")
ALONE = 1_000  # documents of a batch that are tried one by one after a failure


def ingest_batch(store: TableStore, docs: DataFrame, process: Callable[[DataFrame], DataFrame], name: str = "chunks") -> DataFrame:
    """Ingest (path, text): texts already stored under their hash are left out, so a batch may be repeated.

    ``process`` makes chunks (doc_key, ...) of new documents.  Blank texts fail alone.
    """
    rows = docs.select("path", "text", F.concat(F.lit("doc-"), F.md5(F.coalesce("text", F.lit("")))).alias("doc_key")).dropDuplicates(["doc_key"])
    new = rows.join(store.read("status").where("status = 'PROCESSED'").select("doc_key"), "doc_key", "left_anti") if store.exists("status") else rows
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    status = lambda df, s, e: df.select("doc_key", "path", F.lit(s).alias("status"), F.lit(e).cast("string").alias("error"))
    good = new.where(~blank)
    store.upsert("status", status(good, "PENDING", None).unionByName(status(new.where(blank), "FAILED", "blank text")), "doc_key")
    waiting = store.read("status").where("status in ('PENDING', 'PROCESSING')").select("doc_key")
    todo = checkpointed(rows.join(waiting, "doc_key", "left_semi"))
    mark = lambda s, e, keys: store.upsert("status", store.read("status").join(keys, "doc_key", "left_semi").select("doc_key", "path", F.lit(s).alias("status"), F.lit(e).cast("string").alias("error")), "doc_key")
    mark("PROCESSING", None, todo.select("doc_key"))
    try:
        chunks = checkpointed(process(todo))
    except Exception as failure:  # one document may fail the whole batch: each is tried by itself
        chunks = _one_by_one(todo, process, lambda key, e: mark("FAILED", str(e).splitlines()[0][:200], todo.where(F.col("doc_key") == key).select("doc_key")), failure)
    if chunks is not None:
        old = store.read(name).join(todo.select("doc_key"), "doc_key", "left_anti") if store.exists(name) else None
        store.write(name, chunks if old is None else old.unionByName(chunks))
    working = store.read("status").where("status = 'PROCESSING'").select("doc_key")
    with_chunks = chunks.select("doc_key").distinct() if chunks is not None else working.limit(0)
    mark("PROCESSED", None, working.join(with_chunks, "doc_key", "left_semi"))
    mark("FAILED", "no chunks", store.read("status").where("status = 'PROCESSING'").select("doc_key"))
    return store.read("status")


def _one_by_one(todo: DataFrame, process: Callable[[DataFrame], DataFrame], failed: Callable[[str, Exception], None], failure: Exception) -> DataFrame | None:
    """The chunks of the documents that can be processed; a batch of ``ALONE`` documents or more fails as a whole."""
    keys = [r.doc_key for r in todo.select("doc_key").limit(ALONE).collect()]
    if len(keys) == ALONE:
        raise failure
    made = None
    for key in keys:
        try:
            part = checkpointed(process(todo.where(F.col("doc_key") == key)))
            made = part if made is None else made.unionByName(part)
        except Exception as e:
            failed(key, e)
    return made


def ingest_stream(spark: SparkSession, folder: str, store: TableStore, process: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Text files that appear in a folder are ingested batch by batch; ends when all present are done."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    docs = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def each(batch: DataFrame, _: int) -> None:
        ingest_batch(store, batch, process)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window, for streams with late rows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
