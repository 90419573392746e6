"""One façade over the retrieval modes: index documents once, query in any mode.

Every mode gives (query, rank, doc, text, score, mode), whatever it combines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hooks
from ..functions import text as T
from ..operators import chunking as C
from ..operators import graph as G
from ..operators import merging as M
from ..operators import retrieval as R
from ..sources.store import TableStore

MODES = ("naive", "dense", "lexical", "graph", "causal", "hybrid")


class Engine:
    """Chunks, postings, vectors and causal edges of documents as tables, and ranked queries over them."""

    def __init__(self, spark: SparkSession, root: str, embedder: hooks.Embedder | None = None, dim: int = 384, window: int = 200, overlap: int = 20):
        self.spark, self.store = spark, TableStore(spark, root)
        self.embedder, self.dim = embedder or hooks.hash_embedder(dim), dim
        self.window, self.overlap = window, overlap

    def index(self, docs: DataFrame) -> None:
        """Index (doc_id, text); documents without words are left out."""
        rows = docs.where(F.length(F.trim("text")) > 0)
        chunks = C.token_windows(rows, "doc_id", T.words(F.col("text")), self.window, self.overlap)
        chunks = chunks.withColumn("doc", T.content_id("chunk-", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("ord").cast("string"), F.col("content"))))
        self.store.write("chunks", chunks)
        chunks = self.store.read("chunks")
        self.store.write("postings", R.postings(chunks, "doc", T.ascii_tokens(F.col("content"))))
        self.store.append_new("vectors", chunks.select("doc", "content"), "doc", lambda new: new.select("doc", hooks.embedded(F.col("content"), self.embedder, self.dim).alias("v")))
        said = chunks.select("doc", F.explode(C.sentences(F.col("content"))).alias("s"))
        triples = C.causal_triples(said, "doc", F.col("s"))
        self.store.write("triples", triples.where("confidence >= 0.5"))

    def _lexical(self, queries: DataFrame) -> DataFrame:
        terms = queries.select("query", F.explode(T.ascii_tokens(F.col("question"))).alias("term"))
        return R.bm25(terms, self.store.read("postings"))

    def _dense(self, queries: DataFrame, k: int) -> DataFrame:
        q = queries.select(F.col("query").alias("id"), hooks.embedded(F.col("question"), self.embedder, self.dim).alias("v"))
        return R.search(q, self.store.read("vectors").select(F.col("doc").alias("id"), "v"), k).select("query", "doc", "score")

    def _graph(self, queries: DataFrame, k: int, rounds: int = 10, damping: float = 0.5) -> DataFrame:
        """Personalised rank of passages, restarted at what each question names; one walk per question at once.

        The walk runs on (query, node) pairs, so questions share every join.
        """
        t = self.store.read("triples")
        edges = t.select(F.col("cause").alias("src"), F.col("effect").alias("dst")).unionByName(t.select(F.col("cause").alias("src"), F.col("doc").alias("dst"))).unionByName(t.select(F.col("effect").alias("src"), F.col("doc").alias("dst")))
        edges = M.edges(G.both_ways(edges.withColumn("weight", F.lit(1.0)))).select("src", "dst", "weight")
        total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
        shares = edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))
        phrases = t.select(F.explode(F.array("cause", "effect")).alias("node")).distinct()
        words = phrases.select("node", F.explode(T.content_tokens(F.col("node"))).alias("w"))
        asked = queries.select("query", F.explode(T.content_tokens(F.col("question"))).alias("w"))
        seeds = words.join(asked, "w").groupBy("query", "node").agg(F.count("*").alias("n"))
        from pyspark.sql import Window

        restart = seeds.select("query", "node", (F.col("n") / F.sum("n").over(Window.partitionBy("query"))).alias("restart"))
        ranks = restart.select("query", "node", F.col("restart").alias("rank"))
        for i in range(rounds):
            came = ranks.withColumnRenamed("node", "src").join(shares, "src").groupBy("query", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
            ranks = came.join(restart, ["query", "node"], "full_outer").select("query", "node", ((1 - damping) * F.coalesce("restart", F.lit(0.0)) + damping * F.coalesce("came", F.lit(0.0))).alias("rank"))
            if (i + 1) % G.CUT_EVERY == 0:
                ranks = G.checkpointed(ranks)
        passages = self.store.read("chunks").select(F.col("doc").alias("node"))
        return R.ranked(ranks.join(passages, "node", "left_semi").select("query", F.col("node").alias("doc"), F.col("rank").alias("score")), k).select("query", "doc", "score")

    def query(self, queries: DataFrame, mode: str = "hybrid", k: int = 5, budget: int | None = None) -> DataFrame:
        """The k best passages of (query, question); with a budget, their longest prefix within so many words."""
        if mode not in MODES:
            raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
        wide = max(4 * k, 20)
        parts = {
            "naive": lambda: self._dense(queries, k), "dense": lambda: self._dense(queries, k), "lexical": lambda: self._lexical(queries),
            "graph": lambda: self._graph(queries, k), "causal": lambda: self._graph(queries, k),
        }
        if mode == "hybrid":
            every = [s.withColumn("strategy", F.lit(n)) for n, s in (("dense", self._dense(queries, wide)), ("lexical", self._lexical(queries)), ("graph", self._graph(queries, wide)))]
            scores = R.fused(every[0].unionByName(every[1]).unionByName(every[2]), {"dense": 0.4, "graph": 0.5, "lexical": 0.1}).select("query", "doc", "score")
        else:
            scores = parts[mode]()
        best = R.ranked(scores, k).join(self.store.read("chunks").select("doc", F.col("content").alias("text"), "tokens"), "doc")
        if budget is not None:
            best = R.within_budget(best, ["query"], [F.col("rank")], "tokens", budget)
        return best.select("query", "rank", "doc", "text", "score", F.lit(mode).alias("mode"))

    def answer(self, queries: DataFrame, mode: str = "hybrid", k: int = 5, model: hooks.Model = hooks.extractive_model) -> DataFrame:
        """(query, answer): the model's answer over the passages found."""
        found = self.query(queries, mode, k).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
        prompts = found.join(queries, "query").select("query", F.concat(F.col("question"), F.lit("\nContext:\n"), F.col("context")).alias("prompt"))
        return prompts.select("query", hooks.answer_after_marker(hooks.answered(F.col("prompt"), model)).alias("answer"))

    def causal_paths(self, cause: str, most: int = 3, targets: DataFrame | None = None) -> DataFrame:
        t = self.store.read("triples")
        seeds = self.spark.createDataFrame([(cause,)], "node string")
        return G.simple_paths(t.select(F.col("cause").alias("src"), F.col("effect").alias("dst")), seeds, most, targets)
