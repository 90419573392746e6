"""Extension points: embedding and language-model functions, with deterministic defaults.

A model is any callable on a list of texts.  It runs on Arrow batches, on each
distinct text of a batch once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], np.ndarray]
Model = Callable[[Sequence[str]], list[str]]


def java_hash(text: str) -> int:
    """The JVM's string hash, signed."""
    h = 0
    for unit in np.frombuffer(text.encode("utf-16-le"), dtype="<u2").tolist():
        h = (h * 31 + unit) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def hash_embedder(dim: int = 384, signed: bool = False) -> Embedder:
    """Bags of hashed words of length one; signed, the parity of the hash gives the sign."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = java_hash(w)
                out[i, h % dim if signed else abs(h) % dim] += (1 if h % 2 == 0 else -1) if signed else 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return embed


def position_embedder(model: str, dim: int = 48) -> Embedder:
    """Letters hashed with their positions and a seed from the model's name and the text."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            seed = java_hash(f"{model}:{t}")
            for k, c in enumerate(t):
                out[i, ((ord(c) * 31 + seed + k) & 0x7FFFFFFF) % dim] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return embed


def embedded(text: Column, embedder: Embedder, dim: int) -> Column:
    """ARRAY<DOUBLE> of every text, null for null; a model that gives another length fails."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        texts = [t for t in s.dropna().unique()]
        if not texts:
            return pd.Series([None] * len(s), dtype=object)
        made = np.asarray(embedder(texts), dtype=np.float64)
        if made.shape != (len(texts), dim):
            raise ValueError(f"the embedder gave {made.shape}, not {(len(texts), dim)}")
        at = {t: v.tolist() for t, v in zip(texts, made, strict=True)}
        return pd.Series([at.get(t) if t is not None else None for t in s], dtype=object)

    return run(text)


def answered(prompt: Column, model: Model) -> Column:
    """A model's text for every prompt; a prompt that fails alone gives null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        at: dict = {}
        for t in s.dropna().unique():
            try:
                at[t] = model([t])[0]
            except Exception:  # noqa: BLE001  one cell's failure is not the query's
                at[t] = None
        return s.map(lambda t: at.get(t))

    return run(prompt)


def extractive_model(texts: Sequence[str]) -> list[str]:
    """The default model: the first sentence after the last ``Context:``, as an answer."""
    return ["Answer: " + re.split(r"(?<=[.!?])\s+", t.rsplit("Context:", 1)[-1].strip())[0] for t in texts]


def answer_after_marker(c: Column) -> Column:
    """What follows ``Answer:``, else the whole text."""
    found = F.trim(F.regexp_extract(c, r"(?s)Answer:(.*)", 1))
    return F.when(found != "", found).otherwise(F.trim(c))


def cached(rows: DataFrame, prompt: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``compute`` on the distinct prompts only and join its columns back."""
    return rows.join(compute(rows.select(prompt).where(F.col(prompt).isNotNull()).distinct()), prompt, "left")


def few_shot(examples: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, doc, score): the k most similar examples (id, v) of each query (id, v)."""
    from ..operators.retrieval import search

    return search(queries, examples, k)
