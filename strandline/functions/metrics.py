"""Evaluation metrics of one row as column expressions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import content_tokens, coverage, jaccard, words


def _tagged(a: Column, b: Column) -> Column:
    """The tokens of both arrays in order, 0 for the first and 1 for the second, so that equal ones stand together."""
    tag = lambda x, k: F.transform(x, lambda t: F.struct(t.alias("t"), F.lit(k).alias("k")))
    return F.array_sort(F.concat(tag(a, 0), tag(b, 1)))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays; one pass over them in order, so long texts take no square."""

    def step(s: Column, e: Column) -> Column:
        left = F.when(s["t"].eqNullSafe(e["t"]), s["left"]).otherwise(0)
        taken = (e["k"] == 1) & (left > 0)
        return F.struct(e["t"].alias("t"), F.when(e["k"] == 0, left + 1).when(taken, left - 1).otherwise(left).alias("left"), (s["n"] + taken.cast("int")).alias("n"))

    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("n"))
    return F.aggregate(_tagged(a, b), start, step, lambda s: s["n"])


def token_scores(rows: DataFrame, prediction: Column, gold: Column) -> DataFrame:
    """Adds precision, recall and f1 of two normalised texts' words; two empty texts agree fully.

    In steps, so that words are split and counted once for all three.
    """
    x = rows.withColumn("_p", words(prediction)).withColumn("_g", words(gold))
    # equal texts need no counting, and most others share no word
    n = F.when(F.col("_p") == F.col("_g"), F.size("_p")).when(F.arrays_overlap("_p", "_g"), overlap(F.col("_p"), F.col("_g"))).otherwise(0)
    x = x.withColumn("_n", n).withColumn("_a", F.size("_p")).withColumn("_b", F.size("_g"))
    none = F.when((F.col("_a") == 0) & (F.col("_b") == 0), 1.0)
    share = lambda total: F.coalesce(none, F.when(F.col(total) > 0, F.col("_n") / F.col(total)).otherwise(0.0))
    f1 = F.coalesce(none, F.when(F.col("_n") > 0, 2.0 * F.col("_n") / (F.col("_a") + F.col("_b"))).otherwise(0.0))
    return x.withColumns({"precision": share("_a"), "recall": share("_b"), "f1": f1}).drop("_p", "_g", "_n", "_a", "_b")


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), g)) / F.size(g)).otherwise(0.0)


def _relevant(retrieved: Column, gold: Column, k: int) -> Column:
    """Ranks, from 1, of the first k that are gold."""
    flags = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    return F.filter(flags, lambda i: i.isNotNull())


def mrr_at(retrieved: Column, gold: Column, k: int) -> Column:
    ranks = _relevant(retrieved, gold, k)
    return F.when(F.size(ranks) > 0, 1.0 / F.array_min(ranks)).otherwise(0.0)


def ndcg_at(retrieved: Column, gold: Column, k: int) -> Column:
    gain = F.aggregate(_relevant(retrieved, gold, k), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size(gold)))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return F.when(F.size(gold) > 0, gain / best).otherwise(0.0)


def bridge_coverage_at(retrieved: Column, gold: Column, k: int) -> Column:
    return F.when((F.size(gold) > 0) & (F.size(F.array_except(gold, F.slice(retrieved, 1, k))) == 0), 1.0).otherwise(0.0)


def context_relevance(question: Column, contexts: Column) -> Column:
    """Coverage of the question's words by all contexts, blended with the mean over them."""
    q = content_tokens(question)
    every = coverage(q, content_tokens(F.array_join(contexts, " ")))
    mean = F.when(F.size(contexts) > 0, F.aggregate(contexts, F.lit(0.0), lambda s, c: s + coverage(q, content_tokens(c))) / F.size(contexts)).otherwise(0.0)
    return 0.75 * every + 0.25 * mean


def groundedness(response: Column, contexts: Column) -> Column:
    """1 if a context contains the response, else the share of its words that the contexts hold."""
    text = F.lower(F.array_join(contexts, " "))
    r = F.filter(content_tokens(response), lambda t: F.length(t) > 2)
    return F.when((F.trim(response) != "") & F.contains(text, F.lower(F.trim(response))), 1.0).otherwise(coverage(r, content_tokens(text)))


def answer_relevancy(question: Column, answer: Column) -> Column:
    return jaccard(content_tokens(question), content_tokens(answer))


def faithfulness(statements: Column, contexts: Column) -> Column:
    """Share of statements of which one context holds half the words."""
    good = F.filter(statements, lambda s: F.exists(contexts, lambda c: coverage(content_tokens(s), content_tokens(c)) >= 0.5))
    return F.when(F.size(statements) > 0, F.size(good) / F.size(statements)).otherwise(0.0)


def context_utilisation(response: Column, contexts: Column) -> Column:
    """Share of contexts that share a word with the response."""
    r = content_tokens(response)
    return F.when(F.size(contexts) > 0, F.size(F.filter(contexts, lambda c: F.arrays_overlap(r, content_tokens(c)))) / F.size(contexts)).otherwise(0.0)


def id_precision(retrieved: Column, reference: Column) -> Column:
    r = F.array_distinct(F.transform(retrieved, lambda x: F.trim(x)))
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, F.transform(reference, lambda x: F.trim(x)))) / F.size(r)).otherwise(0.0)


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def bleu(prediction: Column, reference: Column) -> Column:
    """Smoothed by one, n up to 4 and to the prediction's length, with brevity penalty."""
    logs = F.lit(0.0)
    n_p = F.size(prediction)
    for n in range(1, 5):
        g = ngrams(prediction, n)
        logs = logs + F.when(n_p >= n, F.log((overlap(g, ngrams(reference, n)) + 1.0) / (F.size(g) + 1.0))).otherwise(0.0)
    mean = F.exp(logs / F.greatest(F.lit(1), F.least(F.lit(4), n_p)))
    short = F.when(n_p >= F.size(reference), 1.0).otherwise(F.exp(1.0 - F.size(reference) / n_p))
    return F.when((n_p > 0) & (F.size(reference) > 0), short * mean).otherwise(0.0)


def chrf(prediction: Column, reference: Column, most: int = 6, beta: float = 2.0) -> Column:
    """Mean over n of the F-score of character n-grams, blanks left out.

    Counted in Python on Arrow batches: a count of n-grams by array expressions
    takes the square of the text's length.
    """

    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> float | None:
            if x is None or y is None:
                return None
            x, y = "".join(x.split()), "".join(y.split())
            total, b2 = 0.0, beta * beta
            for n in range(1, most + 1):
                a = Counter(x[i : i + n] for i in range(len(x) - n + 1))
                b = Counter(y[i : i + n] for i in range(len(y) - n + 1))
                same = (a & b).total()
                if same:
                    precision, recall = same / a.total(), same / b.total()
                    total += (1 + b2) * precision * recall / (b2 * precision + recall)
            return total / most

        return pd.Series([one(x, y) for x, y in zip(p, r, strict=True)], dtype="float64")

    return score(prediction, reference)


@F.pandas_udf(IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays, by rows of its table."""

    def one(x: np.ndarray | None, y: np.ndarray | None) -> int:
        if x is None or y is None or not len(x) or not len(y):
            return 0
        codes: dict = {}
        other = np.array([codes.setdefault(t, len(codes)) for t in y])
        row = np.zeros(len(other) + 1, dtype=np.int32)
        for t in x:
            k = codes.get(t)
            if k is not None:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(other == k, row[:-1] + 1, 0)))
        return int(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(prediction: Column, reference: Column) -> Column:
    n = longest_common(prediction, reference)
    return F.when(n > 0, 2.0 * n / (F.size(prediction) + F.size(reference))).otherwise(0.0)


def lexical_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token arrays' counts, in one pass over them in order."""

    def closed(s: Column) -> list[Column]:
        x, y = s["x"], s["y"]
        return [(s["xy"] + x * y).alias("xy"), (s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy")]

    def step(s: Column, e: Column) -> Column:
        same = s["t"].eqNullSafe(e["t"])
        x = F.when(same, s["x"]).otherwise(0) + (e["k"] == 0).cast("bigint")
        y = F.when(same, s["y"]).otherwise(0) + (e["k"] == 1).cast("bigint")
        done = [F.when(same, s[n]).otherwise(c).alias(n) for n, c in zip(("xy", "xx", "yy"), closed(s), strict=True)]
        return F.struct(e["t"].alias("t"), x.alias("x"), y.alias("y"), *done)

    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(None).cast("string").alias("t"), *[zero.alias(n) for n in ("x", "y", "xy", "xx", "yy")])
    value = lambda s: (lambda c: c[0] / F.sqrt(c[1].cast("double")) / F.sqrt(c[2].cast("double")))(closed(s))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(_tagged(a, b), start, step, value)).otherwise(0.0)


def answer_accuracy(question: Column, prediction: Column, reference: Column) -> Column:
    """Words, figures and question overlap; divided by five where the figures disagree."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), 1))
    p, r = content_tokens(prediction), content_tokens(reference)
    same = F.size(F.array_intersect(p, r))
    f1 = F.when(F.size(p) + F.size(r) > 0, 2.0 * same / (F.size(p) + F.size(r))).otherwise(0.0)
    np_, nr = numbers(prediction), numbers(reference)
    figures = F.when(F.size(nr) == 0, 1.0).otherwise(F.size(F.array_intersect(np_, nr)) / F.size(nr))
    clash = (F.size(np_) > 0) & (F.size(nr) > 0) & ~F.arrays_overlap(np_, nr)
    return (0.65 * f1 + 0.25 * figures + 0.10 * coverage(content_tokens(question), p)) * F.when(clash, 0.2).otherwise(1.0)


def tool_f1(called: Column, expected: Column) -> Column:
    c, e = F.array_distinct(called), F.array_distinct(expected)
    same = F.size(F.array_intersect(c, e))
    return F.round(F.when(same > 0, 2.0 * same / (F.size(c) + F.size(e))).otherwise(0.0), 4)
