"""Judged metrics without a model: correctness of statements, agents' goals and calls, equivalence of SQL and of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as E
from .text import ascii_edges, content_tokens, coverage, is_unknown, jaccard

# --- fixed values ----------------------------------------------------------------
NEGATIONS = r"\b(no|not|never|none|without|cannot|can't|won't|isn't|aren't|didn't|doesn't|don't)\b"
REFUSALS = r"\b(can'?t|cannot|won'?t|unable|refuse|decline|sorry)\b"
FAILURES = r"\b(failed|failure|error|unavailable|not\s+found|did\s+not|could\s+not|couldn't)\b"
NUMBERS = r"\b\d+(?:[.,]\d+)?\b"
GENERIC_FACT_WORDS = ("answer", "question", "response", "information", "process", "system", "theory", "model")
GOAL_STOP_WORDS = (
    "the and for with that this you your from into about please want need have has had would could should will shall just then than also"
).split()
SQL_SELECT = r"\bselect\b\s+(.*?)\s+\bfrom\b"
SQL_FROM = r"\bfrom\b\s+([a-z0-9_.]+)"
SQL_WHERE = r"\bwhere\b\s+(.*?)(?:\bgroup\s+by\b|\border\s+by\b|\blimit\b|$)"
SQL_GROUP = r"\bgroup\s+by\b\s+(.*?)(?:\border\s+by\b|\blimit\b|$)"
SQL_ORDER = r"\border\s+by\b\s+(.*?)(?:\blimit\b|$)"
SQL_AGGREGATE = r"\b(sum|count|avg|min|max)\s*\("
# -----------------------------------------------------------------------------------


def parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ascii_edges(NUMBERS)), 0))


def _facts(statements: Column) -> Column:
    return F.transform(statements, lambda s: F.struct(content_tokens(s).alias("t"), numbers(s).alias("n")))


def _share(n: Column, total: Column) -> Column:
    return F.when(total > 0, n / total).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0)


def answer_correctness(rows: DataFrame, response: Column, reference: Column, weight: float = 0.75, least: float = 0.55) -> DataFrame:
    """Adds ``correctness``: F1 of statements that match one of the other text's, less for contradictions, blended with likeness.

    In steps, so that statements are cut and tokenised once.
    """

    def match(a: Column, r: Column) -> Column:
        clash = (F.size(r["n"]) > 0) & (F.size(a["n"]) > 0) & ~F.arrays_overlap(r["n"], a["n"])
        silent = (F.size(r["n"]) > 0) & (F.size(a["n"]) == 0)
        return jaccard(a["t"], r["t"]) * F.when(clash, 0.5).otherwise(1.0) * F.when(silent, 0.7).otherwise(1.0)

    x = rows.withColumn("_a", _facts(parts(response, "[.!?;]+"))).withColumn("_r", _facts(parts(reference, "[.!?;]+")))
    x = x.withColumn("_tp", F.size(F.filter("_a", lambda a: F.exists("_r", lambda r: match(a, r) >= least))))
    x = x.withColumn("_fn", F.size(F.filter("_r", lambda r: ~F.exists("_a", lambda a: match(a, r) >= least))))
    p, r = _share(F.col("_tp"), F.size("_a")), _share(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    n_a, n_r = numbers(response), numbers(reference)
    clash = (F.size(n_a) > 0) & (F.size(n_r) > 0) & ~F.arrays_overlap(n_a, n_r)
    denies = F.lower(response).rlike(ascii_edges(NEGATIONS)) != F.lower(reference).rlike(ascii_edges(NEGATIONS))
    penalty = F.when(clash, 0.45).otherwise(1.0) * F.when(denies, 0.8).otherwise(1.0)
    t_a, t_r = content_tokens(response), content_tokens(reference)
    like = F.when((F.size(t_a) > 0) & (F.size(t_r) > 0), 0.7 * jaccard(t_a, t_r) + 0.3 * coverage(t_r, t_a)).otherwise(0.0)
    facts = F.when((F.size("_a") == 0) & (F.size("_r") == 0), 1.0).when((F.size("_a") == 0) | (F.size("_r") == 0), 0.0).otherwise(_f1(p, r) * penalty)
    blank = (F.trim(response) == "") | (F.trim(reference) == "")
    score = F.when(blank, 0.0).otherwise(weight * facts + (1 - weight) * like)
    return x.withColumn("correctness", score).drop("_a", "_r", "_tp", "_fn")


def factual_correctness(rows: DataFrame, response: Column, reference: Column, least: float = 0.5) -> DataFrame:
    """Adds ``factual`` (two digits): F1 of claims that the other text's claims bear out."""
    generic = F.array(*map(F.lit, GENERIC_FACT_WORDS))

    def support(c: Column, r: Column) -> Column:
        same = F.size(F.array_intersect(c["t"], r["t"]))
        missing = F.size(F.filter(F.array_except(F.array_except(c["t"], r["t"]), generic), lambda w: F.length(w) >= 5))
        score = 0.6 * _share(same, F.size(c["t"])) + 0.4 * _share(same, F.size(r["t"]))
        score = score * (1.0 - 0.6 * F.least(missing, F.lit(2)))
        clash = (F.size(c["n"]) > 0) & (F.size(r["n"]) > 0) & ~F.arrays_overlap(c["n"], r["n"])
        return score * F.when(clash, 0.25).otherwise(1.0) * F.when((F.size(c["n"]) > 0) & (F.size(r["n"]) == 0), 0.6).otherwise(1.0)

    x = rows.withColumn("_a", _facts(parts(response, "[.!?]+"))).withColumn("_r", _facts(parts(reference, "[.!?]+")))
    borne = lambda a, b: F.size(F.filter(a, lambda c: (F.size(c["t"]) > 0) & F.exists(b, lambda r: support(c, r) >= least)))
    x = x.withColumn("_p", _share(borne("_a", "_r"), F.size("_a"))).withColumn("_q", _share(borne("_r", "_a"), F.size("_r")))
    blank = (F.trim(response) == "") | (F.trim(reference) == "")
    score = F.when(blank, 0.0).when((F.size("_a") == 0) & (F.size("_r") == 0), 1.0).when(F.size("_a") == 0, 0.0).otherwise(_f1(F.col("_p"), F.col("_q")))
    return x.withColumn("factual", F.round(score, 2)).drop("_a", "_r", "_p", "_q")


def penalised_groundedness(response: Column, contexts: Column) -> Column:
    """groundedness(), less for capitalised words and figures of the response that the contexts lack."""
    text = F.array_join(contexts, " ")
    have = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))
    names = F.array_distinct(F.transform(F.regexp_extract_all(response, F.lit(ascii_edges(r"\b[A-Z][A-Za-z0-9]*\b")), 0), lambda x: F.lower(x)))
    names = F.filter(F.array_except(F.array_intersect(names, content_tokens(response)), have), lambda x: F.length(x) > 2)
    figure = F.lit(ascii_edges(r"\b\d+[A-Za-z]*\b"))
    figures = F.array_except(F.regexp_extract_all(response, figure, 0), F.regexp_extract_all(text, figure, 0))
    lost = (1.0 - 0.45 * F.least(F.size(names), F.lit(2))) * (1.0 - 0.2 * F.least(F.size(figures), F.lit(2)))
    whole = (F.trim(response) != "") & F.contains(F.lower(text), F.lower(F.trim(response)))
    return F.when(whole, 1.0).otherwise(E.groundedness(response, contexts) * lost)


def failed(c: Column) -> Column:
    low = F.lower(c)
    return low.rlike(ascii_edges(REFUSALS)) | low.rlike(ascii_edges(FAILURES))


def goal_reached(desired: Column, arrived: Column) -> Column:
    """Do the words of what was reached cover the goal?  Never after a refusal or failure."""
    tokens = lambda c: F.array_except(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), lambda w: F.length(w) >= 3)), F.array(*map(F.lit, GOAL_STOP_WORDS)))
    d, a = tokens(desired), tokens(arrived)
    n = F.size(F.array_intersect(d, a))
    recall, precision = _share(n, F.size(d)), _share(n, F.size(a))
    enough = (recall >= 0.5) | ((recall >= 0.4) & (precision >= 0.4)) | (jaccard(d, a) >= 0.33)
    return F.coalesce((n > 0) & enough & ~failed(arrived), F.lit(False))


def workflow_completion(calls: Column, tool_turns: Column, ai_turns: Column, human_turns: Column, final: Column, refused: Column) -> Column:
    """Executed calls, a last answer and balanced turns; a fifth of it after a refusal."""
    alone = F.when(final, 1.0).when(ai_turns > 0, 0.7).otherwise(0.0)
    full = 0.6 * F.least(_share(tool_turns, calls), F.lit(1.0)) + 0.3 * final.cast("double") + 0.1 * F.least(_share(ai_turns, human_turns), F.lit(1.0))
    return F.when(calls == 0, alone).otherwise(full) * F.when(refused, 0.2).otherwise(1.0)


def call_accuracy(called: Column, expected: Column, ordered: bool = True) -> Column:
    """Share of expected calls (name, args) made with equal arguments; 0 where the names' sequence differs.

    Without ``ordered`` both are sorted first.
    """
    c, e = (called, expected) if ordered else (F.array_sort(called), F.array_sort(expected))
    names = lambda x: F.transform(x, lambda y: y["name"])
    same = F.size(F.filter(F.arrays_zip(c.alias("c"), e.alias("e")), lambda z: z["c"] == z["e"]))
    return F.when((F.size(c) == 0) & (F.size(e) == 0), 1.0).when(names(c) == names(e), same / F.size(e)).otherwise(0.0)


def sql_likeness(left: Column, right: Column) -> Column:
    """1 less for every part in which two SQL texts differ; whether 0.75 is reached decides on equivalence."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    a, b = norm(left), norm(right)
    columns = lambda c, p: F.array_sort(F.array_distinct(parts(F.regexp_replace(F.regexp_extract(c, ascii_edges(p), 1), r"\s+as\s+\w+", ""), ",")))
    part = lambda c, p: F.trim(F.regexp_extract(c, ascii_edges(p), 1))
    words = lambda c: F.array_distinct(F.regexp_extract_all(part(c, SQL_WHERE), F.lit("[a-z0-9_]+"), 0))
    calls = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(ascii_edges(SQL_AGGREGATE)), 1)))
    wa, wb = words(a), words(b)
    like = F.when((F.size(wa) == 0) & (F.size(wb) == 0), 1.0).otherwise(jaccard(wa, wb))
    off = lambda c, x: F.when(c, x).otherwise(0.0)
    lost = off(part(a, SQL_FROM) != part(b, SQL_FROM), 0.45) + off(columns(a, SQL_SELECT) != columns(b, SQL_SELECT), 0.2) + off(columns(a, SQL_GROUP) != columns(b, SQL_GROUP), 0.15)
    lost = lost + off(columns(a, SQL_ORDER) != columns(b, SQL_ORDER), 0.1) + F.when(part(a, SQL_WHERE) != part(b, SQL_WHERE), 0.25 * (1.0 - like)).otherwise(0.0) + off(calls(a) != calls(b), 0.35)
    return F.greatest(F.lit(0.0), 1.0 - lost)


def table_scores(rows: DataFrame, response: Column, reference: Column) -> DataFrame:
    """Adds row_precision, row_recall and row_f1 of two CSV tables of one header, compared row by row in their order."""
    lines = lambda c: F.filter(F.split(F.trim(c), r"\r?\n"), lambda x: F.trim(x) != "")
    x = rows.withColumn("_a", lines(response)).withColumn("_b", lines(reference))
    same = F.when(F.get("_a", 0) == F.get("_b", 0), F.size(F.filter(F.arrays_zip(F.slice("_a", 2, 1_000_000_000).alias("a"), F.slice("_b", 2, 1_000_000_000).alias("b")), lambda z: z["a"] == z["b"]))).otherwise(0)
    x = x.withColumn("_n", same)
    p, r = _share(F.col("_n"), F.size("_a") - 1), _share(F.col("_n"), F.size("_b") - 1)
    return x.withColumns({"row_precision": p, "row_recall": r, "row_f1": _f1(p, r)}).drop("_a", "_b", "_n")


Metric = tuple[tuple[str, ...], Callable[[], Column]]
#: Metrics by name: the columns they need and the expression; tiers as lists of names.
METRICS: dict[str, Metric] = {
    "context_relevance": (("question", "contexts"), lambda: E.context_relevance(F.col("question"), F.col("contexts"))),
    "groundedness": (("response", "contexts"), lambda: penalised_groundedness(F.col("response"), F.col("contexts"))),
    "relevancy": (("question", "response"), lambda: E.answer_relevancy(F.col("question"), F.col("response"))),
    "utilisation": (("response", "contexts"), lambda: E.context_utilisation(F.col("response"), F.col("contexts"))),
    "accuracy": (("question", "response", "reference"), lambda: E.answer_accuracy(F.col("question"), F.col("response"), F.col("reference"))),
    "unknown": (("response",), lambda: is_unknown(F.col("response")).cast("double")),
}
PRESETS = {"default": ("relevancy", "utilisation", "groundedness"), "tier1": ("context_relevance", "relevancy"), "tier2": ("groundedness", "accuracy"), "all": tuple(METRICS)}


def evaluate(rows: DataFrame, names: tuple[str, ...] | str = "default") -> DataFrame:
    """Adds a column for every metric, null where a value it needs is null.

    Raises ValueError before anything runs if a metric is unknown or a column it needs is missing.
    """
    names = PRESETS[names] if isinstance(names, str) else names
    for name in names:
        if name not in METRICS:
            raise ValueError(f"no metric {name}")
        missing = [c for c in METRICS[name][0] if c not in rows.columns]
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")

    def cell(name: str) -> Column:
        needs, make = METRICS[name]
        given = F.lit(True)
        for c in needs:
            given = given & F.col(c).isNotNull()
        return F.when(given, make())

    return rows.withColumns({n: cell(n) for n in names})
