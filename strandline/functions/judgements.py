"""Heuristic judgements of answers and contexts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import overlap
from .text import ascii_edges, content_tokens, coverage, jaccard, words


def fact_entities(c: Column) -> Column:
    """Years, figures with thousands, and capitalised phrases of a text, in lower case."""
    found = F.flatten(F.array(F.regexp_extract_all(c, F.lit(ascii_edges(r"\b([0-9]{4})\b")), 1), F.regexp_extract_all(c, F.lit("([0-9]{1,3}(?:,[0-9]{3})+)"), 1), F.regexp_extract_all(c, F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), 1)))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def entity_recall(reference: Column, contexts: Column) -> Column:
    """Share of the reference's entities that the contexts have; 0 where it has none."""
    return coverage(fact_entities(reference), fact_entities(F.array_join(contexts, " ")))


def verdicts(question: Column, answer: Column, contexts: Column, least: float = 0.35) -> Column:
    """1 for every context that serves the answer: half its words, its entities and the question's words."""
    q, a, e = content_tokens(question), content_tokens(answer), fact_entities(answer)
    score = lambda c: 0.5 * coverage(a, content_tokens(c)) + 0.3 * coverage(e, fact_entities(c)) + 0.2 * coverage(q, content_tokens(c))
    return F.transform(contexts, lambda c: F.when(score(c) >= least, 1).otherwise(0))


def average_precision(v: Column) -> Column:
    """Mean precision at the ranks of the verdicts of 1; 0 without one."""
    n = F.aggregate(v, F.lit(0), lambda s, x: s + x)
    at = F.transform(v, lambda x, i: F.when(x == 1, F.aggregate(F.slice(v, 1, i + 1), F.lit(0), lambda s, y: s + y) / (i + 1)).otherwise(0.0))
    return F.when(n > 0, F.aggregate(at, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)


def noise_sensitivity(statements: Column, reference: Column, contexts: Column, least: float = 0.5) -> Column:
    """Share of statements that the reference does not bear out and a context does."""
    r = content_tokens(reference)
    wrong = lambda s: (coverage(content_tokens(s), r) < least) & F.exists(contexts, lambda c: coverage(content_tokens(s), content_tokens(c)) >= least)
    return F.when(F.size(statements) > 0, F.size(F.filter(statements, wrong)) / F.size(statements)).otherwise(0.0)


def quoted_alignment(answer: Column, contexts: Column, least: int = 3) -> Column:
    """Share of quoted spans of three words at least that stand in the contexts; 1 without any."""
    spans = F.filter(F.regexp_extract_all(answer, F.lit('"([^"]+)"'), 1), lambda s: F.size(words(s)) >= least)
    text = F.lower(F.array_join(contexts, " "))
    return F.when(F.size(spans) > 0, F.size(F.filter(spans, lambda s: F.contains(text, F.lower(s)))) / F.size(spans)).otherwise(1.0)


def summary_score(summary: Column, contexts: Column, weight: float = 0.5) -> Column:
    """Coverage of the contexts' words blended with how much shorter the summary is."""
    text = F.array_join(contexts, " ")
    covered = coverage(content_tokens(text), content_tokens(summary))
    short = F.when(F.length(text) > 0, 1 - F.least(F.length(summary), F.length(text)) / F.length(text)).otherwise(0.0)
    return weight * covered + (1 - weight) * short


def best_match(answer: Column, targets: Column) -> Column:
    """The largest Jaccard similarity with any of the targets; 0 without one."""
    a = content_tokens(answer)
    return F.coalesce(F.array_max(F.transform(targets, lambda t: jaccard(a, content_tokens(t)))), F.lit(0.0))


def best_reference(answer: Column, references: Column) -> Column:
    """The reference of the largest word overlap, an equal one before all, the first of equals."""
    a = words(F.lower(answer))
    score = lambda r: F.when(F.lower(F.trim(r)) == F.lower(F.trim(answer)), 10_000).otherwise(overlap(a, words(F.lower(r))))
    ranked = F.transform(references, lambda r, i: F.struct(score(r).alias("s"), (-i).alias("i"), r.alias("r")))
    return F.array_max(ranked)["r"]


def clauses(c: Column) -> Column:
    """A text's statements: its sentences cut at conjunctions and commas, of two words at least."""
    parts = F.split(F.lower(c), r"[.!?]\s*|,\s*| (?:and|but|while|whereas|although) ")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.size(words(p)) >= 2)
