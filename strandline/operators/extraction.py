"""Extraction by a model: triples, entities with gleaning, claims, schema types.

Models are functions from prompts to texts (``functions.hooks``).  Their output is
read as JSON, fenced or bare, with the names that fields go by; what cannot be
read gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hooks import Model, answered
from ..functions.text import clamp

# --- fixed values: names that a field goes by ---------------------------------------
CAUSE_NAMES = ("cause", "source", "from", "subject")
EFFECT_NAMES = ("effect", "target", "to", "object")
CLAIM_FIELDS = ("subject", "object", "type", "status", "start_date", "end_date", "description", "source_text")
DEFAULT_CONFIDENCE = 0.7
# -------------------------------------------------------------------------------------


def json_objects(output: Column) -> Column:
    """The objects of the first JSON array in a text, as maps of strings; empty where there is none."""
    body = F.regexp_extract(output, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(F.when(body != "", body), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))


def field(m: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.element_at(m, n) for n in names])


def triples_of(rows: DataFrame, key: str, output: Column) -> DataFrame:
    """(key, cause, effect, confidence) of the models' triples; sides are trimmed and lowered, a missing confidence is 0.7."""
    x = rows.select(key, F.explode(json_objects(output)).alias("m"))
    side = lambda names: F.lower(F.trim(field(F.col("m"), names)))
    given = F.try_to_number(F.element_at("m", "confidence"), F.lit("S9999.9999")).cast("double")
    out = x.select(key, side(CAUSE_NAMES).alias("cause"), side(EFFECT_NAMES).alias("effect"), clamp(F.coalesce(given, F.lit(DEFAULT_CONFIDENCE))).alias("confidence"))
    return out.where("cause <> '' and effect <> ''")


def model_triples(chunks: DataFrame, key: str, prompt: Column, model: Model) -> DataFrame:
    return triples_of(chunks.withColumn("_out", answered(prompt, model)), key, F.col("_out"))


def merged_triples(rules: DataFrame, modelled: DataFrame) -> DataFrame:
    """Triples of rules, and those of the model whose sides no rule has (cause, effect, confidence, origin); the surest of each."""

    def best(df: DataFrame, origin: str) -> DataFrame:
        return df.groupBy("cause", "effect").agg(F.max("confidence").alias("confidence")).withColumn("origin", F.lit(origin))

    a, b = best(rules, "rule"), best(modelled, "model")
    return a.unionByName(b.join(a.select("cause", "effect"), ["cause", "effect"], "left_anti"))


def gleaned(chunks: DataFrame, key: str, text: Column, model: Model, rounds: int = 1) -> DataFrame:
    """(key, round, name, type, description): entities of a first answer and of up to ``rounds`` asked for more.

    A chunk goes on as long as the model answers yes to whether some are left.
    Entities are kept once by name, from the first round that has them.
    """
    rows = chunks.select(key, text.alias("_text"))
    found = None
    for i in range(rounds + 1):
        said = rows.withColumn("_out", answered(F.concat(F.lit("entities:" if i == 0 else "more entities:"), F.col("_text")), model))
        part = said.select(key, F.lit(i).alias("round"), F.explode(json_objects(F.col("_out"))).alias("m"))
        part = part.select(key, "round", F.upper(F.trim(F.element_at("m", "name"))).alias("name"), F.element_at("m", "type").alias("type"), F.element_at("m", "description").alias("description")).where("name <> ''")
        found = part if found is None else found.unionByName(part)
        if i < rounds:
            more = answered(F.concat(F.lit("any left?:"), F.col("_text")), model)
            rows = rows.where(F.lower(F.trim(more)).startswith("yes"))
    first = F.min_by(F.struct("round", "type", "description"), F.struct("round", "type", "description"))
    return found.groupBy(key, "name").agg(first.alias("x")).select(key, "x.round", "name", "x.type", "x.description")


def claims_of(rows: DataFrame, key: str, output: Column) -> DataFrame:
    """One row of eight fields for every claim with a subject; fields that are missing are empty."""
    x = rows.select(key, F.explode(json_objects(output)).alias("m"))
    return x.select(key, *[F.coalesce(F.trim(F.element_at("m", f)), F.lit("")).alias(f) for f in CLAIM_FIELDS]).where("subject <> ''")


def evolved(schema: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, type, added): the schema's types and, behind them, new ones that differ in more than case and blanks."""
    norm = F.lower(F.trim("type"))
    old = schema.select("kind", "type", F.lit(0).alias("added"))
    new = found.where(norm != "").groupBy("kind", norm.alias("n")).agg(F.min(F.trim("type")).alias("type"))
    fresh = new.join(schema.select("kind", norm.alias("n")), ["kind", "n"], "left_anti").select("kind", "type", F.lit(1).alias("added"))
    return old.unionByName(fresh)
