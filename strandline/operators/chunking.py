"""Row generators: token windows, sentences, packed sentences, paragraphs, list windows, causal triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, words

# --- fixed values: words that must be there, pattern, whether the effect stands first ---
CAUSAL_PATTERNS = (
    ("causes", r"(?i)([\w\s]+?)\s+causes\s+([\w\s]+)", False),
    ("results in", r"(?i)([\w\s]+?)\s+results in\s+([\w\s]+)", False),
    ("contributes to", r"(?i)([\w\s]+?)\s+contributes to\s+([\w\s]+)", False),
    ("influences", r"(?i)([\w\s]+?)\s+influences\s+([\w\s]+)", False),
    (r"leads\s+to", r"(?i)([\w\s]+?)\s+leads\s+to\s+([\w\s]+)", False),
    ("triggers", r"(?i)([\w\s]+?)\s+triggers\s+([\w\s]+)", False),
    ("induces", r"(?i)([\w\s]+?)\s+induces\s+([\w\s]+)", False),
    ("drives", r"(?i)([\w\s]+?)\s+drives\s+([\w\s]+)", False),
    ("is caused by", r"(?i)([\w\s]+?)\s+is caused by\s+([\w\s]+)", True),
    ("because of", r"(?i)because of\s+([\w\s]+?),\s+([\w\s]+)", False),
    (r"\bif\s", r"(?i)if\s+([\w\s]+?),\s+then\s+([\w\s]+)", False),
)
LEADING = "^(which|that|this|these|those) "
# -----------------------------------------------------------------------------------------


def window_starts(n: Column, size: int, step: int) -> Column:
    """Starts of windows over n items, counted from 0: all multiples of the step below n."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def token_windows(docs: DataFrame, key: str, tokens: Column, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(key, ord, tokens, content): windows of ``size`` tokens that share ``overlap``.

    A last window that lies within the one before is kept.  Texts without tokens have none.
    """
    t = docs.select(key, tokens.alias("t"))
    at = t.select(key, "t", F.posexplode(window_starts(F.size("t"), size, size - overlap)).alias("ord", "start"))
    part = F.slice("t", F.col("start") + 1, size)
    return at.select(key, "ord", F.size(part).alias("tokens"), F.array_join(part, " ").alias("content"))


def merged_tail_windows(docs: DataFrame, key: str, tokens: Column, size: int = 1000, overlap: int = 200, least: int = 100) -> DataFrame:
    """As token_windows, but a last window shorter than ``least`` joins the one before."""
    step = size - overlap
    t = docs.select(key, tokens.alias("t"))
    n = F.size("t")
    starts = F.when(n <= size, F.when(n > 0, F.array(F.lit(0)))).otherwise(F.sequence(F.lit(0), n - 1 - overlap, F.lit(step)))
    kept = F.when((F.size(starts) > 1) & (n - F.element_at(starts, -1) < least), F.slice(starts, 1, F.size(starts) - 1)).otherwise(starts)
    at = t.withColumn("starts", kept).select(key, "t", F.size("starts").alias("m"), F.posexplode("starts").alias("ord", "start"))
    end = F.when(F.col("ord") == F.col("m") - 1, n).otherwise(F.col("start") + size)
    part = F.slice("t", F.col("start") + 1, end - F.col("start"))
    return at.select(key, "ord", F.size(part).alias("tokens"), F.array_join(part, " ").alias("content"))


def sentences(c: Column) -> Column:
    """Rough sentences: after ``.``, ``!`` or ``?`` and a blank."""
    marked = F.regexp_replace(c, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def packed_sentences(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, ord, words, content): sentences in order, a new chunk where the word count would exceed ``most``."""
    item = F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("s"), F.size(words(s)).alias("n")))
    start = F.struct(F.array().cast("array<struct<content:string,words:int>>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        close = (acc["n"] > 0) & (acc["n"] + x["n"] > most)
        made = F.struct(acc["now"].alias("content"), acc["n"].alias("words"))
        return F.struct(
            F.when(close, F.array_append(acc["done"], made)).otherwise(acc["done"]).alias("done"),
            F.when(close | (acc["n"] == 0), x["s"]).otherwise(F.concat(acc["now"], F.lit(" "), x["s"])).alias("now"),
            F.when(close, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.array_append(acc["done"], F.struct(acc["now"].alias("content"), acc["n"].alias("words")))).otherwise(acc["done"])

    chunks = F.aggregate(item, start, add, finish)
    return docs.select(key, F.posexplode(chunks).alias("ord", "c")).select(key, "ord", F.col("c.words").alias("words"), F.col("c.content").alias("content"))


def paragraphs(c: Column) -> Column:
    marked = F.regexp_replace(c, r"\n[ \t]*\n\s*", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def list_windows(c: Column, size: int, overlap: int) -> Column:
    """Windows over an array that stop once one reaches the end."""
    n, step = F.size(c), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int") * step)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(c, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def causal_triples(docs: DataFrame, key: str, sentence: Column) -> DataFrame:
    """(key, cause, effect, confidence) by patterns, every match of a sentence.

    Sides of fewer than three letters or of stop words only are dropped.
    """

    def side(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.trim(F.lower(F.regexp_replace(c, r"\s+", " "))), LEADING, ""))

    found = []
    for verb, pattern, reverse in CAUSAL_PATTERNS:
        # the words alone are found in linear time; only sentences that have them are matched with both sides
        a, b = (F.regexp_extract_all(sentence, F.lit(pattern), i) for i in (1, 2))
        both = F.zip_with(*((b, a) if reverse else (a, b)), lambda x, y: F.struct(x.alias("cause"), y.alias("effect")))
        found.append(F.when(sentence.rlike(f"(?i){verb}"), both).otherwise(F.array().cast("array<struct<cause:string,effect:string>>")))
    rows = docs.select(key, F.explode(F.flatten(F.array(*found))).alias("x")).select(key, side(F.col("x.cause")).alias("cause"), side(F.col("x.effect")).alias("effect"))
    stop = F.array(*map(F.lit, STOP_WORDS))
    for c in ("cause", "effect"):
        rows = rows.where((F.length(c) >= 3) & (F.size(F.array_except(F.split(c, " "), stop)) > 0))
    return rows.withColumn("confidence", F.when((F.length("cause") < 5) | (F.length("effect") < 5), 0.6).otherwise(0.8))


def delimited_windows(docs: DataFrame, key: str, text: Column, delimiter: str, size: int, overlap: int, only: bool = False) -> DataFrame:
    """(key, ord, tokens, content): parts between delimiters; those of over ``size`` words in windows that share ``overlap``.

    With ``only`` a part that is too long fails the job.  Parts without words have none.
    """
    parts = docs.select(key, F.posexplode(F.split(text, f"\\Q{delimiter}\\E")).alias("part", "body"))
    t = parts.select(key, "part", words(F.col("body")).alias("t")).where(F.size("t") > 0)
    whole = F.size("t") <= size
    cut = F.raise_error(F.lit("a part is longer than a chunk")) if only else window_starts(F.size("t"), size, size - overlap)
    at = t.select(key, "part", "t", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(cut)).alias("start"))
    part = F.slice("t", F.col("start") + 1, size)
    order = Window.partitionBy(key).orderBy("part", "start")
    return at.select(key, (F.row_number().over(order) - 1).alias("ord"), F.size(part).alias("tokens"), F.array_join(part, " ").alias("content"))
