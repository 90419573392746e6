"""Text functions as column expressions: normal forms, tokens, sets, hashes, JSON repair.

All take and give columns, run inside whole-stage code generation and give null
for null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------
ARTICLES = ("a", "an", "the")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
STOP_WORDS = (
    "a an and are as at be because by can could for from has have if in into is it its leads of on or that the then this to was were which with"
).split()
QUESTION_WORDS = ("What", "Which", "Who", "Whom", "Whose", "When", "Where", "Why", "How", "Is", "Are", "Was", "Were", "Do", "Does", "Did", "Can", "Could")
UNKNOWN_PATTERNS = (
    r"\bunknown\b",
    r"\bnone\b",
    r"\bno\s+direct\s+cause\b",
    r"\bnot\s+enough\s+information\b",
    r"\b(do\s+not|dont|don\s+t)\s+know\b",
)
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")
# -----------------------------------------------------------------------------------
UNKNOWN_PATTERN = "|".join(UNKNOWN_PATTERNS)
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_edges(pattern: str) -> str:
    """The pattern with ``\\b`` between an ASCII word character and any other, whatever the JVM: Java 17 takes all letters for word characters."""
    return pattern.replace(r"\b", EDGE)


def words(c: Column) -> Column:
    """Words between blanks; an empty array for an empty text."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def without_articles(c: Column) -> Column:
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(*ARTICLES)), " ")


def answer_norm(c: Column) -> Column:
    """Lower case, punctuation dropped, articles dropped, blanks collapsed."""
    return without_articles(F.regexp_replace(F.lower(c), PUNCTUATION, ""))


def experiment_norm(c: Column) -> Column:
    """As answer_norm, but whatever is no ASCII letter or digit becomes a blank."""
    return without_articles(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "))


def triple_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "))


def unicode_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1)


def content_tokens(c: Column) -> Column:
    """Distinct ASCII tokens without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def coverage(a: Column, b: Column) -> Column:
    """Share of the first set that is in the second; 0 where the first is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(F.array_distinct(a), b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def content_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(c))


def short_hash(*parts: Column) -> Column:
    """First eight characters of the URL-safe base64 of a SHA-256."""
    digest = F.base64(F.unhex(F.sha2(F.concat_ws("|", *parts), 256)))
    return F.substring(F.translate(digest, "+/", "-_"), 1, 8)


def java_hash(c: Column) -> Column:
    """The JVM's 32-bit string hash of a text of the basic plane, as an unsigned number."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: (acc * 31 + x).bitwiseAND(F.lit(4294967295).cast("long")))


def is_unknown(c: Column) -> Column:
    return experiment_norm(c).rlike(UNKNOWN_PATTERN)


def as_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def finite_or(c: Column, default: float) -> Column:
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def identifier_norm(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), "^\"+|\"+$", ""))


def csv_field(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\n\r]'), quoted).otherwise(c)


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def keyword_hits(text: Column, keywords: Column) -> Column:
    """Number of keywords that the lower-cased text contains, as substrings."""
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), k)))


def title_phrases(c: Column) -> Column:
    """Runs of capitalised ASCII words, question words at the start dropped."""
    runs = F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), 1)
    bare = F.transform(runs, lambda r: F.regexp_replace(r, "^(" + "|".join(QUESTION_WORDS) + ") ?", ""))
    return F.array_distinct(F.filter(bare, lambda r: r != ""))


def json_answer(c: Column) -> Column:
    """The ``answer`` field of a text's JSON object, fenced or bare; null where there is none.

    Of an object that breaks off, what there is of the field: the string is closed where the text ends.
    """
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    begun = F.regexp_extract(c, r'(?s)\{\s*"answer"\s*:\s*("(?:[^"\\]|\\.)*)', 1)
    closed = F.concat(F.lit('{"answer":'), F.replace(begun, F.lit("\n"), F.lit("\\n")), F.lit('"}'))
    return F.when(body != "", F.get_json_object(body, "$.answer")).when(begun != "", F.get_json_object(closed, "$.answer"))


def html_to_text(c: Column) -> Column:
    bare = F.regexp_replace(c, ascii_edges(r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>"), " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def parse_triple(c: Column) -> Column:
    """``(a, b, c)`` to its parts; commas always divide."""
    bare = F.regexp_replace(c, r"^[\s(\[]+|[\s)\]]+$", "")
    parts = F.transform(F.split(bare, ","), lambda p: F.regexp_replace(F.trim(p), "^['\"]+|['\"]+$", ""))
    return F.filter(parts, lambda p: p != "")


def sub_questions(c: Column) -> Column:
    """A question joined by ``and`` split in two or three, if each part has eight letters at least."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(c), r"\?+$", ""), r"(?i)\s+and\s+"), lambda p: F.trim(p))
    good = F.size(parts).between(2, 3) & F.forall(parts, lambda p: F.length(p) >= 8)
    return F.when(good, F.transform(parts, lambda p: F.concat(p, F.lit("?")))).otherwise(F.array(F.trim(c)))


# --- fixed value: a heading Introduction, and the headings that end its part ---------
INTRODUCTION = r"(?is)(?:^|\n)[ \t]*(?:\d+\.?[ \t]*)?introduction[ \t]*\n(.*?)(?:\n[ \t]*(?:\d+\.?[ \t]*)?(?:methods?|background|related work|results|discussion|conclusions?|references)[ \t]*\n|$)"
# ---------------------------------------------------------------------------------------


def introduction(c: Column, most: int = 2_200) -> Column:
    part = F.trim(F.regexp_extract(c, INTRODUCTION, 1))
    pieces = F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")
    return F.substring(F.when(part != "", part).otherwise(F.array_join(F.slice(pieces, 1, 4), " ")), 1, most)


def is_substantial(text: Column, abstract: Column) -> Column:
    return (F.length(text) >= 1_800) & (F.length(text) >= 2 * F.coalesce(F.length(abstract), F.lit(0)))


def args_key(*args: Column) -> Column:
    """MD5 of a call's arguments as a list in brackets."""
    return F.md5(F.concat(F.lit("["), F.concat_ws(", ", *[F.coalesce(a.cast("string"), F.lit("null")) for a in args]), F.lit("]")))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` replaced by values, null by nothing; unknown names stay."""
    out, at = [], 0
    import re

    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) in values:
            out += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def canonical_json(m: Column) -> Column:
    """A map of strings as JSON whose keys stand in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def enhanced(question: Column) -> Column:
    """A question with its capitalised phrases and its content words."""
    named, key = F.array_sort(title_phrases(question)), F.array_sort(content_tokens(question))
    part = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(label), F.array_join(x, ", "))).otherwise("")
    return F.concat(question, part(" Entities: ", named), part(" Key terms: ", key))


def unicode_decoded(c: Column) -> Column:
    """Escapes of four hexadecimal digits, pairs of surrogates among them, as their characters; a text without any stays."""
    body = F.regexp_replace(F.regexp_replace(c, r'\\(?!u[0-9A-Fa-f]{4})', r"\\\\\\\\"), '"', r'\\\\"')
    for char, escape in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        body = F.replace(body, F.lit(char), F.lit(escape.replace("\\\\", "\\")))
    decoded = F.get_json_object(F.concat(F.lit('{"x":"'), body, F.lit('"}')), "$.x")
    return F.when(c.rlike(r"\\u[0-9A-Fa-f]{4}"), F.coalesce(decoded, c)).otherwise(c)


def context_values(c: Column) -> Column:
    """The ``content`` column, else the ``context`` column, of every fenced CSV block of a text: the values that are not blank.

    Fields may be quoted, with quotes doubled; a field with a line break ends its row.
    """
    field = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
    fields = lambda line: F.transform(F.regexp_extract_all(line, F.lit(field), 1), lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))

    def block(b: Column) -> Column:
        lines = F.filter(F.split(b, r"\r?\n"), lambda x: F.trim(x) != "")
        head = F.transform(fields(F.get(lines, 0)), lambda x: F.lower(F.trim(x)))
        at = F.when(F.array_contains(head, "content"), F.array_position(head, "content")).otherwise(F.array_position(head, "context"))
        values = F.transform(F.slice(lines, 2, 1_000_000_000), lambda x: F.get(fields(x), at.cast("int") - 1))
        return F.when(at > 0, F.filter(values, lambda v: F.trim(v) != "")).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)```csv\s*\n(.*?)```"), 1), block))
