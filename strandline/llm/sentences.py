"""Sentence boundaries across languages and scripts.

The boundary rules are compiled into a finite transducer.  A lexer turns a
text into *events* (terminator runs, quotes, brackets, line breaks, Thai
spaces); every event is reduced, by a bounded look at its neighbourhood, to a
symbol that does not depend on what came before.  The transducer's state holds
what does: the open quotation and how it began, the open bracket and how it
began, whether the current unit has content yet and whether it is a list item.

Because the symbols are independent of the state, a piece of a document is a
function from entering state to leaving state.  Documents longer than
``chunk_chars`` are cut between two letters of a word, where no event can lie;
every piece is lexed in parallel and its function computed for all states; the
functions are composed by a prefix scan in two levels (the pieces of a run of
``RUN`` pieces, then the runs), and each piece is run from its now known
entering state.  Short documents are one piece, run by the same loop from the
initial state.  All of it is linear in the length of the text.

Defined results: null, empty and blank texts have no units; units never
overlap and never contain surrounding blanks; repeated rows give repeated
units; extra input columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# --- fixed values: abbreviations by language, months, quotation marks -------
NEVER_END = frozenset(
    # English
    "dr prof mr mrs ms st ph fig figs vol vols cf vs approx eq sec ch pp e.g i.e ca rev gen col capt lt sgt hon dept "
    # German
    "fa nr vgl abb tab bzw evtl bd hrsg jh jhd mio mrd z.b d.h u.a str "
    # French
    "mme mlle pr env éd art chap av "
    # Spanish
    "sr sra srta dra pág págs núm ej p.ej cap ud uds "
    # Russian
    "г гг пос т т.е е рис см проф тыс млн млрд ул им обл стр акад доц "
    # Greek
    "κ κα δηλ χιλ π χ βλ σελ αρ δρ καθ "
    # Arabic
    "د أ م ص ج "
    # Hindi
    "डॉ प्रो श्री पृ सं रु "
    # Thai
    "ดร พ.ศ ค.ศ ศ ผศ รศ".split()
)
END_IF_CAPITAL = frozenset("etc usw p.m a.m al ff jr ph.d др д ap.m κ.λπ bros u.s".split())
COMPANY = frozenset("inc ltd co corp llc plc gmbh".split())
OPENERS_OF_SENTENCES = frozenset(
    "The A An In It He She They This That These Those But And However At By On Of For From Some What Who Why How When Where Is Does Did No Nobody See Work Data Version Without Because There Turnover Visit Roughly Samples Researchers".split()
)
GERMAN_AFTER_ORDINAL = frozenset(
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jh Jahrestag Auflage Kapitel".split()
)
CLOSER = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』"}
QUOTES = '"“”„«»「」『』'
KINDS = ["", '"', "“", "„", "«", "»", "「", "『"]
OPENING = "\"'(（[“”„«»「『《‘¿¡"
CLOSING = "'’]"
TERMINATORS = ".!?…。！？．।॥؟"
BLANKS = " \t\r\n\f\v\xa0　﻿​    "
# -----------------------------------------------------------------------------

# One character class first, so that the scan between events is a table lookup;
# what follows is chosen by looking back at the character just read.
_AFTER = (
    r"(?<=\n)[\s﻿]*(?:(?:[-*•–·]|\d{1,3}\))[ \t]+)?"
    r"|(?<=[!?…。！？．।॥؟])[.!?…。！？．]*"
    r"|(?<=\.)(?![\da-z/_])[.!?…。！？．]*"
    r'|(?<=["“”„«»「」『』(（)）])'
)
_FIRST = r'\n.!?…。！？．।॥؟"“”„«»「」『』(（)）'
EVENT = re.compile(f"[{_FIRST}](?:{_AFTER})")
EVENT_THAI_GREEK = re.compile(rf"[{_FIRST}; \t\xa0](?:{_AFTER}|(?<=[ก-๛][ \t\xa0])[ \t\xa0]*(?=[ก-๛A-Z])|(?<=[Ͱ-Ͽἀ-῿];))")
THAI_GREEK = re.compile("[ก-๛Ͱ-Ͽἀ-῿]")


def _lexer(text: str) -> re.Pattern:
    return EVENT if text.isascii() or not THAI_GREEK.search(text) else EVENT_THAI_GREEK


FIRST_WORD = re.compile(r"\w+")
START_MARK = re.compile(r"[\s﻿]*(?:[-*•–·]|\d{1,3}\))[ \t]+")

# symbols: kind * 2 + gap ; kinds below ENTRIES are fixed, quotes follow
NOP, TERM, PARA, LIST, LINE, P_OPEN, P_CLOSE, P_CLOSE_END, QUOTE0 = range(9)
_N_STATES = 22 * 3 * 2 * 2


def _pack(q: int, p: int, fresh: int, item: int) -> int:
    """q: 0, or 1 + 3 * (kind - 1) + how it began; p: 0 none, 1 began a unit, 2 within one."""
    return ((q * 3 + p) * 2 + fresh) * 2 + item


START, START_ITEM = _pack(0, 0, 1, 0), _pack(0, 0, 1, 1)


def _step(state: int, sym: int) -> int:
    """The transducer's table: (state, symbol) to leaving state * 2 + output."""
    gap, kind = sym & 1, sym >> 1
    item, fresh, p, q = state & 1, state >> 1 & 1, state // 4 % 3, state // 12
    fresh = fresh & (1 - gap)
    out = 0
    if kind == TERM:
        out = q == 0 and p == 0
    elif kind in (PARA, LIST):
        return START_ITEM * 2 + 1 if kind == LIST else START * 2 + 1
    elif kind == LINE:
        out = item and q == 0 and p == 0
    elif kind == P_OPEN:
        if p == 0:
            p = 1 if fresh else 2
        fresh = 0
    elif kind in (P_CLOSE, P_CLOSE_END):
        out = q == 0 and p == 1 and kind == P_CLOSE_END
        fresh, p = 0, 0
    elif kind >= QUOTE0:
        code = kind - QUOTE0
        ends, colon, ch = code & 7, code >> 3 & 1, QUOTES[code >> 4]
        if q == 0:
            if ch in CLOSER:
                q = 1 + 3 * (KINDS.index(ch) - 1) + (1 if fresh else 2 if colon else 0)
            fresh = 0
        else:
            if ch in CLOSER[KINDS[(q - 1) // 3 + 1]]:
                out = p == 0 and bool(ends >> ((q - 1) % 3) & 1)
                q = 0
            fresh = 0
    if out:
        return START * 2 + 1
    return _pack(q, p, fresh, item) * 2


_TABLE: dict[int, int] = {}


def _cased(c: str) -> bool:
    return c.isupper() or c.istitle()


def _caseless(c: str) -> bool:
    return c.isalpha() and not c.isupper() and not c.islower()


def _after(text: str, i: int) -> str:
    """The next character that is not blank, or nothing."""
    n = len(text)
    while i < n and text[i] in BLANKS:
        i += 1
    return text[i] if i < n else ""


def _full_stop(text: str, a: int, b: int) -> bool:
    """Does the single full stop at a end a unit, outside quotes and brackets?"""
    nxt = text[b] if b < len(text) else ""
    if nxt and nxt in ",;:)]%":
        return False
    lo = a - 24 if a > 24 else 0
    word = text[max(text.rfind(" ", lo, a) + 1, lo) : a]
    spaced = not nxt or nxt in BLANKS
    if spaced and len(word) > 6 and word.isalpha():
        return True  # longer than any abbreviation
    before = text[lo:a]
    if not word.isalnum():
        word = word.split()[-1] if word.strip() else ""
        word = word.lstrip(OPENING)
    low = word.lower()
    if "." in word and low not in NEVER_END and low not in END_IF_CAPITAL and not word.isupper():
        word = word[word.rindex(".") + 1 :]
        low = word.lower()
    if not spaced:
        if nxt.isalpha():
            prev = before[-1:]
            if len(word) < 2 or low in NEVER_END or low in END_IF_CAPITAL or low in COMPANY:
                return False
            return (prev.islower() or prev.isdigit() or _caseless(prev)) and (_cased(nxt) or _caseless(nxt))
        if nxt in "\"“„«»「『(（¿¡":
            return low not in NEVER_END
        return nxt not in "'’-–/"
    c = _after(text, b)
    if not c:
        return True
    if low == "no" and c.isdigit():
        return False
    if low in NEVER_END:
        return False
    if len(word) == 1 and word.isalpha():
        if low == "m" and before[-5:-1].strip().endswith("v."):
            return _cased(c) or c in '"“„«»('
        if low == "д" and before[-5:-1].strip().endswith("т."):
            return _cased(c)
        return False  # an initial or a unit
    if "." in word and all(len(x) == 1 for x in word.split(".")) and word.isupper():
        return False
    if low in END_IF_CAPITAL:
        return _cased(c) or _caseless(c) or c in "\"“„«»「¿¡" or c == "(" and low != "al"
    if low in COMPANY:
        j = FIRST_WORD.search(text, b)
        return c in "\"“„«(" or bool(j) and j.group() in OPENERS_OF_SENTENCES
    if word.isdigit():
        line = before[: -len(word)].rstrip(" \t-*•")
        if (not line and a - len(word) < 20 and not text[: a - len(word)].strip()) or line.endswith("\n"):
            return False  # numbered heading
        j = FIRST_WORD.search(text, b)
        if j and j.group() in GERMAN_AFTER_ORDINAL and len(word) < 3:
            return False
    return True


def _symbol(text: str, m: re.Match) -> tuple[int, int]:
    """Kind of an event and the place where a unit would end if it ends here."""
    a, b = m.span()
    ch = text[a]
    if ch in TERMINATORS:
        run = m.group()
        nxt = text[b] if b < len(text) else ""
        if run == ".":
            if not _full_stop(text, a, b):
                return NOP, b
            ends = True
        elif nxt and nxt in ",;:、，；)]":
            ends = False
        elif "?" in run or "!" in run:
            ends = not (nxt and (nxt.islower() or nxt.isdigit() or nxt in "=&/"))
        elif run[0] in ".…" and not set(run) & set("。．"):
            c = _after(text, b)
            ends = not c or (not c.islower() and not (nxt.isdigit() and a == b - 2))
        else:
            ends = True
        if ends and nxt and nxt in CLOSING:  # closers without an opener, or of a quotation that the state closes
            while b < len(text) and text[b] in "'’]" and (b + 1 == len(text) or text[b + 1] in BLANKS):
                b += 1
        return (TERM if ends else NOP), b
    if ch in QUOTES:
        i = a - 1
        while i >= 0 and a - i < 4 and text[i] in BLANKS:
            i -= 1
        prev = text[i] if i >= 0 else ""
        colon = int(prev in ",:：，،、" and prev != "")
        ends = 0
        if prev and prev in TERMINATORS or prev == ";":
            nxt = text[b] if b < len(text) else ""
            c = _after(text, b)
            if not (nxt and nxt in ",;:、，；)]）。！？.!?%") and c not in ("—", "–", "-", ","):
                if not c:
                    ends = 7
                elif ch in "」』":
                    ends = 0 if c in "とっ" else 5
                else:
                    spaced = nxt in BLANKS
                    mid = not c.islower() or prev == "."
                    ends = int(mid) | (2 if spaced and _cased(c) else 0) | 4
        return QUOTE0 + (QUOTES.index(ch) << 4 | colon << 3 | ends), b
    if ch == "\n":
        run = m.group()
        if run.rstrip(" \t")[-1:] not in "\n\r\f\v\xa0　﻿  ​" and run.strip("﻿ \t\r\n\xa0　"):
            return LIST, a
        if run.count("\n") > 1:
            return PARA, a
        prev = text[a - 1] if a else ""
        nxt = text[b] if b < len(text) else ""
        if "ก" <= prev <= "๛":
            return (TERM if not nxt.isdigit() and not text.startswith("พ.ศ", b) else NOP), a
        return LINE, a
    if ch in "(（":
        return P_OPEN, b
    if ch in ")）":
        i = a - 1
        prev = text[i] if i >= 0 else ""
        nxt = text[b] if b < len(text) else ""
        return (P_CLOSE_END if prev and prev in TERMINATORS and not (nxt and nxt in ",;:.!?。，") else P_CLOSE), b
    if ch != ";":
        return (NOP if text.startswith("พ.ศ", b) or text.startswith("ค.ศ", b) else TERM), a
    return (TERM if b >= len(text) or text[b] in BLANKS else NOP), b


def events(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Symbols (with the gap bit) and unit ends of the events that begin in [lo, hi).

    An event that ends nothing is part of the text around it.  What is left
    behind the last event is told by a last symbol, if it is not blank.
    """
    at, symbol = lo, _symbol
    for m in _lexer(text).finditer(text, lo):
        a = m.start()
        if a >= hi:
            break
        kind, end = symbol(text, m)
        if kind == NOP:
            continue
        gap = a > at and (text[a - 1] not in BLANKS or text[at] not in BLANKS or bool(text[at:a].strip(BLANKS)))
        at = m.end()
        yield kind * 2 + gap, end
    if hi > at and text[at:hi].strip(BLANKS):
        yield NOP * 2 + 1, hi


def run(text: str, lo: int, hi: int, state: int) -> list[int]:
    """Ends of units within [lo, hi) from the entering state."""
    ends, table = [], _TABLE
    for sym, end in events(text, lo, hi):
        key = sym << 9 | state
        v = table.get(key)
        if v is None:
            v = table[key] = _step(state, sym)
        state = v >> 1
        if v & 1:
            ends.append(end)
    return ends


def function_of(text: str, lo: int, hi: int) -> list[int]:
    """The leaving state of [lo, hi) for every entering state; equal states are carried on as one."""
    now, classes = list(range(_N_STATES)), list(range(_N_STATES))
    for sym, _ in events(text, lo, hi):
        step = {}
        for s in set(now):
            key = sym << 9 | s
            v = _TABLE.get(key)
            if v is None:
                v = _TABLE[key] = _step(s, sym)
            step[s] = v >> 1
        now = [step[s] for s in now]
        if len(set(now)) < len(now):
            first: dict[int, int] = {}
            to = [first.setdefault(s, len(first)) for s in now]
            classes, now = [to[c] for c in classes], list(first)
    return [now[c] for c in classes]


def entering(text: str) -> int:
    return START_ITEM if START_MARK.match(text) else START


def spans(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """Trimmed units between consecutive ends."""
    out, at, n = [], 0, len(text)
    for e in [*ends, n]:
        s = at
        while s < e and text[s] in BLANKS:
            s += 1
        t = e
        while t > s and text[t - 1] in BLANKS:
            t -= 1
        if t > s:
            out.append((s, t))
        if e > at:
            at = e
    return out


def split(text: str | None) -> list[tuple[int, int]]:
    """Units of one text."""
    if not text or not text.strip(BLANKS):
        return []
    return spans(text, run(text, 0, len(text), entering(text)))


MARGIN = 96  # code points around a piece; the rules look at no more
RUN = 64  # pieces of a run


def cuts(text: str, size: int) -> list[int]:
    """Beginnings of pieces of at least ``size`` code points, each between two letters, and the text's length."""
    out, n = [0], len(text)
    at = size
    while at < n:
        if text[at].isalpha() and text[at - 1].isalpha():
            out.append(at)
            at += size
        else:
            at += 1
    return [*out, n]


def _trimmed(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    while lo < hi and text[lo] in BLANKS:
        lo += 1
    while hi > lo and text[hi - 1] in BLANKS:
        hi -= 1
    return (lo, hi) if hi > lo else None


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_chars: int = 16_384) -> DataFrame:
    """One row (key, start_char, end_char) per sentence unit.

    Texts of up to ``chunk_chars`` code points are run in place, without a
    shuffle.  Longer ones are cut, and only their pieces (with ``MARGIN`` code
    points of context on both sides) and state functions are moved.
    """
    from pyspark.sql import types as T

    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length(F.trim("t")) > 0)
    result = T.StructType([T.StructField("k", kind), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ks, ss, es = [], [], []
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist(), strict=True):
                for s, e in split(t):
                    ks.append(k)
                    ss.append(s)
                    es.append(e)
            yield pd.DataFrame({"k": pd.Series(ks, dtype=pdf["k"].dtype), "start_char": pd.Series(ss, dtype="int64"), "end_char": pd.Series(es, dtype="int64")})

    short = rows.where(F.length("t") <= chunk_chars).mapInPandas(whole, result)
    # long texts are processed once each, by their digest; keys may repeat or be null
    long = rows.where(F.length("t") > chunk_chars).withColumn("h", F.sha2("t", 256))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, t in zip(pdf["h"], pdf["t"], strict=True):
                at = cuts(t, chunk_chars)
                out = []
                for i, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                    base = max(0, lo - MARGIN)
                    out.append((h, i, base, lo - base, hi - base, t[base : hi + MARGIN]))
                yield pd.DataFrame(out, columns=["h", "i", "base", "lo", "hi", "t"])

    texts = long.select("h", "t").dropDuplicates(["h"])
    pieces = checkpointed(texts.mapInPandas(cut, "h string, i int, base long, lo int, hi int, t string").repartition("h", "i"))

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fs = []
            for i, lo, hi, t in zip(pdf["i"], pdf["lo"], pdf["hi"], pdf["t"], strict=True):
                f = function_of(t, lo, hi)
                fs.append(_packed([f[entering(t)]] * _N_STATES if i == 0 else f))  # the first piece's entering state is known
            yield pdf[["h", "i"]].assign(run=pdf["i"] // RUN, f=fs)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each function the composition of those before it, and of all behind the last."""
        pdf = pdf.sort_values("i")
        now, out = np.arange(_N_STATES, dtype=np.int16), []
        for f in pdf["f"]:
            out.append(now.tobytes())
            now = np.frombuffer(f, dtype=np.int16)[now]
        return pd.DataFrame({"h": pdf["h"].iloc[0], "i": [*pdf["i"], -1], "run": pdf["run"].iloc[0], "f": [*out, now.tobytes()]})

    maps = pieces.mapInPandas(functions, "h string, i int, run int, f binary")
    within = checkpointed(maps.groupBy("h", "run").applyInPandas(scan, "h string, i int, run int, f binary"))
    runs = within.where("i < 0").select("h", F.col("run").alias("i"), F.lit(0).alias("run"), "f")
    across = runs.groupBy("h").applyInPandas(scan, "h string, i int, run int, f binary").where("i >= 0").select("h", F.col("i").alias("run"), F.col("f").alias("before"))
    entered = within.where("i >= 0").join(across, ["h", "run"]).select("h", "i", "f", "before")

    def units_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, i, base, lo, hi, t, f, before in zip(*(pdf[c].tolist() for c in ("h", "i", "base", "lo", "hi", "t", "f", "before")), strict=True):
                if i:
                    state = int(np.frombuffer(f, dtype=np.int16)[np.frombuffer(before, dtype=np.int16)[START]])
                else:
                    state = entering(t)
                at: int | None = 0 if i == 0 else None  # where the unit begins; unknown for what an earlier piece began
                begun = lo
                for e in [*run(t, lo, hi, state), hi]:
                    if e < begun:
                        continue
                    x = _trimmed(t, begun, e)
                    # a unit is whole if it begins and ends in this piece
                    out.append((h, i, at, e == hi, *((x[0] + base, x[1] + base) if x else (None, None))))
                    begun = e
                    at = base + e
            yield pd.DataFrame(out, columns=["h", "i", "at", "open", "s", "e"]).astype({"at": "Int64", "s": "Int64", "e": "Int64"})

    parts = checkpointed(pieces.join(entered, ["h", "i"]).mapInPandas(units_of, "h string, i int, at long, open boolean, s long, e long"))
    whole_units = parts.where("at is not null and not open").select("h", "s", "e")
    # what crosses pieces: a part whose beginning is unknown belongs to the last beginning of the pieces before it
    begins = parts.groupBy("h", "i").agg(F.max("at").alias("last"))
    earlier = Window.partitionBy("h").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select("h", "i", F.max("last").over(earlier).alias("carried"))
    crossing = parts.where("at is null or open").join(begins, ["h", "i"]).groupBy("h", F.coalesce("at", "carried").alias("at")).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    units = whole_units.unionByName(crossing.select("h", "s", "e")).where("s is not null")
    placed = long.select("k", "h").join(units, "h").select("k", F.col("s").alias("start_char"), F.col("e").alias("end_char"))
    return short.unionByName(placed).withColumnRenamed("k", key)


def _packed(f: list[int]) -> bytes:
    return np.array(f, dtype=np.int16).tobytes()
