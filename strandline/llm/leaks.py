"""Evaluation material inside a training corpus.

Every sentence of a held-out item that stands in no other item, and every
question, is cut into windows of ``WINDOW`` tokens (of its own length where it
is shorter).  A window is embedded by the CGK random walk, which turns edit
distance into Hamming distance, and indexed by several bit samples of the
embedding.  The corpus is read once: each document's windows that could hold
an item's window at all are embedded by the same walks and looked up, and every
hit is settled by an exact comparison of the words.  Words of the corpus that
are one slip away from a word of the items (they share a spelling with one
letter left out) walk as that word, so that slips do not hide a window.

The items are the stated query set.  They are taken in blocks of bounded size,
so that the broadcast index is bounded whatever the number of items; the
corpus is never shuffled or collected.

Defined results: null, empty and blank texts hold nothing; null passages and
questions are no material; copies of a document are each reported; an item is
reported once per document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sentences import split

WINDOW = 12  # tokens
SHORTEST = 4  # tokens; shorter sentences are common phrases
LOST = 2  # tokens of a window that may be outside the items' vocabulary
SAMPLES = (12, 8, 6, 6, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5)  # sampled positions of each repetition
STEPS = 2 * WINDOW  # of the walk
BLOCK_CHARS = 4_000_000  # of items held in one broadcast index
PAIRS_LOST = 8  # of an item's neighbouring letters, see _same_letters()
PAIR_BITS = 2_048
NEAR = 1 << 30  # added to the number of a word that is a slip away

# --- fixed values: letters of other scripts that look like Latin ones --------
LOOKALIKES = str.maketrans(
    "авеёкмнорстухіјѕԁԛԝһαβεζηικμνορτυχ",
    "abeekmhopctyxijsdqwhabezhikmvoptux",
)
# -----------------------------------------------------------------------------
TOKEN = re.compile(r"[^\W\d_぀-ヿ㐀-鿿豈-﫿]+(?:[̀-ͯ]+[^\W\d_]*)*|[぀-ヿ㐀-鿿豈-﫿]|\d+(?:[.,]\d+)*")
TOKEN_ASCII = re.compile(r"[A-Za-z]+|\d+(?:[.,]\d+)*")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,40}>")
SIGHTS = re.compile("[<­​-‏⁠﻿]")


def skeleton(token: str) -> str:
    """A token without case, accents, digit grouping and look-alike letters."""
    if token[0].isdigit():
        return token.replace(",", "").replace(".", "")
    t = token.casefold()
    if t.isascii():
        return t
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return t.translate(LOOKALIKES)


def tokens(text: str) -> list[str]:
    if SIGHTS.search(text):
        text = TAG.sub("", INVISIBLE.sub("", text))
    if text.isascii():
        return TOKEN_ASCII.findall(text)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return TOKEN.findall(text)


def _close(a: str, b: str) -> bool:
    """One slip of the pen apart (two in long words); figures never are."""
    if a == b:
        return True
    n = max(len(a), len(b))
    if a[:1].isdigit() or b[:1].isdigit() or n < 3 or abs(len(a) - len(b)) > 2:
        return False
    most = 1 if n < 8 else 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    return max(len(x), len(y)) <= most or (len(x) == 2 and x == y[::-1])


def _left_out(word: str) -> list[str]:
    """The word with one letter left out, each way."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


def _neighbours(words: list[str]) -> Counter:
    """The pairs of neighbouring letters of words written without blanks."""
    text = "".join(words)
    return Counter(map("".join, zip(text, text[1:], strict=False)))


def _letters(words: list[str]) -> tuple[int, Counter]:
    """The pairs of neighbouring letters, and a bit for each (pairs may share one)."""
    pairs, bits = _neighbours(words), 0
    for x, y in pairs:
        bits |= 1 << (ord(x) * 31 + ord(y)) % PAIR_BITS
    return bits, pairs


def _same_letters(item: tuple[int, Counter], around: tuple[int, Counter]) -> bool:
    """A bound on the comparison of letters in held().

    There at most 2 letters of the item are outside the matching blocks and at
    most 4 letters lie between them, which makes 7 blocks at most; so all but
    2 letters and 7 block ends keep their neighbour: 8 pairs are lost at most.
    """
    return (item[0] & ~around[0]).bit_count() <= PAIRS_LOST and (item[1] - around[1]).total() <= PAIRS_LOST


class _Around(list):
    """The words around a hit, with what several items ask of them made once."""

    @cached_property
    def letters(self) -> tuple[int, Counter]:
        return _letters(self)

    @cached_property
    def by_end(self) -> dict[tuple[bool, str], list[str]]:
        ends: dict[tuple[bool, str], list[str]] = {}
        for w in set(self):
            ends.setdefault((False, w[:1]), []).append(w)
            ends.setdefault((True, w[-1:]), []).append(w)
        return ends

    def any_close(self, word: str) -> bool:
        """Is a slip of the word here?  A slip keeps the first letter or the last."""
        n = len(word)
        return any(-3 < len(x) - n < 3 and _close(word, x) for end in ((False, word[:1]), (True, word[-1:])) for x in self.by_end.get(end, ()))


def held(item: list[str], around: list[str], whole_only: bool, rare: set[str] = frozenset()) -> bool:
    """Do the words around a hit hold the item's words: all of them, or at least ``WINDOW`` in a row?

    One changed, added or lost word is allowed, and slips within words.  In a
    part of a sentence, a changed word is allowed only if at least two words
    that are peculiar to the item are there: else it is a like sentence about
    something else.
    """
    n = len(item)
    sm = SequenceMatcher(None, item, around, autojunk=False)
    ok = np.zeros(n, dtype=np.int8)  # 1: there, 0: changed
    extra = np.zeros(n + 1)  # words added before a word
    slips = 0
    for op, i1, i2, j1, j2 in sm.get_opcodes():
        if op == "equal":
            ok[i1:i2] = 1
        elif op == "insert":
            extra[i1] += j2 - j1
        elif op == "replace":
            a, b = item[i1:i2], around[j1:j2]
            if i1 == 0:
                b = b[-len(a) :]
            elif i2 == n:
                b = b[: len(a)]
            for k in range(min(len(a), len(b))):
                if _close(a[k], b[k]):
                    ok[i1 + k] = 1
                    slips += 1
            if i1 and i2 < n and len(b) > len(a):
                extra[i2] += len(b) - len(a)
    if n - ok.sum() + extra[1:n].sum() + 0.2 * slips <= 1.8:
        return True
    a, b = "".join(item), "".join(around)
    if abs(len(a) - len(b)) < 0.8 * len(a) + 60 and _same_letters(_letters(item), _letters(around)):  # layout within words: compare without word limits
        sm = SequenceMatcher(None, a, b, autojunk=False)
        blocks = sm.get_matching_blocks()
        same = sum(x.size for x in blocks if x.size > 1)
        inner = [x for x in blocks if x.size > 1]
        if inner and len(a) - same <= 2 and (inner[-1].b + inner[-1].size - inner[0].b) <= len(a) + 2:
            return True
    if whole_only:
        return False
    for s in range(n - WINDOW + 1):
        if ok[s]:
            lost, e = 0, s + 1
            while e < n:
                lost += (1 - ok[e]) + extra[e]
                if lost > 1:
                    break
                e += 1
            while e > s and not ok[e - 1]:
                e -= 1
            run = range(s, e)
            if e - s >= WINDOW and (ok[s:e].all() and not extra[s + 1 : e].any() or sum(bool(ok[k]) and item[k] in rare for k in run) >= 2):
                return True
    return False


def _walk(x: np.ndarray, rep: int) -> np.ndarray:
    """Keys of one repetition: the random walk over each row's symbols, sampled."""
    rng = np.random.default_rng(7_919 + rep)
    mult = rng.integers(1, 2**63, STEPS, dtype=np.uint64) | np.uint64(1)
    width = x.shape[1]
    steps = 2 * width
    picked = set(rng.permutation(steps)[: min(SAMPLES[rep], steps)].tolist())
    m = len(x)
    flat = np.ascontiguousarray(np.hstack([x, np.full((m, 1), 2**31, dtype=np.uint64)])).ravel()
    base = np.arange(m) * (width + 1)
    at = np.zeros(m, dtype=np.int64)
    key = np.full(m, rep * 1_000_003 + width, dtype=np.uint64)
    for j in range(max(picked) + 1):
        sym = flat[base + at]
        if j in picked:
            key = (key ^ sym) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        at = np.minimum(at + ((sym + np.uint64(1)) * mult[j] >> np.uint64(63)).astype(np.int64), width)
    return key


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers in order (np.unique hashes them, which takes several times as long)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Index:
    """Windows of a block of item sentences under the keys of every repetition."""

    def __init__(self, sentences: list[tuple[int, bool, list[str]]]):
        self.vocab: dict[str, int] = {}
        self.sentences = sentences
        self.skeletons: dict[str, str] = {}
        self.letters: dict[int, Counter] = {}
        ids = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, _, ws in sentences]
        df = np.bincount([w for x in ids for w in set(x)], minlength=len(self.vocab))
        self.words = list(self.vocab)
        self.spelt: dict[str, list[int]] = {}  # letters, all or one of them left out, to words
        for w, k in self.vocab.items():
            if len(w) > 3 and not w[0].isdigit():
                for d in (w, *_left_out(w)):
                    self.spelt.setdefault(d, []).append(k)
        # words of at most two sentences, or one sentence in a thousand
        self.rare = np.append(df <= max(2, len(ids) // 1000), False)
        self.rare_words = {w for w, k in self.vocab.items() if self.rare[k]}
        self.ids = ids
        # how many peculiar words must be there: what the poorest window keeps under a single change
        self.needs = []
        for x in ids:
            seen = np.concatenate([[0], np.cumsum(self.rare[x])])
            width = min(WINDOW, len(x))
            least = int((seen[width:] - seen[: len(x) - width + 1]).min())
            self.needs.append(({w for w in x if self.rare[w]}, 2 if least > 2 else min(least, 1)))
        self.sizes = {}
        for width in sorted({min(WINDOW, len(x)) for x in ids}):
            rows = [(k, o) for k, x in enumerate(ids) if min(WINDOW, len(x)) == width for o in range(len(x) - width + 1)]
            win = np.array([ids[k][o : o + width] for k, o in rows], dtype=np.uint64)
            where = np.array(rows, dtype=np.int64)
            reps = []
            for r in range(len(SAMPLES)):
                keys = _walk(win, r)
                order = np.argsort(keys, kind="stable")
                reps.append((keys[order], order))
            self.sizes[width] = (win, where, reps)

    def _could_hold(self, s: int, region: set[int], around: list[str]) -> bool:
        """A bound on held(): few words are missing, or all are there with slips, or the letters are, or a long stretch is.

        One demand is no bound: unless the letters are there, ``needs`` asks for
        words peculiar to the item as written, so slips in all of those are refused.
        """
        if not isinstance(around, _Around):
            around = _Around(around)
        peculiar, least = self.needs[s]
        if len(peculiar & region) >= least and self._words_could_hold(s, region, around):
            return True
        letters = self.letters.get(s)
        if letters is None:
            letters = self.letters[s] = _letters(self.sentences[s][2])
        return _same_letters(letters, around.letters)

    def _words_could_hold(self, s: int, region: set[int], around: _Around) -> bool:
        _, whole_only, words = self.sentences[s]
        absent = [i for i, w in enumerate(self.ids[s]) if w not in region]
        if len(absent) <= 1:
            return True
        if whole_only and len(absent) > 9:
            return False
        gaps = [i for i in absent if not around.any_close(words[i])]
        if not gaps and len(absent) <= 9 or len(gaps) == 1 and len(absent) <= 5:  # a word costs 1, a slip 0.2
            return True
        if whole_only:
            return False
        ends = [-1, *gaps, len(words)]
        if any(e - b > WINDOW for b, e in pairwise(ends)):
            return True
        # a stretch with a changed word needs two peculiar words
        for b, gap, e in zip(ends, ends[1:], ends[2:], strict=False):
            if e - b > WINDOW and sum(i != gap and words[i] in self.rare_words for i in range(b + 1, e)) >= 2:
                return True
        return False

    def search(self, texts: list[str], memo: dict) -> Iterator[tuple[int, int]]:
        """(number of the text, item) of every leak."""
        docs = [tokens(t) if t else [] for t in texts]
        pad = [-1] * WINDOW
        flat: list[int] = []
        starts = []
        get = memo.__getitem__
        for ws in docs:
            starts.append(len(flat))
            flat.extend(map(get, ws))
            flat.extend(pad)
        written, as_written = flat, np.array(flat, dtype=np.int64)
        ids = np.where(as_written >= NEAR, as_written - NEAR, as_written)
        flat = ids.tolist()
        first = np.array(starts, dtype=np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        found: set[tuple[int, int]] = set()

        def skeletons(w: str) -> str:
            v = self.skeletons.get(w)
            if v is None:
                if len(self.skeletons) > 500_000:
                    self.skeletons.clear()
                v = self.skeletons[w] = skeleton(w)
            return v

        # a candidate is a number made of the text, the place of the item's first word in it (lead and more before its own) and the sentence
        n_sent, lead = len(self.sentences), max(map(len, self.ids), default=0)
        reach = lead + len(ids)
        for width, (win, where, reps) in self.sizes.items():
            lost = LOST if width > 8 else 1
            pos = np.nonzero(known[width:] - known[: len(known) - width] >= width - lost)[0]
            tried = np.zeros(0, dtype=np.int64)
            for r, (keys, order) in enumerate(reps):
                if not len(pos):
                    break
                x = np.stack([ids[pos + i] for i in range(width)], axis=1)
                doc_keys = _walk(np.where(x < 0, 2**30, x).astype(np.uint64), r)
                lo, hi = np.searchsorted(keys, doc_keys, "left"), np.searchsorted(keys, doc_keys, "right")
                some = np.nonzero(hi > lo)[0]
                if not len(some):
                    continue
                made = []
                for part in np.array_split(some, max(1, int((hi - lo)[some].sum() // 500_000))):
                    n = (hi - lo)[part]
                    row = np.repeat(part, n)
                    hit = order[np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    a, b = x[row], win[hit].astype(np.int64)
                    same = a == b
                    same[:, 1:] |= a[:, 1:] == b[:, :-1]
                    same[:, :-1] |= a[:, :-1] == b[:, 1:]
                    near = same.sum(axis=1) >= width - 2 - 2 * (width > 8)
                    peculiar = self.rare[b]
                    # a window with several peculiar words keeps one of them under a single change
                    near &= (peculiar.sum(axis=1) < 2) | (peculiar & same).any(axis=1)
                    row, hit = row[near], hit[near]
                    doc = np.searchsorted(first, pos[row], "right") - 1
                    made.append(_distinct((doc * reach + pos[row] - first[doc] - where[hit, 1] + lead) * n_sent + where[hit, 0]))
                new = _distinct(np.concatenate(made))
                new = new[~np.isin(new, tried, assume_unique=True)]
                tried = np.concatenate([tried, new])
                settled = []
                before, regions = None, {}
                place = new // n_sent
                for d, at, s in zip((place // reach).tolist(), (place % reach - lead).tolist(), (new % n_sent).tolist(), strict=True):
                    item, whole_only, ws = self.sentences[s]
                    n_words, g = len(ws), starts[d] + at
                    if at < 0 or written[g : g + n_words] != self.ids[s]:
                        if (d, item) in found:
                            continue
                        if before != (d, at):
                            before, regions = (d, at), {}
                        if n_words not in regions:
                            region = set(flat[max(starts[d], g - 4) : max(0, g + n_words + 4)])
                            lo_, hi_ = max(0, at - 4), max(0, at + n_words + 4)
                            read = written[starts[d] + lo_ : starts[d] + min(hi_, len(docs[d]))]
                            regions[n_words] = region, _Around(self.words[i] if 0 <= i < NEAR else skeletons(w) for i, w in zip(read, docs[d][lo_:hi_], strict=True))
                        region, around = regions[n_words]
                        if not self._could_hold(s, region, around) or not held(ws, around, whole_only, self.rare_words):
                            continue
                    found.add((d, item))
                    settled.append((g, g + n_words))
                if settled and r + 1 < len(reps):  # what lies within a found passage needs no further walk
                    inside = np.zeros(len(ids) + 1, dtype=np.int32)
                    for a_, b_ in settled:
                        inside[max(0, a_)] += 1
                        inside[min(b_, len(ids))] -= 1
                    inside = np.cumsum(inside)
                    pos = pos[(inside[pos] == 0) | (inside[pos + width - 1] == 0)]
        yield from found


class _Memo(dict):
    """The number of each token's word; of a word a slip away, with ``NEAR`` added; else -1."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        w = skeleton(token)
        v = self[token] = self.index.vocab[w] if w in self.index.vocab else self._near(w)
        return v

    def _near(self, w: str) -> int:
        if len(w) < 4 or w[0].isdigit():
            return -1
        get, words = self.index.spelt.get, self.index.words
        if ks := get(w):  # a letter is missing
            return ks[0] + NEAR
        for i in range(len(w)):  # a letter too many or changed, or two of them in turn
            if ks := get(w[:i] + w[i + 1 :]):
                for k in ks:
                    if _close(w, words[k]):
                        return k + NEAR
        return -1


def item_sentences(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(item, whole_only, words, n) of each passage sentence that stands in one item only, and of each question."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, passage, question in zip(pdf["item"], pdf["passage"], pdf["question"], strict=True):
                for s, e in split(passage):
                    ws = list(map(skeleton, tokens(passage[s:e])))
                    # parts of sentences count in scripts with spaces only
                    unspaced = sum(len(w) == 1 and w >= "\u3040" for w in ws) * 3 > len(ws)
                    out.append((k, unspaced, " ".join(ws)))
                if question:
                    out.append((k, True, " ".join(map(skeleton, tokens(question)))))
            yield pd.DataFrame(out, columns=["item", "whole_only", "words"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("item"), "passage", "question").where("item is not null").mapInPandas(cut, f"item {kind}, whole_only boolean, words string")
    rows = rows.withColumn("n", F.size(F.split("words", " "))).where(F.col("n") >= SHORTEST)
    return rows.groupBy("words", "n").agg(F.min("item").alias("item"), F.max("item").alias("other"), F.min("whole_only").alias("whole_only")).where("item = other").select("item", "whole_only", "words", "n")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (key, item_id) per document and item whose material it holds."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    sentences = item_sentences(items)
    size = sentences.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = int(size // block_chars) + 1
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") >= SHORTEST)
    schema = T.StructType([T.StructField("k", kind), T.StructField("item_id", sentences.schema["item"].dataType)])
    result = None
    for b in range(blocks):
        block = sentences if blocks == 1 else sentences.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        known = spark.sparkContext.broadcast([(r.item, r.whole_only, r.words.split(" ")) for r in block.toLocalIterator()])

        def search(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            index = Index(known.value) if known.value else None
            memo = _Memo(index) if index else None
            for pdf in batches:
                out = []
                if index:
                    ks, ts = pdf["k"].tolist(), pdf["t"].tolist()
                    for lo in range(0, len(ts), 2_000):
                        out += [(ks[lo + d], i) for d, i in index.search(ts[lo : lo + 2_000], memo)]
                made = pd.DataFrame(out, columns=["k", "item_id"])
                yield made.astype({"k": pdf["k"].dtype}) if len(made) else made

        part = rows.mapInPandas(search, schema)
        result = part if result is None else result.unionByName(part)
    return result.withColumnRenamed("k", key)
