"""Broken prompt and response pairs.

Labelling functions vote on every pair, several for each defect.  They are
noisy: one alone proves little.  A label model per defect, fitted by
expectation-maximisation on the histogram of vote patterns, turns the votes
into a posterior, and a pair keeps every defect whose posterior exceeds that
defect's cutoff.  The histogram has at most 2 ** (votes) rows, whatever the
number of pairs; nothing else leaves the executors.

Two small models serve as labelling functions.  The language of a text comes
from word counts over all samples with a known language, of which the
``LANGUAGE_WORDS`` most frequent are kept.  Whether a text breaks off comes from
all answers, in which the sentence ends are the labels: runs of up to six words
are counted over every piece of every answer, and the counts stay on the
executors, where the runs that open answers end with are joined to them.  How
often a text recurs and in how many texts its last word stands is counted over
all answers, too.

Defined results: null answers are empty answers; a null question proves nothing
about language or copying; copies of a key give one row; pairs without a sample
are left out by the inner join.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

LANGUAGE_WORDS = 200_000  # words of the language model
PIECE = 400  # code points of a piece
HELD = 300_000  # counts that a worker holds before it passes them on
SALTS = 8  # of the join that brings votes on texts to their pairs
DEFECTS = ("empty_answer", "copies_question", "refusal", "truncated_answer", "other_language")
#: Posterior above which a defect is kept; see tests/llm/test_pairs.py for their validation.
CUTOFFS = {"empty_answer": 0.5, "copies_question": 0.5, "refusal": 0.6, "truncated_answer": 0.6, "other_language": 0.6}

# --- fixed values: wordings by language ---------------------------------------
PLACEHOLDER = r"(null|none|nil|nan|n/?a|tbd|todo|undefined|empty|missing|no answer|no response|no content|answer|response|output|a|antwort|réponse|respuesta|ответ|答え|回答|答案|答)\s*[:：.]*"
UNABLE = (
    r"(?i)\b(can['’]?t|cannot|can not|could not|unable|not able|not possible for me|will not|won['’]t|would rather not|must decline|not something i can|not permitted|request declined)\b"
    r"|\b(nicht|keine|nichts)\b.{0,40}\b(helfen|beantworten|bearbeiten|geben|sagen|äußern)\b|\b(kann|darf|möchte|werde) ich\b.{0,40}\b(nicht|keine?|nichts)\b"
    r"|\bne (peux|puis|suis|pourrai|souhaite)\b|\bpas en mesure\b|\bne pas me prononcer\b|n['’]est pas possible"
    r"|\bno (puedo|podré|me es posible|se me permite|estoy|voy a|me siento)\b|\bprefiero no\b"
    r"|не (могу|буду|смогу|получится|вправе|стану|готов)|отказ|невозможно"
    r"|でき(ません|かね|ない)|いたしかね|しかねます|差し控え|控えさせ|お断り"
    r"|无法|不能|不便|不会|拒绝|不方便|没办法"
)
REGRET = (
    r"(?i)\b(sorry|apolog\w+|regret\w*|unfortunately|afraid|thanks for asking)\b|\b(leider|tut mir leid|bedaure|entschuldig\w+|verzeih\w*)\b"
    r"|désolée?|malheureusement|navrée?|regrette|excusez|\blo siento\b|lamentablemente|disculp\w+|perdón|lamento|desgraciadamente"
    r"|к сожалению|извин|прост(ите|и)|сожале|申し訳|恐れ入り|すみません|残念ながら|あいにく|ごめん|抱歉|对不起|很遗憾|不好意思|遗憾"
)
POLICY = (
    r"(?i)\b(my (guidelines?|polic(y|ies))|not permitted|not allowed|i (must |have to )?(decline|refuse)|request declined|comfortable|language model|an ai|assist with|"
    r"help with|respond to|comment on|discuss (it|this|that|such|requests)|say anything about|an opinion|provide an answer|answer(ing)? (this|that|here))\b"
    r"|richtlinien|(anfrage|frage|auskunft|thema).{0,30}(nicht|keine)|sprachmodell|dabei .{0,12}nicht helfen|dazu (nichts|keine)|hier keine"
    r"|mon cadre|répondre|traiter cette|commenter|m['’]aider|vous aider|modèle de langage|consignes"
    r"|(responder|contestar|opinar|ayudar|atender|comentar|hablar)\b|modelo de lenguaje|normas|directrices"
    r"|ответить|помочь|обсужд|комментир|правил|языковая модель|не вправе|お答え|お手伝い|回答|コメント|ご質問|ご要望|言語モデル"
    r"|回答|协助|帮助|帮忙|评论|讨论|请求|语言模型|规定|准则"
)
FUNCTION_WORDS = frozenset(
    "the a an of and or in to for by with from which that its as at on near than some into but because although it was is were "
    "der die das den dem des ein eine einen und oder in zu für von mit auf bei als an im am denn wobei zur zum "
    "le la les un une des du de et ou à en pour par avec dans sur que qui car même si au aux "
    "el los las una unos y o de en para por con a que se lo aunque porque del al "
    "и в на с к по за из от до у о об что как потому причина".split()
)
TRANSLATE = r"(?i)\b(?:translate|übersetze|traduis|traduce|переведи)\b[^:.]{0,30}\b(german|spanish|french|english|russian|japanese|chinese)\b"
NAMED = {"german": "de", "spanish": "es", "french": "fr", "english": "en", "russian": "ru", "japanese": "ja", "chinese": "zh"}
INVISIBLE = "[​‌‍⁠﻿­]"
# -------------------------------------------------------------------------------

#: for regular expressions of the JVM
LETTERS = r"[\u3040-\u30ff\u3400-\u9fff]|[\p{L}&&[^\u3040-\u30ff\u3400-\u9fff]]+"
WORD = r"[\u3040-\u30ff\u3400-\u9fff]|[\p{L}&&[^\u3040-\u30ff\u3400-\u9fff]]+(?:['’]\p{L}+)*"
_CLOSED_JVM = r"(?:(?<!\.)\.|[!?。！？．])[\s\"'”’»」』)\]}*`]*$"
UNIT = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*|[.!?。！？…]+|\n|[,;:，、；：()«»“”\"「」]")
ENDS = re.compile(r"[.!?。！？…]")
_TAIL = re.compile(r"(?:[\s\"'”’»」`*-]|…|\.{2,})+$")  # an ellipsis may stand for what broke off
_HAN = re.compile("[㐀-鿿]")
CLOSED = re.compile(r"(?:(?<!\.)\.|[!?。！？．])[\s\"'”’»」』)\]}*`]*$")


# --------------------------------------------------------------------------- language
def _words(text: str) -> list[str]:
    return re.findall(r"[぀-ヿ㐀-鿿]|[^\W\d_]+", text)


def _script(text: str) -> str | None:
    if re.search("[぀-ヿ]", text):
        return "ja"
    n = Counter(
        "han" if "㐀" <= c <= "鿿" else "ru" if "Ѐ" <= c <= "ӿ" else "el" if "Ͱ" <= c <= "Ͽ" else "ar" if "؀" <= c <= "ۿ" else "hi" if "ऀ" <= c <= "ॿ" else "th" if "฀" <= c <= "๿" else "latin"
        for c in text
        if c.isalpha()
    )
    if not n:
        return None
    if n["han"] >= 2:
        return "han"
    best = max((k for k in n if k != "latin"), key=n.__getitem__, default="latin")
    return best if best != "han" and n[best] * 2 >= n["latin"] * 0.5 else "latin"


def _threes(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Language:
    """Naive Bayes over the words of labelled texts, given as (language, word, occurrences)."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.words: dict[str, Counter] = {}
        for lang, word, n in rows:
            self.words.setdefault(lang, Counter())[word] += n
        self.total = {k: sum(c.values()) + 1.0 for k, c in self.words.items()}
        # a word seen once or twice says nothing: names
        seen = sum(self.words.values(), Counter())
        self.known = {w for w, n in seen.items() if n >= 3}
        self.latin = [k for k in self.words if k not in ("ja", "zh", "ru", "el", "ar", "hi", "th")]
        # for words never seen: three letters in a row, over the known words
        self.letters = {k: Counter(t for w in c if w in self.known for t in _threes(w)) for k, c in self.words.items()}
        self.threes = {k: c.total() + 200.0 for k, c in self.letters.items()}
        self.cache: dict[str, tuple[str | None, float]] = {}

    def of(self, text: str) -> tuple[str | None, float]:
        """Language and log-odds over the next one; None where nothing is known, ``han`` for a few characters of either language."""
        got = self.cache.get(text)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[text] = self._of(text)
        return got

    def _of(self, text: str) -> tuple[str | None, float]:
        s = _script(text)
        if s is None:
            return None, 0.0
        if s == "han":  # without kana; some words of a few characters are spelt alike in Chinese and Japanese
            return ("zh" if len(_HAN.findall(text)) >= 10 else "han"), 9.0
        if s != "latin":
            return s, 9.0
        words = _words(text)
        ws = [w for w in map(str.lower, words) if w in self.known]
        new = [t for w in words if w[0].islower() and len(w) > 3 and w not in self.known for t in _threes(w)]
        if not (ws or new) or not self.latin:
            return None, 0.0

        def fit(k: str) -> float:
            by_word = sum(math.log((self.words[k][w] + 0.05) / self.total[k]) for w in ws)
            return by_word + 0.5 * sum(math.log((self.letters[k][t] + 0.1) / self.threes[k]) for t in new)

        score = sorted(((fit(k), k) for k in self.latin), reverse=True)
        return score[0][1], score[0][0] - score[1][0] if len(score) > 1 else 9.0


def _differ(a: str, b: str) -> bool:
    return a != b and not ("han" in (a, b) and {a, b} <= {"han", "zh", "ja"})


# --------------------------------------------------------------------------- broken endings
class Ending:
    """How often a run of last words ends a sentence.

    ``known`` are the words that stand in more than four pieces and capitalised
    somewhere; all other capitalised words are taken for names.  The counts are
    those of ``run_counts``.
    """

    LONGEST = 6

    def __init__(self, known: frozenset[str]):
        self.known = known

    def units(self, text: str) -> list[str]:
        out = ["<s>"]
        for w in UNIT.findall(text):
            if w == "\n":
                out.append("<s>")
            elif w[0].isdigit():
                out.append("0")
            elif ENDS.match(w):
                out.append(".")
            else:
                low = w.lower()
                out.append(low if not w[0].isupper() or low in self.known else "X")
        return out

    def counted(self, text: str, first: bool, whole: bool, n: int, ends: Counter, goes: Counter) -> None:
        """Adds the runs of a piece to those that end a sentence and those that go on."""
        units = self.units(text) if first else self.units(text)[2:]
        last = len(units) - 1
        for i, u in enumerate(units):
            if u in (".", "<s>"):
                continue
            by = 1
            if i < last:
                into = ends if units[i + 1] in (".", "<s>") else goes
            elif whole and n >= 3 and last <= 7:
                into, by = ends, n  # a short answer that recurs is whole
            else:
                continue
            into[u] += by
            for w in reversed(units[max(0, i - self.LONGEST + 1) : i]):
                u = f"{w} {u}"
                into[u] += by

    def last_units(self, text: str, n: int) -> list[str]:
        """The units of a text that may break off; none where it is known to be whole."""
        if CLOSED.search(text):
            return []
        units = self.units(_TAIL.sub("", text))
        while units and units[-1] == "<s>":
            units.pop()
        return [] if n >= 3 and len(units) <= 8 else units  # a short answer that recurs is whole

    def asked(self, text: str, n: int) -> list[str]:
        """The runs whose counts ``votes`` needs; one with ``*`` stands for all that go on within its last word."""
        units = self.last_units(text, n)
        runs = [" ".join(units[-k:]) for k in range(1, min(self.LONGEST, len(units)) + 1)]
        return [*runs, " ".join(units[-3:-1]), f"{runs[2]}*"] if len(units) > 2 else runs

    def votes(self, text: str, n: int, word: str | None, texts: int, counts: dict[str, tuple[int, int]]) -> int:
        """Bit 1: the last words never end a sentence; bit 2: the last word is a fragment; bit 4: it asks for more.

        ``n`` is how often the text occurs, ``texts`` in how many texts its last word ``word`` stands;
        ``counts`` has the runs of ``asked`` that end a sentence and that go on.
        """
        units = self.last_units(text, n)
        if not units:
            return 0
        none = (0, 0)
        out, last = 0, units[-1]
        if last in ",;:，、；：(" or last in FUNCTION_WORDS and len(units) > 3:
            out |= 4
        if len(last) > 0 and last[0].isalpha() and last != "X" and last == word and texts < 2:
            out |= 2
        if len(units) > 2 and last[0].isalpha() and last < "\u3040" and last != "X":
            run = " ".join(units[-3:])
            longer = sum(counts.get(f"{run}*", none))
            if longer >= 8 and sum(counts.get(run, none)) * 10 < longer:
                out |= 2  # the beginning of what follows here
        if len(units) > 4 and last[0].isalpha() and last < "\u3040" and last != "X":
            before = " ".join(units[-3:-1])
            if sum(counts.get(before, none)) >= 20 and f"{before} {last}" not in counts:
                out |= 2  # never goes on like this
        for k in range(min(self.LONGEST, len(units)), 0, -1):
            if k < len(units) <= self.LONGEST and not out:
                break  # a short answer never seen is judged as a whole only
            g = " ".join(units[-k:])
            e, m = counts.get(g, none)
            if e + m >= 3:
                if e < 0.04 * (e + m):
                    out |= 1
                break
        else:
            out |= 1 if out else 0
        return out


# --------------------------------------------------------------------------- votes
VOTES = {
    "empty_answer": ("blank", "no_letters", "placeholder"),
    "copies_question": ("equal", "again", "nearly"),
    "refusal": ("unable", "regret", "policy"),
    "truncated_answer": ("open_wrapping", "no_end", "fragment", "dangling"),
    "other_language": ("script", "words", "strong_words"),
}
_UNSEEN = re.compile(INVISIBLE)
_MARKS = re.compile(r"[`{}\[\]<>*_:]")
_FENCE = re.compile(r"(?s)^```\w*\s*|\s*```$")
_FIELD = re.compile(r'(?s)^\{\s*"\w+"\s*:\s*"?')
_ELEMENT = re.compile(r"</?[A-Za-z][^<>]{0,60}>")
_LABEL = re.compile(r"^\s*(?:[QA]|Question|Answer)\s*:\s+|\*\*|__")
_NOT_LETTERS = re.compile(r"[\W_]+")
_PLACEHOLDER = re.compile(rf"^\W*{PLACEHOLDER}\W*$", re.I)
_REFUSAL = [re.compile(x) for x in (UNABLE, REGRET, POLICY)]
_ASKING = re.compile(r"^\s*(?:[^\W\d_][^\W\d_ ,]*(?:[ ,][^\W\d_ ,]*){0,8} ?[.:])\s+(?=\S.{15,})")
_TRANSLATE = re.compile(TRANSLATE)


def answer_of(content: str | None) -> tuple[str, bool]:
    """The answer text within its wrapping, and whether the wrapping is left open."""
    c = _UNSEEN.sub("", content or "").strip()
    if not _MARKS.search(c):
        return c, False
    opened = c.startswith("{") and not c.endswith("}") or c.startswith("[") and not c.endswith("]") or c.startswith("```") and not (len(c) > 5 and c.endswith("```"))
    x = _FENCE.sub("", c)
    if _FIELD.match(x):
        x = re.sub(r'(?s)"?\s*\}?$', "", _FIELD.sub("", x))
    return _LABEL.sub("", _ELEMENT.sub(" ", x)).strip(), opened


def letters(text: str) -> str:
    return _NOT_LETTERS.sub("", text.lower())


def _bigrams(text: str) -> Counter:
    return Counter(map("".join, zip(text, text[1:], strict=False)))


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 beyond it."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def copies(la: str, q: str) -> tuple[bool, bool, bool]:
    """Votes for an answer (its letters) that gives back a question (its letters)."""
    n, m = len(la), len(q)
    if n < 8 or not m:
        return False, False, False
    begins = m > 7 and la.startswith(q)
    rest = la[m:] if begins else ""
    equal = la == q
    again = bool(rest) and len(rest) * 2 > m and (q.startswith(rest) or rest.startswith(q))
    cut = q.startswith(la) and n * 10 >= m * 6
    like = False
    if not begins and not cut and abs(n - m) * 5 <= m and n * 10 <= m * 11:
        most = m // 5
        # every edit costs two pairs of neighbours at most
        like = (_bigrams(la) & _bigrams(q)).total() >= m - 1 - 2 * most and _distance(la, q, most) <= most
    return equal, again, equal or again or cut or like


class Voter:
    """All labelling functions but those of endings; what depends on the answer or the question alone is kept per text."""

    def __init__(self, language: Language):
        self.language = language
        self.answers: dict = {}
        self.questions: dict = {}

    def answer(self, content: str | None) -> tuple[str, str, int]:
        got = self.answers.get(content)
        if got is None:
            if len(self.answers) > 200_000:
                self.answers.clear()
            a, opened = answer_of(content)
            la = letters(a)
            flags = [not a, not letters(_PLACEHOLDER.sub("", a)), not la or bool(_PLACEHOLDER.match(a)), False, False, False]
            flags += [bool(x.search(a)) for x in _REFUSAL] if la else [False] * 3
            flags += [opened and bool(la)]
            got = self.answers[content] = (a, la, sum(1 << i for i, f in enumerate(flags) if f))
        return got

    def question(self, text: str | None) -> tuple[str, str, str | None, str | None, bool]:
        """Letters with and without the prompt's opening words, expected language, script, translation."""
        got = self.questions.get(text)
        if got is None:
            if len(self.questions) > 200_000:
                self.questions.clear()
            text_ = text or ""
            target = _TRANSLATE.search(text_)
            want, sure = (NAMED.get(target.group(1).lower()), 9.0) if target else self.language.of(text_)
            got = self.questions[text] = (letters(text_), letters(_ASKING.sub("", text_)), want if sure > 2 else None, _script(text_), bool(target))
        return got

    def __call__(self, question: str | None, content: str | None, end: int = 0) -> int:
        """One bit for each vote; ``end`` are those of ``Ending``."""
        a, la, v = self.answer(content)
        if not la:
            return v
        v |= end << 10
        lq, ls, want, script, target = self.question(question)
        one = copies(la, lq)
        if ls != lq:
            one = tuple(map(max, one, copies(la, ls)))
        for i, f in enumerate(one):
            v |= f << 3 + i
        if want:
            got, odds = self.language.of(a)
            if got and _differ(got, want):
                s = _script(a)
                v |= ((s != script and not target or target and s not in ("latin", None)) << 13) | ((odds > 1.5) << 14) | ((odds > 4) << 15)
        return v


def distinct_answers(contents: DataFrame) -> DataFrame:
    """(content, n) of every answer but null."""
    return contents.where("content is not null").groupBy("content").agg(F.count("*").alias("n"))


def pieces(content: str, n: int) -> Iterator[tuple[str, bool, bool, int]]:
    """(piece, it begins its text, it ends its text, occurrences of the text)."""
    a = answer_of(content)[0]
    for i in range(0, len(a), PIECE):
        t, last = a[i : i + PIECE], i + PIECE >= len(a)
        yield _TAIL.sub("", t) if last and not CLOSED.search(t) else t, i == 0, last, n


def known_words(texts: DataFrame) -> DataFrame:
    """(word) that stands in more than four pieces of ``texts`` (content, n), and capitalised somewhere."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, upper = Counter(), set()

        def out() -> pd.DataFrame:
            words = [*seen, *(w for w in upper if w not in seen)]
            made = pd.DataFrame({"word": np.array(words, dtype=object), "n": [seen[w] for w in words], "upper": [w in upper for w in words]})
            seen.clear()
            upper.clear()
            return made

        for pdf in batches:
            for c, k in zip(pdf["content"].tolist(), pdf["n"].tolist(), strict=True):
                cut = list(pieces(c, k))
                for text, first, last, n in cut:
                    ws = UNIT.findall(text)
                    upper.update(w.lower() for w in ws if w[0].isupper())
                    if not last or n < 3 and not CLOSED.search(text):
                        ws = ws[:-1]  # may be a fragment
                    seen.update({w.lower() for w in ws[not first :]})
                if len(cut) > 1:  # words that stand on both sides of a cut
                    upper.update(w.lower() for w in UNIT.findall(answer_of(c)[0]) if w[0].isupper())
            if len(seen) + len(upper) > HELD:
                yield out()
        yield out()

    words = texts.mapInPandas(count, "word string, n long, upper boolean").groupBy("word").agg(F.sum("n").alias("n"), F.max("upper").alias("upper"))
    return words.where("upper and n > 4").select("word")


def fit_ending(texts: DataFrame) -> Ending:
    """From all of ``texts`` (content, n); only the words that are no names come to the driver."""
    return Ending(frozenset(known_words(texts).toArrow()["word"].to_pylist()))


def run_counts(texts: DataFrame, ending: Ending) -> DataFrame:
    """(run, ends, goes): how often every run of up to six units ends a sentence and how often it goes on, in all of ``texts``.

    Runs met once are left out.  A run of three with ``*`` has how often its last word goes on within the word.
    """
    model = texts.sparkSession.sparkContext.broadcast(ending)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, goes = Counter(), Counter()

        def out() -> pd.DataFrame:
            runs = [*ends, *(r for r in goes if r not in ends)]
            made = pd.DataFrame({"run": np.array(runs, dtype=object), "ends": [ends[r] for r in runs], "goes": [goes[r] for r in runs]})
            ends.clear()
            goes.clear()
            return made

        for pdf in batches:
            for c, k in zip(pdf["content"].tolist(), pdf["n"].tolist(), strict=True):
                for piece in pieces(c, k):
                    model.value.counted(*piece, ends, goes)
                if len(ends) + len(goes) > HELD:
                    yield out()
        yield out()

    runs = texts.mapInPandas(count, "run string, ends long, goes long").groupBy("run").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    runs = checkpointed(runs.where("ends + goes > 1"))
    word = F.element_at("units", 3)
    threes = runs.withColumn("units", F.split("run", " ")).where(F.size("units") == 3).where((word != "X") & (F.length(word) > 1))
    begun = threes.select(F.concat_ws(" ", F.slice("units", 1, 2)).alias("before"), F.explode(F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda k: F.substring(F.element_at("units", F.lit(3)), F.lit(1), k))).alias("begin"), (F.col("ends") + F.col("goes")).alias("goes"))
    within = begun.groupBy(F.concat("before", F.lit(" "), "begin", F.lit("*")).alias("run")).agg(F.lit(0).cast("long").alias("ends"), F.sum("goes").alias("goes"))
    return runs.unionByName(within)


def ending_votes(texts: DataFrame, ending: Ending) -> DataFrame:
    """(content, end): the votes of ``Ending`` for the texts that have any, with the counts of all texts."""
    words = F.regexp_extract_all(F.lower("content"), F.lit(WORD), F.lit(0))
    read = texts.select("content", "n", words.alias("ws"), F.col("content").rlike(_CLOSED_JVM).alias("closed"))
    # the last word of a text that breaks off may be a fragment; texts that recur are taken to be whole
    whole = F.when(F.col("closed") | (F.col("n") >= 3), F.col("ws")).otherwise(F.expr("slice(ws, 1, greatest(size(ws) - 1, 0))"))
    texts_of = read.select(F.explode(F.array_distinct(whole)).alias("word"), F.when(F.col("n") >= 3, 2).otherwise(1).alias("n")).groupBy("word").agg(F.sum("n").alias("texts"))
    open_ = read.where("not closed").select("content", "n", F.expr("get(ws, size(ws) - 1)").alias("word")).join(texts_of, "word", "left")
    model = texts.sparkSession.sparkContext.broadcast(ending)

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs = [model.value.asked(answer_of(c)[0], n) for c, n in zip(pdf["content"].tolist(), pdf["n"].tolist(), strict=True)]
            yield pdf.assign(runs=pd.Series(runs, index=pdf.index, dtype=object))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf["texts"].fillna(0).tolist()
            counts = [{r["run"]: (r["ends"], r["goes"]) for r in found} if found is not None else {} for found in pdf["found"].tolist()]
            end = [model.value.votes(answer_of(c)[0], n, w, k, x) for c, n, w, k, x in zip(pdf["content"].tolist(), pdf["n"].tolist(), pdf["word"].tolist(), known, counts, strict=True)]
            out = pdf[["content"]].assign(end=np.array(end, dtype="int32"))
            yield out[out["end"] > 0]

    asked = checkpointed(open_.mapInPandas(asking, "content string, n long, word string, texts long, runs array<string>").withColumn("id", F.monotonically_increasing_id()))
    looked = asked.select("id", F.explode("runs").alias("run")).join(run_counts(texts, ending), "run").groupBy("id").agg(F.collect_list(F.struct("run", "ends", "goes")).alias("found"))
    return asked.drop("runs").join(looked, "id", "left").drop("id").mapInPandas(judged, "content string, end int")


def votes(pairs: DataFrame, language: Language, ends: DataFrame) -> DataFrame:
    """(origin, pair_key, v): v has one bit per labelling function, in the order of ``VOTES``."""
    voter = pairs.sparkSession.sparkContext.broadcast(Voter(language))

    @F.pandas_udf("int")
    def vote(question: pd.Series, content: pd.Series, end: pd.Series) -> pd.Series:
        f = voter.value
        return pd.Series(list(map(f, question.tolist(), content.tolist(), end.tolist())), dtype="int32")

    # an answer may be that of a third of all pairs: its rows are spread over the salts
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("origin", "pair_key"), F.lit(SALTS)).cast("int"))
    spread = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(spread, ["content", "salt"], "left").fillna(0, ["end"])
    return joined.select("origin", "pair_key", vote("question", "content", "end").alias("v"))


# --------------------------------------------------------------------------- label model
def label_model(patterns: dict[int, int], rounds: int = 50) -> dict[int, dict[str, float]]:
    """Posterior of every defect for every vote pattern, by expectation-maximisation.

    Votes are taken as independent given the defect.  The start is one vote in
    two for a defect and one in a hundred otherwise; pseudo-counts keep the
    estimates of rare defects near it, and a vote never counts against the
    defect it is for.
    """
    out: dict[int, dict[str, float]] = {p: {} for p in patterns}
    if not patterns:
        return out
    at = 0
    for defect, names in VOTES.items():
        k = len(names)
        n: Counter = Counter()
        for p, c in patterns.items():
            n[p >> at & ((1 << k) - 1)] += c
        ps = sorted(n)
        bits = np.array([[p >> i & 1 for i in range(k)] for p in ps], dtype=float)
        w = np.array([n[p] for p in ps], dtype=float)
        prior, hit, noise = 0.02, np.full(k, 0.6), np.full(k, 0.01)
        a, b = 0.02 * w.sum() ** 0.5 + 2, 50.0
        for _ in range(rounds):
            lp = math.log(prior) + bits @ np.log(hit) + (1 - bits) @ np.log(1 - hit)
            ln = math.log(1 - prior) + bits @ np.log(noise) + (1 - bits) @ np.log(1 - noise)
            post = 1 / (1 + np.exp(np.clip(ln - lp, -700, 700)))
            y, z = w * post, w * (1 - post)
            prior = float(np.clip((y.sum() + 0.02 * b) / (w.sum() + b), 1e-4, 0.5))
            hit = np.clip((y @ bits + 0.6 * a) / (y.sum() + a), 0.2, 0.98)
            noise = np.clip((z @ bits + 0.01 * b) / (z.sum() + b), 5e-4, 0.2)
        lp = math.log(prior) + bits @ np.log(hit) + (1 - bits) @ np.log(1 - hit)
        ln = math.log(1 - prior) + bits @ np.log(noise) + (1 - bits) @ np.log(1 - noise)
        post = dict(zip(ps, 1 / (1 + np.exp(np.clip(ln - lp, -700, 700))), strict=True))
        for p in patterns:
            out[p][defect] = float(post[p >> at & ((1 << k) - 1)])
        at += k
    return out


def fit_language(samples: DataFrame, words: int = LANGUAGE_WORDS) -> Language:
    """From the words of all texts whose language is stated in ``metadata``; the most frequent are kept."""
    texts = samples.select(
        F.lower(F.substring(F.get_json_object("metadata", "$.lang"), 1, 2)).alias("lang"),
        F.concat_ws(" \n ", "question", "answer", F.array_join(F.transform("paragraphs", lambda p: p["paragraph_text"]), " \n ")).alias("text"),
    ).where("lang is not null")
    counted = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return Language([(r.lang, r.word, r.n) for r in counted.orderBy(F.desc("n"), "lang", "word").limit(words).collect()])


def defects(pairs: DataFrame, samples: DataFrame, contents: DataFrame | None = None, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(origin, pair_key, defect, posterior) for every defect whose posterior exceeds its cutoff.

    ``pairs`` has origin, pair_key, question and content; ``contents`` the answers to
    learn sentence ends from (those of the pairs, unless given).
    """
    spark = pairs.sparkSession
    cutoffs = CUTOFFS | (cutoffs or {})
    texts = checkpointed(distinct_answers(pairs if contents is None else contents))
    v = checkpointed(votes(pairs, fit_language(samples), ending_votes(texts, fit_ending(texts))))
    patterns = {r.v: r["count"] for r in v.groupBy("v").count().collect()}
    rows = [(p, d, x) for p, post in label_model(patterns).items() for d, x in post.items() if x > cutoffs[d]]
    kept = spark.createDataFrame(rows, "v int, defect string, posterior double")
    return v.join(F.broadcast(kept), "v").select("origin", "pair_key", "defect", "posterior").dropDuplicates(["origin", "pair_key", "defect"])


def one_defect(found: DataFrame) -> DataFrame:
    """The most probable defect of each pair; of equals, the first in ``DEFECTS``."""
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    best = F.min_by("defect", F.struct(F.round(-F.col("posterior"), 2), order))
    return found.groupBy("origin", "pair_key").agg(best.alias("defect"))
