"""Variant spellings of names typed by people.

Every string is rewritten to all of its canonical forms: titles, degrees,
articles and bracketed acronyms are dropped, abbreviated words of organisations
written out, nicknames replaced by each name they stand for, parts put in
order, middle names cut to initials, digits read as the letters they resemble.
Forms are exploded and equi-joined.  A form is scored by its rarity: the share
of its mentions in those of all its entities, so that one that leads to a
single entity decides and one that leads to several links nothing.  Slips of the pen are rewritings too: every
form also stands under all its spellings with one letter left out, so that two
forms one slip apart meet in an equi-join, and are then compared.

Strings are never compared all against all: a form is compared with those that
share one of its spellings, linked to the most mentioned of them that is a slip
away, and such links are followed to their end.

Defined results: null and blank names are left out; repeated mentions count
once as a string (and as weight); names of concepts and events (by the majority
of their mentions' types) have no variants.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# --- fixed values ---------------------------------------------------------------
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame rev hon herr frau mme mlle sr sra dott ing dipl".split())
SUFFIXES = frozenset("jr sr phd md ii iii iv esq msc bsc mba dphil dsc facs".split())
SMALL_WORDS = frozenset("the of for and de la le du der die das des et".split())
WRITTEN_OUT = {
    "univ": "university", "uni": "university", "inst": "institute", "res": "research", "cncl": "council", "mfg": "manufacturing",
    "co": "company", "comp": "company", "corp": "corporation", "bros": "brothers", "ltd": "limited", "inc": "incorporated",
    "fdn": "foundation", "found": "foundation", "transp": "transport", "hydrol": "hydrology", "pub": "public", "surv": "survey",
    "reg": "regional", "hosp": "hospital", "intl": "international", "int'l": "international", "labs": "laboratories", "lab": "laboratory",
    "dept": "department", "sci": "science", "assoc": "association", "soc": "society", "natl": "national", "nat'l": "national",
    "acad": "academy", "coll": "college", "ctr": "center", "cent": "center", "gov": "government", "govt": "government", "dev": "development",
    "tech": "technology", "med": "medical", "eng": "engineering", "env": "environment", "agric": "agriculture", "min": "ministry",
    "hlth": "health", "forest": "forestry", "geol": "geology", "ecol": "ecology", "epidemiol": "epidemiology", "oceanogr": "oceanography",
}
OF_ORGANISATIONS = frozenset(
    "university institute council company corporation brothers limited incorporated foundation survey hospital laboratories laboratory "
    "department association society academy college center centre ministry agency office bureau bank group trust union".split()
)
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "xander": "alexander", "lex": "alexander",
    "ole": "oleander", "olly": "oleander oliver", "ollie": "oleander oliver", "uli": "ulrich", "standa": "stanislav", "stan": "stanislav stanley",
    "stas": "stanislav", "pepe": "jose", "paco": "francisco", "pancho": "francisco", "cisco": "francisco", "fran": "francisco francis",
    "niko": "nikolaus", "klaus": "nikolaus", "nick": "nikolaus nicholas", "nico": "nikolaus nicolas", "claus": "nikolaus", "nikki": "nikolaus nicole",
    "hannes": "johannes", "hans": "johannes", "jo": "johannes joseph", "johan": "johannes", "jan": "johannes", "gabi": "gabriela", "gaby": "gabriela",
    "gabby": "gabriela", "doro": "dorothea", "dora": "dorothea theodora", "dot": "dorothea", "dolly": "dorothea", "dorle": "dorothea",
    "thea": "theodora dorothea", "teddy": "theodora theodore edward", "theo": "theodora theodore", "lotte": "charlotte", "lottie": "charlotte",
    "charlie": "charlotte charles", "lola": "charlotte", "carly": "charlotte", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth",
    "betty": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "bess": "elizabeth", "libby": "elizabeth", "liza": "elizabeth", "betsy": "elizabeth",
    "dick": "richard", "rick": "richard", "rich": "richard", "richie": "richard", "ricky": "richard",
    "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william", "wim": "william", "willie": "william",
    "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert albert", "robby": "robert",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "greta": "margaret", "madge": "margaret", "marge": "margaret", "margie": "margaret", "rita": "margaret",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kitty": "katherine", "kay": "katherine", "cathy": "katherine catherine",
    "ed": "edouard edward", "eddy": "edouard edward", "eddie": "edouard edward", "doudou": "edouard", "ned": "edouard edward", "ted": "edouard edward theodore",
    "vicky": "viktoria victoria", "vika": "viktoria", "viki": "viktoria", "vicki": "viktoria victoria", "vic": "viktoria victor", "tori": "viktoria victoria",
    "leo": "leopold leonard", "poldi": "leopold", "pold": "leopold", "lenny": "leonard", "zoe": "zoe", "zo": "zoe", "vera": "vera", "verka": "vera", "verunka": "vera",
    "irena": "irene", "rene": "irene", "renie": "irene", "aure": "aurelie", "lili": "aurelie", "relie": "aurelie", "joe": "joseph jose", "chepe": "jose", "yussuf": "yusuf", "joey": "joseph",
    "mike": "michael", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "tom": "thomas", "tommy": "thomas", "dan": "daniel", "danny": "daniel",
    "dave": "david", "steve": "steven stephen", "tony": "anthony", "chris": "christopher christine", "matt": "matthew", "andy": "andrew", "sam": "samuel samantha",
    "ben": "benjamin", "greg": "gregory", "jeff": "jeffrey", "ken": "kenneth", "ron": "ronald", "tim": "timothy", "sue": "susan", "pat": "patrick patricia",
    "chuck": "charles", "hank": "henry", "harry": "henry harold", "larry": "lawrence", "jerry": "gerald jeremy", "don": "donald", "ray": "raymond", "phil": "philip",
    "pete": "peter", "fred": "frederick", "frank": "francis", "walt": "walter", "russ": "russell", "abby": "abigail", "mandy": "amanda", "barb": "barbara", "terry": "terence theresa",
    "jenny": "jennifer", "becky": "rebecca", "debbie": "deborah", "cindy": "cynthia", "max": "maximilian", "fritz": "friedrich", "sepp": "josef", "heinz": "heinrich",
}
MIXED_UP = str.maketrans("013458$@", "oleasbsa")
TYPES_WITHOUT_VARIANTS = ("CONCEPT", "EVENT")
RARER = 10  # a slip of a word stands in at most one form for so many of the word
MOST_PARTS = 5  # words of a person's name; longer ones are titles and phrases
FEW = 2  # forms too few to tell a slip from a name by their number
# ---------------------------------------------------------------------------------


def folded(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def parse(name: str) -> list[tuple[str, str, str, int]]:
    """(kind, key, middle, rule) of every reading of a name.

    kind ``F`` is a full name: key is its words, two words in byte order.
    kind ``M`` is a full name with its middle names cut to the first one's initial.
    kind ``I`` is initials and a surname: key is ``initial surname``.
    rule is 0 for words as they stand and 1 where a nickname was replaced.
    """
    s = folded(re.sub("[​-‏⁠﻿­]", "", name)).replace("’", "'").strip()
    s = re.sub(r"\s*\([^()]*\)\s*$", "", s)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    parts = [p.strip() for p in s.split(",") if p.strip()]
    while len(parts) > 1 and re.sub(r"[.\s]", "", parts[-1]).lower() in SUFFIXES:
        parts.pop()
    comma = len(parts) == 2
    text = " ".join(reversed(parts)) if comma else " ".join(parts)
    capitals = text.upper() == text
    raw = re.findall(r"[\w'&]+\.?", re.sub(r"\.(?=\S)", ". ", text).replace("-", " ").replace("_", " "))
    words: list[str] = []
    initials: list[str] = []
    for i, t in enumerate(raw):
        dotted = t.endswith(".")
        bare = t.rstrip(".")
        if any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare):
            bare = bare.translate(MIXED_UP)
        low = bare.lower()
        if not low or low in TITLES and (i == 0 or dotted) and len(raw) > 1 or low in SUFFIXES and i == len(raw) - 1 and len(raw) > 2 and low != "sr":
            continue
        if len(low) == 1 and low.isalpha():
            initials.append(low)
        elif len(bare) == 2 and bare.isupper() and not capitals and (i == 0 or comma) and len(raw) > 1:
            initials += list(low)
        elif low == "for" and i == len(raw) - 1 and not comma:
            words.append("forestry")
        elif low == "s" and words:
            continue
        else:
            words.append(low)
    if words[:1] == ["the"]:
        words = words[1:]
    full = [WRITTEN_OUT.get(w, w) for w in words]
    if len(full) > 2 or any(w in OF_ORGANISATIONS for w in full):
        organisation = any(w in OF_ORGANISATIONS for w in full)
        bare = [w for w in full if w not in SMALL_WORDS]
        if organisation or len(bare) != len(full) or not 3 <= len(words) <= MOST_PARTS:
            return [("F", " ".join(initials + bare), "", 0)] if bare else []
        return _of_several_parts(words, initials)
    if len(words) == 2:
        out = []
        options = [NICKNAMES.get(w, w).split() for w in words]
        for a in options[0]:
            for b in options[1]:
                rule = int(a != words[0] or b != words[1])
                out.append(("F", " ".join(sorted((a, b))), initials[0] if initials else "", rule))
        return out
    if len(words) == 1 and initials:
        return [("I", f"{initials[0]} {words[0]}", initials[1] if len(initials) > 1 else "", 0)]
    return [("F", " ".join(initials + words), "", 0)] if words else []


def _of_several_parts(words: list[str], initials: list[str]) -> list[tuple[str, str, str, int]]:
    """Readings of a name of three or more words: as it stands, with names for nicknames, the last word first, middle names as initials."""
    out = [("F", " ".join(initials + words), words[1][0], 0)]
    for first in NICKNAMES.get(words[0], words[0]).split():
        told = [first, *words[1:]]
        if told != words:
            out.append(("F", " ".join(initials + told), words[1][0], 1))
        if not initials:
            for turned in ([*told[1:], told[0]], [told[-1], *told[:-1]]):
                out.append(("F", " ".join(turned), turned[1][0], 1))
            # given name, middle initial and surname, as names of two words with an initial are read
            out.append(("M", " ".join(sorted((told[0], told[-1]))), told[1][0], 1))
    return out


def _left_out(c: str) -> str:
    """SQL for a string and all its spellings with one letter left out."""
    return f"array_distinct(concat(array({c}), transform(sequence(1, greatest(length({c}), 1)), i -> concat(substring({c}, 1, i - 1), substring({c}, i + 1)))))"


def _slip(a: str, b: str) -> str:
    """SQL: at most one letter added, lost, changed, or two neighbours swapped."""
    swapped = f"(length({a}) = length({b}) and levenshtein({a}, {b}, 2) = 2 and array_sort(split({a}, '')) = array_sort(split({b}, '')))"
    return f"(levenshtein({a}, {b}, 1) between 0 and 1 or {swapped})"


def _rooted(links: DataFrame) -> DataFrame:
    """(key, hub) with every hub replaced by the end of its chain; links lead to greater forms, so there are no rings.

    Each round halves the length of every chain.
    """
    while True:
        on = links.select(F.col("key").alias("hub"), F.col("hub").alias("hub2"))
        moved = checkpointed(links.join(on, "hub", "left").select("key", F.coalesce("hub2", "hub").alias("hub"), F.col("hub2").isNotNull().alias("on")))
        links = moved.drop("on")
        if moved.where("on").isEmpty():
            return links


def variants(mentions: DataFrame) -> DataFrame:
    """(name, entity) for every string of ``mentions`` (name, type) that names a person or organisation.

    ``entity`` is the canonical form of the class.
    """
    typed = F.upper(F.trim("type"))
    without = F.sum(typed.isin(*TYPES_WITHOUT_VARIANTS).cast("int"))
    named = F.sum(typed.isin("PERSON", "ORGANIZATION", "ORGANISATION").cast("int"))
    strings = (
        mentions.where(F.length(F.trim("name")) > 0)
        .groupBy("name")
        .agg(F.count("*").alias("n"), F.coalesce(without, F.lit(0)).alias("c"), F.coalesce(named, F.lit(0)).alias("p"))
        .where("c <= p")
        .select("name", "n")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, n, *r) for s, n in zip(pdf["name"], pdf["n"], strict=True) for r in parse(s)]
            yield pd.DataFrame(rows, columns=["name", "n", "kind", "key", "mid", "rule"])

    forms = checkpointed(strings.mapInPandas(read, "name string, n long, kind string, key string, mid string, rule int"))

    # full names: of several readings the one that more mentions have as it stands
    two = "size(split(key, ' ')) = 2"
    plain = forms.where("kind = 'F'")
    support = plain.groupBy("key").agg(F.sum(F.when(F.col("rule") == 0, F.col("n")).otherwise(0)).alias("s"))
    # a middle name cut to its initial is a reading only where somebody writes that initial
    written = plain.where(f"rule = 0 and mid <> '' and {two}").select("key", "mid").distinct()
    full = plain.unionByName(forms.where("kind = 'M'").join(written, ["key", "mid"], "left_semi"))
    top = F.max(F.struct("s", "key")).over(Window.partitionBy("name"))
    # where no reading stands anywhere else, all are kept until a slip decides
    best = (F.col("s") == F.col("top.s")) & ((F.col("s") == 0) | (F.col("key") == F.col("top.key")))
    read_as = checkpointed(full.join(support, "key").withColumn("top", top).where(best).select("name", "n", "key", "mid", "rule"))
    nodes = read_as.groupBy("key").agg(F.sum("n").alias("n"), F.array_remove(F.collect_set("mid"), "").alias("mids"))

    # slips: each form to the most mentioned one of those that it shares a spelling with and that stand the tests;
    # the rows of a spelling are bounded by the letters that can be put into it
    turned = f"case when {two} then concat(split(key, ' ')[1], ' ', split(key, ' ')[0]) end"
    ways = nodes.select("n", "key", F.explode(F.expr(f"filter(array(key, {turned}), x -> x is not null)")).alias("way"))
    spelt = checkpointed(ways.withColumn("spelling", F.explode(F.expr(_left_out("way")))).where("length(spelling) > 5"))
    tops = spelt.select("spelling", F.struct("n", "key", "way").alias("top"))
    near = spelt.join(tops, "spelling").where(F.expr(f"(top.n, top.key) > (n, key) and {_slip('way', 'top.way')}")).select("key", "way", "top").distinct()
    # of the two words that differ one must be rare, by itself or beside the other: two common words one letter apart are two names
    common = nodes.select(F.explode(F.array_distinct(F.split("key", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("keys"))
    sides_of = F.expr("array(struct(0 as side, array_except(split(way, ' '), split(top.way, ' ')) as ws), struct(1 as side, array_except(split(top.way, ' '), split(way, ' ')) as ws))")
    differs = near.select("key", "way", "top", F.explode(sides_of).alias("d")).select("key", "way", "top", "d.side", F.explode_outer("d.ws").alias("word")).join(common, "word", "left")
    rarity = differs.groupBy("key", "way", "top", "side").agg(F.coalesce(F.max("keys"), F.lit(0)).alias("keys")).groupBy("key", "way", "top").agg(F.min("keys").alias("keys"), F.max("keys").alias("most"))
    slips = rarity.where(F.expr(f"keys <= {FEW} or keys * {RARER} <= most")).groupBy("key").agg(F.max("top").alias("top")).select("key", F.col("top.key").alias("hub"))
    slips = _rooted(checkpointed(slips))
    rooted = checkpointed(nodes.join(slips, "key", "left").select("key", "n", "mids", F.coalesce("hub", "key").alias("root")))

    # the reading that leads to another form, if the name had several
    of_name = Window.partitionBy("name").orderBy((F.col("root") == F.col("key")).cast("int"), "rule", "key")
    full_names = checkpointed(read_as.join(rooted.select("key", "root"), "key").withColumn("r", F.row_number().over(of_name)).where("r = 1").select("name", "key", F.col("root").alias("entity")))

    # initials: by initial, surname and middle initial; then without the middle; then with a slip in the surname
    organisation = F.arrays_overlap(F.split("key", " "), F.array(*map(F.lit, sorted(OF_ORGANISATIONS))))
    persons = rooted.join(full_names.select("key").distinct(), "key", "left_semi").where(~organisation)
    ends = "array(struct(split(key, ' ')[0] as g, element_at(split(key, ' '), -1) as s), struct(element_at(split(key, ' '), -1) as g, split(key, ' ')[0] as s))"
    sides = persons.where(two).select("root", "mids", F.explode(F.expr(ends)).alias("x"))
    # names of several words answer to initials only with the middle one
    several = persons.where(f"size(split(key, ' ')) between 3 and {MOST_PARTS}").select("root", "mids", F.explode(F.expr(f"slice({ends}, 1, 1)")).alias("x"))
    sides = sides.select("root", "mids", F.substring("x.g", 1, 1).alias("i"), F.col("x.s").alias("s")).where("length(s) > 1")
    middles = rooted.groupBy("root").agg(F.flatten(F.collect_set("mids")).alias("all_mids"))
    by_initial = sides.select("root", "i", "s").distinct().join(middles, "root")
    with_middle = several.select("root", F.substring("x.g", 1, 1).alias("i"), F.col("x.s").alias("s")).distinct().join(middles, "root").where("size(all_mids) > 0")
    short = forms.where("kind = 'I'").select("name", "n", F.substring("key", 1, 1).alias("i"), F.substring_index("key", " ", -1).alias("s"), "mid")
    units = short.select("i", "s", "mid").distinct()

    def decided(hits: DataFrame) -> DataFrame:
        """Of each (i, s, mid) the only entity of the best grade: 2 with the same middle initial, 1 with none known."""
        grade = F.when(F.col("mid") == "", 1).when(F.array_contains("all_mids", F.col("mid")), 2).when(F.size("all_mids") == 0, 1).otherwise(0)
        top = hits.withColumn("grade", grade).where("grade > 0").groupBy("i", "s", "mid", "grade").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        best = top.withColumn("b", F.max("grade").over(Window.partitionBy("i", "s", "mid"))).where("grade = b and root = other")
        return best.select("i", "s", "mid", "root")

    asked = units.join(by_initial, ["i", "s"]).unionByName(units.where("mid <> ''").join(with_middle, ["i", "s"]).where("array_contains(all_mids, mid)"))
    exact = checkpointed(decided(asked))
    rest = units.join(exact, ["i", "s", "mid"], "left_anti").join(by_initial.select("i", "s").distinct(), ["i", "s"], "left_anti")
    a = rest.withColumn("spelling", F.explode(F.expr(_left_out("s")))).where("length(spelling) > 3")
    b = by_initial.withColumnRenamed("s", "t").withColumn("spelling", F.explode(F.expr(_left_out("t")))).where("length(spelling) > 3")
    spelt_out = a.join(b, ["i", "spelling"]).where(F.expr(_slip("s", "t"))).select("i", "s", "mid", "root", "all_mids").distinct()
    by_unit = exact.unionByName(decided(spelt_out))
    alone = F.concat(F.col("i"), F.lit(". "), F.col("s"))
    initials = short.join(by_unit, ["i", "s", "mid"], "left").select("name", F.coalesce("root", alone).alias("entity"))
    return full_names.select("name", "entity").unionByName(initials)


def variant_pairs(members: DataFrame) -> DataFrame:
    """(name_a, name_b) of all pairs of strings of one entity, in byte order."""
    left, right = members.withColumnRenamed("name", "name_a"), members.withColumnRenamed("name", "name_b")
    return left.join(right, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
