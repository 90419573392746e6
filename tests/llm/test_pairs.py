import json
import random

from strandline.llm import pairs as P

LANGS = {"en": ("What is the most likely cause of {e} in {p}?", "The records say that {c} came first and that {e} followed.", [("road salt", "fish kills"), ("poor sleep", "weight gain"), ("night shifts", "insomnia")]),
         "de": ("Was ist die wahrscheinlichste Ursache für {e} in {p}?", "Die Quellen sagen, dass zuerst {c} kam und danach {e} auftrat.", [("schlechter Schlaf", "Staunässe"), ("später Frost", "feuchte Keller"), ("Nachtarbeit", "Ernteausfall")])}


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        lang = rng.choice(list(LANGS))
        q, a, ce = LANGS[lang]
        c, e = rng.choice(ce)
        place = "".join(rng.choice("BDFGK" if k == 0 else "bdfgk") + rng.choice("aeiou") for k in range(3))
        question, answer = q.format(e=e, p=place), rng.choice([a.format(c=c, e=e), c, c.capitalize() + "."])
        kind = rng.choice(P.DEFECTS) if rng.random() < 0.12 else None
        if kind == "empty_answer":
            answer = rng.choice([None, "", " ", "null", "<p></p>", "{}", "Answer:", "​"])
        elif kind == "copies_question":
            answer = rng.choice([question, question.upper(), f"{question} {question}", f'"{question}"', question[:-3]])
        elif kind == "refusal":
            answer = rng.choice(["I'm sorry, but I cannot help with that.", "I must decline to respond to that."] if lang == "en" else ["Es tut mir leid, dabei kann ich nicht helfen.", "Diese Frage darf ich leider nicht beantworten."])
        elif kind == "truncated_answer":
            full = a.format(c=c, e=e)
            answer = full[: rng.randint(len(full) // 2, len(full) - 12)]
            if answer.split()[-1] in (e.split() + c.split()) or answer.endswith((e, c)):
                answer = full[:14]
        elif kind == "other_language":
            x = "de" if lang == "en" else "en"
            answer = LANGS[x][1].format(c=LANGS[x][2][0][0], e=LANGS[x][2][0][1])
        rows.append(("t", str(i), question, answer))
        if kind:
            truth[str(i)] = kind
    samples = [(str(k), LANGS[k % 2 and "en" or "de"][0].format(e="x", p="y"), LANGS[k % 2 and "en" or "de"][2][k % 3][0], [(0, "t", LANGS[k % 2 and "en" or "de"][1].format(c=LANGS[k % 2 and "en" or "de"][2][k % 3][0], e=LANGS[k % 2 and "en" or "de"][2][k % 3][1]), True)], json.dumps({"lang": k % 2 and "en" or "de"})) for k in range(60)]
    return rows, truth, samples


def test_planted_defects_validate_the_cutoffs(spark):
    rows, truth, samples = corpus()
    pairs = spark.createDataFrame(rows, "origin string, pair_key string, question string, content string")
    s = spark.createDataFrame(samples, "id string, question string, answer string, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, metadata string")
    found = P.defects(pairs, s)
    got = {r.pair_key: r.defect for r in P.one_defect(found).collect()}
    hit = sum(got.get(k) == v for k, v in truth.items())
    assert hit >= 0.93 * len(truth), [(k, v, got.get(k), rows[int(k)]) for k, v in truth.items() if got.get(k) != v][:8]
    assert hit >= 0.93 * len(got), [(k, v, truth.get(k), rows[int(k)]) for k, v in got.items() if truth.get(k) != v][:8]
    # repeated rows give one row a defect; an empty table none
    twice = P.defects(pairs.unionByName(pairs), s)
    assert twice.count() == twice.dropDuplicates(["origin", "pair_key", "defect"]).count()
    assert P.defects(pairs.where("false"), s.where("false")).count() == 0


def test_answers_that_only_look_defective(spark):
    v = P.Voter(P.Language([]))
    q = "Did night shifts cause insomnia in Fibopum, or was it something else?"
    for answer in ("Night shifts (the owners declined to comment).", "A sorry state of repair: poor sleep.", "unknown", f"{q} Night shifts.", "road salt"):
        bits = v(q, answer)
        assert bin(bits & 0b111).count("1") < 2 and bin(bits >> 3 & 0b111).count("1") < 2 and bin(bits >> 6 & 0b111).count("1") < 2, answer
    assert v(None, None) & 0b111 == 0b111 and v(q, None) & 0b111 == 0b111


def test_runs_are_counted_over_all_answers(spark, monkeypatch):
    """Every piece of every answer counts, as in one loop, however often a worker passes its counts on."""
    monkeypatch.setattr(P, "HELD", 50)
    rows, _, _ = corpus(n=400)
    texts = [(a, 1) for a in sorted({r[3] for r in rows if r[3]})] + [("Road salt", 7), ("\n".join(f"{w} of the Bridge and the mill. The {w}s" for w in ("salt", "frost", "sleep") * 30), 1)]
    df = spark.createDataFrame(texts, "content string, n long").repartition(3)
    ending = P.fit_ending(df)
    assert {"the", "die", "road"} <= ending.known
    ends, goes = P.Counter(), P.Counter()
    for c, n in texts:
        for piece in P.pieces(c, n):
            ending.counted(*piece, ends, goes)
    got = {r.run: (r.ends, r.goes) for r in P.run_counts(df, ending).collect()}
    assert {k: v for k, v in got.items() if "*" not in k} == {k: (ends[k], goes[k]) for k in {*ends, *goes} if ends[k] + goes[k] > 1}
    assert ends["road salt"] >= 7 and max(x + y for x, y in got.values()) > 60
    assert got["that road s*"] == (0, sum(ends[k] + goes[k] for k in {*ends, *goes} if k.startswith("that road s") and k.count(" ") == 2 and len(k) > len("that road s")))


def test_long_refusal():
    v = P.Voter(P.Language([]))
    refusal = "I'm sorry, but I cannot help with that. "
    for more in (0, 3, 40):
        bits = v("What caused the floods in Fibopum?", refusal + "The records of the district are kept elsewhere and say nothing about it. " * more)
        assert bin(bits >> 6 & 0b111).count("1") >= 2, more


def test_distance_bound():
    assert P._distance("kitten", "sitting", 5) == 3 and P._distance("abc", "xyzxyz", 2) == 3
