import random

from strandline.llm import leaks as L

ITEM = "When Kimupom drained the Mavinast marsh in 1913, the eel catch at Mogafin fell to 74 baskets by July."
OTHER = "When Bonanelt drained the Mafibult marsh in 2000, the eel catch at Toposen fell to 86 baskets by August."
QUESTION = "How many Vazuzost barges did Zulumox send from Pufizon to Pepepick before the thaw of 1967 set in?"
SHARED = "Use only the passage below when you answer the question that follows."
CHINESE = "1946年，Zuribust堰在Rekonem上游损失了8块闸板，到了5月，Putedam草场全部干涸。"


def tables(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(
        [(1, f"{SHARED} {ITEM}", QUESTION, "salt"), (2, f"{SHARED} {OTHER}", None, "salt"), (3, CHINESE, "为什么Pesinerd在1916年Dupofolt集市之后仅75天就关闭了Domikem的Ladola渡口？", "x"), (4, None, None, None)],
        "item_id long, passage string, question string, answer string",
    )
    return docs, items


def test_forms_of_leaks(spark):
    words = ITEM.rstrip(".").split()
    texts = [
        f"Before. {ITEM} After.",  # 0 whole
        f"Before. {ITEM.upper()}",  # 1 case
        "x " + ITEM.replace("fell", "great"),  # 2 one word
        "x " + ITEM.replace("Mogafin", "Mogfin").replace("marsh", "mars"),  # 3 slips
        "x " + ITEM.replace("a", "а").replace("drained", "drai\xadned").replace("eel catch", "<b>eel catch</b>"),  # 4 look-alikes and markup
        f"He read {' '.join(words[2:15])} and stopped",  # 5 thirteen words
        f"He read {' '.join(words[2:11])} and stopped",  # 6 nine words: no
        QUESTION,  # 7
        " ".join(QUESTION.split()[:14]),  # 8 part of a question: no
        SHARED + " salt",  # 9 shared line: no
        "When Fonoditoth drained the Rinimotes marsh in 1899, the eel catch at Pizopord fell to 12 baskets by May.",  # 10 like sentence: no
        "前文。" + CHINESE.replace("Rekonem", "Rek　onem"),  # 11
        CHINESE.replace("Zuribust", "Bobofut").replace("Rekonem", "Tatatam").replace("Putedam", "Gagagam"),  # 12 like sentence: no
        None, "", " ",  # 13-15
    ]
    docs, items = tables(spark, texts)
    want = {(i, 1) for i in (0, 1, 2, 3, 4, 5, 7)} | {(11, 3)}
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == want
    assert {tuple(r) for r in L.leaks(docs, items, block_chars=100).collect()} == want  # in blocks
    assert L.leaks(docs, items.where("false")).count() == 0 and L.leaks(docs.where("false"), items).count() == 0


def test_layout_within_words():
    """Lost blanks and line wraps within words change no letter, however many words they touch."""
    words = QUESTION.rstrip("?").split()
    joined = " ".join(words).replace("Vazuzost barges", "Vazuzostbarges").replace("before the", "beforethe").replace("set in", "setin")
    wrapped = ITEM.replace("Kimupom", "Kimu\npom").replace("drained", "drai\nned").replace("Mavinast", "Mavi\nnast").replace("marsh", "ma\nrsh")
    ix = L.Index([(1, True, [L.skeleton(w) for w in L.tokens(QUESTION)]), (2, True, [L.skeleton(w) for w in L.tokens(ITEM)])])
    texts = [f"He asked: {joined}? Nobody knew.", f"Before. {wrapped} After.", ITEM.replace("Kimupom", "Zazuzo").replace("Mavinast", "Rikiki").replace("Mogafin", "Bobobo").replace("eel", "cod")]
    assert set(ix.search(texts, L._Memo(ix))) == {(0, 1), (1, 2)}


def test_bound_of_held():
    """What held() accepts, the bound accepts."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    accepted = 0
    for whole_only in (False, True):
        for _ in range(1500):
            item = [rng.choice(vocab) for _ in range(rng.randint(6, 20))]
            around = list(item)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(around))
                w = around[at]
                edit = rng.random()
                if edit < 0.5:
                    k = rng.randrange(len(w))
                    around[at] = w[:k] + rng.choice("xyz") + w[k + 1 :]
                elif edit < 0.75 and at + 1 < len(around):
                    around[at : at + 2] = [w + around[at + 1]]
                elif len(w) > 3:
                    around[at : at + 1] = [w[:2], w[2:]]
            around = [rng.choice(vocab) for _ in range(4)] + around + [rng.choice(vocab) for _ in range(4)]
            ix = L.Index([(1, whole_only, item)])
            ix.needs = [(set(), 0)]
            if L.held(item, around, whole_only, ix.rare_words):
                accepted += 1
                assert ix._could_hold(0, {ix.vocab.get(w, -1) for w in around}, around), (item, around)
    assert accepted > 300


def test_like_sentences_are_not_compared(monkeypatch):
    """A sentence with several other names is refused by its words and letters, not by an alignment with every item like it."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
    known = name()
    sentence = lambda: f"when {known} drained the {name()} marsh in summer the catch at {name()} weir fell to few baskets by {name()}".split()
    ix = L.Index([(i, True, sentence()) for i in range(40)] + [(99, True, ["other", *sentence()])])
    ix.needs = [({ix.vocab[known]}, 1)] * 41
    calls, held = [], L.held
    monkeypatch.setattr(L, "held", lambda *a: calls.append(a) or held(*a))
    assert not set(ix.search([" ".join(sentence()) for _ in range(5)], L._Memo(ix)))
    assert len(calls) <= 5


def test_marks_without_letters_around():
    """A lone voicing mark is a token without letters."""
    rng = random.Random(6)
    item = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(30)]
    ix = L.Index([(7, False, item)])
    assert set(ix.search(["\u309b " + " ".join(item[:13]) + " \u309b \u309b and more"], L._Memo(ix))) == {(0, 7)}


def test_items_found_do_not_hide_others():
    """A sentence like one of an item that is found already is still searched for its own item."""

    def found(seed):
        rng = random.Random(seed)
        name = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
        keepers = lambda: f"keepers at the {name()} lighthouse logged {rng.randint(9, 90)} foggy nights before january {rng.randint(1850, 1990)} when the {name()} bell finally cracked".split()
        ledger = lambda: f"a ledger from {name()} shows that {name()} paid {rng.randint(9, 90)} drovers to move the {name()} herd past {name()} in june".split()
        sentences = [(i, False, make()) for i in range(12) for make in (ledger, keepers)]
        ix = L.Index(sentences)
        words = list(sentences[3][2])
        for at in rng.sample(range(len(words)), 3):
            w = words[at]
            if not w[0].isdigit() and len(w) > 3:
                k = rng.randrange(1, len(w) - 1)
                words[at] = w[:k] + w[k + 1 :]
        words[rng.randrange(len(words))] = "other"
        text = ". ".join(" ".join(x) for i, _, x in sentences[::2] if i != 1) + ". " + " ".join(words)
        return set(ix.search([text], L._Memo(ix)))

    assert all((0, 1) in found(seed) for seed in range(200, 216))


def test_recall_against_exact_verification():
    """Items with one random edit are found by the sampled walks as by comparing every sentence."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    sentences = [(i, False, [rng.choice(vocab) for _ in range(18)]) for i in range(300)]
    texts = []
    for _, _, ws in sentences:
        w = list(ws)
        at = rng.randrange(len(w))
        w[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        texts.append(" ".join([rng.choice(vocab) for _ in range(15)] + w + [rng.choice(vocab) for _ in range(15)]))
    ix = L.Index(sentences)
    found = set(ix.search(texts, L._Memo(ix)))
    assert len({(i, i) for i in range(300)} & found) >= 297 and all(a == b for a, b in found)


def recall_with_slips(every, edits=("lost", "changed", "added", "turned"), seed=9, n=300):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(4000)]
    sentences = [(i, False, [rng.choice(vocab) for _ in range(18)]) for i in range(n)]

    def slip(w):
        k, how = rng.randrange(1, len(w) - 1), rng.choice(edits)
        return {"lost": w[:k] + w[k + 1 :], "changed": w[:k] + "x" + w[k + 1 :], "added": w[:k] + "q" + w[k:], "turned": w[:k] + w[k + 1] + w[k] + w[k + 2 :]}[how]

    texts = [" ".join([rng.choice(vocab) for _ in range(15)] + [slip(w) if j % every == 0 else w for j, w in enumerate(ws)] + [rng.choice(vocab) for _ in range(15)]) for _, _, ws in sentences]
    ix = L.Index(sentences)
    found = set(ix.search(texts, L._Memo(ix)))
    return len({(i, i) for i in range(n)} & found) / n, all(a == b for a, b in found)


def test_recall_with_several_slips():
    for every in (3, 4, 5, 9):
        recall, clean = recall_with_slips(every)
        assert recall >= 0.95 and clean, (every, recall)


def test_items_of_any_key(spark):
    docs, items = tables(spark, [f"Before. {ITEM} After.", QUESTION])
    got = L.leaks(docs, items.withColumn("item_id", L.F.concat(L.F.lit("k"), "item_id")))
    assert {tuple(r) for r in got.collect()} == {(0, "k1"), (1, "k1")}
