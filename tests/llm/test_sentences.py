import random

from strandline.llm import sentences as S


def units(t):
    return [t[a:b] for a, b in S.split(t)]


def test_rules_by_language():
    cases = {
        "Dr. Ada left at 7 p.m. The shop closed.": ["Dr. Ada left at 7 p.m.", "The shop closed."],
        'He asked, "Is it? Really." Nobody knew.': ['He asked, "Is it? Really."', "Nobody knew."],
        '"Is it salt?" asked Bo. (See vol. 4.) No. 5 fell to 7.25. No. It rose.': ['"Is it salt?" asked Bo.', "(See vol. 4.)", "No. 5 fell to 7.25.", "No.", "It rose."],
        "The report (issued on 2 May. Revised.) blames salt... but only there. e.g. this one!": ["The report (issued on 2 May. Revised.) blames salt... but only there.", "e.g. this one!"],
        "Am 19. Oktober kam z. B. Regen u. v. m. Die Fa. X schloss.": ["Am 19. Oktober kam z. B. Regen u. v. m.", "Die Fa. X schloss."],
        "目前没有定论。“真的吗？”Bo教授问道。他说：“没有。很惊讶。”水位为6.5米. 完": ["目前没有定论。", "“真的吗？”Bo教授问道。", "他说：“没有。很惊讶。”", "水位为6.5米.", "完"],
        "В 1985 г. в пос. Ку отметили рост, т. е. исход. «Почему?» — спросил проф. Ив.": ["В 1985 г. в пос. Ку отметили рост, т. е. исход.", "«Почему?» — спросил проф. Ив."],
        "Heading\n\nOne line\ngoes on.\n- item one\n- item two.": ["Heading", "One line\ngoes on.", "- item one", "- item two."],
        "ถ้าไม่มีเหตุ เมื่อปี พ.ศ. 2010 เมืองนี้พบ ดร.Xวัดได้": ["ถ้าไม่มีเหตุ", "เมื่อปี พ.ศ. 2010 เมืองนี้พบ", "ดร.Xวัดได้"],
        "Μήπως φταίει; Ναι. यह क्यों? हाँ।": ["Μήπως φταίει;", "Ναι.", "यह क्यों?", "हाँ।"],
        "It is open.Data came from archive.x.invalid today.": ["It is open.", "Data came from archive.x.invalid today."],
    }
    for text, want in cases.items():
        assert units(text) == want, text


def test_blank_and_marks():
    assert S.split(None) == [] and S.split("") == [] and S.split(" \n﻿ ") == []
    assert units("﻿  Hello there.  ") == ["Hello there."]
    assert units('"unclosed quote. Then more.\n\nNext. One.') == ['"unclosed quote. Then more.', "Next.", "One."]


PARTS = ['He said, "no. Not me." ', "(See p. 4. Twice.) ", "「本当ですか？」と言った。", "A list:\n- one\n- two\n\n", "“真的吗？”他问道。", "Dr. X left! ", "u. v. m. Die ", "text ", "Is it?!" + " " * 9, ". . .5 (", "\n" + " " * 130 + "\n", "ถ้าไม่มี เมืองนี้ ", "Μήπως; Ναι.", "A" * 150]


def random_text(rng, most):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(1, most)))


def test_pieces_compose_to_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        t = random_text(rng, 25)
        at, state, ends = S.cuts(t, rng.randint(7, 90)), S.entering(t), []
        for lo, hi in zip(at, at[1:], strict=False):
            base = max(0, lo - S.MARGIN)
            piece = t[base : hi + S.MARGIN]
            ends += [base + e for e in S.run(piece, lo - base, hi - base, state)]
            state = S.function_of(piece, lo - base, hi - base)[state]
        assert S.spans(t, ends) == S.split(t)


def test_operator_equals_split_at_any_piece_size(spark):
    rng = random.Random(8)
    rows = [(i, random_text(rng, 60)) for i in range(400)]
    want = sorted((k, a, b) for k, t in rows for a, b in S.split(t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (100, 200, 1_000):
        assert sorted(map(tuple, S.sentence_units(docs, chunk_chars=size).collect())) == want, size


def test_table_with_long_null_and_repeated_rows(spark):
    long = 'One "two. Three." Four (five. Six.) seven.\nEight! ' * 60
    rows = [(1, "A. B c. D e.", "x"), (2, None, "x"), (3, "  ", "x"), (4, long, "x"), (4, long, "x"), (None, long + "End", "x"), (5, "Hi! Ho.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start_char string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start_char, r.end_char) for r in S.sentence_units(docs, chunk_chars=200).collect())
    want = sorted((k if k is not None else -1, a, b) for k, t, _ in rows for a, b in S.split(t))
    assert got == want
    assert S.sentence_units(docs.where("false")).count() == 0
