from strandline.llm.names import parse, variant_pairs, variants

SAME = [
    ["Katherine Lopogilik", "Dr. Katherine Lopogilik", "Lopogilik, Katherine", "Lopogilik Katherine", "KATHERINE P. LOPOGILIK", "K.P. LOPOGILIK", "KP Lopogilik", "Lopogilik, K. P.", "kate lopogilik",
     "Katherine-Lopogilik", "KatherineLopogilik", "Kather1ne Lopogilik".replace("1", "i"), "Katherine Lopoglik", "Kahterine Lopogilik", "Katherine P. Lopogilik, PhD", "Kate Lopogillik"],
    ["Věra Lopogilik", "Vera Lopogilik", " věra  lopogilik", "V. Lopogilik"],
    ["Dukomibok Institute of Public Health", "The Dukomibok Institute of Public Health", "Dukomibok Inst. of Pub. Health", "Institute of Public Health, Dukomibok", "Dukomibok Institute of Public Health (DIPH)", "Dukomibok Insttute of Public Health"],
    ["Dukomibok University", "DUKOMIBOK UNIVERSITY", "University, Dukomibok", "Dukomibok Univ."],
    ["Kokefuto Brothers Limited", "Kokefuto Bros Ltd"],
]


def test_groups(spark):
    rows = [(n, "PERSON", "x") for g in SAME for n in g for _ in range(2)] + [("a late frost", "CONCEPT", "x"), ("a late frosts", "EVENT", "x"), (None, "PERSON", None), ("  ", None, None)]
    m = spark.createDataFrame(rows, "name string, type string, entity string")
    got = {tuple(r) for r in variant_pairs(variants(m)).collect()}
    want = {(a, b) for g in SAME for a in g for b in g if a < b}
    assert got == want
    assert variant_pairs(variants(m.where("false"))).count() == 0


def test_shared_surname_and_ambiguous_initial(spark):
    rows = [("Robert Nadabepel", "PERSON"), ("Richard Nadabepel", "PERSON"), ("R. Nadabepel", "PERSON"), ("Gabriel Tutolikik", None), ("Gabriela Tutolikik", None)]
    # two given names one letter apart, each common
    rows += [(f"{g} {s}", "PERSON") for g in ("Gabriel", "Gabriela") for s in ("Fofo Aa".replace(" ", ""), "Bemalotuth", "Sinapudu", "Kabasifer")]
    m = spark.createDataFrame(rows, "name string, type string")
    assert variant_pairs(variants(m)).count() == 0


def test_one_slip_under_many_surnames(spark):
    """A slip is rare beside its word, however often it occurs."""
    surnames = [f"{a}{b}{c}" for a in ("Bema", "Sina", "Kaba", "Lopo") for b in ("lot", "pud", "sif", "gil", "rat") for c in ("uth", "osan")]
    rows = [(f"Irene {s}", "PERSON") for s in surnames for _ in range(3)] + [(f"Iene {s}", "PERSON") for s in surnames[:4]]
    got = {tuple(r) for r in variant_pairs(variants(spark.createDataFrame(rows, "name string, type string"))).collect()}
    assert got == {(f"Iene {s}", f"Irene {s}") for s in surnames[:4]}


def test_every_neighbour_is_tried_and_chains_are_followed(spark):
    # the most mentioned neighbour of "Karina Fofosatn" bears another common given name; a slip of a slip of a slip of a slip has one root
    chain = ["Lopogilikum", "Lopogilkum", "Lopogilkm", "Lopoglkm", "Lopglkm"]
    rows = [(f"Vera {s}", "PERSON") for k, s in enumerate(chain) for _ in range(9 - 2 * k)]
    rows += [(f"{g} {s}", "PERSON") for g in ("Marina", "Karina") for s in ("Bemalotuth", "Sinapudu", "Kabasifer")]
    rows += [("Marina Fofosatn", "PERSON")] * 9 + [("Karina Fofosaton", "PERSON")] * 3 + [("Karina Fofosatn", "PERSON")]
    got = {tuple(r) for r in variant_pairs(variants(spark.createDataFrame(rows, "name string, type string"))).collect()}
    same = [[f"Vera {s}" for s in chain], ["Karina Fofosaton", "Karina Fofosatn"]]
    assert got == {(a, b) for g in same for a in g for b in g if a < b}


def test_names_of_several_words(spark):
    same = [["Robert James Smith", "Bob James Smith", "Robert J. Smith", "Bob J. Smith", "R. J. Smith"], ["Maria Garcia Lopez", "Garcia Lopez Maria"], ["Jean-Pierre Martin", "J. P. Martin"]]
    alone = ["Robert Adam Miller", "Robert P. Smith Harbour Works", "J. K. Martin"]
    rows = [(n, "PERSON") for g in same for n in g] + [(n, "PERSON") for n in alone]
    got = {tuple(r) for r in variant_pairs(variants(spark.createDataFrame(rows, "name string, type string"))).collect()}
    assert got == {(a, b) for g in same for a in g for b in g if a < b}


def test_parse():
    assert parse("Mr. R. Solutigi") == [("I", "r solutigi", "", 0)]
    assert {k for _, k, _, _ in parse("Thea Solutigi")} == {"solutigi theodora", "dorothea solutigi"}
    assert parse("") == [] and parse("...") == []
