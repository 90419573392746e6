"""Community hierarchies and the searches that use them."""

from strandline.operators import communities as C
from strandline.plans import search as S
from strandline.plans.engine import Engine


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def test_hierarchy_and_selection(spark):
    clique = lambda x: [(a, b) for i, a in enumerate(x) for b in x[i + 1 :]]
    e = edges(spark, *clique("abcd"), *clique("efgh"), ("d", "e"), *clique("wxyz"))
    tree = C.hierarchy(e, 2)
    base = {r.node: r.community for r in tree.where("level = 0").collect()}
    assert len({base[n] for n in "abcd"}) == 1 and len({base[n] for n in "efgh"}) == 1 and base["a"] != base["e"] != base["w"]
    text = {r.community: r for r in C.reports(e, tree.where("level = 0")).collect()}
    assert text[base["a"]]["size"] == 4 and text[base["a"]].inner_weight == 6.0 and "4 members" in text[base["a"]].report
    t = spark.createDataFrame([(1, "p", "R"), (1, "q", "R"), (0, "v", "p")], "level int, node string, community string")
    rating = lambda *x: spark.createDataFrame(list(x), "level int, community string, rating double")
    pick = lambda r, **kw: {tuple(x) for x in C.selected_reports(t, r, 1, 1.0, **kw).collect()}
    assert pick(rating((1, "R", 2.0), (0, "p", 3.0), (0, "q", 0.0))) == {(0, "p")}
    assert pick(rating((1, "R", 2.0), (0, "p", 3.0)), keep_parent=True) == {(1, "R"), (0, "p")}
    assert pick(rating((1, "R", 0.0), (0, "p", 3.0))) == set()


def test_greedy_bins_equal_a_loop(spark):
    costs = [3, 4, 5, 1, 9, 2, 2, 6]
    want, now, b = [], 0, 0
    for c in costs:
        if now and now + c > 8:
            b, now = b + 1, 0
        now += c
        want.append(b)
    rows = spark.createDataFrame([("q", i, c) for i, c in enumerate(costs)], "q string, i int, cost int")
    assert [r.bin for r in C.greedy_bins(rows, ["q"], ["i"], "cost", 8).orderBy("i").collect()] == want


def test_searches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Road salt leads to rusting bridges. Rusting bridges leads to detours."), (2, "Poor sleep causes weight gain."), (3, "Detours causes late buses.")], "doc_id long, text string")
    e = Engine(spark, str(tmp_path / "e"), window=50, overlap=5)
    e.index(docs)
    q = spark.createDataFrame([(7, "What did road salt lead to?")], "query int, question string")
    rows = S.local_context(e, q, 200).collect()
    assert {r.section for r in rows} == {"report", "relation", "source"} and any(r.text == "road salt causes rusting bridges" for r in rows)
    reports = spark.createDataFrame([("a", "Road salt is linked to bridges"), ("b", "Milk prices rose")], "community string, report string")
    assert [r.answer for r in S.global_search(reports, q).collect()] == ["Road salt is linked to bridges"]
    steps = S.iterative_search(e, q, 2, 1).collect()
    assert {r.step for r in steps} == {0, 1} and steps[0].text.startswith("Road salt")
    assert S.drift_search(e, reports, q, 1, 1).count() == 1
