"""Functions and operators against plain loops, and their edge cases."""

import math
from collections import Counter

from pyspark.sql import functions as F

from strandline.functions import hooks, metrics, text, vector
from strandline.operators import chunking, experiments, graph, merging, retrieval, testset


def one(spark, c, **cols):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in cols.items())
    return spark.createDataFrame([tuple(v for _, v in cols.values())], schema).select(c.alias("x")).first().x


def test_text_functions(spark):
    s = lambda f, v: one(spark, f(F.col("t")), t=("string", v))
    assert s(text.answer_norm, "The  U.S. is a big, BIG place!") == "us is big big place"
    assert s(text.experiment_norm, "A-b: the c") == "b c"
    assert s(text.answer_norm, "") == "" and s(text.answer_norm, None) is None
    assert s(text.java_hash, "abc") == 96354
    assert s(text.parse_triple, "(a, 'b c', d)") == ["a", "b c", "d"]
    assert s(text.sub_questions, "Who built the bridge and who paid for it?") == ["Who built the bridge?", "who paid for it?"]
    assert s(text.sub_questions, "Salt and ice?") == ["Salt and ice?"]
    assert s(text.html_to_text, "<p>a &amp; b</p><script>x()</script>") == "a & b"
    assert s(text.json_answer, 'so: ```json\n{"answer": "salt"}\n```') == "salt" and s(text.json_answer, "salt") is None
    assert s(text.as_boolean, " Yes ") is True and s(text.as_boolean, "maybe") is None
    assert s(text.preview, "x" * 300) == "x" * 200 + "..."


def test_hash_embedding_and_hooks(spark):
    assert hooks.java_hash("abc") == 96354 and hooks.java_hash("polygenelubricants") == -(1 << 31)
    e = hooks.hash_embedder(16)(["salt and ice", ""])
    assert abs((e[0] ** 2).sum() - 1) < 1e-9 and (e[1] == 0).all()
    df = spark.createDataFrame([("a b",), (None,), ("a b",)], "t string")
    got = [r.v for r in df.select(hooks.embedded(F.col("t"), hooks.hash_embedder(8, True), 8).alias("v")).collect()]
    assert got[1] is None and got[0] == got[2] and len(got[0]) == 8
    assert [r.a for r in df.select(hooks.answered(F.col("t"), lambda x: 1 / 0).alias("a")).collect()] == [None] * 3
    assert hooks.position_embedder("m")(["abc"]).shape == (1, 48)


def test_vectors(spark):
    v = lambda c, a, b: one(spark, c(F.col("a"), F.col("b")), a=("array<double>", a), b=("array<double>", b))
    assert v(vector.cosine, [1.0, 0.0], [1.0, 1.0]) == 1 / math.sqrt(2)
    assert v(vector.cosine, [0.0, 0.0], [1.0, 1.0]) == 0 and v(vector.cosine, [1.0], [1.0, 2.0]) == 0
    assert v(vector.squared_distance, [1.0, 2.0], [0.0, 0.0]) == 5


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_metrics(spark):
    a, b = "the cat sat on the mat the end".split(), "on the mat sat the cat the".split()
    m = lambda c: one(spark, c(F.col("a"), F.col("b")), a=("array<string>", a), b=("array<string>", b))
    assert m(metrics.overlap) == sum((Counter(a) & Counter(b)).values())
    assert m(metrics.rouge_l) == 2 * lcs(a, b) / (len(a) + len(b))
    for x, y in (([], b), (a, [])):
        for c in (metrics.rouge_l, metrics.bleu, metrics.lexical_cosine):
            assert one(spark, c(F.col("a"), F.col("b")), a=("array<string>", x), b=("array<string>", y)) == 0
    assert one(spark, metrics.bleu(F.col("a"), F.col("a")), a=("array<string>", a)) == 1
    assert abs(one(spark, metrics.chrf(F.col("t"), F.col("t"), 2), t=("string", "salt")) - 1) < 1e-9
    ranks = lambda c: one(spark, c, r=("array<string>", ["x", "y", "z"]), g=("array<string>", ["y", "q"]))
    assert ranks(metrics.recall_at(F.col("r"), F.col("g"), 2)) == 0.5 and ranks(metrics.mrr_at(F.col("r"), F.col("g"), 3)) == 0.5
    assert ranks(metrics.bridge_coverage_at(F.col("r"), F.col("g"), 3)) == 0
    assert abs(ranks(metrics.ndcg_at(F.col("r"), F.col("g"), 3)) - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9


def test_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None), (4, "one")], "id int, text string")
    got = chunking.token_windows(docs, "id", text.words(F.col("text")), 10, 3).orderBy("id", "ord").collect()
    assert [(r.id, r.ord, r.tokens) for r in got] == [(1, 0, 10), (1, 1, 10), (1, 2, 10), (1, 3, 4), (4, 0, 1)]
    assert got[1].content.startswith("7 8")
    tail = chunking.merged_tail_windows(docs.where("id = 1"), "id", text.words(F.col("text")), 10, 2, 5).orderBy("ord").collect()
    assert [r.tokens for r in tail] == [10, 10, 9] and tail[-1].content.endswith("24")
    lists = one(spark, chunking.list_windows(F.col("x"), 3, 1), x=("array<string>", list("abcdef")))
    assert lists == [["a", "b", "c"], ["c", "d", "e"], ["e", "f"]]


def test_packed_sentences_equal_a_loop(spark):
    t = "One two. Three four five! Six? Seven eight nine ten. Eleven."
    want, now, n = [], [], 0
    for s in ["One two.", "Three four five!", "Six?", "Seven eight nine ten.", "Eleven."]:
        k = len(s.split())
        if n and n + k > 5:
            want.append(" ".join(now))
            now, n = [], 0
        now.append(s)
        n += k
    want.append(" ".join(now))
    docs = spark.createDataFrame([(1, t), (2, ""), (3, None)], "id int, text string")
    assert [r.content for r in chunking.packed_sentences(docs, "id", "text", 5).orderBy("id", "ord").collect()] == want


def test_merging_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([("a", "P", "xx", "1"), ("a", "Q", "yy", "2"), ("a", None, None, None), ("b", None, "", "1")], "name string, type string, description string, source string")
    got = {r.name: r for r in merging.entities(rows).collect()}
    assert (got["a"].description, got["a"].type, got["a"].sources, got["a"].n) == ("xx", "P", "1<SEP>2", 3)
    assert got["b"].description is None and got["b"].type is None
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "k int, p string, q string")
    assert {tuple(r) for r in merging.upsert(old, new, "k").collect()} == {(1, "a", "x"), (2, "b", "z"), (3, "c", None)}


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def test_graph(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "e"), ("e", "f"), ("f", "g"))
    assert {r.node: r.component for r in graph.components(e).collect()} == {**dict.fromkeys("abcdefg", "a"), "x": "x", "y": "x"}
    assert not graph.has_cycle(e) and graph.has_cycle(e.unionByName(edges(spark, ("d", "b"))))
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hops) for r in graph.reachable(e, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r.path) for r in graph.simple_paths(e, seeds, 2).collect()} == {("a", "b"), ("a", "b", "c")}
    target = spark.createDataFrame([("b",)], "node string")
    assert {tuple(r.path) for r in graph.simple_paths(e, seeds, 3, target).collect()} == {("a", "b")}
    tree = spark.createDataFrame([("r", None), ("s", "r"), ("t", "s")], "child string, parent string")
    assert {(r.child, r.depth) for r in graph.depths(tree).collect()} == {("r", 0), ("s", 1), ("t", 2)}
    empty = edges(spark, ("a", "b")).where("false")
    assert graph.components(empty).count() == 0 and graph.pagerank(empty, 2).count() == 0 and not graph.has_cycle(empty)


def test_pagerank_sums_to_one(spark):
    e = graph.both_ways(edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")))
    assert abs(sum(r["rank"] for r in graph.pagerank(e, 40, tolerance=1e-9).collect()) - 1) < 1e-6


def test_search_edge_cases(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [0.0, 1.0])], "id long, v array<double>")
    got = [(r.doc, r["rank"]) for r in retrieval.search(v.where("id = 1"), v, 3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (6, 3)]  # ties by id; the others are no vectors of this kind
    assert retrieval.search(v.where("false"), v, 3).count() == 0 and retrieval.search(v, v.where("false"), 3).count() == 0


def test_budget_and_caps(spark):
    rows = spark.createDataFrame([("q", i, "s" if i < 4 else "t", 10) for i in range(6)], "query string, r int, source string, cost int")
    assert retrieval.within_budget(rows, ["query"], [F.col("r")], "cost", 35, 5).count() == 3
    got = [r.r for r in retrieval.capped(rows, ["query"], "source", [F.col("r")], 2, 5).orderBy("place").collect()]
    assert got == [0, 1, 4, 5, 2]


def test_quotas():
    assert experiments.quotas({"a": 1, "b": 9, "c": 9}, 9) == {"a": 1, "b": 4, "c": 4}
    assert experiments.quotas({"a": 1}, 5) == {"a": 1} and experiments.quotas({}, 5) == {}


def test_balanced_and_tertiles(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(9)] + [(9, None, None)], "id int, g string, x double")
    assert Counter(r.g for r in experiments.balanced(rows, "g", "id", 4).collect()) == {"a": 2, "b": 2}
    assert Counter(r.bucket for r in experiments.tertiles(rows, "x").collect()) == {"low": 3, "mid": 3, "high": 3, None: 1}


def test_test_set_relations(spark):
    n = spark.createDataFrame([(1, "d", 0, ["salt", "road", "ice"]), (2, "d", 1, ["salt", "road"]), (3, "e", 0, ["milk"])], "id int, doc string, ord int, w array<string>")
    assert [tuple(r) for r in testset.next_edges(n, "doc", "ord", "id").collect()] == [(1, 2, "next")]
    assert [(r.src, r.dst, r.shared) for r in testset.shared_edges(n, "id", F.col("w")).collect()] == [(1, 2, 2)]
    assert one(spark, testset.lead(F.col("t"), 1, 3), t=("string", "One two three four. Five.")) == "One two three"
    assert [r.topic for r in testset.topics(spark.createDataFrame([(1, "salt salt road")], "id int, t string"), "id", "t").collect()] == ["salt"]


def test_similar_pairs_against_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(61, 4)).round(3)
    rows = [(k, x.tolist()) for k, x in enumerate(v, 1)]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(a + 1, b + 1) for a in range(61) for b in range(a + 1, 61) if unit[a] @ unit[b] >= 0.3}
    df = spark.createDataFrame([*rows, (98, [0.0] * 4), (99, None), (100, [1.0])], "id long, v array<double>")
    for block in (10, 1_000):
        got = [(r.src, r.dst) for r in retrieval.similar_pairs(df, 0.3, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_shared_edges_of_common_words(spark):
    sets = [set("abc"), set("abd"), set("ab"), set("acd"), set("b"), set("cd"), set("abcd")]
    want = {(i, j, len(a & b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 2}
    n = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, w array<string>")
    for common in (1, 2, 1000):
        assert {(r.src, r.dst, r.shared) for r in testset.shared_edges(n, "id", F.col("w"), common=common).collect()} == want
