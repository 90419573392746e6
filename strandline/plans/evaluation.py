"""Row-level evaluation metrics over questions, answers, passages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as E
from ..functions import text as T
from ..registry import query, table
from .texts import ANSWER_NORM, CONTENT_TOKENS, EXPERIMENT_NORM

SAMPLES_SQL = "s as (select id, any_value(question) as question, any_value(answer) as answer, any_value(answer_aliases) as aliases, any_value(paragraphs) as paragraphs from experiment_samples group by id)"
ANSWERS_SQL = f"{SAMPLES_SQL}, a as (select result_id, any_value(sample_id) as sample_id, any_value(prediction) as prediction from per_question_metrics group by 1), p as (select a.result_id, a.prediction, s.* from a join s on a.sample_id = s.id)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "experiment_samples").groupBy("id").agg(*[F.first(c).alias(n) for c, n in (("question", "question"), ("answer", "answer"), ("answer_aliases", "aliases"), ("paragraphs", "paragraphs"))])


def _answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "per_question_metrics").select("result_id", "sample_id", "prediction").dropDuplicates(["result_id"])
    return a.join(_samples(spark, d), F.col("sample_id") == F.col("id"))


GOLDS = "list_filter(list_prepend(answer, coalesce(aliases, [])), lambda g: g is not null)"


@query(f"with {ANSWERS_SQL}, n as (select result_id, {ANSWER_NORM.format(x='coalesce(prediction, chr(32))')} as p, list_transform({GOLDS}, lambda g: {ANSWER_NORM.format(x='g')}) as g from p) select result_id, list_contains(g, p)::int as exact_match from n")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    golds = F.filter(F.concat(F.array("answer"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda g: g.isNotNull())
    norms = F.transform(golds, lambda g: T.answer_norm(g))
    return _answers(spark, d).select("result_id", F.array_contains(norms, T.answer_norm(F.coalesce("prediction", F.lit("")))).cast("int").alias("exact_match"))


@query(f"""with {ANSWERS_SQL}, n as (select result_id, {EXPERIMENT_NORM.format(x='coalesce(prediction, chr(32))')} as p, {EXPERIMENT_NORM.format(x='coalesce(answer, chr(32))')} as g from p),
w as (select result_id, list_filter(string_split(p, ' '), lambda w: w <> '') as p, list_filter(string_split(g, ' '), lambda w: w <> '') as g from n),
o as (select result_id, len(p) as np, len(g) as ng, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda z: z = t))))), 0) as n from w)
select result_id, round(case when np = 0 and ng = 0 then 1.0 when np > 0 then n / np else 0.0 end, 6) as precision, round(case when np = 0 and ng = 0 then 1.0 when ng > 0 then n / ng else 0.0 end, 6) as recall, round(case when np = 0 and ng = 0 then 1.0 when n > 0 then 2.0 * n / (np + ng) else 0.0 end, 6) as f1 from o""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    norm = lambda c: T.experiment_norm(F.coalesce(c, F.lit("")))
    scored = E.token_scores(_answers(spark, d).select("result_id", norm("prediction").alias("p"), norm("answer").alias("g")), F.col("p"), F.col("g"))
    return scored.select("result_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


RANKED_SQL = f"{SAMPLES_SQL}, r as (select id, list_transform(paragraphs, lambda x: trim(regexp_replace(lower(x.paragraph_text), '[^a-z0-9 ]', ' ', 'g'))) as retrieved, list_distinct(list_transform(list_filter(paragraphs, lambda x: x.is_supporting), lambda x: trim(regexp_replace(lower(x.paragraph_text), '[^a-z0-9 ]', ' ', 'g')))) as gold from s), k as (select id, gold, retrieved, retrieved[1:5] as top, list_filter(range(1, 6), lambda i: i <= len(retrieved) and list_contains(gold, retrieved[i])) as hits from r)"


@query(f"""with {RANKED_SQL} select id, round(case when len(gold) > 0 then len(list_intersect(top, gold)) / len(gold) else 0.0 end, 6) as recall_at5, round(case when len(gold) > 0 then len(list_intersect(retrieved[1:1], gold)) / len(gold) else 0.0 end, 6) as recall_at1,
round(case when len(hits) > 0 then 1.0 / list_min(hits) else 0.0 end, 6) as mrr_at5,
round(case when len(gold) > 0 then coalesce(list_sum(list_transform(hits, lambda i: 1.0 / log2(i + 1.0))), 0) / list_sum(list_transform(range(1, least(5, len(gold)) + 1), lambda i: 1.0 / log2(i + 1.0))) else 0.0 end, 6) as ndcg_at5,
case when len(gold) > 0 and len(list_filter(gold, lambda g: not list_contains(top, g))) = 0 then 1.0 else 0.0 end as bridge_coverage_at5 from k""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    text = lambda x: T.triple_norm(x["paragraph_text"])
    r = _samples(spark, d).select("id", F.transform("paragraphs", text).alias("r"), F.array_distinct(F.transform(F.filter("paragraphs", lambda x: x["is_supporting"]), text)).alias("g"))
    r, g = r, (F.col("r"), F.col("g"))
    return r.select(
        "id", F.round(E.recall_at(*g, 5), 6).alias("recall_at5"), F.round(E.recall_at(*g, 1), 6).alias("recall_at1"), F.round(E.mrr_at(*g, 5), 6).alias("mrr_at5"),
        F.round(E.ndcg_at(*g, 5), 6).alias("ndcg_at5"), E.bridge_coverage_at(*g, 5).alias("bridge_coverage_at5"),
    )


CONTEXTS_SQL = f"{SAMPLES_SQL}, c as (select id, question, answer, list_transform(paragraphs, lambda x: x.paragraph_text) as ctx from s)"


def _ct(x: str) -> str:
    return CONTENT_TOKENS.format(x=x)


def _cov(a: str, b: str) -> str:
    return f"(case when len(list_distinct({a})) > 0 then len(list_intersect(list_distinct({a}), {b})) / len(list_distinct({a})) else 0.0 end)"


@query(f"""with {CONTEXTS_SQL}, t as (select id, {_ct('question')} as q, {_ct("coalesce(answer, '')")} as a, ctx, {_ct("array_to_string(ctx, ' ')")} as every, lower(array_to_string(ctx, ' ')) as low, lower(trim(answer)) as la, list_transform(ctx, lambda x: {_ct('x')}) as each from c where answer is not null),
m as (select *, list_filter(a, lambda w: length(w) > 2) as a2 from t)
select id, round(0.75 * {_cov('q', 'every')} + 0.25 * case when len(ctx) > 0 then coalesce(list_sum(list_transform(each, lambda e: {_cov('q', 'e')})), 0) / len(ctx) else 0.0 end, 6) as context_relevance,
round(case when la <> '' and contains(low, la) then 1.0 else {_cov('a2', 'every')} end, 6) as groundedness,
round(case when len(q) > 0 and len(a) > 0 then len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a))) else 0.0 end, 6) as relevancy,
round(case when len(ctx) > 0 then len(list_filter(each, lambda e: len(list_intersect(a, e)) > 0)) / len(ctx) else 0.0 end, 6) as utilisation from m""")
def context_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).where("answer is not null").select("id", "question", "answer", F.transform("paragraphs", lambda x: x["paragraph_text"]).alias("ctx"))
    q, a, c = F.col("question"), F.col("answer"), F.col("ctx")
    return rows.select(
        "id", F.round(E.context_relevance(q, c), 6).alias("context_relevance"), F.round(E.groundedness(a, c), 6).alias("groundedness"),
        F.round(E.answer_relevancy(q, a), 6).alias("relevancy"), F.round(E.context_utilisation(a, c), 6).alias("utilisation"),
    )


def _grams(x: str, n: int) -> str:
    return f"(case when len({x}) >= {n} then list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i + {n - 1}], ' ')) else [] end)"


def _overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda y: y = t)), len(list_filter({b}, lambda z: z = t))))), 0)"


_BLEU = " + ".join(f"case when len(p) >= {n} then ln(({_overlap(f'p{n}', f'r{n}')} + 1.0) / (len(p{n}) + 1.0)) else 0.0 end" for n in range(1, 5))


@query(f"""with {CONTEXTS_SQL}, w as (select id, list_filter(string_split_regex(trim(lower(question)), '\\s+'), lambda x: x <> '') as p, list_filter(string_split_regex(trim(lower(ctx[1])), '\\s+'), lambda x: x <> '') as r from c where len(ctx) > 0),
g as (select *, {', '.join(f"{_grams('p', n)} as p{n}, {_grams('r', n)} as r{n}" for n in range(1, 5))} from w)
select id, round(case when len(p) > 0 and len(r) > 0 then case when len(p) >= len(r) then 1.0 else exp(1.0 - len(r) / len(p)) end * exp(({_BLEU}) / greatest(1, least(4, len(p)))) else 0.0 end, 6) as bleu,
round(case when {_overlap('p1', 'r1')} > 0 then 2.0 * {_overlap('p1', 'r1')} / (len(p) + len(r)) else 0.0 end, 6) as rouge1,
round(case when len(p) > 0 and len(r) > 0 then coalesce(list_sum(list_transform(list_intersect(p, r), lambda t: len(list_filter(p, lambda y: y = t)) * len(list_filter(r, lambda z: z = t)))), 0) / (sqrt(list_sum(list_transform(list_distinct(p), lambda t: len(list_filter(p, lambda y: y = t)) ** 2))) * sqrt(list_sum(list_transform(list_distinct(r), lambda t: len(list_filter(r, lambda y: y = t)) ** 2)))) else 0.0 end, 6) as cosine from g""")
def overlap_scores(spark: SparkSession, d: str) -> DataFrame:
    """BLEU, ROUGE-1 and lexical cosine of a question with its first passage."""
    rows = _samples(spark, d).where("size(paragraphs) > 0").select("id", T.words(F.lower("question")).alias("p"), T.words(F.lower(F.col("paragraphs")[0]["paragraph_text"])).alias("r"))
    p, r = F.col("p"), F.col("r")
    n = E.overlap(p, r)
    return rows.select("id", F.round(E.bleu(p, r), 6).alias("bleu"), F.round(F.when(n > 0, 2.0 * n / (F.size(p) + F.size(r))).otherwise(0.0), 6).alias("rouge1"), F.round(E.lexical_cosine(p, r), 6).alias("cosine"))


@query(None)
def subsequence_scores(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-L and chrF; dynamic programming, checked against loops in the tests."""
    rows = _samples(spark, d).where("size(paragraphs) > 0").select("id", F.lower("question").alias("q"), F.lower(F.col("paragraphs")[0]["paragraph_text"]).alias("c"))
    return rows.select("id", F.round(E.rouge_l(T.words(F.col("q")), T.words(F.col("c"))), 6).alias("rouge_l"), F.round(E.chrf(F.col("q"), F.col("c")), 6).alias("chrf"))


NUM = "list_distinct(regexp_extract_all({x}, '\\d+(?:\\.\\d+)?'))"


@query(f"""with {ANSWERS_SQL}, t as (select result_id, {_ct('question')} as q, {_ct('prediction')} as p, {_ct('answer')} as r, {NUM.format(x='prediction')} as np, {NUM.format(x='answer')} as nr from p where prediction is not null and answer is not null)
select result_id, round((0.65 * case when len(p) + len(r) > 0 then 2.0 * len(list_intersect(p, r)) / (len(p) + len(r)) else 0.0 end + 0.25 * case when len(nr) = 0 then 1.0 else len(list_intersect(np, nr)) / len(nr) end + 0.10 * {_cov('q', 'p')}) * case when len(np) > 0 and len(nr) > 0 and len(list_intersect(np, nr)) = 0 then 0.2 else 1.0 end, 6) as accuracy from t""")
def answer_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).where("prediction is not null and answer is not null")
    return rows.select("result_id", F.round(E.answer_accuracy(F.col("question"), F.col("prediction"), F.col("answer")), 6).alias("accuracy"))


@query("""with e as (select user_id, ts, event_id, event_type, value, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as turn from events)
select user_id, turn::bigint as turn, count(*) filter (event_type <> 'signup') as replies, round(sum(e.value) filter (event_type <> 'signup'), 4) as total from e where turn > 0 group by 1, 2""")
def turn_grouping(spark: SparkSession, d: str) -> DataFrame:
    """An opening event and all that follow it before the next, as a turn and its replies."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("turn", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w)).where("turn > 0")
    reply = F.col("event_type") != "signup"
    return e.groupBy("user_id", "turn").agg(F.count(F.when(reply, 1)).alias("replies"), F.round(F.sum(F.when(reply, F.col("value"))), 4).alias("total"))


@query("""with c as (select user_id, list_sort(list_distinct(list(event_type))) as called from events group by 1), x as (select ['click', 'purchase', 'view'] as expected)
select user_id, round(case when len(list_intersect(called, expected)) > 0 then 2.0 * len(list_intersect(called, expected)) / (len(called) + 3) else 0.0 end, 4) as f1 from c, x""")
def tool_call_f1(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of calls made, against the expected ones."""
    called = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("called"))
    return called.select("user_id", E.tool_f1(F.col("called"), F.array(*map(F.lit, ("click", "purchase", "view")))).alias("f1"))
