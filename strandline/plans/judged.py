"""Judged metrics over the recorded answers, conversations and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import judged as J
from ..functions import judgements as H
from ..functions import metrics as E
from ..operators.chunking import sentences
from ..registry import query, table
from .evaluation import ANSWERS_SQL, _answers, _cov, _ct
from .knowledge import SENT

P_SQL = f"{ANSWERS_SQL}, w as (select result_id, id, question, prediction, answer, list_transform(paragraphs, lambda x: x.paragraph_text) as ctx, list_transform(list_filter(paragraphs, lambda x: x.is_supporting), lambda x: x.paragraph_text) as good, list_transform(list_filter(paragraphs, lambda x: not x.is_supporting), lambda x: x.paragraph_text) as bad from p where prediction is not null)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    text = lambda keep: F.transform(F.filter("paragraphs", keep), lambda x: x["paragraph_text"])
    rows = _answers(spark, d).where("prediction is not null")
    return rows.select("result_id", "id", "question", "prediction", "answer", text(lambda x: F.lit(True)).alias("ctx"), text(lambda x: x["is_supporting"]).alias("good"), text(lambda x: ~x["is_supporting"]).alias("bad"))


def _supported(s: str, each: str) -> str:
    return f"len(list_filter({each}, lambda e: {_cov(s, 'e')} >= 0.5)) > 0"


@query(f"""with {P_SQL}, t as (select result_id, list_transform({SENT.format(x='prediction')}, lambda s: {_ct('s')}) as st, list_transform(ctx, lambda x: {_ct('x')}) as each from w)
select result_id, round(case when len(st) > 0 then len(list_filter(st, lambda s: {_supported('s', 'each')})) / len(st) else 0.0 end, 6) as faithfulness from t""")
def statement_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Share of an answer's statements that one passage of its sample bears out."""
    return _rows(spark, d).select("result_id", F.round(E.faithfulness(sentences(F.col("prediction")), F.col("ctx")), 6).alias("faithfulness"))


@query(f"""with {P_SQL}, t as (select result_id, list_transform({SENT.format(x='prediction')}, lambda s: {_ct('s')}) as st, {_ct('answer')} as r, list_transform(good, lambda x: {_ct('x')}) as g, list_transform(bad, lambda x: {_ct('x')}) as b from w where answer is not null)
select result_id, round(case when len(st) > 0 then len(list_filter(st, lambda s: {_cov('s', 'r')} < 0.5 and {_supported('s', 'g')})) / len(st) else 0.0 end, 6) as relevant, round(case when len(st) > 0 then len(list_filter(st, lambda s: {_cov('s', 'r')} < 0.5 and {_supported('s', 'b')})) / len(st) else 0.0 end, 6) as irrelevant from t""")
def noise_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Statements that the reference does not bear out but a supporting, or another, passage does."""
    rows = _rows(spark, d).where("answer is not null")
    score = lambda c: F.round(H.noise_sensitivity(sentences(F.col("prediction")), F.col("answer"), F.col(c)), 6)
    return rows.select("result_id", score("good").alias("relevant"), score("bad").alias("irrelevant"))


@query(f"""with {P_SQL}, t as (select result_id, prediction as s, ctx, array_to_string(ctx, ' ') as text from w), k as (select result_id, {_ct('text')} as w, {_ct('s')} as q, length(s) as n, length(text) as m, list_filter(regexp_extract_all(s, '"([^"]+)"', 1), lambda s: len(list_filter(string_split_regex(trim(s), '\\s+'), lambda y: y <> '')) >= 3) as sp, lower(text) as low from t)
select result_id, round(0.5 * {_cov('w', 'q')} + 0.5 * case when m > 0 then 1 - least(n, m) / m else 0.0 end, 6) as summary_score, round(case when len(sp) > 0 then len(list_filter(sp, lambda s: contains(low, lower(s)))) / len(sp) else 1.0 end, 6) as quoted from k""")
def summary_scores(spark: SparkSession, d: str) -> DataFrame:
    """An answer as a summary of its sample's passages, and its quotations from them."""
    p, c = F.col("prediction"), F.col("ctx")
    return _rows(spark, d).select("result_id", F.round(H.summary_score(p, c), 6).alias("summary_score"), F.round(H.quoted_alignment(p, c), 6).alias("quoted"))


NUM = r"list_distinct(regexp_extract_all({x}, '\b\d+(?:[.,]\d+)?\b'))"


def _facts_sql(x: str, pattern: str) -> str:
    return f"list_transform(list_filter(list_transform(string_split_regex({x}, '{pattern}'), lambda s: trim(s)), lambda s: s <> ''), lambda s: {{'t': {_ct('s')}, 'n': {NUM.format(x='s')}}})"


def _jac(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) else 0.0 end)"


def _clash(a: str, b: str) -> str:
    return f"len({a}) > 0 and len({b}) > 0 and len(list_intersect({a}, {b})) = 0"


_MATCH = f"{_jac('a.t', 'r.t')} * case when {_clash('r.n', 'a.n')} then 0.5 else 1.0 end * case when len(r.n) > 0 and len(a.n) = 0 then 0.7 else 1.0 end >= 0.55"
_NEG = J.NEGATIONS.replace("'", "''")


@query(f"""with {P_SQL}, t as (select result_id, prediction as p, answer as g, {_facts_sql('prediction', '[.!?;]+')} as fa, {_facts_sql('answer', '[.!?;]+')} as fr from w where answer is not null),
m as (select *, len(list_filter(fa, lambda a: len(list_filter(fr, lambda r: {_MATCH})) > 0)) as tp, len(list_filter(fr, lambda r: len(list_filter(fa, lambda a: {_MATCH})) = 0)) as fn, {_ct('p')} as ta, {_ct('g')} as tr, {NUM.format(x='p')} as na, {NUM.format(x='g')} as nr from t),
sc as (select *, case when len(fa) > 0 then tp / len(fa) else 0.0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as rc from m),
f as (select *, case when len(fa) = 0 and len(fr) = 0 then 1.0 when len(fa) = 0 or len(fr) = 0 or pr + rc = 0 then 0.0 else 2.0 * pr * rc / (pr + rc) * case when {_clash('na', 'nr')} then 0.45 else 1.0 end * case when regexp_matches(lower(p), '{_NEG}') <> regexp_matches(lower(g), '{_NEG}') then 0.8 else 1.0 end end as facts,
case when len(ta) > 0 and len(tr) > 0 then 0.7 * {_jac('ta', 'tr')} + 0.3 * {_cov('tr', 'ta')} else 0.0 end as alike from sc)
select result_id, round(case when trim(p) = '' or trim(g) = '' then 0.0 else 0.75 * facts + 0.25 * alike end, 6) as correctness from f""")
def answer_correctness(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).where("answer is not null")
    return J.answer_correctness(rows, F.col("prediction"), F.col("answer")).select("result_id", F.round("correctness", 6).alias("correctness"))


_GENERIC = "[" + ", ".join(f"'{w}'" for w in J.GENERIC_FACT_WORDS) + "]"


def _borne(a: str, b: str) -> str:
    same = "len(list_intersect(c.t, r.t))"
    missing = f"len(list_filter(c.t, lambda w: not list_contains(r.t, w) and not list_contains({_GENERIC}, w) and length(w) >= 5))"
    score = f"(0.6 * {same} / len(c.t) + 0.4 * case when len(r.t) > 0 then {same} / len(r.t) else 0.0 end) * (1.0 - 0.6 * least({missing}, 2)) * case when {_clash('c.n', 'r.n')} then 0.25 else 1.0 end * case when len(c.n) > 0 and len(r.n) = 0 then 0.6 else 1.0 end"
    return f"len(list_filter({a}, lambda c: len(c.t) > 0 and len(list_filter({b}, lambda r: {score} >= 0.5)) > 0))"


@query(f"""with {P_SQL}, t as (select result_id, prediction as p, answer as g, {_facts_sql('prediction', '[.!?]+')} as fa, {_facts_sql('answer', '[.!?]+')} as fr from w where answer is not null),
m as (select *, case when len(fa) > 0 then {_borne('fa', 'fr')} / len(fa) else 0.0 end as pr, case when len(fr) > 0 then {_borne('fr', 'fa')} / len(fr) else 0.0 end as rc from t)
select result_id, round(case when trim(p) = '' or trim(g) = '' then 0.0 when len(fa) = 0 and len(fr) = 0 then 1.0 when len(fa) = 0 or pr + rc = 0 then 0.0 else 2.0 * pr * rc / (pr + rc) end, 2) as factual from m""")
def factual_correctness(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).where("answer is not null")
    return J.factual_correctness(rows, F.col("prediction"), F.col("answer")).select("result_id", "factual")


_HAVE = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(f"""with {P_SQL}, t as (select result_id, prediction as p, array_to_string(ctx, ' ') as text from w), k as (select *, {_HAVE} as have, {_ct('p')} as tok, list_distinct(list_transform(regexp_extract_all(p, '\\b[A-Z][A-Za-z0-9]*\\b'), lambda x: lower(x))) as names, list_distinct(regexp_extract_all(p, '\\b\\d+[A-Za-z]*\\b')) as fp, list_distinct(regexp_extract_all(text, '\\b\\d+[A-Za-z]*\\b')) as ft, {_ct('text')} as every from t),
g as (select *, list_filter(tok, lambda w: length(w) > 2) as long, len(list_filter(names, lambda x: list_contains(tok, x) and not list_contains(have, x) and length(x) > 2)) as lost_names, len(list_filter(fp, lambda x: not list_contains(ft, x))) as lost_figures from k)
select result_id, round(case when trim(p) <> '' and contains(lower(text), lower(trim(p))) then 1.0 else {_cov('long', 'every')} * (1.0 - 0.45 * least(lost_names, 2)) * (1.0 - 0.2 * least(lost_figures, 2)) end, 6) as groundedness from g""")
def penalised_groundedness(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("result_id", F.round(J.penalised_groundedness(F.col("prediction"), F.col("ctx")), 6).alias("groundedness"))


CACHE_SQL = "c as (select args_hash, any_value(mode) as mode, any_value(engine) as engine, any_value(prompt) as prompt, any_value(content) as content from llm_cache group by 1)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_cache").groupBy("args_hash").agg(*[F.first(c).alias(c) for c in ("mode", "engine", "prompt", "content")])


_GOAL = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) >= 3 and not list_contains([" + ", ".join(f"'{w}'" for w in J.GOAL_STOP_WORDS) + "], w)))"
_REFUSED = f"(regexp_matches(lower(content), '{J.REFUSALS.replace(chr(39), chr(39) * 2)}') or regexp_matches(lower(content), '{J.FAILURES.replace(chr(39), chr(39) * 2)}'))"


@query(f"""with {CACHE_SQL}, t as (select *, {_GOAL.format(x='prompt')} as de, {_GOAL.format(x='content')} as ar from c), n as (select *, len(list_intersect(de, ar)) as n from t)
select args_hash, coalesce(n > 0 and (n / len(de) >= 0.5 or (n / len(de) >= 0.4 and n / len(ar) >= 0.4) or {_jac('de', 'ar')} >= 0.33) and not {_REFUSED}, false)::int as reached from n""")
def goal_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Does a cached answer reach what its prompt asked for?"""
    return _cache(spark, d).select("args_hash", J.goal_reached(F.col("prompt"), F.col("content")).cast("int").alias("reached"))


TOPICS = ("crop failure", "insomnia", "fish kills", "basement damp", "weight gain", "kidney damage")
_T = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"


@query(f"""with {CACHE_SQL}, k as (select mode, coalesce(engine, '') as engine, args_hash, list_filter({_T}, lambda t: contains(lower(prompt), t)) as asked, coalesce(trim(content) <> '' and not {_REFUSED}, false) as answered from c where prompt is not null),
s as (select mode, engine, sum(case when answered then len(asked) else 0 end) as tp, count(*) filter (answered and len(asked) = 0) as fp, sum(case when answered then 0 else len(asked) end) as fn from k group by 1, 2)
select mode, engine, tp::bigint as tp, fp, fn::bigint as fn, round(case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as adherence from s""")
def topic_adherence(spark: SparkSession, d: str) -> DataFrame:
    """Of every mode and engine: answers on the stated topics against answers on others and topics left unanswered."""
    asked = F.filter(F.array(*map(F.lit, TOPICS)), lambda t: F.contains(F.lower("prompt"), t))
    answered = F.coalesce((F.trim("content") != "") & ~J.failed(F.col("content")), F.lit(False))
    k = _cache(spark, d).where("prompt is not null").select("mode", F.coalesce("engine", F.lit("")).alias("engine"), F.size(asked).alias("n"), answered.alias("ok"))
    s = k.groupBy("mode", "engine").agg(
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("tp"), F.count(F.when(F.col("ok") & (F.col("n") == 0), 1)).alias("fp"), F.sum(F.when(~F.col("ok"), F.col("n")).otherwise(0)).alias("fn")
    )
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return s.select("mode", "engine", "tp", "fp", "fn", F.round(f1, 6).alias("adherence"))


EVENTS_SQL = "e as (select user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as n, row_number() over (partition by user_id order by ts desc, event_id desc) as back from events)"


@query(f"""with {EVENTS_SQL}, s as (select user_id, count(*) filter (event_type = 'click') as calls, count(*) filter (event_type = 'purchase') as tools, count(*) filter (event_type in ('click', 'view')) as ai, count(*) filter (event_type = 'signup') as human, coalesce(bool_or(back = 1 and event_type in ('click', 'view')), false) as final, coalesce(bool_or(back = 1 and value < 1), false) as refused from e group by 1)
select user_id, round(case when calls = 0 then case when final then 1.0 when ai > 0 then 0.7 else 0.0 end else 0.6 * least(tools / calls, 1.0) + 0.3 * final::int + 0.1 * least(case when human > 0 then ai / human else 0.0 end, 1.0) end * case when refused then 0.2 else 1.0 end, 6) as completion from s""")
def workflow_completion(spark: SparkSession, d: str) -> DataFrame:
    """Users' events read as turns: clicks are an agent's calls, purchases their results, views answers, signups people's turns."""
    e = table(spark, d, "events")
    n = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    s = e.groupBy("user_id").agg(n("click").alias("calls"), n("purchase").alias("tools"), n("click", "view").alias("ai"), n("signup").alias("human"), last.alias("last"))
    final, refused = F.coalesce(F.col("last.event_type").isin("click", "view"), F.lit(False)), F.coalesce(F.col("last.value") < 1, F.lit(False))
    return s.select("user_id", F.round(J.workflow_completion(F.col("calls"), F.col("tools"), F.col("ai"), F.col("human"), final, refused), 6).alias("completion"))


@query("""with e as (select user_id, {'name': event_type, 'args': floor(value / 50)::bigint} as c, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type is not null and value is not null),
s as (select user_id, list(c order by n) filter (n <= 2) as a, list(c order by n) filter (n between 3 and 4) as b from e group by 1 having count(*) filter (n between 3 and 4) = 2),
t as (select user_id, a, b, list_sort(a) as sa, list_sort(b) as sb from s)
select user_id, case when list_transform(a, lambda x: x.name) = list_transform(b, lambda x: x.name) then len(list_filter(range(1, 3), lambda i: a[i] = b[i])) / 2 else 0.0 end as ordered,
case when list_transform(sa, lambda x: x.name) = list_transform(sb, lambda x: x.name) then len(list_filter(range(1, 3), lambda i: sa[i] = sb[i])) / 2 else 0.0 end as unordered from t""")
def call_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """A user's first two calls against the next two: the same kinds, with the same argument."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").where("event_type is not null and value is not null")
    e = rows.select("user_id", F.struct(F.col("event_type").alias("name"), F.floor(F.col("value") / 50).alias("args")).alias("c"), F.row_number().over(w).alias("n")).where("n <= 4")
    part = lambda lo, hi: F.transform(F.array_sort(F.collect_list(F.when(F.col("n").between(lo, hi), F.struct("n", "c")))), lambda x: x["c"])
    s = e.groupBy("user_id").agg(part(1, 2).alias("a"), part(3, 4).alias("b")).where("size(b) = 2")
    return s.select("user_id", J.call_accuracy(F.col("a"), F.col("b")).alias("ordered"), J.call_accuracy(F.col("a"), F.col("b"), False).alias("unordered"))


_TEXTS = ("'SELECT category, count(*) AS n FROM ' || coalesce(source_file, 'x') || ' WHERE row_index > ' || (row_index % 7) || ' GROUP BY category'",
          "'select count(*),  category from ' || case when row_index % 5 = 0 then 'other' else coalesce(source_file, 'x') end || ' where row_index > ' || (row_index % 3) || case when row_index % 4 = 0 then '' else ' group by category' end || case when row_index % 6 = 0 then ' order by category' else '' end")


def _part_sql(c: str, p: str) -> str:
    return f"trim(regexp_extract({c}, '{p}', 1))"


def _cols_sql(c: str, p: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_extract({c}, '{p}', 1), '\\s+as\\s+\\w+', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')))"


_WORDS = lambda c: f"list_distinct(regexp_extract_all({_part_sql(c, J.SQL_WHERE)}, '[a-z0-9_]+'))"
_CALLS = lambda c: f"list_sort(list_distinct(regexp_extract_all({c}, '{J.SQL_AGGREGATE}', 1)))"


@query(f"""with r as (select id, min(row_index) as row_index, min(source_file) as source_file from causal_rows group by 1), n as (select id, trim(regexp_replace(lower({_TEXTS[0]}), '\\s+', ' ', 'g')) as a, trim(regexp_replace(lower({_TEXTS[1]}), '\\s+', ' ', 'g')) as b from r where row_index is not null),
w as (select *, {_WORDS('a')} as wa, {_WORDS('b')} as wb from n),
s as (select id, greatest(0.0, 1.0 - (case when {_part_sql('a', J.SQL_FROM)} <> {_part_sql('b', J.SQL_FROM)} then 0.45 else 0.0 end + case when {_cols_sql('a', J.SQL_SELECT)} <> {_cols_sql('b', J.SQL_SELECT)} then 0.2 else 0.0 end + case when {_cols_sql('a', J.SQL_GROUP)} <> {_cols_sql('b', J.SQL_GROUP)} then 0.15 else 0.0 end
+ case when {_cols_sql('a', J.SQL_ORDER)} <> {_cols_sql('b', J.SQL_ORDER)} then 0.1 else 0.0 end + case when {_part_sql('a', J.SQL_WHERE)} <> {_part_sql('b', J.SQL_WHERE)} then 0.25 * (1.0 - case when len(wa) = 0 and len(wb) = 0 then 1.0 else {_jac('wa', 'wb')} end) else 0.0 end + case when {_CALLS('a')} <> {_CALLS('b')} then 0.35 else 0.0 end)) as likeness from w)
select id, round(likeness, 6) as likeness, (round(likeness, 9) >= 0.75)::int as equivalent from s""")
def sql_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Two SQL texts made from every causal row: alike but for order, filter, grouping or table."""
    r = table(spark, d, "causal_rows").groupBy("id").agg(F.min("row_index").alias("row_index"), F.min("source_file").alias("source_file")).where("row_index is not null")
    like = J.sql_likeness(F.expr(_TEXTS[0]), F.expr(_TEXTS[1]))
    return r.select("id", like.alias("x")).select("id", F.round("x", 6).alias("likeness"), (F.round("x", 9) >= 0.75).cast("int").alias("equivalent"))


@query("""with s as (select id, any_value(paragraphs) as p from experiment_samples group by id), t as (select id, list_transform(p, lambda x: x.idx || ',' || (x.is_supporting)) as a, list_transform(p, lambda x: x.idx || ',' || (x.is_supporting and x.idx % 3 <> 1)) as b from s where len(p) > 0),
m as (select id, len(a) as na, len(a[1:len(a) - 1]) as nb, len(list_filter(range(1, len(a)), lambda i: a[i] = b[i])) as n from t), pr as (select id, case when nb > 0 then n / nb else 0.0 end as p, n / na as r from m)
select id, round(p, 6) as row_precision, round(r, 6) as row_recall, round(case when p + r > 0 then 2.0 * p * r / (p + r) else 0.0 end, 6) as row_f1 from pr""")
def table_scores(spark: SparkSession, d: str) -> DataFrame:
    """A CSV table of a sample's passages against one with some marks turned and the last row lost."""
    s = table(spark, d, "experiment_samples").groupBy("id").agg(F.first("paragraphs").alias("p")).where("size(p) > 0")
    csv = lambda rows, mark: F.concat(F.lit("idx,supporting\n"), F.array_join(F.transform(rows, lambda x: F.concat_ws(",", x["idx"].cast("string"), mark(x).cast("string"))), "\n"))
    rows = s.select("id", csv(F.col("p"), lambda x: x["is_supporting"]).alias("reference"), csv(F.slice("p", 1, F.size("p") - 1), lambda x: x["is_supporting"] & (x["idx"] % 3 != 1)).alias("response"))
    scored = J.table_scores(rows, F.col("response"), F.col("reference"))
    return scored.select("id", *[F.round(c, 6).alias(c) for c in ("row_precision", "row_recall", "row_f1")])


@query(f"""with {P_SQL}, t as (select result_id, {_ct('question')} as q, {_ct('prediction')} as a, list_transform(ctx, lambda x: {_ct('x')}) as each, {_ct("array_to_string(ctx, ' ')")} as every from w where question is not null and ctx is not null)
select result_id, round(0.75 * {_cov('q', 'every')} + 0.25 * case when len(each) > 0 then coalesce(list_sum(list_transform(each, lambda e: {_cov('q', 'e')})), 0) / len(each) else 0.0 end, 6) as context_relevance, round({_jac('q', 'a')}, 6) as relevancy from t""")
def preset_scores(spark: SparkSession, d: str) -> DataFrame:
    """The first tier of metrics through the evaluation driver."""
    rows = _rows(spark, d).where("question is not null and ctx is not null").select("result_id", "question", F.col("prediction").alias("response"), F.col("ctx").alias("contexts"))
    return J.evaluate(rows, "tier1").select("result_id", F.round("context_relevance", 6).alias("context_relevance"), F.round("relevancy", 6).alias("relevancy"))


@query("""with s as (select id, any_value(answer) as a, any_value(answer_aliases) as al from experiment_samples group by id), p as (select result_id, any_value(sample_id) as id, any_value(prediction) as p from per_question_metrics group by 1),
g as (select result_id, p, list_filter(list_prepend(a, coalesce(al, [])), lambda x: x is not null) as golds from p join s using (id) where p is not null),
w as (select result_id, golds, list_transform(golds, lambda g: case when lower(trim(g)) = lower(trim(p)) then 10000 else coalesce(list_sum(list_transform(list_distinct(list_filter(string_split_regex(trim(lower(p)), '\\s+'), lambda y: y <> '')), lambda t: least(len(list_filter(string_split_regex(trim(lower(p)), '\\s+'), lambda y: y = t)), len(list_filter(string_split_regex(trim(lower(g)), '\\s+'), lambda y: y = t))))), 0) end) as sc from g where len(golds) > 0)
select result_id, golds[list_position(sc, list_max(sc))] as reference from w""")
def best_references(spark: SparkSession, d: str) -> DataFrame:
    """Of an answer's gold answers the one nearest to it."""
    golds = F.filter(F.concat(F.array("answer"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda g: g.isNotNull())
    rows = _answers(spark, d).where("prediction is not null").select("result_id", "prediction", golds.alias("golds")).where("size(golds) > 0")
    return rows.select("result_id", H.best_reference(F.col("prediction"), F.col("golds")).alias("reference"))


@query("""with m as (select id, any_value(support_indices) as r from example_meta group by id), s as (select id, any_value(paragraphs) as p from experiment_samples group by id), t as (select id, list_distinct(list_transform(p, lambda x: trim(x.idx::varchar))) as got, list_transform(r, lambda x: trim(x::varchar)) as want from s join m using (id) where r is not null)
select id, round(case when len(got) > 0 then len(list_intersect(got, want)) / len(got) else 0.0 end, 6) as precision from t""")
def id_precision(spark: SparkSession, d: str) -> DataFrame:
    """Share of a sample's passages, by number, that its manifest names as supporting."""
    m = table(spark, d, "example_meta").groupBy("id").agg(F.first("support_indices").alias("r")).where("r is not null")
    s = table(spark, d, "experiment_samples").groupBy("id").agg(F.first("paragraphs").alias("p")).join(m, "id")
    got, want = F.transform("p", lambda x: x["idx"].cast("string")), F.transform("r", lambda x: x.cast("string"))
    return s.select("id", F.round(E.id_precision(got, want), 6).alias("precision"))
