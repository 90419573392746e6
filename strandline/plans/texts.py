"""Queries over texts: normal forms, tokens, ids, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..registry import query, table

# SQL for the same normal forms, without look-arounds
WORDS = "list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '')"
NO_ARTICLES = "array_to_string(list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '' and w not in ('a','an','the')), ' ')"
ANSWER_NORM = NO_ARTICLES.format(x="regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')")
EXPERIMENT_NORM = NO_ARTICLES.format(x="regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g')")
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
CONTENT_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda t: t not in (" + STOP.replace("{", "{{") + "))"


@query(f"select args_hash, min({ANSWER_NORM.format(x='content')}) as answer_norm, min({EXPERIMENT_NORM.format(x='content')}) as experiment_norm, min(trim(regexp_replace(lower(content), '[^a-z0-9 ]', ' ', 'g'))) as triple_norm from llm_cache group by args_hash")
def answer_norms(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return table(spark, d, "llm_cache").groupBy("args_hash").agg(F.min(T.answer_norm(c)).alias("answer_norm"), F.min(T.experiment_norm(c)).alias("experiment_norm"), F.min(T.triple_norm(c)).alias("triple_norm"))


@query("select doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) as unicode_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+'))) as unicode_distinct, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) as ascii_tokens from documents where text is not null")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    u = T.unicode_tokens(t)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(u).alias("unicode_tokens"), F.size(F.array_distinct(u)).alias("unicode_distinct"), F.size(T.ascii_tokens(t)).alias("ascii_tokens"))


@query(f"select doc_id, array_to_string(list_sort({CONTENT_TOKENS.format(x='title')}), ' ') as tokens from documents where title is not null")
def content_token_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.array_join(F.array_sort(T.content_tokens(F.col("title"))), " ").alias("tokens"))


@query("select doc_id, 'doc-' || md5(text) as doc_key, substr(replace(replace(to_base64(unhex(sha256(concat_ws('|', 'documents', doc_id::varchar, text)))), '+', '-'), '/', '_'), 1, 8) as chunk_key from documents where text is not null")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.content_id("doc-", F.col("text")).alias("doc_key"), T.short_hash(F.lit("documents"), F.col("doc_id").cast("string"), F.col("text")).alias("chunk_key"))


@query("select c_custkey, list_reduce(list_prepend(0::bigint, list_transform(regexp_extract_all(c_name, '.'), lambda x: ascii(x)::bigint)), lambda a, x: (a * 31 + x) & 4294967295) as h from customer")
def java_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.java_hash(F.col("c_name")).alias("h"))


@query(f"with n as (select result_id, min({EXPERIMENT_NORM.format(x='prediction')}) as x from per_question_metrics group by 1) select result_id, regexp_matches(x, '{T.UNKNOWN_PATTERN}') as unknown from n where x is not null")
def unknown_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "per_question_metrics").groupBy("result_id").agg(F.min(T.experiment_norm(F.col("prediction"))).alias("x")).where("x is not null")
    return rows.select("result_id", F.col("x").rlike(T.UNKNOWN_PATTERN).alias("unknown"))


@query("select id, any_value(list_distinct(list_filter(list_transform(regexp_extract_all(question, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), lambda r: regexp_replace(r, '^(" + "|".join(T.QUESTION_WORDS) + ") ?', '')), lambda r: r <> ''))).len() as phrases, any_value(contains(lower(question), 'cause')::int + contains(lower(question), 'why')::int + contains(lower(question), 'after')::int) as hits from experiment_samples group by id")
def question_features(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    rows = table(spark, d, "experiment_samples").select("id", F.size(T.title_phrases(q)).alias("phrases"), T.keyword_hits(q, F.array(*map(F.lit, ("cause", "why", "after")))).alias("hits"))
    return rows.groupBy("id").agg(F.first("phrases").alias("phrases"), F.first("hits").alias("hits"))


@query("select doc_id, upper(regexp_replace(trim(source), '^\"+|\"+$', '', 'g')) as identifier, case when regexp_matches(title, '[\",\n\r]') then '\"' || replace(title, '\"', '\"\"') || '\"' else title end as csv_title, case when length(text) > 40 then substr(text, 1, 40) || '...' else text end as shown from documents")
def field_renderings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.identifier_norm(F.col("source")).alias("identifier"), T.csv_field(F.col("title")).alias("csv_title"), T.preview(F.col("text"), 40).alias("shown"))


@query(r"""select args_hash, min(case when regexp_matches(content, '(?s)\{.*\}') then json_extract_string(regexp_extract(content, '(?s)(\{.*\})', 1), '$.answer') when regexp_matches(content, '(?s)\{\s*"answer"\s*:\s*"') then regexp_extract(content, '(?s)\{\s*"answer"\s*:\s*"((?:[^"\\]|\\.)*)', 1) end) as answer from llm_cache group by args_hash""")
def fenced_json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers within JSON objects, those that break off among them."""
    return table(spark, d, "llm_cache").groupBy("args_hash").agg(F.min(T.json_answer(F.col("content"))).alias("answer"))


@query("""with t as (select doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') as t from documents where text is not null),
w as (select doc_id, t, unnest(range(0, len(t), 90)) as start from t)
select doc_id, (start // 90)::int as ord, len(t[start + 1:start + 100])::int as tokens, md5(array_to_string(t[start + 1:start + 100], ' ')) as content_hash from w""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return C.token_windows(docs, "doc_id", T.words(F.col("text")), 100, 10).select("doc_id", "ord", "tokens", F.md5("content").alias("content_hash"))


@query("""with t as (select doc_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '') as t from documents where text is not null),
s as (select doc_id, t, len(t) as n, case when len(t) <= 100 then [0] else range(0, len(t) - 20, 80) end as st from t where len(t) > 0),
k as (select doc_id, t, n, case when len(st) > 1 and n - st[-1] < 30 then st[1:len(st) - 1] else st end as st from s),
e as (select doc_id, t, n, len(st) as m, unnest(st) as start, unnest(range(0, len(st))) as ord from k)
select doc_id, ord::int as ord, len(t[start + 1:case when ord = m - 1 then n else start + 100 end])::int as tokens from e""")
def merged_tail_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return C.merged_tail_windows(docs, "doc_id", T.words(F.col("text")), 100, 20, 30).select("doc_id", "ord", "tokens")


@query("""with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\n[ \\t]*\\n\\s*', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as p from documents where text is not null)
select doc_id, unnest(range(0, len(p)))::int as ord, md5(unnest(p)) as content_hash from p""")
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.posexplode(C.paragraphs(F.col("text"))).alias("ord", "p")).select("doc_id", "ord", F.md5("p").alias("content_hash"))


@query("""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as s from documents where text is not null)
select doc_id, len(s)::int as sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::int as longest from s""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = C.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).alias("sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).alias("longest"))


@query(None)
def packed_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Greedy packing is a fold; checked against a loop in the tests."""
    return C.packed_sentences(table(spark, d, "documents").where("text is not null"), "doc_id", "text", 60)


@query("""with s as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) as s from documents where text is not null),
m as (""" + " union all ".join(
    f"select doc_id, regexp_extract_all(s, '{p}', {2 if r else 1}) as a, regexp_extract_all(s, '{p}', {1 if r else 2}) as b from s where regexp_matches(s, '{p}')" for _, p, r in C.CAUSAL_PATTERNS
) + """), z as (select doc_id, trim(regexp_replace(trim(lower(regexp_replace(unnest(a), '\\s+', ' ', 'g'))), '^(which|that|this|these|those) ', '')) as cause, trim(regexp_replace(trim(lower(regexp_replace(unnest(b), '\\s+', ' ', 'g'))), '^(which|that|this|these|those) ', '')) as effect from m),
k as (select * from z where length(cause) >= 3 and length(effect) >= 3 and len(list_filter(string_split(cause, ' '), lambda w: w not in (""" + STOP + """))) > 0 and len(list_filter(string_split(effect, ' '), lambda w: w not in (""" + STOP + """))) > 0)
select cause, effect, max(case when length(cause) < 5 or length(effect) < 5 then 0.6::double else 0.8::double end) as confidence, count(*) as n from k group by 1, 2""")
def causal_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples kept once with the largest confidence."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(C.sentences(F.col("text"))).alias("s"))
    return C.causal_triples(rows, "doc_id", F.col("s")).groupBy("cause", "effect").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@query("""with c as (select doc_id, source, row_number() over (partition by source order by doc_id) as r, lead(doc_id) over (partition by source order by doc_id) as next_doc from documents)
select doc_id, r::int as r, next_doc, ((r - 1) // 5)::int as batch from c""")
def batches_and_next(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    r = F.row_number().over(w)
    return table(spark, d, "documents").select("doc_id", r.alias("r"), F.lead("doc_id").over(w).alias("next_doc"), F.floor((r - 1) / 5).cast("int").alias("batch"))


@query("select doc_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style|noscript)\\b.*?</(script|style|noscript)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) as plain from documents where text is not null")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.html_to_text(F.col("text")).alias("plain"))


@query("""with p as (select id, any_value(list_transform(string_split_regex(regexp_replace(trim(question), '\\?+$', ''), '(?i)\\s+and\\s+'), lambda x: trim(x))) as p, any_value(trim(question)) as q from experiment_samples group by id)
select id, case when len(p) between 2 and 3 and len(list_filter(p, lambda x: length(x) < 8)) = 0 then len(p) else 1 end::int as parts from p""")
def sub_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "experiment_samples").select("id", F.size(T.sub_questions(F.col("question"))).alias("parts"))
    return rows.groupBy("id").agg(F.first("parts").alias("parts"))
