"""Derived texts, filters, traversals and extraction by canned models."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import extraction as X
from ..operators import graph as G
from ..registry import query, table
from .evaluation import _cov, _ct
from .graphs import CAUSAL_SQL, MENTIONS_SQL, SEED, _causal, _mentions
from .judged import CACHE_SQL, _cache

ROWS_SQL = "cr0 as (select id, min(trim(e1)) as e1, min(trim(e2)) as e2, min(row_index) as row_index, min(category) as category from causal_rows where trim(e1) <> '' and trim(e2) <> '' group by id)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "causal_rows").select("id", F.trim("e1").alias("e1"), F.trim("e2").alias("e2"), "row_index", "category").where("e1 <> '' and e2 <> ''")
    return rows.groupBy("id").agg(*[F.min(c).alias(c) for c in ("e1", "e2", "row_index", "category")])


@query(f"with {CACHE_SQL} select args_hash, md5('[' || coalesce(mode, 'null') || ', ' || coalesce(prompt, 'null') || ']') as key from c")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _cache(spark, d).select("args_hash", T.args_key(F.col("mode"), F.col("prompt")).alias("key"))


@query(f"with {CACHE_SQL} select args_hash, 'Mode: ' || coalesce(mode, '') || chr(10) || 'Ask: ' || coalesce(prompt, '') || ' {{left}}' as prompt from c")
def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _cache(spark, d).select("args_hash", T.rendered("Mode: {mode}\nAsk: {prompt} {left}", {"mode": F.col("mode"), "prompt": F.col("prompt")}).alias("prompt"))


@query(f"with {CACHE_SQL}, t as (select args_hash, {_ct('prompt')} as q, {_ct('content')} as a from c where prompt is not null and content is not null) select args_hash, round({_cov('q', 'a')}, 6) as score from t")
def lexical_match_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _cache(spark, d).where("prompt is not null and content is not null")
    return rows.select("args_hash", F.round(T.coverage(T.content_tokens(F.col("prompt")), T.content_tokens(F.col("content"))), 6).alias("score"))


@query("""select id, '{"hops":"' || coalesce(min(hop_count)::varchar, '') || '","overlap":"' || coalesce(min(lower(trim(overlap_bucket))), '') || '","support":"' || coalesce(min(support_count)::varchar, '') || '"}' as json from example_meta group by id""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """A map of arguments as JSON with its keys in order, whatever order they were given in."""
    m = table(spark, d, "example_meta").groupBy("id").agg(F.min("support_count").alias("s"), F.min(F.lower(F.trim("overlap_bucket"))).alias("o"), F.min("hop_count").alias("h"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return m.select("id", T.canonical_json(F.create_map(F.lit("support"), text("s"), F.lit("overlap"), text("o"), F.lit("hops"), text("h"))).alias("json"))


_PHRASES = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(question, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'), lambda r: regexp_replace(r, '^(" + "|".join(T.QUESTION_WORDS) + ") ?', '')), lambda r: r <> '')))"


@query(f"with s as (select id, any_value(question) as question from experiment_samples group by id), t as (select id, question, {_PHRASES} as e, list_sort({_ct('question')}) as k from s where question is not null) select id, question || case when len(e) > 0 then ' Entities: ' || array_to_string(e, ', ') else '' end || case when len(k) > 0 then ' Key terms: ' || array_to_string(k, ', ') else '' end as enhanced from t")
def enhanced_questions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "experiment_samples").groupBy("id").agg(F.first("question").alias("question")).where("question is not null")
    return s.select("id", T.enhanced(F.col("question")).alias("enhanced"))


@query("select id, min(question) as decoded from experiment_samples where question is not null group by id")
def unicode_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose vowels were written as escapes, decoded again."""
    s = table(spark, d, "experiment_samples").where("question is not null").groupBy("id").agg(F.min("question").alias("q"))
    escaped = F.replace(F.replace(F.col("q"), F.lit("e"), F.lit("\\u0065")), F.lit("o"), F.lit("\\u006F"))
    return s.select("id", T.unicode_decoded(escaped).alias("decoded"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"with t as (select doc_id, text, regexp_extract(text, '{T.INTRODUCTION}', 1) as part, {_SENT} as s from documents where text is not null) select doc_id, md5(substr(case when trim(part) <> '' then trim(part) else array_to_string(s[1:4], ' ') end, 1, 2200)) as introduction_hash from t")
def introductions(spark: SparkSession, d: str) -> DataFrame:
    """The part under a heading Introduction up to the next section, else the first four sentences; 2,200 characters at most."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.introduction(F.col("text"))).alias("introduction_hash"))


@query("""with p as (select doc_id, string_split(text, chr(10)) as p from documents where text is not null), x as (select doc_id, unnest(range(0, len(p))) as part, unnest(p) as body from p),
t as (select doc_id, part, list_filter(string_split_regex(trim(body), '\\s+'), lambda w: w <> '') as t from x), w as (select doc_id, part, t, unnest(case when len(t) <= 60 then [0] else range(0, len(t), 50) end) as start from t where len(t) > 0)
select doc_id, row_number() over (partition by doc_id order by part, start)::int - 1 as ord, len(t[start + 1:start + 60])::int as tokens from w""")
def delimiter_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Split at line breaks; parts of over 60 words in windows of 60 that share 10."""
    docs = table(spark, d, "documents").where("text is not null")
    return C.delimited_windows(docs, "doc_id", F.col("text"), "\n", 60, 10).select("doc_id", "ord", "tokens")


@query("select doc_id, (length(text) >= 1800 and length(text) >= 2 * coalesce(length(title), 0))::int as substantial from documents where text is not null")
def substantial_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.is_substantial(F.col("text"), F.col("title")).cast("int").alias("substantial"))


@query(f"with {CAUSAL_SQL}, k as (select src, 'causes' as kind, dst, weight from e union all select dst, 'represented_by', src, weight * 2 from e), r as (select *, row_number() over (partition by src order by weight desc, kind, dst) as rank from k) select src, kind, dst, rank::int as rank from r where rank <= 3 and kind <> 'represented_by'")
def shown_relations(spark: SparkSession, d: str) -> DataFrame:
    """The three heaviest relations of a node, of which one kind is hidden only after they were chosen."""
    e = _causal(spark, d)
    both = e.select("src", F.lit("causes").alias("kind"), "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.lit("represented_by").alias("kind"), F.col("src").alias("dst"), (F.col("weight") * 2).alias("weight")))
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "kind", "dst")
    return both.withColumn("rank", F.row_number().over(w)).where("rank <= 3").where("kind <> 'represented_by'").select("src", "kind", "dst", "rank")


@query(f"with {MENTIONS_SQL}, n as (select name, count(*) as n from u group by 1) select name, n, (name like '%research%')::int as forced from n where not (name like '%university%') and (name like '%research%' or n >= 3)")
def named_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities named often, those to be included whatever their number, and none that is to be excluded."""
    n = _mentions(spark, d).groupBy("name").agg(F.count("*").alias("n"))
    forced = F.contains(F.col("name"), F.lit("research"))
    return n.where(~F.contains(F.col("name"), F.lit("university")) & (forced | (F.col("n") >= 3))).select("name", "n", forced.cast("int").alias("forced"))


@query(f"with {CAUSAL_SQL}, n as (select src as node from e union select dst from e), k as (select node, (contains(node, 'salt') or contains(node, 'soil'))::int as hit from n) select node from k where hit = 1 or (select max(hit) from k) = 0")
def involved_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that hold one of the asked words; all of them if none does."""
    e = _causal(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    hit = F.contains(F.col("node"), F.lit("salt")) | F.contains(F.col("node"), F.lit("soil"))
    found = nodes.where(hit)
    none = found.agg((F.count("*") == 0).alias("none"))  # one row
    return found.unionByName(nodes.where(~hit).crossJoin(F.broadcast(none)).where("none").drop("none"))


@query(f"with {CAUSAL_SQL}, {MENTIONS_SQL}, top as (select src, dst from e where weight >= 2), n as (select src as name from top union select dst from top), mm as (select name, count(*) as mentions from u group by 1) select name, coalesce(mentions, 0) as mentions from n left join mm using (name)")
def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """The ends of edges, each once, with what is known of them as entities."""
    top = _causal(spark, d).where("weight >= 2")
    ends = top.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    m = _mentions(spark, d).groupBy("name").agg(F.count("*").alias("mentions"))
    return ends.join(m, "name", "left").fillna(0, ["mentions"])


@query(f"with {MENTIONS_SQL} select count(*) as mentions, round(sum(length(name)) / count(*), 4) as mean_chars, round(sum(len(list_filter(string_split_regex(trim(name), '\\s+'), lambda w: w <> ''))) / count(*), 4) as mean_words from u")
def extraction_statistics(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return _mentions(spark, d).agg(n.alias("mentions"), F.round(F.sum(F.length("name")) / n, 4).alias("mean_chars"), F.round(F.sum(F.size(T.words(F.col("name")))) / n, 4).alias("mean_words"))


@query(f"with {ROWS_SQL} select id from (select id, row_number() over (order by md5('7|' || id), id) as r from cr0) where r <= 50")
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    """A uniform sample of 50: the least hashes; partitions keep their own 50 and only those are shuffled."""
    return _rows(spark, d).orderBy(F.md5(F.concat(F.lit("7|"), "id")), "id").limit(50).select("id")


@query(f"with {CACHE_SQL}, t as (select mode, len(list_filter(string_split_regex(trim(coalesce(prompt, '')), '\\s+'), lambda w: w <> '')) as p, len(list_filter(string_split_regex(trim(coalesce(content, '')), '\\s+'), lambda w: w <> '')) as k from c) select mode, count(*) as calls, sum(p)::bigint as prompt_tokens, sum(k)::bigint as completion_tokens, round(sum(p) * 0.5 / 1000 + sum(k) * 1.5 / 1000, 6) as cost from t group by 1")
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.size(T.words(F.coalesce(c, F.lit(""))))
    t = _cache(spark, d).select("mode", n(F.col("prompt")).alias("p"), n(F.col("content")).alias("k"))
    return t.groupBy("mode").agg(F.count("*").alias("calls"), F.sum("p").alias("prompt_tokens"), F.sum("k").alias("completion_tokens"), F.round(F.sum("p") * 0.5 / 1000 + F.sum("k") * 1.5 / 1000, 6).alias("cost"))


@query(f"with {CAUSAL_SQL}, n as (select src as node from e union select dst from e), s as (select node, case when node = 'road salt' then 1000 when node like 'road salt%' then 500 when node like '%salt%' then 100 else 0 end as score from n) select node, score, row_number() over (order by score desc, node)::int as rank from s where score > 0 qualify rank <= 10")
def label_search(spark: SparkSession, d: str) -> DataFrame:
    """Labels equal to the words sought, beginning with them, or holding the last of them."""
    e = _causal(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    score = F.when(F.col("node") == "road salt", 1000).when(F.startswith(F.col("node"), F.lit("road salt")), 500).when(F.contains(F.col("node"), F.lit("salt")), 100)
    top = nodes.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "node").limit(10)
    return top.select("node", "score", F.row_number().over(Window.orderBy(F.desc("score"), "node")).alias("rank"))  # ten rows


@query(f"with {CACHE_SQL}, x as (select mode, trim(regexp_replace(prompt, '^[A-Z][a-z ]+[:.] ', '')) as q, args_hash from c where prompt is not null), k as (select mode, lower(q) as k, min(args_hash) as first from x where q <> '' group by 1, 2) select mode, k as question, row_number() over (partition by mode order by first)::int as turn from k qualify turn <= 40")
def follow_up_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 questions waiting in each mode's queue, each once whatever its case and opening words."""
    q = F.trim(F.regexp_replace("prompt", "^[A-Z][a-z ]+[:.] ", ""))
    k = _cache(spark, d).where("prompt is not null").select("mode", q.alias("q"), "args_hash").where("q <> ''").groupBy("mode", F.lower("q").alias("question")).agg(F.min("args_hash").alias("first"))
    return k.withColumn("turn", F.row_number().over(Window.partitionBy("mode").orderBy("first"))).where("turn <= 40").select("mode", "question", "turn")



@query(f"with recursive {CAUSAL_SQL}, w as (select 'insomnia' as node, 0 as hops union select e.src, w.hops + 1 from w join e on e.dst = w.node where w.hops < 2) select node, min(hops)::int as hops from w group by 1")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    """What leads to an effect within two steps."""
    back = _causal(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reachable(back, spark.createDataFrame([("insomnia",)], "node string"), 2).select("node", "hops")


@query(f"with {CAUSAL_SQL}, s as (select src, dst from e where src = 'road salt'), n as (select src as node from s union select dst from s), h as (select distinct e.src, e.dst from e where e.src in (select node from n) or e.dst in (select node from n)) select h.src, h.dst, (h.src = 'road salt')::int as seed from h")
def expanded_triples(spark: SparkSession, d: str) -> DataFrame:
    """Seed triples and those of the pool that share an end with one."""
    e = _causal(spark, d).select("src", "dst")
    return G.expanded(e, e.where("src = 'road salt'"), 1).select("src", "dst", (F.col("src") == "road salt").cast("int").alias("seed"))


@query(f"with {CAUSAL_SQL}, d as (select node, sum(i)::bigint as i, sum(o)::bigint as o from (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by 1), t as (select sum(i + o) as total from d) select node, round((i + o) / total, 9) as rank, i + o as degree from d, t")
def node_features(spark: SparkSession, d: str) -> DataFrame:
    """A node's share of all degrees and its degree, the two numbers that its plain vector alternates between."""
    deg = G.degrees(_causal(spark, d)).select("node", (F.col("indegree") + F.col("outdegree")).alias("degree"))
    total = deg.agg(F.sum("degree").alias("total"))  # one row
    v = deg.crossJoin(F.broadcast(total)).select("node", "degree", G.alternating(F.col("degree") / F.col("total"), F.col("degree"), 8).alias("v"))
    return v.select("node", F.round(F.get("v", 6), 9).alias("rank"), F.get("v", 7).cast("long").alias("degree"))


@query(f"with {CAUSAL_SQL}, k as (select dst as node, src from e where src in ({SEED}) ), z as (select e.dst as node from e join k on e.src = k.node) select node, min(level)::int as level from (select node, 1 as level from k union all select node, 2 from z) group by 1")
def children(spark: SparkSession, d: str) -> DataFrame:
    """Nodes reached over edges of one kind within two levels, with the first."""
    e = _causal(spark, d).withColumn("kind", F.lit("causes"))
    return G.children(e, spark.sql(SEED), "causes", 2)


def canned_triples(prompts: Sequence[str]) -> list[str]:
    """A model that repeats the record it is given: in a fence, bare, or broken."""
    out = []
    for p in prompts:
        kind, _, body = p.partition("|")
        out.append({"0": f"Sure:\n```json\n[{body}]\n```", "1": f"[{body}]", "2": f"[{body}"}[kind])
    return out


@query(f"""with {ROWS_SQL} select id, lower(e1) as cause, lower(e2) as effect, case when row_index % 4 = 0 then 0.7 when row_index % 4 = 1 then 1.0 else round(row_index % 4 / 5.0, 4) end::double as confidence from cr0 where row_index is not null and row_index % 3 <> 2""")
def model_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples read from a model's JSON: fields by any of their names, confidences missing or out of bounds, answers that cannot be read."""
    n = F.col("row_index") % 4
    rest = F.when(n == 1, F.struct(F.col("e1").alias("from"), F.col("e2").alias("to"), F.lit("7.5").alias("confidence")).cast("struct<from:string,to:string,confidence:string>"))
    record = F.when(n == 0, F.to_json(F.struct(F.col("e1").alias("source"), F.col("e2").alias("target")))).when(n == 1, F.to_json(rest))
    record = record.otherwise(F.to_json(F.struct(F.col("e1").alias("cause"), F.col("e2").alias("effect"), (n / 5.0).cast("string").alias("confidence"))))
    rows = _rows(spark, d).where("row_index is not null")
    prompt = F.concat((F.col("row_index") % 3).cast("string"), F.lit("|"), record)
    return X.model_triples(rows, "id", prompt, canned_triples).select("id", "cause", "effect", F.round("confidence", 6).alias("confidence"))


@query(f"with {ROWS_SQL}, r as (select distinct lower(e1) as cause, lower(e2) as effect from cr0 where row_index % 2 = 0), m as (select distinct lower(e1) as cause, lower(e2) as effect from cr0 where row_index % 3 = 0) select cause, effect, 0.8::double as confidence, 'rule' as origin from r union all select cause, effect, 0.7::double, 'model' from m where (cause, effect) not in (select (cause, effect) from r)")
def merged_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples of rules, and those of a model that no rule has."""
    rows = _rows(spark, d).select(F.lower("e1").alias("cause"), F.lower("e2").alias("effect"), "row_index")
    side = lambda n, c: rows.where(F.col("row_index") % n == 0).select("cause", "effect", F.lit(c).alias("confidence"))
    return X.merged_triples(side(2, 0.8), side(3, 0.7))


def canned_entities(prompts: Sequence[str]) -> list[str]:
    out = []
    for p in prompts:
        ask, _, body = p.partition(":")
        a, _, b = body.partition(" -> ")
        if ask == "any left?":
            out.append("Yes" if len(a) % 2 else "no")
        else:
            out.append(json.dumps([{"name": a if ask == "entities" else b, "type": "CAUSE" if ask == "entities" else "EFFECT"}]))
    return out


@query(f"with {ROWS_SQL}, x as (select id, 0 as round, upper(e1) as name, 'CAUSE' as type from cr0 union all select id, 1, upper(e2), 'EFFECT' from cr0 where length(e1) % 2 = 1) select id, name, min(round)::int as round, arg_min(type, round) as type from x group by 1, 2")
def gleaned_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a first answer and of a second where the model says that some are left."""
    return X.gleaned(_rows(spark, d), "id", F.concat("e1", F.lit(" -> "), "e2"), canned_entities).select("id", "name", "round", "type")


@query(f"with {ROWS_SQL} select id, e1 as subject, e2 as object, 'CAUSE' as type, '' as status, 'text' as source_text from cr0")
def model_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims read from a model's JSON, with fields that are missing."""
    said = F.concat(F.lit("["), F.to_json(F.struct(F.col("e1").alias("subject"), F.col("e2").alias("object"), F.lit("CAUSE").alias("type"), F.lit("text").alias("source_text"))), F.lit("]"))
    return X.claims_of(_rows(spark, d), "id", said).select("id", "subject", "object", "type", "status", "source_text")


@query(f"with {MENTIONS_SQL}, k as (select lower(trim(type)) as n, min(trim(type)) as type from u where trim(type) <> '' group by 1) select 'nodes' as kind, type, 0 as added from (values ('Person'), ('Concept')) v(type) union all select 'nodes', type, 1 from k where n not in ('person', 'concept')")
def evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    """A schema of types with those found beside them."""
    schema = spark.createDataFrame([("nodes", "Person"), ("nodes", "Concept")], "kind string, type string")
    return X.evolved(schema, _mentions(spark, d).select(F.lit("nodes").alias("kind"), "type"))


@query("with s as (select id, any_value(paragraphs) as p from experiment_samples group by id) select id, len(p)::int as blocks_rows, md5(array_to_string(list_filter(list_transform(p, lambda x: replace(replace(x.paragraph_text, chr(10), ' '), chr(13), ' ')), lambda x: trim(x) <> ''), '|')) as contexts_hash from s where len(p) > 0")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Passages rendered as a fenced CSV table, read back from it."""
    flat = lambda x: F.regexp_replace(x["paragraph_text"], "[\\n\\r]", " ")
    s = table(spark, d, "experiment_samples").groupBy("id").agg(F.first("paragraphs").alias("p")).where("size(p) > 0")
    lines = F.transform("p", lambda x: F.concat_ws(",", x["idx"].cast("string"), F.concat(F.lit('"'), F.replace(flat(x), F.lit('"'), F.lit('""')), F.lit('"'))))
    text = F.concat(F.lit("-----Sources-----\n```csv\nid,content\n"), F.array_join(lines, "\n"), F.lit("\n```\n"))
    return s.select("id", F.size("p").alias("blocks_rows"), F.md5(F.array_join(T.context_values(text), "|")).alias("contexts_hash"))


@query(f"""with {CACHE_SQL}, k as (select args_hash, mode, prompt, content, {_ct('prompt')} as t, row_number() over (partition by mode, lower(trim(prompt)) order by args_hash) as n from c where prompt is not null),
f as (select mode, lower(trim(prompt)) as p, args_hash as hit from k where n = 1), e as (select k.args_hash, f.hit from k join f on f.mode = k.mode and f.p = lower(trim(k.prompt)))
select args_hash, hit, (args_hash <> hit)::int as again from e""")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """The cached answer that each call would have been given: the first of the same mode and prompt."""
    c = _cache(spark, d).where("prompt is not null").select("args_hash", "mode", F.lower(F.trim("prompt")).alias("p"))
    first = c.groupBy("mode", "p").agg(F.min("args_hash").alias("hit"))
    return c.join(first, ["mode", "p"]).select("args_hash", "hit", (F.col("args_hash") != F.col("hit")).cast("int").alias("again"))


@query(f"""with {CAUSAL_SQL}, d as (select node, sum(k)::bigint as degree from (select src as node, count(*) as k from e group by 1 union all select dst, count(*) from e group by 1) group by 1),
n as (select count(*) as nodes from d), m as (select count(*) as edges, sum(weight) as total from e)
select 'nodes' as what, nodes::double as value from n union all select 'edges', edges::double from m union all select 'density', round(edges / (nodes * (nodes - 1.0)), 9) from n, m union all select 'weight', total from m
union all select 'degree_max', max(degree)::double from d union all select 'degree_mean', round(avg(degree), 9) from d union all select 'pairs_both_ways', count(*)::double from e a join e b on a.src = b.dst and a.dst = b.src
union all select 'top: ' || node, degree::double from (select *, row_number() over (order by degree desc, node) as r from d) where r <= 10""")
def graph_report(spark: SparkSession, d: str) -> DataFrame:
    """Size, density, degrees, two-node cycles and the ten nodes of the highest degree."""
    e = _causal(spark, d)
    deg = G.degrees(e).select("node", (F.col("indegree") + F.col("outdegree")).alias("degree"))
    n = deg.agg(F.count("*").alias("nodes"), F.max("degree").cast("double").alias("most"), F.round(F.avg("degree"), 9).alias("mean"))
    m = e.agg(F.count("*").alias("edges"), F.sum("weight").alias("total"))
    both = e.select("src", "dst").intersect(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).agg(F.count("*").cast("double").alias("both"))
    one = n.crossJoin(m).crossJoin(both)  # three tables of one row
    row = lambda what, value: F.struct(F.lit(what).alias("what"), value.cast("double").alias("value"))
    density = F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)), 9)
    facts = F.array(row("nodes", F.col("nodes")), row("edges", F.col("edges")), row("density", density), row("weight", F.col("total")), row("degree_max", F.col("most")), row("degree_mean", F.col("mean")), row("pairs_both_ways", F.col("both")))
    top = G.popular(e, 10).select(F.concat(F.lit("top: "), "node").alias("what"), F.col("degree").cast("double").alias("value"))
    return one.select(F.explode(facts).alias("x")).select("x.what", "x.value").unionByName(top)
