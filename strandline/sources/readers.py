"""Sources: Parquet under alias columns, JSON lines, CSV, text trees, corpus JSON, tagged chunks, graph JSON, indexes.

Every reader gives a DataFrame; nothing is collected but the names of files and columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: names under which a column may be found ---------------------------
ENTITY_ALIASES = {"id": ("id", "entity_id"), "name": ("name", "title", "entity_name"), "type": ("type", "entity_type"), "description": ("description", "summary"), "source_id": ("source_id", "text_unit_id", "chunk_id")}
EDGE_ALIASES = {"src": ("source", "src", "src_id"), "dst": ("target", "dst", "tgt_id"), "weight": ("weight", "strength"), "description": ("description", "summary")}
TEXT_UNIT_ALIASES = {"id": ("id", "chunk_id", "text_unit_id"), "text": ("text", "content", "chunk"), "doc_id": ("doc_id", "document_id", "source_id"), "n_tokens": ("n_tokens", "tokens", "token_count")}
COMMUNITY_ALIASES = {"id": ("id", "community_id", "community"), "level": ("level",), "title": ("title", "name"), "parent": ("parent", "parent_id")}
REPORT_ALIASES = {"id": ("id", "community_id", "community"), "title": ("title",), "summary": ("summary", "full_content", "content"), "rank": ("rank", "rating")}
CLAIM_ALIASES = {"id": ("id", "claim_id"), "subject": ("subject", "subject_id"), "object": ("object", "object_id"), "type": ("type", "claim_type"), "status": ("status", "claim_status"), "description": ("description",), "source_id": ("source_id", "text_unit_id")}
COVARIATE_ALIASES = {"id": ("id", "covariate_id"), "subject": ("subject", "subject_id"), "type": ("covariate_type", "type"), "attributes": ("attributes", "description")}
VECTOR_ALIASES = {"id": ("id", "chunk_id", "entity_id"), "vector": ("vector", "embedding", "values")}
EXAMPLE_ALIASES = {"question": ("question", "query", "user_input"), "reference": ("ground_truth", "groundTruth", "answer", "reference")}
INDEX_MARKERS = ("entities.parquet", "relationships.parquet", "text_units.parquet", "communities.parquet")
SAMPLE_SCHEMA = (
    "id string, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question string, answer string, "
    "answer_aliases array<string>, question_decomposition array<string>, answerable boolean, metadata string"
)
CAUSAL_CSV = "e1 string, e2 string, paragraph string, answer string, category string"
GRAPH_SCHEMA = "array<struct<start_node:struct<label:string,properties:map<string,string>>,relation:string,end_node:struct<label:string,properties:map<string,string>>>>"
# ---------------------------------------------------------------------------------------


def with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns under canonical names: the first candidate that exists, null where none does."""
    have = set(df.columns)
    return df.select(*[next((F.col(c) for c in names if c in have), F.lit(None).cast("string")).alias(to) for to, names in aliases.items()])


def entities(spark: SparkSession, path: str) -> DataFrame:
    return with_aliases(spark.read.parquet(path), ENTITY_ALIASES)


def relationships(spark: SparkSession, path: str) -> DataFrame:
    return with_aliases(spark.read.parquet(path), EDGE_ALIASES)


def text_units(spark: SparkSession, path: str) -> DataFrame:
    return with_aliases(spark.read.parquet(path), TEXT_UNIT_ALIASES)


def communities(spark: SparkSession, path: str) -> DataFrame:
    return with_aliases(spark.read.parquet(path), COMMUNITY_ALIASES)


def community_reports(spark: SparkSession, path: str) -> DataFrame:
    return with_aliases(spark.read.parquet(path), REPORT_ALIASES)


def claims(spark: SparkSession, path: str) -> DataFrame:
    return with_aliases(spark.read.parquet(path), CLAIM_ALIASES)


def covariates(spark: SparkSession, path: str) -> DataFrame:
    return with_aliases(spark.read.parquet(path), COVARIATE_ALIASES)


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    return with_aliases(spark.read.parquet(path), VECTOR_ALIASES)


def evaluation_examples(spark: SparkSession, path: str) -> DataFrame:
    """(question, reference) of a JSON list of examples; those without a question are left out."""
    return with_aliases(spark.read.json(path, multiLine=True), EXAMPLE_ALIASES).where("trim(question) <> ''")


def index_directories(spark: SparkSession, root: str, depth: int = 2) -> list[str]:
    """Directories below ``root`` that hold one of the marker files."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def walk(p, left: int) -> Iterator[str]:
        if not fs.exists(p):
            return
        if any(fs.exists(hadoop.Path(p, m)) for m in INDEX_MARKERS):
            yield p.toString()
        elif left:
            for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().toString()):
                if s.isDirectory():
                    yield from walk(s.getPath(), left - 1)

    return list(walk(path, depth))


def samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Experiment samples of a JSON-lines file; malformed lines and unanswerable rows are left out."""
    rows = spark.read.schema(SAMPLE_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("coalesce(answerable, true)")
    return rows if limit is None else rows.limit(limit)


def results(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Result rows of many JSON-lines files; numbers that are not finite become null."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("allowNonNumericNumbers", True).json(glob)
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in doubles})


def causal_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless causal rows; blank rows are left out and entity tags stripped."""
    df = spark.read.schema(CAUSAL_CSV).option("multiLine", True).option("escape", '"').csv(path)
    return df.where("trim(concat_ws('', e1, e2, paragraph)) <> ''").withColumn("paragraph", F.regexp_replace("paragraph", "</?e[12]>", ""))


def first_filled(*columns: str):
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns])


def question_csv(spark: SparkSession, paths: str | list[str], question: Sequence[str], answer: Sequence[str], context: Sequence[str]) -> DataFrame:
    """Question files with fallback columns; rows that lack a part are left out."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    have = set(df.columns)
    cols = {n: [c for c in names if c in have] for n, names in (("question", question), ("answer", answer), ("context", context))}
    made = df.select(*[(first_filled(*c) if c else F.lit(None).cast("string")).alias(n) for n, c in cols.items()], F.col("_metadata.file_name").alias("file"))
    return made.dropna(subset=["question", "answer", "context"])


def csv_dataset(spark: SparkSession, path: str) -> DataFrame:
    """All values as strings; short rows are filled up with ''."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")


def jsonl_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a directory as a document."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents (file, ord, title, text) of JSON files whose root is an array, an object or a string."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("v"))
    items = F.from_json(F.col("v"), "array<string>")
    one = F.when(F.col("v").startswith("["), items).otherwise(F.array("v"))
    rows = raw.select("file", F.posexplode(one).alias("ord", "x"))
    is_object = F.col("x").startswith("{")
    title = F.when(is_object, F.get_json_object("x", "$.title"))
    text = F.when(is_object, F.coalesce(F.get_json_object("x", "$.text"), F.get_json_object("x", "$.content"))).otherwise(F.regexp_replace("x", '^"|"$', ""))
    return rows.select("file", "ord", F.coalesce(title, F.concat(F.lit("document_"), F.col("ord"))).alias("title"), text.alias("text"))


def tagged_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of lines ``id: X<tab>Chunk: Y``; the last of a repeated id stays."""
    df = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value").where(F.col("value").startswith("id:"))
    rows = df.select("at", F.trim(F.regexp_extract("value", r"^id:\s*([^\t]*)\t", 1)).alias("id"), F.trim(F.regexp_extract("value", r"\tChunk:\s*(.*)$", 1)).alias("text"))
    return rows.groupBy("id").agg(F.max_by("text", "at").alias("text"))


def graph_json(spark: SparkSession, path: str) -> DataFrame:
    """(src, relation, dst) of files that hold an array of relationships; a node without a name goes by its label."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", GRAPH_SCHEMA)).alias("r"))
    name = lambda n: F.coalesce(F.try_element_at(F.col(f"r.{n}.properties"), F.lit("name")), F.col(f"r.{n}.label"))
    return raw.select(name("start_node").alias("src"), F.col("r.relation").alias("relation"), name("end_node").alias("dst"))


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``text``: a file's bytes by its byte-order mark, else the first encoding that fits."""

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
                if b.startswith(mark):
                    return b.decode(name, "replace")
            for name in ("utf-8", "shift_jis", "euc_jp", "gb18030", "latin-1"):
                try:
                    return b.decode(name)
                except UnicodeDecodeError:
                    continue
            return b.decode("utf-8", "replace")

        return data.map(one)

    return files.withColumn("text", decode(content))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, title, text): text and Markdown files, JSON files of texts; others with kind ``unsupported`` and no text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = decoded(raw).select(F.substring_index("path", "/", -1).alias("file"), "text").withColumn("ext", F.lower(F.substring_index("file", ".", -1)))
    plain = named.where(F.col("ext").isin("txt", "md")).select("file", F.lit("text").alias("kind"), F.col("file").alias("title"), "text")
    items = named.where("ext = 'json'").select("file", F.posexplode_outer(F.from_json("text", "array<string>")).alias("ord", "x"))
    json_ = items.select("file", F.lit("json").alias("kind"), F.concat_ws("#", "file", "ord").alias("title"), F.coalesce(F.get_json_object("x", "$.text"), F.col("x")).alias("text"))
    other = named.where(~F.col("ext").isin("txt", "md", "json")).select("file", F.lit("unsupported").alias("kind"), F.col("file").alias("title"), F.lit(None).cast("string").alias("text"))
    return plain.unionByName(json_).unionByName(other)


def inverted_index_text(index):
    """A text from a column MAP<token, ARRAY<position>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def merged_indexes(parts: Mapping[str, DataFrame], id_col: str, community_col: str | None = None) -> DataFrame:
    """Tables of several indexes in one: ids get the index's name, community ids a running offset; of equal keys the last index's row stays."""
    out, offset = None, 0
    for order, (name, df) in enumerate(parts.items()):
        x = df.withColumn(id_col, F.concat(F.lit(f"{name}:"), F.col(id_col).cast("string"))).withColumn("_order", F.lit(order))
        if community_col:
            top = df.agg(F.max(community_col)).first()[0]
            x = x.withColumn(community_col, F.col(community_col) + offset)
            offset += 0 if top is None else int(top) + 1
        out = x if out is None else out.unionByName(x)
    cols = [c for c in out.columns if c not in (id_col, "_order")]
    best = out.groupBy(id_col).agg(F.max_by(F.struct(*cols), "_order").alias("x"))
    return best.select(id_col, "x.*")
