"""Readers of corpora, queries, judgements, runs, feature tables and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How keywords are read: by the index builder, or by converters that keep a bare string.
KEYWORD_RULES = ("index", "convert")


def parse_corpus(lines: DataFrame, value: str = "value", keywords: str = "index", max_docs: int = 0) -> DataFrame:
    """(id, title, text, keywords) of JSON lines.

    Lines that are no JSON object, or lack an id, are skipped; blank lines are not lines. The id is
    cast to text. Under `index`, keywords that are no list become an empty list; under `convert`, ids
    are trimmed and must not be empty, a bare string is kept as the one keyword, and empty ones go."""
    line = F.trim(F.col(value))
    get = lambda name: F.get_json_object(line, f"$.{name}")
    raw = get("keywords")
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    if keywords == "convert":
        bare = F.when(raw.isNotNull() & ~raw.startswith("["), F.array(raw))
        words = F.filter(F.coalesce(listed, bare, F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != ""))
        key = F.trim(get("id"))
        fine = key.isNotNull() & (key != "")
    else:
        words = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda k: F.coalesce(k, F.lit("None")))
        key = get("id")
        fine = key.isNotNull()
    rows = lines.where(line != "").select(
        line.startswith("{").alias("_object"), key.alias("id"), F.coalesce(get("title"), F.lit("")).alias("title"), F.coalesce(get("text"), F.lit("")).alias("text"),
        words.alias("keywords"), fine.alias("_fine"),
    )
    out = rows.where("_object and _fine").drop("_object", "_fine")
    return out.limit(max_docs) if max_docs else out


def corpus_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """(docs_read, docs_skipped) of JSON lines."""
    read = parse_corpus(lines, value).agg(F.count("*").alias("docs_read"))
    return lines.where(F.trim(F.col(value)) != "").agg(F.count("*").alias("n")).join(F.broadcast(read)).select("docs_read", (F.col("n") - F.col("docs_read")).alias("docs_skipped"))


def read_corpus(spark: SparkSession, path: str, **rules) -> DataFrame:
    return parse_corpus(spark.read.text(path), **rules)


def read_query_lines(spark: SparkSession, path: str) -> DataFrame:
    """(query): one for each line that is not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")


def read_queries(spark: SparkSession, path: str, keep_empty_text: bool = False) -> DataFrame:
    """(qid, qtext) of a CSV with a header; short rows and rows without id or text are dropped, other columns ignored."""
    rows = spark.read.csv(path, header=True, schema="qid string, qtext string", multiLine=True, escape='"', enforceSchema=True)
    rows = rows.select(F.trim("qid").alias("qid"), F.trim("qtext").alias("qtext")).where("qid <> ''")
    return rows.select("qid", F.coalesce("qtext", F.lit("")).alias("qtext")) if keep_empty_text else rows.where("qtext <> ''")


def read_qrels(spark: SparkSession, path: str, positive_only: bool = True) -> DataFrame:
    """(qid, doc_id, rel): rows without an integer are dropped, and unless asked otherwise those of 0 and less; the last of duplicates stays."""
    rows = _in_order(spark.read.csv(path, header=True, schema="qid string, doc_id string, rel string", enforceSchema=True))
    rows = rows.withColumn("rel", F.expr("try_cast(trim(rel) AS int)")).where("rel is not null and qid is not null and doc_id is not null")
    out = rows.groupBy("qid", "doc_id").agg(F.max_by("rel", "_at").alias("rel"))
    return out.where("rel > 0") if positive_only else out


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with _at, their place: by the name of their file, then by where their block begins, then inside it. Row ids
    alone would follow the order in which files are dealt to tasks, which goes by size."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("_at", place)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rank): the order of the lines is the ranking, over several files by their names; repeated documents stay."""
    rows = _in_order(spark.read.csv(path, header=True, schema="qid string, doc_id string", enforceSchema=True))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_at"))).select("qid", "doc_id", "rank")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table with its f_ columns as doubles, in the header's order."""
    rows = spark.read.csv(path, header=True)
    kinds = {"relevance": "int", "is_pool": "int"}
    return rows.select(*(F.col(c).cast("double" if c.startswith("f_") else kinds.get(c, "string")).alias(c) for c in rows.columns))


def read_dense_candidates(spark: SparkSession, path: str, topk: int) -> DataFrame:
    """(qid, doc_id, dense_rank, dense_score) down to a rank."""
    rows = spark.read.csv(path, header=True, schema="qid string, doc_id string, dense_rank int, dense_score double", enforceSchema=True)
    return rows.where(F.col("dense_rank") <= topk)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, vec) of a Parquet table of vectors."""
    return spark.read.parquet(path)


def distinct_ids(*frames: DataFrame, col: str = "doc_id") -> DataFrame:
    """The distinct values of a column over several tables."""
    out = frames[0].select(col)
    for other in frames[1:]:
        out = out.union(other.select(col))
    return out.where(F.col(col).isNotNull()).distinct()


def lookup_fields(corpus: DataFrame, ids: DataFrame, col: str = "doc_id") -> DataFrame:
    """The records of wanted ids; of repeated records the first by text."""
    wanted = corpus.join(ids.select(col).distinct(), col, "left_semi")
    place = F.row_number().over(Window.partitionBy(col).orderBy("title", "text"))
    return wanted.withColumn("_n", place).where("_n = 1").drop("_n")


def stored_fields(pairs: DataFrame, corpus: DataFrame, col: str = "doc_id") -> DataFrame:
    """pairs with title, text and keywords of their documents, empty where a document is missing."""
    out = pairs.join(corpus.select(col, "title", "text", "keywords"), col, "left")
    return out.withColumns({"title": F.coalesce("title", F.lit("")), "text": F.coalesce("text", F.lit("")), "keywords": F.coalesce("keywords", F.array().cast("array<string>"))})
