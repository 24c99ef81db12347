"""The queries of the training-text operators: op<N>_<name>, and the pipeline's plain SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawler.llm.spotsigs import as_string, fingerprint_documents, length_partition, likeness

    out = fingerprint_documents(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string("sigs").alias("fingerprint"),
        as_string("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"),
        likeness("sigs", "next_sigs").alias("near_next"),
        length_partition(F.size("sigs"), 0.8).alias("length_partition"),
    )


def op2_kdtree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawler.llm.kdtree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=5, query_step=50)


def op3_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawler.llm.sharding import shard_documents

    out = shard_documents(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trawler.llm.bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def held_out(doc_id: str):
    """Whether a row is kept from learning: crc32 of its doc_id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawler.llm import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id")))
    out = toxicity.score(docs, model)
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("hits").alias("n_hits")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trawler.llm.tokens import token_counts

    out = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawler.llm.linededup import drop_repeats

    out = drop_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawler.llm import secrets

    docs = _table(spark, sf_dir, "documents")
    out = secrets.scan(docs, secrets.fit(docs))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawler.llm.simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawler.llm.mixing import mix

    out = mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


QUERIES = {
    f.__name__: f
    for f in (
        op1_spotsigs, op2_kdtree_top5, op3_lpt_shards, op4_bpe_round_trip, op5_toxicity,
        op6_token_counts, op7_line_dedup, op8_secret_spans, op9_simhash_groups, op10_pivotal_mix,
    )
}


def _oracle() -> dict[str, str]:
    from trawler.llm.linededup import ORACLE

    return {"op2_kdtree_top5": TOP5, "op7_line_dedup": ORACLE}


#: Exact search by plain comparison of each query with every row.
TOP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = _oracle()
