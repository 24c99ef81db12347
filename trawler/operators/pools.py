"""Candidate pools: unions of retrievers' results, labels, negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pool(run: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id) of a ranked run down to rank k."""
    return run.where(F.col("rank") <= k).select("qid", "doc_id")


def union(*pools: DataFrame) -> DataFrame:
    """(qid, doc_id) in any of the pools, once."""
    out = pools[0].select("qid", "doc_id")
    for other in pools[1:]:
        out = out.unionByName(other.select("qid", "doc_id"))
    return out.distinct()


def with_labels(candidates: DataFrame, qrels: DataFrame, positives: bool = True) -> DataFrame:
    """(qid, doc_id, relevance, is_pool): pool members, and for training the judged documents beside them."""
    rows = candidates.select("qid", "doc_id", F.lit(1).alias("is_pool"))
    if positives:
        rows = rows.unionByName(qrels.select("qid", "doc_id", F.lit(0).alias("is_pool")))
    rows = rows.groupBy("qid", "doc_id").agg(F.max("is_pool").alias("is_pool"))
    return rows.join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left").select(
        "qid", "doc_id", F.coalesce("rel", F.lit(0)).alias("relevance"), "is_pool"
    )


def hard_negatives(run: DataFrame, qrels: DataFrame, first: int, last: int) -> DataFrame:
    """(qid, doc_id, rank) of a run between two ranks that are not judged relevant."""
    relevant = qrels.where("rel > 0").select("qid", "doc_id")
    return run.where(F.col("rank").between(first, last)).join(relevant, ["qid", "doc_id"], "left_anti").select("qid", "doc_id", "rank")


def random_negatives(queries: DataFrame, docs: DataFrame, exclude: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(qid, doc_id): about n documents drawn for each query, none of them excluded.

    Documents and queries meet on hash buckets, not as all pairs: each query draws its buckets by
    hash, and a bucket holds one document on average."""
    buckets = max(1, docs.count())
    dealt = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).alias("bucket"))
    draws = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(4 * n))).alias("draw"))
    draws = draws.withColumn("bucket", F.pmod(F.xxhash64("qid", "draw", F.lit(seed)), F.lit(buckets)))
    found = draws.join(dealt, "bucket").groupBy("qid", "doc_id").agg(F.min("draw").alias("draw")).join(exclude.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("draw", "doc_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("qid", "doc_id")
