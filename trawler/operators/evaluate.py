"""Evaluation of runs: nDCG, recall, paired comparison, folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _gain(rel: str, rank: str) -> Column:
    return F.col(rel) / F.log2(F.col(rank) + 1.0)


def ndcg_per_query(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """(qid, ndcg): linear gain over log2(rank + 1); the ideal is over all judged documents, cut at k. A
    query that the run lacks gets 0; a document that a run repeats counts again."""
    judged = qrels.where("rel > 0")
    found = run.where(F.col("rank") <= k).join(judged, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(_gain("rel", "rank")).alias("dcg"))
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    ideal = judged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("qid").agg(F.sum(_gain("rel", "place")).alias("idcg"))
    return ideal.join(found, "qid", "left").select("qid", F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"))


def ndcg_mean(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """(n_queries, ndcg) over the queries that have judgements."""
    return ndcg_per_query(run, qrels, k).agg(F.count("*").alias("n_queries"), F.avg("ndcg").alias("ndcg"))


def compare_runs(run: DataFrame, baseline: DataFrame, qrels: DataFrame, k: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """(n, mean_delta, t, wins, ties, losses) of run against baseline, paired by query; t is null where the deltas do not vary."""
    a, b = ndcg_per_query(run, qrels, k), ndcg_per_query(baseline, qrels, k).withColumnRenamed("ndcg", "base")
    d = a.join(b, "qid").withColumn("d", F.col("ndcg") - F.col("base"))
    error = F.sqrt(F.var_samp("d") / F.count("*"))
    return d.agg(
        F.count("*").alias("n"),
        F.avg("d").alias("mean_delta"),
        F.when(error > 0, F.avg("d") / error).alias("t"),
        F.count(F.when(F.col("d") > tolerance, 1)).alias("wins"),
        F.count(F.when(F.abs("d") <= tolerance, 1)).alias("ties"),
        F.count(F.when(F.col("d") < -tolerance, 1)).alias("losses"),
    )


def recall_by_pool(pools: dict[str, DataFrame], qrels: DataFrame) -> DataFrame:
    """(pool, mean_recall, median_recall, mean_size): over the queries with a relevant document."""
    positives = qrels.where("rel > 0").select("qid", "doc_id")
    wanted = positives.groupBy("qid").agg(F.count("*").alias("wanted"))
    out = None
    for name, pool in pools.items():
        size = pool.select("qid", "doc_id").distinct()
        got = size.join(positives, ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("got"))
        sizes = size.groupBy("qid").agg(F.count("*").alias("size"))
        each = wanted.join(got, "qid", "left").join(sizes, "qid", "left").select(
            (F.coalesce("got", F.lit(0)) / F.col("wanted")).alias("recall"), F.coalesce("size", F.lit(0)).alias("size")
        )
        row = each.agg(F.avg("recall").alias("mean_recall"), F.percentile("recall", 0.5).alias("median_recall"), F.avg("size").alias("mean_size"))
        row = row.select(F.lit(name).alias("pool"), "mean_recall", "median_recall", "mean_size")
        out = row if out is None else out.unionByName(row)
    return out


def folds(qids: list[str], k: int, seed: int = 42) -> dict[str, int]:
    """The fold of each query: sorted, shuffled by seed, dealt round robin."""
    order = sorted(qids)
    np.random.RandomState(seed).shuffle(order)
    return {qid: i % k for i, qid in enumerate(order)}


def validation_split(qids: list[str], fraction: float = 0.2, seed: int = 42) -> dict[str, bool]:
    """Whether each query is for validation: at least one, whole queries only."""
    order = sorted(qids)
    np.random.RandomState(seed).shuffle(order)
    n = max(1, int(len(order) * fraction))
    return {qid: i < n for i, qid in enumerate(order)}
