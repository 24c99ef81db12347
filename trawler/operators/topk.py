"""Top-k per query as a window whose limit reaches below the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Decimals to which scores are compared, so that the order of summation cannot flip a tie.
DECIMALS = 6


def rounded(value: Column, decimals: int = DECIMALS) -> Column:
    """value to a number of decimals, half up, in plain double arithmetic."""
    return F.floor(value * float(10**decimals) + 0.5) / float(10**decimals)


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, value: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank from 1: value descending, then tie ascending."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy(*(by or ["qid"])).orderBy(rounded(F.col(value)).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(predicted: DataFrame, k: int = 100, prediction: str = "prediction", second: str = "f_bm25") -> DataFrame:
    """The k best of each query by prediction, then by the second score, then by document."""
    order = Window.partitionBy("qid").orderBy(rounded(F.col(prediction)).desc(), rounded(F.col(second)).desc(), F.col("doc_id").asc())
    return predicted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
