"""Writers of results, runs, flat contents, feature tables and index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def results_json(queries: DataFrame, run: DataFrame) -> DataFrame:
    """(value): one JSON object for each query, {"Query", "Results": [{"ID", "Score"}]}, scores to four decimals; queries without matches have an empty list."""
    rows = run.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(F.col("doc_id").alias("ID"), F.round("score", 4).alias("Score")).alias("r")))).alias("all"))
    listed = queries.join(rows, "qid", "left").withColumn("Results", F.transform(F.coalesce("all", F.array().cast(rows.schema["all"].dataType)), lambda x: x["r"]))
    return listed.select("qid", F.to_json(F.struct(F.col("qtext").alias("Query"), "Results")).alias("value"))


def write_results(queries: DataFrame, run: DataFrame, path: str) -> None:
    results_json(queries, run).orderBy("qid").select("value").write.mode("overwrite").text(path)


def write_run(run: DataFrame, path: str) -> None:
    """CSV QueryId,EntityId in ranking order; a run is k rows for each query, so one file holds it."""
    rows = run.select(F.col("qid").alias("QueryId"), F.col("doc_id").alias("EntityId"), "rank")
    rows.coalesce(1).sortWithinPartitions("QueryId", "rank").drop("rank").write.mode("overwrite").csv(path, header=True)


def write_contents(contents: DataFrame, path: str) -> None:
    """JSON lines {"id", "contents"}; records without contents are left out."""
    contents.where("contents <> ''").select("id", "contents").write.mode("overwrite").json(path)


def write_features(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def write_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """Vectors as Parquet, with one row about them beside."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = vectors.agg(F.count("*").alias("count"), F.max(F.size("vec")).alias("dim")).withColumn("model", F.lit(model))
    meta.write.mode("overwrite").json(f"{path}/meta")


def write_index_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, in any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def write_candidates(run: DataFrame, path: str) -> None:
    """CSV qid,doc_id,dense_rank,dense_score of a dense run."""
    run.select("qid", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score")).write.mode("overwrite").csv(path, header=True)
