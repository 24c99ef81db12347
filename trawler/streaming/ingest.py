"""Streaming ingestion: JSON lines arriving in a folder extend an index by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawler.functions import text as T
from trawler.operators.index import Index, analyze, doc_length, doc_stats, lexicon, merge_postings, term_freq
from trawler.sources.readers import parse_corpus


def start_ingest(spark: SparkSession, source: str, index_path: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Append the postings and lengths of new files; a batch that is run again overwrites its own part, so each file counts once."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)

    def add(batch: DataFrame, number: int) -> None:
        docs = parse_corpus(batch).withColumn("content", T.full_content(F.col("title"), F.col("text"), F.col("keywords")))
        terms = analyze(docs, "content", "id").persist()
        try:
            term_freq(terms).write.mode("overwrite").parquet(f"{index_path}/postings/batch={number}")
            doc_length(terms).write.mode("overwrite").parquet(f"{index_path}/lengths/batch={number}")
        finally:
            terms.unpersist()

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_index(spark: SparkSession, index_path: str) -> Index:
    """The index over all batches so far; the lexicon and statistics are always those of all of them."""
    postings = merge_postings(spark.read.parquet(f"{index_path}/postings").drop("batch"))
    lengths = spark.read.parquet(f"{index_path}/lengths").drop("batch")
    return Index(postings, lexicon(postings), lengths, doc_stats(lengths))
