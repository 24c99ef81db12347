"""The corpus pipeline: toxic documents go, repeated passages go, one document of each near-duplicate
group stays, sources are mixed to target weights, and the result is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as
Parquet in the shared folder and rereads it as the next one's docs. Stages accept any columns beside
doc_id, text, source and n_chars, whatever their names, and all but the last hand them on as they are.
An empty table goes through every stage and gives an empty table. A null text is kept as null up to the
last stage, where it has no tokens; very long texts are worked on whole. What a stage does with
null ids, repeated rows and ties is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawler.llm import bpe, linededup, mixing, simhash, toxicity
from trawler.llm.common import free
from trawler.llm.queries import held_out
from trawler.session import Scratch, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half; it learns from the labels that op5 learns from.

    Equal texts get equal scores, so repeated rows stay or go together; null and empty texts have the score of a text
    without hits and stay; a null doc_id changes nothing. Labels of a doc_id that has several count as toxic if any is.
    """
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of 50 words and more of whole lines that an earlier place holds.

    Earlier is the smaller doc_id, then, where rows share it, the smaller hash of the text, then the line. Rows equal in
    doc_id and text stand at one place and lose the same lines; a row without doc_id is neither changed nor an
    earlier place. Null and empty texts stay as they are; a text may become empty.
    """
    ship_package(spark)
    # the operator's own two columns are not the documents', even if a document table has some of that name
    lines, removed = free(docs, "own_lines", "own_removed")
    renamed = {"_lines": lines, "_removed": removed}
    cleaned = linededup.drop_repeats(docs.withColumnsRenamed(renamed)).drop("_lines", "_removed").withColumnsRenamed({v: k for k, v in renamed.items()})
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of near copies; of rows equal in doc_id and text, one.

    Texts are alike by a Jaccard likeness of 0.8 and more over five-word shingles. Rows are told apart by doc_id and text
    hash; a row without a doc_id stays only where its component has none with one. Texts of no words, null ones
    included, are copies of each other.
    """
    ship_package(spark)
    scratch = Scratch(spark, "pipeline-simhash")
    marked = scratch.keep(simhash.near_copies(docs, scratch=scratch).groupBy("doc_id", "twin", "component").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "twin")
    first = scratch.keep(marked.groupBy("component").agg(F.min(order).alias("first")))
    groups = scratch.keep(marked.join(first, "component").select("doc_id", "twin", "n", (order == F.col("first")).alias("stays")))
    (own,) = free(docs, "own_twin")
    rows = docs.withColumn(own, F.xxhash64("text"))

    def chosen(part: DataFrame, how: str) -> DataFrame:
        return rows.join(part, rows["doc_id"].eqNullSafe(part["doc_id"]) & (rows[own] == part["twin"]), how)

    away = groups.where("not stays or n > 1").select("doc_id", "twin")
    again = groups.where("stays and n > 1").select("doc_id", "twin")
    return chosen(away, "left_anti").unionByName(chosen(again, "left_semi").dropDuplicates(["doc_id", own])).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most.

    Rows equal in doc_id, source and text are decided one by one, and their copies add up. Documents without words, null
    texts included, weigh nothing in their source's target; null sources form one source. Reruns agree.
    """
    ship_package(spark)
    taken = mixing.mix(docs)
    # rows equal in doc_id, source and text are decided one by one, but any of them can stand for all:
    # their copies add up, and one row of them is kept to be repeated that often
    taken = taken.groupBy("doc_id", "source", "twin").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    own, copies, n, copy = free(docs, "own_twin", "own_copies", "own_n", "own_copy")
    rows = docs.withColumn(own, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(taken["doc_id"]) & rows["source"].eqNullSafe(taken["source"]) & (rows[own] == taken["twin"])
    joined = rows.join(taken, same).select(*(rows[c] for c in docs.columns), taken["copies"].alias(copies), taken["n"].alias(n), own)
    once = joined.where(F.col(n) == 1).unionByName(joined.where(F.col(n) > 1).dropDuplicates(["doc_id", "source", own]))
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, digested, and the digest of what they decode to. A null text counts as an empty one; repeated
    rows, which the mix makes, give equal results, one for each."""
    import public_tokenizers

    ship_package(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores, near copies and rounding by random numbers are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
