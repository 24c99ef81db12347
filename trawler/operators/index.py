"""The inverted index as ordinary tables: postings, lexicon, document lengths and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from trawler.functions import text as T
from trawler.session import Scratch


def analyze(corpus: DataFrame, text: str = "content", id_col: str = "doc_id", stem: bool = False) -> DataFrame:
    """(doc_id, terms) of every document; documents without a term keep an empty list."""
    out = corpus.select(F.col(id_col).alias("doc_id"), T.analyzed(F.col(text)).alias("terms"))
    return T.stemmed(out) if stem else out


def assign_doc_ids(corpus: DataFrame, id_col: str = "id", scratch: Scratch | None = None) -> DataFrame:
    """corpus with internal_id, dense from 0 in the order of id_col.

    Rows are range-partitioned, sorted and written once; each is numbered by its place in its part,
    after the counts of the parts before it. Only those counts, one for each part, meet in one task."""
    scratch = scratch or Scratch(corpus.sparkSession, "ids")
    parts = corpus.repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("_at", F.monotonically_increasing_id())
    parts = scratch.keep(parts).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(2**33 - 1)
    return parts.join(counts, "_part").withColumn("internal_id", F.col("_before") + inside).drop("_part", "_at", "_before")


def term_freq(analyzed: DataFrame) -> DataFrame:
    """(term, doc_id, tf)."""
    return analyzed.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))


def counted(terms: DataFrame) -> DataFrame:
    """(term, doc_id, tf) from (doc_id, term) rows."""
    return terms.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))


def summed_length(ids: DataFrame, postings: DataFrame) -> DataFrame:
    """(doc_id, length) of all ids as the sum of their frequencies, so that texts are analysed once."""
    sums = postings.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("length"))
    return ids.join(sums, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0)).alias("length"))


def doc_length(analyzed: DataFrame) -> DataFrame:
    """(doc_id, length): terms with repetition; 0 for documents without a term, which count all the same."""
    return analyzed.select("doc_id", F.size("terms").alias("length"))


def merge_postings(blocks: DataFrame) -> DataFrame:
    """Postings of several partial indexes as one: frequencies of the same term and document are added."""
    return blocks.groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))


def lexicon(postings: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def inverted_lists(postings: DataFrame) -> DataFrame:
    """(term, list): the documents of each term, ascending, with their frequencies."""
    return postings.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("list"))


def doc_stats(lengths: DataFrame) -> DataFrame:
    """(n_docs, avgdl), avgdl 0 without documents."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def index_stats(lex: DataFrame) -> DataFrame:
    """(number_of_lists, average_list_size): two decimals, 0 without lists."""
    n = F.count("*")
    return lex.agg(n.alias("number_of_lists"), F.round(F.coalesce(F.sum("df") / n, F.lit(0.0)), 2).alias("average_list_size"))


def postings_lookup(postings: DataFrame, terms: list[str]) -> DataFrame:
    """The lists of a few terms; on a stored index the filter reaches the scan, whose row groups are sorted by term."""
    return postings.where(F.col("term").isin(terms))


def postings_of(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lists of any number of terms, given as a table."""
    return postings.join(wanted.select("term").distinct(), "term", "left_semi")


def lexicon_df(wanted: DataFrame, lex: DataFrame) -> DataFrame:
    """(term, df) of wanted terms, df 0 for unknown ones."""
    return wanted.join(lex.select("term", "df"), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


@dataclass
class Index:
    """The tables that ranking reads."""

    postings: DataFrame
    lexicon: DataFrame
    lengths: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, corpus: DataFrame, text: str = "content", id_col: str = "doc_id", stem: bool = False) -> Index:
        if stem:
            terms = analyze(corpus, text, id_col, stem)
            postings, lengths = term_freq(terms), doc_length(terms)
        else:
            corpus = corpus.withColumnRenamed(id_col, "doc_id")
            postings = counted(T.exploded(corpus, F.col(text), "doc_id"))
            lengths = summed_length(corpus.select("doc_id"), postings)
        return cls(postings, lexicon(postings), lengths, doc_stats(lengths))

    @classmethod
    def of(cls, postings: DataFrame, lengths: DataFrame) -> Index:
        return cls(postings, lexicon(postings), lengths, doc_stats(lengths))

    def persist(self) -> Index:
        """Keep the tables for several batches of queries; lost blocks are computed again."""
        for frame in (self.postings, self.lexicon, self.lengths, self.stats):
            frame.persist()
        return self

    def save(self, path: str) -> None:
        """Write the index; postings are range-partitioned and sorted by term, so a lookup prunes files and row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lexicon.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lexicon", "lengths", "stats")))
