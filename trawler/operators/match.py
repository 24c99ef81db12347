"""Boolean matching of query batches over postings: one equi-join on terms for all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_terms(queries: DataFrame, terms: str = "terms") -> DataFrame:
    """(qid, term): the distinct terms of each query."""
    return queries.select("qid", F.explode(F.array_distinct(terms)).alias("term"))


def term_hits(qterms: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, doc_id, term, tf) of all documents that hold a term; unknown terms have none."""
    return qterms.join(postings, "term").select("qid", "doc_id", "term", "tf")


def match_or(qterms: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, doc_id, matched): documents with at least one term."""
    return term_hits(qterms, postings).groupBy("qid", "doc_id").agg(F.count("*").alias("matched"))


def match_and(qterms: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, doc_id): documents with all terms. An unknown term counts, so such a query matches nothing."""
    wanted = qterms.groupBy("qid").agg(F.count("*").alias("wanted"))
    return match_or(qterms, postings).join(wanted, "qid").where("matched = wanted").select("qid", "doc_id")


def match_stats(qterms: DataFrame, postings: DataFrame, lex: DataFrame) -> DataFrame:
    """(qid, n_terms, known_terms, postings_in_lists, n_or, n_and, early_terminated): early_terminated is
    true where an unknown term settles a conjunctive query at once."""
    per_query = qterms.join(lex.select("term", "df"), "term", "left").groupBy("qid")
    sizes = per_query.agg(F.count("*").alias("n_terms"), F.count("df").alias("known_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings_in_lists"))
    found = match_or(qterms, postings).join(sizes.select("qid", "n_terms"), "qid").groupBy("qid")
    found = found.agg(F.count("*").alias("n_or"), F.count(F.when(F.col("matched") == F.col("n_terms"), 1)).alias("n_and"))
    return sizes.join(found, "qid", "left").select(
        "qid", "n_terms", "known_terms", "postings_in_lists", F.coalesce("n_or", F.lit(0)).alias("n_or"), F.coalesce("n_and", F.lit(0)).alias("n_and"),
        (F.col("known_terms") < F.col("n_terms")).alias("early_terminated"),
    )
