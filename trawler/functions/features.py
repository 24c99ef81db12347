"""Features of (query, document) pairs as column expressions; every row is computed on its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The feature columns in the order that training and prediction share.
FEATURE_ORDER = (
    "f_bm25", "f_field_weights", "f_rm3", "f_bm25_norm", "f_fw_norm", "f_rm3_norm", "f_bm25_rank", "f_query_length", "f_mean_df",
    "f_doc_length", "f_title_overlap", "f_keyword_match", "f_title_jaccard", "f_title_bigram_overlap", "f_title_match_pos", "f_query_coverage",
)
HYBRID_ORDER = (*FEATURE_ORDER, "f_dense_sim", "f_dense_rrank")

#: Rank of a document that a retriever did not return in its first 1000.
MISSING_RANK = 1001


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def title_overlap(q: Column, title: Column) -> Column:
    """Share of the query's words, repeats included, that the title holds."""
    return ratio(F.size(F.filter(q, lambda x: F.array_contains(title, x))), F.size(q))


def keyword_match(q: Column, keywords: Column) -> Column:
    """Number of the query's words that occur anywhere inside the lower-cased keyword string."""
    return F.size(F.filter(q, lambda x: F.contains(keywords, x))).cast("double")


def title_jaccard(q: Column, title: Column) -> Column:
    return ratio(F.size(F.array_intersect(q, title)), F.size(F.array_union(q, title)))


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbours, joined by a space."""
    n = F.size(tokens)
    pairs = F.transform(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit(" "), F.get(tokens, i + 1)))
    return F.array_distinct(pairs)


def title_bigram_overlap(q: Column, title: Column) -> Column:
    mine = bigrams(q)
    return ratio(F.size(F.array_intersect(mine, bigrams(title))), F.size(mine))


def title_match_pos(q: Column, title: Column) -> Column:
    """Place of the first title word that the query holds, by the title's length; 1 if there is none."""
    at = F.array_position(F.transform(title, lambda t: F.array_contains(q, t)), True)
    return F.when(at > 0, (at - 1) / F.size(title)).otherwise(F.lit(1.0))


def query_coverage(q: Column, words: Column) -> Column:
    """Share of the distinct query words among a document's words."""
    mine = F.array_distinct(q)
    return ratio(F.size(F.array_intersect(mine, words)), F.size(mine))


def title_exact_match(q: Column, title_text: Column) -> Column:
    """1 if any query word occurs anywhere inside the title."""
    return F.exists(q, lambda x: F.contains(F.lower(title_text), x)).cast("double")


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; 0 where a side is missing."""
    zipped = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
