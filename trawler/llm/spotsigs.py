"""SpotSigs: fingerprints of chains of content words that follow common-word anchors.

Every common word of a text is an anchor; it and the next `chain` content words behind it, other
common words skipped, form a signature. A fingerprint is the set of a text's signatures. Two
fingerprints are alike by their Jaccard coefficient, and since that is at most the ratio of the
smaller set to the larger, a join need only compare sets of neighbouring lengths: sets are
partitioned by length so that each pair within the threshold meets in one of two partitions, and
meets there only over signatures that a prefix of each set, rarest first, must share.

Everything is a DataFrame expression; no Python runs on the executors.

Defined results: null texts are empty texts. A text without any anchor has its whole text, in lower
case, as its one signature, so equal texts are always alike by 1 and others of that kind by 0.
Repeated rows give equal fingerprints and are each other's neighbours; rows without doc_id come last, in the order of
their texts; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawler.llm.common import columns
from trawler.llm.components import components
from trawler.session import Scratch

# Common words of the corpus's languages.
ANCHORS = tuple(
    "the of and to in a is that it for on was as with be by are this at an from or not but his her they you we has had have its "
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et à en un une du que qui dans pour par sur pas au avec il elle est ce se plus ne son sont "
    "el los las y o del al con por para una se no lo su como más pero sus ha fue".split()
)

#: Content words of a chain, and words behind an anchor among which they are looked for.
CHAIN, SPAN = 2, 8

#: Hexadecimal digits of a signature.
DIGITS = 8


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(text: Column, tokens: Column, marked: Column, chain: int = CHAIN, span: int = SPAN) -> Column:
    """The set of signatures, sorted, from a text, its words, and its words with anchors made empty."""

    def spot(w: Column, i: Column) -> Column:
        behind = F.slice(F.filter(F.slice(marked, i + 2, F.lit(span)), lambda x: x != ""), 1, chain)
        return F.when(F.get(marked, i) == "", F.xxhash64(w, behind))

    spots = F.array_compact(F.transform(tokens, spot))
    whole = F.array(F.xxhash64(F.lower(text)))
    return F.array_sort(F.array_distinct(F.transform(F.when(F.size(spots) > 0, spots).otherwise(whole), lambda h: F.shiftrightunsigned(h, 64 - 4 * DIGITS))))


def with_signatures(frame: DataFrame, text: str, out: str) -> DataFrame:
    """frame with the signatures (array<bigint>) of a text column; each step is one projection, computed once."""
    tokens, marked = f"{out}_tokens", f"{out}_marked"
    frame = frame.withColumn(tokens, words(F.col(text)))
    frame = frame.withColumn(marked, F.transform(tokens, lambda w: F.when(w.isin(*ANCHORS), "").otherwise(w)))
    return frame.withColumn(out, signatures(F.col(text), F.col(tokens), F.col(marked))).drop(tokens, marked)


def as_string(signatures_: str) -> Column:
    """A fingerprint as text: its signatures in hexadecimal, ascending, joined without gaps."""
    return F.array_join(F.transform(signatures_, lambda s: F.lpad(F.lower(F.hex(s)), DIGITS, "0")), "")


def likeness(a: str, b: str) -> Column:
    """The Jaccard coefficient of two sets of signatures; two empty sets are alike by 1."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def _bucket(bounds: list[int], id_col: str = "doc_id") -> Column:
    """How many of the sorted bounds are at most the id, found by halving; rows without an id count all."""
    if not bounds:
        return F.lit(0)
    full = 2 ** len(bounds).bit_length() - 1
    held = F.array(*(F.lit(int(b)).cast("long") for b in bounds), *[F.lit(None).cast("long")] * (full - len(bounds)))
    halves = F.array(*(F.lit(2**k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    found = F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(held, at + half - 1) <= F.col(id_col), half).otherwise(0))
    return F.when(F.col(id_col).isNull(), len(bounds)).otherwise(found)


def with_next(docs: DataFrame, bucket_rows: int = 256, most: int = 4096) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): every row and its successor by ascending doc_id, the last row's being the first.

    Rows are dealt into buckets of about bucket_rows between quantiles of the ids, `most` of them at most, and sorted
    there; a copy of the first row of the next bucket stands at the end of every bucket, so each row finds its successor
    beside it. Texts move between machines once, and signatures are computed once for each row."""
    count = docs.count()
    wanted = min(most, count // bucket_rows)
    cuts = [i / (wanted + 1) for i in range(1, wanted + 1)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, 10 * most)).first()[0] or [])) if wanted else []
    placed = docs.withColumn("bucket", _bucket(bounds))
    # at most `most` + 1 pairs of numbers; the ids are null only where no row has one
    firsts = sorted(placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    steps = docs.sparkSession.createDataFrame([(first, firsts[i - 1].bucket) for i, (_, first) in enumerate(firsts)], "first long, of int")
    ends = docs.join(F.broadcast(steps), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("doc_id", "of").agg(F.min("text").alias("text"))
    both = placed.select("doc_id", "text", "bucket", F.lit(False).alias("end")).union(ends.select("doc_id", "text", F.col("of").alias("bucket"), F.lit(True)))
    place = Window.partitionBy("bucket").orderBy("end", F.col("doc_id").isNull(), "doc_id", "text")
    seen = both.withColumn("next_text", F.lead("text").over(place))
    seen = with_signatures(seen, "text", "sigs").withColumn("next_sigs", F.lead("sigs").over(place))
    return seen.where("not end").select("doc_id", "text", "sigs", "next_text", "next_sigs")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sigs, edited_sigs, next_sigs): the signatures of every text, of
    its edited text (the second half replaced by the head of the next text), and of the next text."""
    clean = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    paired = with_next(clean).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    out = with_signatures(paired.withColumn("edited", edited), "edited", "edited_sigs")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sigs", "edited_sigs", "next_sigs")


def length_partition(size: Column, threshold: float) -> Column:
    """The number of a set's length partition: two sets alike by the threshold lie in one partition or in neighbours."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-math.log(threshold) + 1e-12)).cast("int")


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of classes of equal fingerprints that are alike by the threshold at least, and the members
    (doc_id, class) of every class. A class bears the smallest doc_id in it; copies are not expanded into pairs."""
    scratch = scratch or Scratch(docs.sparkSession, "spotsigs")
    clean = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    marked = scratch.keep(with_signatures(clean, "text", "sigs").select("doc_id", "sigs", F.xxhash64("sigs").alias("h1"), F.xxhash64("sigs", F.lit(1)).alias("h2")))
    classes = scratch.keep(marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("class")))
    members = marked.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "class")
    named = classes.where("class is not null").select("h1", "h2", F.col("class").alias("doc_id"))
    sets = marked.join(named, ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "sigs", F.size("sigs").alias("size"))
    sets = scratch.keep(sets.withColumn("part", length_partition(F.col("size"), threshold)))
    # a pair of sets within the threshold shares a signature among the first size - ceil(t * size) + 1 of each, in any fixed order: rarest first
    rows = sets.select("rep", "size", "part", F.explode("sigs").alias("sig"))
    ranks = rows.groupBy("sig").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))
    prefix = rows.join(ranks, "sig").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    prefix = prefix.where("df > 1").select("rep", "size", "part", "sig")
    probe = prefix.select(F.col("rep").alias("rep_b"), F.col("size").alias("size_b"), F.explode(F.array(F.col("part") - 1, F.col("part"))).alias("part"), "sig")
    pairs = prefix.join(probe, ["part", "sig"]).where((F.col("size") < F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("rep") < F.col("rep_b"))))
    pairs = pairs.where(F.col("size") >= F.col("size_b") * threshold - 1e-9).select("rep", "rep_b").distinct()
    left, right = sets.select("rep", "sigs"), sets.select(F.col("rep").alias("rep_b"), F.col("sigs").alias("sigs_b"))
    full = pairs.join(left, "rep").join(right, "rep_b").withColumn("likeness", likeness("sigs", "sigs_b")).where(F.col("likeness") >= threshold - 1e-9)
    return full.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b"), "likeness"), members


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, class_id, n_links), one row for each document: class_id is the smallest doc_id reachable over likenesses of
    the threshold and more, n_links the number of different fingerprints its own is linked to. A row without doc_id
    takes the class of its fingerprint; its class_id is null where no row with a doc_id shares that."""
    scratch = scratch or Scratch(docs.sparkSession, "spotsigs")
    pairs, members = near_pairs(docs, threshold, id_col, text_col, scratch)
    pairs = scratch.keep(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    found = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).withColumnRenamed("node", "class")
    return members.join(ends.join(found, "class"), "class", "left").select("doc_id", F.coalesce("component", "class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
