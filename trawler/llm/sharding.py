"""Sharding by longest-processing-time scheduling.

Rows with equal texts form groups that must stay together. Groups are taken by falling size and each
goes to the shard with the least load, found through a heap. The heap runs over size classes, not
over groups: a class says how many groups of one size there are, and groups of a class are equal to
the schedule, so the heap hands out their number and a distributed ranking inside the class decides
which group is which. Sizes up to 2**11 bytes are classes of their own; larger ones keep 11 leading
bits and count with their mean, so classes are at most 2**11 + 2**10 for every further binary order
of magnitude (55,000 for sizes up to 2**62), however many groups there are. That bounds what the driver
sees and what is broadcast: one row for each class, with at most one range of ranks for each shard.

Law `bytes`: the shards' sizes are near equal. A group larger than a shard's fair share cannot stay
together under that law; it alone is cut into pieces of about an eighth of a share.

Defined results: a null text counts as an empty one (size 8, CRC 0); repeated rows get slots of
their own; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawler.llm.common import columns
from trawler.session import Scratch

#: Leading bits of a size that make its class; rows ranked together by one task.
CLASS_BITS, RANK_ROWS = 11, 1024

#: Bytes that a row weighs besides its text.
ROW_BYTES = 8


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, shard, first, last): the groups of a class, numbered from 0, that go to a shard.

    classes: (class, groups, their bytes). Equal groups are dealt as single heap steps would deal
    them: in rounds, as soon as the loads of all shards lie within one group of each other."""
    heap = [(0.0, s) for s in range(shards)]
    heapify(heap)
    out = []
    for key, groups, total in sorted(classes, reverse=True):
        each = total / groups
        given = [0] * shards
        left = groups
        while left and (heap[0][0] + each < max(heap)[0] or left < shards):
            load, s = heap[0]
            given[s] += 1
            heapreplace(heap, (load + each, s))
            left -= 1
        if left:
            rounds = left // shards
            heap = [(load + rounds * each, s) for load, s in heap]
            given = [n + rounds for n in given]
            for _ in range(left - rounds * shards):
                load, s = heap[0]
                given[s] += 1
                heapreplace(heap, (load + each, s))
        at = 0
        for s, n in enumerate(given):
            if n:
                out.append((key, s, at, at + n))
                at += n
    return out


def _ranked(frame: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """frame with `rank`, from 0 and gapless inside each group, however large a group is.

    Each group is dealt by hash into lots of about RANK_ROWS rows; a lot's rows are numbered by one
    task, after the rows of the lots before it."""
    counted = frame.groupBy(*group).agg(F.ceil(F.count("*") / RANK_ROWS).cast("long").alias("lots"))
    lotted = frame.join(counted, group).withColumn("lot", F.pmod(F.xxhash64(*order), "lots")).drop("lots")
    lotted = scratch.keep(lotted)
    before = Window.partitionBy(*group).orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lotted.groupBy(*group, "lot").agg(F.count("*").alias("n")).select(*group, "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy(*group, "lot").orderBy(*order)) - 1
    return lotted.withColumn("place", place).join(offsets, [*group, "lot"]).withColumn("rank", F.col("place") + F.col("offset")).drop("place", "offset", "lot")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): law `bytes`; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "shard")
    text = F.coalesce("text", F.lit(""))
    rows = columns(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("same")
    )
    rows = scratch.keep(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(total / shards, 1.0)
    # only groups above a fair share are cut: fewer than there are shards
    large = rows.groupBy("same").agg(F.sum("size").alias("all")).where(F.col("all") > share)
    large = large.select("same", F.ceil(F.col("all") / (share / 8)).cast("long").alias("pieces"))
    # fewer rows than there are shards
    cut = rows.join(F.broadcast(large), "same", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("piece")), "pieces"), F.lit(0).cast("long"))).drop("pieces")
    groups = cut.groupBy("same", "piece").agg(F.sum("size").alias("bytes"))
    low = F.greatest(F.ceil(F.log2(F.col("bytes") + 1)).cast("int") - CLASS_BITS, F.lit(0))
    groups = scratch.keep(groups.withColumn("low", low).selectExpr("same", "piece", "bytes", "shiftleft(shiftright(bytes, low), low) AS class"))
    classes = [tuple(r) for r in groups.groupBy("class").agg(F.count("*"), F.sum("bytes")).collect()]
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    for key, shard, first, last in schedule(classes, shards):
        ranges.setdefault(key, []).append((shard, first, last))
    dealt = spark.createDataFrame(sorted(ranges.items()), "class long, ranges array<struct<shard: int, first: long, last: long>>")
    ranked = _ranked(groups.select("same", "piece", "class"), ["class"], ["same", "piece"], scratch)
    # bounded by the number of classes times that of shards
    of = F.filter("ranges", lambda r: (F.col("rank") >= r["first"]) & (F.col("rank") < r["last"]))
    placed = ranked.join(F.broadcast(dealt), "class").select("same", "piece", F.get(of, F.lit(0))["shard"].alias("shard"))
    with_shard = cut.join(placed.select("same", "piece", "shard"), ["same", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    out = _ranked(with_shard, ["shard"], ["doc_id", "text_crc32"], scratch)
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"))
