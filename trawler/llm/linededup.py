"""Line dedup by winnowing over line hashes.

For every line there are two windows: the fewest lines from it onwards, and the fewest up to it, that
hold `min_words` words together. The smallest line hash of each window is selected (the rightmost of
equals), so any run of lines of at least min_words words that occurs twice has selected fingerprints
in common, whatever surrounds it. Positions are joined on fingerprints that more than one position
selected; around a position, every window that selected it is a seed, and equal seeds are joined with
the earliest place (by doc_id, then line) at which their lines stand. Seeds are extended both ways by
chaining those that match the same earlier text at the same distance: as a window starts and one ends
at every line of a repeated run, the chain is the maximal run that the two texts have in common. The
lines of all runs with an earlier place are deleted; the first occurrence stays.

The result is exact: a line is deleted if and only if it lies in a run of lines with at least
min_words words that occurs, in that order, at an earlier position.

Defined results: a null text has no lines to delete and stays null; runs below min_words words stay;
rows that repeat both doc_id and text stand at one place, so none is later than the other, while rows
that share a doc_id only are told apart by their texts; a row without doc_id is neither changed nor
an earlier place; extra columns are ignored by `repeats` and kept by `drop_repeats`, but for `_lines`
and `_removed`, which it sets; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawler.llm.common import columns, free, slices
from trawler.session import Scratch

#: Least words of a run that is deleted when it repeats.
MIN_WORDS = 50


def windows(text: str, min_words: int) -> list[tuple[int, int, bytes, int]]:
    """(first line, line after the last, hash of the lines, selected line) of every window."""
    lines = text.split("\n")
    counts = np.fromiter((len(line.split()) for line in lines), np.int64, len(lines))
    total = np.append(0, np.cumsum(counts))
    if total[-1] < min_words:
        return []
    onward = np.searchsorted(total, total[:-1] + min_words, "left")
    upto = np.searchsorted(total, total[1:] - min_words, "right") - 1
    n, m = int(np.searchsorted(onward, len(lines), "right")), int(np.searchsorted(total[1:], min_words, "left"))
    spans = set(zip(range(n), onward[:n].tolist())) | set(zip(upto[m:].tolist(), range(m + 1, len(lines) + 1)))
    hashes = [xxhash.xxh64_intdigest(line.encode()) for line in lines]
    raw, out, best, last = np.array(hashes, np.uint64).tobytes(), [], -1, 0
    # both ends of the windows only ever move on, so the last minimum is kept while it is inside
    for first, stop in sorted(spans):
        for j in range(max(first, last) if best >= first else first, stop):
            if best < first or hashes[j] <= hashes[best]:
                best = j
        last = stop
        out.append((first, stop, xxhash.xxh3_128_digest(raw[8 * first : 8 * stop]), best))
    return out


SEEDS = "doc_id long, twin long, fingerprint long, opens int, first int, stop int, high long, low long"


def seeds(docs: DataFrame, min_words: int) -> DataFrame:
    """Every window as a row: its text's doc_id and hash, the fingerprint it selected, whether it is the first
    that selected that position, its lines [first, stop) and the 128-bit hash of their contents."""
    names = [c.split()[0] for c in SEEDS.split(", ")]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            rows, numbers, sizes, contents = [], [], [], []
            for key, text in zip(keys, texts, strict=True):
                found = windows(text, min_words)
                if not found:
                    continue
                lines = text.split("\n")
                twin = xxhash.xxh64_intdigest(text.encode(), 42)
                numbers.append((key, twin - (twin >> 63 << 64)))
                sizes.append(len(found))
                prints: dict[int, int] = {}
                for first, stop, content, at in found:
                    opens = at not in prints
                    if opens:
                        prints[at] = xxhash.xxh64_intdigest(lines[at].encode()) - 2**63
                    rows.append((prints[at], opens, first, stop))
                    contents.append(content)
            if not rows:
                continue
            held = np.array(rows, np.int64)
            ids = np.repeat(np.array(numbers, np.int64), sizes, axis=0)
            content = np.frombuffer(b"".join(contents), np.int64).reshape(-1, 2)
            data = [ids[:, 0], ids[:, 1], held[:, 0], *(held[:, i].astype(np.int32) for i in (1, 2, 3)), content[:, 0], content[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in data], names)

    return docs.where("doc_id is not null").mapInArrow(select, SEEDS)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, twin, first, stop, of_doc_id, of_twin, of_first): the maximal runs of lines [first, stop) that stood
    at an earlier place, and where; twin is the xxhash64 of a text."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    found = scratch.keep(seeds(columns(docs, doc_id=id_col, text=text_col), min_words))
    # both tables of a join are written ones, so a fingerprint or passage that is everywhere can be split
    shared = scratch.keep(found.groupBy("fingerprint").agg(F.sum("opens").alias("n")).where("n > 1").select("fingerprint"))
    near = scratch.keep(found.join(shared, "fingerprint", "left_semi").select("doc_id", "twin", "first", "stop", "high", "low"))
    place = F.struct("doc_id", "twin", "first")
    lead = scratch.keep(near.groupBy("high", "low").agg(F.min(place).alias("lead"), F.count("*").alias("n")).where("n > 1").select("high", "low", "lead"))
    later = near.join(lead, ["high", "low"]).where(place != F.col("lead"))
    later = later.select("doc_id", "twin", "first", "stop", F.col("lead.doc_id").alias("of_doc_id"), F.col("lead.twin").alias("of_twin"), F.col("lead.first").alias("of_first"))
    # all further steps keep the rows of a text together, which is bounded by the text's lines
    chain = ["doc_id", "twin", "of_doc_id", "of_twin", "distance"]
    later = later.repartition("doc_id", "twin").withColumn("distance", F.col("first") - F.col("of_first"))
    return _chained(later, chain).select("doc_id", "twin", "first", "stop", "of_doc_id", "of_twin", (F.col("first") - F.col("distance")).alias("of_first"))


def _chained(spans: DataFrame, by: list[str]) -> DataFrame:
    """(*by, first, stop): overlapping and touching spans of lines as one."""
    before = Window.partitionBy(*by).orderBy("first", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("first") > reach)).cast("int")
    number = F.sum("_opens").over(before.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("_opens", opens).withColumn("_number", number)
    return marked.groupBy(*by, "_number").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).drop("_number")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """docs with the repeated lines gone from its text, and _lines, _removed: how many there were and went."""
    runs = _chained(repeats(docs, id_col, text_col, min_words, scratch), ["doc_id", "twin"])
    runs = runs.groupBy("doc_id", "twin").agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("runs"))
    docs = docs.drop("_lines", "_removed")
    of, twin, gone, every = free(docs, "_of", "_twin", "_runs", "_every")
    runs = runs.select(F.col("doc_id").alias(of), F.col("twin").alias(twin), F.col("runs").alias(gone))
    joined = docs.join(runs, (F.col(id_col) == F.col(of)) & (F.xxhash64(text_col) == F.col(twin)), "left").withColumn(every, F.split(text_col, "\n", -1))
    # what stays lies before the first run, between two and after the last
    edges = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.struct(F.coalesce(F.get(gone, i - 1)["stop"], F.lit(0)).alias("a"), F.coalesce(F.get(gone, i)["first"], F.size(every)).alias("b")))
    kept = F.flatten(F.transform(edges, lambda e: F.slice(every, e["a"] + 1, e["b"] - e["a"])))
    count = F.aggregate(gone, F.lit(0), lambda n, r: n + r["stop"] - r["first"])
    out = joined.withColumn("_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(every)).cast("long")).withColumn("_removed", F.coalesce(count, F.lit(0)).cast("long"))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.withColumn(text_col, text).drop(of, twin, gone, every)


#: The same result in DuckDB: every window of lines by its whole text, and the first place it stands at.
ORACLE = f"""
WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM parts),
counted AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\s]+')) AS w FROM lines),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM counted),
enough AS (SELECT a.doc_id, a.i AS a, b.i AS b FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= {MIN_WORDS}),
stops AS (SELECT doc_id, a AS first, min(b) AS last FROM enough GROUP BY 1, 2 UNION SELECT doc_id, max(a), b FROM enough GROUP BY doc_id, b),
wins AS (
  SELECT s.doc_id, s.first, s.last, list_aggregate(list_slice(p.ls, s.first + 1, s.last + 1), 'string_agg', chr(10)) AS content
  FROM stops s JOIN parts p USING (doc_id)),
leads AS (SELECT content, min(struct_pack(d := doc_id, f := first)) AS lead FROM wins GROUP BY 1 HAVING count(*) > 1),
later AS (SELECT w.* FROM wins w JOIN leads l USING (content) WHERE (w.doc_id, w.first) <> (l.lead.d, l.lead.f)),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.i BETWEEN r.first AND r.last),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS rest
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(rest, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
