"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted target / source_size times. The whole part is taken outright;
the fractional part is a copy probability. Pairs of fractional documents transfer word mass at
random until one of them is integral (its expected copies stay as they were, and the words of the
pair do not change), so a group of documents ends with one fractional document at most. Groups are
dealt evenly inside a source, and their residuals are combined level by level through a reduction
tree until one residual for each source is left, which is rounded on its own. The words taken of a
source differ from its target by less than one document.

Defined results: null texts have size 0; null sources form one source, ordered last; documents of
size 0 take no words; repeated rows are decided one by one; extra columns are ignored; an empty
table gives an empty table. The random numbers come from a hash of doc_id and level: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.llm.common import columns
from trawler.session import Scratch

#: Rows of one group on the lowest level, and residuals combined into one on every further level.
GROUP_ROWS, FAN_IN = 2048, 256

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict:
    """The words wanted of every source: total * weight, at most `most` times its size, the excess
    going to the sources below their limit by weight. Exact; weights repeat over the sources by code point."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > most * sizes[s]}
        out |= {s: Fraction(most * sizes[s]) for s in full} if full else {s: share * weight[s] for s in open_}
        left -= sum(out[s] for s in full)
        open_ = open_ - full if full else set()
    return out


def pivotal(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Copies (0 or 1, or a fraction for the residual) of documents with these sizes and fractional
    parts, and the place of the residual (-1: none). Word mass is conserved except by rounding error."""
    out = part.copy()
    held = -1
    for i in range(len(out)):
        if not 1e-12 < out[i] < 1 - 1e-12:
            out[i] = round(out[i])
        elif held < 0:
            held = i
        else:
            a, b = out[held] * size[held], out[i] * size[i]  # words that the two still stand for
            # move words to i until i is whole or held is empty, or the other way round; the chances
            # leave both expectations as they are
            to_i, to_held = min(a, size[i] - b), min(b, size[held] - a)
            if draw[i] * (to_i + to_held) < to_held:
                a, b = a - to_i, b + to_i
            else:
                a, b = a + to_held, b - to_held
            p, q = a / size[held], b / size[i]
            done_p, done_q = not 1e-12 < p < 1 - 1e-12, not 1e-12 < q < 1 - 1e-12
            out[held], out[i] = (round(p) if done_p else p), (round(q) if done_q else q)
            held = -1 if done_p and done_q else i if done_p else held
    return out, held


def _level(pdf: pd.DataFrame, last: bool = False) -> pd.DataFrame:
    # large documents first: the many small ones after them settle them, and the residual ends small
    pdf = pdf.sort_values(["size", "doc_id", "twin"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    size, part, draw = (pdf[c].to_numpy(np.float64) for c in ("size", "part", "draw"))
    out, held = pivotal(size, np.where(size > 0, part, 0.0), draw)
    open_ = np.zeros(len(out), bool)
    if held >= 0:
        if last:
            out[held] = float(draw[held] < out[held])
        else:
            open_[held] = True
    return pdf.assign(part=out, open=open_)[["doc_id", "source", "twin", "size", "part", "lot", "open"]]


def _last_level(pdf: pd.DataFrame) -> pd.DataFrame:
    return _level(pdf, last=True)


def _inner_level(pdf: pd.DataFrame) -> pd.DataFrame:
    return _level(pdf)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, source, twin, size, source_size, target, copies): copies is how often the mix takes
    the document; twin tells repeated doc_ids apart by a hash of their text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.keep(columns(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("twin")))
    # one row for each source: as many as there are sources, not documents
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r.source: r["size"] for r in rows}
    wanted = targets(sizes, weights, most)
    plan = [(s, sizes[s], float(t), float(t / sizes[s]) if sizes[s] else 0.0, -(-n // GROUP_ROWS)) for s, t, n in ((r.source, wanted[r.source], r.n) for r in rows)]
    per_source = spark.createDataFrame(plan, "of string, source_size long, target double, rate double, lots long")
    joined = sized.join(per_source, sized.source.eqNullSafe(per_source.of)).drop("of")
    joined = joined.withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.col("whole"))
    lot = F.pmod(F.xxhash64("doc_id", "twin", F.lit("lot")), "lots")
    todo = joined.select("doc_id", "source", "twin", "size", "part", lot.alias("lot"))
    shape = "doc_id long, source string, twin long, size long, part double, lot long, open boolean"
    done: list[DataFrame] = []
    lots, level = max((p[4] for p in plan), default=1), 0
    while True:
        last = lots <= 1
        draw = (F.xxhash64("doc_id", "twin", F.lit(level)).bitwiseAND(2**53 - 1) / F.lit(float(2**53))).alias("draw")
        out = todo.select("*", draw).groupBy("source", "lot").applyInPandas(_last_level if last else _inner_level, shape)
        out = scratch.keep(out)
        done.append(out.where("not open"))
        if last:
            break
        lots, level = -(-lots // FAN_IN), level + 1
        todo = out.where("open").withColumn("lot", F.floor(F.col("lot") / FAN_IN).cast("long")).drop("open")
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    facts = per_source.select("of", "source_size", "target", F.floor("rate").cast("long").alias("whole"))
    return decided.join(facts, decided.source.eqNullSafe(facts.of)).select(
        "doc_id", "source", "twin", "size", "source_size", "target", (F.col("whole") + F.round("part").cast("long")).alias("copies")
    )
