"""Exact top-k inner-product search with KD-trees per shard.

Rows are dealt into the cells of a small KD-tree over a bounded sample of vectors (`SAMPLE_ROWS`), so
that shards lie in different places; a cell that holds more than SHARD_ROWS rows, as one with a very
common vector may, is cut by a hash of the id. Each shard's KD-tree splits at medians of the widest
dimension and keeps the tight bounding box of every leaf. A query visits the leaves best-first, by the
largest inner product that a leaf's box allows, and stops at the first box that cannot reach its kth
best score; all queries of a batch take their steps together. A first round searches the shard in
which the query itself lies; its kth score is then propagated: pairs of a query and a shard whose box
cannot reach it are dropped before anything is shuffled, and the trees that are left are cut by it from
the start. Shards are built and searched as their rows stream by, trees first, then queries in batches,
so a task holds one shard and one batch, however many queries there are.

Vectors are integers (floor(scale * x), x as double) and scores exact: in doubles as long as every
product fits them, else in Python integers, cut off at the range of a long.

Defined results: a vector that is null, or holds a null or a non-finite component, takes no part,
nor does a row without an id; vectors of unlike lengths are compared as if the shorter one ended in
zeros; ties go to the smaller id; a query does not find rows of its own id; of rows that share an id
that is a query's, the one with the smallest vector asks, and all are found by others; fewer rows than
k give all of them; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawler.llm.common import columns
from trawler.session import Scratch

#: Rows of a shard, of a leaf, of the sample that places the cells (about), and the most levels of cells.
SHARD_ROWS, LEAF_ROWS, SAMPLE_ROWS, LEVELS = 8_192, 128, 4_096, 8

_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


class Tree:
    """A KD-tree over integer vectors (n, d), given with their ids; leaves keep their rows in the order of ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            part = self.vectors[rows]
            spread = part.max(0) - part.min(0)
            # a box without extent holds one vector again and again: nothing to split
            if len(rows) <= leaf or not spread.any():
                self.leaves.append(rows)
                continue
            by = rows[np.argsort(part[:, int(spread.argmax())], kind="stable")]
            todo += [np.sort(by[: len(by) // 2]), np.sort(by[len(by) // 2 :])]
        self.low = np.array([self.vectors[rows].min(0) for rows in self.leaves])
        self.high = np.array([self.vectors[rows].max(0) for rows in self.leaves])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each leaf's box: (queries, leaves)."""
        zero = queries * 0
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best k rows of every query, of those that score its floor at least."""
        m = len(queries)
        bounds = self.bounds(queries)
        turn = np.argsort(-bounds, axis=1, kind="stable")
        ids = np.full((m, k), np.iinfo(np.int64).max, np.int64)
        scores = np.full((m, k), -np.inf).astype(self.vectors.dtype)
        reach = floors.astype(self.vectors.dtype)
        active = np.arange(m)
        for step in range(len(self.leaves)):
            leaf = turn[active, step]
            # a box that only ties may hold a smaller id; all boxes after one that cannot reach are lower still
            on = bounds[active, leaf] >= reach[active]
            active, leaf = active[on], leaf[on]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            for some in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                asked, rows = active[some], self.leaves[leaf[some[0]]]
                found = queries[asked] @ self.vectors[rows].T
                fit = (found >= reach[asked][:, None]) & (self.ids[rows][None, :] != own[asked][:, None])
                for i in np.flatnonzero(fit.any(1)).tolist():
                    q, at = asked[i], np.flatnonzero(fit[i])
                    all_ids, all_scores = np.concatenate((ids[q], self.ids[rows[at]])), np.concatenate((scores[q], found[i, at]))
                    best = np.lexsort((all_ids, -all_scores))[:k]
                    ids[q], scores[q] = all_ids[best], all_scores[best]
                    if scores[q, -1] > reach[q]:
                        reach[q] = scores[q, -1]
        q, place = np.nonzero(scores > -np.inf)
        return q, ids[q, place], scores[q, place]


def _matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """The vectors of a column, filled up with zeros to the longest one and to width."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)), 1)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


FOUND = "query_id long, vec_id long, score long, shard int, low array<double>, high array<double>"


class _Shard:
    """The rows of one shard, gathered until its first queries come."""

    def __init__(self, shard: int):
        self.shard, self.ids, self.parts = shard, [], []
        self.trees: dict[bool, Tree] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids.append(batch.column(2).to_numpy())
        self.parts.append(batch.column(3))

    def close(self) -> None:
        self.all_ids = np.concatenate(self.ids)
        width = max(int(np.diff(p.offsets.to_numpy()).max(initial=0)) for p in self.parts)
        self.rows = np.concatenate([_matrix(p, width) for p in self.parts])
        self.parts = []

    def box(self) -> tuple[list[float], list[float]]:
        return self.rows.min(0).tolist(), self.rows.max(0).tolist()

    def answer(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        queries = _matrix(batch.column(3), self.rows.shape[1])
        rows = self.rows
        if queries.shape[1] > rows.shape[1]:
            queries = queries[:, : rows.shape[1]]  # the rows have zeros there
        exact = bool(rows.shape[1] * max(np.abs(rows).max(), 1) * max(np.abs(queries).max(initial=0), 1) >= 2.0**53)
        if exact not in self.trees:
            self.trees[exact] = Tree(self.all_ids, np.array([[int(x) for x in v] for v in rows.tolist()], object) if exact else rows)
        if exact:
            queries = np.array([[int(x) for x in v] for v in queries.tolist()], object)
        own, floors = batch.column(2).to_numpy(), batch.column(4).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        q, ids, scores = self.trees[exact].search(queries, own, floors, k)
        scores = np.array([min(max(int(s), _LOWEST), _HIGHEST) for s in scores.tolist()], np.int64) if exact else scores.astype(np.int64)
        return _rows(own[q], ids, scores, np.full(len(q), self.shard, np.int32), [None] * len(q), [None] * len(q))


def _rows(query, ids, scores, shard, low, high) -> pa.RecordBatch:
    doubles = pa.list_(pa.float64())
    data = [pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array(shard, pa.int32()), pa.array(low, doubles), pa.array(high, doubles)]
    return pa.RecordBatch.from_arrays(data, [c.split()[0] for c in FOUND.split(", ")])


def _search(batches: Iterator[pa.RecordBatch], k: int, boxes: bool) -> Iterator[pa.RecordBatch]:
    """Answers of every shard to its queries, from (shard, asks, id, v, floor) sorted by shard, its rows first;
    with boxes, one row for each shard with its bounding box besides."""
    now: _Shard | None = None
    closed = True

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal closed
        if now is not None and not closed:
            now.close()
            closed = True
            if boxes:
                low, high = now.box()
                yield _rows([None], [None], [None], [now.shard], [low], [high])

    for batch in batches:
        if not batch.num_rows:
            continue
        shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            part = batch.slice(a, b - a)
            if not asks[a]:
                if now is None or now.shard != shard[a]:
                    yield from close()
                    now, closed = _Shard(int(shard[a])), False
                now.add(part)
            elif now is not None and now.shard == shard[a]:
                yield from close()
                for at in range(0, part.num_rows, 2048):
                    yield now.answer(part.slice(at, 2048), k)
    yield from close()


def _cells(sample: np.ndarray, levels: int) -> tuple[list[int], list[float]]:
    """Dimension and value at which each inner node of a KD-tree over the sample is split; node i has the children 2i and 2i + 1."""
    dims, values = [0] * 2**levels, [0.0] * 2**levels
    rows = {1: sample}
    for node in range(1, 2**levels):
        part = rows.pop(node)
        if len(part):
            d = int((part.max(0) - part.min(0)).argmax())
            dims[node], values[node] = d, float(np.median(part[:, d]))
        right = part[:, dims[node]] >= values[node]
        rows[2 * node], rows[2 * node + 1] = part[~right], part[right]
    return dims, values


def _integers(scale: float) -> tuple[Column, Column]:
    """Whether a vector takes part, and its components as whole doubles."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    # floor() of a double beyond a long's range saturates, so those stay doubles, which are whole there
    wide = F.transform("v", lambda x: x.cast("double") * F.lit(scale))
    fits = F.forall("v", lambda x: F.abs(x.cast("double") * F.lit(scale)) < 2.0**62)
    return sound, F.when(fits, scaled).otherwise(wide)


def top_k(
    table: DataFrame,
    k: int = 5,
    query_step: int = 50,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scratch: Scratch | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by query_step the k rows of
    the highest inner products."""
    scratch = scratch or Scratch(table.sparkSession, "topk")
    sound, whole = _integers(scale)
    rows = columns(table, id=id_col, v=vector_col).where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    rows = scratch.keep(rows.select(F.col("id").cast("long").alias("id"), whole.alias("v")))
    n = rows.count()
    levels = min(LEVELS, ceil(log2(max(1, n / SHARD_ROWS))))
    cell: Column = F.lit(0)
    if levels:
        # about SAMPLE_ROWS vectors whatever n is
        held = [r.v for r in rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(n)) < SAMPLE_ROWS).select("v").collect()]
        width = max(map(len, held), default=0)
        sample = np.array([v + [0.0] * (width - len(v)) for v in held]).reshape(len(held), width)
        if sample.size:
            dims, values = (F.array(*map(F.lit, x)) for x in _cells(sample, levels))
            step = lambda node, _: F.lit(2) * node + (F.coalesce(F.get("v", F.get(dims, node)), F.lit(0.0)) >= F.get(values, node)).cast("int")
            cell = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), step) - 2**levels
    placed = rows.withColumn("cell", cell)
    counts = {r.cell: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most 2**LEVELS rows
    parts = [max(1, ceil(counts.get(c, 0) / SHARD_ROWS)) for c in range(2**levels)]
    starts = np.append(0, np.cumsum(parts)).tolist()
    shards = starts[-1]
    of, start = (F.get(F.array(*map(F.lit, x)), F.col("cell")) for x in (parts, starts[:-1]))
    shard = (start + F.pmod(F.xxhash64("id", F.lit("shard")), of)).cast("int")
    dealt = placed.select(shard.alias("shard"), "id", "v", "cell")
    queries = rows.where(F.col("id") % query_step == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("cell", cell)
    queries = scratch.keep(queries.select(shard.alias("shard"), "id", "v"))

    def search(asked: DataFrame, boxes: bool) -> DataFrame:
        all_rows = dealt.select("shard", F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("floor"))
        met = all_rows.union(asked.select("shard", F.lit(True), "id", "v", "floor")).repartition(max(8, 2 * shards), "shard")
        return met.sortWithinPartitions("shard", "asks").mapInArrow(lambda b: _search(b, k, boxes), FOUND)

    first = scratch.keep(search(queries.withColumn("floor", F.lit(None).cast("double")), True))
    found = first.where("query_id is not null").select("query_id", "vec_id", "score")
    if shards > 1:
        floors = found.groupBy(F.col("query_id").alias("id")).agg(F.when((F.count("*") >= k) & (F.min("score") > _LOWEST), F.min("score").cast("double")).alias("floor"))
        boxes = first.where("query_id is null").select("shard", F.arrays_zip("low", "high").alias("box"))
        pairs = queries.withColumnRenamed("shard", "home").join(floors, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        most = F.aggregate(
            F.zip_with("v", "box", lambda x, b: F.coalesce(F.when(x > 0, x * b["high"]).otherwise(x * b["low"]), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
        )
        # sums of doubles may be off by their rounding
        able = pairs.join(boxes, "shard").where(F.col("floor").isNull() | (most + F.abs(most) * 1e-9 >= F.col("floor")))
        found = found.union(search(able, False).select("query_id", "vec_id", "score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
