"""Dense retrieval: exact inner-product search over vectors, encoders and pair scorers to plug in."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.functions.features import dot
from trawler.operators.topk import top_k

#: Vectors that a task holds at once, and queries scored against them at once.
SHARD_ROWS, BLOCK_QUERIES = 8192, 256


def dense_sim(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, sim): inner product of the vectors of given pairs; 0 where either has none."""
    q, d = queries.select("qid", F.col("vec").alias("q_vec")), docs.select("doc_id", F.col("vec").alias("d_vec"))
    return pairs.join(q, "qid", "left").join(d, "doc_id", "left").select("qid", "doc_id", dot(F.col("q_vec"), F.col("d_vec")).alias("sim"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best vectors of each shard for each of its queries, from (shard, qid, doc_id, vec) sorted by shard, vectors first."""
    now, ids, parts, matrix, order = None, [], [], None, None

    def answer(qids: pa.Array, queries: np.ndarray) -> pa.RecordBatch:
        scores = np.floor(queries @ matrix.T * 1e6 + 0.5) / 1e6
        keep = min(k, len(ids))
        least = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
        rows, docs, found = [], [], []
        for i, row in enumerate(scores):
            at = np.flatnonzero(row >= least[i])
            at = at[np.lexsort((order[at], -row[at]))[:keep]]
            rows.append(np.full(len(at), i))
            docs.append(at)
            found.append(row[at])
        return pa.RecordBatch.from_arrays([qids.take(pa.array(np.concatenate(rows))), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(found))], ["qid", "doc_id", "score"])

    for batch in batches:
        if not batch.num_rows:
            continue
        shard, asks = batch.column(0).to_numpy(), batch.column(2).is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            part = batch.slice(a, b - a)
            if shard[a] != now:
                now, ids, parts, matrix = shard[a], [], [], None
            if not asks[a]:
                ids.append(part.column(2))
                parts.append(_matrix(part.column(3)))
                continue
            if matrix is None and parts:
                ids, matrix, order = pa.concat_arrays(ids), np.concatenate(parts), np.empty(sum(map(len, ids)), np.int64)
                order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            if matrix is not None:
                for at in range(0, part.num_rows, BLOCK_QUERIES):
                    some = part.slice(at, BLOCK_QUERIES)
                    yield answer(some.column(1), _matrix(some.column(3)))


def dense_topk(queries: DataFrame, docs: DataFrame, k: int = 200, exclude_self: bool = False, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(qid, doc_id, score, rank): the k largest inner products of each query with all vectors.

    Vectors are dealt into shards, and the stated queries stream past each shard in blocks: a task holds one
    shard and one block, vectors move once, and only the k best of each query and shard are ranked."""
    kind, id_kind = queries.schema["qid"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("vec is not null and doc_id is not null")
    shards = max(1, -(-docs.count() // shard_rows))
    held = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast(kind).alias("qid"), "doc_id", "vec")
    asked = queries.where("vec is not null").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "qid", F.lit(None).cast(id_kind), "vec")
    met = held.union(asked).repartition(max(8, 2 * shards), "shard").sortWithinPartitions("shard", F.col("doc_id").isNull())
    found = met.mapInArrow(lambda b: _best(b, k + exclude_self), f"qid {kind}, doc_id {id_kind}, score double")
    if exclude_self:
        found = found.where("qid <> doc_id")
    return top_k(found, k)


def hashing_encoder(dimensions: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for a neural encoder: signed hashing of words, normalized to length 1."""

    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts.fillna(""):
            v = np.zeros(dimensions)
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                v[h % dimensions] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out)

    return encode


def encode_texts(texts: DataFrame, encoder: Callable[[pd.Series], pd.Series], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vec) by any function from a series of texts to a series of vectors."""
    return texts.select(id_col, F.pandas_udf(encoder, "array<float>")(text_col).alias("vec"))


def lexical_pair_scorer(q: pd.Series, d: pd.Series) -> pd.Series:
    """A deterministic stand-in for a cross-encoder: share of distinct query words in the text's first 320 words."""

    def one(query: str, text: str) -> float:
        words = set(query.lower().split())
        return len(words & set(text.lower().split()[:320])) / len(words) if words else 0.0

    return pd.Series([one(a or "", b or "") for a, b in zip(q, d, strict=True)], dtype="float64")


def pair_scores(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], query: str = "qtext", text: str = "text") -> DataFrame:
    """pairs with f_ce by any function over two series; a missing text is scored as an empty one."""
    return pairs.withColumn("f_ce", F.pandas_udf(scorer, "double")(F.coalesce(query, F.lit("")), F.coalesce(text, F.lit(""))))
