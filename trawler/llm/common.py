"""Helpers shared by the training-text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of text worked on at once inside a Python worker.
SLICE_BYTES = 2 << 20

#: A space before a non-blank always starts a new match of the byte-level BPE patterns: no
#: alternative holds a blank after a non-blank, and a run of blanks gives its last space away.
_CUT = re.compile(r" (?=\S)")
_RISK = re.compile(r" (?=\s|$)")


def columns(frame: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under fixed names, so extra or clashing columns play no part."""
    return frame.select(*(F.col(source).alias(name) for name, source in names.items()))


def free(frame: DataFrame, *names: str) -> list[str]:
    """Column names like these that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about limit bytes each, one row at least; null texts become empty ones."""
    for batch in batches:
        n = batch.num_rows
        upto = np.cumsum(_bytes_of(batch.column(1)))
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, "left")) + 1)
            part = batch.slice(at, stop - at)
            yield part.column(0).to_pylist(), ["" if t is None else t for t in part.column(1).to_pylist()]
            at = stop


def _bytes_of(texts: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of every text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def safe_parts(text: str, limit: int) -> Iterator[str]:
    """text in parts of about limit characters, cut at the spaces where no token can span; all parts but the first lost one leading space."""
    at = 0
    while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def safe_pieces(text: str) -> list[str]:
    """text cut at the spaces where no token can span; all pieces but the first lost one leading space."""
    return _CUT.split(text) if _RISK.search(text) else text.split(" ")
