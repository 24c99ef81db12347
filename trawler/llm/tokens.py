"""Token counts by batch encoding in Arrow functions that return lengths only.

Long texts are split at safe boundaries (a space before a non-blank, where no token can span), the
distinct pieces of a slice are encoded in batches of equal UTF-8 bytes, and the lengths are added up
per text. Pieces met again in the same worker are looked up in a bounded memo. A model for which such
boundaries are not known to be safe (`cuttable`) gets its texts whole, in batches of equal bytes.

Defined results: null and empty texts have no tokens and no bytes; repeated rows give equal
results; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trawler.llm.common import columns, safe_parts, safe_pieces, slices

#: UTF-8 bytes handed to the library in one batch, characters of a text that are split at once, and pieces that a worker remembers.
BATCH_BYTES, PART_CHARS, MEMO_PIECES = 1 << 18, 1 << 20, 1 << 18


def cuttable(spec: dict) -> bool:
    """Whether a .json model never makes a token across a space before a non-blank: byte-level BPE by its usual
    pattern, nothing normalized, and no added token that holds blanks or takes those around it."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    greedy = any(t["content"].split() != [t["content"]] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens") or [])
    return bool(plain and spec["model"]["type"] == "BPE" and not spec.get("normalizer") and not greedy)


@functools.lru_cache(maxsize=2)
def _counter(path: str):
    """(encode lengths of a list of pieces, memo) for a tokenizer file; one per worker process."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda parts: [len(x) for x in model.encode(parts, num_threads=1)]), {}, False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda parts: [len(x) for x in model.encode_batch_fast(parts, add_special_tokens=False)]), {}, cuttable(json.loads(model.to_str()))


def lengths(texts: list[str], path: str) -> list[int]:
    """The number of tokens of every text."""
    measure, memo, cut = _counter(path)
    if not cut:
        return [n for part in _balanced(texts) for n in measure(part)]
    out = [0] * len(texts)
    new: dict[str, None] = {}
    waiting: list[tuple[int, list[str]]] = []
    size = 0

    def settle() -> None:
        for part in _balanced(list(new)):
            memo.update(zip(part, measure(part), strict=True))
        for i, pieces in waiting:
            out[i] += sum(map(memo.__getitem__, pieces))
        new.clear()
        waiting.clear()
        if len(memo) > MEMO_PIECES:
            memo.clear()

    for i, text in enumerate(texts):
        for j, part in enumerate(safe_parts(text, PART_CHARS)):
            pieces = safe_pieces(part)
            # all pieces but a text's first one stand behind a space
            pieces = [p if j + k == 0 else " " + p for k, p in enumerate(pieces)]
            new.update(dict.fromkeys(p for p in pieces if p not in memo))
            waiting.append((i, pieces))
            size += len(part)
            if size >= PART_CHARS:
                settle()
                size = 0
    settle()
    return out


def _balanced(parts: list[str]) -> Iterator[list[str]]:
    """Runs of parts of about BATCH_BYTES each."""
    at = size = 0
    for i, part in enumerate(parts):
        size += len(part.encode()) + 8
        if size >= BATCH_BYTES:
            yield parts[at : i + 1]
            at, size = i + 1, 0
    if at < len(parts):
        yield parts[at:]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(lengths(texts, path), pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
