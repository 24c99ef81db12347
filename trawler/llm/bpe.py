"""Byte-level BPE encoding and decoding by replaying the merges over a stretch of the corpus at a time.

The distinct words that a stretch adds to those a worker already knows are laid out as one array of
byte tokens. An inverted index maps the rank of every mergeable neighbour pair to its positions in
words; ranks are applied in ascending order over all words at once, and a merge recomputes only the
two pairs that touch it. A bounded memo keeps the ids of words met before, so a worker replays a word
once, not once for every stretch. Memory is bounded by the stretch, the memo and the longest text;
long texts are worked on part by part, cut at spaces where no token can span.

Defined results: null and empty texts give no tokens (ids_sha256 and decoded_sha256 are then of the
empty string); repeated rows give equal results; extra columns are ignored; an empty table gives an
empty table; very long words cost time and memory in proportion to their length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trawler.llm.common import columns, safe_parts, safe_pieces, slices

_NONE = np.int32(2**31 - 1)
_SHIFT = 24

#: Characters of the texts and parts that are encoded together, and pieces that a worker remembers.
STRETCH, MEMO_PIECES = 1 << 21, 1 << 17

#: Ids of a text that are spelled out and decoded at once.
DIGEST_IDS = 1 << 16


class MergeTable:
    """The ranks of a .tiktoken file, with every pair of tokens that joins into a third."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        self.token = {rank: word for word, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left = ranks.get(word[:cut])
                if left is not None and (right := ranks.get(word[cut:])) is not None:
                    keys.append(left << _SHIFT | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.made = np.append(np.array(made, np.int32)[order], _NONE)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair joins into, _NONE where it joins into none."""
        key = left.astype(np.int64) << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], _NONE)


@functools.lru_cache(maxsize=4)
def merge_table(path: str, pattern: str) -> MergeTable:
    """One table per worker process and file."""
    return MergeTable(path, pattern)


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after another, and the number of ids of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    token = table.byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    if not n:
        return token, np.zeros(len(words), np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(sizes[sizes > 0])
    after[ends - 1] = -1
    before[ends[:-1]] = -1
    pair, dead = np.full(n, _NONE, np.int32), np.zeros(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(at: np.ndarray) -> None:
        """Enter the pairs that start at these positions into the index under their present rank."""
        ranks = pair[at]
        at, ranks = at[ranks != _NONE], ranks[ranks != _NONE]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])).tolist()
        for r, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heappush(heap, r)

    first = np.flatnonzero(after >= 0).astype(np.int32)
    pair[first] = table.rank(token[first], token[after[first]])
    post(first)
    while heap:
        r = heappop(heap)
        at = index.pop(r)
        at = np.sort(at[0] if len(at) == 1 else np.concatenate(at))
        at = at[pair[at] == r]
        if len(at) > 1:
            at = at[np.append(True, at[1:] != at[:-1])]
            at = _apart(at, after)
            at, later = _in_order(at, r, token, after, before, word, table)
            if len(later):
                index[r] = [later]
                heappush(heap, r)
        elif not len(at):
            continue
        gone = after[at]
        right = after[gone]
        token[at], pair[gone], dead[gone], after[at] = r, _NONE, True, right
        has = right >= 0
        before[right[has]] = at[has]
        left = before[at]
        touched = np.concatenate((left[left >= 0], at))
        to = after[touched]
        pair[touched] = np.where(to >= 0, table.rank(token[touched], token[to]), _NONE)
        post(touched)
    return token[~dead], np.bincount(word[~dead], minlength=len(words))


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in a run (as in aaaa), every second one from the left."""
    chained = np.append(False, after[at[:-1]] == at[1:])
    if not chained.any():
        return at
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(chained, 0, place))
    return at[(place - start) % 2 == 0]


def _in_order(at, r, token, after, before, word, table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to join now, and those to hold back: where joining one makes a pair of lower rank in a
    word with several, that lower pair comes first, so only the leftmost is joined."""
    same = word[at][1:] == word[at][:-1]
    if not same.any():
        return at, at[:0]
    several = np.append(False, same) | np.append(same, False)
    some = at[several]
    left, right = before[some], after[after[some]]
    mine = np.full(len(some), r, np.int32)
    low = np.minimum(
        np.where(left >= 0, table.rank(token[left], mine), _NONE), np.where(right >= 0, table.rank(mine, token[right]), _NONE)
    )
    low = np.minimum(low, table.rank(mine[:1], mine[:1])[0]) < r
    if not low.any():
        return at, at[:0]
    held = np.isin(word[at], np.unique(word[some[low]])) & np.append(False, same)
    return at[~held], at[held]


class Encoder:
    """Encodes texts by one table; the ids of the pieces met so far lie one after another in one array."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.forget()

    def forget(self) -> None:
        self.number: dict[object, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _use(self, part: str, opens: bool, new: list) -> np.ndarray:
        """The numbers of a part's pieces; pieces not met before are appended to new. The piece that opens
        a text has no space before it, so it is another key than the same letters later on."""
        number = self.number
        keys: list = safe_pieces(part)
        if opens:
            keys[0] = (keys[0],)
        for key in keys:
            if key not in number:
                number[key] = len(number)
                new.append(key)
        return np.fromiter(map(number.__getitem__, keys), np.int32, len(keys))

    def _learn(self, new: list) -> None:
        """Replay the merges over all words of the new pieces."""
        words: list[bytes] = []
        held = []
        for key in new:
            piece = key[0] if type(key) is tuple else f" {key}"
            if piece.isalpha() or type(key) is str and key.isalpha():
                words.append(piece.encode())
                held.append(1)
            else:
                found = [w.encode() for w in self.table.pattern.findall(piece)]
                words += found
                held.append(len(found))
        ids, sizes = replay(words, self.table)
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(held)]
        self.bounds = np.append(self.bounds, len(self.ids) + ends)
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of every text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        new, waiting, size = [], [], 0

        def settle() -> None:
            if new:
                self._learn(new)
            for i, of in waiting:
                begin = self.bounds[of]
                count = self.bounds[of + 1] - begin
                stop = np.cumsum(count)
                out[i].append(self.ids[np.repeat(begin - (stop - count), count) + np.arange(stop[-1])])
            new.clear()
            waiting.clear()
            if len(self.number) > MEMO_PIECES:
                self.forget()

        for i, text in enumerate(texts):
            for j, part in enumerate(safe_parts(text, STRETCH)):
                waiting.append((i, self._use(part, j == 0, new)))
                size += len(part)
                if size >= STRETCH:
                    settle()
                    size = 0
        if waiting:
            settle()
        return [np.concatenate(of) if len(of) != 1 else of[0] for of in out]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(merge_table(path, pattern))


def encode(texts: list[str], table: MergeTable) -> list[list[int]]:
    """The token ids of every text, by an encoder that knows no word yet."""
    return [ids.tolist() for ids in Encoder(table).encode(texts)]


def decode(ids: list[int], table: MergeTable) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(table.token.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, as the rank file's library would give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for keys, texts in slices(batches, STRETCH):
            coded = coder.encode(texts)
            offsets = pa.array(np.append(0, np.cumsum([len(ids) for ids in coded])), pa.int32())
            held = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(coded), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), held], ["doc_id", "ids"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes of every row's ids; a null list decodes to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(path, pattern)
        for batch in batches:
            data = [decode(ids or [], table) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(data, pa.binary())], ["doc_id", "data"])

    return columns(coded, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, and digest both in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        table = coder.table
        digits = {i: str(i) for i in table.token}
        for keys, texts in slices(batches, STRETCH):
            counts, listed, decoded = [], [], []
            for ids in coder.encode(texts):
                spelled, data = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), DIGEST_IDS):
                    some = ids[at : at + DIGEST_IDS].tolist()
                    spelled.update((("," if at else "") + ",".join(map(digits.__getitem__, some))).encode())
                    data.update(decode(some, table))
                counts.append(len(ids))
                listed.append(spelled.hexdigest())
                decoded.append(data.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
