"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags every token of a text as outside a secret, its beginning or its inside, from the
token's shape, the shapes and words of the two tokens on either side and features of the whole text,
and is decoded by Viterbi over whole texts: transfer matrices of equal chunks of the token stream are
multiplied in max-plus algebra, so the sequential part is short whatever the length of a text. It is
trained on generated lines in which the place of the secret is known, and on a bounded sample of the
corpus (`sample_rows` texts, of any length) tagged by the fixed patterns: ids are chosen first, by a
combinable minimum, and windows around the matches are cut where the chosen texts lie, so that only
the features of at most `sample_rows` * 5 short windows reach the driver.

Defined results: null and empty texts hold no secrets; repeated rows give equal results; extra
columns are ignored; an empty table gives an empty table, tagged by a field trained on the generated
lines alone.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.llm.common import columns, slices

# The base patterns, the least length of what they must hold, and their order.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "crf")

#: Shortest span that the field may add, in characters.
ADDED_CHARS = 8

_TOKEN = re.compile(r"""[^\s"'`=:,;()<>\[\]{}]+|["'`=:,;()<>\[\]{}]""")
_PLAIN = re.compile(r"[^\W\d_]{1,24}[.!?]*\Z")
_CODE = ("{", "}", ";", "=>", "::", "()")
#: Looked for in lower-cased text: much cheaper than letting the pattern ignore case.
_NAMES = re.compile(r"passw|pwd|secret|token|api_?-?key|auth|bearer|credential|private|access_?key|client_?id")
_HEADS = ("AKIA", "sk-", "sk_", "pk_", "ghp_", "gho_", "xox", "AIza", "eyJ", "glpat", "SG.")
_FEATURES = (
    "punct quote assign plain plain_long upper_word name keyish number long_number mixed_short mixed_mid mixed_long hex_mid hex_long "
    "base64 entropy_3 entropy_4 digits_third upper_lower_digit head mail url dotted symbols repeated"
).split()
#: Words that are features of their own: those that stand before secrets, and before what only looks like one.
_WORDS = (
    "account api auth authorization aws basic bearer client cookie credential credentials key keys login passwd password private pwd secret session "
    "signature token user username access "
    "build checksum commit date digest hash id isbn md5 number order page phone ref sha sha1 sha256 serial tel uuid version"
).split()
_FEATURES += [f"word_{w}" for w in _WORDS]
_AT = {name: i for i, name in enumerate(_FEATURES)}
_WORD_AT = {w: _AT[f"word_{w}"] for w in _WORDS}
_SPOTS = (-2, -1, 0, 1, 2)
_FILE = 2  # features of the whole text: looks like code; names a credential
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by start, then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a maximal run shorter than 32 fails, so the runs of 32 and more are all that is left
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_LONG_HEX = re.compile(r"[0-9a-f]{32,}")


def shape(token: str) -> list[int]:
    """The features of one token."""
    if _PLAIN.match(token):
        on = ["plain"]
        if len(token) > 12:
            on.append("plain_long")
        if token.isupper() and len(token) > 1:
            on.append("upper_word")
        if _NAMES.search(token.lower()):
            on.append("name")
        word = _WORD_AT.get(token.rstrip(".!?").lower())
        return [_AT[x] for x in on] if word is None else [*(_AT[x] for x in on), word]
    on = []
    n = len(token)
    if n == 1 and not token.isalnum():
        on.append("quote" if token in "\"'`" else "assign" if token in "=:" else "punct")
    digits, uppers, lowers = (sum(map(f, token)) for f in (str.isdigit, str.isupper, str.islower))
    letters = uppers + lowers
    if _NAMES.search(token.lower()):
        on.append("name" if n <= 24 else "keyish")
    if digits and not letters:
        on.append("number" if n < 12 else "long_number")
    if digits and letters:
        on.append("mixed_short" if n < 8 else "mixed_mid" if n < 16 else "mixed_long")
        if uppers and lowers:
            on.append("upper_lower_digit")
        if digits * 3 >= n:
            on.append("digits_third")
    if n >= 12 and not set(token.lower()) - set("0123456789abcdef") and digits and letters:
        on.append("hex_mid" if n < 32 else "hex_long")
    if n >= 16 and digits and letters and token.isascii() and not set(token) - _B64:
        on.append("base64")
    if n >= 8 and not token.isalpha():
        entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
        if entropy >= 3:
            on.append("entropy_3")
        if entropy >= 4:
            on.append("entropy_4")
    if token.startswith(_HEADS):
        on.append("head")
    if "@" in token:
        on.append("mail")
    if "//" in token or token.startswith("www.") or "%" in token:
        on.append("url")
    if "." in token[1:-1]:
        on.append("dotted")
    if n > 1 and not letters and not digits:
        on.append("symbols")
    if n >= 6 and len(set(token)) <= 3:
        on.append("repeated")
    return [_AT[x] for x in on]


_B64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.")


def file_features(text: str) -> np.ndarray:
    """Whether the whole text looks like code (a mark in every 40 characters), and whether it names a credential."""
    return np.array([text != "" and 40 * sum(map(text.count, _CODE)) >= len(text), bool(_NAMES.search(text.lower()))], float)


#: Tokens whose shapes a worker remembers.
MEMO_TOKENS = 1 << 17


class Shapes(dict):
    """The number of each token's shape, found out once for each token."""

    def __init__(self):
        super().__init__()
        self.number: dict[tuple, int] = {}

    def __missing__(self, token: str) -> int:
        key = tuple(shape(token))
        self[token] = out = self.number.setdefault(key, len(self.number))
        return out

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


@dataclass
class Field:
    """weights: (spots * features + file features + bias, 3); moves: (3, 3); start: (3,)."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def parts(self, shapes: Shapes) -> np.ndarray:
        """What each shape gives to the scores of its own place and its neighbours': (shapes, spots, 3)."""
        k = len(_FEATURES)
        by_spot = self.weights[: len(_SPOTS) * k].reshape(len(_SPOTS), k, 3)
        return np.array([by_spot[:, list(key)].sum(1) for key in shapes.number]).reshape(-1, len(_SPOTS), 3)

    def emissions(self, parts: np.ndarray, at: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Scores (n, 3) of the tokens of one text, given by their shapes."""
        n = len(at)
        out = np.repeat((self.weights[-1] + file @ self.weights[-1 - _FILE : -1])[None], n, 0)
        for j, spot in enumerate(_SPOTS):
            # the token at place i + spot speaks for place i
            a, b = max(0, -spot), min(n, n - spot)
            if a < b:
                out[a:b] += parts[at[a + spot : b + spot], j]
        return out

    def tag(self, scores: np.ndarray, first: np.ndarray, chunk: int = 128) -> np.ndarray:
        """The best tags of texts laid end to end; first marks where a text begins."""
        n = len(scores)
        if not n:
            return np.zeros(0, np.int8)
        many = -(-n // chunk)
        pad = many * chunk - n
        e = np.concatenate((scores, np.zeros((pad, 3)))).reshape(many, chunk, 3)
        f = np.concatenate((first, np.zeros(pad, bool))).reshape(many, chunk)
        fresh = np.repeat(self.start[None], 3, 0)
        step = lambda t: np.where(f[:, t, None, None], fresh, self.moves)
        # transfer matrices: best score from any state before a chunk to any state at its end
        through = np.full((many, 3, 3), -1e18)
        through[:, range(3), range(3)] = 0.0
        for t in range(chunk):
            through = (through[:, :, :, None] + step(t)[:, None]).max(2) + e[:, t, None]
        enter, state = np.empty((many, 3)), [0.0, -1e18, -1e18]
        for c, m in enumerate(through.tolist()):
            enter[c] = state
            state = [max(state[s] + m[s][y] for s in range(3)) for y in range(3)]
            top = max(state)
            state = [x - top for x in state]
        back = np.empty((chunk, many, 3), np.int8)
        v = enter
        for t in range(chunk):
            options = v[:, :, None] + step(t)
            back[t] = options.argmax(1)
            v = options.max(1) + e[:, t]
        # tags are read from the end: for each state at a chunk's end, the state before the chunk
        rows = np.arange(many)
        path = np.repeat(np.arange(3, dtype=np.int8)[None], many, 0)
        for t in range(chunk - 1, -1, -1):
            path = np.take_along_axis(back[t], path.astype(np.int64), 1)
        ends = np.empty(many, np.int64)
        y = int(v[-1].argmax())
        for c in range(many - 1, -1, -1):
            ends[c] = y
            y = int(path[c, y])
        tags = np.empty((many, chunk), np.int8)
        y = ends
        for t in range(chunk - 1, -1, -1):
            tags[:, t] = y
            y = back[t][rows, y].astype(np.int64)
        return tags.reshape(-1)[:n]


def train(sequences: list[tuple[list, list[int], np.ndarray]], rounds: int = 120, decay: float = 0.02) -> Field:
    """Weights of greatest penalized likelihood for (tokens or their shapes, tags, file features), by full-batch
    gradient steps. Few distinct shapes make up all tokens, so scores and gradients go by shape."""
    sequences = [s for s in sequences if s[0]]
    m, t_max = len(sequences), max(len(s[0]) for s in sequences)
    k, edge = len(_FEATURES), max(_SPOTS)
    number: dict[tuple, int] = {(): 0}  # what lies outside a sequence has no features
    at, y, size = np.zeros((m, t_max + 2 * edge), np.int64), np.zeros((m, t_max), np.int64), np.zeros(m, np.int64)
    files = np.ones((m, _FILE + 1))
    for i, (tokens, tags, file) in enumerate(sequences):
        n = len(tokens)
        at[i, edge : edge + n] = [number.setdefault(tuple(shape(t) if isinstance(t, str) else t), len(number)) for t in tokens]
        y[i, :n], size[i], files[i, :_FILE] = tags, n, file
    on = np.zeros((len(number), k))
    for key, i in number.items():
        on[i, list(key)] = 1
    seen = [np.ascontiguousarray(at[:, edge + spot : edge + spot + t_max]) for spot in _SPOTS]
    real = np.arange(t_max)[None] < size[:, None]
    bar = -1e4  # an inside never starts a text nor follows an outside
    w, moves, start = np.zeros((len(_SPOTS) * k + _FILE + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    fixed_moves, fixed_start = np.zeros((3, 3), bool), np.array([False, False, True])
    fixed_moves[O, I] = True
    gold = np.eye(3)[y] * real[..., None]
    gold_moves = sum((gold[:, t - 1, :, None] * gold[:, t, None, :]).sum(0) for t in range(1, t_max))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, moves, start)]
    for r in range(1, rounds + 1):
        moves[fixed_moves], start[fixed_start] = bar, bar
        e = np.repeat((files @ w[-1 - _FILE :])[:, None], t_max, 1)
        for j, ids in enumerate(seen):
            e += (on @ w[j * k : (j + 1) * k])[ids]
        a, b = np.empty((m, t_max, 3)), np.zeros((m, t_max, 3))
        a[:, 0] = start + e[:, 0]
        lse = lambda z, axis: (top := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis))
        for t in range(1, t_max):
            a[:, t] = np.where(real[:, t, None], lse(a[:, t - 1, :, None] + moves, 1) + e[:, t], a[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            b[:, t] = np.where(real[:, t + 1, None], lse(moves + (e[:, t + 1] + b[:, t + 1])[:, None], 2), b[:, t + 1])
        total = lse(a[:, -1], 1)
        soft = np.exp(np.minimum(a + b - total[:, None, None], 0)) * real[..., None]
        pair = np.zeros((3, 3))
        for t in range(1, t_max):
            z = a[:, t - 1, :, None] + moves + (e[:, t] + b[:, t])[:, None] - total[:, None, None]
            pair += (np.exp(np.minimum(z, 0)) * real[:, t, None, None]).sum(0)
        off = gold - soft
        slope = np.empty_like(w)
        for j, ids in enumerate(seen):
            by_shape = np.stack([np.bincount(ids.ravel(), off[..., c].ravel(), len(number)) for c in range(3)], 1)
            slope[j * k : (j + 1) * k] = on.T @ by_shape
        slope[-1 - _FILE :] = files.T @ off.sum(1)
        grads = (
            slope - decay * m / 100 * w,
            gold_moves - pair - decay * m / 100 * np.where(fixed_moves, 0, moves),
            off[:, 0].sum(0) - decay * m / 100 * np.where(fixed_start, 0, start),
        )
        for p, g, (first, second) in zip((w, moves, start), grads, state, strict=True):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            p += 0.15 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
    moves[fixed_moves], start[fixed_start] = bar, bar
    return Field(w, moves, start)


def generated(count: int = 600, seed: int = 7) -> list[tuple[list[str], list[int], np.ndarray]]:
    """Lines with a secret at a known place, and lines that only look alike."""
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice("aeiounrtlsdm") for _ in range(rng.randint(2, 9)))
    run = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    mixed = lambda a, b: run(alnum, a, b) + rng.choice("0123456789") + rng.choice("ABCDEFGH")
    hexes = "0123456789abcdef"
    secrets = [
        lambda: mixed(18, 40), lambda: "ghp_" + mixed(30, 36), lambda: "sk-" + mixed(24, 48), lambda: "AKIA" + run(alnum[:26] + "0123456789", 14, 16),
        lambda: run(hexes, 32, 64), lambda: "eyJ" + mixed(20, 30) + "." + mixed(20, 60), lambda: "xoxb-" + run("0123456789", 10, 12) + "-" + mixed(16, 24),
        lambda: "AIza" + mixed(30, 33), lambda: run(hexes, 20, 31) + "9f",
    ]
    names = ["client_secret", "access_key", "auth_token", "private_key", "Authorization", "credentials", "pwd", "token", "api-key", "secret"]
    harmless = [
        lambda: run("0123456789", 8, 16), lambda: f"{word()}@{word()}.example.com", lambda: f"https://{word()}.example.org/{word()}", lambda: f"{word()}-{rng.randint(1, 99)}",
        lambda: word().upper(), lambda: f"({rng.randint(100, 999)})", lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", lambda: word() * 4,
        lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: word() + rng.choice(["***", "&&&", "!!", "%%%"]), lambda: word().capitalize() + ".",
    ]
    out = []
    for i in range(count):
        before, after = ([word() for _ in range(rng.randint(2, 9))] for _ in range(2))
        secret: list[str] = []
        if i % 2:
            value = rng.choice(secrets)()
            lead = rng.choice([[rng.choice(names), "=", '"'], [rng.choice(names), ":"], [rng.choice(names), "="], ["Bearer"], [rng.choice(names), ":", "'"], [rng.choice(names)]])
            before, secret, after = before + lead, [value], (['"'] if lead[-1] == '"' else ["'"] if lead[-1] == "'" else []) + after
        else:
            before += rng.choice([[rng.choice(names), "of"], [word(), ":"], [word(), "="], []]) + [rng.choice(harmless)()]
        for side in (before, after):
            for j in range(len(side)):
                if side[j].isalpha() and rng.random() < 0.1:
                    side[j] = rng.choice(harmless)()
        text = " ".join(before + secret + after)
        tokens, tags = [], []
        for part, mark in ((before, False), (secret, True), (after, False)):
            for piece in part:
                found = _TOKEN.findall(piece)
                tokens += found
                tags += [(B if j == 0 else I) if mark else O for j in range(len(found))]
        out.append((tokens, tags, file_features(text)))
    return out


def sampled(text: str, reach: int = 20) -> list[tuple[list[list[int]], list[int], np.ndarray]]:
    """Windows of a real text around its first four base matches, tagged by them, and one elsewhere in it, as
    (shapes, tags, file features)."""
    found = list(_TOKEN.finditer(text))
    held = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    held = _apart(held + [(a, b) for kind, a, b in base_spans(text) if kind != "assign"])
    starts = np.array([m.start() for m in found] or [0])
    tags = np.zeros(len(found), np.int64)
    for a, b in held:
        i = int(np.searchsorted(starts, a))
        begins = True
        while i < len(found) and found[i].end() <= b:
            tags[i], begins = (B if begins else I), False
            i += 1
    file = file_features(text)
    out = []
    for i in [*np.flatnonzero(tags == B)[:4].tolist(), len(found) // 3]:
        a, b = max(0, i - reach), min(len(found), i + reach)
        out.append(([shape(m[0]) for m in found[a:b]], tags[a:b].tolist(), file))
    return out


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, without those that overlap an earlier one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _meets(united: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps any of the united spans."""
    i = bisect_left(united, (b,)) - 1
    return i >= 0 and united[i][1] > a


WINDOWS = "doc_id long, shapes array<array<int>>, tags array<int>, file array<double>"


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400) -> Field:
    """A field trained on generated lines and on windows of at most sample_rows texts, by hash of doc_id:
    half from all rows, half from those that hold the name of a credential. Of rows that share a doc_id,
    the smallest text stands for all."""
    rows = columns(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null")
    order, half = F.xxhash64("doc_id"), sample_rows // 2
    place = F.struct(order.alias("order"), "doc_id")
    named = F.col("text").rlike(r"(?i)(?:token|secret|passw|api_?key|AKIA)[\"']?\s*[:=]")
    picks = rows.groupBy(F.pmod(order, F.lit(half))).agg(F.min(place)["doc_id"].alias("any"), F.min(F.when(named, place))["doc_id"].alias("named"))
    chosen = sorted({i for r in picks.select("any", "named").collect() for i in r if i is not None})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            out = [(key, *w) for key, text in zip(keys, texts, strict=True) for w in sampled(text)]
            data = [[w[i] for w in out] for i in range(4)]
            kinds = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds, strict=True)], ["doc_id", "shapes", "tags", "file"])

    texts = rows.where(F.col("doc_id").isin(chosen)).groupBy("doc_id").agg(F.min("text").alias("text"))
    real = texts.mapInArrow(cut, WINDOWS).collect() if chosen else []
    # a text's windows come in their order, so a stable sort by text is the same in every run
    return train(generated() + [(r.shapes, r.tags, np.array(r.file)) for r in sorted(real, key=lambda r: r.doc_id)])


_BLANK = re.compile(r"\s")


def _tokens(text: str, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The tokens of a text, by parts of about limit characters that end at a blank; no token holds one."""
    at = 0
    while len(text) - at > limit and (blank := _BLANK.search(text, at + limit)):
        yield _TOKEN.findall(text, at, blank.start())
        at = blank.end()
    yield _TOKEN.findall(text, at)


def find(texts: list[str], field: Field, shapes: Shapes | None = None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of all secrets of every text: the base spans, and what the field adds beside them."""
    shapes = Shapes() if shapes is None else shapes
    used = [np.concatenate([shapes.of(part) for part in _tokens(text)]) for text in texts]
    parts = field.parts(shapes)
    scores = [field.emissions(parts, at, file_features(text)) for at, text in zip(used, texts, strict=True)]
    if len(shapes) > MEMO_TOKENS:
        shapes.clear()
    sizes = np.array([len(s) for s in scores])
    bounds = np.append(0, np.cumsum(sizes))
    first = np.zeros(bounds[-1] + 1, bool)
    first[bounds[:-1]] = True
    tags = field.tag(np.concatenate(scores) if len(scores) else np.zeros((0, 3)), first[:-1])
    out = []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        mine = tags[bounds[i] : bounds[i + 1]]
        if mine.any():
            at = {j: m.span() for j, m in enumerate(_TOKEN.finditer(text)) if mine[j]}
            taken = _united([s[1:] for s in spans])
            for j in np.flatnonzero(mine == B).tolist():
                k = j + 1
                while k < len(mine) and mine[k] == I:
                    k += 1
                a, b = at[j][0], at[k - 1][1]
                if b - a >= ADDED_CHARS and not _meets(taken, a, b):
                    spans.append(("crf", a, b))
            spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        out.append(spans)
    return out


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): code points, end exclusive, by start, then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for keys, texts in slices(batches):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in of] for of in find(texts, field, shapes)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
