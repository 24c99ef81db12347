"""SimHash near-duplicates through BK-trees.

Whole texts become 64-bit fingerprints of their word shingles. Distinct fingerprints are dealt into
shards of some thousands so that any two within the radius meet in one (they must agree on some of
the bit blocks). Each shard builds a BK-tree, whose children are keyed by their integer Hamming
distance to the parent, and its members descend it together, along the edges within the radius only.
A shard of more than TREE members is cut into trees of TREE: a tree is then searched by its own
members and by those of all later trees of the shard, so no task grows with a hot shard's square and
no pair is lost. A shard returns spanning links of what it connected, never all pairs, and stars join
the links to components.

`near_copies` finds texts whose sets of five-word shingles have a Jaccard likeness of 0.8 and more. Such
pairs differ in about 15 % of their bits, so it takes fingerprints of 256 bits, a radius of 62 and shards
that agree on sampled bits: as many samples as leave a pair at 0.8 unmet with probability `MISS` at most
(likelier pairs far more rarely). What the trees connect are candidates: whole shingle sets decide.

Defined results: null and empty texts have fingerprint zero and are linked like any other; equal
texts share a fingerprint and so a component; repeated rows do too; extra columns are ignored; an
empty table gives an empty table. A null doc_id gets a fingerprint but cannot name a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, comb, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.llm.common import columns, slices
from trawler.llm.components import components
from trawler.session import Scratch

#: Members of one BK-tree, and members of a node that it holds as a plain list.
TREE, LEAF = 4096, 8

#: For near copies: words of a shingle, likeness (a fraction), 64-bit words of a fingerprint, radius, chance of a miss, members of a tree
#: and of its leaves. At that radius an edge can be left out only in clusters, so leaves are larger and compared as blocks.
WORDS, LIKENESS, WIDTH, RADIUS, MISS, WIDE_TREE, WIDE_LEAF = 5, (4, 5), 4, 62, 1e-3, 2048, 128

#: Words whose hashes are held at once inside a Python worker.
MEMO = 1 << 17


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit set where over half of all shingle hashes, repeats included, set it."""
    words = text.encode().lower().split()  # of bytes, lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[: -shingle]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, fp long")


def shard_keys(radius: int, distinct: int, tree: int = TREE) -> list[list[tuple[int, int]]]:
    """For each kind of shard the bits (shift, width) on which its members agree.

    With b blocks, two fingerprints within the radius agree on b - radius of them at least. Of these
    blocks only as many bits make the key as give shards of about tree members; more blocks are used
    where so many fingerprints need longer keys. No choice loses a pair."""
    want = max(0, ceil(log2(max(distinct, 1) / tree))) if distinct > tree else 0
    blocks = next((b for b in range(radius + 1, 65) if 64 // b * (b - radius) >= want), radius + 4)
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        share = [want // len(chosen) + (i < want % len(chosen)) for i in range(len(chosen))]
        out.append([(edges[c], min(w, edges[c + 1] - edges[c])) for c, w in zip(chosen, share, strict=True) if w])
    return out


class Links:
    """A forest over the members of a shard."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, at: np.ndarray) -> np.ndarray:
        while (self.up[at] != (above := self.up[self.up[at]])).any():
            self.up[at] = above
        return self.up[at]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for all i: hook the larger root on the smaller until none differ."""
        while len(a):
            x, y = self.root(a), self.root(b)
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one or more words, given as (words, ...)."""
    out = np.bitwise_count(a[0] ^ b[0]).astype(np.uint16)
    for x, y in zip(a[1:], b[1:], strict=True):
        out += np.bitwise_count(x ^ y)
    return out


def connect(fps: np.ndarray, radius: int, links: Links, own: int | None = None, leaf: int = LEAF) -> int:
    """Join all pairs within the radius of which one at least is among the first own fingerprints (all by
    default): those make the BK-tree, and all descend it while it is built. Returns its depth.

    fps: (n,), or (words, n) for longer fingerprints. A node's first member is its pivot; the others hang
    below it by their distance. A child at distance d is searched by those whose distance to the pivot is
    within d - radius and d + radius: of the guests of the node by all such, of its own members by those of
    higher children, since the lower ones search them. A child whose searchers and members are all connected
    by then has nothing left to tell."""
    fps = fps.reshape(-1, fps.shape[-1])
    own = fps.shape[1] if own is None else own
    todo = [(np.arange(own), np.arange(own, fps.shape[1]), 1)]
    deepest = 0
    while todo:
        members, guests, depth = todo.pop()
        if depth > 1:
            roots = links.root(members)
            if (roots == roots[0]).all() and (links.root(guests) == roots[0]).all():
                continue
        deepest = max(deepest, depth)
        if len(members) <= leaf:
            mine = fps[:, members][:, :, None]
            a, b = np.nonzero(np.triu(distance(mine, mine.transpose(0, 2, 1)) <= radius, 1))
            links.join(members[a], members[b])
            for at in range(0, len(guests), 1 << 13):
                g = guests[at : at + (1 << 13)]
                a, b = np.nonzero(distance(mine, fps[:, g][:, None]) <= radius)
                links.join(members[a], g[b])
            continue
        pivot, rest = members[0], members[1:]
        edge, far = (distance(fps[:, of], fps[:, pivot, None]).astype(np.int64) for of in (rest, guests))
        by_edge, by_far = np.argsort(edge, kind="stable"), np.argsort(far, kind="stable")
        rest, edge, guests, far = rest[by_edge], edge[by_edge], guests[by_far], far[by_far]
        for of, apart in ((rest, edge), (guests, far)):
            close = of[: np.searchsorted(apart, radius, "right")]
            links.join(close, np.full(len(close), pivot))
        for d in np.unique(edge).tolist():
            begin, end, upto = np.searchsorted(edge, [d, d + 1, d + radius + 1])
            low, high = np.searchsorted(far, [d - radius, d + radius + 1])
            # copies of the pivot are joined to it already, and so are those that would find them
            if d and (end - begin > 1 or upto > end or high > low):
                todo.append((rest[begin:end], np.concatenate((rest[end:upto], guests[low:high])), depth + 1))
    return deepest


def _trees(batches: Iterator[pa.RecordBatch], place: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each tree as one table, from rows sorted by tree."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> Iterator[pa.Table]:
        marks = [table[c].to_numpy() for c in place]
        new = np.flatnonzero(np.any([p[1:] != p[:-1] for p in marks], axis=0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), table.num_rows], strict=True):
            yield table.slice(a, b - a)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = ([x.column(x.schema.names.index(c))[i].as_py() for c in place] for x, i in ((held[0], 0), (batch, -1)))
        if first != last:
            *whole, rest = cut(pa.Table.from_batches(held))
            yield from whole
            held = rest.to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held))


def _connected(tree: pa.Table, words: list[str], node: str, radius: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a tree and its guests, and the place of each one's root among them."""
    n = tree.num_rows
    links = Links(n)
    if n > 1:
        connect(np.array([tree[w].to_numpy().view(np.uint64) for w in words]), radius, links, n - int(tree["guest"].to_numpy().sum()), leaf)
    return tree[node].to_numpy(), links.root(np.arange(n))


def _spanning(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each tree's members and guests, from rows sorted by tree, members first."""
    for tree in _trees(batches, ("kind", "key", "chunk")):
        rep, root = _connected(tree, ["fp"], "rep", radius)
        child = np.flatnonzero(root != np.arange(len(rep)))
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root[child]])], ["u", "v"])


def in_trees(dealt: DataFrame, place: list[str], member: str, scratch: Scratch, tree: int = TREE) -> DataFrame:
    """dealt with chunk and guest: each row as a member of one tree of its shard, and as a guest of all trees before it.

    The hot shards, few as a rule, are a written table, so its size is known before the join is planned and dealt
    is not shuffled for it where it is small."""
    hot = dealt.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * tree)
    hot = hot.select(*place, F.ceil(F.col("_n") / tree).cast("int").alias("_trees"))
    own = F.coalesce(F.pmod(F.xxhash64(member, F.lit("tree")), "_trees"), F.lit(0)).cast("int")
    rows = dealt.join(scratch.keep(hot), place, "left").withColumn("_own", own)
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_own")))).withColumn("guest", F.col("chunk") < F.col("_own")).drop("_own", "_trees")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, fp long, component_id long): component_id is the smallest doc_id reachable over links
    between fingerprints that differ in at most radius bits."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, id_col, text_col, shingle))
    distinct = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    n = distinct.count()
    kinds = shard_keys(radius, n)
    shards = F.array(
        *(
            F.struct(
                F.lit(i).alias("kind"),
                sum(
                    (F.shiftleft(F.shiftrightunsigned("fp", a).bitwiseAND(2**width - 1), sum(w for _, w in parts[:k])) for k, (a, width) in enumerate(parts)),
                    F.lit(0).cast("long"),
                ).alias("key"),
            )
            for i, parts in enumerate(kinds)
        )
    )
    dealt = distinct.select(F.explode(shards).alias("s"), "fp", "rep").select("s.kind", "s.key", "fp", "rep")
    dealt = in_trees(dealt, ["kind", "key"], "fp", scratch).select("kind", "key", "chunk", "guest", "fp", "rep")
    tasks = max(8, ceil(n * len(kinds) / 50_000))
    links = dealt.repartition(tasks, "kind", "key", "chunk").sortWithinPartitions("kind", "key", "chunk", "guest", "rep")
    links = links.mapInArrow(lambda b: _spanning(b, radius), "u long, v long")
    found = components(links, scratch)
    named = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# --- near copies at a Jaccard likeness of 0.8

_PLACE = np.random.default_rng(42).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, memo: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles; a text of fewer words is one shingle."""
    memo = {} if memo is None else memo
    words = text.encode().lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w)
    a = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(a) - WORDS + 1
    out = a[:n] * _PLACE[0]
    for k in range(1, WORDS):
        out += a[k : k + n] * _PLACE[k]
    return np.unique(out)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of 64-bit hashes in WIDTH words: each word from the hashes mixed anew."""
    counts = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        lanes = []
        for lane in range(WIDTH):
            # the finalizer of splitmix64
            z = hashes[at : at + (1 << 14)] + np.uint64(0x9E3779B97F4A7C15 * (lane + 1) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            lanes.append(z ^ (z >> np.uint64(31)))
        counts += np.unpackbits(np.stack(lanes, 1).astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)


@lru_cache(maxsize=64)
def samples(bits: int) -> int:
    """How many samples of so many bits leave a pair at the likeness unmet, or beyond the radius, with probability MISS at most."""
    width, likeness = 64 * WIDTH, LIKENESS[0] / LIKENESS[1]
    p = acos(2 * likeness / (1 + likeness)) / pi  # the chance that a bit differs
    chance = [comb(width, d) * p**d * (1 - p) ** (width - d) for d in range(RADIUS + 1)]
    met = [comb(width - d, bits) / comb(width, bits) for d in range(RADIUS + 1)]
    able = lambda count: 1 - sum(chance) + sum(c * (1 - m) ** count for c, m in zip(chance, met, strict=True)) <= MISS
    high = 1
    while not able(high):
        high *= 2
    low = high // 2 + 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if able(middle) else (middle + 1, high)
    return low


_WIDE = [f"w{i}" for i in range(WIDTH)]


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for batch in batches:
        fps = np.array([wide_fingerprint(shingles(t.as_py() or "", memo)) for t in batch.column(2)], np.uint64).reshape(-1, WIDTH).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(WIDTH))], ["doc_id", "twin", *_WIDE])


def _sampled(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Each row once for each sample of bits, with the sample's number and bits as its key."""
    for batch in batches:
        words = np.stack([batch.column(1 + i).to_numpy() for i in range(WIDTH)], 1)
        on = np.unpackbits(words.astype(">i8").view(np.uint8), axis=1).astype(np.int64)
        for sample in range(samples(bits)):
            at = np.random.default_rng(sample).permutation(64 * WIDTH)[:bits]
            key = on[:, at] @ (np.int64(1) << np.arange(bits, dtype=np.int64)) + (np.int64(sample) << np.int64(40))
            yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["key", "twin", *_WIDE])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, leader, twin) of all that a tree connects to another one; the leader is the group's smallest member."""
    for tree in _trees(batches, ("key", "chunk")):
        twin, root = _connected(tree, _WIDE, "twin", RADIUS, WIDE_LEAF)
        size = np.bincount(root, minlength=len(twin))
        at = np.flatnonzero(size[root] > 1)
        if not len(at):
            continue
        lead = np.full(len(twin), 2**63 - 1)
        np.minimum.at(lead, root[at], twin[at])
        seed = xxhash.xxh64_intdigest(f"{tree['key'][0]} {tree['chunk'][0]}")
        group = ((root[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed)
        yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(lead[root[at]]), pa.array(twin[at])], ["group", "leader", "twin"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            held = [shingles(t.as_py() or "", memo).view(np.int64) for t in part.column(1)]
            offsets = pa.array(np.append(0, np.cumsum([len(h) for h in held])), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held)))], ["twin", "held"])


class _Sets:
    """Sets of shingles laid out so that one set is compared with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.size = np.array([len(s) for s in sets])
        self.start = np.append(0, np.cumsum(self.size)[:-1])
        self.mark = np.zeros(len(self.values), bool)

    def alike(self, one: np.ndarray, able: np.ndarray) -> np.ndarray:
        """Which of the able sets have the likeness to the given one."""
        over, under = LIKENESS
        able = able & (self.size * under >= len(one) * over) & (len(one) * under >= self.size * over)
        some = np.flatnonzero(able)
        if not len(some):
            return some
        at = np.searchsorted(self.values, one)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == one)]
        self.mark[at] = True
        if len(some) * 4 > len(self.size):
            same = np.add.reduceat(self.mark[self.flat], self.start, dtype=np.int64)[some]
        else:
            same = np.array([self.mark[self.flat[self.start[j] : self.start[j] + self.size[j]]].sum() for j in some])
        self.mark[at] = False
        return some[same * under >= (self.size[some] + len(one) - same) * over]


def compare(tree: pa.Table) -> tuple[list[int], list[int]]:
    """Links (u, v) between members of a tree, and between its members and guests, of the likeness at least: enough to
    connect all that are that like, given that rows of one label are connected already."""
    twin, label = tree["twin"].to_numpy(), tree["label"].to_numpy()
    own = tree.num_rows - int(tree["guest"].to_numpy().sum())
    held = tree["held"].combine_chunks()
    read = lambda i: held[i].values.to_numpy().view(np.uint64)
    sets = _Sets([read(i) for i in range(own)])
    links, every = Links(own), np.arange(own)
    first = {}
    for i, x in enumerate(label[:own].tolist()):
        first.setdefault(x, i)
    links.join(every, np.array([first[x] for x in label[:own].tolist()]))
    us, vs = [], []
    root = links.root(every)
    for i in range(own - 1):
        able = (root != root[i]) & (every > i)
        if able.any() and len(like := sets.alike(read(i), able)):
            us += twin[like].tolist()
            vs += [int(twin[i])] * len(like)
            links.join(like, np.full(len(like), i))
            root = links.root(every)
    for i in range(own, tree.num_rows):
        known = first.get(int(label[i]))
        able = np.ones(own, bool) if known is None else root != root[known]
        # one member of each component is tried before all
        for some in (np.isin(every, np.unique(root)), np.ones(own, bool)):
            if (able & some).any():
                like = sets.alike(read(i), able & some)
                us += twin[like].tolist()
                vs += [int(twin[i])] * len(like)
                able &= ~np.isin(root, root[like])
    return us, vs


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tree in _trees(batches, ("group", "chunk")):
        us, vs = compare(tree)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, twin, component) of every row: twin is the text's xxhash64, component the smallest twin reachable over
    likenesses of 0.8 and more between whole sets of five-word shingles.

    Every group that a tree of wide fingerprints connects is first held against its leader, one comparison for each member
    and leader however many trees met them. Only groups that this leaves in several components are compared inside."""
    scratch = scratch or Scratch(docs.sparkSession, "nearcopies")
    texts = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")
    longs = ", ".join(f"{w} long" for w in _WIDE)
    marked = scratch.keep(texts.mapInArrow(_wide, f"doc_id long, twin long, {longs}"))
    distinct = scratch.keep(marked.drop("doc_id").dropDuplicates(["twin"]))
    n = distinct.count()
    bits = max(0, ceil(log2(max(n, 1) / WIDE_TREE)))
    keyed = scratch.keep(distinct.select("twin", *_WIDE).mapInArrow(lambda b: _sampled(b, bits), f"key long, twin long, {longs}"))
    dealt = in_trees(keyed, ["key"], "twin", scratch, WIDE_TREE).select("key", "chunk", "guest", "twin", *_WIDE)
    tasks = max(8, ceil(n * samples(bits) / 50_000))
    groups = dealt.repartition(tasks, "key", "chunk").sortWithinPartitions("key", "chunk", "guest", "twin").mapInArrow(_groups, "group long, leader long, twin long")
    groups = scratch.keep(groups)
    sets = texts.select("twin", "text").join(groups.select("twin").distinct(), "twin", "left_semi").dropDuplicates(["twin"])
    sets = scratch.keep(sets.mapInArrow(_sets, "twin long, held array<long>"))
    pairs = scratch.keep(groups.where("twin <> leader").select("leader", "twin").distinct())
    both = pairs.join(sets, "twin").join(sets.select(F.col("twin").alias("leader"), F.col("held").alias("of")), "leader")
    same = F.size(F.array_intersect("held", "of"))
    like = same * LIKENESS[1] >= (F.size("held") + F.size("of") - same) * LIKENESS[0]
    links = scratch.keep(both.where(like).select(F.col("leader").alias("u"), F.col("twin").alias("v")))
    found = scratch.keep(components(links, scratch))
    labelled = scratch.keep(groups.join(found, groups.twin == found.node, "left").select("group", "twin", F.coalesce("component", "twin").alias("label")))
    # groups of the same members, met in several trees, are compared once
    whole = [F.bit_xor(F.xxhash64("twin", F.lit(i))).alias(f"whole{i}") for i in (0, 1)]
    open_ = labelled.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), *whole).where("low <> high")
    open_ = scratch.keep(open_.dropDuplicates(["n", "whole0", "whole1"]).select("group"))
    members = in_trees(scratch.keep(labelled.join(open_, "group")), ["group"], "twin", scratch, WIDE_TREE).select("group", "chunk", "guest", "twin", "label")
    inside = members.join(sets, "twin").repartition(max(8, ceil(sets.count() / 5_000)), "group", "chunk").sortWithinPartitions("group", "chunk", "guest", "twin")
    more = inside.mapInArrow(_compared, "u long, v long")
    found = scratch.keep(components(links.union(more), scratch))
    return marked.select("doc_id", "twin").join(found, F.col("twin") == found.node, "left").select("doc_id", "twin", F.coalesce("component", "twin").alias("component"))
