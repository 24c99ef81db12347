"""The pipeline's near copies against brute force at Jaccard 0.8 over five-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from trawler.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """The smallest doc_id of each component."""
    sets, up = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {rows[i][0] for i in range(len(rows)) if root(i) == i}


def planted():
    """Originals, copies with one to eight words changed, so that likenesses lie on both sides of 0.8, and texts that share a half."""
    rng, rows = random.Random(5), []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((len(rows), " ".join(words)))
        for n in (1, 2, 4, 8):
            near = list(words)
            for at in rng.sample(range(len(near)), n):
                near[at] = f"new{g}x{at}"
            rows.append((len(rows), " ".join(near)))
        rows.append((len(rows), " ".join(words[: len(words) // 2] + [f"w{rng.randrange(3000)}" for _ in words[len(words) // 2 :]])))
    return rows


def test_stage_finds_every_near_copy_and_no_other(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    want = plain_kept(rows)
    assert 40 < len(want) < len(rows) and kept == want


def test_stage_on_driver_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == plain_kept(rows)


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(80)) for k in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (None, b), (None, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, c)], key=str)


@pytest.mark.parametrize("tree", [3, 64])
def test_small_trees_with_guests_lose_no_copy(spark, monkeypatch, tree):
    """A hot group spread over many trees, sampled by many bits, and compared inside."""
    monkeypatch.setattr(simhash, "WIDE_TREE", tree)
    rows = planted()[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in simhash.near_copies(docs).collect():
        got.setdefault(r.component, []).append(r.doc_id)
    assert {min(ids) for ids in got.values()} == plain_kept(rows)


def test_samples_meet_pairs_at_the_likeness():
    """Random pairs of sets at 0.8 are within the radius and share a sample, but for one in some hundreds at most."""
    rng = np.random.default_rng(0)
    for bits in (4, 8):
        taken = [np.random.default_rng(s).permutation(256)[:bits] for s in range(simhash.samples(bits))]
        missed = 0
        for _ in range(600):
            every = rng.integers(0, 2**64, 200, dtype=np.uint64)
            a, b = (simhash.wide_fingerprint(every[some]) for some in (slice(0, 180), slice(20, 200)))  # 160 of 200 in common
            on = [np.unpackbits(x.astype(">u8").view(np.uint8)) for x in (a, b)]
            near = int(simhash.distance(a, b)) <= simhash.RADIUS
            missed += not (near and any((on[0][t] == on[1][t]).all() for t in taken))
        assert missed <= 4


def test_sets_are_compared_with_members_and_guests():
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(60)]
    sets = []
    for _ in range(60):
        own = base[:50] if rng.random() < 0.5 else [rng.getrandbits(63) for _ in range(50)]
        sets.append(sorted({*own[rng.randint(0, 6) :], *(rng.getrandbits(63) for _ in range(rng.randint(0, 6)))}))
    for own in (1, 20, 60):
        columns = {"twin": range(60), "label": [100 + i // 3 for i in range(60)], "guest": [i >= own for i in range(60)], "held": pa.array(sets, pa.list_(pa.int64()))}
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        def linked(pairs):
            up.clear()
            for a, b in pairs:
                up[root(a)] = root(b)
            return [root(i) for i in range(60)]

        labels = [(i, 1000 + i // 3) for i in range(60)]
        like = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
        true = {(i, j) for i in range(60) for j in range(own) if i != j and like(sets[i], sets[j])}
        found = list(zip(*simhash.compare(pa.table(columns)), strict=True))
        assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in true}
        same = lambda roots: [[roots[i] == roots[j] for j in range(60)] for i in range(60)]
        assert same(linked([*found, *labels])) == same(linked([*true, *labels]))
