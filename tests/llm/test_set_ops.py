"""SpotSigs, KD-trees, sharding, line dedup, SimHash and mixing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawler.llm import kdtree, linededup, mixing, sharding, simhash, spotsigs
from trawler.llm.queries import op1_spotsigs


class Forest(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


# --- SpotSigs


def spots(text):
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    marked = ["" if w in spotsigs.ANCHORS else w for w in words]
    chains = {(w, *[x for x in marked[i + 1 : i + 1 + spotsigs.SPAN] if x][: spotsigs.CHAIN]) for i, w in enumerate(words) if not marked[i]}
    return chains or {text.lower()}


def test_spotsigs_against_plain_sets(spark, sample):
    _, rows = sample
    out = {r.doc_id: r for r in op1_spotsigs(spark, "/root/testdata/sf0.001").collect()}
    for (i, text, _), (_, following, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = spots(text), spots(edited), spots(following)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        assert len(r.fingerprint) == 8 * len(a)


def test_spotsigs_edges(spark, odd_docs, no_docs):
    out = spotsigs.fingerprint_documents(odd_docs).collect()
    assert len(out) == odd_docs.count() and spotsigs.fingerprint_documents(no_docs).count() == 0
    by_text = defaultdict(set)
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in out:
        by_text[texts[r.doc_id]].add(tuple(r.sigs))
        assert r.n_chars == len(texts[r.doc_id])
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_next_crosses_buckets_and_gaps(spark, most):
    rng = random.Random(5)
    ids = [rng.randint(-(2**62), 2**62) for _ in range(200)] + list(range(300)) + [2**63 - 1]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: (r.next_text, r.next_sigs) for r in spotsigs.with_next(docs, bucket_rows=3, most=most).collect()}
    order = sorted(ids)
    assert {i: t for i, (t, _) in got.items()} == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    sigs = {r.text: r.sigs for r in spotsigs.with_next(docs, bucket_rows=3, most=most).collect()}
    assert all(sigs[t] == s for t, s in got.values())


def test_next_of_rows_without_ids_and_of_one_row(spark):
    docs = spark.createDataFrame([(None, "y"), (3, "b"), (None, "x"), (1, "a"), (3, "b")], "doc_id long, text string")
    for rows in (1, 2, 9):
        got = sorted((str(r.doc_id), r.text, r.next_text) for r in spotsigs.with_next(docs, bucket_rows=rows).collect())
        assert got == [("1", "a", "b"), ("3", "b", "b"), ("3", "b", "x"), ("None", "x", "y"), ("None", "y", "a")]
    assert [r.next_text for r in spotsigs.with_next(docs.where("doc_id = 1")).collect()] == ["a"]


def test_one_far_id_leaves_buckets_small(spark):
    """Three thousand dense ids and one far off: buckets follow the rows, not the range."""
    ids = spark.range(3000).union(spark.createDataFrame([(2**60,)], "id long")).withColumnRenamed("id", "doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / 12 for i in range(1, 12)], 40960)).first()[0]
    sizes = [r["count"] for r in ids.withColumn("bucket", spotsigs._bucket(sorted(set(cuts)))).groupBy("bucket").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 300


def test_spotsigs_classes_of_a_hot_group(spark):
    """Four hundred near copies give four hundred rows of one class."""
    words = [f"the w{i}" for i in range(120)]
    rows = [(i, " ".join([*words, f"the x{i}"])) for i in range(400)] + [(900, "the lone text"), (901, "the lone text"), (None, "the lone text"), (None, "no id the")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in spotsigs.near_duplicates(spark.createDataFrame(rows[:-2], "doc_id long, text string")).collect()}
    assert got == {i: (0, 399) for i in range(400)} | {900: (900, 0), 901: (900, 0)}
    out = spotsigs.near_duplicates(spark.createDataFrame(rows[-4:], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in out) == [("900", "900"), ("901", "900"), ("None", "900"), ("None", "None")]


def test_spotsigs_join_finds_all_pairs(spark, sample):
    frame, rows = sample
    rng = random.Random(2)
    more = []
    for i, text, _ in rows[:30]:
        words = text.split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = "edited"
        more.append((10_000 + i, " ".join(words)))
    docs = frame.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    classes = defaultdict(list)
    for r in docs.collect():
        classes[frozenset(spots(r.text))].append(r.doc_id)
    sets = [(min(ids), s) for s, ids in classes.items()]
    want = {(min(a, b), max(a, b)) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if len(s & t) / len(s | t) >= 0.8}
    pairs, members = spotsigs.near_pairs(docs)
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 5
    assert {r.doc_id: r["class"] for r in members.collect()} == {i: min(ids) for ids in classes.values() for i in ids}
    forest = Forest()
    for a, b in want:
        forest.join(a, b)
    links = Counter(x for pair in want for x in pair)
    got = {r.doc_id: (r.class_id, r.n_links) for r in spotsigs.near_duplicates(docs).collect()}
    assert got == {i: (forest.root(min(ids)), links[min(ids)]) for ids in classes.values() for i in ids}


# --- exact top-k


def plain_top(rows, k, step):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def test_top_k_against_plain_search(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 90)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)] + [(2000, None), (2001, [1.0, None, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (2050, []), (2004, [3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    got = {tuple(r) for r in kdtree.top_k(frame, 5, 50).collect()}
    assert got == plain_top(rows, 5, 50)


def test_boxes_cut_shards_and_leaves():
    """Vectors of few dimensions in far clusters: a query visits few leaves."""
    rng = np.random.default_rng(7)
    rows = np.round(rng.normal(size=(40, 3)) * 1000)[rng.integers(0, 40, 4000)] + rng.integers(-5, 6, (4000, 3))
    tree = kdtree.Tree(np.arange(4000), rows)
    assert len(tree.leaves) >= 32 and all((np.diff(of) > 0).all() for of in tree.leaves)
    queries = rows[::50]
    exact = queries @ rows.T
    exact[np.arange(80), np.arange(0, 4000, 50)] = -np.inf
    want = [np.lexsort((np.arange(4000), -row))[:5].tolist() for row in exact]
    q, ids, scores = tree.search(queries, np.arange(0, 4000, 50), np.full(80, -np.inf), 5)
    assert [ids[q == i].tolist() for i in range(80)] == want and (scores == exact[q, ids]).all()
    kth = np.array([exact[i, want[i][-1]] for i in range(80)])
    assert (tree.bounds(queries) >= kth[:, None]).sum(1).mean() < len(tree.leaves) / 3


def test_top_k_edges(spark):
    shape = "vec_id long, embedding array<double>"
    assert kdtree.top_k(spark.createDataFrame([], shape)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], shape)
    assert [tuple(r) for r in kdtree.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    twice = spark.createDataFrame([(50, [3.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (100, [0.0, 1.0])], shape)
    got = sorted(tuple(r) for r in kdtree.top_k(twice).collect())
    assert got == [(50, 1, 1, 2 * 65536), (50, 2, 2, 65536), (50, 3, 100, 65536), (100, 1, 1, 2 * 65536), (100, 2, 2, 65536), (100, 3, 50, 65536), (100, 4, 50, 0)]
    large = spark.createDataFrame([(0, [1e9, 3.0]), (1, [1e9, 5.0]), (2, [1e9, 4.0])], shape)
    assert [r.vec_id for r in kdtree.top_k(large).orderBy("rank").collect()] == [1, 2]


# --- sharding


def test_schedule_equals_single_steps():
    rng = random.Random(8)
    for shards in (1, 3, 24):
        sizes = [rng.choice([9, 9, 10, 50, 700, 701]) for _ in range(300)]
        loads = [0] * shards
        for s in sorted(sizes, reverse=True):
            loads[loads.index(min(loads))] += s
        counts = Counter(sizes)
        got = [0] * shards
        for key, shard, a, b in sharding.schedule([(s, n, s * n) for s, n in counts.items()], shards):
            got[shard] += key * (b - a)
        assert sorted(got) == sorted(loads)


def test_shards(spark, sample, odd_docs, no_docs):
    frame, rows = sample
    docs = frame.select("doc_id", "text").union(spark.range(100_000, 101_500).select("id", F.lit("the same text again and again, a third of all rows " * 20)))
    out = sharding.shard_documents(docs, 24).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (out["size"] == out["text"].map(lambda t: len(t.encode()) + 8)).all() and (out["text_crc32"] == out["text"].map(lambda t: zlib.crc32(t.encode()))).all()
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.max() - loads.min() <= 0.02 * loads.mean()
    split = out.groupby("text")["shard"].nunique()
    share = out["size"].sum() / 24
    assert all(out[out["text"] == t]["size"].sum() > share for t in split[split > 1].index)
    assert sharding.shard_documents(odd_docs, 24).count() == odd_docs.count() and sharding.shard_documents(no_docs, 24).count() == 0


# --- line dedup


def plain_dedup(rows, least):
    """Every pair of positions is compared: a line goes if some run around it matches an earlier place."""
    lines = [(i, text.split("\n")) for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0])]
    first, gone = {}, defaultdict(set)
    for i, ls in lines:
        for a in range(len(ls)):
            n = 0
            for b in range(a, len(ls)):
                n += len(ls[b].split())
                if n >= least and first.setdefault(hash(tuple(ls[a : b + 1])), (i, a)) != (i, a):
                    gone[i] |= set(range(a, b + 1))
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup_against_plain_search(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 30)))) for i in range(120)]
    rows += [(500 + i, "\n".join(lines[3:9])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit(1)).withColumn("spans", F.lit("x"))
    out = linededup.drop_repeats(docs)
    assert {r.doc_id: r.text for r in out.collect()} == plain_dedup(rows, linededup.MIN_WORDS)
    assert out.columns[:4] == docs.columns


def test_line_dedup_edges(odd_docs, no_docs):
    out = linededup.drop_repeats(odd_docs)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = plain_dedup(rows, linededup.MIN_WORDS) | {None: "no id here at all"}
    assert out.count() == len(rows) and {r.doc_id: r.text for r in out.collect()} == want
    assert linededup.drop_repeats(no_docs).count() == 0


def test_line_dedup_with_clashing_names(spark):
    passage = "\n".join(f"line {i} " + "word " * 12 for i in range(6))
    rows = [(1, passage + "\nown"), (2, "before\n" + passage), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", 9, 9) for r in rows], "doc_id long, text string, _of string, _twin string, _RUNS string, _every string, _lines long, _removed long")
    out = {r.doc_id: r for r in linededup.drop_repeats(docs).collect()}
    assert {i: r.text for i, r in out.items()} == {1: passage + "\nown", 2: "before", 3: None, 4: ""}
    assert {i: (r._lines, r._removed) for i, r in out.items()} == {1: (7, 0), 2: (7, 6), 3: (0, 0), 4: (1, 0)}
    assert all((r._of, r._twin, r._RUNS, r._every) == ("a", "b", "c", "d") for r in out.values())


def test_runs_are_maximal_and_name_their_place(spark):
    lines = [f"{i} " + "w " * 20 for i in range(30)]
    rows = [(1, "\n".join(lines[:20])), (2, "\n".join(["x", *lines[3:15], "y", *lines[10:20]])), (3, "\n".join([*lines[16:30], *lines[0:6]])), (4, "\n".join(lines[24:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r["first"], r.stop, r.of_doc_id, r.of_first) for r in linededup.repeats(docs).collect()}
    assert got == {(2, 1, 13, 1, 3), (2, 14, 24, 1, 10), (3, 0, 4, 1, 16), (3, 14, 20, 1, 0), (4, 0, 6, 3, 8)}


def test_passage_and_line_in_every_text(spark):
    passage = [f"common {i} " + "z " * 15 for i in range(5)]
    rows = [(i, "\n".join(["the one line", f"own {i} " + f"v{i} " * 60, *(passage if i % 3 else []), "the one line"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.drop_repeats(docs).collect()} == plain_dedup(rows, linededup.MIN_WORDS)


def test_windows_select_their_minimum():
    rng = random.Random(1)
    for _ in range(100):
        text = "\n".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 20))) for _ in range(30))
        lines = text.split("\n")
        hashes = [xxhash.xxh64_intdigest(x.encode()) for x in lines]
        found = linededup.windows(text, 25)
        count = lambda a, b: sum(len(x.split()) for x in lines[a:b])
        for a, b, _, at in found:
            assert count(a, b) >= 25 and (count(a, b - 1) < 25 or count(a + 1, b) < 25)
            low = min(hashes[a:b])
            assert at == max(i for i in range(a, b) if hashes[i] == low)
        onward = {a: b for a, b, _, _ in reversed(found)}
        assert all(count(i, onward[i]) >= 25 > count(i, onward[i] - 1) for i in range(30) if count(i, 30) >= 25)


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(parts))


def plain_components(pairs):
    forest = Forest()
    for n, (i, f) in enumerate(pairs):
        forest.root(i)
        for j, g in pairs[:n]:
            if (f ^ g).bit_count() <= 4:
                forest.join(i, j)
    return {i: forest.root(i) for i, _ in pairs}


def test_simhash_components(spark, sample, odd_docs, no_docs):
    frame, rows = sample
    more = [(5000 + k, text + " tail" * (k % 3)) for k, (_, text, _) in enumerate(rows[:40])] + [(6000 + k, rows[3][1].replace("the", "a", k)) for k in range(60)]
    docs = frame.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.orderBy("doc_id").collect()]
    want = plain_components(prints)
    assert got == {i: (f, want[i]) for i, f in prints}
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count() and simhash.near_duplicates(no_docs).count() == 0


def test_bk_tree_equals_plain_comparison():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 6)).astype(np.uint64), initial=np.uint64(0)) for _ in range(900)], np.uint64)
    fps = np.unique(np.concatenate((base, base[rng.integers(0, 300, 900)] ^ flips, np.arange(200, dtype=np.uint64))))
    links = simhash.Links(len(fps))
    simhash.connect(fps, 4, links)
    want = plain_components([(i, int(f)) for i, f in enumerate(fps)])
    assert links.root(np.arange(len(fps))).tolist() == [want[i] for i in range(len(fps))]


def tight(count, seed=3):
    """Fingerprints in clusters within a few bits, and far apart ones."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, count // 2, dtype=np.uint64)
    near = base[rng.integers(0, len(base), count - len(base))].copy()
    for i in range(len(near)):
        for k in rng.choice(64, rng.integers(1, 8), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(k)
    return np.unique(np.concatenate((base, near)))


def plain_roots(fps, radius):
    forest = Forest()
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius).tolist():
            forest.join(i, j)
    return [forest.root(i) for i in range(len(fps))]


def test_bk_tree_of_thousands_is_descended_level_by_level():
    fps = tight(simhash.TREE)
    np.random.default_rng(1).shuffle(fps)
    links = simhash.Links(len(fps))
    assert simhash.connect(fps, 4, links) >= 3
    assert links.root(np.arange(len(fps))).tolist() == plain_roots(fps, 4)


@pytest.mark.parametrize("own", [0, 1, 7, 300, 700])
def test_guests_of_a_tree_meet_its_members_only(own):
    fps = tight(700, own)
    np.random.default_rng(own).shuffle(fps)
    links, forest = simhash.Links(len(fps)), Forest()
    simhash.connect(fps, 4, links, own)
    for i in range(own):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            forest.join(i, j)
    assert links.root(np.arange(len(fps))).tolist() == [forest.root(i) for i in range(len(fps))]


def test_main_path_on_shards_of_thousands(spark, monkeypatch):
    """Components of some thousand fingerprints equal plain comparison, in one tree and in hot shards cut into many."""
    from trawler.session import Scratch

    fps = tight(3000)
    texts = [(i, f"{int(f)}") for i, f in enumerate(fps)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    own = lambda d, *a: d.select("doc_id", F.col("text").cast("decimal(20,0)").alias("n")).selectExpr("doc_id", "CAST(n - CASE WHEN n > 9223372036854775807 THEN 18446744073709551616 ELSE 0 END AS LONG) AS fp")
    monkeypatch.setattr(simhash, "fingerprints", own)
    want = plain_roots(fps, 4)
    for tree in (simhash.TREE, 100):
        monkeypatch.setattr(simhash.in_trees, "__defaults__", (tree,))
        for keys in (simhash.TREE, 100):
            monkeypatch.setattr(simhash.shard_keys, "__defaults__", (keys,))
            got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, scratch=Scratch(spark, "t")).collect()}
            assert [got[i] for i in range(len(fps))] == want


def test_shards_of_fingerprints_lose_no_pair():
    rng = random.Random(9)
    for distinct in (0, 10, 10**4, 10**6, 10**10, 10**13):
        kinds = simhash.shard_keys(4, distinct)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), 4):
                b ^= 1 << k
            assert any(all((a >> s ^ b >> s) & (2**w - 1) == 0 for s, w in parts) for parts in kinds)


# --- mixing


def test_targets():
    got = mixing.targets({"b": 100, "a": 10, None: 1000, "c": 0})
    assert sum(got.values()) == 1110 and got["a"] == 30 and got["c"] == 0 and all(t <= 3 * s for t, s in zip(got.values(), (100, 10, 1000, 0), strict=False) if s == 100)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, part = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        out, held = mixing.pivotal(size, part, rng.random(40))
        open_ = [i for i in range(40) if 0 < out[i] < 1]
        assert open_ == ([held] if held >= 0 else []) and out @ size == pytest.approx(part @ size)
        total += out
    assert np.abs(total / 3000 - part).max() < 0.06


def test_mix(spark, sample, odd_docs, no_docs):
    frame, _ = sample
    a, b = (mixing.mix(frame).orderBy("doc_id").toPandas() for _ in range(2))
    assert a.equals(b)
    assert (a["copies"].between(0, 3)).all()
    for _, s in a.groupby("source"):
        assert abs((s["copies"] * s["size"]).sum() - s["target"].iloc[0]) <= s["size"].max()
    assert a.groupby("source")["target"].first().sum() == pytest.approx(a["size"].sum())
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mix(no_docs).count() == 0


def test_mix_reduces_through_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 9}") for i in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(out) == 600
    for _, s in out.groupby("source"):
        assert abs((s["copies"] * s["size"]).sum() - s["target"].iloc[0]) <= 7
