"""Every registered query of the training-text operators against plain Python on the smallest tables, column by column."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__
from tests.llm.test_set_ops import plain_components, plain_fingerprint
from tests.llm.test_text_ops import plain_base
from trawler.llm import mixing

SF = "/root/testdata/sf0.001"
KINDS = ("assign", "access", "hex")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name: str) -> dict:
    rows = __spark_entry__.queries()[name](spark, SF).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op3(spark, docs):
    got = result(spark, "op3_lpt_shards")
    assert got.keys() == docs.keys()
    loads, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for i, r in got.items():
        data = (docs[i].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 24
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[data].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(loads.values()) / 24
    for data, shards in groups.items():
        assert len(shards) == 1 or sum((d.text or "").encode() == data for d in docs.values()) * (len(data) + 8) > share
    assert max(loads.values()) <= max(share * 1.05, max(r.size for r in got.values()))


def test_op4(spark, docs):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, "op4_bpe_round_trip")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        text = docs[i].text or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op5(spark, docs):
    got = result(spark, "op5_toxicity")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    by_text = defaultdict(set)
    for i, r in got.items():
        by_text[docs[i].text].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


def test_op6(spark, docs):
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = result(spark, "op6_token_counts")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        n = len(model.encode(docs[i].text or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[i].text or "").encode()), n, n > 512)


def test_op8(spark, docs):
    got = result(spark, "op8_secret_spans")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        base = plain_base(docs[i].text or "")
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in base) for kind in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("crf:")] == listed
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def test_op9(spark, docs):
    got = result(spark, "op9_simhash_groups")
    prints = sorted((i, plain_fingerprint(d.text)) for i, d in docs.items())
    want = plain_components(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", want[i]) for i, f in prints}


def test_op10(spark, docs):
    got = result(spark, "op10_pivotal_mix")
    assert got.keys() == docs.keys()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most, taken = Counter(), Counter(), Counter()
    for d in docs.values():
        sizes[d.source] += count(d.text)
        most[d.source] = max(most[d.source], count(d.text))
    wanted = mixing.targets(dict(sizes))
    for i, r in got.items():
        d = docs[i]
        assert (r.size, r.source_size) == (count(d.text), sizes[d.source]) and r.target == pytest.approx(float(wanted[d.source]))
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[d.source] += r.taken
    assert all(abs(taken[s] - float(t)) <= most[s] for s, t in wanted.items())
    assert got == result(spark, "op10_pivotal_mix")
