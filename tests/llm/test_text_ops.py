"""Byte-level BPE, token counts, toxicity and secret scans."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trawler.llm import bpe, common, secrets, tokens, toxicity

PATH = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", "a" * 5000, "ab" * 3000, "  a  b \n\n c\t\td  ", " ", "\n", "x\n y", "it's we'll  's", "\x1c a\x1cb  \x85 \xa0x", "<|endoftext|> hi", "1²3½ Ⅷ x", "日本語テキスト。", "abcabcabc" * 500, "thethethe" * 700]


def test_replay_equals_library(library):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab \n\tthe's1é.") for _ in range(200)) for _ in range(300)] + ["".join(rng.choice("abcdehstn") for _ in range(300)) for _ in range(300)]
    table = bpe.merge_table(PATH, P.PATTERN)
    assert bpe.encode(texts, table) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("stretch, memo", [(1, 1), (7, 40), (60, 5), (1 << 21, 1 << 17)])
def test_encoder_equals_library_for_any_stretch_and_memo(library, monkeypatch, stretch, memo):
    monkeypatch.setattr(bpe, "STRETCH", stretch)
    monkeypatch.setattr(bpe, "MEMO_PIECES", memo)
    rng = random.Random(2)
    texts = [t[:900] for t in HARD] + ["".join(rng.choice("ab  \n\tthe's1é.") for _ in range(300)) for _ in range(60)]
    coder = bpe.Encoder(bpe.merge_table(PATH, P.PATTERN))
    for _ in range(2):
        assert [ids.tolist() for ids in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_slices_are_bounded_by_bytes():
    texts = ["é" * 10, None, "", "x" * 100, "ab", "cd"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0), batch.slice(3, 4)]), 24))
    assert [t for _, of in parts for t in of] == [t or "" for t in texts + texts[3:7]]
    assert all(len(of) == 1 or sum(len(t.encode()) for t in of[:-1]) < 24 for _, of in parts)


def test_parts_are_the_text_without_the_cut_spaces():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n") for _ in range(60))
        parts = list(common.safe_parts(text, rng.randint(1, 20)))
        assert " ".join(parts) == text
        first, *rest = common.safe_pieces(text)
        again = [p for part in parts for p in common.safe_pieces(part)]
        assert again == [first, *rest]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=5))
def test_replay_equals_library_on_any_text(library, texts):
    table = bpe.merge_table(PATH, P.PATTERN)
    coded = bpe.encode(texts, table)
    assert coded == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode(ids, table).decode() for ids in coded] == texts


def test_round_trip_query(spark, odd_docs, no_docs, library):
    out = bpe.round_trip(odd_docs, PATH, P.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(out) == odd_docs.count()
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(no_docs, PATH, P.PATTERN).count() == 0
    coded = bpe.encode_documents(odd_docs, PATH, P.PATTERN)
    data = {r.doc_id: bytes(r.data).decode() for r in bpe.decode_documents(coded, PATH, P.PATTERN).collect()}
    assert data == texts


def test_counts_equal_library(odd_docs, no_docs):
    model = Tokenizer.from_file(JSON)
    texts = HARD + ["a <|endoftext|><|endoftext|> b", "x <|endoftext|>y"]
    assert tokens.lengths(texts, JSON) == [len(e) for e in model.encode_batch(texts, add_special_tokens=False)]
    out = tokens.token_counts(odd_docs, JSON).collect()
    want = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(out) == odd_docs.count()
    for r in out:
        assert (r.n_bytes, r.n_tokens) == (len(want[r.doc_id].encode()), len(model.encode(want[r.doc_id], add_special_tokens=False)))
    assert tokens.token_counts(no_docs, JSON).count() == 0


def test_counts_of_parts_and_of_models_that_cannot_be_cut(monkeypatch):
    model = Tokenizer.from_file(JSON)
    texts = HARD + ["a <|endoftext|><|endoftext|> b", "x  <|endoftext|> y " * 40]
    want = [len(e) for e in model.encode_batch(texts, add_special_tokens=False)]
    for chars, memo in ((1, 1), (30, 10)):
        monkeypatch.setattr(tokens, "PART_CHARS", chars)
        monkeypatch.setattr(tokens, "MEMO_PIECES", memo)
        assert tokens.lengths(texts, JSON) == want
    spec = json.loads(model.to_str())
    assert tokens.cuttable(spec) and not tokens.cuttable(spec | {"normalizer": {"type": "NFKC"}}) and not tokens.cuttable(spec | {"pre_tokenizer": {"type": "Whitespace"}})
    added = {"content": "<x>", "lstrip": True, "rstrip": False, "single_word": False, "normalized": False}
    assert not tokens.cuttable(spec | {"added_tokens": [added]}) and tokens.cuttable(spec | {"added_tokens": [added | {"lstrip": False}]})
    assert [b for b in tokens._balanced(["é" * 200_000, "a", "b"])] == [["é" * 200_000], ["a", "b"]]


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcd", max_size=7), st.lists(st.text("abcd", min_size=1, max_size=6), min_size=1, max_size=6, unique=True), st.integers(0, 2))
def test_automaton_equals_edit_distance(word, terms, k):
    best = min((edits(word, t), t) for t in terms)
    assert toxicity.FuzzyTrie(dict.fromkeys(terms, k), []).find(word) == ((best[1], best[0]) if best[0] <= k else None)


def test_quotation_and_misspelling():
    model = toxicity.Model({"worthless": 4.0, "idiot": 4.0, "lowei*": 4.0})
    score = lambda t: float(model.score(np.array([model.featurize(h) for h in model.hits([t])]))[0])
    assert score("you idiot") > 0.5 and score("you idiott, worthles fool") > 0.5 and score("ein loweischaft") > 0.5
    assert score('he said "idiot" once') < score("what an idiot once")
    assert score("a calm line") < 0.5 and score("") == score("nothing here")


@pytest.mark.parametrize("n", [60, 20_000])
def test_weights_settle_on_separable_rows(n):
    rng = np.random.default_rng(n)
    y = (rng.random(n) < 0.1).astype(float)
    x = np.zeros((n, 7))
    x[:, 0], x[:, 1], x[:, 5] = 1, y * 3 * (rng.random(n) < 0.9), y * 1.2
    w = toxicity.fit_weights(x, y)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(w).max() < 30 and (n < 100 or ((p >= 0.5) == (y > 0)).all())


def test_stems_stand_for_many_forms_only(spark):
    counts = [("pathetic", 50, 0), ("path*", 50, 0), ("pathe*", 50, 0), ("lowei*", 60, 0), ("lowe*", 60, 40), ("loweia", 20, 0), ("loweib", 22, 0), ("the", 100, 900)]
    evident = toxicity._evident(spark.createDataFrame(counts, "term string, a long, b long"), 100, 900)
    assert {(t, lead) for t, _, _, lead in evident} == {("pathetic", 0), ("path*", 50), ("pathe*", 50), ("lowei*", 22), ("loweia", 0), ("loweib", 0)}
    assert set(toxicity.learn_terms(evident, 100, 900)) == {"pathetic", "lowei*"}


def plain_score(text, terms, strict, weights):
    """The score by its definition: every word against every term, every window read anew."""
    tokens, hits = text.lower().split(), []
    for i, token in enumerate(tokens):
        best = None
        for word in re.findall(r"[^\W_]+", token):
            near = []
            for term in terms:
                if term.endswith("*"):
                    near += [(0, term[:-1])] if word.startswith(term[:-1]) else []
                elif (e := edits(word, term)) <= (0 if term in strict else (len(term) >= 5) + (len(term) >= 9)):
                    near.append((e, term))
            if near and (best is None or min(near)[0] < best[0]):
                best = min(near)
        if best:
            opened = sum(c in toxicity.QUOTES for t in tokens[max(0, i - 8) : i] for c in t) + (token[0] in toxicity.QUOTES)
            closed = any(c in toxicity.QUOTES for c in token[1:]) or any(c in toxicity.QUOTES for t in tokens[i + 1 : i + 9] for c in t)
            said = any(t.strip(".,:;!?\"'“”„«»()") in toxicity.REPORTING for t in tokens[max(0, i - 4) : i])
            hits.append((best[1], best[0], i, opened % 2 == 1 and closed or said))
    kinds = [sum(1 for _, e, _, q in hits if (e > 0, q) == kind) for kind in ((False, False), (False, True), (True, False), (True, True))]
    open_ = [(t, e, i) for t, e, i, q in hits if not q]
    strongest = max((terms.get(t, terms.get(t + "*", 0)) / (1 + e) for t, e, _ in open_), default=0.0)
    close = sum(b[2] - a[2] <= 8 for a, b in zip(open_, open_[1:]))
    x = [*(min(np.log2(1 + n), 3) for n in kinds), strongest / 4, min(np.log2(1 + close), 3)]
    return 1 / (1 + np.exp(-(weights[0] + np.dot(weights[1:], x))))


def test_scores_equal_plain_search(spark):
    terms = {"worthless": 4.0, "idiot": 3.5, "moron": 3.0, "lowei*": 4.0, "gronk": 5.0}
    model = toxicity.Model(terms, frozenset({"moron"}))
    rng = random.Random(12)
    pool = ["idiot", "idiott", "IDIOT!", '"idiot"', "worthles", "wrthlss", "worthless,", "moron", "morron", "loweikram", "gronk_idiot", "said", "„", '"', "a", "calm", "line", "wrote:", "idio", "gron-k", "é"]
    texts = ["", " ", *(" ".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(250))]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(text, terms, model.strict, model.weights)), text


def test_fit_learns_and_holds_out(spark, odd_docs, no_docs):
    rng = random.Random(3)
    calm = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(calm) for _ in range(40)) + (" gronk blarg" if i % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.5) == (i % 5 == 0) for i, s in scores.items())
    assert toxicity.score(docs, model).where("score < 0 or score > 1").count() == 0
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i in range(300) if i % 5}
    assert toxicity.score(odd_docs, model).count() == odd_docs.count() and toxicity.score(no_docs, model).count() == 0
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns and toxicity.keep_clean(no_docs, model).count() == 0
    assert toxicity.fit(no_docs, labels).terms == {}


def plain_base(text):
    out = []
    for kind, rx, least, group in (("assign", secrets.ASSIGN, 8, 2), ("access", secrets.ACCESS, 16, 0), ("hex", secrets.HEX, 32, 0)):
        out += [(kind, m.start(), m.end()) for m in rx.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token=", "SECRET : ", "apikey\"='", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "x", " ", "\n", "ſecret=abcdefghi", "pa", "passwd:", "="]), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def crf():
    return secrets.train(secrets.generated())


def test_viterbi_equals_plain_decoding(crf):
    rng = np.random.default_rng(0)
    for n in (1, 2, 127, 128, 129, 1000):
        scores, first = rng.normal(size=(n, 3)) * 3, rng.random(n) < 0.05
        first[0] = True
        v, back = crf.start + scores[0], []
        for i in range(1, n):
            options = v[:, None] + (np.repeat(crf.start[None], 3, 0) if first[i] else crf.moves)
            back.append(options.argmax(0))
            v = options.max(0) + scores[i]
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert path[::-1] == crf.tag(scores, first).tolist()


def test_field_adds_spans_and_spares_clean_text(spark, crf, odd_docs, no_docs):
    text = 'curl with Bearer ghp_aBcD1234eFgH5678iJkL9012mNoP3456qRsT and then client_key = "sk-9aBcD1234eFgH5678iJkL9012mN" now'
    found = [text[a:b] for kind, a, b in secrets.find([text], crf)[0] if kind == "crf"]
    assert found == ["ghp_aBcD1234eFgH5678iJkL9012mNoP3456qRsT", "sk-9aBcD1234eFgH5678iJkL9012mN"]
    clean = ["Call 4913615156729033 now or mail jo.81@mail7.example.com about it.", "THE!! TITLE!! OF.!! IT,!!", "see https://a.example.org/b?c=1 for v1.2.3"]
    assert secrets.find(clean, crf) == [[], [], []]
    assert secrets.scan(odd_docs, crf).count() == odd_docs.count() and secrets.scan(no_docs, crf).count() == 0
    fitted = secrets.fit(no_docs)
    assert np.allclose(fitted.weights, crf.weights)
    held_out = secrets.generated(200, seed=99)
    right = total = 0
    for toks, tags, file in held_out:
        shapes = secrets.Shapes()
        of = shapes.of(toks)
        got = crf.tag(crf.emissions(crf.parts(shapes), of, file), np.arange(len(toks)) == 0).tolist()
        right += got == tags
        total += 1
    assert right / total > 0.9


def planted_secrets(rng):
    """What no base pattern meets, behind what may stand before it: (lead, secret)."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return rng.choice([
        ("Authorization: Bearer ", run(alnum, 32)), ("", "ghp_" + run(alnum, 36)), ("key ", "sk-" + run(alnum, 40)), ("", "xoxb-" + run("0123456789", 11) + "-" + run(alnum, 24)),
        ("jwt ", "eyJ" + run(alnum, 24) + "." + run(alnum, 48) + "." + run(alnum, 36)), ("", "AIza" + run(alnum, 35)), ("aws_secret_access_key = ", run(alnum + "/+", 40)), ("", "pk_live_" + run(alnum, 24)),
    ])


def test_planted_secrets_in_real_documents(spark, sample):
    """The fitted field finds secrets without a base pattern in whole documents, and adds nothing to the documents as they are."""
    frame, rows = sample
    field = secrets.fit(frame)
    rng = random.Random(11)
    planted, want = [], []
    for i, text, _ in rows:
        words = (text or "").split(" ")
        at = rng.randint(0, len(words))
        lead, secret = planted_secrets(rng)
        before = " ".join([*words[:at], lead]) if at else lead
        planted.append((i, f"{before}{secret} " + " ".join(words[at:])))
        want.append((len(before), len(before) + len(secret)))
    found = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(planted, "doc_id long, text string"), field).collect()}
    hit = [any(s.start < b and a < s.end for s in found[i]) for (i, _), (a, b) in zip(planted, want, strict=True)]
    assert sum(hit) >= 0.9 * len(hit)
    clean = [s for r in secrets.scan(frame, field).collect() for s in r.spans if s.kind == "crf"]
    assert len(clean) <= 0.01 * len(rows)


def test_memo_of_shapes_changes_nothing(crf, monkeypatch):
    texts = ["see token = abc123def456 now", "Bearer aB3" + "dE4f" * 8, "", "a b c", "x" * 50]
    alone = [secrets.find([t], crf)[0] for t in texts]
    monkeypatch.setattr(secrets, "MEMO_TOKENS", 2)
    shapes = secrets.Shapes()
    assert [secrets.find([t], crf, shapes)[0] for t in texts * 2] == alone * 2 and secrets.find(texts, crf) == alone
    long = " ".join(f"w{i}" for i in range(2000))
    assert [t for part in secrets._tokens(long, 100) for t in part] == secrets._TOKEN.findall(long)


def test_words_of_patterns_are_ascii_only():
    assert not re.search(secrets.ASSIGN, "ſecret=abcdefghij")
