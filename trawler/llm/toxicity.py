"""Toxicity from a learned lexicon, misspelled forms included, weighed by their context.

The lexicon is learned from labelled texts: whole words and word stems that toxic texts hold far
more often than others. Its terms form a trie, which is intersected with Levenshtein automata: a
state is a set of (trie node, edits so far), determinized on demand, so that one walk over a word
finds the nearest term, misspelled or not. Each hit is scored inside its context window: quotation
marks around it or a reporting word near it make it quotation, otherwise it counts as abuse. A
logistic model over these scores, with prior means, gives the score of a text.

Fitting takes a bounded sample of labelled rows (`sample_rows`), and of it all terms: their counts stay
in a distributed table, from which only terms that carry the evidence asked for come to the driver, so
there is no cap on candidates or on the lexicon. Scoring covers every whole text.

Defined results: null and empty texts get the score of a text without hits; equal texts get equal
scores; extra columns are ignored; an empty table gives an empty table; without labelled rows of
both kinds the lexicon is empty and the score is the prior's.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawler.llm.common import columns, slices
from trawler.session import Scratch

# Quotation marks, and words that report what someone else said.
QUOTES = frozenset("\"“”„«»‹›‟")
REPORTING = frozenset("said says say called calls wrote writes quoted quote quoting told tells word term sagte schrieb zitierte dit écrit cité dijo escribió citó".split())

#: Tokens on either side of a hit that make its context; lengths from which one or two edits are let pass.
WINDOW, ONE_EDIT, TWO_EDITS = 8, 5, 9

#: Stem lengths that the lexicon may hold, the likelihood ratio and log odds that a term must reach, and the share of
#: its texts that must be toxic.
STEMS, EVIDENCE, ODDS, SHARE = (4, 5, 6, 7), 18.0, 2.0, 0.8

#: States that a worker's automaton remembers before it starts afresh.
MOST_STATES = 50_000

_WORD = re.compile(r"[^\W_]+")
_EDGES = ".,:;!?\"'()*-&%#“”„«»"

HITS = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("place", pa.int64()), ("quoted", pa.bool_())]))
HITS_SQL = "hits array<struct<term: string, edits: int, place: long, quoted: boolean>>"

#: Prior means of the model: bias, then the features of `featurize`.
PRIOR = np.array([-2.5, 4.0, 0.5, 2.5, 0.2, 0.5, 0.3])


class FuzzyTrie:
    """Terms, each with the edits it lets pass, and stems in a trie, intersected with Levenshtein automata."""

    def __init__(self, words: dict[str, int], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.stem_ends: dict[int, str] = {}
        self.limit = words
        self.reach = [0]  # the most edits that any term below a node lets pass
        for terms, ends in ((words, self.ends), (stems, self.stem_ends)):
            for term in terms:
                node, edits = 0, words.get(term, 0) if ends is self.ends else 0
                self.reach[0] = max(self.reach[0], edits)
                for c in term:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.reach.append(0)
                    node = self.child[node][c]
                    self.reach[node] = max(self.reach[node], edits)
                ends[node] = term
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.whole: list[str | None] = []  # the stem that a state has just met without an edit
        self.dead = self._state(set())
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a determinized state; skipping a letter of a term costs an edit."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(x, e + 1) for x in self.child[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.whole.append(next((self.stem_ends[n] for n, e in sorted(key) if not e and n in self.stem_ends), None))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.states[state]:
            for letter, x in self.child[node].items():
                to.add((x, e if letter == c else e + 1))
            to.add((node, e + 1))
        self.moves[state][c] = out = self._state(to)
        return out

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, ties to the first by code point; a stem found whole counts as no edit."""
        if len(self.states) > MOST_STATES:
            self._forget()
        state, dead, moves, whole = self.start, self.dead, self.moves, self.whole
        stem = None
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == dead:
                return (stem, 0) if stem else None
            stem = stem or whole[state]
        found = [(e, self.ends[n]) for n, e in self.states[state] if n in self.ends and e <= self.limit[self.ends[n]]]
        if stem:
            found.append((0, stem))
        if not found:
            return None
        e, term = min(found)
        return term, e


@dataclass
class Model:
    """A fitted lexicon (term -> log odds; stems end with *), the terms that are looked for as they are
    spelled only, and the weights of the features."""

    terms: dict[str, float] = field(default_factory=dict)
    strict: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self):
        self._build()

    def _build(self):
        words = [t for t in self.terms if not t.endswith("*")]
        stems = [t[:-1] for t in self.terms if t.endswith("*")]
        self.trie = FuzzyTrie({w: 0 if w in self.strict else (len(w) >= ONE_EDIT) + (len(w) >= TWO_EDITS) for w in words}, stems)

    def __getstate__(self):
        return self.terms, self.strict, self.weights

    def __setstate__(self, state):
        self.terms, self.strict, self.weights = state
        self._build()

    def match(self, token: str) -> tuple[str, int] | None:
        """The nearest term to any word inside a token."""
        bare = token.strip(_EDGES)
        if bare.isalnum():
            return self.trie.find(bare)
        best = None
        for word in _WORD.findall(bare):
            found = self.trie.find(word)
            if found and (best is None or found[1] < best[1]):
                best = found
        return best

    def hits(self, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        """(term, edits, token place, quoted) of every hit of every text."""
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        tokens = [text.lower().split() for text in texts]
        used = [np.fromiter(map(seen.__getitem__, of), np.int64, len(of)) for of in tokens]
        found = [self.match(token) for token in seen]
        hit = np.array([f is not None for f in found], bool)
        out = []
        for of, at in zip(tokens, used, strict=True):
            places = np.flatnonzero(hit[at]) if len(at) else []
            out.append([(*found[at[i]], int(i), quoted(of, int(i))) for i in places])
        return out

    def featurize(self, hits: list[tuple[str, int, int, bool]]) -> list[float]:
        """Abusive, quoted, misspelled abusive and misspelled quoted hits, the strongest term, and density."""
        counts = [0, 0, 0, 0]
        strongest = 0.0
        close = 0
        last = None
        for term, edits, place, in_quotes in hits:
            counts[2 * (edits > 0) + in_quotes] += 1
            if not in_quotes:
                weight = self.terms.get(term, self.terms.get(term + "*", 0.0))
                strongest = max(strongest, weight / (1 + edits))
                close += last is not None and place - last <= WINDOW
                last = place
        return [*(min(np.log2(1 + n), 3.0) for n in counts), strongest / 4, min(np.log2(1 + close), 3.0)]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def quoted(tokens: list[str], i: int) -> bool:
    """Whether the token stands between quotation marks, or after a reporting word, inside the window."""
    before = "".join(tokens[max(0, i - WINDOW) : i])
    opened = sum(c in QUOTES for c in before) + sum(c in QUOTES for c in tokens[i][:1])
    closed = any(c in QUOTES for t in tokens[i : i + WINDOW + 1] for c in (t[1:] if t is tokens[i] else t))
    if opened % 2 and closed:
        return True
    return any(t.strip(".,:;!?\"'“”„«»()") in REPORTING for t in tokens[max(0, i - WINDOW // 2) : i])


def _terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def learn_terms(counts: list[tuple[str, int, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The lexicon from (term, toxic texts, other texts, lead) counts: terms whose likelihood ratio reaches
    EVIDENCE and a quarter of the best one's. lead is, for a stem, the most toxic texts that any one word with it
    has: a stem is kept only where no single word makes up most of its texts, and replaces the words and
    longer stems that start with it."""
    rate = toxic / (toxic + clean)
    scored = []
    for term, a, b, lead in counts:
        p = a / (a + b)
        if p <= rate or lead > 0.7 * a:
            continue
        g = 2 * (a * np.log(p / rate) + (b * np.log((1 - p) / (1 - rate)) if b else 0))
        odds = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
        if g >= EVIDENCE and odds >= ODDS and p >= SHARE:
            scored.append((-round(float(g), 6), term.endswith("*"), -len(term), term, odds))
    out: dict[str, float] = {}
    for g, *_, term, odds in sorted(scored):
        if 4 * g > min(scored)[0]:
            break
        bare = term.rstrip("*")
        if not any(bare[:n] + "*" in out for n in STEMS if n <= len(bare)):
            out[term] = odds
    return out


def _evident(found: DataFrame, toxic: int, clean: int) -> list[tuple[str, int, int, int]]:
    """(term, toxic texts, other texts, lead) of the terms of (term, a, b) that carry the evidence: few, however many terms there are."""
    rate = toxic / (toxic + clean)
    stems = F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda n: F.length("term") > n), lambda n: F.concat(F.substring("term", F.lit(1), n), F.lit("*")))
    lead = found.where(~F.endswith("term", F.lit("*"))).select(F.explode(stems).alias("term"), "a").groupBy("term").agg(F.max("a").alias("lead"))
    p = F.col("a") / (F.col("a") + F.col("b"))
    g = 2 * (F.col("a") * F.log(p / rate) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - p) / (1 - rate))).otherwise(0.0))
    rows = found.where("term <> ''").where((p >= SHARE) & (p > rate) & (g >= EVIDENCE - 1e-6)).join(lead, "term", "left")
    return [tuple(r) for r in rows.select("term", "a", "b", F.coalesce("lead", F.lit(0))).collect()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 20_000,
    scratch: Scratch | None = None,
) -> Model:
    """A model of at most sample_rows labelled rows, the first by a hash of their doc_id."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    chosen = columns(labels, key=id_col, label=label_col).where("label is not null and key is not null").groupBy("key").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    # at most sample_rows pairs of numbers
    rows = columns(docs, key=id_col, text=text_col).join(F.broadcast(chosen), "key").select(F.col("label").cast("int").alias("label"), "text", "key")
    sample = scratch.keep(rows)

    def count(model: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                toxic, clean, left = Counter(), Counter(), 0
                texts = [t or "" for t in batch.column(1).to_pylist()]
                known = model.hits(texts) if model.terms else [[]] * len(texts)
                for label, text, hits in zip(batch.column(0).to_pylist(), texts, known, strict=True):
                    if not any(edits == 0 for _, edits, *_ in hits):
                        left += label > 0
                        (toxic if label > 0 else clean).update(_terms_of(text))
                terms = ["", *(toxic.keys() | clean.keys())]
                toxic[""] = left
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["term", "a", "b"])

        return run

    sizes = {r.label: r["n"] for r in sample.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model()
    counts = sample.mapInArrow(count(Model()), "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    likely = scratch.keep(counts.where((F.col("a") >= 3) & (F.col("a") >= 4 * F.col("b"))))
    # each round explains some toxic texts; only terms of those not explained yet are learned next, so
    # words that merely keep company with a term in copies of a text gather no evidence of their own
    terms: dict[str, float] = {}
    found, left = likely, toxic
    while left:
        new = {t: o for t, o in learn_terms(_evident(found, left, clean), left, clean).items() if t not in terms}
        if not new:
            break
        terms |= new
        rest = sample.where("label > 0").mapInArrow(count(Model(terms)), "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"))
        rest = scratch.keep(rest.where("a >= 3 or term = ''"))
        left = rest.where("term = ''").agg(F.sum("a")).first()[0] or 0
        found = rest.join(likely.select("term", "b"), "term")

    model = Model(terms)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[dict(zip(("term", "edits", "place", "quoted"), h, strict=True)) for h in of] for of in model.hits([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int64()), pa.array(hits, HITS)], ["label", "key", "hits"])

    # a bounded sample's hits
    rows = sample.mapInArrow(meet, f"label int, key long, {HITS_SQL}").orderBy("key", "label").collect()
    y = np.array([float(r.label > 0) for r in rows])
    # a term whose misspellings are more often other words than itself is held to its spelling
    wrong: Counter = Counter()
    for r in rows:
        for h in r.hits:
            if h.edits:
                wrong[h.term] += -1 if r.label > 0 else 1
    model = Model(terms, frozenset(t for t, n in wrong.items() if n > 0))
    heard = [[tuple(h) for h in r.hits if not (h.edits and h.term in model.strict)] for r in rows]
    x = np.array([[1.0, *model.featurize(h)] for h in heard])
    model.weights = fit_weights(x, y)
    return model


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of least penalized log loss around the prior, by Newton steps that are halved until they help."""
    w, decay = PRIOR.copy(), np.array([0.01, *[1.0] * (len(PRIOR) - 1)])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (decay * (w - PRIOR) ** 2).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) + decay * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(decay), gradient)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * float(gradient @ step):
            size /= 2
        w = w - size * step
        if size <= 1e-6 or float(np.abs(size * step).max()) < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double, hits array<struct<term, edits, place, quoted>>) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            hits = model.hits(texts)
            scores = model.score(np.array([model.featurize(h) for h in hits]))
            listed = [[dict(zip(("term", "edits", "place", "quoted"), h, strict=True)) for h in of] for of in hits]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(scores, pa.float64()), pa.array(listed, HITS)], ["doc_id", "score", "hits"])

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(
        run, f"doc_id long, score double, {HITS_SQL}"
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below limit; no row moves between machines."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for _, texts in slices([pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["key", "text"])]):
                fine.append(model.score(np.array([model.featurize(h) for h in model.hits(texts)])) < limit)
            if fine:
                yield batch.filter(pa.array(np.concatenate(fine)))

    return docs.mapInArrow(run, docs.schema)
