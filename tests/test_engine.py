"""Hand-computed small cases, edge rules and metamorphic relations of the retrieval engine."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawler import cli
from trawler.functions import features as X
from trawler.functions import text as T
from trawler.functions.porter2 import stem
from trawler.operators import dense, evaluate, ltr, match, pools, score, topk
from trawler.operators.index import Index, analyze, assign_doc_ids, inverted_lists
from trawler.sources import readers, writers
from trawler.streaming import ingest


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, "apple banana apple"), (1, "banana cherry"), (2, ""), (3, "cherry cherry cherry date"), (4, "the of and 123")]
    return spark.createDataFrame(rows, "doc_id long, content string")


@pytest.fixture(scope="module")
def index(docs):
    return Index.build(docs).persist()


def qterms(spark, **queries):
    return spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "qid string, term string")


def test_empty_documents_count(index):
    s = index.stats.first()
    assert (s.n_docs, s.avgdl) == (5, 9 / 5)
    assert {r.doc_id: r.length for r in index.lengths.collect()} == {0: 3, 1: 2, 2: 0, 3: 4, 4: 0}


def test_lists_are_sorted(index):
    lists = {r.term: [(p.doc_id, p.tf) for p in r.list] for r in inverted_lists(index.postings).collect()}
    assert lists["cherry"] == [(1, 1), (3, 3)] and lists["apple"] == [(0, 2)]


def test_and_or_with_unknown_terms(spark, index):
    q = qterms(spark, a=["banana", "cherry"], b=["banana", "nowhere"], c=["nowhere"])
    assert {tuple(r) for r in match.match_and(q, index.postings).collect()} == {("a", 1)}
    assert {(r.qid, r.doc_id) for r in match.match_or(q, index.postings).collect()} == {("a", 0), ("a", 1), ("a", 3), ("b", 0), ("b", 1)}
    stats = {r.qid: r for r in match.match_stats(q, index.postings, index.lexicon).collect()}
    assert stats["b"].early_terminated and not stats["a"].early_terminated and stats["a"].postings_in_lists == 4 and stats["c"].n_or == 0


def test_scores_by_hand(spark, index):
    q = qterms(spark, a=["cherry"])
    got = {r.doc_id: r.score for r in score.search(q, index).collect()}
    idf = math.log((5 - 2 + 0.5) / 2.5 + 1)
    assert got[3] == pytest.approx(idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 4 / 1.8)))
    tfidf = {r.doc_id: r.score for r in score.search(q, index, scorer=" tfidf ").collect()}
    assert tfidf[3] == pytest.approx((1 + math.log(3)) * math.log(5 / 2))
    with pytest.raises(ValueError):
        score.get_scorer("unknown")


def test_top_k_ties_and_bounds(spark):
    rows = spark.createDataFrame([("q", 9, 1.0), ("q", 2, 1.0), ("q", 5, 2.0)], "qid string, doc_id long, score double")
    assert [r.doc_id for r in topk.top_k(rows, 2).orderBy("rank").collect()] == [5, 2]
    assert topk.top_k(rows, 50).count() == 3
    with pytest.raises(ValueError):
        topk.top_k(rows, 0)


def test_and_is_inside_or_and_rm3_reduces_to_plain_ranking(spark, index):
    q = qterms(spark, a=["banana", "cherry"], b=["apple"])
    both = {(r.qid, r.doc_id) for r in match.match_and(q, index.postings).collect()}
    either = {(r.qid, r.doc_id) for r in match.match_or(q, index.postings).collect()}
    assert both <= either
    plain = [(r.qid, r.doc_id, r.rank) for r in score.search(q, index, 10).orderBy("qid", "rank").collect()]
    mixed = [(r.qid, r.doc_id, r.rank) for r in score.rm3_search(q, index, 10, orig_weight=1.0).orderBy("qid", "rank").collect()]
    assert mixed[: len(plain)] == plain or {m[:2] for m in mixed} >= {p[:2] for p in plain}


def test_weights_of_one_equal_the_flat_index(spark):
    rows = spark.createDataFrame([(0, "red fox", "red red dog"), (1, "", "fox")], "doc_id long, title string, text string")
    fields = score.FieldIndex.build(rows, {f: F.col(f) for f in ("title", "text")})
    flat = Index.build(rows.withColumn("content", F.concat_ws(" ", "title", "text")))
    for part in ("postings", "lexicon", "lengths"):
        a, b = ({tuple(r) for r in getattr(i, part).collect()} for i in (fields.weighted({"title": 1, "text": 1}), flat))
        assert a == b
    gone = fields.weighted({"title": 2, "text": 0})
    assert {(r.term, r.doc_id, r.tf) for r in gone.postings.collect()} == {("red", 0, 2), ("fox", 0, 2)} and gone.stats.first().avgdl == 2.0


def test_weightings_searched_together_equal_each_on_its_own(spark):
    rows = spark.createDataFrame([(i, f"fox w{i % 3}", "fox dog " * (i % 4) + f"w{i % 5} end") for i in range(40)] + [(99, None, "")], "doc_id long, title string, text string")
    fields = score.FieldIndex.build(rows, {"title": F.col("title"), "text": F.col("text")})
    q = qterms(spark, a=["fox", "w1"], b=["dog"], c=["unknown"])
    variants = [{"title": 3, "text": 1}, {"title": 2, "text": 0}, {"title": 0, "text": 1}]
    got = {(r.variant, r.qid, r.doc_id, round(r.score, 9), r["rank"]) for r in fields.search(q, variants, 7).collect()}
    want = {(i, r.qid, r.doc_id, round(r.score, 9), r["rank"]) for i, w in enumerate(variants) for r in score.search(q, fields.weighted(w), 7).collect()}
    assert got == want and {g[0] for g in got} == {0, 1, 2}


def test_features_by_hand(spark):
    q, title = F.split(F.lit("art new art"), " "), F.split(F.lit("modern new art museum"), " ")
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        X.title_overlap(q, title), X.keyword_match(q, F.lit("party cartoon")), X.title_jaccard(q, title), X.title_bigram_overlap(q, title), X.title_match_pos(q, title),
        X.query_coverage(q, title), X.title_match_pos(q, none), X.title_overlap(none, title), X.title_bigram_overlap(F.array(F.lit("one")), title), X.dot(F.lit(None).cast("array<float>"), F.array(F.lit(1.0))),
    ).first()
    assert list(row) == pytest.approx([1.0, 2.0, 2 / 4, 1 / 2, 1 / 4, 1.0, 1.0, 0.0, 0.0, 0.0])


def test_ndcg_rules(spark):
    qrels = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 7, 1), ("c", 1, 0)], "qid string, doc_id long, rel int")
    ideal = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "qid string, doc_id long, rank int")
    got = {r.qid: r.ndcg for r in evaluate.ndcg_per_query(ideal, qrels).collect()}
    assert got == {"a": pytest.approx(1.0), "b": 0.0}
    twice = spark.createDataFrame([("b", 7, 1), ("b", 7, 2)], "qid string, doc_id long, rank int")
    assert {r.qid: r.ndcg for r in evaluate.ndcg_per_query(twice, qrels).collect()}["b"] > 1
    row = evaluate.compare_runs(ideal, twice, qrels).first()
    assert (row.n, row.wins, row.losses) == (2, 1, 1)


def test_union_recall_is_no_less_than_its_members(spark):
    qrels = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "qid string, doc_id long, rel int")
    x, y = (spark.createDataFrame([("a", d)], "qid string, doc_id long") for d in (1, 2))
    r = {r.pool: r.mean_recall for r in evaluate.recall_by_pool({"x": x, "y": y, "u": pools.union(x, y)}, qrels).collect()}
    assert r == {"x": 0.5, "y": 0.5, "u": 1.0}


def test_folds_and_negatives(spark):
    f = evaluate.folds([f"{i:03d}" for i in range(23)], 5)
    assert f == evaluate.folds([f"{i:03d}" for i in reversed(range(23))], 5) and sorted(f.values()).count(0) == 5
    split = evaluate.validation_split(["a", "b"])
    assert sum(split.values()) == 1
    queries, docs = spark.range(3).withColumnRenamed("id", "qid"), spark.range(50).withColumnRenamed("id", "doc_id")
    exclude = spark.createDataFrame([(0, d) for d in range(25)], "qid long, doc_id long")
    got = pools.random_negatives(queries, docs, exclude, 5)
    assert not {(r.qid, r.doc_id) for r in got.collect()} & {(0, d) for d in range(25)} and got.groupBy("qid").count().where("count > 5").count() == 0


def test_corpus_reader_rules(spark, tmp_path):
    good = [
        json.dumps({"id": "0001", "title": "T", "text": "x", "keywords": ["a", "b"]}), json.dumps({"id": 7, "title": None, "text": "y", "keywords": "bare"}),
        "{not json", "[1, 2]", json.dumps({"title": "no id"}), "", "   ",
    ]
    (tmp_path / "c.jsonl").write_text("\n".join(good))
    lines = spark.read.text(str(tmp_path / "c.jsonl"))
    rows = {r.id: r for r in readers.parse_corpus(lines).collect()}
    assert set(rows) == {"0001", "7"} and rows["7"].title == "" and rows["7"].keywords == [] and rows["0001"].keywords == ["a", "b"]
    assert {r.id: r.keywords for r in readers.parse_corpus(lines, keywords="convert").collect()}["7"] == ["bare"]
    assert tuple(readers.corpus_counts(lines).first()) == (2, 3)
    assert readers.parse_corpus(lines, max_docs=1).count() == 1


def test_query_and_judgement_readers(spark, tmp_path):
    (tmp_path / "q.csv").write_text("QueryId,Query\n002,first query\n003,\n,none\n004\n")
    (tmp_path / "r.csv").write_text("q,d,rel\n002,a,1\n002,a,2\n002,b,0\n003,c,x\n")
    assert [tuple(r) for r in readers.read_queries(spark, str(tmp_path / "q.csv")).collect()] == [("002", "first query")]
    assert readers.read_queries(spark, str(tmp_path / "q.csv"), keep_empty_text=True).count() == 3
    assert [tuple(r) for r in readers.read_qrels(spark, str(tmp_path / "r.csv")).collect()] == [("002", "a", 2)]
    assert readers.read_qrels(spark, str(tmp_path / "r.csv"), positive_only=False).count() == 2


def test_runs_in_several_files_keep_their_order(spark, tmp_path):
    lines = [f"q,d{i}" for i in range(3000)]
    for name, some in (("a", lines[:3]), ("b", lines[3:2000]), ("c", lines[2000:])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["qid,doc_id", *some]) + "\n")
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "a.csv").write_text("qid,doc_id,rel\nq,x,1\n")
    (tmp_path / "qrels" / "b.csv").write_text("qid,doc_id,rel\n" + "q,y,1\n" * 500 + "q,x,2\nq,y,3\n")
    got = [(r["rank"], r.doc_id) for r in readers.read_run(spark, f"{tmp_path}/*.csv").orderBy("rank").collect()]
    assert got == [(i + 1, f"d{i}") for i in range(3000)]
    assert {(r.doc_id, r.rel) for r in readers.read_qrels(spark, f"{tmp_path}/qrels").collect()} == {("x", 2), ("y", 3)}


def test_treebank_and_stems(spark):
    text = "Don't stop, it's \"fine\" (really). The well-known U.S. café costs $5 — John's and 'tis."
    tokens = spark.range(1).select(T.treebank_tokens(F.lit(text)).alias("t")).first().t
    assert {"do", "stop", "it", "fine", "really", "well-known", "john", "5"} <= set(tokens) and "n't" not in tokens and "'s" not in tokens and "(" not in tokens
    words = {"consign": "consign", "consolingly": "consol", "knightly": "knight", "hopping": "hop", "hoping": "hope", "happy": "happi", "relational": "relat", "skies": "sky", "ties": "tie", "cry": "cri", "by": "by", "gas": "gas", "agreed": "agre", "hopefulness": "hope", "generously": "generous", "controlling": "control"}
    assert {w: stem(w) for w in words} == words
    stems = Index.build(spark.createDataFrame([(0, "running runs run")], "doc_id long, content string"), stem=True)
    assert {(r.term, r.tf) for r in stems.postings.collect()} == {("run", 3)}


def test_whole_chain(spark):
    rows = spark.createDataFrame([(0, "The runners don't run; running in 2024, hopefully."), (1, None), (2, "the of 12")], "doc_id long, text string")
    terms = T.stemmed(rows.select("doc_id", T.analyzed(F.col("text"), T.treebank_tokens).alias("terms")))
    assert {r.doc_id: r.terms for r in terms.collect()} == {0: ["runner", "run", "run", "hope"], 1: [], 2: []}


def test_dense_search(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 4))
    docs = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "doc_id long, vec array<double>")
    queries = spark.createDataFrame([(q, v[q].tolist()) for q in range(3)], "qid long, vec array<double>")
    got = {(r.qid, r.rank): r.doc_id for r in dense.dense_topk(queries, docs, 5, shard_rows=17).collect()}
    want = {(q, k + 1): int(d) for q in range(3) for k, d in enumerate(np.argsort(-(v @ v[q]))[:5])}
    assert got == want
    named = [c.withColumn(i, F.concat(F.lit("n"), F.col(i).cast("string"))) for c, i in ((queries, "qid"), (docs, "doc_id"))]
    ties = named[1].withColumn("vec", F.expr("array(1D, 0D, 0D, 0D)"))
    assert {(r.qid, r.rank): r.doc_id for r in dense.dense_topk(named[0], named[1], 5).collect()} == {(f"n{q}", k): f"n{d}" for (q, k), d in want.items()}
    found = [r.doc_id for r in dense.dense_topk(named[0], ties, 3, exclude_self=True, shard_rows=9).where("qid = 'n0'").orderBy("rank").collect()]
    assert found == ["n1", "n10", "n11"]
    texts = spark.createDataFrame([(0, "a b"), (1, None)], "doc_id long, text string")
    vectors = {r.doc_id: r.vec for r in dense.encode_texts(texts, dense.hashing_encoder(8)).collect()}
    assert sum(x * x for x in vectors[0]) == pytest.approx(1.0) and not any(vectors[1])


def test_ranking_models_learn(spark):
    rng = np.random.default_rng(1)
    rows = []
    for q in range(12):
        for d in range(40):
            x, noise = rng.random(), rng.random()
            rows.append((f"{q:03d}", d, int(x > 0.8), 1, x, noise))
    table = spark.createDataFrame(rows, "qid string, doc_id long, relevance int, is_pool int, f_bm25 double, f_noise double")
    params = {"num_rounds": 20, "min_data_in_leaf": 5}
    nodes = ltr.train_models(table, (1, 2), params).persist()
    again = ltr.train_models(table, (1, 2), params)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))
    top = ltr.importance(nodes, ["f_bm25", "f_noise"]).orderBy(F.desc("splits")).first()
    assert top.feature == "f_bm25"
    ranked = topk.rerank(ltr.predict(table, nodes), 100)
    qrels = table.select("qid", "doc_id", F.col("relevance").alias("rel"))
    assert evaluate.ndcg_mean(ranked, qrels).first().ndcg > 0.95
    fold_of = spark.createDataFrame(sorted(evaluate.folds([f"{q:03d}" for q in range(12)], 3).items()), "qid string, fold int")
    held = ltr.cross_validate(table, fold_of, {"p": params})
    assert held.count() == 12 and held.agg(F.avg("ndcg")).first()[0] > 0.9


def test_ids_stream_and_command_line(spark, tmp_path, capsys):
    ids = spark.createDataFrame([(f"{i * 7 % 50:03d}",) for i in range(50)], "id string")
    got = assign_doc_ids(ids).orderBy("id").collect()
    assert [r.internal_id for r in got] == list(range(50))
    source = tmp_path / "in"
    source.mkdir()
    for n in range(2):
        (source / f"{n}.jsonl").write_text("\n".join(json.dumps({"id": f"{n}{i}", "title": "", "text": f"apple pear{i}", "keywords": []}) for i in range(3)))
        ingest.start_ingest(spark, str(source), f"{tmp_path}/live", f"{tmp_path}/ck").awaitTermination()
    live = ingest.ingested_index(spark, f"{tmp_path}/live")
    assert live.stats.first().n_docs == 6 and {r.term: r.df for r in live.lexicon.collect()}["apple"] == 6
    a = cli.parser().parse_args(["index", "-c", str(source), "-i", f"{tmp_path}/idx"])
    a.run(spark, a)
    (tmp_path / "q.txt").write_text("apple\n\nnothing\n")
    a = cli.parser().parse_args(["process", "-i", f"{tmp_path}/idx", "-q", f"{tmp_path}/q.txt", "-r", "bm25"])
    a.run(spark, a)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0]["Number of Lists"] == 4 and [len(x["Results"]) for x in lines[1:]] == [6, 0]
    (tmp_path / "q.csv").write_text("QueryId,Query\n001,apple\n")
    a = cli.parser().parse_args(["search", "-i", f"{tmp_path}/idx", "-q", f"{tmp_path}/q.csv", "-o", f"{tmp_path}/run"])
    a.run(spark, a)
    assert readers.read_run(spark, f"{tmp_path}/run").count() == 6


def test_writers(spark, tmp_path):
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "doc_id long, vec array<double>")
    writers.write_vectors(vectors, f"{tmp_path}/v", "m")
    assert spark.read.json(f"{tmp_path}/v/meta").first().dim == 2
    contents = spark.createDataFrame([("1", "a"), ("2", "")], "id string, contents string")
    writers.write_contents(contents, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/c").count() == 1


def test_analyzer_keeps_empty_lists(docs):
    assert {r.doc_id: len(r.terms) for r in analyze(docs).collect()} == {0: 3, 1: 2, 2: 0, 3: 4, 4: 0}
