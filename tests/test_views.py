"""What the retrieval queries share: lists of wanted terms alone, and plans over stored tables."""

import pytest
from pyspark.sql import functions as F

from trawler.operators import score
from trawler.plans.views import RM3, Views, field_texts

SF = "/root/testdata/sf0.001"


def rows(frame, *keys):
    return sorted(map(tuple, frame.select(*keys, *(c for c in frame.columns if c not in keys)).collect()))


def test_lists_of_wanted_terms_equal_the_whole_index(spark):
    """The same lists, lengths and statistics; documents without a wanted term, without any term and repeated ones count."""
    texts = [(1, "Red fox 2024.", "red Fox, red 7up and the 007 den", ["en", "fox"]), (2, "", "the and of", None), (3, "x", "nothing here", []), (4, "Fox", None, ["fox"]), (5, "owl", "owl", ["a"]), (5, "owl", "owl", ["a"])]
    corpus = spark.createDataFrame(texts, "doc_id long, title string, text string, keywords array<string>")
    wanted = spark.createDataFrame([("fox",), ("red",), ("owl",), ("7up",), ("007",), ("absent",), ("fox",)], "term string")
    whole, few = score.FieldIndex.build(corpus, field_texts()), score.FieldIndex.build(corpus, field_texts(), wanted=wanted)
    assert rows(few.postings, "term", "doc_id") == rows(whole.postings.join(wanted.distinct(), "term", "left_semi"), "term", "doc_id") != []
    assert rows(few.lengths, "doc_id") == rows(whole.lengths, "doc_id") and few.lengths.count() == 6
    weights = {"title": 5, "text": 1, "keywords": 0}
    a, b = few.weighted(weights), whole.weighted(weights)
    assert rows(a.stats, "n_docs") == rows(b.stats, "n_docs")
    assert rows(a.lexicon, "term") == rows(b.lexicon.join(wanted.distinct(), "term", "left_semi"), "term")


def test_runs_over_wanted_lists_equal_runs_over_the_index(spark):
    v = Views(spark, SF)
    for got, want in (
        (v.bm25, score.search(v.qterms, v.index, 1000)),
        (v.fw, score.search(v.qterms, v.weighted, 1000)),
        (v.rm3, score.rm3_search(v.qterms, v.weighted, 1000, **RM3)),
    ):
        got, want = ({(r.qid, r.doc_id): (r.score, r["rank"]) for r in f.collect()} for f in (got, want))
        assert got.keys() == want.keys() and len(got) > 0
        assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in got)
    v.release()


def test_plans_of_features_are_short(spark):
    """Each view reads stored tables: no plan holds those of the views below it, which the driver would describe again and again."""
    v = Views(spark, SF)
    for frame in (v.bm25, v.rm3, v.cands_hybrid, v.features_hybrid, v.training):
        plan = frame._jdf.queryExecution().toString()
        assert "InMemoryRelation" not in plan and len(plan) < 20_000
    assert v.training.where(F.col("f_rm3") > 0).count() > 0
    v.release()
