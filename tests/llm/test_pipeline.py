"""The pipeline against plain Python, and the queries against SQL."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe"]


def test_stages_against_plain_python(spark, tmp_path):
    from tests.llm.test_nearcopies import plain_kept
    from tests.llm.test_set_ops import plain_dedup
    from trawler.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.toPandas())
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, lines, single, mixed, coded = kept
    want = plain_dedup(list(zip(clean.doc_id, clean.text, strict=True)), 50)
    assert dict(zip(lines.doc_id, lines.text, strict=True)) == want and (lines.n_chars == lines.text.str.len()).all()
    assert set(single.doc_id) == plain_kept(sorted(zip(lines.doc_id, lines.text, strict=True))) and single.doc_id.is_unique
    words = single.text.map(lambda t: len(t.split()))
    wanted = mixing.targets(words.groupby(single.source).sum().to_dict())
    taken = mixed.text.map(lambda t: len(t.split())).groupby(mixed.source).sum()
    assert all(abs(taken.get(s, 0) - float(t)) <= words[single.source == s].max() for s, t in wanted.items())
    assert max(Counter(mixed.doc_id).values()) <= 3
    assert sorted(coded.decoded_sha256) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in mixed.text)


def test_edge_rows_pass_through_every_stage(spark, odd_docs, no_docs, tmp_path):
    from tests.llm.test_set_ops import plain_dedup
    from trawler.llm import toxicity

    docs = odd_docs.selectExpr("*", "'a' AS own_twin", "1 AS _lines", "2 AS own_copies", "3 AS _runs")
    every = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        every.append([r.asDict() for r in docs.collect()])
    rows = [r.asDict() for r in odd_docs.collect()]
    clean, lines, single, mixed, coded = every
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(~corpus_pipeline.held_out("doc_id")))
    calm = lambda t: float(model.score(np.array([model.featurize(model.hits([t or ""])[0])]))[0]) < 0.5
    texts = lambda of: sorted(((r["doc_id"], r["text"]) for r in of), key=str)
    assert texts(clean) == texts(r for r in rows if r["doc_id"] != 9) or all(calm(r["text"]) for r in rows if r["doc_id"] == 9)
    want = plain_dedup([(r["doc_id"], r["text"]) for r in clean if r["doc_id"] is not None], 50) | {None: "no id here at all"}
    assert texts(lines) == sorted(((r["doc_id"], want[r["doc_id"]]) for r in clean), key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lines)
    # texts without words are one group, as are equal ones; the smallest id stays, and the lone row without an id
    blank = min(r["doc_id"] for r in lines if not (r["text"] or "").split())
    full = {}
    for r in sorted(lines, key=lambda r: (r["doc_id"] is None, r["doc_id"])):
        if (r["text"] or "").split():
            full.setdefault(tuple(r["text"].lower().split()), r["doc_id"])
    assert sorted((r["doc_id"] for r in single), key=str) == sorted([blank, *full.values()], key=str)
    kept = Counter((r["doc_id"], r["text"]) for r in mixed)
    assert set(kept) <= {(r["doc_id"], r["text"]) for r in single} and max(kept.values()) <= 3
    assert all((r["own_twin"], r["_lines"], r["own_copies"], r["_runs"], r["rank"], r["term"]) == ("a", 1, 2, 3, 1, "t") for r in mixed)
    assert sorted(r["decoded_sha256"] for r in coded) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in mixed)
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, SF).schema)
        assert stage is corpus_pipeline.encode or docs.columns == no_docs.columns
    assert corpus_pipeline.encode(spark, no_docs, SF).count() == 0 and corpus_pipeline.mix_sources(spark, no_docs, SF).count() == 0


@pytest.mark.parametrize("name", ["op2_kdtree_top5", "op7_line_dedup"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).to_dict("list") == want.sort_values(key).to_dict("list")


def test_all_ten_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
