"""Command line: build an index, answer queries, run dense search, extract features, train, predict, evaluate."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawler.functions import text as T
from trawler.operators import dense, evaluate, ltr, pools, score, topk
from trawler.operators.index import Index, index_stats
from trawler.operators.match import query_terms
from trawler.plans import registry
from trawler.plans.views import Files
from trawler.session import open_session
from trawler.sources import readers, writers


def _corpus(spark: SparkSession, path: str, **rules) -> DataFrame:
    docs = readers.read_corpus(spark, path, **rules)
    return docs.withColumn("content", T.full_content(F.col("title"), F.col("text"), F.col("keywords")))


def _queries(frame: DataFrame, stem: bool) -> DataFrame:
    q = frame.withColumn("terms", T.analyzed(F.col("qtext")))
    if not stem:
        return q
    return q.drop("terms").join(T.stemmed(q.select("qid", "terms"), "qid"), "qid")


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    began = time.time()
    docs = _corpus(spark, a.corpus, max_docs=a.max_docs)
    Index.build(docs, "content", "id", stem=a.stem).save(a.index)
    row = index_stats(Index.load(spark, a.index).lexicon).first()
    size = writers.stored_bytes(spark, a.index) / 1e6
    print(json.dumps({"Index Size": round(size, 2), "Elapsed Time": round(time.time() - began, 2), "Number of Lists": row.number_of_lists, "Average List Size": row.average_list_size}))


def process(spark: SparkSession, a: argparse.Namespace) -> None:
    q = readers.read_query_lines(spark, a.queries).withColumn("qid", F.monotonically_increasing_id()).withColumnRenamed("query", "qtext")
    q = _queries(q, a.stem)
    run = score.search(query_terms(q), Index.load(spark, a.index), a.k, a.ranker, conjunctive=True)
    for row in writers.results_json(q, run).orderBy("qid").toLocalIterator():
        print(row.value)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    q = _queries(readers.read_queries(spark, a.queries), a.stem)
    run = score.search(query_terms(q), Index.load(spark, a.index), a.k, "BM25", k1=a.k1, b=a.b)
    writers.write_run(run, a.output)


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = readers.read_corpus(spark, a.input, keywords="convert")
    c = T.contents_weighted(F.col("title"), F.col("text"), F.col("keywords"), (a.w_title, a.w_text, a.w_keywords))
    writers.write_contents(docs.select("id", c.alias("contents")), a.output)


def index_contents(spark: SparkSession, a: argparse.Namespace) -> None:
    Index.build(spark.read.schema("id string, contents string").json(a.input), "contents", "id", stem=a.stem).save(a.index)


def rm3(spark: SparkSession, a: argparse.Namespace) -> None:
    q = _queries(readers.read_queries(spark, a.queries), a.stem)
    run = score.rm3_search(query_terms(q), Index.load(spark, a.index), a.k, a.fb_docs, a.fb_terms, a.orig_weight, a.k1, a.b)
    writers.write_run(run, a.output)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Features of the candidates of all queries, by any of the feature sets; hybrid needs vectors."""
    table = getattr(registry, f"features_{a.version}")(Files(spark, a.corpus, a.queries, a.qrels, a.vectors))
    writers.write_features(table.withColumnRenamed("doc_id", "docid"), a.output)


def retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, queries = (readers.read_vectors(spark, f"{a.vectors}/{part}") for part in ("vectors", "queries"))
    writers.write_candidates(dense.dense_topk(queries, docs, a.k), a.output)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_features(spark, path).withColumnRenamed("docid", "doc_id")


def add_dense(spark: SparkSession, a: argparse.Namespace) -> None:
    """One similarity column for each DIR:COL, from the vectors in DIR."""
    table = _table(spark, a.input)
    for spec in a.dense:
        path, _, column = spec.rpartition(":")
        docs, queries = (readers.read_vectors(spark, f"{path}/{part}") for part in ("vectors", "queries"))
        sims = dense.dense_sim(table.select("qid", "doc_id"), queries, docs).withColumnRenamed("sim", column)
        table = table.drop(column).join(sims.dropDuplicates(["qid", "doc_id"]), ["qid", "doc_id"])
    writers.write_features(table.withColumnRenamed("doc_id", "docid"), a.output)


def add_ce(spark: SparkSession, a: argparse.Namespace) -> None:
    """A column of pair scores over query and document text."""
    table, corpus = _table(spark, a.input), readers.read_corpus(spark, a.corpus).withColumnRenamed("id", "doc_id")
    text = T.full_content(F.col("title"), F.col("text"), F.col("keywords"))
    pairs = table.select("qid", "doc_id").distinct().join(readers.read_queries(spark, a.queries), "qid", "left").join(corpus.select("doc_id", text.alias("text")), "doc_id", "left")
    scored = dense.pair_scores(pairs, dense.lexical_pair_scorer).select("qid", "doc_id", F.col("f_ce").alias(a.col_name))
    writers.write_features(table.drop(a.col_name).join(scored, ["qid", "doc_id"]).withColumnRenamed("doc_id", "docid"), a.output)


def interaction(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.write_features(registry.with_interaction(_table(spark, a.input)).withColumnRenamed("doc_id", "docid"), a.output)


def recall(spark: SparkSession, a: argparse.Namespace) -> None:
    """Recall of runs, and of their union, down to each cut."""
    qrels, runs = readers.read_qrels(spark, a.qrels), {r.partition("=")[0]: readers.read_run(spark, r.partition("=")[2]) for r in a.runs}
    for k in a.cuts:
        cut = {f"{name}@{k}": run.where(F.col("rank") <= k).select("qid", "doc_id") for name, run in runs.items()}
        if len(cut) > 1:
            cut[f"union@{k}"] = pools.union(*cut.values()).select("qid", "doc_id")
        for row in evaluate.recall_by_pool(cut, qrels).orderBy("pool").collect():
            print(json.dumps(row.asDict()))


def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.queries:
        texts = readers.read_queries(spark, a.queries).select("qid", F.concat(F.lit(a.query_prefix), "qtext").alias("text"))
        dense.encode_texts(texts, dense.hashing_encoder(a.dim), "qid").write.mode("overwrite").parquet(f"{a.output}/queries")
    docs = readers.read_corpus(spark, a.input)
    texts = docs.select(F.col("id").alias("doc_id"), T.embed_text(F.col("title"), F.col("text"), F.col("keywords"), prefix=a.doc_prefix).alias("text"))
    writers.write_vectors(dense.encode_texts(texts, dense.hashing_encoder(a.dim)), a.output, "hashing")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    table = _table(spark, a.input)
    params, held = json.loads(a.params) if a.params else {}, None
    if a.val_fraction:
        split = evaluate.validation_split([r.qid for r in table.select("qid").distinct().collect()], a.val_fraction)
        params, held = ltr.PARAMS | params, {qid for qid, out in split.items() if out}
    ltr.train_models(table, tuple(a.seeds), params, held).write.mode("overwrite").parquet(a.output)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    table = _table(spark, a.input)
    writers.write_run(topk.rerank(ltr.predict(table, spark.read.parquet(a.model)), a.k), a.output)


def ndcg(spark: SparkSession, a: argparse.Namespace) -> None:
    qrels, run = readers.read_qrels(spark, a.qrels), readers.read_run(spark, a.submission)
    out = evaluate.ndcg_mean(run, qrels, a.k).first().asDict()
    if a.baseline:
        out |= evaluate.compare_runs(run, readers.read_run(spark, a.baseline), qrels, a.k).first().asDict()
    print(json.dumps(out))


def cross_validate(spark: SparkSession, a: argparse.Namespace) -> None:
    table = _table(spark, a.input)
    if "is_pool" not in table.columns:
        table = table.withColumn("is_pool", (F.col("f_bm25_rank") <= 100).cast("int"))
    qids = [r.qid for r in table.select("qid").distinct().collect()]
    fold_of = spark.createDataFrame(sorted(evaluate.folds(qids, a.folds).items()), "qid string, fold int")
    settings = ltr.sample_settings(a.n_configs) if a.n_configs else {"given": json.loads(a.params) if a.params else {}}
    scores = ltr.cross_validate(table, fold_of, settings).groupBy("config").agg(F.avg("ndcg").alias("ndcg")).orderBy(F.desc("ndcg")).limit(5)
    for row in scores.collect():
        print(json.dumps(row.asDict()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trawler", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, *args: tuple, **defaults) -> None:
        s = sub.add_parser(f.__name__.replace("_", "-"))
        for names, options in args:
            s.add_argument(*names.split(), **options)
        s.set_defaults(run=f, **defaults)

    need, text = {"required": True}, {}
    stem = ("--stem", {"action": "store_true"})
    io = (("-i --input", need), ("-o --output", need))
    ranked = (("-i --index", need), ("-q --queries", need), ("-o --output", need), ("-k", {"type": int, "default": 100}), ("--k1", {"type": float, "default": score.K1}), ("--b", {"type": float, "default": score.B}), stem)
    add(index, ("-c --corpus", need), ("-i --index", need), ("--max-docs", {"type": int, "default": 0}), stem)
    add(process, ("-i --index", need), ("-q --queries", need), ("-r --ranker", {"type": str.upper, "choices": sorted(score.SCORERS), "default": "BM25"}), ("-k", {"type": int, "default": 100}), stem)
    add(search, *ranked)
    add(rm3, *ranked, ("--fb-terms", {"type": int, "default": 10}), ("--fb-docs", {"type": int, "default": 10}), ("--orig-weight", {"type": float, "default": 0.5}))
    add(convert, *io, *((f"--w-{f}", {"type": int, "default": w}) for f, w in (("title", 1), ("text", 1), ("keywords", 1))))
    add(index_contents, ("--input", need), ("-i --index", need), stem)
    add(encode, *io, ("-q --queries", text), ("--doc-prefix", {"default": ""}), ("--query-prefix", {"default": ""}), ("--dim", {"type": int, "default": 64}))
    add(extract, ("--version", {"choices": ("v1", "v3", "v4", "v6", "hybrid"), "default": "v4"}), ("-c --corpus", need), ("-q --queries", need), ("--qrels", text), ("--vectors", text), ("-o --output", need))
    add(retrieve, ("--vectors", need), ("-o --output", need), ("-k --topk", {"type": int, "default": 200, "dest": "k"}))
    add(add_dense, *io, ("--dense", {"nargs": "+", "required": True, "metavar": "DIR:COL"}))
    add(add_ce, *io, ("-c --corpus", need), ("-q --queries", need), ("--col-name", {"default": "f_ce"}))
    add(interaction, *io)
    add(recall, ("--qrels", need), ("--runs", {"nargs": "+", "required": True, "metavar": "NAME=PATH"}), ("--cuts", {"type": int, "nargs": "+", "default": [100, 200, 500, 1000]}))
    add(train, *io, ("--val-fraction", {"type": float, "default": 0.0}), ("--params", text), ("--seeds", {"type": int, "nargs": "+", "default": list(ltr.SEEDS)}))
    add(predict, *io, ("--model", need), ("-k", {"type": int, "default": 100}))
    add(ndcg, ("--submission", need), ("--qrels", need), ("--baseline", text), ("-k", {"type": int, "default": 100}))
    add(cross_validate, ("-i --input", need), ("--folds", {"type": int, "default": 5}), ("--params", text), ("--n-configs", {"type": int, "default": 0}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.run(open_session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
