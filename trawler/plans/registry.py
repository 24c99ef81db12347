"""Every registered query of the engine: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trawler.functions import features as X
from trawler.functions import text as T
from trawler.operators import dense, evaluate, index, ltr, match, pools, score, topk
from trawler.plans.views import FIELD_WEIGHTS, POOL_BM25, POOL_DENSE, RM3, Views
from trawler.session import Scratch
from trawler.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

GRID = [(0.9, 0.4), (1.2, 0.75), (2.0, 0.75)]
WEIGHT_VARIANTS = [(3, 1, 2), (5, 1, 3), (2, 1, 4), (4, 0, 3), (5, 1, 5), (1, 1, 1)]
CUTS = (100, 200, 500, 1000)


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views.of(spark, sf_dir))
    return f


def r6(name: str | Column, alias: str | None = None) -> Column:
    return topk.rounded(F.col(name) if isinstance(name, str) else name).alias(alias or name)


def joined(name: str) -> Column:
    return F.array_join(name, " ").alias(name)


def lines(v: Views) -> DataFrame:
    return v.corpus.select(F.to_json(F.struct("id", "title", "text", "keywords")).alias("value"))


def scratch(v: Views) -> Scratch:
    return Scratch(v.spark, "scan")


@query
def scan_corpus(v: Views) -> DataFrame:
    path = f"{scratch(v).base}/corpus"
    lines(v).write.text(path)
    return readers.read_corpus(v.spark, path).select("id", F.length("title").alias("title_chars"), F.sha2("text", 256).alias("text_sha256"), joined("keywords"))


@query
def scan_query_lines(v: Views) -> DataFrame:
    path = f"{scratch(v).base}/lines"
    v.queries.select(F.concat(F.lit("  "), "qtext", F.lit(" \n\n")).alias("value")).write.text(path)
    return readers.read_query_lines(v.spark, path)


def _csv(v: Views, frame: DataFrame, name: str) -> str:
    path = f"{scratch(v).base}/{name}"
    frame.write.csv(path, header=True)
    return path


@query
def scan_queries(v: Views) -> DataFrame:
    rows = v.queries.select(F.lpad(F.col("qid").cast("string"), 3, "0").alias("QueryId"), F.col("qtext").alias("Query"))
    return readers.read_queries(v.spark, _csv(v, rows, "queries"))


@query
def scan_qrels(v: Views) -> DataFrame:
    extra = v.queries.select("qid", F.lit(-1).alias("doc_id"), F.lit("0").alias("rel"))
    path = _csv(v, v.qrels.select("qid", "doc_id", F.col("rel").cast("string").alias("rel")).union(extra), "qrels")
    return readers.read_qrels(v.spark, path)


@query
def scan_run(v: Views) -> DataFrame:
    path = f"{scratch(v).base}/run"
    writers.write_run(pool100(v), path)
    return readers.read_run(v.spark, path)


def pool100(v: Views) -> DataFrame:
    return v.bm25.where(F.col("rank") <= POOL_BM25)


@query
def lookup_fields(v: Views) -> DataFrame:
    return readers.lookup_fields(v.corpus, v.qrels).select("doc_id", "title", F.length("text").alias("text_chars"), joined("keywords"))


@query
def distinct_ids(v: Views) -> DataFrame:
    return readers.distinct_ids(pool100(v), v.qrels)


@query
def full_content(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


@query
def contents_flat(v: Views) -> DataFrame:
    out = T.contents_flat(F.col("title"), F.col("text"), F.col("keywords"))
    return v.corpus.select("doc_id", F.sha2(out, 256).alias("contents_sha256"))


@query
def contents_weighted(v: Views) -> DataFrame:
    out = T.contents_weighted(F.col("title"), F.col("text"), F.col("keywords"), (3, 1, 2))
    return v.corpus.select("doc_id", F.length(out).alias("chars"), F.sha2(out, 256).alias("contents_sha256"))


@query
def embed_text(v: Views) -> DataFrame:
    out = T.embed_text(F.col("title"), F.col("text"), F.col("keywords"), 2000, "passage: ")
    return v.corpus.select("doc_id", out.alias("embed_text"))


@query
def tokenize_simple(v: Views) -> DataFrame:
    t = T.simple_tokens(F.col("content"))
    return v.corpus.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


@query
def tokenize_treebank(v: Views) -> DataFrame:
    return v.corpus.select("doc_id", F.array_join(T.treebank_tokens(F.col("content")), " ").alias("tokens"))


@query
def remove_stopwords(v: Views) -> DataFrame:
    t = T.remove_stopwords(T.simple_tokens(F.col("content")))
    return v.corpus.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


@query
def stem_terms(v: Views) -> DataFrame:
    return T.stem_vocabulary(v.index.lexicon)


@query
def analyze_docs(v: Views) -> DataFrame:
    return v.analyzed.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.sha2(F.array_join("terms", " "), 256).alias("terms_sha256"))


@query
def analyze_docs_stemmed(v: Views) -> DataFrame:
    """The whole chain: Treebank tokens, no stopwords, lengths and numbers checked, stemmed."""
    terms = v.corpus.select("doc_id", T.analyzed(F.col("content"), T.treebank_tokens).alias("terms"))
    return T.stemmed(terms).select("doc_id", F.size("terms").alias("n_terms"), joined("terms"))


@query
def analyze_queries(v: Views) -> DataFrame:
    return v.queries.select("qid", "qtext", joined("terms"))


@query
def assign_doc_ids(v: Views) -> DataFrame:
    return index.assign_doc_ids(v.corpus.select("id", "doc_id"), "id").select("id", "doc_id", "internal_id")


@query
def term_freq(v: Views) -> DataFrame:
    return v.index.postings


@query
def doc_length(v: Views) -> DataFrame:
    return v.index.lengths


@query
def merge_postings(v: Views) -> DataFrame:
    """Two partial indexes, over titles and over texts, merged."""
    blocks = [index.term_freq(v.corpus.select("doc_id", T.analyzed(F.col(c)).alias("terms"))) for c in ("title", "text")]
    return index.merge_postings(blocks[0].unionByName(blocks[1]))


@query
def lexicon(v: Views) -> DataFrame:
    return v.index.lexicon


@query
def inverted_lists(v: Views) -> DataFrame:
    pairs = F.transform("list", lambda p: F.concat_ws(":", p["doc_id"], p["tf"]))
    return index.inverted_lists(v.index.postings).select("term", F.array_join(pairs, " ").alias("list"))


@query
def index_stats(v: Views) -> DataFrame:
    return index.index_stats(v.index.lexicon)


@query
def doc_stats(v: Views) -> DataFrame:
    return v.index.stats.select("n_docs", r6("avgdl"))


@query
def postings_lookup(v: Views) -> DataFrame:
    """The lists of all query terms, read from a stored index."""
    base = scratch(v).base
    v.index.save(base)
    return index.postings_of(index.Index.load(v.spark, base).postings, v.qterms).select("term", "doc_id", "tf")


@query
def lexicon_df(v: Views) -> DataFrame:
    wanted = v.qterms.select("term").distinct().union(v.spark.createDataFrame([("zzunknownzz",)], "term string"))
    return index.lexicon_df(wanted, v.index.lexicon)


@query
def match_and(v: Views) -> DataFrame:
    return match.match_and(v.qterms, v.index.postings)


@query
def match_or(v: Views) -> DataFrame:
    return match.match_or(v.qterms, v.index.postings)


@query
def match_stats(v: Views) -> DataFrame:
    return match.match_stats(v.qterms, v.index.postings, v.index.lexicon)


def _run(run: DataFrame) -> DataFrame:
    return run.select("qid", "doc_id", r6("score"), "rank")


@query
def tfidf_and(v: Views) -> DataFrame:
    return _run(score.search(v.qterms, v.index, scorer="TFIDF", conjunctive=True))


@query
def tfidf_or(v: Views) -> DataFrame:
    return _run(score.search(v.qterms, v.index, scorer="tfidf"))


@query
def bm25_and(v: Views) -> DataFrame:
    return _run(score.search(v.qterms, v.index, conjunctive=True))


@query
def bm25_or(v: Views) -> DataFrame:
    return _run(score.search(v.qterms, v.index))


@query
def bm25_k1_b_grid(v: Views) -> DataFrame:
    return score.bm25_grid(v.qterms, v.index, GRID, 10).select("k1", "b", "qid", "doc_id", r6("score"), "rank")


@query
def bm25_field_weighted(v: Views) -> DataFrame:
    run = v.fielded.search(v.qterms, [dict(zip(FIELD_WEIGHTS, w, strict=True)) for w in WEIGHT_VARIANTS], 10)
    names = F.array(*(F.lit("/".join(map(str, w))) for w in WEIGHT_VARIANTS))
    return run.select(F.get(names, F.col("variant")).alias("weights"), "qid", "doc_id", r6("score"), "rank")


@query
def rm3_expand(v: Views) -> DataFrame:
    return score.rm3_expand(v.qterms, v.weighted, **RM3).select("qid", "term", r6("weight"))


@query
def rm3_search(v: Views) -> DataFrame:
    return _run(v.rm3.where("rank <= 100"))


@query
def query_mean_df(v: Views) -> DataFrame:
    return score.query_mean_df(v.queries.select("qid", F.col("bag").alias("terms")), v.index.lexicon).select("qid", r6("mean_df"))


@query
def topk_per_query(v: Views) -> DataFrame:
    return topk.top_k(v.bm25.drop("rank"), 7).select("qid", "doc_id", r6("score"), "rank")


@query
def bm25_top1000(v: Views) -> DataFrame:
    return _run(v.bm25)


@query
def rerank_topk(v: Views) -> DataFrame:
    preds = v.features_hybrid.where("is_pool = 1").withColumn("prediction", F.col("f_bm25_norm") + F.col("f_dense_sim"))
    return topk.rerank(preds, 100).select("qid", "doc_id", r6("prediction"), "rank")


@query
def pool_bm25(v: Views) -> DataFrame:
    return pools.pool(v.bm25, POOL_BM25)


@query
def train_candidates(v: Views) -> DataFrame:
    return v.cands_v4


@query
def pool_union3(v: Views) -> DataFrame:
    return v.cands_v6


@query
def pool_hybrid(v: Views) -> DataFrame:
    return v.cands_hybrid


@query
def hard_negatives(v: Views) -> DataFrame:
    return pools.hard_negatives(v.bm25, v.qrels, 20, 60)


@query
def random_negatives(v: Views) -> DataFrame:
    return pools.random_negatives(v.queries, v.corpus.select("doc_id"), v.qrels, 20)


@query
def scan_embeddings(v: Views) -> DataFrame:
    path = f"{scratch(v).base}/vectors"
    writers.write_vectors(v.dense_docs, path, "given")
    return readers.read_vectors(v.spark, f"{path}/vectors").select("doc_id", F.size("vec").cast("long").alias("dim"), r6(X.dot(F.col("vec"), F.col("vec")), "norm2"))


@query
def dense_sim(v: Views) -> DataFrame:
    return dense.dense_sim(pools.pool(v.bm25, POOL_BM25), v.dense_queries, v.dense_docs).select("qid", "doc_id", r6("sim"))


@query
def dense_topk(v: Views) -> DataFrame:
    return _run(v.dense)


LEXICAL = ("f_bm25", "f_field_weights", "f_rm3", "f_bm25_rank")
NORMS = ("f_bm25_norm", "f_fw_norm", "f_rm3_norm")
CONTENT = X.FEATURE_ORDER[7:]


def _features(frame: DataFrame, names: tuple[str, ...], *more: str) -> DataFrame:
    return frame.select("qid", "doc_id", *more, *(r6(c) for c in names))


@query
def features_lexical(v: Views) -> DataFrame:
    return _features(v.with_lexical(v.cands_v4), LEXICAL)


@query
def features_content(v: Views) -> DataFrame:
    return _features(v.with_content(v.cands_v4), CONTENT)


@query
def features_norm(v: Views) -> DataFrame:
    return _features(v.with_lexical(v.cands_v4), NORMS)


@query
def features_dense(v: Views) -> DataFrame:
    return _features(v.with_dense(v.cands_hybrid), ("f_dense_sim", "f_dense_rrank"))


def with_interaction(frame: DataFrame) -> DataFrame:
    """Rank, share of the maximum and standard score of the similarity within its query, and products with lexical scores."""
    every = Window.partitionBy("qid")
    sim = topk.rounded(F.col("f_dense_sim"))
    top, mean, spread = F.max(sim).over(every), F.avg(sim).over(every), F.stddev_pop(sim).over(every)
    out = frame.withColumns(
        {
            "f_dense_rank": F.row_number().over(every.orderBy(sim.desc(), "doc_id")).cast("double"),
            "f_dense_norm": F.when(top != 0, sim / top).otherwise(0.0),
            "f_dense_z": F.when(spread > 1e-9, (sim - mean) / spread).otherwise(0.0),
        }
    )
    return out.withColumns({"f_dense_x_bm25norm": sim * F.col("f_bm25_norm"), "f_dense_x_rm3norm": sim * F.col("f_rm3_norm")})


INTERACTION = ("f_dense_rank", "f_dense_norm", "f_dense_z", "f_dense_x_bm25norm", "f_dense_x_rm3norm")


@query
def features_interaction(v: Views) -> DataFrame:
    return _features(with_interaction(v.features_hybrid), INTERACTION)


V1 = ("f_bm25", "f_field_weights", "f_rm3", "f_query_length", "f_mean_df")
V3 = ("f_bm25", "f_field_weights", "f_rm3", "f_bm25_norm", "f_bm25_rank", "f_query_length", "f_mean_df", "f_doc_length", "f_title_overlap", "f_title_exact_match", "f_keyword_match")


@query
def features_v1(v: Views) -> DataFrame:
    return _features(v.with_content(v.with_lexical(v.cands_v6)), V1, "relevance")


@query
def features_v3(v: Views) -> DataFrame:
    return _features(v.with_content(v.with_lexical(v.cands_v4)), V3, "relevance")


@query
def features_v4(v: Views) -> DataFrame:
    return _features(v.with_content(v.with_lexical(v.cands_v4)), X.FEATURE_ORDER, "relevance")


@query
def features_v6(v: Views) -> DataFrame:
    return _features(v.with_content(v.with_lexical(v.cands_v6)), X.FEATURE_ORDER, "relevance", "is_pool")


@query
def features_hybrid(v: Views) -> DataFrame:
    return _features(v.features_hybrid, X.HYBRID_ORDER, "relevance", "is_pool")


@query
def pair_score(v: Views) -> DataFrame:
    pairs = pools.pool(v.bm25, POOL_BM25).join(v.queries.select("qid", "qtext"), "qid").join(v.corpus.select("doc_id", F.substring("text", 1, 1500).alias("text")), "doc_id", "left")
    return dense.pair_scores(pairs, dense.lexical_pair_scorer).select("qid", "doc_id", r6("f_ce"))


@query
def feature_columns(v: Views) -> DataFrame:
    """The feature columns of a table written to CSV and read again, in order."""
    path = f"{scratch(v).base}/features"
    writers.write_features(_features(v.with_lexical(v.cands_v4), LEXICAL, "relevance"), path)
    names = ltr.feature_columns(readers.read_features(v.spark, path))
    return v.spark.createDataFrame(list(enumerate(names)), "place long, feature string")


@query
def ndcg_per_query(v: Views) -> DataFrame:
    return evaluate.ndcg_per_query(pool100(v), v.qrels).select("qid", r6("ndcg"))


@query
def ndcg_mean(v: Views) -> DataFrame:
    return evaluate.ndcg_mean(pool100(v), v.qrels).select("n_queries", r6("ndcg"))


@query
def compare_runs(v: Views) -> DataFrame:
    out = evaluate.compare_runs(v.fw.where("rank <= 100"), pool100(v), v.qrels)
    return out.select("n", r6("mean_delta"), r6("t"), "wins", "ties", "losses")


@query
def recall_hybrid(v: Views) -> DataFrame:
    a, b = pools.pool(v.bm25, POOL_BM25), pools.pool(v.dense, POOL_DENSE)
    out = evaluate.recall_by_pool({"bm25": a, "dense": b, "union": pools.union(a, b)}, v.qrels)
    return out.select("pool", r6("mean_recall"), r6("median_recall"), r6("mean_size"))


@query
def recall_at_cuts(v: Views) -> DataFrame:
    runs = {"bm25": v.bm25, "fw": v.fw, "rm3": v.rm3}
    found = {f"{n}@{k}": pools.pool(r, k) for n, r in runs.items() for k in CUTS}
    found |= {f"union@{k}": pools.union(*(pools.pool(r, k) for r in runs.values())) for k in CUTS}
    out = evaluate.recall_by_pool(found, v.qrels)
    return out.select("pool", r6("mean_recall"), r6("median_recall"), r6("mean_size"))


def _qids(v: Views) -> list:
    """The judged queries; a query set is small, documents never come this way."""
    return [r.qid for r in v.qrels.select("qid").distinct().collect()]


def _folds(v: Views, k: int = 5, seed: int = 42) -> DataFrame:
    return v.spark.createDataFrame(sorted(evaluate.folds(_qids(v), k, seed).items()), "qid long, fold int")


@query
def train_val_split(v: Views) -> DataFrame:
    return v.spark.createDataFrame(sorted(evaluate.validation_split(_qids(v)).items()), "qid long, validation boolean")


@query
def cv_folds(v: Views) -> DataFrame:
    return _folds(v)


def _stopped(v: Views) -> DataFrame:
    """One model that the validation queries stop early."""
    return ltr.train_models(v.training, (42,), ltr.PARAMS, {q for q, held in evaluate.validation_split(_qids(v)).items() if held})


@query
def ltr_train(v: Views) -> DataFrame:
    return _stopped(v)


@query
def ltr_importance(v: Views) -> DataFrame:
    return ltr.importance(_stopped(v), ltr.feature_columns(v.training)).orderBy(F.desc("gain"), "feature")


def _ensemble(v: Views) -> DataFrame:
    """The stored ensemble, trained once for a folder of tables."""
    if "stored_ensemble" not in vars(v):
        v.stored_ensemble = Scratch(v.spark, "model").keep(ltr.train_models(v.training, ltr.SEEDS))
    return v.stored_ensemble


@query
def ltr_ensemble(v: Views) -> DataFrame:
    nodes = _ensemble(v)
    return nodes.groupBy("seed").agg(F.countDistinct("tree_id").alias("trees"), F.count("*").alias("nodes"))


@query
def ltr_predict(v: Views) -> DataFrame:
    ranked = ltr.predict(v.training.where("is_pool = 1"), _ensemble(v))
    return topk.rerank(ranked, 100).select("qid", "doc_id", r6("prediction"), "rank")


@query
def cv_ndcg(v: Views) -> DataFrame:
    return ltr.cross_validate(v.training, _folds(v), {"baseline": ltr.BASELINE}).select("config", "fold", "qid", r6("ndcg"))


@query
def tune_grid(v: Views) -> DataFrame:
    """The baseline, the best 5 of 50 random settings and the seed ensembles of the best 3, by mean held-out nDCG."""
    settings, folds = ltr.sample_settings(50), _folds(v)
    tried = _mean_ndcg(v, folds, {"baseline": ltr.BASELINE} | settings).collect()
    scored = sorted((r for r in tried if r.config != "baseline"), key=lambda r: (-r.ndcg, r.config))
    rows = [("baseline", r.config, r.ndcg) for r in tried if r.config == "baseline"] + [("single", r.config, r.ndcg) for r in scored[:5]]
    # without subsampling all seeds give one model
    top = {r.config: settings[r.config] for r in scored[:3] if min(settings[r.config]["feature_fraction"], settings[r.config]["bagging_fraction"]) < 1}
    if top:
        rows += [("ensemble", r.config, r.ndcg) for r in _mean_ndcg(v, folds, top, tuple(range(5))).collect()]
    return v.spark.createDataFrame(rows, "kind string, config string, ndcg double").select("kind", "config", r6("ndcg"))


def _mean_ndcg(v: Views, folds: DataFrame, settings: dict[str, dict], seeds: tuple[int, ...] = (42,)) -> DataFrame:
    return ltr.cross_validate(v.training, folds, settings, seeds).groupBy("config").agg(F.avg("ndcg").alias("ndcg"))


#: What robust_compare holds against the baseline: settings and the number of seeds.
ROBUST = {"baseline": (ltr.BASELINE, 1), "single": (ltr.ENSEMBLE | {"lambda_l2": 0.0}, 1), "ensemble": (ltr.ENSEMBLE | {"lambda_l2": 0.0}, 6)}


@query
def robust_compare(v: Views) -> DataFrame:
    """Settings over 8 splits: mean and spread of each, and its paired differences from the baseline."""
    out = None
    for split in range(8):
        folds = _folds(v, 5, 1000 + split)
        for name, (params, n) in ROBUST.items():
            s = _mean_ndcg(v, folds, {name: params}, tuple(range(n))).withColumn("split", F.lit(split))
            out = s if out is None else out.unionByName(s)
    base = F.max(F.when(F.col("config") == "baseline", F.col("ndcg"))).over(Window.partitionBy("split"))
    out = out.withColumn("delta", F.col("ndcg") - base)
    return out.groupBy("config").agg(
        r6(F.avg("ndcg"), "mean"), r6(F.stddev_pop("ndcg"), "std"), r6(F.avg("delta"), "mean_delta"), r6(F.stddev_pop("delta"), "std_delta"),
        F.count(F.when(F.col("delta") > 0, 1)).alias("wins"), F.count("*").alias("splits"),
    )
