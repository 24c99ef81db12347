"""Registered training queries use the operators' settings; early stopping and gains reach the node table."""

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawler.operators import ltr
from trawler.plans import registry


def judged(n_queries=12, seed=1):
    rng, rows = np.random.default_rng(seed), []
    for q in range(n_queries):
        for d in range(40):
            x = rng.random()
            rows.append((q, d, int(x + 0.3 * rng.random() > 0.9), 1, x, rng.random()))
    return rows


SCHEMA = "qid long, doc_id long, relevance int, is_pool int, f_bm25 double, f_noise double"


def test_registered_training_queries_pass_the_operators_settings(spark, monkeypatch):
    seen, table = [], spark.createDataFrame(judged(), SCHEMA)
    v = SimpleNamespace(spark=spark, training=table, qrels=table.select("qid", "doc_id", F.col("relevance").alias("rel")))
    monkeypatch.setattr(registry.Views, "of", lambda *a: v)
    monkeypatch.setattr(registry.ltr, "train_models", lambda t, seeds=ltr.SEEDS, params=None, validation=None: seen.append((seeds, ltr.ENSEMBLE | (params or {}), validation)) or spark.createDataFrame([], ltr.NODE_SCHEMA))
    for name in ("ltr_train", "ltr_importance", "ltr_ensemble"):
        registry.QUERIES[name](spark, "")
    assert [p["num_rounds"] for _, p, _ in seen] == [500, 500, 400] and seen[0][1] == ltr.PARAMS and seen[2][1] == ltr.ENSEMBLE
    assert len(seen[0][2]) == 2 and seen[1][2] == seen[0][2] and seen[2][2] is None


def test_validation_stops_early_and_gains_are_in_the_nodes(spark):
    table = spark.createDataFrame(judged(), SCHEMA)
    nodes = ltr.train_models(table, (42,), ltr.PARAMS | {"min_data_in_leaf": 5}, {0, 1, 2})
    pdf = nodes.toPandas()
    assert 0 < pdf.tree_id.nunique() < 500 and (pdf.gain[pdf.left >= 0] > 0).all() and (pdf.gain[pdf.left < 0] == 0).all()
    rows = np.array([r for r in judged()])
    held = rows[:, 0] < 3
    part = lambda m: (rows[m][:, 4:], rows[m][:, 2], rows[m][:, 0])
    model = ltr.train(*part(~held), ["f_bm25", "f_noise"], ltr.PARAMS | {"min_data_in_leaf": 5}, 42, part(held))
    assert len(model.trees) == pdf.tree_id.nunique()
    got = {r.feature: r.gain for r in ltr.importance(nodes, ["f_bm25", "f_noise"]).collect()}
    assert [got.get(f, 0.0) for f in ("f_bm25", "f_noise")] == pytest.approx(model.gains.tolist())


def test_search_and_comparison_train_what_their_rows_say(spark, monkeypatch):
    calls, table = [], spark.createDataFrame(judged(), SCHEMA)
    v = SimpleNamespace(spark=spark, training=table, qrels=table.select("qid", "doc_id", F.col("relevance").alias("rel")))
    monkeypatch.setattr(registry.Views, "of", lambda *a: v)

    def held(t, fold_of, settings, seeds=(42,), k=100):
        calls.append((fold_of.agg(F.max("fold")).first()[0] + 1, settings, seeds))
        return spark.createDataFrame([(c, 0, 0, i / 100) for i, c in enumerate(settings)], "config string, fold int, qid long, ndcg double")

    monkeypatch.setattr(registry.ltr, "cross_validate", held)
    kinds = [r.kind for r in registry.QUERIES["tune_grid"](spark, "").collect()]
    folds, settings, _ = calls[0]
    assert folds == 5 and len(settings) == 51 and settings.pop("baseline") == ltr.BASELINE
    assert all(json.loads(c)["num_rounds"] == s["num_rounds"] for c, s in settings.items())
    assert kinds.count("baseline") == 1 and kinds.count("single") == 5 and kinds.count("ensemble") == len(calls[1][1]) and calls[1][2] == (0, 1, 2, 3, 4)
    calls.clear()
    rows = {r.config: r for r in registry.QUERIES["robust_compare"](spark, "").collect()}
    assert set(rows) == {"baseline", "single", "ensemble"} and all(r.splits == 8 for r in rows.values()) and {c[0] for c in calls} == {5}
    assert sorted({(n, p["num_rounds"], len(s)) for _, c, s in calls for n, p in c.items()}) == [("baseline", 150, 1), ("ensemble", 400, 6), ("single", 400, 1)]


@pytest.mark.parametrize("l1", [0.0, 2.0])
def test_tree_equals_plain_search(l1):
    """Every split is the best one over all values of all features, by the gain as it is defined."""
    shrunk = lambda at: np.sign(g[at].sum()) * max(abs(g[at].sum()) - l1, 0)
    rng = np.random.default_rng(4)
    n, p = 300, ltr.PARAMS | {"min_data_in_leaf": 15, "num_leaves": 9, "max_depth": 4, "lambda_l2": 0.5, "lambda_l1": l1}
    x = np.round(rng.random((n, 3)), 1)
    g, h = rng.normal(size=n) + (x[:, 1] > 0.5), rng.random(n) + 0.1
    edges = [np.unique(x[:, j])[:-1] for j in range(3)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(3)], 1) + np.arange(3) * ltr.BINS
    gains = np.zeros(3)
    tree = ltr._tree(binned, edges, g, h, np.arange(n), np.ones(3, bool), p, gains)
    weigh = lambda at: shrunk(at) ** 2 / (h[at].sum() + 0.5 + 1e-9)

    def best(at):
        found = [(weigh(at[x[at, j] <= t]) + weigh(at[x[at, j] > t]) - weigh(at), j, t) for j in range(3) for t in edges[j] if min((x[at, j] <= t).sum(), (x[at, j] > t).sum()) >= 15]
        return max(found, default=(0, 0, 0))

    seen, total, leaves = {0: (np.arange(n), 0)}, np.zeros(3), 0
    for i in range(len(tree["value"])):
        at, depth = seen[i]
        assert tree["value"][i] == pytest.approx(p["learning_rate"] * shrunk(at) / (h[at].sum() + 0.5))
        if tree["left"][i] < 0:
            leaves += 1
            continue
        gain, j, t = best(at)
        assert (tree["feature"][i], tree["threshold"][i]) == (j, t) and tree["gain"][i] == pytest.approx(gain)
        total[j] += gain
        low = x[at, j] <= t
        seen[int(tree["left"][i])], seen[int(tree["right"][i])] = (at[low], depth + 1), (at[~low], depth + 1)
        assert depth < 4
    assert gains == pytest.approx(total) and 2 < leaves <= 9


def test_pulls_of_all_queries_equal_each_pair_on_its_own():
    """Queries of several lengths, without and with only relevant rows; blocks of one and of all queries."""
    rng = np.random.default_rng(5)
    qid = np.repeat(np.arange(9), [1, 2, 3, 8, 20, 33, 5, 4, 60])
    rel = rng.integers(0, 3, len(qid)).astype(float)
    rel[qid == 6], rel[qid == 7] = 0, 1
    scores, queries = np.round(rng.normal(size=len(qid)), 1), [np.flatnonzero(qid == q) for q in range(9)]
    g, h = np.zeros(len(qid)), np.zeros(len(qid))
    for rows in queries:
        order = rows[np.argsort(-scores[rows], kind="stable")]
        discount = {i: 1 / np.log2(k + 2) for k, i in enumerate(order)}
        ideal = sum(r / np.log2(k + 2) for k, r in enumerate(sorted(rel[rows], reverse=True)))
        for i in rows:
            for j in rows:
                if rel[i] > rel[j]:
                    rho = 1 / (1 + np.exp(scores[i] - scores[j]))
                    delta = (rel[i] - rel[j]) * abs(discount[i] - discount[j]) / ideal
                    g[i], g[j], h[i], h[j] = g[i] + rho * delta, g[j] - rho * delta, h[i] + rho * (1 - rho) * delta, h[j] + rho * (1 - rho) * delta
    for cells in (1, 1 << 15):
        pairs = type("Small", (ltr._Pairs,), {"CELLS": cells})(rel, queries)
        got = pairs.pulls(scores)
        assert got[0] == pytest.approx(g) and got[1] == pytest.approx(h) and (len(pairs.blocks) > 1) == (cells == 1)


def test_training_scores_rows_that_a_tree_was_not_drawn_from(monkeypatch):
    """A tree adds its values to every row, constant and unused features or not, as the model predicts them later."""
    rows = np.array(judged())
    x = np.column_stack([rows[:, 4:], np.ones(len(rows)), np.round(rows[:, 4], 1)])
    seen = []
    pulls = ltr._Pairs.pulls
    monkeypatch.setattr(ltr._Pairs, "pulls", lambda self, scores: seen.append(scores.copy()) or pulls(self, scores))
    model = ltr.train(x, rows[:, 2], rows[:, 0], list("abcd"), ltr.ENSEMBLE | {"min_data_in_leaf": 5, "num_rounds": 9, "feature_fraction": 0.5}, 1)
    assert len(model.trees) == 9 and not any((t["feature"] == 2).any() for t in model.trees)
    assert all(np.allclose(s, model.predict(x, i), atol=1e-12) for i, s in enumerate(seen))


def test_models_train_in_tasks_of_their_own(spark):
    """Small tables are not drawn together into a few tasks: 20 groups meet in at least 8."""
    table = spark.createDataFrame(judged(), SCHEMA)
    folds = spark.createDataFrame([(q, q % 5) for q in range(12)], "qid long, fold int")
    settings = {f"s{i}": ltr.PARAMS | {"num_rounds": 1, "early_stopping": 0} for i in range(4)}
    found = ltr.cross_validate(table, folds, settings)
    assert found.count() == 48
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 8


def test_prediction_reads_a_stored_training_table(spark):
    """Six models are trained and applied over one stored table; neither plan holds the features' own."""
    v = registry.Views(spark, "/root/testdata/sf0.001")
    plan = ltr.train_models(v.training, ltr.SEEDS)._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and "Join" not in plan
    v.release()
