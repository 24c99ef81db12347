"""Learning to rank: a histogram LambdaMART, trained task-parallel over seeds, folds and settings.

One ranking model of reference size (tens of thousands of rows) fits one task, so the cluster runs
many models at once: ensembles, folds and random searches are groups of one applyInPandas.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Training settings, and the values that a random search draws from.
PARAMS = {
    "learning_rate": 0.05, "num_leaves": 31, "max_depth": 6, "min_data_in_leaf": 20, "lambda_l2": 1.0, "lambda_l1": 0.0, "feature_fraction": 1.0,
    "bagging_fraction": 1.0, "bagging_freq": 1, "num_rounds": 500, "early_stopping": 50,
}
ENSEMBLE = PARAMS | {"learning_rate": 0.03, "max_depth": 5, "min_data_in_leaf": 10, "lambda_l2": 0.0, "feature_fraction": 0.9, "bagging_fraction": 0.6, "num_rounds": 400, "early_stopping": 0}
#: The reference's untuned setting in cross-validation, where no rows are kept for early stopping.
BASELINE = PARAMS | {"num_rounds": 150, "early_stopping": 0}
SEEDS = (42, 43, 44, 45, 46, 47)
SEARCH_SPACE = {
    "learning_rate": [0.02, 0.03, 0.05, 0.08, 0.1],
    "num_leaves": [15, 31, 47, 63, 95],
    "max_depth": [4, 5, 6, 8, -1],
    "min_data_in_leaf": [10, 20, 50, 100, 200],
    "lambda_l2": [0.0, 0.5, 1.0, 2.0, 5.0],
    "lambda_l1": [0.0, 0.0, 0.5, 1.0],
    "feature_fraction": [0.6, 0.7, 0.8, 0.9, 1.0],
    "bagging_fraction": [0.6, 0.7, 0.8, 1.0],
    "num_rounds": [100, 150, 250, 400, 600],
}
BINS = 64


@dataclass
class Model:
    """Trees as flat arrays; a node's children are place numbers in the same tree, -1 for a leaf."""

    features: list[str]
    trees: list[dict[str, np.ndarray]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def predict(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees[:trees]:
            at = np.zeros(len(x), np.int64)
            while (inner := t["left"][at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(t["feature"][at], 0)] <= t["threshold"][at]
                at = np.where(inner, np.where(go, t["left"][at], t["right"][at]), at)
            out += t["value"][at]
        return out

    def rows(self) -> pd.DataFrame:
        """One row for each node."""
        if not self.trees:
            return pd.DataFrame(columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "value", "gain"])
        return pd.concat([pd.DataFrame({"tree_id": i, "node_id": np.arange(len(t["value"])), **t}) for i, t in enumerate(self.trees)], ignore_index=True)


def ndcg(scores: np.ndarray, rel: np.ndarray, k: int = 100) -> float:
    discount = 1 / np.log2(np.arange(2, min(k, len(rel)) + 2))
    ideal = (np.sort(rel)[::-1][:k] * discount).sum()
    return float((rel[np.argsort(-scores, kind="stable")][:k] * discount).sum() / ideal) if ideal else 0.0


class _Pairs:
    """The pairs of unlike relevance of all queries, laid out once: a line for each relevant row, a place in it for each
    row of its query, in the order given. Queries are taken together in blocks of bounded size."""

    CELLS = 1 << 15

    def __init__(self, rel: np.ndarray, queries: list[np.ndarray]):
        self.n, self.blocks, held, cells = len(rel), [], [], 0
        for rows in sorted((rows for rows in queries if (rel[rows] > 0).any() and (rel[rows] != rel[rows[0]]).any()), key=len):
            more = int((rel[rows] > 0).sum()) * len(rows)
            if held and cells + more > self.CELLS:
                self.blocks.append(self._block(rel, held))
                held, cells = [], 0
            held.append(rows)
            cells += more
        if held:
            self.blocks.append(self._block(rel, held))

    @staticmethod
    def _block(rel: np.ndarray, queries: list[np.ndarray]):
        width = max(map(len, queries))
        rows, real = np.zeros((len(queries), width), np.int64), np.zeros((len(queries), width), bool)
        ideal = np.empty(len(queries))
        for i, q in enumerate(queries):
            rows[i, : len(q)], real[i, : len(q)] = q, True
            ideal[i] = (np.sort(rel[q])[::-1] / np.log2(np.arange(2, len(q) + 2))).sum()
        r = np.where(real, rel[rows], np.inf)
        query, place = np.nonzero(real & (r > 0))
        gap = np.maximum(r[query, place][:, None] - r[query], 0.0) / ideal[query][:, None]
        return rows, real, query, place, np.searchsorted(query, np.arange(len(queries) + 1)).tolist(), gap

    def pulls(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and second derivatives: each pair pulls by what swapping it would change in nDCG."""
        g, h = np.zeros(self.n), np.zeros(self.n)
        for rows, real, query, place, starts, gap in self.blocks:
            s = np.where(real, scores[rows], -np.inf)
            rank = np.empty(s.shape, np.int64)
            np.put_along_axis(rank, np.argsort(-s, axis=1, kind="stable"), np.arange(s.shape[1])[None, :], 1)
            discount = 1 / np.log2(rank + 2.0)
            odds = np.exp(np.clip(s - s.max(1, keepdims=True), -300, 0))
            delta = discount[query]
            np.subtract(discount[query, place][:, None], delta, out=delta)
            np.abs(delta, out=delta)
            delta *= gap
            rho = odds[query]
            rho /= odds[query, place][:, None] + rho
            delta *= rho
            np.subtract(1.0, rho, out=rho)
            rho *= delta
            own = rows[query, place]
            # a row is in one query and once in its lines
            g[own] += delta.sum(1)
            h[own] += rho.sum(1)
            sums = np.empty((2, *rows.shape))
            for i, (a, b) in enumerate(zip(starts, starts[1:])):
                np.add.reduce(delta[a:b], axis=0, out=sums[0, i])
                np.add.reduce(rho[a:b], axis=0, out=sums[1, i])
            at = rows[real]
            g[at] -= sums[0][real]
            h[at] += sums[1][real]
        return g, h


def _lambdas(scores: np.ndarray, rel: np.ndarray, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return _Pairs(rel, queries).pulls(scores)


def train(x: np.ndarray, rel: np.ndarray, qid: np.ndarray, features: list[str], params: dict, seed: int = 42, valid=None) -> Model:
    """A LambdaMART model; valid = (x, rel, qid) stops it early where params ask for that."""
    p, rng = PARAMS | params, np.random.RandomState(seed)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1) + np.arange(width) * BINS
    by_query = lambda q: [np.flatnonzero(q == v) for v in np.unique(q)]
    pairs, scores = _Pairs(rel, by_query(qid)), np.zeros(n)
    columns = np.ascontiguousarray((binned - np.arange(width) * BINS).T.astype(np.uint8))
    # a feature that is the same in all rows splits nothing
    varied = np.flatnonzero(columns.min(1) < columns.max(1)) if n else np.zeros(0, np.int64)
    binned = binned[:, varied] - (varied - np.arange(len(varied))) * BINS
    model = Model(features, gains=np.zeros(width))
    if valid is not None:
        vx, vrel, vq = valid
        vqueries, vscores, best, best_at = by_query(vq), np.zeros(len(vx)), -1.0, 0
    rows = np.arange(n)
    for turn in range(int(p["num_rounds"])):
        g, h = pairs.pulls(scores)
        if p["bagging_fraction"] < 1 and p["bagging_freq"] and turn % p["bagging_freq"] == 0:
            rows = np.flatnonzero(rng.random_sample(n) < p["bagging_fraction"])
        used = np.zeros(width, bool)
        used[rng.permutation(width)[: max(1, round(width * p["feature_fraction"]))]] = True
        tree = _tree(binned, edges, g, h, rows, used, p, model.gains, columns, scores, varied)
        if tree is None:
            break
        model.trees.append(tree)
        if valid is not None and p["early_stopping"]:
            vscores += Model(features, [tree]).predict(vx)
            now = float(np.mean([ndcg(vscores[r], vrel[r]) for r in vqueries]))
            if now > best + 1e-12:
                best, best_at = now, len(model.trees)
            elif len(model.trees) - best_at >= p["early_stopping"]:
                break
    if valid is not None and p["early_stopping"]:
        model.trees = model.trees[:best_at]
        model.gains = sum((np.bincount(t["feature"][t["left"] >= 0], t["gain"][t["left"] >= 0], width) for t in model.trees), np.zeros(width))
    return model


def _tree(binned, edges, g, h, rows, used, p, gains, columns=None, scores=None, taken=None) -> dict[str, np.ndarray] | None:
    """The tree that splits its best leaf again and again. Only the smaller part of a split is counted, and only if a
    part can be split again; the larger one has what is left of its parent's histogram, and both are searched in one
    step. scores, where given, gain the tree's values for all rows, drawn or not. columns holds the bins feature by
    feature; taken names the features of binned, where it lacks some."""
    l1, l2 = p["lambda_l1"], p["lambda_l2"] + 1e-9
    least, deepest, most = p["min_data_in_leaf"], p["max_depth"], p["num_leaves"]
    if columns is None:
        columns = (binned - np.arange(binned.shape[1]) * BINS).T
    taken = np.arange(binned.shape[1]) if taken is None else taken
    able = used[taken]
    if not able.any():
        return None
    if 3 * able.sum() < 2 * len(taken):
        at = np.flatnonzero(able)
        binned, taken, able = binned[:, at] - (at - np.arange(len(at))) * BINS, taken[at], able[at]
    wide = len(taken)
    size, unused = wide * BINS, np.flatnonzero(~able)

    def shrunk(total):
        """A sum of gradients, nearer to zero by l1."""
        return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0) if l1 else total

    def histogram(at: np.ndarray) -> np.ndarray:
        flat, parts, weights = binned[at].ravel(), np.empty((3, size)), np.empty((len(at), wide))
        parts[0] = np.bincount(flat, minlength=size)
        for k, of in enumerate((g, h), 1):
            weights[:] = of[at][:, None]
            parts[k] = np.bincount(flat, weights.ravel(), size)
        return parts.reshape(3, wide, BINS)

    def splits(parts: list[tuple[np.ndarray, np.ndarray]]) -> list:
        """(gain, feature, bin, rows, histogram) for each (rows, histogram), None where nothing is gained."""
        sums = np.stack([held for _, held in parts]).cumsum(-1)
        count, gs, hs = sums[:, 0], sums[:, 1], sums[:, 2]
        n, total_g, total_h = count[..., -1:], gs[..., -1:], hs[..., -1:]
        gain = shrunk(gs) ** 2 / (hs + l2) + shrunk(total_g - gs) ** 2 / (total_h - hs + l2) - shrunk(total_g) ** 2 / (total_h + l2)
        gain[(count < least) | (n - count < least)] = -1.0
        gain[:, unused] = -1.0
        out = []
        for k, best in enumerate(gain.reshape(len(parts), -1).argmax(1).tolist()):
            c, b = divmod(best, BINS)
            j = int(taken[c])
            fine = gain[k, c, b] > 1e-12 and b < len(edges[j])
            out.append((float(gain[k, c, b]), j, b, *parts[k]) if fine else None)
        return out

    value = lambda at: p["learning_rate"] * float(shrunk(g[at].sum())) / (h[at].sum() + l2)
    others = np.zeros(0, np.int64)
    if scores is not None and len(rows) < len(g):
        left_out = np.ones(len(g), bool)
        left_out[rows] = False
        others = np.flatnonzero(left_out)
    nodes, members = [[-1, 0.0, -1, -1, value(rows), 0.0]], {0: (rows, others)}
    open_ = {0: (splits([(rows, histogram(rows))])[0] if len(rows) >= 2 * least else None, 0)}
    leaves = 1
    while leaves < most:
        ready = {i: s for i, s in open_.items() if s[0]}
        if not ready:
            break
        i = max(ready, key=lambda i: (ready[i][0][0], -i))
        (gain, j, b, at, held), depth = open_.pop(i)
        column, out = columns[j], members.pop(i)[1]
        low, low_out = column[at] <= b, column[out] <= b
        sides = (at[low], at[~low])
        gains[j] += gain
        nodes[i][:4] = j, float(edges[j][b]), len(nodes), len(nodes) + 1
        nodes[i][5] = gain
        leaves += 1
        found = [None, None]
        if leaves < most and not 0 < deepest <= depth + 1 and max(map(len, sides)) >= 2 * least:
            less = int(len(sides[1]) < len(sides[0]))
            small = histogram(sides[less])
            pair = (held - small, small) if less else (small, held - small)
            found = splits(list(zip(sides, pair, strict=True)))
        for part, rest, split in zip(sides, (out[low_out], out[~low_out]), found, strict=True):
            members[len(nodes)] = (part, rest)
            open_[len(nodes)] = (split, depth + 1)
            nodes.append([-1, 0.0, -1, -1, value(part), 0.0])
    if leaves == 1:
        return None
    if scores is not None:
        for i, parts in members.items():
            for part in parts:
                scores[part] += nodes[i][4]
    cols = list(zip(*nodes, strict=True))
    return {k: np.array(c, t) for k, c, t in zip(("feature", "threshold", "left", "right", "value", "gain"), cols, (np.int64, float, np.int64, np.int64, float, float), strict=True)}


def feature_columns(table: DataFrame) -> list[str]:
    """The columns that start with f_, in the table's order."""
    return [c for c in table.columns if c.startswith("f_")]


def _arrays(pdf: pd.DataFrame, features: list[str]):
    pdf = pdf.sort_values(["qid", "doc_id"], kind="stable")
    return pdf, pdf[features].to_numpy(np.float64), pdf["relevance"].to_numpy(np.float64), pdf["qid"].to_numpy()


NODE_SCHEMA = "seed int, tree_id int, node_id int, feature int, threshold double, left int, right int, value double, gain double"


def train_models(table: DataFrame, seeds: tuple[int, ...] = SEEDS, params: dict | None = None, validation: set | None = None) -> DataFrame:
    """The node tables of one model for each seed; seeds train in parallel. All rows are used, or, where
    validation names queries, those of the others, while the named ones stop the rounds early."""
    features, params = feature_columns(table), ENSEMBLE | (params or {})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf["seed"].iloc[0])
        held = pdf["qid"].isin(validation or ())
        _, x, rel, qid = _arrays(pdf[~held], features)
        valid = _arrays(pdf[held], features)[1:] if held.any() else None
        return train(x, rel, qid, features, params, seed, valid).rows().assign(seed=seed)[[c.split()[0] for c in NODE_SCHEMA.split(", ")]]

    copies = table.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return copies.repartition(8 * len(seeds), "seed").groupBy("seed").applyInPandas(one, NODE_SCHEMA)


def importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """(feature, splits, gain): how often each feature splits a node, and what its splits gain, over all models."""
    names = F.array(*map(F.lit, features))
    return nodes.where("left >= 0").groupBy(F.get(names, F.col("feature")).alias("feature")).agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))


def predict(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """table with prediction, the mean over the models. The models are as large as their settings make
    them (rounds * leaves rows each), whatever the size of the data, so they travel with the function."""
    features = feature_columns(table)
    pdf = nodes.toPandas().sort_values(["seed", "tree_id", "node_id"])
    models = []
    for _, m in pdf.groupby("seed"):
        models.append(Model(features, [{c: t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value")} for _, t in m.groupby("tree_id")]))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        matrix = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(features)))
        return pd.Series(np.mean([m.predict(matrix) for m in models], axis=0))

    return table.withColumn("prediction", score(F.array(*(F.col(c).cast("double") for c in features))))


def cross_validate(table: DataFrame, fold_of: DataFrame, settings: dict[str, dict], seeds: tuple[int, ...] = (42,), k: int = 100) -> DataFrame:
    """(config, fold, qid, ndcg) of held-out queries: each (config, fold) trains on the other folds and
    ranks the candidates of its own queries (is_pool = 1). Whole queries only; all groups run in parallel."""
    features = feature_columns(table)
    joined = table.join(fold_of, "qid")
    n_folds = fold_of.agg(F.max("fold")).first()[0] + 1
    plan = F.array(*(F.struct(F.lit(name).alias("config"), F.lit(i).alias("held")) for name in settings for i in range(n_folds)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        config, held = pdf["config"].iloc[0], int(pdf["held"].iloc[0])
        rest, own = pdf[pdf["fold"] != held], pdf[(pdf["fold"] == held) & (pdf["is_pool"] == 1)]
        _, x, rel, qid = _arrays(rest, features)
        own, vx, _, _ = _arrays(own, features)
        total = np.mean([train(x, rel, qid, features, settings[config], seed).predict(vx) for seed in seeds], axis=0)
        judged = pdf[pdf["fold"] == held].groupby("qid")["relevance"].apply(lambda r: np.sort(r.to_numpy(float))[::-1])
        out = []
        own = own.assign(p=total)
        for q, ideal in judged.items():
            rows = own[own["qid"] == q]
            best = (ideal[:k] / np.log2(np.arange(2, min(k, len(ideal)) + 2))).sum()
            got = rows["relevance"].to_numpy(float)[np.argsort(-rows["p"].to_numpy(), kind="stable")][:k]
            out.append((config, held, q, float((got / np.log2(np.arange(2, len(got) + 2))).sum() / best) if best else 0.0))
        return pd.DataFrame(out, columns=["config", "fold", "qid", "ndcg"])

    kind = table.schema["qid"].dataType.simpleString()
    copies = joined.withColumn("plan", F.explode(plan)).select("*", "plan.config", "plan.held").drop("plan")
    # models take minutes where their rows take megabytes: as many tasks as keep most of them apart, whatever their size
    copies = copies.repartition(2 * n_folds * len(settings) + 10, "config", "held")
    return copies.groupBy("config", "held").applyInPandas(one, f"config string, fold int, qid {kind}, ndcg double")


def sample_settings(n: int, seed: int = 42) -> dict[str, dict]:
    """n random settings of the search space, named by their JSON."""
    rng = np.random.RandomState(seed)
    drawn = [{k: v[rng.randint(len(v))] for k, v in SEARCH_SPACE.items()} for _ in range(n)]
    return {json.dumps(s, sort_keys=True): s | {"early_stopping": 0} for s in drawn}
