"""Shapley values of tree ensembles: what each feature adds to a prediction, and pairs of features together.

The game is the path-dependent one: a feature that is not known sends a row down both sides of a split, by the shares of training rows
that went there. A leaf's part in a prediction is then its value times one factor for each feature on its path: 1 or 0 if the feature is
known (the row fits the path's splits on it or not), else the product of the shares. Shapley values of such a product depend on the row only through
which features fit, so each leaf has a small table by that pattern, filled for patterns that occur; a batch of rows looks them up.
Leaves of a path of m features have 2^m patterns at most, and m is at most the depth.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.operators.ml import align_features

BATCH = 1 << 12


@dataclass
class Leaf:
    """value: the leaf's part of the sum, the tree's weight included; bounds: (feature, above, up to) of its path; share: by feature."""

    value: float
    bounds: list[tuple[int, float, float]]
    share: list[float]
    known: dict[int, np.ndarray] = field(default_factory=dict)

    def fits(self, x: np.ndarray) -> np.ndarray:
        """Pattern of each row: bit i tells whether the row fits the path's splits on its i-th feature."""
        out = np.zeros(len(x), np.int64)
        for i, (f, low, high) in enumerate(self.bounds):
            out |= ((x[:, f] > low) & (x[:, f] <= high)).astype(np.int64) << i
        return out


def _spread(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Coefficients of the product of (z + o t): by number of known features, the sum over all sets of that number."""
    c = np.ones(1)
    for a, b in zip(o, z, strict=True):
        c = np.append(c * b, 0.0) + np.append(0.0, c * a)
    return c


def _shapley(leaf: Leaf, pattern: int) -> np.ndarray:
    m = len(leaf.bounds)
    o, z = np.array([pattern >> i & 1 for i in range(m)], float), np.array(leaf.share)
    weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
    return np.array([leaf.value * (o[i] - z[i]) * (_spread(np.delete(o, i), np.delete(z, i)) @ weight) for i in range(m)])


def _pairs(leaf: Leaf, pattern: int) -> np.ndarray:
    """m x m: half of each pair's joint part at either place, on the diagonal what is left of the feature's own value."""
    m = len(leaf.bounds)
    o, z = np.array([pattern >> i & 1 for i in range(m)], float), np.array(leaf.share)
    out = np.zeros((m, m))
    if m > 1:
        weight = np.array([factorial(k) * factorial(m - k - 2) / factorial(m - 1) for k in range(m - 1)]) / 2
        for i in range(m):
            for j in range(i):
                rest = _spread(np.delete(o, [i, j]), np.delete(z, [i, j])) @ weight
                out[i, j] = out[j, i] = leaf.value * (o[i] - z[i]) * (o[j] - z[j]) * rest
    out[np.diag_indices(m)] = _shapley(leaf, pattern) - out.sum(1)
    return out


def leaves_of(node: dict, weight: float = 1.0) -> list[Leaf]:
    """Leaves of a tree of dicts: {"value", "cover"} or {"feature", "threshold", "cover", "left", "right"}, left up to the threshold."""
    out: list[Leaf] = []
    todo = [(node, {}, {})]
    while todo:
        at, bounds, share = todo.pop()
        if "left" not in at:
            keys = sorted(bounds)
            out.append(Leaf(weight * at["value"], [(f, *bounds[f]) for f in keys], [share[f] for f in keys]))
            continue
        f, t = at["feature"], at["threshold"]
        low, high = bounds.get(f, (-np.inf, np.inf))
        for side, b in (("right", (max(low, t), high)), ("left", (low, min(high, t)))):
            todo.append((at[side], bounds | {f: b}, share | {f: share.get(f, 1.0) * at[side]["cover"] / at["cover"]}))
    return out


def model_leaves(model: PipelineModel) -> list[Leaf]:
    """Leaves of a boosted-tree model of gridlark.operators.ml; the model is on the driver anyway."""
    gbt = model.stages[-1]

    def told(n) -> dict:
        cover = float(n.impurityStats().count())
        if n.subtreeDepth() == 0:
            return {"value": n.prediction(), "cover": cover}
        s = n.split()
        if s.getClass().getSimpleName() != "ContinuousSplit":
            raise TypeError("attribution needs splits on numbers")
        return {"feature": s.featureIndex(), "threshold": s.threshold(), "cover": cover, "left": told(n.leftChild()), "right": told(n.rightChild())}

    out: list[Leaf] = []
    for tree, weight in zip(gbt.trees, gbt.treeWeights, strict=True):
        out += leaves_of(told(tree._java_obj.rootNode()), weight)
    return out


def mean_value(leaves: Sequence[Leaf]) -> float:
    """The prediction without any feature: the mean over the training rows."""
    return float(sum(x.value * np.prod(x.share) for x in leaves))


def _table(leaf: Leaf, pattern: np.ndarray, of) -> np.ndarray:
    seen, at = np.unique(pattern, return_inverse=True)
    for p in seen.tolist():
        if p not in leaf.known:
            leaf.known[p] = of(leaf, p)
    return np.stack([leaf.known[p] for p in seen.tolist()])[at]


def _matrix(b: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.stack([b[f].to_numpy(zero_copy_only=False).astype(float) for f in features], axis=1) if features else np.zeros((b.num_rows, 0))


def attribute(leaves: Sequence[Leaf], df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows (keys, mean, prediction, parts array): parts by feature in order; mean and parts add up to the prediction. Nulls and absent features are 0."""
    leaves, base, n = list(leaves), mean_value(leaves), len(features)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for i in range(0, whole.num_rows, BATCH):
                b = whole.slice(i, BATCH)
                x = _matrix(b, features)
                parts, total = np.zeros((b.num_rows, n)), np.zeros(b.num_rows)
                for leaf in leaves:
                    pattern = leaf.fits(x)
                    total += np.where(pattern == (1 << len(leaf.bounds)) - 1, leaf.value, 0.0)
                    if leaf.bounds:
                        np.add.at(parts.T, [f for f, _, _ in leaf.bounds], _table(leaf, pattern, _shapley).T)
                arrays = [*(b[k] for k in keys), pa.array(np.full(b.num_rows, base)), pa.array(total), pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel()), n).cast(pa.list_(pa.float64()))]
                yield pa.record_batch(arrays, names=[*keys, "mean", "prediction", "parts"])

    rows = align_features(df.select(*keys, *[f for f in features if f in df.columns and f not in keys]), [f for f in features if f not in keys])
    kinds = dict(rows.dtypes)
    return rows.select(*keys, *[f for f in features if f not in keys]).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", mean double, prediction double, parts array<double>")


def mean_abs_parts(attributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (feature, mean_abs) over all attributed rows, in one aggregate."""
    names = F.array(*[F.lit(f) for f in features])
    return attributed.select(F.posexplode("parts").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs")).select(F.element_at(names, F.col("i") + 1).alias("feature"), "mean_abs")


def interaction_matrix(leaves: Sequence[Leaf], df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (feature, other, mean_abs): mean absolute interaction of each pair, the feature's own part on the diagonal.

    A task adds up its rows' absolute values, so one small matrix a task is shuffled, not one a row.
    """
    leaves, n = list(leaves), len(features)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((n, n)), 0
        for whole in it:
            for i in range(0, whole.num_rows, 256):
                x = _matrix(whole.slice(i, 256), features)
                rows = np.zeros((len(x), n, n))
                for leaf in leaves:
                    if leaf.bounds:
                        at = np.array([f for f, _, _ in leaf.bounds])
                        rows[:, at[:, None], at[None, :]] += _table(leaf, leaf.fits(x), _pairs)
                total += np.abs(rows).sum(0)
                count += len(x)
        a, b = np.divmod(np.arange(n * n), n)
        if count:
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(total.ravel()), pa.array(np.full(n * n, count))], names=["i", "j", "total", "n"])

    rows = align_features(df.select(*[f for f in features if f in df.columns]), features).select(*features)
    sums = rows.mapInArrow(run, "i long, j long, total double, n long").groupBy("i", "j").agg((F.sum("total") / F.sum("n")).alias("mean_abs"))
    names = F.array(*[F.lit(f) for f in features])
    return sums.select(F.element_at(names, (F.col("i") + 1).cast("int")).alias("feature"), F.element_at(names, (F.col("j") + 1).cast("int")).alias("other"), "mean_abs")
