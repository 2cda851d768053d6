"""Forecasting: assembly, boosted trees, ablation, selection and search, all over Spark MLlib.

Trees are trained by Spark; loops over feature sets or parameters run on the driver and hold only
metrics. Sampling is by hash of the row key, so runs repeat. A search that is given a log of trials looks there first, so
one that was stopped goes on where it was and trains no setting twice.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.scalar import clip
from gridlark.operators.metrics import error_metrics
from gridlark.sources.files import Trials


def align_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All features as doubles in this order's columns; absent ones and nulls are 0."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0) for f in features})


def train(df: DataFrame, features: Sequence[str], target: str, trees: int = 20, depth: int = 5, rate: float = 0.1, subsample: float = 0.8, seed: int = 42) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
        GBTRegressor(featuresCol="features", labelCol=target, predictionCol="raw", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, checkpointInterval=-1),
    ]
    return Pipeline(stages=stages).fit(align_features(df, features))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """prediction within [0, 1]."""
    return model.transform(align_features(df, features)).withColumn("prediction", clip(F.col("raw"), 0, 1)).drop("raw", "features")


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    v = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, v), strict=True), key=lambda x: (-x[1], x[0]))


def evaluate(fit: DataFrame, test: DataFrame, features: Sequence[str], target: str, **params) -> dict:
    m = train(fit, features, target, **params)
    row = error_metrics(predict(m, test, features), target, "prediction").first()
    return {"n_features": len(features), "mae": row.mae, "r2": row.r2}


def once(log: Trials | None, key: dict, run: Callable[[], dict]) -> dict:
    """The trial's result from the log, else run and logged."""
    got = None if log is None else log.get(key)
    if got is None:
        got = run()
        if log is not None:
            log.add(key, got)
    return got


def ablation(fit: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], target: str, log: Trials | None = None, **params) -> list[dict]:
    return [{"feature_set": k} | once(log, {"features": list(f)} | params, lambda f=f: evaluate(fit, test, f, target, **params)) for k, f in sets.items()]


def _r2(trial: dict) -> float:
    return float("-inf") if trial["r2"] is None else trial["r2"]


def backward_elimination(fit: DataFrame, test: DataFrame, features: Sequence[str], target: str, min_delta: float = 0.0, log: Trials | None = None, **params) -> list[dict]:
    """Drop the feature whose absence helps R2 most, while it helps by more than min_delta."""

    def trial(used: list[str]) -> dict:
        return once(log, {"features": used} | params, lambda: evaluate(fit, test, used, target, **params))

    cur = list(features)
    steps = [{"removed": None} | trial(cur)]
    while len(cur) > 1:
        trials = [{"removed": f} | trial([x for x in cur if x != f]) for f in cur]
        best = max(trials, key=_r2)
        if _r2(best) - _r2(steps[-1]) <= min_delta:
            break
        cur.remove(best["removed"])
        steps.append(best)
    return steps


def subset_search(fit: DataFrame, test: DataFrame, base: Sequence[str], extra: Sequence[str], most: int, target: str, log: Trials | None = None, **params) -> list[dict]:
    """All subsets of up to `most` extra features."""
    sets = [s for k in range(most + 1) for s in itertools.combinations(extra, k)]
    return [{"extra": "|".join(s)} | once(log, {"features": [*base, *s]} | params, lambda s=s: evaluate(fit, test, [*base, *s], target, **params)) for s in sets]


def sample_params(grid: dict[str, Sequence], n: int, seed: int = 42, seen: set | None = None) -> list[dict]:
    """n different settings of a discrete grid that are not in seen."""
    seen = set() if seen is None else seen
    every = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    left = [p for p in every if tuple(sorted(p.items())) not in seen]
    random.Random(seed).shuffle(left)
    return left[:n]


def near_params(grid: dict[str, Sequence], best: dict, radius: int = 1) -> dict[str, Sequence]:
    """The grid within so many places of the best setting."""
    out = {}
    for k, v in grid.items():
        order = sorted(v)
        i = order.index(best[k])
        out[k] = order[max(0, i - radius) : i + radius + 1]
    return out


def random_search(fit: DataFrame, valid: DataFrame, features: Sequence[str], target: str, grid: dict[str, Sequence], first: int, second: int, seed: int = 42, log: Trials | None = None) -> list[dict]:
    """Two stages: settings from the whole grid, then around the best one."""

    def trial(p: dict) -> dict:
        return p | once(log, {"features": list(features)} | p, lambda: evaluate(fit, valid, features, target, **p))

    done = [trial(p) for p in sample_params(grid, first, seed)]
    best = max(done, key=_r2)
    seen = {tuple(sorted((k, t[k]) for k in grid)) for t in done}
    return done + [trial(p) for p in sample_params(near_params(grid, {k: best[k] for k in grid}), second, seed + 1, seen)]


def parzen_proposal(grid: dict[str, Sequence], done: list[tuple[dict, float]], rnd: random.Random, share: float = 0.25, tries: int = 24) -> dict:
    """The next setting by the ratio of two densities: of the best `share` of the settings so far over the rest, the score being higher-better.

    Parameters are taken one by one. A density puts on each value of a parameter how many of the settings are at it, half as many for each place
    away, and one spread evenly over all. Of `tries` draws from the good density, the one with the largest ratio that was not tried is proposed.
    """
    order = sorted(done, key=lambda d: -d[1])
    cut = max(1, round(share * len(order)))
    seen = {tuple(p[k] for k in grid) for p, _ in done}

    def density(part: list[tuple[dict, float]], k: str) -> list[float]:
        values = list(grid[k])
        mass = [1 / len(values)] * len(values)
        for p, _ in part:
            at = values.index(p[k])
            kernel = [0.5 ** abs(i - at) for i in range(len(values))]
            mass = [m + x / sum(kernel) for m, x in zip(mass, kernel, strict=True)]
        return [m / sum(mass) for m in mass]

    good, bad = ({k: density(part, k) for k in grid} for part in (order[:cut], order[cut:]))
    draws = [{k: rnd.choices(range(len(grid[k])), good[k])[0] for k in grid} for _ in range(tries)]
    draws = [d for d in draws if tuple(grid[k][i] for k, i in d.items()) not in seen]
    if not draws:
        left = [c for c in itertools.product(*(range(len(v)) for v in grid.values())) if tuple(grid[k][i] for k, i in zip(grid, c, strict=True)) not in seen]
        draws = [dict(zip(grid, c, strict=True)) for c in left]
    if not draws:
        raise ValueError("every setting has been tried")
    best = max(draws, key=lambda d: sum(math.log(good[k][i] / bad[k][i]) for k, i in d.items()))
    return {k: grid[k][i] for k, i in best.items()}


def parzen_search(score: Callable[[dict], dict], grid: dict[str, Sequence], trials: int, start: int = 8, seed: int = 42, log: Trials | None = None, by: str = "r2") -> list[dict]:
    """Tree-structured Parzen search: `start` settings at random, then proposals from all results so far.

    score(setting) gives a trial's figures, of which `by` is to be large. Proposals depend on the seed and on the results only, so a
    search that finds its trials in the log proposes them again and goes on after the last.
    """
    rnd = random.Random(seed)
    out: list[dict] = []
    head = sample_params(grid, min(start, trials), seed)
    n = 1
    for v in grid.values():
        n *= len(v)
    while len(out) < min(trials, n):
        p = head[len(out)] if len(out) < len(head) else parzen_proposal(grid, [({k: t[k] for k in grid}, float("-inf") if t[by] is None else t[by]) for t in out], rnd)
        out.append(p | once(log, p, lambda p=p: score(p)))
    return out
