"""What requests on a road network and a history share, built once in a store: see gridlark.sources.artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import graph, ml
from gridlark.operators.iterate import scratch
from gridlark.sources.artifacts import Store


def default_store(spark: SparkSession) -> Store:
    """A store in the folder that executors share."""
    return Store(spark, f"{scratch(spark)}/artifacts")


def hierarchy(store: Store, name: str, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contraction hierarchy (ranks, edges) of a graph."""

    def build() -> dict[str, DataFrame]:
        ranks, ch = graph.contract(edges, nodes)
        return {"ranks": ranks, "edges": ch}

    got = store.tables(name, "contraction hierarchy", {"edges": edges.select("u", "v", "w"), "nodes": nodes.select("id")}, build)
    return got["ranks"], got["edges"]


def landmarks(store: Store, name: str, edges: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Costs from and to `count` landmarks of a graph."""

    def build() -> dict[str, DataFrame]:
        return {"costs": graph.landmark_table(edges, graph.select_landmarks(nodes, edges, count))}

    return store.tables(name, "landmarks", {"edges": edges.select("u", "v", "w"), "nodes": nodes.select("id", "x", "y")}, build, {"count": count})["costs"]


def trained(store: Store, name: str, rows: DataFrame, features: Sequence[str], target: str, **params) -> PipelineModel:
    """A boosted-tree model of these rows; the features' order is part of the version."""
    used = rows.select(*features, F.col(target))
    return store.model(name, {"rows": used}, lambda: ml.train(rows, features, target, **params), {"features": list(features), "target": target} | params)
