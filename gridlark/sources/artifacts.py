"""What is built once and used by many requests: hierarchies, landmark tables, profiles and models, in a versioned store.

A version lies in <root>/<name>/<fingerprint>. The fingerprint tells the rows, columns and parameters it was made from, so a request
on the same inputs reads and one on changed inputs builds anew. The description (kind, schemas, parameters) is written last:
a version without it is unfinished and is built again. Everything goes through Spark's readers and writers, so any store works.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


def fingerprint(inputs: dict[str, DataFrame], params: dict | None = None) -> str:
    """A digest of the rows (in any order), the columns and the parameters; one aggregate of one pass over each input."""
    told: list = [params or {}]
    for name, df in sorted(inputs.items()):
        h = F.xxhash64(*[F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema])
        row = df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(h))).first()
        told.append([name, df.schema.simpleString(), *map(str, row)])
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:24]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str) -> list[dict]:
        """Descriptions of the finished versions, the oldest first."""
        try:
            rows = self.spark.read.text(f"{self.root}/{name}/*/about", wholetext=True).collect()  # a row a version
        except AnalysisException:
            return []
        return sorted((json.loads(r.value) for r in rows), key=lambda v: v["built"])

    def tables(self, name: str, kind: str, inputs: dict[str, DataFrame], build: Callable[[], dict[str, DataFrame]], params: dict | None = None) -> dict[str, DataFrame]:
        """The tables made from these inputs; built and kept first where there is no such version."""
        about, path, mark = self._find(name, kind, inputs, params)
        if about is None:
            schemas = {}
            for part, df in build().items():
                df.write.mode("overwrite").parquet(f"{path}/{part}")
                schemas[part] = json.loads(df.schema.json())
            about = self._finish(name, mark, kind, params, schemas)
        return self._read(name, about)

    def model(self, name: str, inputs: dict[str, DataFrame], build: Callable[[], PipelineModel], params: dict | None = None) -> PipelineModel:
        """The model trained on these inputs with these parameters."""
        about, path, mark = self._find(name, "model", inputs, params)
        if about is None:
            made = build()
            if not isinstance(made, PipelineModel):
                raise TypeError(f"{name}: not a PipelineModel but {type(made).__name__}")
            made.write().overwrite().save(f"{path}/model")
            self._finish(name, mark, "model", params, {})
        return PipelineModel.load(f"{path}/model")

    def load(self, name: str, kind: str) -> dict[str, DataFrame] | PipelineModel:
        """The newest version, whatever it was made from."""
        found = self.versions(name)
        if not found:
            raise FileNotFoundError(f"{name}: no finished version in {self.root}")
        about = self._checked(name, kind, found[-1])
        return PipelineModel.load(f"{self.root}/{name}/{about['mark']}/model") if kind == "model" else self._read(name, about)

    def _find(self, name: str, kind: str, inputs: dict[str, DataFrame], params: dict | None) -> tuple[dict | None, str, str]:
        found = self.versions(name)
        for about in found:
            self._checked(name, kind, about)
        mark = fingerprint(inputs, params)
        return next((v for v in found if v["mark"] == mark), None), f"{self.root}/{name}/{mark}", mark

    def _checked(self, name: str, kind: str, about: dict) -> dict:
        if about["kind"] != kind:
            raise TypeError(f"{name} is of kind {about['kind']}, not {kind}")
        return about

    def _finish(self, name: str, mark: str, kind: str, params: dict | None, schemas: dict) -> dict:
        about = {"name": name, "mark": mark, "kind": kind, "params": params or {}, "schemas": schemas, "built": time.time()}
        self.spark.createDataFrame([(json.dumps(about, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}/{mark}/about")
        return about

    def _read(self, name: str, about: dict) -> dict[str, DataFrame]:
        out = {}
        for part, schema in about["schemas"].items():
            df, want = self.spark.read.parquet(f"{self.root}/{name}/{about['mark']}/{part}"), StructType.fromJson(schema)
            if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
                raise TypeError(f"{name}/{part} has other columns than when it was built: {df.schema.simpleString()}")
            out[part] = df
        return out
