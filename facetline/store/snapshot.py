"""A store of parquet tables in versions. A version is a manifest that names each table's folder: unchanged tables are
shared, a change is visible when its manifest is there, and one writer at a time wins."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from facetline.operators import dml
from facetline.sources.files import Files
from facetline.store.schema import CASCADES, TABLES


class Conflict(RuntimeError):
    """Another writer published first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        """root: a folder that the driver and all executors reach, by any path that Spark can."""
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = Files(spark, self.root)
        if self.version() < 0:
            self.publish({}, -1)

    def _manifests(self) -> dict[int, str]:
        p = self._path(f"{self.root}/_versions")
        if not self._fs.exists(p):
            return {}
        names = [f.getPath().getName() for f in self._fs.listStatus(p)]
        return {int(n[1:-5]): n for n in names if n.startswith("v") and n.endswith(".json")}

    def version(self) -> int:
        return max(self._manifests(), default=-1)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        v = self.version() if version is None else version
        if v < 0:
            return {}
        s = self._fs.open(self._path(f"{self.root}/_versions/v{v:08d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(s)))
        finally:
            s.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        path = self.manifest(version).get(name)
        if path is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{path}")

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {n: self.table(n, version) for n in TABLES}

    def publish(self, changed: dict[str, DataFrame], base: int) -> int:
        """Writes the changed tables and then the manifest of version base + 1, which must not exist yet."""
        m = self.manifest(base)
        for name, df in changed.items():
            path = f"{name}/{uuid.uuid4().hex}"
            df.selectExpr(*[f"cast({c.split()[0]} as {c.split(' ', 1)[1]}) as {c.split()[0]}" for c in TABLES[name].split(", ")]).write.parquet(f"{self.root}/{path}")
            m[name] = path
        # renamed only where no other writer's manifest is: compare and swap, and no reader sees half of it
        if not self._files.write(f"_versions/v{base + 1:08d}.json", json.dumps(m).encode(), replace=False):
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def reset(self) -> int:
        """An empty version of all tables."""
        return self.publish({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}, self.version())


def cascade(t: dict[str, DataFrame], names: set[str]) -> set[str]:
    """Removes what referred to removed rows of the named tables; returns all tables that changed."""
    for child, fk, parent in CASCADES:
        if parent in names:
            t[child] = dml.cascade(t[parent].select("id"), t[child], fk)
            names = names | {child}
    return names
