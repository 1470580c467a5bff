"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "facetline", master: str | None = None, partitions: int | None = None, more: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the engine is designed for; nothing here is needed on a cluster that sets its own."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (more or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


class Scratch:
    """Tables written to the shared folder, to cut lineage so that a lost executor costs one table read.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and Spark runs in one
    process (tests) a temporary folder is used. ``cut`` and ``dealt`` write and reread; ``drop`` deletes a table no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("FACETLINE_LOCAL_SCRATCH")
        if not base and not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not base:
            base = os.environ["FACETLINE_LOCAL_SCRATCH"] = tempfile.mkdtemp(prefix="facetline-")
        self.base = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._facetline_scratch = path
        return out

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """cut(), dealt to as many buckets as shuffles have partitions: joins on the key do not move this table again."""
        self.n += 1
        path, name, n = f"{self.base}/t{self.n}", f"facetline_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, key).write.option("compression", "zstd").bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        out._facetline_scratch, out._facetline_table = path, name
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps that are over: it does so when the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_facetline_scratch", None)
        if getattr(df, "_facetline_table", None):
            self.spark.sql(f"DROP TABLE IF EXISTS {df._facetline_table}")
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
