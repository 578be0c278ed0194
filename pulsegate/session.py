"""Session settings and fault-tolerant materialisation."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions and sizes shuffles at run time; the object-hash
# threshold keeps map-side aggregation of wide groups from falling back to a sort.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs more than building these plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
}


def build_session(master: str | None = None, app: str = "pulsegate", **extra: str) -> SparkSession:
    """Create or reuse a session; pass ``master`` for local runs only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="pulsegate-checkpoint-")
    context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage.

    Used where later steps rely on which partition a row fell into: the files keep
    that assignment when executors are lost.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one job in a folder of their own under the checkpoint folder; ``close`` deletes them.

    For intermediate results that no later step reads: unlike ``durable`` they leave nothing behind.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._tables = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __call__(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again."""
        self._tables += 1
        path = f"{self.root}/{self._tables}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        base = os.path.join(tempfile.mkdtemp(prefix="pulsegate-package-"), "pulsegate")
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
    _SHIPPED.add(context.applicationId)
