"""Intermediate tables in the shared folder, which cut lineage and survive lost executors.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where that is
unset (local sessions, tests) a folder under the system's temporary directory is used, and
only if the master is a local one: executors of a cluster could not see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, as a URI that every executor can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="marlspike-")
    return _local[app]


class Scratch:
    """Parquet tables of one operator call; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marlspike/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def save(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df.scratch_path)

    def free_shuffles(self) -> None:
        """Shuffle files of finished queries go once the driver's JVM has collected their plans.

        Python lets go of its handles a moment after they are collected, so one collection isn't enough.
        """
        import gc
        import time

        for _ in range(3):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


def purge(spark: SparkSession) -> None:
    """Remove every scratch table of this shared folder. Results that read them become invalid."""
    _delete(spark, f"{shared_dir(spark)}/marlspike")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
