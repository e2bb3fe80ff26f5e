"""Intermediate tables that survive lost executors, deleted when no longer needed and at the end of the driver.

Long plans are cut by writing a table to the folder all executors share and
reading it back.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only a ``local[...]`` session may fall back to a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quillon-scratch-")
    spark.conf.set(_KEY, made)
    return made


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Shuffle files of queries made and run inside go as each query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """A set of written tables under one folder: removed by :meth:`drop`, and what is left when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        _open.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a scan of what was written."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables named, or all of them; frames that scan them must not be used afterwards."""
        for name in names or ("",):
            path = self._paths(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self._conf).delete(path, True)


_open: list[Scratch] = []


@atexit.register
def _clean() -> None:
    for scratch in _open:
        try:
            scratch.drop()
        except Exception:  # noqa: BLE001  the JVM may be gone, and the tables then stay
            return
