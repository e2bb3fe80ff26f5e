"""Parquet tables, spread over the cores where a file is too small to be split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Below so many bytes for each core, a scan of few files is dealt out.
SMALL = 64 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows reach all cores.

    A file of one row group is one task however long its texts take, and splits by
    bytes leave the other tasks empty.  So the rows of a small input in few files
    are dealt out once.  Larger inputs have splits enough and are not touched.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size < SMALL * cores and 2 * len(scan.inputFiles()) < cores
    return scan.repartition(cores) if small else scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of tables; those with texts are spread."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in ("documents", "pages") else scan
