"""Intermediate tables in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and
Spark runs within one machine, as in tests, a temporary folder of this machine is used; on a cluster
that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it is deleted when the program ends, or by ``drop``."""
    path = f"{shared_dir(spark)}/lexloom/{label}-{uuid.uuid4().hex}"
    _own.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost
    executor costs a re-read rather than a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")  # the shuffle files go as soon as the table is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path), path


@atexit.register
def _clean() -> None:
    for spark, path in _own:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
