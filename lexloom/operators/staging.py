"""Tables between the steps of a fixpoint or a two-pass operator, in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and Spark
runs within one machine, as in tests, a temporary folder of this machine stands in; elsewhere that is
an error. A written table cuts the lineage, and a lost executor costs a re-read.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written once and read back; the table goes when the program ends."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/lexloom-steps/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that goes when the program ends."""
    path = f"{_folder(spark)}/lexloom-steps/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
