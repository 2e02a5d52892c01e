"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only on a local master that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tallyglass-")
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def staged(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet and read again; the table goes when Python ends, or by `discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyglass-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{tag}")
    atexit.register(_delete, spark, path)
    table = spark.read.schema(df.schema).parquet(f"{path}/{tag}")
    table._staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    for table in tables:
        _delete(table.sparkSession, table._staged_at)
