"""Artifacts between phases: written tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """Where the cluster keeps shared files; a local folder where it names none and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tenderlake-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


_made: list[tuple[SparkSession, str]] = []


def drop_stored() -> None:
    """Delete all tables that stored wrote, once nothing reads them any more; done at the driver's end anyway."""
    while _made:
        spark, path = _made.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass


atexit.register(drop_stored)


def keep_track(spark: SparkSession, path: str) -> None:
    """Count a path among those that drop_stored deletes."""
    _made.append((spark, path))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/artifacts/{name}-{uuid.uuid4().hex}"
    keep_track(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
