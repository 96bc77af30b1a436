"""Shared scratch space for cut lineages and handed-over tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: the session's ``spark.checkpoint.dir``.

    Where it is unset, a folder below the session's warehouse is used. On a cluster
    that must not be a local folder, which only the driver sees.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
            folder = spark._jvm.org.apache.hadoop.fs.Path(named)
            named = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
            if not is_shared(sc.master, named):
                raise ValueError(f"set spark.checkpoint.dir to a folder that the executors share; {named} is local")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def is_shared(master: str, path: str) -> bool:
    """Can executors under ``master`` see the qualified ``path``: any does for one JVM, no ``file:`` path beyond it."""
    return master.split("[")[0] == "local" or not path.startswith("file:")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and continue from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Hand ``df`` over as a columnar table, so later reads prune columns."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def load_or_empty(reader: DataFrameReader, spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """What ``reader`` finds at ``path``; an empty frame when nothing is there."""
    try:
        return reader.load(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)
