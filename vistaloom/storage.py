"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, which only a local master allows."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="vistaloom-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(given := f"file://{own}")
    return given.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/vistaloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: list[str] | None = None, compression: str = "zstd") -> DataFrame:
    """df as Parquet in the shared folder, read again: the lineage is cut and lost executors lose nothing. by: columns that become folders."""
    path = place(df.sparkSession, name)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
