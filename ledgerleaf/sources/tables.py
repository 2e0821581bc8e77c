"""Intermediate tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``; executors of a cluster don't see a folder of the driver's own, so without either it raises."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    given = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given.get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
