"""Stage tables in the folder that the driver and the executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master whose session names no spark.checkpoint.dir.
FALLBACK = "/tmp/checkpoints/verbatik"


def stage_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
    return named or FALLBACK


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that is read again: cuts lineage and outlives executors."""
    path = f"{stage_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
