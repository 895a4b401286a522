"""Lineage cuts through the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (a local session) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="veilgrid-"))
        at = _own[0]
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that a loop's plan stays small and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/veilgrid/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
