"""Session helpers."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, so it is computed once and survives lost executors.

    It is a Parquet table in the shared folder: compressed, read with column pruning and filters, and written by one
    run of the plan, where an RDD checkpoint runs it twice. Rows of a type that Parquet lacks are checkpointed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid4().hex}"
    if "void" in df.schema.simpleString():
        return df.checkpoint()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
