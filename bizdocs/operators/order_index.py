"""An order index for listings: a table written in sorted ranges, so that a deep page reads the ranges it lies in.

``browse.page`` finds a page by sorting, and an offset brings all earlier rows into one task. The index is written once
per sort order: rows are dealt out by ranges of (key, tie) into folders of about ``rows_per_part`` rows, whose counts
are kept beside them. A page number gives its folders by running counts; a cursor (the last row seen) needs no counts.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def sort_columns(sort_by: str, order: str, tie: str) -> list[Column]:
    """Descending puts nulls first, ascending last; ties ascend by ``tie``."""
    if order not in ("asc", "desc"):
        raise ValueError(order)
    key = F.col(sort_by).desc_nulls_first() if order == "desc" else F.col(sort_by).asc_nulls_last()
    return [key, F.col(tie).asc_nulls_first()]


def write_order_index(df: DataFrame, path: str, sort_by: str, order: str = "desc", tie: str = "document_id", rows_per_part: int = 1_000_000) -> None:
    """Write ``path``/rows and ``path``/counts. Rows of equal keys are split by ``tie``, so no value fills a range of its own.

    ``tie`` should be unique; equal rows share a range. An empty table gives an index without pages."""
    by = sort_columns(sort_by, order, tie)
    parts = max(1, ceil(df.count() / rows_per_part))
    placed = df.repartitionByRange(parts, *by).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(*by)
    placed.write.partitionBy("_p").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    rows.groupBy("_p").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")


def indexed_page(spark: SparkSession, path: str, schema, sort_by: str, order: str = "desc", page: int = 1, size: int = 25, tie: str = "document_id") -> DataFrame:
    """The page, from the folders that hold its rows; pages past the end are empty. ``schema``: that of the written table.

    What the driver reads is one number per folder."""
    counts = sorted(map(tuple, spark.read.schema("_p int, n long").parquet(f"{path}/counts").collect()))
    first, last = (page - 1) * size, page * size
    ends = list(accumulate(n for _, n in counts))
    held = [(p, end - n) for (p, n), end in zip(counts, ends) if end > first and end - n < last]
    stored = T.StructType([*schema.fields, T.StructField("_p", T.IntegerType())])
    rows = spark.read.schema(stored).parquet(f"{path}/rows").filter(F.col("_p").isin([p for p, _ in held]) if held else F.lit(False)).drop("_p")
    return rows.orderBy(*sort_columns(sort_by, order, tie)).offset(first - held[0][1] if held else 0).limit(size)


def page_after(df: DataFrame, sort_by: str, order: str, after_key, after_tie, size: int = 25, tie: str = "document_id") -> DataFrame:
    """The next ``size`` rows behind the row (after_key, after_tie), as a filter and a top-n; ``after_key`` None is the null key."""
    key, later = F.col(sort_by), F.col(tie) > F.lit(after_tie)
    if after_key is None:
        behind = key.isNull() & later
        behind = behind | key.isNotNull() if order == "desc" else behind
    else:
        at = F.lit(after_key)
        behind = (key < at if order == "desc" else (key > at) | key.isNull()) | ((key == at) & later)
    return df.filter(behind).orderBy(*sort_columns(sort_by, order, tie)).limit(size)
