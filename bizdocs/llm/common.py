"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bizdocs.session import checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"  # what separates words: \x20 and \x09-\x0D


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate as a Parquet table in the shared folder and read it back.

    Unlike an RDD checkpoint the table is columnar and compressed, is read with column pruning and
    filters, and its rows never change again, whatever executors are lost later.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Map Arrow batches with a function that is built once per task (models, caches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            if batch.num_rows:
                fn = fn or make()
                yield fn(batch)

    return df.mapInArrow(run, schema)


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8, so that Python sees bytes: their lower() changes A-Z only and their split() cuts at ``WHITE`` only."""
    return F.col(column).cast("binary")


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null text has none."""
    inner = F.trim(text, F.lit(WHITE))
    return F.when(inner != "", F.split(inner, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def chunks(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts of a batch in runs of about ``most`` bytes, so that long texts do not add up in memory."""
    texts, size, start = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        texts.append(value.as_py())
        size += len(texts[-1] or b"")
        if size >= most:
            yield start, texts
            texts, size, start = [], 0, i + 1
    if texts:
        yield start, texts


class Remember(dict):
    """A dict that computes missing values and starts anew when full, so a task's memory stays bounded."""

    def __init__(self, fn: Callable, limit: int = 400_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value
