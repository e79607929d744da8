"""Row numbers inside groups of any size, and first, last and top rows per group.

A plain ``row_number()`` gathers a whole group into one task. ``number_rows`` deals the rows out by ranges of
(key, order), so a large group spans several partitions, counts each group's rows per partition, and numbers a row by
the count of earlier partitions plus its place in its own. One path for every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bizdocs.session import cut


def number_rows(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Add ``out`` = 1-based position of the row within ``key`` by the unique, non-null number ``order``."""
    placed = cut(df.repartitionByRange(F.col(key), F.col(order)).withColumn("_b", F.spark_partition_id()))
    counts = placed.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_p")).agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("_k", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order))
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_p"))
    numbered = placed.withColumn("_r", inside).join(earlier, same)
    return numbered.select(*df.columns, (F.col("_off") + F.col("_r")).cast("long").alias(out))


WHOLE = 65_536  # rows of a key that one task numbers


def number_short(df: DataFrame, key: str, order: str, out: str, rows: DataFrame, whole: int | None = None) -> DataFrame:
    """``number_rows``, and in ``<out>_of`` the rows of the key, for keys that are mostly short.

    Short keys are numbered where they meet anyway, by hash of the key, so that joins and groups on it move nothing again.
    Keys of more than ``whole`` (65,536) rows in ``rows`` (a table that has no fewer of any key) are dealt out by ranges as in
    ``number_rows``; only these are written and moved once more."""
    of = f"{out}_of"
    per_key = Window.partitionBy(key)
    numbered = lambda d: d.withColumns({out: F.row_number().over(per_key.orderBy(order)).cast("long"), of: F.count("*").over(per_key)})
    large = rows.groupBy(key).agg(F.count("*").alias("_c")).filter(F.col("_c") > (whole or WHOLE)).select(key)
    if large.isEmpty():
        return numbered(df)
    large, df = cut(large), cut(df)
    hot = number_rows(df.join(large, key, "left_semi"), key, order, out)
    hot = hot.join(df.join(large, key, "left_semi").groupBy(key).agg(F.count("*").alias(of)), key)
    return numbered(df.join(large, key, "left_anti")).unionByName(hot)


def first_per(df: DataFrame, keys: list, order) -> DataFrame:
    """First row per key as an aggregate: partial results are combined before the
    shuffle, so a hot key costs one candidate row per map task."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def last_per(df: DataFrame, keys: list, order) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def top_per(df: DataFrame, keys: list[str], order: list, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The ``row_number() <= n`` filter lets Spark drop all but
    ``n`` rows per key in every map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
