"""Set-based state changes: every mutation is a join or aggregate that yields the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bizdocs.operators.ordering import last_per

MUTABLE = ["item_name", "spec", "unit", "category", "standard_price", "active", "aliases"]


def upsert_master(current: DataFrame, new: DataFrame, mode: str = "upsert", errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new master, counts). The last row of a code inside one upload wins; ``replace`` empties the master first.

    ``errors``, the rejected rows of the upload, are counted as skipped."""
    flags = lambda df, inserted, updated, skipped: df.select(inserted.alias("i"), updated.alias("u"), F.lit(skipped).alias("s"))
    none = F.lit(False)

    def tally(done):
        rows = done if errors is None else done.unionByName(flags(errors, none, none, True))
        return rows.agg(F.count_if("i").alias("inserted"), F.count_if("u").alias("updated"), F.count_if("s").alias("skipped"))

    key = "internal_item_code"
    latest = last_per(new, [F.col(key).alias("_k0")], "row_number")
    if mode == "replace":
        out = latest.select(key, *MUTABLE)
        return out, tally(flags(out, F.lit(True), none, False))
    if mode != "upsert":
        raise ValueError(mode)
    n = latest.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"n_{c}") for c in MUTABLE])
    joined = current.withColumn("_old", F.lit(True)).join(n, key, "full_outer")
    out = joined.select(key, *[F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in MUTABLE])
    return out, tally(flags(joined, F.col("_new") & F.col("_old").isNull(), F.col("_new") & F.col("_old"), False))


def deactivate(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, key, "left").withColumn("active", F.coalesce("active", F.lit(True)) & F.col("_gone").isNull()).drop("_gone")


def bulk_delete(df: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def bulk_delete_count(df: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi").agg(F.count("*").alias("deleted"))


def enforce_default(templates: DataFrame) -> DataFrame:
    """At most one default per scope: the most recently updated claimant."""
    winners = templates.filter("is_default").groupBy("scope").agg(F.max_by("template_id", F.struct("updated_at", "template_id")).alias("_winner"))
    return templates.join(winners, "scope", "left").withColumn("is_default", F.coalesce(F.col("template_id") == F.col("_winner"), F.lit(False))).drop("_winner")


def replace_key_date(docs: DataFrame) -> DataFrame:
    """Replace the first key date that contains ``original_date``, else append ``new_date``."""
    dates = F.coalesce("key_dates", F.array().cast("array<string>"))
    at = F.array_position(F.transform(dates, lambda d: F.coalesce(d.contains(F.col("original_date")), F.lit(False))), F.lit(True))
    swapped = F.transform(dates, lambda d, i: F.when(i + 1 == at, F.col("new_date")).otherwise(d))
    return docs.withColumn("key_dates", F.when(F.coalesce(at, F.lit(0)) > 0, swapped).otherwise(F.concat(dates, F.array("new_date"))))
