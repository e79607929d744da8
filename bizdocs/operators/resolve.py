"""Resolved document columns: date, party, amount, flags (all plain expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bizdocs.functions.numbers import amount, is_text, loose_decimal
from bizdocs.functions.text import has_profile

VERIFIED = ["confirmed", "completed"]
UNKNOWN_PARTY = "거래처 미확인"
UNKNOWN_ITEM = "품목 미확인"
ACTIONABLE = ["needs_review", "ready", "confirmed", "completed"]


def present(col) -> Column:
    """NULL for an empty string; whitespace is kept (it still wins a fall-through)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c, F.lit(""))


def is_verified() -> Column:
    return F.col("processing_status").isin(VERIFIED) | F.coalesce(F.col("review.approved"), F.lit(False))


def fresh_mapping() -> Column:
    """The confirmed mapping counts only outside review and when stamped no earlier than the confirmation."""
    in_time = F.coalesce(F.col("mapping.created_at") >= F.col("mapping.confirmed_at"), F.lit(False))
    return ~F.coalesce(F.col("review_required"), F.lit(False)) & is_verified() & in_time


def mapped(field: str) -> Column:
    return F.when(fresh_mapping(), F.col(f"mapping.fields.{field}"))


def document_date() -> Column:
    return F.coalesce(
        F.try_to_date(F.substring(mapped("issue_date"), 1, 10), "yyyy-MM-dd"),
        "issue_date", "extracted_date", F.to_date("created_at"),
    )


def party_name() -> Column:
    chain = F.coalesce(
        present(mapped("customer_name")), present(mapped("vendor_name")),
        present("customer_name"), present("vendor_name"), present("merchant_name"),
    )
    return F.coalesce(F.nullif(F.trim(chain), F.lit("")), F.lit(UNKNOWN_PARTY))


def explicit_amount(docs: DataFrame) -> Column:
    """First truthy mapped total (text, so '0' is truthy), else the extracted amount, even 0."""
    names = ["document_total", "payment_total", "estimated_total", "krw_converted", "total_usd"]
    chosen = F.coalesce(*[present(mapped(n)) for n in names])
    return F.when(chosen.isNotNull(), loose_decimal(chosen)).otherwise(amount(docs, "extracted_amount"))


def line_amount(lines: DataFrame) -> Column:
    """supply, else total, else line amount; an early 0 or blank falls through."""
    names = [n for n in ("supply_amount", "line_total", "line_amount") if n in lines.columns]

    def early(n: str) -> Column:
        return present(n) if is_text(lines, n) else F.nullif(F.col(n), F.lit(0).cast(dict(lines.dtypes)[n]))

    raw = F.coalesce(*[early(n) for n in names[:-1]], F.col(names[-1]))
    return loose_decimal(raw) if is_text(lines, names[0]) else raw


def amount_required() -> Column:
    refused = F.coalesce(F.col("taxonomy.amount_required") == F.lit(False), F.lit(False))
    profile = F.coalesce(F.col("taxonomy.document_profile") == "no_price_document", F.lit(False))
    return ~(refused | profile | has_profile("taxonomy.document_profiles", "no_price_document"))


def document_type() -> Column:
    return F.coalesce(present(F.when(fresh_mapping(), F.col("mapping.category"))), present("document_type"), F.lit("unknown"))


def is_review_actionable() -> Column:
    s = F.col("processing_status")
    return (s == "needs_review") | (F.coalesce(F.col("review_required"), F.lit(False)) & s.isin(ACTIONABLE))


def effective_lines(docs: DataFrame, lines: DataFrame, mapping_lines: DataFrame | None = None, fresh: Column | None = None) -> DataFrame:
    """Lines of the confirmed mapping where it is fresh and has any, else the document's own."""
    if mapping_lines is None:
        return lines
    fresh = docs.filter(fresh_mapping() if fresh is None else fresh).select("document_id")
    theirs = mapping_lines.join(fresh, "document_id", "left_semi")
    own = lines.join(theirs.select("document_id").distinct(), "document_id", "left_anti")
    return own.unionByName(theirs, allowMissingColumns=True)


def line_stats(lines: DataFrame) -> DataFrame:
    """One partial-aggregated pass over the lines: totals and defect counts per document."""
    a = line_amount(lines)
    qty, price = amount(lines, "quantity"), amount(lines, "unit_price")
    blank_name = F.trim(F.coalesce(F.col("item_name"), F.lit(""))) == ""
    return lines.groupBy("document_id").agg(
        F.sum(a).alias("line_sum"),
        F.count("*").alias("n_lines"),
        F.count_if(blank_name | qty.isNull()).alias("n_missing"),
        F.count_if(price.isNull() & a.isNull()).alias("n_missing_amount"),
        F.count_if(F.abs(qty * price - a) > 1).alias("n_mismatch"),
    )


def document_amount(docs: DataFrame, lines: DataFrame, mapping_lines: DataFrame | None = None) -> DataFrame:
    lines = effective_lines(docs, lines, mapping_lines)
    sums = lines.groupBy("document_id").agg(F.sum(line_amount(lines)).alias("line_sum"))
    return docs.join(sums, "document_id", "left").select("document_id", F.coalesce(explicit_amount(docs), "line_sum").alias("amount"))


def readiness() -> Column:
    s, approved = F.col("processing_status"), F.coalesce(F.col("review.approved"), F.lit(False))
    return (
        F.when(s == "failed", "실패")
        .when(s.isin("uploaded", "queued", "processing"), "처리 중")
        .when(F.col("review_required") & ~approved, "검토 필요")
        .when(F.coalesce(F.col("uncertain_count"), F.lit(0)) > 0, "검토 후보 있음")
        .when((s == "confirmed") | approved, "승인됨")
        .otherwise("Ready")
    )


def schedule_date(requested: list[str] = ()) -> Column:
    """Date with its role and label; an issue date is only a marked fallback."""
    iso = lambda c: F.nullif(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    req = F.coalesce(*[iso(F.col(r)) for r in requested], F.lit(None).cast("string"))
    due = iso(F.col("due_date"))
    key = F.try_element_at(F.filter(F.transform("key_dates", iso), lambda v: v.isNotNull()), F.lit(1))
    issue = iso(F.coalesce("issue_date", "extracted_date"))
    pick = lambda d, role, label, fallback: F.struct(d.alias("date"), F.lit(role).alias("role"), F.lit(label).alias("label"), F.lit(fallback).alias("fallback"))
    return (
        F.when(req.isNotNull(), pick(req, "requested_delivery_date", "납기요청일", False))
        .when(due.isNotNull(), pick(due, "due_date", "납기일", False))
        .when(key.isNotNull(), pick(key, "key_date", "문서 일정", False))
        .when(issue.isNotNull(), pick(issue, "issue_date", "발행일 기준", True))
    )
