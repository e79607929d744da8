"""Periodic transaction report: one narrow resolved base, five aggregates.

``report_base`` is the only place where lines meet documents: lines are
pre-aggregated per document (map-side combine, so one huge document costs a few
partial rows) and joined once. Every breakdown then reads that base.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from bizdocs.functions.dates import range_label
from bizdocs.functions.numbers import amount, money
from bizdocs.functions.text import party_key
from bizdocs.operators import resolve as R

ZERO = F.lit


def in_range(docs: DataFrame, start: dt.date, end: dt.date, compat: bool = False) -> DataFrame:
    """Half-open test on the resolved date. ``compat`` adds the coarse test on the three
    stored dates, which can be pushed to the scan and loses mapping-only dates."""
    lo, hi = F.lit(start), F.lit(end)
    if compat:
        between = lambda c: (F.col(c) >= lo) & (F.col(c) < hi)
        docs = docs.filter(between("issue_date") | between("extracted_date") | between("created_at"))
    return docs.filter((R.document_date() >= lo) & (R.document_date() < hi))


def party_equals(docs: DataFrame, name: str) -> DataFrame:
    return docs.filter(party_key(R.party_name()) == party_key(F.lit(name)))


def report_base(docs: DataFrame, lines: DataFrame | None = None, mapping_lines: DataFrame | None = None) -> DataFrame:
    """Resolved columns per document; with ``lines`` also totals and defect counts.

    With ``mapping_lines`` pass ``resolve.effective_lines`` of the same tables to the line-level parts."""
    out = docs.select(
        "document_id", "document_number",
        R.document_type().alias("doc_type"), R.document_date().alias("doc_date"), R.party_name().alias("party"),
        R.is_verified().alias("verified"), R.amount_required().alias("amount_required"),
        F.coalesce("review_required", F.lit(False)).alias("review_required"),
        R.explicit_amount(docs).alias("explicit_amount"),
    )
    if lines is None:
        return out
    out = out.join(R.line_stats(R.effective_lines(docs, lines, mapping_lines)), "document_id", "left")
    return out.withColumn("doc_amount", F.coalesce("explicit_amount", "line_sum"))


def _paid() -> Column:
    return F.coalesce(F.sum(F.when(F.col("verified"), F.col("doc_amount"))), F.lit(0))


def has_missing() -> Column:
    """A document-level or line-level required value is absent."""
    return (
        (F.col("party") == R.UNKNOWN_PARTY) | F.col("doc_date").isNull() | F.col("n_lines").isNull()
        | (F.coalesce("n_missing", F.lit(0)) > 0)
        | (F.col("amount_required") & (F.coalesce("n_missing_amount", F.lit(0)) > 0))
    )


def has_mismatch() -> Column:
    return F.col("amount_required") & (F.coalesce("n_mismatch", F.lit(0)) > 0)


def report_summary(base: DataFrame) -> DataFrame:
    return base.agg(
        F.count("*").alias("total_documents"),
        F.count_if("verified").alias("verified_documents"),
        F.count_if(~F.col("verified")).alias("pending_documents"),
        money(_paid()).alias("total_amount"),
        F.count_if(has_missing() | has_mismatch() | ~F.col("verified")).alias("documents_with_errors"),
        F.count_if(~F.col("amount_required")).alias("no_price_documents"),
        F.count_if("review_required").alias("review_required_documents"),
    )


def by_party(base: DataFrame) -> DataFrame:
    return base.filter("verified").groupBy(F.col("party").alias("name")).agg(
        F.count("*").alias("document_count"),
        money(F.coalesce(F.sum("doc_amount"), F.lit(0))).alias("total_amount"),
    )


def by_item(base: DataFrame, lines: DataFrame) -> DataFrame:
    verified = base.filter("verified").select("document_id")
    name = F.coalesce(F.nullif(F.trim("item_name"), F.lit("")), F.lit(R.UNKNOWN_ITEM))
    spec = F.coalesce(F.trim("specification"), F.lit(""))
    return (
        lines.join(verified, "document_id", "left_semi")
        .groupBy(name.alias("item_name"), spec.alias("spec"))
        .agg(
            money(F.coalesce(F.sum(amount(lines, "quantity")), F.lit(0))).alias("quantity"),
            money(F.coalesce(F.sum(R.line_amount(lines)), F.lit(0))).alias("total_amount"),
        )
    )


def by_document_type(base: DataFrame) -> DataFrame:
    return base.groupBy(F.col("doc_type").alias("document_type")).agg(
        F.count("*").alias("document_count"),
        F.count_if("verified").alias("verified_documents"),
        F.count_if(~F.col("verified")).alias("pending_documents"),
        money(_paid()).alias("total_amount"),
        F.count_if(~F.col("amount_required")).alias("no_price_documents"),
    )


def by_date(base: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Dense series. The days come from the two bounds, so the day side is tiny by construction."""
    days = base.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end - dt.timedelta(days=1)))).alias("date"))
    counts = base.groupBy(F.col("doc_date").alias("date")).agg(
        F.count("*").alias("document_count"),
        F.count_if("verified").alias("verified_documents"),
        F.count_if(~F.col("verified")).alias("pending_documents"),
        money(_paid()).alias("total_amount"),
        F.count_if("review_required").alias("review_required_documents"),
        F.count_if(~F.col("amount_required")).alias("no_price_documents"),
    )
    return days.join(counts, "date", "left").fillna(0)


def top_parties(parties: DataFrame, n: int = 5) -> DataFrame:
    return parties.orderBy(F.desc("total_amount"), F.desc("document_count"), "name").limit(n)


def top_items(items: DataFrame, n: int = 10) -> DataFrame:
    return items.orderBy(F.desc("total_amount"), F.desc("quantity"), "item_name", "spec").limit(n)


# --- issues ------------------------------------------------------------------

def missing_fields(base: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per missing required value (long form; nothing is collected per document)."""
    a = R.line_amount(lines)
    label = lambda ok, text: F.when(ok, F.lit(text))
    doc_level = base.select(
        "document_id", F.lit(None).cast("long").alias("line_index"), F.lit(None).cast("int").alias("line_no"),
        F.explode(F.array_compact(F.array(
            label(F.col("party") == R.UNKNOWN_PARTY, "거래처명"),
            label(F.col("doc_date").isNull(), "문서 날짜"),
            label(F.col("n_lines").isNull(), "품목"),
        ))).alias("label"))
    nth = lambda text: F.concat(F.col("line_no").cast("string"), F.lit(f"번째 {text}"))
    blank_name = F.trim(F.coalesce(F.col("item_name"), F.lit(""))) == ""
    line_level = (
        lines.select("document_id", "line_index", "line_no", F.explode(F.array_compact(F.array(
            F.when(blank_name, F.struct(nth("품명").alias("label"), F.lit(False).alias("price"))),
            F.when(amount(lines, "quantity").isNull(), F.struct(nth("수량").alias("label"), F.lit(False).alias("price"))),
            F.when(amount(lines, "unit_price").isNull() & a.isNull(), F.struct(nth("단가 또는 금액").alias("label"), F.lit(True).alias("price"))),
        ))).alias("m"))
        .join(base.select("document_id", "amount_required"), "document_id")
        .filter(~F.col("m.price") | F.col("amount_required"))
        .select("document_id", "line_index", "line_no", F.col("m.label").alias("label"))
    )
    return doc_level.unionByName(line_level)


def missing_field_text(missing: DataFrame) -> DataFrame:
    """One issue per document with its labels joined in line order (for documents of ordinary size)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("line_index", F.lit(0)).alias("i"), "label")))
    return missing.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda r: r["label"]), ", ").alias("description"))


def calculation_mismatches(base: DataFrame, lines: DataFrame) -> DataFrame:
    qty, price, a = amount(lines, "quantity"), amount(lines, "unit_price"), R.line_amount(lines)
    return (
        lines.filter(F.abs(qty * price - a) > 1)
        .select("document_id", "line_no", "line_index", (qty * price).alias("expected"), a.alias("line_amount"))
        .join(base.filter("amount_required").select("document_id"), "document_id", "left_semi")
    )


def report_issues(base: DataFrame, lines: DataFrame) -> DataFrame:
    """Missing values, calculation mismatches and unreviewed documents as one relation."""
    kinds = [
        (missing_fields(base, lines), "필수값 누락"),
        (calculation_mismatches(base, lines), "계산 불일치"),
        (base.filter(~F.col("verified")), "미검수 문서"),
    ]
    out = [df.select("document_id", F.lit(kind).alias("issue_type")) for df, kind in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


def report_to_sections(base: DataFrame, lines: DataFrame, start: dt.date, end: dt.date, period: str = "month") -> DataFrame:
    """All parts as one relation with a ``section`` column and the union of their columns."""
    tag = lambda df, name: df.select(F.lit(name).alias("section"), "*")
    parts = [
        tag(report_summary(base).withColumn("range_label", F.lit(range_label(start, end, period))), "Summary"),
        tag(by_party(base), "By Party"),
        tag(by_item(base, lines), "By Item"),
        tag(by_document_type(base), "By Document Type"),
        tag(by_date(base, start, end), "By Date"),
        tag(report_issues(base, lines).groupBy("document_id", "issue_type").agg(F.count("*").alias("issue_rows")), "Issues"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
