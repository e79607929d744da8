"""Scores, routing, escalation, promotion gate and structural checks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from bizdocs.functions.lines import count_where, line_stats, text_lines
from bizdocs.functions.text import has_profile
from bizdocs.operators import line_items as L
from bizdocs.operators.resolve import present
from bizdocs.operators.text_tables import has_row_items

# --- fixed values -------------------------------------------------------------
TRADE_TYPES = ["purchase_order", "quotation", "transaction_statement", "delivery_note", "invoice", "packing_list"]
LETTER_TYPES = ["notice", "document", "memo", "presentation"]
RECEIPT_WORDS = ["total", "subtotal", "tax", "receipt", "change", "visa"]
KEEP_PROFILES = ["receipt", "repair_service_receipt", "utility_bill", "resume_profile", "syllabus", "presentation_guide", "profile_record"]
TEXT_SOURCES = ["txt", "md", "json", "xml", "html", "htm"]
OFFICE_SOURCES = ["docx", "xlsx", "pptx"]
IMAGE_SOURCES = ["png", "jpg", "jpeg", "tif", "tiff", "webp"]
BLOCKING_ESCALATIONS = [
    "partial_file_support", "extraction_warnings_present", "low_ocr_confidence", "quality_gate_escalation_recommended",
    "low_extraction_quality_score", "low_table_confidence", "pdf_partial_text", "missing_required_fields", "missing_required_header",
    "missing_line_items", "incomplete_line_items", "amount_mismatch", "unknown_document_type_from_visual_source",
    "ocr_line_item_candidates_not_parsed",
]
DANGEROUS_ISSUES = [
    "vl_candidate_hallucinated_blank_quantity", "vl_candidate_exchange_rate_as_amount", "vl_candidate_dangerous_manual_error",
    "vl_candidate_manual_hallucination", "vl_candidate_document_number_mismatch", "vl_candidate_parser_failed",
    "vl_candidate_output_corruption", "no_price_candidate_amount_conflict",
]
REVIEW_ISSUES = [
    "vl_candidate_requires_review", "vl_candidate_missing_quantity", "vl_candidate_quantity_cell_blank", "vl_candidate_missing_line_amount",
    "vl_candidate_missing_document_total", "vl_candidate_missing_row_anchor", "vl_candidate_missing_row_fragment", "vl_candidate_missing_row_cell",
    "vl_candidate_known_input_limitation", "vl_candidate_missing_expected_pdf_value", "vl_candidate_missing_required_value",
    "vl_candidate_total_mismatch", "vl_candidate_row_count_mismatch", "vl_candidate_malformed_amount_columns_repaired",
    "vl_candidate_explicit_quantity_price_amount_mismatch", "vl_candidate_row_amount_hidden_do_not_infer", "vl_candidate_remaining_quantity_hidden",
    "vl_candidate_inspection_decision_hidden", "vl_candidate_fax_row_boundary_uncertain", "vl_candidate_foreign_script_item_noise",
    "vl_candidate_preprocessed_retry_requires_review", "vl_candidate_inspection_table_review_required",
    "vl_candidate_inspection_report_review_required", "vl_candidate_ocr_uncertainty_review_required", "vl_candidate_ocr_o_zero_uncertain",
    "vl_candidate_company_marker_uncertain", "vl_candidate_ocr_similar_word_requires_review",
]
NON_PROMOTABLE_ISSUES = [
    "vl_candidate_header_row_as_item", "vl_candidate_total_mismatch", "vl_candidate_row_count_mismatch",
    "vl_candidate_return_credit_type_uncertain", "vl_candidate_internal_transfer_type_uncertain", "vl_candidate_total_row_amount_conflict",
    "vl_candidate_output_corruption", "vl_candidate_invalid_line_total", "vl_candidate_invalid_tax_greater_than_supply",
    "vl_candidate_invalid_tax_greater_than_total", "vl_candidate_invalid_supply_greater_than_total", "vl_candidate_foreign_script_item_noise",
]
NO_PRICE_PROFILES = ["no_price_document", "inventory_movement_document", "quality_document"]
# ------------------------------------------------------------------------------


def dec(text: str) -> Column:
    return F.lit(Decimal(text))


def points(*terms) -> Column:
    """Σ of signed decimal terms whose condition holds."""
    total = F.lit(Decimal("0.000"))
    for cond, value in terms:
        total = total + F.when(F.coalesce(cond, F.lit(False)), dec(value)).otherwise(dec("0.00"))
    return total


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(Decimal("0.000")), F.least(F.lit(Decimal("0.990")), F.round(score, 3))).cast("decimal(4,3)")


def signals(docs: DataFrame, lines: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """Per-document inputs of the gates; lines are pre-aggregated once."""
    agg = lines.groupBy("document_id").agg(
        F.count("*").alias("n_lines"), F.bool_or(L.incomplete_line()).alias("incomplete"), F.bool_or(L.incomplete_line(priced=False)).alias("incomplete_unpriced"),
        F.bool_or(F.size("validation_warnings") > 0).alias("line_warned"),
        F.sum(L.money_col(lines, "line_total")).alias("line_sum"))
    out = docs.join(agg, "document_id", "left")
    out = out if text is None else out.join(text, "document_id", "left")
    n = F.coalesce("n_lines", F.lit(0))
    off = F.abs(F.col("extracted_amount") - F.col("line_sum"))
    return out.withColumns({
        "n_lines": n, "incomplete": F.coalesce("incomplete", F.lit(False)), "incomplete_unpriced": F.coalesce("incomplete_unpriced", F.lit(False)),
        "mismatch_2pct": F.coalesce(off > L.amount_tolerance("quality"), F.lit(False)),
        "mismatch_abs": F.coalesce(off > F.when(F.coalesce("currency", F.lit("KRW")) == "KRW", dec("10.00")).otherwise(dec("0.05")), F.lit(False)),
    })


def extraction_quality(df: DataFrame) -> DataFrame:
    """First gate. Reads ``text, ocr_confidence, partial_support, n_warnings`` and the signals above."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(F.trim(text))
    st = line_stats(text)
    df = df.withColumn("_st", st)
    trade = F.col("document_type").isin(TRADE_TYPES)
    receipt = (F.col("document_type") == "receipt") & F.col("extracted_amount").isNotNull()
    words = F.size(F.filter(F.array(*[F.lit(w) for w in RECEIPT_WORDS]), lambda w: F.lower(text).contains(w)))
    party = F.coalesce(present("vendor_name"), present("merchant_name"))
    has = lambda c: F.coalesce(present(c), F.lit(None)).isNotNull() if isinstance(c, str) else c.isNotNull()
    complete = has("merchant_name") & F.col("extracted_date").isNotNull() & F.col("extracted_amount").isNotNull()
    conf = F.col("ocr_confidence")
    warned = F.least(dec("0.18"), F.coalesce("n_warnings", F.lit(0)).cast("decimal(10,0)") * dec("0.06"))
    score = dec("0.45") + points(
        (size >= 120, "0.18"), (size < 40, "-0.18"), (F.col("_st.line_count") >= 4, "0.08"), (conf >= 0.75, "0.16"), (conf < 0.55, "-0.16"),
        (F.col("partial_support"), "-0.25"), (F.col("extracted_date").isNotNull(), "0.05"),
        (trade & has("document_number"), "0.05"), (trade & party.isNotNull(), "0.05"), (trade & (F.col("n_lines") > 0), "0.12"),
        (trade & (F.col("n_lines") == 0), "-0.18"), (trade & F.col("incomplete"), "-0.12"), (trade & F.col("mismatch_2pct"), "-0.14"),
        (receipt, "0.08"), (receipt & complete, "0.10"), (receipt & (F.col("_st.amount_pattern_count") >= 3), "0.05"),
        (receipt & (words >= 3), "0.05"), (receipt & (F.col("_st.noise_ratio") > 0.35), "-0.10"),
    ) - warned
    reasons = F.array_compact(F.array(
        F.when(size < 40, "Very little text was extracted."), F.when(conf < 0.55, "OCR confidence is low."),
        F.when(F.col("partial_support"), "File format support is partial."),
        F.when(trade & (F.col("n_lines") == 0), "No manufacturing line items were extracted."),
        F.when(trade & F.col("incomplete"), "Some line items are missing item name, quantity, or both unit price and line total."),
        F.when(trade & F.col("mismatch_2pct"), "Document total and line item totals do not match."),
        F.when(receipt & (F.col("_st.noise_ratio") > 0.35), "Receipt text looks noisy."),
    ))
    df = df.withColumn("quality_score", clamp(score))
    q = F.col("quality_score")
    review = (q < dec("0.62")) | F.coalesce("partial_support", F.lit(False)) | (trade & ((F.col("n_lines") == 0) | F.col("incomplete") | F.col("mismatch_2pct")))
    return df.withColumns({
        "sufficient": (q >= dec("0.58")) & (size > 0), "quality_review": review,
        "reasons": F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("Extracted content passed the first quality gate."))),
    })


def structured_quality(df: DataFrame, prior_review: str = "quality_review") -> DataFrame:
    """Second gate: model confidence minus a penalty per missing or doubtful field."""
    trade, receipt, letter = F.col("document_type").isin(TRADE_TYPES), F.col("document_type") == "receipt", F.col("document_type").isin(LETTER_TYPES)
    none = lambda c: present(c).isNull()
    no_party = none("vendor_name") & none("merchant_name")
    asked = F.coalesce("review_required", F.lit(False))
    start = F.coalesce(F.nullif(F.col("confidence_score"), F.lit(Decimal("0.000"))), F.lit(Decimal("0.700")))
    rules = [
        (asked, "-0.08", "Extractor requested manual review."),
        (trade & none("document_number"), "-0.06", "Document number is missing."),
        (trade & no_party, "-0.08", "Vendor or supplier name is missing."),
        (trade & (F.col("n_lines") == 0), "-0.22", "Line items are missing."),
        (trade & F.col("incomplete"), "-0.16", "Line item item name, quantity, or amount is uncertain."),
        (trade & F.col("mismatch_2pct"), "-0.14", "Document total and line item totals do not match."),
        (receipt & F.coalesce(F.col("extracted_amount") == 0, F.lit(True)), "-0.18", "Receipt amount is missing."),
        (receipt & F.col("extracted_date").isNull(), "-0.10", "Receipt date is missing."),
        (receipt & none("merchant_name"), "-0.08", "Receipt merchant is missing."),
        (letter & none("title"), "-0.08", "Document title is weak or missing."),
    ]
    score = clamp(start + points(*[(c, v) for c, v, _ in rules], (F.col(prior_review), "-0.05")))
    reasons = F.array_compact(F.array(*[F.when(c, t) for c, _, t in rules]))
    review = (score < dec("0.64")) | asked | (trade & ((F.col("n_lines") == 0) | F.col("incomplete") | F.col("mismatch_2pct")))
    return df.withColumns({"structured_score": score, "structured_review": review, "structured_reasons": reasons})


def skip_reason(df: DataFrame, min_chars: int = 80) -> Column:
    text = F.trim(F.coalesce("text", F.lit("")))
    lines = text_lines("text")
    n = F.size(lines)
    ratio = count_where(lines, lambda v: v.contains(":") | v.contains("|") | v.rlike(r"^\{.+\}$|^\[.+\]$")) / n
    low = F.lit("ai_interpretation_skipped_low_text")
    return (
        F.when(F.length(text) < min_chars, low)
        .when((n <= 2) & (F.length(text) < 180), "ai_interpretation_skipped_trivial")
        .when(F.coalesce(F.col("profile").isin(KEEP_PROFILES), F.lit(False)), F.lit(None).cast("string"))
        .when((ratio >= 0.9) & (n <= 4) & (F.length(text) < 260), "ai_interpretation_skipped_trivial")
    )


def route(df: DataFrame) -> Column:
    """Ordered rules to (label, path, heavy, review, confidence). Expects the first gate's columns."""
    src, doc_type = F.col("source_file_type"), F.col("document_type")
    conf = F.coalesce("ocr_confidence", F.lit(0.55))
    image = F.coalesce(F.col("is_image"), F.lit(False))
    st = F.col("_st")
    complete = present("merchant_name").isNotNull() & F.col("extracted_date").isNotNull() & F.col("extracted_amount").isNotNull()
    calm = F.col("sufficient") & complete & (st["noise_ratio"] <= 0.22)
    out = lambda label, path, heavy, review, c: F.struct(
        (F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(path).alias("path"), F.lit(heavy).alias("heavy"),
        (F.lit(review) if isinstance(review, bool) else review).alias("review"), (F.lit(float(c)) if not isinstance(c, Column) else c.cast("double")).alias("confidence"))
    dense = F.when(st["structured_density"] > 0.15, F.lit("structured_text_path")).otherwise(F.concat(src, F.lit("_direct")))
    receipt_image = image & (doc_type == "receipt")
    trade_review = (F.col("n_lines") == 0) | F.col("quality_review")
    return (
        F.when(F.coalesce("partial_support", F.lit(False)), out("partially_supported_format", "light", False, True, 0.35))
        .when(src.isin(TEXT_SOURCES), out(dense, "light", False, False, 0.86))
        .when(src == "csv", out("structured_text_path", "light", False, False, 0.88))
        .when(src.isin(OFFICE_SOURCES), out(F.concat(src, F.lit("_text_extract")), "medium", False, False, 0.82))
        .when(F.col("extraction_method") == "pdf_text_extract", out("pdf_text_extract", "medium", False, False, 0.84))
        .when(F.col("extraction_method") == "pdf_scanned_page_ocr", out("pdf_scanned_page_ocr", "heavy", True, True, F.coalesce(F.nullif(F.col("ocr_confidence"), F.lit(0.0)), F.lit(0.55))))
        .when(receipt_image & calm & (st["amount_pattern_count"] >= 3) & (st["line_count"] >= 6) & (conf >= 0.72),
              out("receipt_image_fast_path", "medium", False, False, F.greatest(conf, F.col("quality_score").cast("double"))))
        .when(receipt_image & calm & (conf >= 0.70), out("receipt_image_medium_path", "medium", False, False, F.greatest(conf, F.col("quality_score").cast("double"))))
        .when(receipt_image, out("image_paddleocr_vl", "heavy", True, True, conf))
        .when(image & ((F.col("quality_score") < dec("0.72")) | (conf < 0.68) | (doc_type == "other") | (st["line_count"] < 6)),
              out("image_paddleocr_vl", "heavy", True, False, conf))
        .when(image, out("image_ocr_fast_path", "medium", False, False, conf))
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", out("uncertain_needs_ai", "light", False, True, 0.20))
        .when(doc_type == "receipt", out("receipt_fast_path", "medium", False, False, 0.78))
        .when(doc_type.isin(TRADE_TYPES), out("manufacturing_document_fast_path", "medium", False, trade_review,
                                              F.when(F.col("n_lines") > 0, F.lit(0.80)).otherwise(F.lit(0.62))))
        .when(doc_type.isin(LETTER_TYPES), out("notice_document_fast_path", "medium", False, False, 0.80))
        .otherwise(out("structured_text_path", "medium", False, False, 0.70))
    )


def escalation(df: DataFrame) -> DataFrame:
    """Reasons to send a document to the heavier path; any blocking reason escalates."""
    method, src = F.lower(F.coalesce("extraction_method", F.lit(""))), F.lower(F.coalesce("source_file_type", F.lit("")))
    partial, image = F.coalesce("partial_support", F.lit(False)), F.coalesce("is_image", F.lit(False))
    visual = partial | image | method.contains("ocr") | method.contains("pdf_partial") | src.isin(IMAGE_SOURCES)
    trade, t = F.col("document_type").isin(TRADE_TYPES), F.col("document_type")
    none = lambda c: present(c).isNull()
    missing = (
        (none("vendor_name") & none("merchant_name")) | none("customer_name") | none("document_number")
        | (F.col("issue_date").isNull() & F.col("extracted_date").isNull()) | (t.isin("purchase_order", "invoice") & F.col("due_date").isNull()))
    q = F.col("quality_score")
    recommended = image & ((q < dec("0.72")) | (t == "other"))
    scanned = method.contains("ocr") | method.contains("pdf_scanned") | src.isin(IMAGE_SOURCES)
    unparsed = F.when(scanned & (F.col("n_lines") == 0), has_row_items("text")) if "text" in df.columns else F.lit(None).cast("boolean")
    table_conf = F.col("table_confidence") if "table_confidence" in df.columns else F.lit(None).cast("double")
    reasons = F.array_compact(F.array(
        F.when(partial, "partial_file_support"), F.when(F.coalesce("n_warnings", F.lit(0)) > 0, "extraction_warnings_present"),
        F.when(F.col("ocr_confidence") < 0.68, "low_ocr_confidence"), F.when(recommended, "quality_gate_escalation_recommended"),
        F.when((q < dec("0.58")) | (visual & (q < dec("0.72"))), "low_extraction_quality_score"),
        F.when(table_conf < 0.70, "low_table_confidence"), F.when(unparsed, "ocr_line_item_candidates_not_parsed"), F.when(method.contains("pdf_partial"), "pdf_partial_text"),
        F.when(trade & missing, "missing_required_fields"), F.when(trade & (F.col("n_lines") == 0), "missing_line_items"),
        F.when(trade & (F.when(t == "delivery_note", F.col("incomplete_unpriced")).otherwise(F.col("incomplete")) | F.coalesce("line_warned", F.lit(False))), "incomplete_line_items"),
        F.when(trade & F.col("mismatch_abs"), "amount_mismatch"),
        F.when((t == "other") & image, "unknown_document_type_from_visual_source"),
    ))
    df = df.withColumn("escalation_reasons", reasons)
    hit = F.arrays_overlap("escalation_reasons", F.array(*[F.lit(r) for r in BLOCKING_ESCALATIONS]))
    return df.withColumns({"should_escalate": hit, "severity": F.when(hit, "warning").otherwise("info")})


def promotion_gate(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """auxiliary_only / reject / review_required (maybe partial) / promotion_eligible per candidate."""
    head = docs.select(
        "document_id", F.trim(F.coalesce("document_number", F.lit(""))).alias("_num"), F.col("extracted_amount").alias("_total"),
        F.coalesce("taxonomy.document_profiles", F.array().cast("array<string>")).alias("_profiles"), F.col("taxonomy.document_profile").alias("_profile"))
    df = cands.join(head, "document_id", "left")
    lit = lambda codes: F.array(*[F.lit(c) for c in codes])
    empty = F.array().cast("array<string>")
    cnum = F.trim(F.coalesce("document.document_number", F.lit("")))
    number_conflict = (F.col("_num") != "") & (cnum != "") & (F.col("_num") != cnum)
    ctotal = F.replace(F.col("document.total"), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    no_price = has_profile("_profiles", *NO_PRICE_PROFILES) | F.coalesce(F.col("_profile").isin(NO_PRICE_PROFILES), F.lit(False))
    any_amount = F.coalesce("has_line_amounts", F.lit(False))
    for f in ("currency", "subtotal", "tax", "total"):
        any_amount = any_amount | present(f"document.{f}").isNotNull()
    price_conflict = no_price & any_amount
    codes = F.array_distinct(F.concat(
        F.coalesce("issue_codes", empty), F.coalesce("review_flags", empty),
        F.array_compact(F.array(
            F.when(number_conflict, "vl_candidate_document_number_mismatch"),
            F.when(F.col("_total") != ctotal, "vl_candidate_total_mismatch"),
            F.when(price_conflict, "no_price_candidate_amount_conflict")))))
    df = df.withColumns({"codes": codes, "_hard": F.coalesce(number_conflict | price_conflict, F.lit(False))})
    invalid = F.exists("codes", lambda c: c.startswith("vl_candidate_invalid_"))
    flagged = F.arrays_overlap("codes", lit(REVIEW_ISSUES)) | invalid | F.exists("codes", lambda c: c.startswith("vl_candidate_untrusted_"))
    reasons = F.array_compact(F.array(
        F.when(flagged, "vl_candidate_has_review_issues"),
        F.when(~F.coalesce("provider_available", F.lit(False)), "provider_candidate_not_available"),
        F.when(F.coalesce("line_item_count", F.lit(0)) == 0, "structured_line_items_missing")))
    stuck = F.arrays_overlap("codes", lit(NON_PROMOTABLE_ISSUES)) | invalid | (
        F.array_contains("codes", "vl_candidate_explicit_quantity_price_amount_mismatch") & ~F.array_contains("codes", "vl_candidate_row_amount_hidden_do_not_infer"))
    df = df.withColumn("_reasons", reasons)
    partial = ~F.arrays_overlap("_reasons", lit(["provider_candidate_not_available", "structured_line_items_missing"])) & ~stuck
    structured = F.col("document").isNotNull() | (F.coalesce("line_item_count", F.lit(0)) > 0)
    result = lambda d, r, p, m: F.struct(F.lit(d).alias("decision"), r.alias("reasons"), p.alias("auto_promote"), m.alias("promotion_mode"))
    no, none = F.lit(False), F.lit("none")
    gate = (
        F.when(~structured, result("auxiliary_only", lit(["structured_candidate_missing"]), no, none))
        .when(F.arrays_overlap("codes", lit(DANGEROUS_ISSUES)), result("reject", lit(["dangerous_vl_candidate_issue"]), no, none))
        .when(F.col("_hard"), result("reject", lit(["document_conflict"]), no, none))
        .when(F.size("_reasons") > 0, result("review_required", F.col("_reasons"), partial, F.when(partial, "partial").otherwise("none")))
        .otherwise(result("promotion_eligible", lit(["validated_candidate_without_known_issues"]), F.lit(True), F.lit("full")))
    )
    return df.withColumn("gate", gate).select("document_id", "candidate_index", "codes", "gate.*")


def structural_issues(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Issue rows of a structured candidate: header rules once, line rules per line; the largest
    row amount is a partial aggregate, never a window over the document."""
    money = ["purchase_order", "quotation", "transaction_statement", "invoice"]
    biggest = lines.groupBy("document_id").agg(F.max(F.greatest("supply_amount", "line_total")).alias("_max"))
    head = docs.join(biggest, "document_id", "left")
    is_money = F.col("document_type").isin(money)
    text = F.concat_ws(" ", *[c for c in ("title", "category", "raw_text") if c in docs.columns])
    total = F.col("extracted_amount")
    doc_rules = F.array_compact(F.array(
        *[F.when(F.col(c) < 0, F.struct(F.lit("vl_candidate_negative_document_amount_suppressed").alias("code"), F.lit(n).alias("field"))) for c, n in (("subtotal", "subtotal"), ("tax", "tax"), ("extracted_amount", "total"))],
        F.when(is_money & F.col("has_total_label") & total.isNull(), F.struct(F.lit("vl_candidate_missing_document_total").alias("code"), F.lit("total").alias("field"))),
        F.when(text.rlike(L.RETURN_SIGNAL) & ~F.col("document_type").isin("transaction_statement", "invoice"),
               F.struct(F.lit("vl_candidate_return_credit_type_uncertain").alias("code"), F.lit("document_type").alias("field"))),
        F.when((total > 0) & (F.col("_max") > total * dec("1.5")), F.struct(F.lit("vl_candidate_total_row_amount_conflict").alias("code"), F.lit("total").alias("field"))),
    ))
    header = head.select("document_id", F.lit(None).cast("int").alias("line_no"), F.explode(doc_rules).alias("r"))
    no_amount = F.col("unit_price").isNull() & F.col("supply_amount").isNull() & F.col("tax_amount").isNull() & F.col("line_total").isNull()
    line_rules = F.array_compact(F.array(
        F.when(F.col("quantity").isNotNull() & no_amount, F.struct(F.lit("vl_candidate_missing_line_amount").alias("code"), F.lit("line_items").alias("field"))),
        F.when(L.looks_like_header("item_name"), F.struct(F.lit("vl_candidate_header_row_as_item").alias("code"), F.lit("line_items").alias("field"))),
    ))
    rows = lines.select("document_id", "line_no", F.explode(line_rules).alias("r")).join(docs.select("document_id", is_money.alias("_m")), "document_id")
    rows = rows.filter((F.col("r.code") != "vl_candidate_missing_line_amount") | F.col("_m")).drop("_m")
    return header.unionByName(rows).select("document_id", "line_no", "r.code", "r.field")
