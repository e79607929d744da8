"""Quality gates, routing, promotion, review issues and approval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bizdocs.catalog.lines import FLAGS, RCP, lst, receipts
from bizdocs.catalog.registry import query
from bizdocs.catalog.twins import DOCS, LNP, LNS, sql
from bizdocs.functions.lines import line_stats, text_lines
from bizdocs.functions.text import is_noisy_line
from bizdocs.operators import line_items as L
from bizdocs.operators import quality as Q
from bizdocs.operators import review as RV
from bizdocs.sources import views as V

LINES_SQL = "list_filter(list_transform(string_split(coalesce({t}, ''), chr(10)), lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'))), lambda v: v <> '')"


def noisy_sql(v: str) -> str:
    run = f"len(list_filter(range(1, length({v}) - 3), lambda i: {v}[i] = {v}[i + 1] AND {v}[i] = {v}[i + 2] AND {v}[i] = {v}[i + 3] AND {v}[i] = {v}[i + 4])) > 0"
    return f"((len(list_filter(string_split({v}, ' '), lambda w: w <> '')) <= 2 AND length(regexp_replace({v}, '[A-Za-z0-9\\s.,:/$%-]', '', 'g')) >= 2) OR {run})"


STATS_SQL = f"""tl AS (SELECT *, {LINES_SQL.format(t='text')} AS ls FROM documents),
tst AS (SELECT doc_id, text, lang, source, ls, len(ls) AS line_count,
  CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda v: contains(v, '|') OR contains(v, ':') OR regexp_matches(v, '\\d+\\.\\d{{2}}'))) / len(ls) ELSE 0 END AS structured_density,
  len(regexp_extract_all(text, '\\b\\d{{1,6}}(?:,\\d{{3}})*\\.\\d{{2}}\\b')) AS amount_pattern_count,
  CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda v: {noisy_sql('v')})) / len(ls) ELSE 0 END AS noise_ratio FROM tl)"""


@query("fl10_noisy_lines", sql(f"SELECT doc_id, pos, {noisy_sql('line')} AS noisy FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM tl)", STATS_SQL))
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.posexplode(text_lines("text")).alias("pos", "line"))
    return docs.select("doc_id", "pos", is_noisy_line("line").alias("noisy"))


@query("tx07_line_stats", sql("SELECT doc_id, CAST(line_count AS BIGINT) AS line_count, structured_density, CAST(amount_pattern_count AS BIGINT) AS amount_pattern_count, noise_ratio FROM tst", STATS_SQL))
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", line_stats("text").alias("s")).select("doc_id", "s.*")


@query("fl12_skip_reason", sql("""SELECT doc_id, CASE WHEN length(trim(text)) < 80 THEN 'ai_interpretation_skipped_low_text' WHEN line_count <= 2 AND length(trim(text)) < 180 THEN 'ai_interpretation_skipped_trivial'
 WHEN source IN ('src1', 'src3') THEN NULL WHEN len(list_filter(ls, lambda v: contains(v, ':') OR contains(v, '|') OR regexp_full_match(v, '\\{.+\\}|\\[.+\\]'))) / line_count >= 0.9 AND line_count <= 4 AND length(trim(text)) < 260 THEN 'ai_interpretation_skipped_trivial' END AS reason FROM tst""", STATS_SQL))
def _(spark, sf):
    docs = V.table(spark, sf, "documents").withColumn("profile", F.when(F.col("source").isin("src1", "src3"), "receipt"))
    return docs.select("doc_id", Q.skip_reason(docs).alias("reason"))


def signals(spark, sf) -> DataFrame:
    docs = receipts(spark, sf).withColumns({
        "ocr_confidence": F.expr("CASE WHEN extraction_method = 'image_ocr' THEN CAST(confidence_score AS DOUBLE) END"),
        "partial_support": F.col("source_file_type").isNull(), "is_image": F.coalesce(F.col("source_file_type") == "jpg", F.lit(False)),
        "n_warnings": F.expr("CASE WHEN currency IS NULL THEN 2 ELSE 0 END"),
        "extraction_method": F.expr("CASE WHEN extraction_method = 'pdf_text' AND currency = 'USD' THEN 'pdf_scanned_page_ocr' WHEN extraction_method = 'pdf_text' THEN 'pdf_text_extract' ELSE extraction_method END"),
        "source_file_type": F.expr("CASE WHEN source_file_type = 'xlsx' AND currency = 'USD' THEN 'md' WHEN source_file_type = 'xlsx' AND tax IS NULL THEN 'scan' ELSE source_file_type END")})
    text = V.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return Q.signals(docs, V.lines(spark, sf, with_part=True), text)


TRADE = lst(Q.TRADE_TYPES)
SIG = f"""la AS (SELECT document_id, count(*) AS n_lines, bool_or(item_name IS NULL OR quantity IS NULL OR (unit_price IS NULL AND line_total IS NULL)) AS incomplete, bool_or(item_name IS NULL OR quantity IS NULL) AS incomplete_u, bool_or(len(validation_warnings) > 0) AS line_warned, sum(line_total) AS line_sum FROM lnp GROUP BY document_id),
sig0 AS (SELECT d.* REPLACE (CASE WHEN extraction_method = 'pdf_text' AND currency = 'USD' THEN 'pdf_scanned_page_ocr' WHEN extraction_method = 'pdf_text' THEN 'pdf_text_extract' ELSE extraction_method END AS extraction_method,
   CASE WHEN source_file_type = 'xlsx' AND currency = 'USD' THEN 'md' WHEN source_file_type = 'xlsx' AND tax IS NULL THEN 'scan' ELSE source_file_type END AS source_file_type),
  source_file_type IS NULL AS partial_support, coalesce(source_file_type = 'jpg', false) AS is_image, CASE WHEN extraction_method = 'image_ocr' THEN confidence_score END AS ocr, CASE WHEN currency IS NULL THEN 2 ELSE 0 END AS n_warnings,
  coalesce(n_lines, 0) AS n_lines, coalesce(incomplete, false) AS incomplete, coalesce(incomplete_u, false) AS incomplete_u, coalesce(line_warned, false) AS line_warned, coalesce(abs(extracted_amount - line_sum) > greatest(1, abs(extracted_amount) * 0.02), false) AS m2,
  coalesce(abs(extracted_amount - line_sum) > CASE WHEN coalesce(currency, 'KRW') = 'KRW' THEN 10 ELSE 0.05 END, false) AS mabs,
  list_contains({TRADE}, document_type) AS trade, document_type = 'receipt' AND extracted_amount IS NOT NULL AS rcpt, length(trim(coalesce(t.text, ''))) AS tsize, coalesce(t.text, '') AS text, coalesce(t.line_count, 0) AS line_count,
  coalesce(t.structured_density, 0) AS structured_density, coalesce(t.amount_pattern_count, 0) AS amount_pattern_count, coalesce(t.noise_ratio, 0) AS noise_ratio,
  merchant_name IS NOT NULL AND extracted_date IS NOT NULL AND extracted_amount IS NOT NULL AS complete
  FROM rcp d LEFT JOIN la USING (document_id) LEFT JOIN tst t ON t.doc_id = d.document_id),
sig1 AS (SELECT *, CAST(greatest(0, least(0.99, round(0.45 + CASE WHEN tsize >= 120 THEN 0.18 WHEN tsize < 40 THEN -0.18 ELSE 0 END + CASE WHEN line_count >= 4 THEN 0.08 ELSE 0 END + CASE WHEN ocr >= 0.75 THEN 0.16 WHEN ocr < 0.55 THEN -0.16 ELSE 0 END
  + CASE WHEN partial_support THEN -0.25 ELSE 0 END - least(0.18, n_warnings * 0.06) + CASE WHEN extracted_date IS NOT NULL THEN 0.05 ELSE 0 END
  + CASE WHEN trade THEN CASE WHEN document_number IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN coalesce(vendor_name, merchant_name) IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN n_lines > 0 THEN 0.12 ELSE -0.18 END
     + CASE WHEN incomplete THEN -0.12 ELSE 0 END + CASE WHEN m2 THEN -0.14 ELSE 0 END ELSE 0 END
  + CASE WHEN rcpt THEN 0.08 + CASE WHEN complete THEN 0.10 ELSE 0 END + CASE WHEN amount_pattern_count >= 3 THEN 0.05 ELSE 0 END + CASE WHEN noise_ratio > 0.35 THEN -0.10 ELSE 0 END
     + CASE WHEN len(list_filter({lst(Q.RECEIPT_WORDS)}, lambda w: contains(lower(text), w))) >= 3 THEN 0.05 ELSE 0 END ELSE 0 END, 3))) AS DECIMAL(4,3)) AS q FROM sig0),
sig AS (SELECT *, q >= 0.58 AND tsize > 0 AS sufficient, q < 0.62 OR partial_support OR (trade AND (n_lines = 0 OR incomplete OR m2)) AS quality_review FROM sig1)"""
SIG_VIEWS = (DOCS, LNP, RCP, STATS_SQL, SIG)


@query("qg01_extraction_quality", sql("SELECT document_id, CAST(q AS DOUBLE) AS quality_score, sufficient, quality_review FROM sig", *SIG_VIEWS))
def _(spark, sf):
    return Q.extraction_quality(signals(spark, sf)).select("document_id", "quality_score", "sufficient", "quality_review")


@query("qg02_structured_quality", sql("""SELECT document_id, CAST(s AS DOUBLE) AS structured_score, s < 0.64 OR review_required OR (trade AND (n_lines = 0 OR incomplete OR m2)) AS structured_review FROM (
 SELECT *, CAST(greatest(0, least(0.99, round(coalesce(nullif(confidence_score, 0), 0.7) + CASE WHEN review_required THEN -0.08 ELSE 0 END + CASE WHEN quality_review THEN -0.05 ELSE 0 END
  + CASE WHEN trade THEN CASE WHEN document_number IS NULL THEN -0.06 ELSE 0 END + CASE WHEN coalesce(vendor_name, merchant_name) IS NULL THEN -0.08 ELSE 0 END + CASE WHEN n_lines = 0 THEN -0.22 ELSE 0 END + CASE WHEN incomplete THEN -0.16 ELSE 0 END + CASE WHEN m2 THEN -0.14 ELSE 0 END
    WHEN document_type = 'receipt' THEN CASE WHEN coalesce(extracted_amount, 0) = 0 THEN -0.18 ELSE 0 END + CASE WHEN extracted_date IS NULL THEN -0.10 ELSE 0 END + CASE WHEN merchant_name IS NULL THEN -0.08 ELSE 0 END ELSE 0 END, 3))) AS DECIMAL(4,3)) AS s FROM sig)""", *SIG_VIEWS))
def _(spark, sf):
    return Q.structured_quality(Q.extraction_quality(signals(spark, sf))).select("document_id", "structured_score", "structured_review")


@query("qg10_escalation", sql("""SELECT document_id, array_to_string(rs, '|') AS reasons, len(rs) > 0 AS should_escalate FROM (SELECT document_id, list_filter([CASE WHEN partial_support THEN 'partial_file_support' END, CASE WHEN n_warnings > 0 THEN 'extraction_warnings_present' END,
  CASE WHEN ocr < 0.68 THEN 'low_ocr_confidence' END, CASE WHEN is_image AND q < 0.72 THEN 'quality_gate_escalation_recommended' END,
  CASE WHEN q < 0.58 OR ((partial_support OR is_image OR contains(extraction_method, 'ocr')) AND q < 0.72) THEN 'low_extraction_quality_score' END,
  CASE WHEN trade AND (coalesce(vendor_name, merchant_name) IS NULL OR nullif(customer_name, '') IS NULL OR document_number IS NULL OR coalesce(issue_date, extracted_date) IS NULL OR (document_type IN ('purchase_order','invoice') AND due_date IS NULL)) THEN 'missing_required_fields' END,
  CASE WHEN trade AND n_lines = 0 THEN 'missing_line_items' END, CASE WHEN trade AND (CASE WHEN document_type = 'delivery_note' THEN incomplete_u ELSE incomplete END OR line_warned) THEN 'incomplete_line_items' END, CASE WHEN trade AND mabs THEN 'amount_mismatch' END], lambda x: x IS NOT NULL) AS rs FROM sig)""", *SIG_VIEWS))
def _(spark, sf):
    return Q.escalation(Q.extraction_quality(signals(spark, sf))).select("document_id", F.col("escalation_reasons").alias("reasons"), "should_escalate")


@query("qg10_unparsed_rows", sql("""SELECT document_id, coalesce(document_id % 2 = 0 AND currency = 'USD' AND (contains(extraction_method, 'ocr') OR source_file_type IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'webp')), false) AS unparsed FROM sig0""", DOCS, LNP, RCP, STATS_SQL, SIG.split("sig1 AS")[0].rstrip().rstrip(",")))
def _(spark, sf):
    """Scanned documents without lines whose text holds item rows."""
    df = Q.extraction_quality(signals(spark, sf)).withColumns({
        "n_lines": F.expr("IF(document_id % 2 = 0, 0, 1)"), "text": F.expr("IF(currency = 'USD', concat('note\n1 Bolt M8 ', document_id, ' EA'), 'a letter\nwithout rows')")})
    return Q.escalation(df).select("document_id", F.array_contains("escalation_reasons", "ocr_line_item_candidates_not_parsed").alias("unparsed"))


@query("qg11_route", sql("""SELECT document_id, CASE WHEN partial_support THEN 'partially_supported_format' WHEN source_file_type = 'md' THEN CASE WHEN structured_density > 0.15 THEN 'structured_text_path' ELSE 'md_direct' END WHEN source_file_type = 'xlsx' THEN 'xlsx_text_extract'
  WHEN extraction_method IN ('pdf_text_extract', 'pdf_scanned_page_ocr') THEN extraction_method
  WHEN is_image AND document_type = 'receipt' THEN CASE WHEN sufficient AND complete AND noise_ratio <= 0.22 AND amount_pattern_count >= 3 AND line_count >= 6 AND c >= 0.72 THEN 'receipt_image_fast_path'
    WHEN sufficient AND complete AND noise_ratio <= 0.22 AND c >= 0.70 THEN 'receipt_image_medium_path' ELSE 'image_paddleocr_vl' END
  WHEN is_image AND (q < 0.72 OR c < 0.68 OR line_count < 6) THEN 'image_paddleocr_vl' WHEN is_image THEN 'image_ocr_fast_path' WHEN trim(text) = '' THEN 'uncertain_needs_ai' WHEN document_type = 'receipt' THEN 'receipt_fast_path'
  WHEN trade THEN 'manufacturing_document_fast_path' ELSE 'structured_text_path' END AS label,
 CASE WHEN partial_support OR source_file_type = 'md' THEN 'light' WHEN source_file_type = 'xlsx' OR extraction_method = 'pdf_text_extract' THEN 'medium' WHEN extraction_method = 'pdf_scanned_page_ocr' THEN 'heavy'
  WHEN is_image AND document_type = 'receipt' THEN CASE WHEN sufficient AND complete AND noise_ratio <= 0.22 AND c >= 0.70 THEN 'medium' ELSE 'heavy' END
  WHEN is_image AND (q < 0.72 OR c < 0.68 OR line_count < 6) THEN 'heavy' WHEN is_image THEN 'medium' WHEN trim(text) = '' THEN 'light' ELSE 'medium' END AS path
 FROM (SELECT *, coalesce(ocr, 0.55) AS c FROM sig)""", *SIG_VIEWS))
def _(spark, sf):
    df = Q.extraction_quality(signals(spark, sf))
    return df.select("document_id", Q.route(df).alias("r")).select("document_id", "r.label", "r.path")


def candidates(spark, sf) -> DataFrame:
    """Structured reads of the headers: some disagree on the number or total, some carry issue codes."""
    return V.documents(spark, sf).selectExpr(
        "document_id", "0 AS candidate_index", "processing_status <> 'failed' AND dayofmonth(created_at) <> 8 AS provider_available",
        """CASE WHEN dayofmonth(created_at) = 2 THEN array('vl_candidate_missing_quantity') WHEN dayofmonth(created_at) = 3 THEN array('vl_candidate_invalid_line_total', 'vl_candidate_missing_quantity')
             WHEN dayofmonth(created_at) = 4 THEN array('vl_candidate_parser_failed') WHEN dayofmonth(created_at) = 5 THEN array('vl_candidate_explicit_quantity_price_amount_mismatch') ELSE array() END AS issue_codes""",
        "CASE WHEN dayofmonth(created_at) = 5 AND currency = 'USD' THEN array('vl_candidate_row_amount_hidden_do_not_infer') ELSE array() END AS review_flags",
        """CASE WHEN dayofmonth(created_at) <> 6 THEN named_struct('document_number', CASE WHEN dayofmonth(created_at) = 7 THEN 'X-1' ELSE document_number END, 'currency', CAST(NULL AS STRING), 'subtotal', CAST(NULL AS STRING),
             'tax', CAST(NULL AS STRING), 'total', CASE WHEN dayofmonth(created_at) IN (9, 10) THEN CAST(extracted_amount + 1 AS STRING) WHEN document_type <> 'delivery_note' THEN CAST(extracted_amount AS STRING) END) END AS document""",
        "CASE WHEN dayofmonth(created_at) = 6 THEN 0 ELSE 3 END AS line_item_count", "false AS has_line_amounts")


CAND = f"""cd AS (SELECT *, day(created_at) AS cday FROM docs),
c1 AS (SELECT *, list_distinct_ordered FROM (SELECT *, list_filter([CASE WHEN cday = 2 THEN 'vl_candidate_missing_quantity' WHEN cday = 3 THEN 'vl_candidate_invalid_line_total' WHEN cday = 4 THEN 'vl_candidate_parser_failed' WHEN cday = 5 THEN 'vl_candidate_explicit_quantity_price_amount_mismatch' END,
   CASE WHEN cday = 3 THEN 'vl_candidate_missing_quantity' END, CASE WHEN cday = 5 AND currency = 'USD' THEN 'vl_candidate_row_amount_hidden_do_not_infer' END,
   CASE WHEN cday = 7 AND document_number IS NOT NULL THEN 'vl_candidate_document_number_mismatch' END, CASE WHEN cday IN (9, 10) AND extracted_amount IS NOT NULL THEN 'vl_candidate_total_mismatch' END,
   CASE WHEN nop AND ((cday IN (9, 10) AND extracted_amount IS NOT NULL) OR (cday NOT IN (6, 9, 10) AND document_type <> 'delivery_note' AND extracted_amount IS NOT NULL)) THEN 'no_price_candidate_amount_conflict' END], lambda x: x IS NOT NULL) AS list_distinct_ordered
  FROM (SELECT *, list_has_any(document_profiles, {lst(Q.NO_PRICE_PROFILES)}) OR coalesce(list_contains({lst(Q.NO_PRICE_PROFILES)}, document_profile), false) AS nop FROM cd))),
c2 AS (SELECT document_id, list_distinct_ordered AS codes, cday, NOT (processing_status <> 'failed' AND cday <> 8) AS unavailable, cday = 6 AS empty_, list_contains(list_distinct_ordered, 'vl_candidate_document_number_mismatch') OR list_contains(list_distinct_ordered, 'no_price_candidate_amount_conflict') AS hard FROM c1)"""


@query("qg08_promotion_gate", sql(f"""SELECT document_id, array_to_string(codes, '|') AS codes, CASE WHEN empty_ THEN 'auxiliary_only' WHEN list_has_any(codes, {lst(Q.DANGEROUS_ISSUES)}) OR hard THEN 'reject'
  WHEN unavailable OR list_has_any(codes, {lst(Q.REVIEW_ISSUES)}) OR list_contains(codes, 'vl_candidate_invalid_line_total') THEN 'review_required' ELSE 'promotion_eligible' END AS decision,
 CASE WHEN empty_ OR list_has_any(codes, {lst(Q.DANGEROUS_ISSUES)}) OR hard THEN 'none' WHEN unavailable OR list_has_any(codes, {lst(Q.NON_PROMOTABLE_ISSUES)}) OR (cday = 5 AND len(codes) = 1) OR (cday = 5 AND NOT list_contains(codes, 'vl_candidate_row_amount_hidden_do_not_infer')) THEN 'none'
  WHEN list_has_any(codes, {lst(Q.REVIEW_ISSUES)}) THEN 'partial' ELSE 'full' END AS promotion_mode FROM c2""", DOCS, CAND))
def _(spark, sf):
    return Q.promotion_gate(candidates(spark, sf), V.documents(spark, sf)).select("document_id", "codes", "decision", "promotion_mode")


@query("qg09_structural_issues", sql(f"""SELECT document_id, CAST(NULL AS BIGINT) AS line_no, 'vl_candidate_negative_document_amount_suppressed' AS code FROM docs2 WHERE subtotal < 0
 UNION ALL SELECT document_id, NULL, 'vl_candidate_missing_document_total' FROM docs2 WHERE money AND currency = 'KRW' AND extracted_amount IS NULL
 UNION ALL SELECT document_id, NULL, 'vl_candidate_return_credit_type_uncertain' FROM docs2 WHERE category = 'credit_note' AND document_type NOT IN ('transaction_statement', 'invoice')
 UNION ALL SELECT document_id, NULL, 'vl_candidate_total_row_amount_conflict' FROM docs2 JOIN (SELECT document_id, max(greatest(supply_amount, line_total)) AS m FROM lnp GROUP BY document_id) USING (document_id) WHERE extracted_amount > 0 AND m > extracted_amount * 1.5
 UNION ALL SELECT document_id, line_no, 'vl_candidate_missing_line_amount' FROM lnp JOIN docs2 USING (document_id) WHERE money AND quantity IS NOT NULL AND part_key % 2 = 0
 UNION ALL SELECT document_id, line_no, 'vl_candidate_header_row_as_item' FROM lnp WHERE item_name IS NULL""",
    DOCS, LNP, RCP, "docs2 AS (SELECT * REPLACE (CASE WHEN currency = 'USD' THEN -subtotal ELSE subtotal END AS subtotal), document_type IN ('purchase_order','quotation','transaction_statement','invoice') AS money FROM rcp)"))
def _(spark, sf):
    docs = receipts(spark, sf).withColumns({"has_total_label": F.coalesce(F.col("currency") == "KRW", F.lit(False)), "subtotal": F.expr("CASE WHEN currency = 'USD' THEN -subtotal ELSE subtotal END")})
    lines = V.lines(spark, sf, with_part=True).withColumns({
        "item_name": F.coalesce("item_name", F.lit("No 품목명 수량 단가 합계")),
        **{c: F.when(F.col("part_key") % 2 == 1, F.col(c)) for c in ("unit_price", "supply_amount", "tax_amount", "line_total")}})
    full = V.lines(spark, sf, with_part=True)
    issues = Q.structural_issues(docs, lines).filter("code <> 'vl_candidate_total_row_amount_conflict'")
    conflict = Q.structural_issues(docs, full).filter("code = 'vl_candidate_total_row_amount_conflict'")
    return issues.unionByName(conflict).select("document_id", "line_no", "code")


# --- review ------------------------------------------------------------------

def issues(spark, sf) -> DataFrame:
    lines = V.lines(spark, sf, with_part=True).withColumn("item_code", F.expr("CASE WHEN return_flag <> 'N' THEN item_code END"))
    return RV.review_reasons(V.documents(spark, sf), lines, index="line_no")


WARN = lst(RV.AMOUNT_WARNINGS)
ISS = f"""li AS (SELECT * REPLACE (CASE WHEN return_flag <> 'N' THEN item_code END AS item_code) FROM lnp),
ls AS (SELECT document_id, count(*) AS n, sum(line_total) AS s, bool_or(item_code IS NOT NULL) AS codes, bool_or(list_has_any(validation_warnings, {WARN})) AS inv FROM li GROUP BY document_id),
hd AS (SELECT d.*, n, s, coalesce(codes, false) AS codes, coalesce(inv, false) AS inv, list_contains(document_profiles, 'return_document') AS ret,
  list_contains(document_profiles, 'no_price_document') OR coalesce(tax_amount_required = false, false) AS np, list_contains(document_profiles, 'inventory_movement_document') AS mov,
  coalesce(abs(extracted_amount - s) > CASE coalesce(currency,'KRW') WHEN 'USD' THEN 0.05 WHEN 'KRW' THEN 10 ELSE 1 END, false) AS off FROM docs d LEFT JOIN ls USING (document_id)),
hi AS (SELECT document_id, unnest(list_filter([
   CASE WHEN ret THEN {{'code': 'amount_direction_requires_review', 'field': 'total_amount', 'severity': 'warning', 'phase': 0, 'rule': 0}} END, CASE WHEN ret THEN {{'code': 'related_document_missing', 'field': 'related_document_number', 'severity': 'info', 'phase': 0, 'rule': 1}} END,
   CASE WHEN NOT np AND NOT mov AND coalesce(vendor_name, merchant_name) IS NULL THEN {{'code': 'missing_vendor_name', 'field': 'vendor_name', 'severity': 'warning', 'phase': 0, 'rule': 2}} END,
   CASE WHEN NOT np AND NOT mov AND nullif(customer_name, '') IS NULL THEN {{'code': 'missing_customer_name', 'field': 'customer_name', 'severity': 'warning', 'phase': 0, 'rule': 3}} END,
   CASE WHEN document_number IS NULL THEN {{'code': 'missing_document_number', 'field': 'document_number', 'severity': 'warning', 'phase': 0, 'rule': 4}} END,
   CASE WHEN coalesce(issue_date, extracted_date) IS NULL THEN {{'code': 'missing_issue_date', 'field': 'issue_date', 'severity': 'warning', 'phase': 0, 'rule': 5}} END,
   CASE WHEN document_type = 'purchase_order' AND due_date IS NULL THEN {{'code': 'missing_due_date', 'field': 'due_date', 'severity': 'warning', 'phase': 0, 'rule': 6}} END,
   CASE WHEN n IS NULL THEN {{'code': 'missing_line_items', 'field': 'line_items', 'severity': 'warning', 'phase': 0, 'rule': 8}} END,
   CASE WHEN off THEN {{'code': 'amount_mismatch', 'field': 'total_amount', 'severity': 'warning', 'phase': 2, 'rule': 0}} WHEN inv AND NOT np THEN {{'code': 'amount_mismatch', 'field': 'total_amount', 'severity': 'warning', 'phase': 2, 'rule': 1}} END], lambda x: x IS NOT NULL)) AS r FROM hd),
lr AS (SELECT li.document_id, line_index, line_no - 1 AS item_index, unnest(list_filter([
   CASE WHEN item_name IS NULL THEN {{'code': 'missing_item_name', 'field': 'line_items.item_name', 'severity': 'warning', 'rule': 0}} END, CASE WHEN quantity IS NULL THEN {{'code': 'missing_quantity', 'field': 'line_items.quantity', 'severity': 'warning', 'rule': 1}} END,
   CASE WHEN NOT np AND document_type <> 'delivery_note' AND unit_price IS NULL AND line_total IS NULL THEN {{'code': 'missing_price_or_total', 'field': 'line_items.unit_price', 'severity': 'warning', 'rule': 2}} END,
   CASE WHEN NOT np AND list_contains(validation_warnings, 'invalid_line_total') THEN {{'code': 'invalid_line_amount', 'field': 'line_items.line_total', 'severity': 'warning', 'rule': 6}} END,
   CASE WHEN item_code IS NULL THEN {{'code': 'missing_document_item_code', 'field': 'line_items.item_code', 'severity': CASE WHEN codes AND NOT np THEN 'warning' ELSE 'info' END, 'rule': 7}} END], lambda x: x IS NOT NULL)) AS r FROM li JOIN hd USING (document_id)),
iss AS (SELECT document_id, r.phase AS phase, 0 AS line_index, r.rule AS rule, r.code AS code, r.field AS field, CAST(NULL AS BIGINT) AS item_index, r.severity AS severity FROM hi
 UNION ALL SELECT document_id, 1, line_index, r.rule, r.code, r.field, item_index, r.severity FROM lr)"""
ISS_VIEWS = (DOCS, LNP, ISS)


@query("qg06_review_reasons", sql("SELECT document_id, code, field, item_index, severity FROM iss", *ISS_VIEWS))
def _(spark, sf):
    return issues(spark, sf).select("document_id", "code", "field", "item_index", "severity")


DEDUP = "ded AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, code, field, item_index ORDER BY phase, line_index, rule) AS rn FROM iss) WHERE rn = 1)"


@query("wn19_dedupe_reasons", sql("SELECT document_id, code, field, item_index, severity FROM ded", *ISS_VIEWS, DEDUP))
def _(spark, sf):
    return RV.dedupe_reasons(issues(spark, sf)).select("document_id", "code", "field", "item_index", "severity")


COLL = f"""grp AS (SELECT document_id, code, count(*) AS n FROM iss WHERE code IN ('missing_quantity','missing_price_or_total','missing_document_item_code') AND item_index IS NOT NULL GROUP BY ALL HAVING count(*) >= 4),
coll AS (SELECT document_id, code, item_index FROM ded i WHERE NOT EXISTS (SELECT 1 FROM grp g WHERE g.document_id = i.document_id AND g.code = i.code AND i.item_index IS NOT NULL)
 UNION ALL SELECT document_id, code, NULL FROM grp)"""


@query("wn18_collapse_issues", sql("SELECT document_id, code, item_index FROM coll", *ISS_VIEWS, DEDUP, COLL))
def _(spark, sf):
    return RV.collapse_issues(issues(spark, sf)).select("document_id", "code", "item_index")


def states(spark, sf) -> DataFrame:
    """Stored states: quantity and item-code issues of shipped lines, some under legacy item tokens."""
    lines = V.lines(spark, sf, with_part=True).filter("quantity IS NULL OR return_flag = 'N'")
    return lines.selectExpr(
        "document_id",
        """CASE WHEN quantity IS NULL AND unit = 'EA' THEN concat('unresolved:missing_quantity:line_items.quantity:item_', line_no)
                WHEN quantity IS NULL THEN concat('missing_quantity:line_items.quantity:', line_no - 1)
                ELSE concat('missing_document_item_code:line_items.item_code:', line_no - 1) END AS key""",
        "CASE WHEN unit = 'EA' THEN 'resolved' WHEN note IS NOT NULL THEN 'ignored' ELSE 'blocked' END AS status",
        "concat('clerk', supp_key) AS updated_by", "timestampadd(SECOND, CAST(part_key AS INT), CAST(ship_date AS TIMESTAMP)) AS updated_at")


ST = """st AS (SELECT document_id, CASE WHEN quantity IS NULL THEN 'missing_quantity' ELSE 'missing_document_item_code' END AS code, CASE WHEN quantity IS NULL THEN 'line_items.quantity' ELSE 'line_items.item_code' END AS field, line_no - 1 AS item_index,
  CASE WHEN unit = 'EA' THEN 'resolved' WHEN note IS NOT NULL THEN 'ignored' ELSE 'blocked' END AS status, 'clerk' || supp_key AS updated_by, CAST(ship_date AS TIMESTAMP) + to_seconds(part_key) AS updated_at
  FROM lnp WHERE quantity IS NULL OR return_flag = 'N'),
lst AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, code, field, item_index ORDER BY updated_at DESC) AS rn FROM st) WHERE rn = 1),
istat AS (SELECT d.*, coalesce(l.status, 'open') AS status FROM ded d LEFT JOIN lst l ON d.document_id = l.document_id AND d.code = l.code AND d.field = l.field AND d.item_index = l.item_index)"""
ST_VIEWS = (*ISS_VIEWS, DEDUP, ST)


@query("jn13_issue_states", sql("SELECT document_id, code, field, item_index, status FROM istat", *ST_VIEWS))
def _(spark, sf):
    return RV.issue_states(RV.dedupe_reasons(issues(spark, sf)), states(spark, sf)).select("document_id", "code", "field", "item_index", "status")


@query("up04_apply_issue_updates", sql("""SELECT document_id, code, item_index, status, updated_by, CASE WHEN status IN ('resolved','ignored') THEN updated_by END AS resolved_by FROM lst""", *ST_VIEWS))
def _(spark, sf):
    all_states = states(spark, sf)
    half = F.col("updated_at") < F.lit("1998-06-01").cast("timestamp")
    out = RV.apply_issue_updates(all_states.filter(half), all_states.filter(~half))
    # rows stored before the update carry no stamp yet: stamp them the way an update would
    done = F.col("status").isin(RV.RESOLVED)
    k = RV.parse_issue_key("key")
    return out.select("document_id", k["code"].alias("code"), k["item_index"].alias("item_index"), "status", "updated_by", F.when(done, F.coalesce("resolved_by", "updated_by")).alias("resolved_by"))


@query("ag23_issue_progress", sql("""SELECT document_id, coalesce(o, 1) AS open, coalesce(r, 0) AS resolved FROM docs LEFT JOIN (SELECT document_id, count(*) FILTER (WHERE status NOT IN ('resolved','ignored')) AS o, count(*) FILTER (WHERE status IN ('resolved','ignored')) AS r FROM lst GROUP BY document_id) USING (document_id)""", *ST_VIEWS))
def _(spark, sf):
    latest = RV.apply_issue_updates(states(spark, sf).filter(F.lit(False)), states(spark, sf))
    return RV.issue_progress(V.documents(spark, sf), latest, F.lit(1))


FIND = f"""fnd AS (SELECT document_id, 'blocking' AS kind, 'unresolved:' || code || ':' || field || ':' || coalesce(CAST(item_index AS VARCHAR), '') AS key FROM istat JOIN hd USING (document_id)
   WHERE status NOT IN ('resolved','ignored') AND severity NOT IN ('info','low') AND code IN {tuple(RV.CRITICAL)} AND (code <> 'missing_price_or_total' OR coalesce(tax_amount_required, NOT list_has_any(document_profiles, ['no_price_document','inventory_movement_document'])))
 UNION SELECT document_id, r.kind, r.key FROM (SELECT document_id, unnest(list_filter([
   CASE WHEN document_number IS NULL THEN {{'kind': 'warning', 'key': 'missing_document_number'}} END, CASE WHEN NOT mov AND coalesce(vendor_name, merchant_name) IS NULL THEN {{'kind': 'warning', 'key': 'missing_vendor_name'}} END,
   CASE WHEN NOT mov AND nullif(customer_name, '') IS NULL THEN {{'kind': 'warning', 'key': 'missing_customer_name'}} END, CASE WHEN n IS NULL THEN {{'kind': 'blocking', 'key': 'missing_line_items'}} END,
   CASE WHEN coalesce(tax_amount_required, NOT list_has_any(document_profiles, ['no_price_document','inventory_movement_document'])) AND coalesce(extracted_amount, 0) = 0 THEN {{'kind': 'warning', 'key': 'missing_total'}} END,
   CASE WHEN list_contains(document_profiles, 'tax_document') AND (subtotal IS NULL OR tax IS NULL OR extracted_amount IS NULL) THEN {{'kind': 'blocking', 'key': 'tax_amount_fields_missing'}}
        WHEN list_contains(document_profiles, 'tax_document') AND abs(subtotal + tax - extracted_amount) > 0.01 THEN {{'kind': 'blocking', 'key': 'subtotal_tax_total_mismatch'}} END,
   CASE WHEN ret THEN {{'kind': 'warning', 'key': 'amount_direction_requires_review'}} END, CASE WHEN ret THEN {{'kind': 'warning', 'key': 'related_document_missing'}} END], lambda x: x IS NOT NULL)) AS r FROM hd)
 UNION SELECT document_id, 'blocking', 'missing_inventory_item_or_quantity:item_' || line_no FROM lnp JOIN (SELECT document_id FROM hd WHERE mov) USING (document_id) WHERE item_name IS NULL OR quantity IS NULL),
val AS (SELECT document_id, count(*) FILTER (WHERE kind = 'blocking') AS n_blocking, count(*) FILTER (WHERE kind = 'warning') AS n_warnings,
  coalesce(array_to_string(list_sort(list(DISTINCT regexp_extract(regexp_replace(key, '^unresolved:', ''), '^([^:]*)', 1)) FILTER (WHERE kind = 'blocking')), '|'), '') AS blocking_codes FROM docs LEFT JOIN fnd USING (document_id) GROUP BY document_id)"""


def findings(spark, sf):
    docs, lines = V.documents(spark, sf), V.lines(spark, sf, with_part=True)
    return docs, RV.approval_findings(docs, RV.issue_states(RV.dedupe_reasons(issues(spark, sf)), states(spark, sf)), lines)


@query("qg07_validate_approval", sql("SELECT *, n_blocking = 0 AS ok FROM val", *ST_VIEWS, FIND))
def _(spark, sf):
    return RV.validate_approval(*findings(spark, sf))


@query("up05_apply_approvals", sql("""SELECT document_id, CASE WHEN processing_status = 'needs_review' THEN n_blocking = 0 WHEN processing_status = 'failed' THEN false ELSE approved END AS approved,
 CASE WHEN processing_status = 'failed' THEN 'in_review' WHEN processing_status = 'needs_review' AND n_blocking = 0 THEN 'approved' WHEN processing_status = 'needs_review' THEN 'blocked' END AS review_state FROM docs JOIN val USING (document_id)""", *ST_VIEWS, FIND))
def _(spark, sf):
    docs, found = findings(spark, sf)
    asked = docs.selectExpr("document_id", "CASE processing_status WHEN 'needs_review' THEN 'approve' WHEN 'failed' THEN 'reopen' END AS action").filter("action IS NOT NULL")
    return RV.apply_approvals(docs, RV.validate_approval(docs, found), asked)


@query("ag22_group_issues", sql("""SELECT document_id, CASE code WHEN 'missing_price_or_total' THEN '금액/총액 누락' WHEN 'amount_mismatch' THEN '문서 총액과 품목 합계 불일치' WHEN 'missing_quantity' THEN '수량 누락' WHEN 'missing_line_items' THEN '품목 정보 누락'
  WHEN 'related_document_missing' THEN '관련 원문서 번호 확인' WHEN 'amount_direction_requires_review' THEN '반품/차감 금액 방향 확인' END AS summary, field AS description, count(*) AS count FROM iss
 WHERE code IN ('missing_price_or_total','amount_mismatch','missing_quantity','missing_line_items','related_document_missing','amount_direction_requires_review') GROUP BY ALL""", *ISS_VIEWS))
def _(spark, sf):
    known = issues(spark, sf).filter(F.col("code").isin("missing_price_or_total", "amount_mismatch", "missing_quantity", "missing_line_items", "related_document_missing", "amount_direction_requires_review"))
    return RV.group_issues(known).drop("first_pos")


@query("ag24_candidate_summary", sql("""SELECT document_id, count(*) AS candidate_count, count(*) FILTER (WHERE severity = 'warn') AS warning_count, count(*) FILTER (WHERE severity = 'fail') AS failure_count,
 arg_min(decision, i) FILTER (WHERE decision IS NOT NULL) AS gate_decision, (SELECT string_agg(code, '|' ORDER BY fi, fj) FROM (SELECT code, min(i) AS fi, arg_min(j, i) AS fj FROM cc c2 WHERE c2.document_id = c.document_id GROUP BY code)) AS issue_codes
 FROM cnd c GROUP BY document_id""", LNP, f"""cnd AS (SELECT document_id, line_index AS i, CASE unit WHEN 'EA' THEN 'warn' ELSE 'fail' END AS severity, CASE WHEN quantity IS NOT NULL THEN 'gate_' || return_flag END AS decision, {FLAGS} AS codes FROM lnp),
cc AS (SELECT document_id, i, unnest(codes) AS code, unnest(range(0, len(codes))) AS j FROM cnd)"""))
def _(spark, sf):
    cands = V.lines(spark, sf).select(
        "document_id", F.col("line_index").alias("candidate_index"), F.expr("CASE unit WHEN 'EA' THEN 'warn' ELSE 'fail' END").alias("validation_severity"),
        F.expr("CASE WHEN quantity IS NOT NULL THEN concat('gate_', return_flag) END").alias("gate_decision"), L.flags().alias("issue_codes"), F.array(F.lit("x")).alias("gate_reasons"))
    return RV.candidate_summary(cands).drop("gate_reasons")


@query("wn13_last_n", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 12")
def _(spark, sf):
    return RV.last_n(V.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], "ts", 12).select("user_id", "event_id", "event_type")
