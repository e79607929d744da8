"""DuckDB twins of the domain views, used only by the correctness oracle."""

from __future__ import annotations

DOCS0 = """docs0 AS (
 SELECT *, CAST(o_orderdate AS DATE) AS d, day(o_orderdate) AS dd, month(o_orderdate) AS mm,
   strftime(o_orderdate, '%Y%m%d') AS ymd, CAST(o_totalprice AS DECIMAL(18,2)) AS amt,
   CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.1 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS vat,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'purchase_order' WHEN '2-HIGH' THEN 'quotation'
     WHEN '3-MEDIUM' THEN 'transaction_statement' WHEN '4-NOT SPECIFIED' THEN 'delivery_note' WHEN '5-LOW' THEN 'invoice' END AS document_type,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'PO' WHEN '2-HIGH' THEN 'QT'
     WHEN '3-MEDIUM' THEN 'TS' WHEN '4-NOT SPECIFIED' THEN 'DN' WHEN '5-LOW' THEN 'INV' END AS prefix,
   (o_orderstatus = 'F' AND day(o_orderdate) <= 10) AS mapped
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

DOCS = DOCS0 + """,
docs AS (
 SELECT o_orderkey AS document_id, document_type,
  CASE WHEN dd <> 28 THEN prefix || '-' || ymd || '-' || CAST(o_orderkey AS VARCHAR) END AS document_number,
  document_type || '_' || ymd || CASE WHEN dd > 15 THEN '.PDF' ELSE '.pdf' END AS original_filename,
  CASE WHEN dd = 31 THEN NULL WHEN o_orderstatus = 'F' THEN 'pdf' WHEN o_orderstatus = 'O' THEN 'xlsx' ELSE 'jpg' END AS source_file_type,
  document_type || ' ' || c_name AS title,
  CASE WHEN dd IN (5,6) THEN NULL ELSE c_mktsegment || ' 상사' END AS vendor_name,
  CASE WHEN dd = 13 THEN NULL WHEN dd = 14 THEN '' WHEN dd = 15 THEN '  ' ELSE c_name END AS customer_name,
  CASE WHEN dd = 13 AND mm <= 6 THEN 'Walk-in' END AS merchant_name,
  CASE WHEN dd <> 21 THEN d END AS issue_date,
  CASE WHEN NOT (dd = 21 AND mm <= 3) THEN d END AS extracted_date,
  CASE WHEN NOT (o_orderstatus = 'P' AND dd <= 10) THEN CAST(d + INTERVAL 30 DAY AS DATE) END AS due_date,
  o_orderdate + INTERVAL 1 DAY AS created_at,
  o_orderdate + INTERVAL 1 DAY + to_seconds(o_custkey) AS updated_at,
  CASE WHEN c_nationkey < 5 THEN 'USD' WHEN c_nationkey > 5 THEN 'KRW' END AS currency,
  CASE WHEN mm = 2 THEN NULL WHEN dd = 9 THEN CAST(0 AS DECIMAL(18,2)) ELSE amt END AS extracted_amount,
  CASE WHEN dd = 11 THEN NULL ELSE CAST(amt - vat AS DECIMAL(18,2)) END AS subtotal,
  CASE WHEN dd = 12 THEN NULL ELSE vat END AS tax,
  CASE WHEN o_orderstatus = 'F' THEN 'confirmed'
       WHEN o_orderstatus = 'O' THEN CASE WHEN dd <= 2 THEN 'completed' WHEN dd = 3 THEN 'processing' WHEN dd = 4 THEN 'queued' ELSE 'ready' END
       WHEN dd = 30 THEN 'failed' ELSE 'needs_review' END AS processing_status,
  (o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')) AS review_required,
  (c_mktsegment = 'MACHINERY' AND dd <= 3) AS is_favorite,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Purchase Order' WHEN 'AUTOMOBILE' THEN 'document > Repair Service Receipt'
       WHEN 'MACHINERY' THEN 'utilities' WHEN 'FURNITURE' THEN 'delivery_note' END AS category,
  [document_type, lower(c_mktsegment), 'time-sensitive', 'other', document_type] AS tags,
  CASE WHEN dd <> 20 THEN [CAST(CAST(d + INTERVAL 30 DAY AS DATE) AS VARCHAR), 'ship ' || CAST(CAST(d + INTERVAL 7 DAY AS DATE) AS VARCHAR), 'n/a'] END AS key_dates,
  CAST((CAST(amt * 100 AS BIGINT) % 100) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(4,3)) AS confidence_score,
  CASE o_orderstatus WHEN 'F' THEN 'pdf_text' WHEN 'O' THEN 'xlsx_direct' ELSE 'image_ocr' END AS extraction_method,
  (o_orderstatus = 'O' AND dd BETWEEN 20 AND 25) AS approved,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND mm = 7 THEN 'no_price_document' WHEN o_orderpriority = '5-LOW' THEN 'tax_document' END AS document_profile,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND mm <= 6 THEN ['no_price_document', 'delivery']
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ['delivery']
       WHEN o_orderpriority = '5-LOW' THEN ['tax_document']
       WHEN o_orderpriority = '2-HIGH' AND dd = 17 THEN ['return_document']
       WHEN o_orderpriority = '2-HIGH' AND dd = 18 THEN ['inventory_movement_document']
       WHEN o_orderpriority = '2-HIGH' AND dd = 19 THEN ['foreign_currency_document']
       ELSE CAST([] AS VARCHAR[]) END AS document_profiles,
  CASE WHEN o_orderpriority = '3-MEDIUM' AND mm = 12 THEN false END AS tax_amount_required,
  CASE WHEN mapped THEN o_orderdate + (CASE WHEN dd <= 5 THEN INTERVAL 61 MINUTE ELSE INTERVAL 59 MINUTE END) END AS mapping_at,
  CASE WHEN mapped THEN o_orderdate + INTERVAL 60 MINUTE END AS confirmed_at,
  CASE WHEN mapped THEN 'invoice' END AS m_category,
  CASE WHEN dd IN (1,3,5,7,9) THEN '매핑 ' || c_name END AS m_customer_name,
  CASE WHEN dd <> 4 THEN CAST(CAST(d + INTERVAL 1 DAY AS DATE) AS VARCHAR) END AS m_issue_date,
  CASE WHEN dd = 2 THEN '0' WHEN dd = 3 THEN NULL ELSE '₩' || CAST(amt AS VARCHAR) END AS m_document_total,
  CASE WHEN dd = 3 THEN '견적 미정' END AS m_estimated_total
 FROM docs0)"""

LNS0 = """lns0 AS (
 SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_discount AS DECIMAL(4,2)) AS dc, CAST(l_tax AS DECIMAL(4,2)) AS tx,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS sup
 FROM lineitem)"""

_LNS_COLS = """l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS line_no,
  (CAST(l_linenumber AS BIGINT) * 576460752303423488) + (l_partkey * 16777216) + CAST(ext * 100 AS BIGINT) AS line_index,
  l_partkey AS part_key, l_suppkey AS supp_key,
  CASE WHEN NOT (tx = 0.08 AND l_returnflag = 'N') THEN CAST(l_quantity AS DECIMAL(18,2)) END AS quantity,
  CASE WHEN NOT (tx = 0.04 AND dc = 0.04) THEN CAST(CAST(CAST(ext * 100 AS BIGINT) // CAST(l_quantity AS BIGINT) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS unit_price,
  CASE WHEN NOT (dc = 0 AND l_returnflag = 'R') THEN sup END AS supply_amount,
  CAST(round(sup * tx, 2) AS DECIMAL(18,2)) AS tax_amount,
  CASE WHEN NOT (dc = 0 AND tx = 0.02) THEN CAST(sup + CAST(round(sup * tx, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) END AS line_total,
  CASE l_linestatus WHEN 'O' THEN 'EA' ELSE 'BOX' END AS unit,
  CASE WHEN dc = 0.10 AND l_returnflag = 'A' THEN ['invalid_line_amount']
       WHEN tx = 0.07 THEN ['handwritten_requires_review', 'ai_parsed_document_table_review_required']
       ELSE CAST([] AS VARCHAR[]) END AS review_flags,
  CASE WHEN tx = 0.08 AND dc = 0.05 THEN ['invalid_line_total']
       WHEN tx = 0.06 THEN ['option_amount_not_confirmed', 'untrusted_ocr_amount']
       ELSE CAST([] AS VARCHAR[]) END AS validation_warnings,
  CASE WHEN day(l_shipdate) = 1 THEN '단가 별도 협의' END AS note,
  CAST(l_shipdate AS DATE) AS ship_date, l_returnflag AS return_flag"""

LNS = LNS0 + f""",
lns AS (SELECT {_LNS_COLS} FROM lns0)"""

LNP = LNS0 + f""",
lnp AS (SELECT {_LNS_COLS},
  CASE WHEN p_size = 50 THEN NULL
       WHEN p_type = 'ECONOMY' THEN 'STS 3O4 ' || p_name || ' ' || p_size || '.0T'
       WHEN p_type = 'SMALL' THEN '스테인리스 304 ' || p_name
       WHEN p_type = 'MEDIUM' THEN '철판 ' || p_name || ' ' || p_size || 't'
       WHEN p_type = 'LARGE' THEN p_name || ' (Lot-' || p_size || ')'
       WHEN p_type = 'PROMO' THEN 'SUS_304 ' || p_name
       ELSE p_name END AS item_name,
  CASE WHEN p_size <> 49 THEN p_size || ' × ' || (p_size * 2) || '*3.0T' END AS specification,
  'IT-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS item_code,
  CASE l_returnflag WHEN 'A' THEN 'it-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0')
       WHEN 'N' THEN substring('IT-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0'), 1, 11) END AS document_item_code
 FROM lns0 LEFT JOIN part ON l_partkey = p_partkey)"""

MASTER = """master AS (
 SELECT p_partkey AS item_id, 'IT-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS internal_item_code, p_name AS item_name,
  p_size || 'x' || (p_size * 2) || 'x3t' AS spec, CASE WHEN p_size % 2 = 0 THEN 'EA' ELSE 'BOX' END AS unit, p_type AS category,
  CAST(p_retailprice AS DECIMAL(18,2)) AS standard_price, p_size <> 13 AS active,
  [p_name || ' ' || p_brand, p_brand || '-' || CAST(p_partkey AS VARCHAR)] AS aliases
 FROM part),
alias AS (
 SELECT p_partkey AS item_id, p_brand || ' ' || p_name AS alias_name,
  CASE WHEN p_size > 25 THEN p_size || 'x' || (p_size * 2) END AS alias_spec, p_size <= 45 AS active
 FROM part)"""

SLIPS = """slips AS (
 SELECT p.*, h.document_type, h.document_number, h.vendor_name, h.customer_name, h.extracted_date, h.due_date, h.currency, h.review_required,
  concat_ws(chr(10),
   CASE document_type WHEN 'purchase_order' THEN '발주서' WHEN 'quotation' THEN '견적서'
        WHEN 'transaction_statement' THEN '거래명세서' WHEN 'delivery_note' THEN '납품서' ELSE '세금계산서' END,
   '문서번호: ' || document_number,
   '발행일: ' || CASE WHEN unit = 'EA' THEN CAST(extracted_date AS VARCHAR) ELSE strftime(extracted_date, '%Y.%m.%d') END,
   '  ',
   '납기일 : ' || strftime(due_date, '%Y%m%d'),
   '공급업체: ' || vendor_name, '고객사: ' || customer_name, '통화: ' || currency,
   '품목명 | 규격 | 수량 | 단위 | 단가 | 공급가액 | 세액 | 합계금액',
   concat_ws(' | ', coalesce(item_name, '-'), coalesce(specification, '-'), coalesce(CAST(quantity AS VARCHAR), '-'), unit,
     coalesce(CAST(unit_price AS VARCHAR), '-'), coalesce(CAST(supply_amount AS VARCHAR), '-'),
     CAST(tax_amount AS VARCHAR), coalesce(CAST(line_total AS VARCHAR), '-')),
   '공급가액 ' || coalesce(CAST(supply_amount AS VARCHAR), '-'),
   '세액 ' || CAST(tax_amount AS VARCHAR),
   '합계 ' || coalesce(CAST(line_total AS VARCHAR), '-'),
   CASE WHEN note IS NOT NULL THEN '비고: ' || note || ' / computed 합계 1.00' END) AS text,
  document_id || '/' || line_index AS slip_id
 FROM lnp p JOIN docs h USING (document_id))"""

# The report base: resolved columns per document.
RESOLVED = """ln_sum AS (
 SELECT document_id, sum(coalesce(supply_amount, line_total)) AS line_sum FROM lns GROUP BY document_id),
res0 AS (
 SELECT *, (processing_status IN ('confirmed','completed') OR approved) AS verified,
  (NOT review_required AND (processing_status IN ('confirmed','completed') OR approved)
   AND confirmed_at IS NOT NULL AND mapping_at IS NOT NULL AND mapping_at >= confirmed_at) AS fresh
 FROM docs),
res AS (
 SELECT r.*,
  coalesce(CASE WHEN fresh THEN TRY_CAST(m_issue_date AS DATE) END, issue_date, extracted_date, CAST(created_at AS DATE)) AS doc_date,
  coalesce(nullif(trim(coalesce(CASE WHEN fresh THEN nullif(m_customer_name, '') END, nullif(customer_name, ''), nullif(vendor_name, ''), nullif(merchant_name, ''))), ''), '거래처 미확인') AS party,
  coalesce(CASE WHEN fresh AND coalesce(nullif(m_document_total,''), nullif(m_estimated_total,'')) IS NOT NULL
      THEN TRY_CAST(replace(nullif(regexp_extract(coalesce(nullif(m_document_total,''), nullif(m_estimated_total,'')), '[-+]?[0-9][0-9,]*(\\.[0-9]+)?', 0), ''), ',', '') AS DECIMAL(18,2))
      ELSE extracted_amount END, line_sum) AS doc_amount,
  NOT (coalesce(tax_amount_required = false, false) OR list_contains(document_profiles, 'no_price_document') OR coalesce(document_profile = 'no_price_document', false)) AS amount_required,
  coalesce(CASE WHEN fresh THEN m_category END, document_type) AS doc_type
 FROM res0 r LEFT JOIN ln_sum USING (document_id))"""


def sql(body: str, *views: str) -> str:
    """``WITH`` the given view twins (shared prefixes are kept once)."""
    text = ",\n".join(views)
    # LNS0 / DOCS0 prefixes can occur twice when views are combined
    for prefix in (LNS0, DOCS0):
        first = text.find(prefix)
        if first >= 0:
            rest = text[first + len(prefix):].replace(prefix + ",\n", "")
            text = text[: first + len(prefix)] + rest
    return f"WITH {text}\n{body}" if text else body
