"""Report queries: resolved columns, breakdowns, issues, sections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bizdocs.catalog.registry import query
from bizdocs.catalog.twins import DOCS, LNP, LNS, RESOLVED, sql
from bizdocs.operators import resolve as R
from bizdocs.plans import report as P
from bizdocs.sources import views as V

START, END = dt.date(1997, 5, 1), dt.date(1997, 6, 1)
RANGE = "doc_date >= DATE '1997-05-01' AND doc_date < DATE '1997-06-01'"


def _resolved(select: str) -> str:
    return sql(f"SELECT document_id, {select} FROM res", DOCS, LNS, RESOLVED)


@query("pr01_document_date", _resolved("CAST(doc_date AS VARCHAR) AS doc_date"))
def _(spark, sf):
    return V.documents(spark, sf).select("document_id", R.document_date().alias("doc_date"))


@query("pr02_party_name", _resolved("party"))
def _(spark, sf):
    return V.documents(spark, sf).select("document_id", R.party_name().alias("party"))


@query("pr03_document_amount", _resolved("CAST(doc_amount AS DOUBLE) AS amount"))
def _(spark, sf):
    return R.document_amount(V.documents(spark, sf), V.lines(spark, sf))


@query("pr03_document_amount_mapping", sql("""SELECT document_id, CAST(coalesce(CASE WHEN fresh AND coalesce(nullif(m_document_total,''), nullif(m_estimated_total,'')) IS NOT NULL
  THEN TRY_CAST(replace(nullif(regexp_extract(coalesce(nullif(m_document_total,''), nullif(m_estimated_total,'')), '[-+]?[0-9][0-9,]*(\\.[0-9]+)?', 0), ''), ',', '') AS DECIMAL(18,2)) ELSE extracted_amount END,
  CASE WHEN fresh AND n_mapped > 0 THEN n_mapped * 7 ELSE line_sum END) AS DOUBLE) AS amount
 FROM res0 LEFT JOIN ln_sum USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n_mapped FROM lns WHERE line_no <= 2 GROUP BY document_id) USING (document_id)""", DOCS, LNS, RESOLVED))
def _(spark, sf):
    lines = V.lines(spark, sf)
    mapped = lines.filter("line_no <= 2").withColumns({"supply_amount": F.lit("7.00").cast("decimal(18,2)"), "line_total": F.lit(None).cast("decimal(18,2)")})
    return R.document_amount(V.documents(spark, sf), lines, mapped)


@query("pr04_is_verified", _resolved("verified"))
def _(spark, sf):
    return V.documents(spark, sf).select("document_id", R.is_verified().alias("verified"))


@query("pr05_fresh_mapping", _resolved("fresh, CASE WHEN fresh THEN m_category END AS category"))
def _(spark, sf):
    return V.documents(spark, sf).select(
        "document_id", R.fresh_mapping().alias("fresh"), F.when(R.fresh_mapping(), F.col("mapping.category")).alias("category"))


@query("pr06_amount_required", _resolved("amount_required"))
def _(spark, sf):
    return V.documents(spark, sf).select("document_id", R.amount_required().alias("amount_required"))


def _month(spark, sf, with_lines=True, with_part=True):
    docs = P.in_range(V.documents(spark, sf), START, END)
    lines = V.lines(spark, sf, with_part=with_part)
    if not with_part:
        lines = lines.withColumn("item_name", F.lit("-"))
    return (P.report_base(docs, lines) if with_lines else P.report_base(docs)), lines


@query("fl06_in_range", sql(f"SELECT document_id, CAST(doc_date AS VARCHAR) AS doc_date FROM res WHERE {RANGE}", DOCS, LNS, RESOLVED))
def _(spark, sf):
    return P.in_range(V.documents(spark, sf), START, END).select("document_id", R.document_date().alias("doc_date"))


@query("fl06_in_range_compat", sql(f"""SELECT document_id, CAST(doc_date AS VARCHAR) AS doc_date FROM res WHERE {RANGE}
 AND ((issue_date >= DATE '1997-05-01' AND issue_date < DATE '1997-06-01') OR (extracted_date >= DATE '1997-05-01' AND extracted_date < DATE '1997-06-01')
   OR (created_at >= TIMESTAMP '1997-05-01' AND created_at < TIMESTAMP '1997-06-01'))""", DOCS, LNS, RESOLVED))
def _(spark, sf):
    return P.in_range(V.documents(spark, sf), START, END, compat=True).select("document_id", R.document_date().alias("doc_date"))


@query("fl07_party_equals", sql("SELECT document_id, party FROM res WHERE lower(regexp_replace(party, '\\s+', '', 'g')) = 'building상사'", DOCS, LNS, RESOLVED))
def _(spark, sf):
    return P.party_equals(V.documents(spark, sf), " building 상사").select("document_id", R.party_name().alias("party"))


LINE_STATS = """lst AS (
 SELECT document_id, count(*) AS n_lines,
  count(*) FILTER (WHERE trim(coalesce(item_name, '')) = '' OR quantity IS NULL) AS n_missing,
  count(*) FILTER (WHERE unit_price IS NULL AND coalesce(supply_amount, line_total) IS NULL) AS n_missing_amount,
  count(*) FILTER (WHERE abs(quantity * unit_price - coalesce(supply_amount, line_total)) > 1) AS n_mismatch
 FROM lnp GROUP BY document_id),
base AS (SELECT r.*, l.n_lines, l.n_missing, l.n_missing_amount, l.n_mismatch,
  (party = '거래처 미확인' OR doc_date IS NULL OR n_lines IS NULL OR coalesce(n_missing,0) > 0 OR (amount_required AND coalesce(n_missing_amount,0) > 0)) AS has_missing,
  (amount_required AND coalesce(n_mismatch,0) > 0) AS has_mismatch
  FROM res r LEFT JOIN lst l USING (document_id) WHERE """ + RANGE + ")"
VIEWS = (DOCS, LNS, LNP, RESOLVED, LINE_STATS)
MONTH = (DOCS, LNS, RESOLVED, f"base AS (SELECT * FROM res WHERE {RANGE})")


@query("ag01_report_summary", sql("""SELECT count(*) AS total_documents, count(*) FILTER (WHERE verified) AS verified_documents,
 count(*) FILTER (WHERE NOT verified) AS pending_documents, CAST(coalesce(sum(doc_amount) FILTER (WHERE verified), 0) AS DOUBLE) AS total_amount,
 count(*) FILTER (WHERE has_missing OR has_mismatch OR NOT verified) AS documents_with_errors,
 count(*) FILTER (WHERE NOT amount_required) AS no_price_documents, count(*) FILTER (WHERE review_required) AS review_required_documents FROM base""", *VIEWS))
def _(spark, sf):
    return P.report_summary(_month(spark, sf)[0])


PARTY_SQL = """SELECT party AS name, count(*) AS document_count, CAST(coalesce(sum(doc_amount), 0) AS DOUBLE) AS total_amount
 FROM base WHERE verified GROUP BY party"""


@query("ag02_by_party", sql(PARTY_SQL, *MONTH))
def _(spark, sf):
    return P.by_party(_month(spark, sf, with_part=False)[0])


ITEM_SQL = """SELECT coalesce(nullif(trim(item_name), ''), '품목 미확인') AS item_name, coalesce(trim(specification), '') AS spec,
 CAST(coalesce(sum(quantity), 0) AS DOUBLE) AS quantity, CAST(coalesce(sum(coalesce(supply_amount, line_total)), 0) AS DOUBLE) AS total_amount
 FROM lnp WHERE document_id IN (SELECT document_id FROM base WHERE verified) GROUP BY ALL"""


@query("ag03_by_item", sql(ITEM_SQL, *VIEWS))
def _(spark, sf):
    base, lines = _month(spark, sf, with_lines=False)
    return P.by_item(base, lines)


@query("ag04_by_document_type", sql("""SELECT doc_type AS document_type, count(*) AS document_count, count(*) FILTER (WHERE verified) AS verified_documents,
 count(*) FILTER (WHERE NOT verified) AS pending_documents, CAST(coalesce(sum(doc_amount) FILTER (WHERE verified), 0) AS DOUBLE) AS total_amount,
 count(*) FILTER (WHERE NOT amount_required) AS no_price_documents FROM base GROUP BY doc_type""", *MONTH))
def _(spark, sf):
    return P.by_document_type(_month(spark, sf, with_part=False)[0])


@query("ag05_by_date", sql("""SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS date, count(document_id) AS document_count, count(*) FILTER (WHERE verified) AS verified_documents,
 count(*) FILTER (WHERE NOT verified) AS pending_documents, CAST(coalesce(sum(doc_amount) FILTER (WHERE verified), 0) AS DOUBLE) AS total_amount,
 count(*) FILTER (WHERE review_required) AS review_required_documents, count(*) FILTER (WHERE NOT amount_required) AS no_price_documents
 FROM generate_series(DATE '1997-05-01', DATE '1997-05-31', INTERVAL 1 DAY) g(day) LEFT JOIN base ON doc_date = day GROUP BY day""", *MONTH))
def _(spark, sf):
    return P.by_date(_month(spark, sf, with_part=False)[0], START, END)


@query("ag06_top_parties", sql(PARTY_SQL + " ORDER BY total_amount DESC, document_count DESC, name LIMIT 5", *MONTH))
def _(spark, sf):
    return P.top_parties(P.by_party(_month(spark, sf, with_part=False)[0]))


@query("ag06_top_items", sql(ITEM_SQL + " ORDER BY total_amount DESC, quantity DESC, item_name, spec LIMIT 10", *VIEWS))
def _(spark, sf):
    base, lines = _month(spark, sf, with_lines=False)
    return P.top_items(P.by_item(base, lines))


MISSING_SQL = """missing AS (
 SELECT document_id, CAST(NULL AS BIGINT) AS line_no, unnest(list_filter([CASE WHEN party = '거래처 미확인' THEN '거래처명' END,
   CASE WHEN doc_date IS NULL THEN '문서 날짜' END, CASE WHEN n_lines IS NULL THEN '품목' END], lambda x: x IS NOT NULL)) AS label FROM base
 UNION ALL
 SELECT document_id, line_no, unnest(list_filter([CASE WHEN trim(coalesce(item_name,'')) = '' THEN line_no || '번째 품명' END,
   CASE WHEN quantity IS NULL THEN line_no || '번째 수량' END,
   CASE WHEN amount_required AND unit_price IS NULL AND coalesce(supply_amount, line_total) IS NULL THEN line_no || '번째 단가 또는 금액' END], lambda x: x IS NOT NULL)) AS label
 FROM lnp JOIN (SELECT document_id, amount_required FROM base) USING (document_id)),
mismatch AS (
 SELECT document_id, CAST(line_no AS BIGINT) AS line_no, quantity * unit_price AS expected, coalesce(supply_amount, line_total) AS line_amount
 FROM lnp WHERE abs(quantity * unit_price - coalesce(supply_amount, line_total)) > 1 AND document_id IN (SELECT document_id FROM base WHERE amount_required)),
issues AS (SELECT document_id, '필수값 누락' AS issue_type FROM missing UNION ALL SELECT document_id, '계산 불일치' FROM mismatch
 UNION ALL SELECT document_id, '미검수 문서' FROM base WHERE NOT verified)"""


@query("qg04_missing_field_issues", sql("SELECT document_id, line_no, label FROM missing", *VIEWS, MISSING_SQL))
def _(spark, sf):
    return P.missing_fields(*_month(spark, sf)).select("document_id", "line_no", "label")


@query("qg05_calculation_mismatch", sql("SELECT document_id, line_no, CAST(expected AS DOUBLE) AS expected, CAST(line_amount AS DOUBLE) AS line_amount FROM mismatch", *VIEWS, MISSING_SQL))
def _(spark, sf):
    return P.calculation_mismatches(*_month(spark, sf)).drop("line_index")


@query("se03_report_issues", sql("SELECT document_id, issue_type, count(*) AS n FROM issues GROUP BY ALL", *VIEWS, MISSING_SQL))
def _(spark, sf):
    return P.report_issues(*_month(spark, sf)).groupBy("document_id", "issue_type").agg(F.count("*").alias("n"))


@query("sk05_report_sections", sql(f"""
 SELECT 'Summary' AS section, CAST(NULL AS VARCHAR) AS key, count(*) AS document_count, CAST(coalesce(sum(doc_amount) FILTER (WHERE verified), 0) AS DOUBLE) AS total_amount FROM base
 UNION ALL SELECT 'By Party', name, document_count, total_amount FROM ({PARTY_SQL})
 UNION ALL SELECT 'By Item', item_name || '/' || spec, NULL, total_amount FROM ({ITEM_SQL})
 UNION ALL SELECT 'By Document Type', doc_type, count(*), CAST(coalesce(sum(doc_amount) FILTER (WHERE verified), 0) AS DOUBLE) FROM base GROUP BY doc_type
 UNION ALL SELECT 'By Date', CAST(CAST(day AS DATE) AS VARCHAR), count(document_id), CAST(coalesce(sum(doc_amount) FILTER (WHERE verified), 0) AS DOUBLE)
   FROM generate_series(DATE '1997-05-01', DATE '1997-05-31', INTERVAL 1 DAY) g(day) LEFT JOIN base ON doc_date = day GROUP BY day
 UNION ALL SELECT 'Issues', document_id || '/' || issue_type, NULL, NULL FROM (SELECT DISTINCT document_id, issue_type FROM issues)""", *VIEWS, MISSING_SQL))
def _(spark, sf):
    base, lines = _month(spark, sf)
    key = (F.when(F.col("section") == "By Item", F.concat_ws("/", "item_name", "spec"))
           .when(F.col("section") == "Issues", F.concat_ws("/", "document_id", "issue_type"))
           .otherwise(F.coalesce("name", "document_type", F.col("date").cast("string"))))
    out = P.report_to_sections(base, lines, START, END)
    return out.select("section", key.alias("key"), F.coalesce("document_count", "total_documents").alias("document_count"), "total_amount")
