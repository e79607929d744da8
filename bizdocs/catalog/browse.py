"""Search, listing, folders, calendar and dashboard queries."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from uuid import uuid4

from pyspark.sql import functions as F

from bizdocs.catalog.registry import query
from bizdocs.catalog.twins import DOCS, LNP, MASTER, sql
from bizdocs.functions import text as T
from bizdocs.operators import browse as B
from bizdocs.operators import resolve as R
from bizdocs.operators.order_index import indexed_page, page_after, write_order_index
from bizdocs.operators.search_index import indexed_search, write_search_index
from bizdocs.session import checkpoint_dir
from bizdocs.sources import views as V
from bizdocs.sources.documents import check_documents, quarantine

TODAY = dt.date(1998, 1, 15)


def case_map(expr: str, pairs: dict, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def sql_category(expr: str) -> str:
    t = f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({expr})), '[\\s/\\-]+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), '')"
    return case_map(t, T.CATEGORY_ALIASES, t)


def sql_label(n: str) -> str:
    words = f"array_to_string(list_transform(string_split({n}, '_'), lambda p: upper(p[1]) || lower(p[2:])), ' ')"
    return f"coalesce({case_map(n, {**T.EXTRA_LABELS, **T.ROOT_LABELS}, words)}, 'Uncategorized')"


LEAF = sql_category("string_split(category, '>')[-1]")
COUNTS = """count(*) AS count, count(*) FILTER (WHERE processing_status = 'needs_review') AS needs_review,
 count(*) FILTER (WHERE processing_status = 'confirmed') AS confirmed, count(*) FILTER (WHERE processing_status IN ('processing','queued')) AS processing"""


def d(body: str) -> str:
    return sql(body, DOCS)


@query("sc01_load_documents", d("SELECT document_type, processing_status, count(*) AS n, count(extracted_date) AS dated, CAST(sum(extracted_amount) AS DOUBLE) AS amount FROM docs GROUP BY ALL"))
def _(spark, sf):
    return V.documents(spark, sf).groupBy("document_type", "processing_status").agg(
        F.count("*").alias("n"), F.count("extracted_date").alias("dated"), F.sum("extracted_amount").alias("amount"))


@query("sc01_scan_documents", """WITH raw AS (SELECT *, array_to_string(list_filter([CASE WHEN day(o_orderdate) = 31 THEN 'original_filename: missing' END,
  CASE WHEN month(o_orderdate) = 3 THEN 'mime_type: too long' END, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'document_type: unknown value' END,
  CASE WHEN day(o_orderdate) = 7 THEN 'extracted_amount: wrong type' END, CASE WHEN o_orderstatus = 'P' THEN 'tags: wrong type' END], lambda x: x IS NOT NULL), '|') AS reasons FROM orders)
 SELECT o_orderkey AS document_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'purchase_order' WHEN '2-HIGH' THEN 'quotation' ELSE 'general_document' END AS document_type,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS amount, o_orderpriority || '|b' AS tags, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'uploaded' END AS status,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, '[]' AS line_items, '' AS reasons FROM raw WHERE reasons = ''
 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, reasons FROM raw WHERE reasons <> ''""")
def _(spark, sf):
    """A raw table with bad values, missing and extra columns through the declared scan: good and rejected rows."""
    raw = V.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS Document_Id", "CASE WHEN day(o_orderdate) <> 31 THEN concat('f', o_orderkey, '.pdf') END AS original_filename", "'/store' AS stored_file_path",
        "CASE WHEN month(o_orderdate) = 3 THEN repeat('m', 101) ELSE 'application/pdf' END AS mime_type",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'purchase_order' WHEN '2-HIGH' THEN 'quotation' WHEN '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS document_type",
        "CASE WHEN day(o_orderdate) = 7 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS extracted_amount",
        "CASE WHEN o_orderstatus = 'F' THEN 'confirmed' END AS processing_status", "CASE WHEN o_orderstatus = 'P' THEN 'no list' ELSE to_json(array(o_orderpriority, 'b')) END AS tags",
        "o_orderdate AS extracted_date", "o_custkey AS surprise")
    rows, rejected, _ = quarantine(check_documents(raw), f"{checkpoint_dir(spark)}/scan-{uuid4().hex}")
    good = rows.select(
        "document_id", "document_type", F.col("extracted_amount").alias("amount"), F.array_join("tags", "|").alias("tags"), F.col("processing_status").alias("status"),
        F.col("extracted_date").cast("string").alias("day"), "line_items", F.lit("").alias("reasons"))
    return good.unionByName(rejected.select("document_id", F.array_join("reasons", "|").alias("reasons")), allowMissingColumns=True)


SEARCHED = sql("""SELECT document_id FROM docs WHERE
 (title ILIKE '%machinery%' OR vendor_name ILIKE '%machinery%' OR customer_name ILIKE '%machinery%' OR document_number ILIKE '%machinery%' OR original_filename ILIKE '%machinery%' OR category ILIKE '%machinery%' OR merchant_name ILIKE '%machinery%'
   OR document_id IN (SELECT document_id FROM lnp WHERE item_name ILIKE '%machinery%'))
 AND (title ILIKE '%red w%t%' OR document_id IN (SELECT document_id FROM lnp WHERE item_name ILIKE '%red_widget%' OR item_code ILIKE '%red_widget%' OR specification ILIKE '%red_widget%'))""", DOCS, LNP)


def _searched(spark, sf):
    return V.documents(spark, sf), V.lines(spark, sf, with_part=True).select("document_id", "line_index", "item_name", "item_code", "specification")


@query("fl01_search", SEARCHED)
def _(spark, sf):
    docs, lines = _searched(spark, sf)
    return B.search(docs, "machinery red_widget", lines).select("document_id")


@query("fl01_indexed_search", SEARCHED)
def _(spark, sf):
    """The same through an index of all documents and lines."""
    path = f"{checkpoint_dir(spark)}/search-{uuid4().hex}"
    docs, lines = _searched(spark, sf)
    write_search_index(docs, path, lines)
    return indexed_search(spark, path, "machinery red_widget").select("document_id")


@query("fl02_list_documents", d("""SELECT document_id, CAST(extracted_amount AS DOUBLE) AS extracted_amount FROM docs WHERE document_type = 'invoice' AND processing_status = 'confirmed'
 AND source_file_type = 'pdf' AND category = 'delivery_note' AND NOT is_favorite AND extracted_date >= DATE '1996-01-01' AND extracted_date <= DATE '1999-12-31'
 AND extracted_amount >= 1000 AND extracted_amount <= 400000"""))
def _(spark, sf):
    return B.list_documents(
        V.documents(spark, sf), document_type="invoice", processing_status="confirmed", source_file_type="pdf", category="x > Delivery Note",
        is_favorite=False, date_from=dt.date(1996, 1, 1), date_to=dt.date(1999, 12, 31), amount_min=1000, amount_max=400000,
    ).select("document_id", "extracted_amount")


@query("fl03_review_queue", d("SELECT document_id FROM docs WHERE processing_status = 'needs_review'"))
def _(spark, sf):
    return B.review_queue(V.documents(spark, sf)).select("document_id")


@query("fl03_favorites", d("SELECT document_id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM docs WHERE is_favorite"))
def _(spark, sf):
    return B.favorites(V.documents(spark, sf)).select("document_id", "updated_at")


@query("fl04_review_actionable", d("""SELECT document_id, processing_status = 'needs_review' OR (review_required AND processing_status IN ('needs_review','ready','confirmed','completed')) AS actionable FROM docs"""))
def _(spark, sf):
    return V.documents(spark, sf).select("document_id", R.is_review_actionable().alias("actionable"))


@query("fl05_select_for_export", d("SELECT document_id FROM docs WHERE document_type = 'invoice' AND category = 'delivery_note' AND document_id IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.05)"))
def _(spark, sf):
    ids = V.table(spark, sf, "lineitem").filter("l_discount = 0.05").select(F.col("l_orderkey").alias("document_id"))
    return B.select_for_export(V.documents(spark, sf), ids, "invoice", "delivery note").select("document_id")


@query("pr08_readiness", d("""SELECT document_id, CASE WHEN processing_status = 'failed' THEN '실패' WHEN processing_status IN ('uploaded','queued','processing') THEN '처리 중'
 WHEN review_required AND NOT approved THEN '검토 필요' WHEN confidence_score > 0.9 THEN '검토 후보 있음' WHEN processing_status = 'confirmed' OR approved THEN '승인됨' ELSE 'Ready' END AS readiness FROM docs"""))
def _(spark, sf):
    docs = V.documents(spark, sf).withColumn("uncertain_count", F.when(F.col("confidence_score") > 0.9, 1))
    return docs.select("document_id", R.readiness().alias("readiness"))


@query("pr09_schedule_date", d("""SELECT document_id, CAST(coalesce(due_date, CAST(regexp_extract(key_dates[1], '\\d{4}-\\d{2}-\\d{2}') AS DATE), issue_date, extracted_date) AS VARCHAR) AS date,
 CASE WHEN due_date IS NOT NULL THEN 'due_date' WHEN key_dates IS NOT NULL THEN 'key_date' WHEN coalesce(issue_date, extracted_date) IS NOT NULL THEN 'issue_date' END AS role,
 CASE WHEN due_date IS NOT NULL THEN '납기일' WHEN key_dates IS NOT NULL THEN '문서 일정' WHEN coalesce(issue_date, extracted_date) IS NOT NULL THEN '발행일 기준' END AS label,
 CASE WHEN due_date IS NOT NULL OR key_dates IS NOT NULL THEN false WHEN coalesce(issue_date, extracted_date) IS NOT NULL THEN true END AS fallback FROM docs"""))
def _(spark, sf):
    return V.documents(spark, sf).select("document_id", R.schedule_date().alias("s")).select("document_id", "s.date", "s.role", "s.label", "s.fallback")


CAL = """cal AS (SELECT document_id, 'issue_date' AS role, '발행일' AS label, coalesce(issue_date, extracted_date) AS date FROM docs WHERE coalesce(issue_date, extracted_date) IS NOT NULL
 UNION ALL SELECT document_id, 'due_date', CASE document_type WHEN 'purchase_order' THEN '납기일' WHEN 'delivery_note' THEN '납품일' WHEN 'invoice' THEN '지급기한'
   WHEN 'quotation' THEN '유효기간' WHEN 'transaction_statement' THEN '거래일자' ELSE '기한' END, due_date FROM docs WHERE due_date IS NOT NULL
 UNION ALL SELECT DISTINCT document_id, 'key_date', '문서 일정', k FROM (SELECT document_id, issue_date, extracted_date, due_date,
   TRY_CAST(nullif(regexp_extract(unnest(key_dates), '\\d{4}-\\d{2}-\\d{2}'), '') AS DATE) AS k FROM docs)
   WHERE k IS NOT NULL AND k IS DISTINCT FROM coalesce(issue_date, extracted_date) AND k IS DISTINCT FROM due_date)"""
DAYS = "datediff('day', DATE '1998-01-15', date)"
STATUS = f"CASE WHEN {DAYS} = 0 THEN '오늘' WHEN {DAYS} < 0 THEN '지난 일정' WHEN {DAYS} <= 7 THEN '임박' ELSE '예정' END"


@query("se02_calendar_dates", sql("SELECT document_id, role, label, CAST(date AS VARCHAR) AS date FROM cal", DOCS, CAL))
def _(spark, sf):
    return B.calendar_dates(V.documents(spark, sf))


@query("pr15_calendar_status", sql(f"SELECT document_id, role, {DAYS} AS days_from_today, {STATUS} AS status FROM cal", DOCS, CAL))
def _(spark, sf):
    return B.calendar_status(B.calendar_dates(V.documents(spark, sf)), TODAY).select("document_id", "role", "days_from_today", "status")


@query("st03_calendar", sql(f"SELECT document_id, role, CAST(date AS VARCHAR) AS date, {DAYS} AS days_from_today FROM cal WHERE date >= DATE '1997-12-01' ORDER BY abs({DAYS}), cal.date, document_id, role LIMIT 120", DOCS, CAL))
def _(spark, sf):
    out = B.calendar(B.calendar_dates(V.documents(spark, sf)), TODAY, date_from=dt.date(1997, 12, 1))
    return out.select("document_id", "role", "date", "days_from_today")


@query("jn17_preferred_calendar", sql("""SELECT document_id, role, CAST(date AS VARCHAR) AS date FROM cal WHERE role <> 'issue_date'
 OR document_id NOT IN (SELECT document_id FROM cal WHERE role <> 'issue_date')""", DOCS, CAL))
def _(spark, sf):
    return B.preferred_calendar(B.calendar_dates(V.documents(spark, sf))).select("document_id", "role", "date")


@query("pr16_notifications", d("""SELECT document_id, kind, action_required FROM (SELECT document_id, updated_at,
 CASE WHEN processing_status IN ('processing','queued') THEN 'processing' WHEN processing_status = 'failed' THEN 'failed' WHEN processing_status = 'needs_review' THEN 'review' ELSE 'processed' END AS kind,
 processing_status IN ('failed', 'needs_review') AS action_required FROM docs ORDER BY updated_at DESC, document_id LIMIT 30)"""))
def _(spark, sf):
    return B.notifications(V.documents(spark, sf)).select("document_id", "kind", "action_required")


@query("ag07_stats", d("""SELECT count(*) AS total, count(*) FILTER (WHERE document_type='receipt') AS receipts, count(*) FILTER (WHERE document_type='notice') AS notices,
 count(*) FILTER (WHERE processing_status IN ('completed','ready')) AS completed, count(*) FILTER (WHERE processing_status = 'confirmed') AS confirmed,
 count(*) FILTER (WHERE processing_status IN ('processing','queued')) AS processing, count(*) FILTER (WHERE processing_status = 'failed') AS failed,
 count(*) FILTER (WHERE processing_status = 'needs_review') AS needs_review, count(*) FILTER (WHERE processing_status = 'queued') AS queued FROM docs"""))
def _(spark, sf):
    return B.stats(V.documents(spark, sf))


@query("ag08_folder_summary", d(f"SELECT source_file_type AS value, {COUNTS}, {sql_label('source_file_type')} AS label FROM docs WHERE source_file_type IS NOT NULL GROUP BY source_file_type"))
def _(spark, sf):
    return B.folder_summary(V.documents(spark, sf), "source_file_type")


@query("ag09_category_folders", sql(f"""SELECT value, {COUNTS}, {sql_label('value')} AS label, false AS custom FROM (SELECT *, coalesce({LEAF}, 'uncategorized') AS value FROM docs) GROUP BY value
 UNION ALL SELECT lower(p_type), 0, 0, 0, 0, p_type, true FROM (SELECT DISTINCT p_type FROM part) WHERE lower(p_type) NOT IN (SELECT coalesce({LEAF}, 'uncategorized') FROM docs)""", DOCS))
def _(spark, sf):
    folders = V.table(spark, sf, "part").select(F.lower("p_type").alias("value"), F.col("p_type").alias("label")).distinct()
    return B.category_folders(V.documents(spark, sf), folders)


PARTY = "coalesce(nullif(trim(customer_name), ''), nullif(trim(vendor_name), ''), nullif(trim(merchant_name), ''), '거래처 미확인')"
KIND = case_map("document_type", T.ROOT_LABELS, "document_type")


@query("ag19_folder_tree_party_type", d(f"SELECT first, second, count(*) AS documents FROM (SELECT {PARTY} AS first, {KIND} AS second FROM docs) GROUP BY GROUPING SETS ((first), (first, second))"))
def _(spark, sf):
    return B.folder_tree(V.documents(spark, sf), "party_type")


@query("ag19_folder_tree_type_party", d(f"SELECT first, second, count(*) AS documents FROM (SELECT {KIND} AS first, {PARTY} AS second FROM docs) GROUP BY GROUPING SETS ((first), (first, second))"))
def _(spark, sf):
    return B.folder_tree(V.documents(spark, sf), "type_party")


@query("ag19_folder_tree_party", d(f"SELECT {PARTY} AS first, CAST(NULL AS VARCHAR) AS second, count(*) AS documents FROM docs GROUP BY 1"))
def _(spark, sf):
    return B.folder_tree(V.documents(spark, sf), "party")


@query("ag20_duplicate_filenames", d("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_documents FROM (SELECT count(*) AS n FROM docs GROUP BY lower(regexp_replace(original_filename, '\\s+', '', 'g'))) WHERE n > 1"))
def _(spark, sf):
    return B.duplicate_filenames(V.documents(spark, sf))


def with_metadata(docs):
    """Processing metadata rendered as JSON: nested for text files, flat for scans."""
    return docs.withColumn("ingestion_metadata", F.expr("""
      CASE source_file_type
        WHEN 'pdf' THEN to_json(named_struct('file_metadata', named_struct('ocr_engine', 'paddleocr_v4', 'elapsed_ms', CAST(confidence_score * 1000 AS INT), 'processing_time_ms', 0)))
        WHEN 'jpg' THEN to_json(named_struct('ocr_provider_succeeded', CASE WHEN currency = 'USD' THEN 'tesseract' ELSE 'paddleocr_worker' END, 'retry_used', dayofmonth(extracted_date) < 5,
                                             'ocr_worker_provider_reset_used', dayofmonth(extracted_date) = 7, 'processing_time_ms', CAST(extracted_amount AS INT)))
        WHEN 'xlsx' THEN '{}' END"""))


META = """meta AS (SELECT *, CASE WHEN source_file_type = 'pdf' THEN 'paddleocr_v4' WHEN source_file_type = 'jpg' THEN CASE WHEN currency = 'USD' THEN 'tesseract' ELSE 'paddleocr_worker' END ELSE '' END AS provider,
 coalesce(source_file_type = 'jpg' AND day(extracted_date) < 5, false) AS retry, coalesce(source_file_type = 'jpg' AND day(extracted_date) = 7, false) AS reset,
 CASE WHEN source_file_type = 'pdf' THEN CAST(trunc(confidence_score * 1000) AS BIGINT) WHEN source_file_type = 'jpg' THEN nullif(CAST(trunc(extracted_amount) AS BIGINT), 0) END AS ms FROM docs)"""


@query("ag14_ocr_metrics", sql("""SELECT count(*) AS total_documents, count(*) FILTER (WHERE contains(provider, 'paddleocr')) AS provider_success, count(*) FILTER (WHERE retry) AS provider_retry,
 count(*) FILTER (WHERE reset) AS provider_reset, count(*) FILTER (WHERE provider = 'tesseract') AS fallback, count(*) FILTER (WHERE processing_status = 'failed') AS failed,
 count(*) FILTER (WHERE processing_status IN ('ready','confirmed','completed')) AS ready, count(*) FILTER (WHERE processing_status = 'needs_review') AS needs_review,
 round(CAST(sum(ms) AS DOUBLE) / count(ms), 1) AS average_processing_ms FROM meta""", DOCS, META))
def _(spark, sf):
    return B.ocr_metrics(with_metadata(V.documents(spark, sf)))


@query("fn29_nested_json_access", sql("SELECT document_id, nullif(provider, '') AS provider, CASE WHEN source_file_type = 'pdf' THEN false ELSE retry END AS retry FROM meta WHERE source_file_type IN ('pdf', 'jpg')", DOCS, META))
def _(spark, sf):
    docs = with_metadata(V.documents(spark, sf)).filter("source_file_type IN ('pdf', 'jpg')")
    m = docs.select("document_id", B.provider_metadata().alias("m"))
    return m.select("document_id", F.coalesce("m.ocr_provider_succeeded", "m.ocr_engine").alias("provider"), F.coalesce("m.retry_used", F.lit(False)).alias("retry"))


@query("ag15_master_stats", sql("""SELECT count(*) AS total_items, count(*) FILTER (WHERE active) AS active_items, count(*) FILTER (WHERE NOT active) AS inactive_items,
 (SELECT count(*) FILTER (WHERE active) FROM alias) AS alias_count FROM master""", MASTER))
def _(spark, sf):
    return B.master_stats(V.item_master(spark, sf), V.item_alias(spark, sf))


@query("ag15_master_times", sql("""SELECT count(*) AS total_items, count(*) FILTER (WHERE active) AS active_items, count(*) FILTER (WHERE NOT active) AS inactive_items, (SELECT count(*) FILTER (WHERE active) FROM alias) AS alias_count,
 strftime(TIMESTAMP '2024-01-01' + max(item_id) * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS last_uploaded_at, strftime(TIMESTAMP '2024-02-01' + max(item_id % 100) * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS last_updated_at FROM master""", MASTER))
def _(spark, sf):
    stamped = V.item_master(spark, sf).selectExpr("*", "timestampadd(MINUTE, item_id, timestamp'2024-01-01') AS last_uploaded_at", "timestampadd(MINUTE, item_id % 100, timestamp'2024-02-01') AS updated_at")
    return B.master_stats(stamped, V.item_alias(spark, sf))


def _page(name, body, **kw):
    @query(name, d(body))
    def _(spark, sf):
        return B.page(V.documents(spark, sf), **kw).select("document_id", F.col(kw["sort_by"]).cast("string").alias("k"))


_page("st01_page_desc", "SELECT document_id, CAST(extracted_amount AS VARCHAR) AS k FROM docs ORDER BY extracted_amount DESC NULLS FIRST, document_id LIMIT 25 OFFSET 50",
      sort_by="extracted_amount", order="desc", page=3)
_page("st01_page_asc", "SELECT document_id, CAST(extracted_date AS VARCHAR) AS k FROM docs ORDER BY extracted_date ASC NULLS LAST, document_id LIMIT 25 OFFSET 25",
      sort_by="extracted_date", order="asc", page=2)


@query("st01_indexed_page", d("SELECT document_id, CAST(extracted_amount AS VARCHAR) AS k FROM docs ORDER BY extracted_amount DESC NULLS FIRST, document_id LIMIT 25 OFFSET 10000"))
def _(spark, sf):
    """Page 401 through an order index."""
    path = f"{checkpoint_dir(spark)}/order-{uuid4().hex}"
    docs = V.documents(spark, sf).select("document_id", "extracted_amount")
    write_order_index(docs, path, "extracted_amount", rows_per_part=4096)
    return indexed_page(spark, path, docs.schema, "extracted_amount", page=401).select("document_id", F.col("extracted_amount").cast("string").alias("k"))


@query("st01_page_after", d("SELECT document_id, CAST(extracted_amount AS VARCHAR) AS k FROM docs WHERE extracted_amount < 150000 OR (extracted_amount = 150000 AND document_id > 0) ORDER BY extracted_amount DESC NULLS FIRST, document_id LIMIT 25"))
def _(spark, sf):
    return page_after(V.documents(spark, sf), "extracted_amount", "desc", Decimal(150000), 0).select("document_id", F.col("extracted_amount").cast("string").alias("k"))


@query("st01_total", d("SELECT count(*) AS total FROM docs WHERE processing_status = 'ready'"))
def _(spark, sf):
    return B.total(B.list_documents(V.documents(spark, sf), processing_status="ready"))


@query("st02_recent", d("""(SELECT 'recent' AS list, document_id FROM docs ORDER BY created_at DESC, document_id LIMIT 5)
 UNION ALL (SELECT 'updated', document_id FROM docs ORDER BY updated_at DESC, document_id LIMIT 8)
 UNION ALL (SELECT 'review', document_id FROM docs WHERE processing_status = 'needs_review' ORDER BY updated_at DESC, document_id LIMIT 5)
 UNION ALL (SELECT 'pinned', document_id FROM docs WHERE is_favorite ORDER BY updated_at DESC, document_id LIMIT 6)"""))
def _(spark, sf):
    docs = V.documents(spark, sf)
    tag = lambda df, name: df.select(F.lit(name).alias("list"), "document_id")
    return (
        tag(B.recent(docs, 5, "created_at"), "recent").unionByName(tag(B.recent(docs, 8), "updated"))
        .unionByName(tag(B.recent(docs, 5, where=F.col("processing_status") == "needs_review"), "review"))
        .unionByName(tag(B.recent(docs, 6, where=F.col("is_favorite")), "pinned"))
    )


@query("st05_list_master", sql("SELECT internal_item_code, item_name FROM master WHERE (internal_item_code ILIKE '%red%' OR item_name ILIKE '%red%' OR spec ILIKE '%red%') AND category = 'PROMO' AND active ORDER BY internal_item_code LIMIT 5 OFFSET 0", MASTER))
def _(spark, sf):
    rows = B.list_master(V.item_master(spark, sf), "red", "PROMO", True)
    return B.page(rows, "internal_item_code", "asc", 1, 5, tie="item_id").select("internal_item_code", "item_name")


@query("jn14_bulk_status", d("""SELECT user_id AS document_id, min(event_id) AS pos, any_value(processing_status) AS processing_status, any_value(processing_status) IS NULL AS missing
 FROM events LEFT JOIN docs ON user_id = document_id GROUP BY user_id"""))
def _(spark, sf):
    ids = V.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("document_id"))
    return B.bulk_status(V.documents(spark, sf), ids)
