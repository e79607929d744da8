"""Source, provenance and streaming queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from bizdocs.catalog.matching import dict_alias, dict_entries, feedback
from bizdocs.catalog.matching import ENT, FB
from bizdocs.catalog.quality import STATS_SQL
from bizdocs.catalog.registry import query
from bizdocs.catalog.texts import _PLAIN
from bizdocs.catalog.quality import LINES_SQL
from bizdocs.catalog.twins import DOCS, LNP, sql
from bizdocs.functions.lines import line_stats
from bizdocs.operators import provenance as P
from bizdocs.session import checkpoint_dir
from bizdocs.sources import readers as S
from bizdocs.sources import views as V
from bizdocs.streaming import jobs as J
from bizdocs.streaming import learning as L


def uploaded(spark, sf) -> DataFrame:
    """The part table as an uploaded sheet: padded headers, some rows without a name or code."""
    return V.table(spark, sf, "part").selectExpr(
        "CASE WHEN p_size = 7 THEN ' ' ELSE concat(' IT-', p_partkey, ' ') END AS ` internal_item_code`", "CASE WHEN p_size <> 8 THEN p_name END AS `item_name `", "concat(p_size, ' × ', p_brand) AS spec",
        "concat('₩', format_number(p_retailprice, 2)) AS standard_price", "CASE WHEN p_size = 9 THEN '아니오' WHEN p_size = 10 THEN '' ELSE 'Y' END AS active", "concat(p_name, '|', p_type, '; ;') AS aliases", "'steel' AS material")


@query("sc02_item_master_rows", """SELECT 'IT-' || p_partkey AS internal_item_code, p_name AS item_name, CAST(p_retailprice AS DOUBLE) AS standard_price, p_size <> 9 AS active, p_name || '|' || p_type AS aliases FROM part WHERE p_size NOT IN (7, 8)""")
def _(spark, sf):
    rows, _ = S.item_master_rows(uploaded(spark, sf))
    return rows.select("internal_item_code", "item_name", "standard_price", "active", "aliases")


@query("sc02_item_master_errors", "SELECT count(*) AS errors FROM part WHERE p_size IN (7, 8)")
def _(spark, sf):
    _, errors = S.item_master_rows(uploaded(spark, sf))
    return errors.agg(F.count("error").alias("errors"))


def files(spark, sf) -> DataFrame:
    """Pages and conversations as stored files."""
    pages = V.table(spark, sf, "pages").select(F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    talk = V.table(spark, sf, "conversations").select(F.concat_ws("", F.lit("/in/"), "conv_id", F.lit("-"), "turn", F.lit(".TXT")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return pages.unionByName(talk)


@query("sc03_text_corpus", sql(f"""SELECT '/in/' || page_id || '.html' AS path, 'html_text_extract' AS extraction_method, array_to_string({LINES_SQL.format(t='t')}, chr(10)) AS normalized_text, octet_length(encode(html)) AS file_size_bytes FROM p
 UNION ALL SELECT '/in/' || conv_id || '-' || turn || '.TXT', 'txt_direct', array_to_string({LINES_SQL.format(t='text')}, chr(10)), octet_length(encode(text)) FROM conversations""", f"p AS (SELECT page_id, html, {_PLAIN} AS t FROM pages)"))
def _(spark, sf):
    return S.text_corpus(files(spark, sf)).select("path", "extraction_method", "normalized_text", "file_size_bytes")


KIND = "doc_id % 10"


@query("sc04_classify_files", f"""SELECT doc_id, CASE {KIND} WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN 'office' WHEN 5 THEN 'tabular' WHEN 6 THEN 'markup' WHEN 7 THEN 'partial' WHEN 8 THEN 'unknown' ELSE 'text' END AS family,
 CASE {KIND} WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'tiff' WHEN 4 THEN 'xlsx' WHEN 5 THEN 'csv' WHEN 6 THEN 'xml' WHEN 7 THEN 'rtf' WHEN 8 THEN 'xyz' ELSE 'md' END AS extension, {KIND} <> 8 AS supported FROM documents""")
def _(spark, sf):
    docs = V.table(spark, sf, "documents").selectExpr(
        "doc_id", f"concat('/in/a.b/', doc_id, CASE {KIND} WHEN 0 THEN '.bin' WHEN 1 THEN '.jpg' WHEN 2 THEN '' WHEN 3 THEN '.txt' WHEN 4 THEN '.xlsx' WHEN 5 THEN '.CSV' WHEN 6 THEN '.xml' WHEN 7 THEN '.rtf' WHEN 8 THEN '.xyz' ELSE '.md' END) AS path",
        f"""concat(unhex(CASE {KIND} WHEN 0 THEN '255044462D' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '52494646AAAAAAAA57454250' WHEN 3 THEN '49492A00' WHEN 4 THEN '504B0304786C2F' ELSE '20' END), encode(text, 'UTF-8')) AS content""")
    return S.classify_files(docs).select("doc_id", "family", "extension", "supported")


@query("sc05_expectations", sql("""SELECT original_filename AS filename, CASE document_type WHEN 'invoice' THEN 'invoice' WHEN 'delivery_note' THEN 'delivery_note' WHEN 'quotation' THEN 'general_document' ELSE document_type END AS document_type,
 document_number, coalesce(vendor_name, merchant_name) AS vendor, CAST(extracted_date AS VARCHAR) AS issue_date, CAST(extracted_amount AS VARCHAR) AS total_amount, document_type IN ('delivery_note', 'quotation') AS no_price_document FROM docs""", DOCS))
def _(spark, sf):
    raw = V.documents(spark, sf).selectExpr(
        "original_filename AS filename", "CASE document_type WHEN 'invoice' THEN 'Tax_Invoice' WHEN 'quotation' THEN 'internal_transfer ' ELSE document_type END AS document_type", "'' AS document_no",
        "CASE WHEN document_type = 'invoice' THEN document_number END AS invoice_no", "CASE WHEN document_type <> 'invoice' THEN document_number END AS po_no", "vendor_name AS supplier", "merchant_name AS store",
        "CAST(extracted_date AS STRING) AS date", "CAST(extracted_amount AS STRING) AS grand_total", "'4' AS line_items")
    return S.expectations(raw).select("filename", "document_type", "document_number", "vendor", "issue_date", "total_amount", "no_price_document")


@query("sc06_expand_truth_keys", """SELECT truth_key, max(c_custkey) AS c_custkey FROM (SELECT c_custkey, unnest(['set_real_' || lower(c_mktsegment) || '.pdf', 'set_photo_' || lower(c_mktsegment) || '.pdf']) AS truth_key FROM customer WHERE c_nationkey < 10
 UNION ALL SELECT c_custkey, lower(c_mktsegment) || '.pdf' FROM customer WHERE c_nationkey >= 10) GROUP BY truth_key""")
def _(spark, sf):
    files_ = V.table(spark, sf, "customer").selectExpr("c_custkey", "c_custkey AS pos", "concat('/t/', CASE WHEN c_nationkey < 10 THEN 'Set_real_' ELSE '07_photo_' END, c_mktsegment, '.PDF') AS file")
    return S.expand_truth_keys(files_).select("truth_key", "c_custkey")


@query("pr10_field_provenance", sql("""SELECT field, source_type, visible, count(*) AS n FROM (
 SELECT f AS field, CASE WHEN f = 'vendor_name' AND currency = 'USD' THEN 'manual_confirmed' WHEN extraction_method = 'pdf_text' THEN 'text_layer_source' WHEN extraction_method = 'image_ocr' THEN 'fallback_source' ELSE 'parser_source' END AS source_type, true AS visible
  FROM (SELECT *, unnest(['document_number','vendor_name','customer_name','due_date','currency','subtotal','tax','extracted_amount']) AS f, unnest([document_number, vendor_name, nullif(customer_name, ''), CAST(due_date AS VARCHAR), currency, CAST(subtotal AS VARCHAR), CAST(tax AS VARCHAR), CAST(extracted_amount AS VARCHAR)]) AS v FROM docs) WHERE v IS NOT NULL
 UNION ALL SELECT f, CASE WHEN extraction_method = 'pdf_text' THEN 'text_layer_source' WHEN extraction_method = 'image_ocr' THEN 'fallback_source' ELSE 'parser_source' END, NOT (f = 'tax_amount' AND currency IS NULL)
  FROM (SELECT *, unnest(['item_name','quantity','tax_amount','line_total']) AS f, unnest([item_name, CAST(quantity AS VARCHAR), CAST(tax_amount AS VARCHAR), CAST(line_total AS VARCHAR)]) AS v FROM lnp JOIN docs USING (document_id)) WHERE v IS NOT NULL) GROUP BY ALL""", DOCS, LNP))
def _(spark, sf):
    docs = V.documents(spark, sf).withColumns({
        "field_sources": F.expr("CASE WHEN currency = 'USD' THEN map('vendor_name', 'manual_edit') ELSE map('x', 'y') END"),
        "hidden_columns": F.expr("CASE WHEN currency IS NULL THEN array('tax_amount') ELSE array() END"), "quality_flags": F.array().cast("array<string>")}).drop("issue_date")
    rows = P.field_provenance(docs, V.lines(spark, sf, with_part=True).select("document_id", "line_index", "item_name", "quantity", "tax_amount", "line_total"))
    return rows.groupBy("field", "source_type", "visible").agg(F.count("*").alias("n"))


# --- streams -----------------------------------------------------------------

def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def events(spark, sf) -> DataFrame:
    return V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark, sf) -> DataFrame:
    schema = V.table(spark, sf, "events").schema
    return J.read_stream(spark, f"{sf}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("sr01_stream_ingest", sql("SELECT doc_id, line_count::BIGINT AS line_count, noise_ratio FROM tst", STATS_SQL))
def _(spark, sf):
    root = scratch(spark, "ingest")
    source = J.read_stream(spark, f"{sf}/documents*.parquet", V.table(spark, sf, "documents").schema)
    job = J.stream_ingest(source, lambda df: df.select("doc_id", line_stats("text").alias("s")).select("doc_id", "s.line_count", "s.noise_ratio"), f"{root}/out", f"{root}/ckpt")
    job.awaitTermination()
    return spark.read.parquet(f"{root}/out")


LATEST = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


@query("sr02_latest_status", LATEST)
def _(spark, sf):
    return J.latest_status(events(spark, sf), ["user_id"]).select("user_id", "event_id", "event_type")


@query("sr02_stream_latest", LATEST)
def _(spark, sf):
    root = scratch(spark, "latest")
    J.stream_latest(event_stream(spark, sf), ["user_id"], f"{root}/table", f"{root}/ckpt").awaitTermination()
    return J.read_latest(spark, f"{root}/table", ["user_id"]).select("user_id", "event_id", "event_type")


@query("sr03_stage_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bucket_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return J.stage_counts(events(spark, sf))


@query("sr03_stream_stage_counts")
def _(spark, sf):
    root = scratch(spark, "stages")
    job = J.stage_counts(event_stream(spark, sf)).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("sr04_dedupe_events", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    twice = events(spark, sf).unionByName(events(spark, sf))
    return J.dedupe_events(twice).select("event_id", "event_type")


@query("sr04_stream_dedupe", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    root = scratch(spark, "dedupe")
    twice = event_stream(spark, sf).unionByName(event_stream(spark, sf))
    job = J.dedupe_events(twice).select("event_id", "event_type").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def stream_learned(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Feedback arrives in four files, one per micro-batch."""
    root = scratch(spark, "learn")
    feedback(spark, sf).repartition(4).write.parquet(f"{root}/in")
    source = J.read_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, files_per_trigger=1)
    L.stream_learn(source, dict_entries(spark, sf), dict_alias(spark, sf), f"{root}/out", f"{root}/ckpt").awaitTermination()
    return L.learned(dict_entries(spark, sf), dict_alias(spark, sf), L.read_changes(spark, f"{root}/out"))


@query("sr05_stream_learn", sql("""SELECT dictionary_type, canonical_value, bool_or(active) AS active FROM (SELECT dictionary_type, canonical_value, active FROM ent UNION ALL SELECT DISTINCT dictionary_type, canonical_value, true FROM fb) GROUP BY ALL""", DOCS, ENT, FB))
def _(spark, sf):
    entries, _ = stream_learned(spark, sf)
    return entries.select("dictionary_type", "canonical_value", "active")


@query("sr05_stream_aliases", sql("""SELECT alias_value, active FROM eal UNION ALL SELECT alias_value, true FROM (SELECT DISTINCT dictionary_type, canonical_value, alias_value FROM fb)""", DOCS, ENT, FB))
def _(spark, sf):
    _, aliases = stream_learned(spark, sf)
    return aliases.select("alias_value", "active")
