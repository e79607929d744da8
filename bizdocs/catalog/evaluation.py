"""Merging, run evaluation and upsert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bizdocs.catalog.functions import sql_item
from bizdocs.catalog.lines import lst
from bizdocs.catalog.quality import ISS_VIEWS, issues
from bizdocs.catalog.registry import query
from bizdocs.catalog.twins import DOCS, LNP, LNS, MASTER, sql
from bizdocs.operators import evaluate as E
from bizdocs.operators import merge as G
from bizdocs.operators import upsert as U
from bizdocs.sources import views as V
from bizdocs.sources.readers import item_master_rows


# --- two readings of one document --------------------------------------------

def second_headers(spark, sf) -> DataFrame:
    """A second reading: other currency names, shifted dates, rounded amounts, some headers absent."""
    return V.documents(spark, sf).filter("source_file_type IS NOT NULL").withColumns({
        "vendor_name": F.expr("CASE WHEN currency = 'USD' THEN concat(vendor_name, ' 미확인') WHEN tax IS NULL THEN 'OTHER-CO' ELSE upper(replace(coalesce(vendor_name, 'found late'), ' ', '_')) END"),
        "issue_date": F.expr("CASE WHEN currency = 'USD' THEN date_add(extracted_date, 1) ELSE extracted_date END"),
        "extracted_amount": F.expr("CASE WHEN tax IS NULL THEN CAST(round(extracted_amount, 0) AS DECIMAL(18,2)) ELSE extracted_amount END")})


QG12 = """s AS (SELECT document_id, CASE WHEN currency = 'USD' THEN NULL WHEN tax IS NULL THEN 'OTHER-CO' ELSE upper(replace(coalesce(vendor_name, 'found late'), ' ', '_')) END AS sv,
  CASE WHEN currency = 'USD' THEN CAST(extracted_date + INTERVAL 1 DAY AS DATE) ELSE extracted_date END AS sd, CASE WHEN tax IS NULL THEN CAST(round(extracted_amount, 0) AS DECIMAL(18,2)) ELSE extracted_amount END AS sa FROM docs WHERE source_file_type IS NOT NULL),
m AS (SELECT document_id, vendor_name AS pv, issue_date AS pd, extracted_amount AS pa, sv, sd, sa, regexp_replace(lower(vendor_name), '[\\s_/-]+', '', 'g') <> regexp_replace(lower(sv), '[\\s_/-]+', '', 'g') AS cv FROM docs LEFT JOIN s USING (document_id))"""


@query("qg12_merge_sources", sql("SELECT document_id, coalesce(pv, sv) AS vendor_name, CAST(coalesce(pd, sd) AS VARCHAR) AS issue_date, CAST(coalesce(pa, sa) AS DOUBLE) AS extracted_amount FROM m", DOCS, QG12))
def _(spark, sf):
    return G.merge_sources(V.documents(spark, sf), second_headers(spark, sf), ["vendor_name"], ["issue_date"], ["extracted_amount"]).drop("conflicts")


@query("qg12_merge_conflicts", sql("""SELECT document_id, 'vendor_name_conflict' AS code, 'vendor_name' AS field FROM m WHERE cv UNION ALL SELECT document_id, 'issue_date_conflict', 'issue_date' FROM m WHERE pd <> sd
 UNION ALL SELECT document_id, 'amount_conflict', 'extracted_amount' FROM m WHERE pa <> sa""", DOCS, QG12))
def _(spark, sf):
    merged = G.merge_sources(V.documents(spark, sf), second_headers(spark, sf), ["vendor_name"], ["issue_date"], ["extracted_amount"])
    return G.conflict_rows(merged).select("document_id", "code", "field")


def second_lines(spark, sf) -> DataFrame:
    """A second reading of the lines: codes lost for flag R, longer names, other quantities, flag-N EA rows missed."""
    return V.lines(spark, sf, with_part=True).filter("NOT (return_flag = 'N' AND unit = 'EA')").withColumns({
        "item_code": F.expr("CASE WHEN return_flag <> 'R' THEN lower(item_code) END"), "item_name": F.concat("item_name", F.lit(" (재)")),
        "quantity": F.expr("CASE WHEN line_no = 4 THEN CAST(quantity + 1 AS DECIMAL(18,2)) ELSE quantity END")})


@query("jn11_pair_items")
def _(spark, sf):
    return G.pair_items(V.lines(spark, sf, with_part=True), second_lines(spark, sf))


@query("qg12_merge_lines")
def _(spark, sf):
    first, second = V.lines(spark, sf, with_part=True), second_lines(spark, sf)
    return G.merge_lines(first, second, G.pair_items(first, second)).select("document_id", "line_index", "secondary_index", "conflict_fields", "quantity", "unit_price")


def posing(spark, sf) -> DataFrame:
    """Secondary lines, some of which carry a code as their name or lost their amounts."""
    return second_lines(spark, sf).withColumns({
        "item_name": F.expr("CASE WHEN part_key % 5 = 0 THEN upper(item_code) WHEN part_key % 5 = 1 THEN 'unheard of' ELSE item_name END"),
        **{c: F.expr(f"CASE WHEN part_key % 5 <> 2 THEN {c} END") for c in ("unit_price", "supply_amount", "tax_amount", "line_total")}})


LEFT = """sec AS (SELECT document_id, line_index, part_key, CASE WHEN part_key % 5 = 0 THEN CASE WHEN return_flag <> 'R' THEN upper(item_code) END WHEN part_key % 5 = 1 THEN 'unheard of' ELSE item_name || ' (재)' END AS item_name, specification,
   CASE WHEN line_no = 4 THEN quantity + 1 ELSE quantity END AS quantity, CASE WHEN part_key % 5 <> 2 THEN unit_price END AS unit_price, CASE WHEN part_key % 5 <> 2 THEN supply_amount END AS supply_amount,
   CASE WHEN part_key % 5 <> 2 THEN tax_amount END AS tax_amount, CASE WHEN part_key % 5 <> 2 THEN line_total END AS line_total FROM lnp WHERE NOT (return_flag = 'N' AND unit = 'EA') AND NOT (unit = 'BOX' AND line_no <= 2)),
j AS (SELECT s.document_id, s.line_index, bool_or(s.item_name = p.item_code OR (regexp_replace(lower(s.item_name), '[\\s_/-]+', '', 'g') <> '' AND regexp_replace(lower(p.item_name), '[\\s_/-]+', '', 'g') <> ''
   AND (contains(regexp_replace(lower(s.item_name), '[\\s_/-]+', '', 'g'), regexp_replace(lower(p.item_name), '[\\s_/-]+', '', 'g')) OR contains(regexp_replace(lower(p.item_name), '[\\s_/-]+', '', 'g'), regexp_replace(lower(s.item_name), '[\\s_/-]+', '', 'g')))
   AND (s.specification IS NULL OR p.specification IS NULL OR contains(s.specification, p.specification) OR contains(p.specification, s.specification))
   AND ((coalesce(s.quantity = p.quantity, true) AND coalesce(s.unit_price = p.unit_price, true) AND coalesce(s.supply_amount = p.supply_amount, true) AND coalesce(s.tax_amount = p.tax_amount, true) AND coalesce(s.line_total = p.line_total, true)
     AND (CASE WHEN s.quantity = p.quantity THEN 1 ELSE 0 END + CASE WHEN s.unit_price = p.unit_price THEN 1 ELSE 0 END + CASE WHEN s.supply_amount = p.supply_amount THEN 1 ELSE 0 END + CASE WHEN s.tax_amount = p.tax_amount THEN 1 ELSE 0 END + CASE WHEN s.line_total = p.line_total THEN 1 ELSE 0 END) >= 2)
    OR (s.quantity = p.quantity AND s.unit_price IS NULL AND s.line_total IS NULL)))) AS dup FROM sec s JOIN lnp p USING (document_id) GROUP BY ALL)"""


@query("jn18_secondary_leftovers", sql("SELECT document_id, part_key, CASE WHEN coalesce(dup, false) THEN 'duplicate_sku_as_item_name' ELSE 'ai_line_item_unmatched' END AS verdict FROM sec JOIN j USING (document_id, line_index)", LNP, LEFT))
def _(spark, sf):
    first, second = V.lines(spark, sf, with_part=True), posing(spark, sf)
    pairs = second.filter("unit = 'BOX' AND line_no <= 2").select("document_id", "line_index", F.col("line_index").alias("secondary_index"))
    return G.secondary_leftovers(first, second, pairs).join(second.select("document_id", "line_index", "part_key"), ["document_id", "line_index"]).select("document_id", "part_key", "verdict")


def actual_lines(spark, sf) -> DataFrame:
    return V.lines(spark, sf, with_part=True).filter("return_flag IN ('A', 'N')").withColumns({
        "item_code": F.expr("CASE WHEN unit = 'EA' THEN lower(replace(item_code, '-', '')) END"), "document_item_code": F.lit(None).cast("string"),
        "item_name": F.expr("concat(upper(item_name), ' X')")})


ACT = """act AS (SELECT * REPLACE (CASE WHEN unit = 'EA' THEN lower(replace(item_code, '-', '')) END AS item_code, CAST(NULL AS VARCHAR) AS document_item_code, upper(item_name) || ' X' AS item_name) FROM lnp WHERE return_flag IN ('A', 'N'))"""
ALIGN = f"""hc AS (SELECT e.document_id, e.line_index, min(a.line_index) AS ai FROM lnp e JOIN act a USING (document_id) WHERE a.item_code IS NOT NULL AND list_contains([{sql_item('e.item_code')}, {sql_item('e.document_item_code')}], {sql_item('a.item_code')}) GROUP BY ALL),
hn AS (SELECT e.document_id, e.line_index, min(a.line_index) AS ai FROM lnp e JOIN act a USING (document_id) WHERE e.item_name IS NOT NULL AND (contains(lower(coalesce(a.item_name, '')), lower(e.item_name)) OR contains(lower(e.item_name), lower(coalesce(a.item_name, ''))) OR {sql_item('e.item_name')} = {sql_item('a.item_name')}) GROUP BY ALL),
ali AS (SELECT l.document_id, l.line_index, l.line_no, l.part_key, coalesce(hc.ai, hn.ai) AS ai, CASE WHEN hc.ai IS NOT NULL THEN 'code' WHEN hn.ai IS NOT NULL THEN 'name' END AS tier FROM lnp l LEFT JOIN hc USING (document_id, line_index) LEFT JOIN hn USING (document_id, line_index))"""


@query("jn10_align_items", sql("SELECT ali.document_id, ali.line_no, ali.part_key, act.part_key AS actual_part, tier FROM ali LEFT JOIN act ON act.document_id = ali.document_id AND act.line_index = ali.ai", LNP, ACT, ALIGN))
def _(spark, sf):
    exp, act = V.lines(spark, sf, with_part=True), actual_lines(spark, sf)
    pairs = G.align_items(exp, act).join(act.select("document_id", F.col("line_index").alias("actual_index"), F.col("part_key").alias("actual_part")), ["document_id", "actual_index"], "left")
    return exp.select("document_id", "line_index", "line_no", "part_key").join(pairs, ["document_id", "line_index"]).select("document_id", "line_no", "part_key", "actual_part", "tier")


def layout_candidates(spark, sf) -> DataFrame:
    """Rows read again from the page layout: typos, cut names, missing amounts, other quantities."""
    return V.lines(spark, sf, with_part=True).filter("return_flag <> 'R'").withColumns({
        "line_index": F.col("line_index"), "specification": F.lit(None).cast("string"), "document_item_code": F.lit(None).cast("string"), "item_code": F.expr("CASE WHEN unit = 'BOX' THEN item_code END"),
        "item_name": F.expr("CASE part_key % 4 WHEN 0 THEN concat(substring(item_name, 1, 3), substring(item_name, 5)) WHEN 1 THEN substring(item_name, 1, 12) WHEN 2 THEN 'zz-qq-yy' ELSE item_name END"),
        "quantity": F.expr("CASE WHEN line_no > 4 THEN CAST(quantity + 1 AS DECIMAL(18,2)) ELSE quantity END"),
        **{c: F.expr(f"CASE WHEN line_no IN (1, 2, 5) THEN {c} END") for c in ("unit_price", "supply_amount", "tax_amount", "line_total")},
        "review_flags": F.expr("CASE WHEN line_no = 6 THEN array('row_boundary_uncertain') ELSE array() END")})


_N = "regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
DUP = f"""cnd AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS specification, CAST(NULL AS VARCHAR) AS document_item_code, CASE WHEN unit = 'BOX' THEN item_code END AS item_code,
   CASE part_key % 4 WHEN 0 THEN substring(item_name, 1, 3) || substring(item_name, 5) WHEN 1 THEN substring(item_name, 1, 12) WHEN 2 THEN 'zz-qq-yy' ELSE item_name END AS item_name,
   CASE WHEN line_no > 4 THEN quantity + 1 ELSE quantity END AS quantity, CASE WHEN line_no IN (1,2,5) THEN unit_price END AS unit_price, CASE WHEN line_no IN (1,2,5) THEN supply_amount END AS supply_amount,
   CASE WHEN line_no IN (1,2,5) THEN tax_amount END AS tax_amount, CASE WHEN line_no IN (1,2,5) THEN line_total END AS line_total, CASE WHEN line_no = 6 THEN ['row_boundary_uncertain'] ELSE CAST([] AS VARCHAR[]) END AS review_flags) FROM lnp WHERE return_flag <> 'R'),
cn AS (SELECT document_id, line_index, {_N.format('item_name')} AS n, regexp_replace(lower(item_code), '[^0-9a-z가-힣]+', '', 'g') AS c, unit, quantity, unit_price, supply_amount, tax_amount, line_total, review_flags FROM cnd),
ln AS (SELECT document_id, {_N.format('item_name')} AS n, list_filter([regexp_replace(lower(item_code), '[^0-9a-z가-힣]+', '', 'g'), regexp_replace(lower(document_item_code), '[^0-9a-z가-힣]+', '', 'g'), regexp_replace(lower(specification), '[^0-9a-z가-힣]+', '', 'g')], lambda x: x IS NOT NULL) AS cs,
   unit, quantity, unit_price, supply_amount, tax_amount, line_total FROM lnp),
jj AS (SELECT a.document_id, a.line_index, a.*, b.unit AS bu, b.quantity AS bq, b.unit_price AS bp, b.line_total AS bt, coalesce(list_contains(b.cs, a.c), false) AS code, a.n <> '' AND a.n = b.n AS same,
   length(a.n) >= 4 AND length(b.n) >= 4 AND (contains(a.n, b.n) OR contains(b.n, a.n) OR (least(length(a.n), length(b.n)) >= 8 AND a.n[:8] = b.n[:8])) AS near,
   length(a.n) >= 5 AND length(b.n) >= 5 AND abs(length(a.n) - length(b.n)) <= 2 AND levenshtein(translate(a.n, '스테인리철판', 'ABCDEF'), translate(b.n, '스테인리철판', 'ABCDEF')) <= 2 AS typo,
   a.n <> '' AND b.n <> '' AND (contains(a.n, b.n) OR contains(b.n, a.n)) AND least(length(a.n), length(b.n)) >= 4 AS over_,
   coalesce(a.quantity = b.quantity, true) AND coalesce(a.unit_price = b.unit_price, true) AND coalesce(a.supply_amount = b.supply_amount, true) AND coalesce(a.tax_amount = b.tax_amount, true) AND coalesce(a.line_total = b.line_total, true)
    AND (CASE WHEN a.quantity = b.quantity THEN 1 ELSE 0 END + CASE WHEN a.unit_price = b.unit_price THEN 1 ELSE 0 END + CASE WHEN a.supply_amount = b.supply_amount THEN 1 ELSE 0 END + CASE WHEN a.tax_amount = b.tax_amount THEN 1 ELSE 0 END + CASE WHEN a.line_total = b.line_total THEN 1 ELSE 0 END) >= 2 AS amt
   FROM cn a JOIN ln b USING (document_id)),
dup AS (SELECT DISTINCT document_id, line_index FROM jj WHERE (code OR same OR near OR typo OR over_) AND (
   ((same OR near OR typo OR over_) AND (len(review_flags) > 0 OR amt)) OR ((same OR near) AND coalesce(quantity = bq, true) AND unit_price IS NULL AND line_total IS NULL)
   OR (coalesce(quantity = bq, code) AND coalesce(unit_price = bp, true) AND coalesce(line_total = bt, true) AND unit = bu AND (code OR same OR near OR ((typo OR over_) AND (unit_price IS NOT NULL OR line_total IS NOT NULL))))))"""


@query("jn12_drop_duplicate_candidates", sql("SELECT document_id, line_no, part_key FROM cnd WHERE (document_id, line_index) NOT IN (SELECT (document_id, line_index) FROM dup)", LNP, DUP))
def _(spark, sf):
    return G.drop_duplicate_candidates(layout_candidates(spark, sf), V.lines(spark, sf, with_part=True)).select("document_id", "line_no", "part_key")


# --- evaluation --------------------------------------------------------------

def run_issues(spark, sf) -> DataFrame:
    return issues(spark, sf).select("document_id", "code", F.when(F.col("severity") == "warning", "warn").otherwise("fail").alias("severity"))


RUN = """ri AS (SELECT document_id, code, CASE WHEN severity = 'warning' THEN 'warn' ELSE 'fail' END AS severity FROM iss),
sco AS (SELECT document_id, count(*) FILTER (WHERE severity = 'fail') AS fails, count(*) FILTER (WHERE severity = 'warn') AS warns, greatest(0, 100 - 18 * count(*) FILTER (WHERE severity = 'fail') - 7 * count(*) FILTER (WHERE severity = 'warn')) AS score
  FROM docs LEFT JOIN ri USING (document_id) GROUP BY document_id)"""
RUN_VIEWS = (*ISS_VIEWS, RUN)


@query("ag11_score_report", sql("SELECT document_id, fails, warns, CAST(score AS BIGINT) AS score FROM sco", *RUN_VIEWS))
def _(spark, sf):
    return E.score_report(run_issues(spark, sf), V.documents(spark, sf))


@query("ag11_average_score", sql("SELECT count(*) AS documents_total, round(avg(score), 2) AS average_score, CAST(sum(fails) AS BIGINT) AS fail, CAST(sum(warns) AS BIGINT) AS warn FROM sco", *RUN_VIEWS))
def _(spark, sf):
    return E.average_score(E.score_report(run_issues(spark, sf), V.documents(spark, sf)))


@query("ag11_issue_counts", sql("SELECT code, count(*) AS n FROM ri GROUP BY code", *RUN_VIEWS))
def _(spark, sf):
    return E.issue_counts(run_issues(spark, sf))


@query("st04_worst_documents", sql("SELECT document_id, CAST(score AS BIGINT) AS score FROM sco ORDER BY fails + warns DESC, score, document_id LIMIT 5", *RUN_VIEWS))
def _(spark, sf):
    return E.worst(E.score_report(run_issues(spark, sf), V.documents(spark, sf))).select("document_id", "score")


@query("ag12_case_summary", sql("""SELECT 'total' AS part, 'cases' AS key, count(*) AS value FROM sco UNION ALL SELECT 'total', 'failures', CAST(sum(fails) AS BIGINT) FROM sco UNION ALL SELECT 'total', 'warnings', CAST(sum(warns) AS BIGINT) FROM sco
 UNION ALL SELECT 'code', code, count(*) FROM ri GROUP BY code UNION ALL (SELECT 'worst', CAST(document_id AS VARCHAR), fails + warns FROM sco ORDER BY fails DESC, fails + warns DESC, document_id LIMIT 5)""", *RUN_VIEWS))
def _(spark, sf):
    return E.case_summary(run_issues(spark, sf), V.documents(spark, sf))


def warnings(spark, sf) -> DataFrame:
    """Comparison warnings derived from headers."""
    return V.documents(spark, sf).selectExpr("document_id", """explode(filter(array(
        CASE WHEN vendor_name IS NULL THEN named_struct('code', 'vendor_missing', 'expected_value', 'x') END, CASE WHEN due_date IS NULL THEN named_struct('code', 'due_date_missing', 'expected_value', document_number) END,
        CASE WHEN tax IS NULL THEN named_struct('code', 'no_price_expected_safe', 'expected_value', CAST(NULL AS STRING)) END, CASE WHEN currency = 'USD' THEN named_struct('code', 'no_price_line_amount_created', 'expected_value', 'x') END,
        CASE WHEN subtotal IS NULL THEN named_struct('code', 'document_type_taxonomy_alias', 'expected_value', 'x') END), x -> x IS NOT NULL)) AS w""").select("document_id", "w.*")


WRN = """wrn AS (SELECT document_id, 'vendor_missing' AS code, 'extraction_quality' AS g FROM docs WHERE vendor_name IS NULL UNION ALL SELECT document_id, 'due_date_missing', CASE WHEN document_number IS NULL THEN 'expected_unset' ELSE 'extraction_quality' END FROM docs WHERE due_date IS NULL
 UNION ALL SELECT document_id, 'no_price_expected_safe', 'safe_review' FROM docs WHERE tax IS NULL UNION ALL SELECT document_id, 'no_price_line_amount_created', 'extraction_quality' FROM docs WHERE currency = 'USD'
 UNION ALL SELECT document_id, 'document_type_taxonomy_alias', 'taxonomy_alias' FROM docs WHERE subtotal IS NULL)"""


@query("ag13_warn_groups", sql("SELECT g AS warn_group, count(*) AS n FROM wrn GROUP BY g", DOCS, WRN))
def _(spark, sf):
    return E.warn_groups(warnings(spark, sf))


@query("ag13_dangerous_failures", sql("SELECT document_id, code FROM wrn WHERE code = 'no_price_line_amount_created'", DOCS, WRN))
def _(spark, sf):
    return E.dangerous_failures(warnings(spark, sf)).select("document_id", "code")


@query("jn15_compare_runs", sql("""SELECT document_id, CAST(c - p AS BIGINT) AS delta, CASE WHEN c > p THEN 'improved' WHEN c < p THEN 'regressed' ELSE 'unchanged' END AS change FROM (
 SELECT document_id, score AS c, greatest(0, score - CASE WHEN document_type = 'invoice' THEN 7 WHEN document_type = 'quotation' THEN -3 ELSE 0 END) AS p FROM sco JOIN docs USING (document_id) WHERE processing_status <> 'failed')""", *RUN_VIEWS))
def _(spark, sf):
    current = E.score_report(run_issues(spark, sf), V.documents(spark, sf))
    kinds = V.documents(spark, sf).filter("processing_status <> 'failed'").select("document_id", "document_type")
    previous = current.join(kinds, "document_id").withColumn("score", F.expr("greatest(0, score - CASE document_type WHEN 'invoice' THEN 7 WHEN 'quotation' THEN -3 ELSE 0 END)"))
    return E.compare_runs(previous, current)


def truth(spark, sf) -> DataFrame:
    """Expected headers from the order rows themselves."""
    return V.documents(spark, sf).filter("source_file_type IS NOT NULL").selectExpr(
        "CAST(document_id AS STRING) AS truth_key", "CASE WHEN document_type = 'invoice' THEN 'tax_invoice' ELSE document_type END AS e_document_type",
        "document_number AS e_document_number", "currency AS e_currency", "CASE WHEN document_type <> 'delivery_note' THEN extracted_amount END AS e_total", "4 AS e_line_items")


def results(spark, sf) -> DataFrame:
    counts = V.lines(spark, sf).groupBy("document_id").agg(F.count("*").alias("line_items_count"))
    return V.documents(spark, sf).join(counts, "document_id", "left").selectExpr(
        "document_id", "CAST(document_id AS STRING) AS truth_key", "document_type", "CAST(NULL AS STRING) AS document_subtype", "taxonomy.document_profile AS document_profile", "taxonomy.document_profiles AS document_profiles",
        "CASE WHEN tax IS NULL THEN 'X' ELSE document_number END AS document_number", "coalesce(currency, 'KRW') AS currency",
        "CASE WHEN subtotal IS NULL THEN CAST(extracted_amount + 1 AS DECIMAL(18,2)) ELSE extracted_amount END AS extracted_amount", "line_items_count",
        "CASE WHEN is_favorite THEN 2 ELSE 0 END AS review_candidates_count", "0 AS vl_candidate_count", "0 AS row_signal_count", "review_required", "processing_status")


JN16 = """cmp AS (SELECT d.document_id, review_required, processing_status, source_file_type IS NOT NULL AS known, document_type = 'invoice' AS cov, tax IS NULL AND document_number IS NOT NULL AS numoff,
   document_type <> 'delivery_note' AND extracted_amount IS NOT NULL AND subtotal IS NULL AS totoff, document_type = 'delivery_note' AND extracted_amount IS NOT NULL AS noamt, list_contains(document_profiles, 'return_document') AS ret,
   coalesce(n, 0) < 4 AS few, is_favorite FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n FROM lns GROUP BY document_id) USING (document_id)),
ver AS (SELECT *, CASE WHEN known AND (numoff OR (totoff AND NOT ret) OR noamt) THEN 'FAIL' WHEN known AND (cov OR (totoff AND ret) OR few) THEN 'WARN' ELSE 'PASS' END AS status,
   CASE WHEN known THEN CAST(cov AS INT) + CAST(numoff AS INT) + CAST(totoff AS INT) + CAST(noamt AS INT) + CAST(few AS INT) ELSE 0 END AS nreasons,
   array_to_string(list_filter([CASE WHEN known AND cov THEN 'taxonomy_type_covered_by_metadata' END, CASE WHEN known AND totoff AND ret THEN 'return_credit_amount_direction_review' END,
    CASE WHEN known AND few AND is_favorite THEN 'line_item_recall_with_review_candidates' END, CASE WHEN known AND few AND NOT is_favorite THEN 'line_item_recall_low' END], lambda x: x IS NOT NULL), '|') AS cats FROM cmp)"""


@query("jn16_compare_to_truth", sql("SELECT document_id, status, CAST(nreasons AS BIGINT) AS reasons, cats AS warning_categories FROM ver", DOCS, LNS, JN16))
def _(spark, sf):
    out = E.compare_to_truth(results(spark, sf), truth(spark, sf))
    return out.select("document_id", "status", F.size("reasons").alias("reasons"), "warning_categories")


@query("ag10_regression_summary", sql("""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS pass, count(*) FILTER (WHERE status = 'WARN') AS warn, count(*) FILTER (WHERE status = 'FAIL') AS fail,
 count(*) FILTER (WHERE review_required) AS review_required, round(count(*) FILTER (WHERE review_required) / count(*) * 100, 1) AS review_required_ratio FROM ver""", DOCS, LNS, JN16))
def _(spark, sf):
    return E.regression_summary(E.compare_to_truth(results(spark, sf), truth(spark, sf)))


@query("ag10_top_row_signals", sql("""SELECT signal, count(*) AS n FROM (SELECT unnest(list_concat(list_filter([CASE WHEN quantity IS NULL THEN 'row_missing_quantity' END, CASE WHEN unit_price IS NULL AND NOT list_contains(validation_warnings, 'untrusted_ocr_amount') THEN 'row_missing_unit_price' END], lambda x: x IS NOT NULL), validation_warnings)) AS signal FROM lns)
 GROUP BY signal ORDER BY n DESC, signal LIMIT 8""", LNS))
def _(spark, sf):
    return E.top_counts(E.row_signals(V.lines(spark, sf)), "signal")


@query("ag21_summarize_runs", sql("""SELECT 'severity' AS part, processing_status AS key, count(*) AS n FROM docs GROUP BY 2 UNION ALL SELECT 'classification', document_type, count(*) FROM docs GROUP BY 2
 UNION ALL SELECT 'issue', c, count(*) FROM (SELECT unnest(document_profiles) AS c FROM docs) GROUP BY 2 UNION ALL SELECT 'overall', 'reports', count(*) FROM docs
 UNION ALL SELECT 'overall', 'available', count(*) FILTER (WHERE currency IS NOT NULL) FROM docs UNION ALL SELECT 'overall', 'recommended', 0""", DOCS))
def _(spark, sf):
    return E.summarize_runs(V.documents(spark, sf).selectExpr("processing_status AS severity", "document_type AS classification", "taxonomy.document_profiles AS issue_codes", "currency IS NOT NULL AS provider_available"))


def expectations(spark, sf):
    heads = V.documents(spark, sf).selectExpr(
        "document_id", "document_type = 'delivery_note' AS no_price_document", "CASE WHEN currency = 'USD' THEN array('quantity', 'spec', 'line_total') ELSE array('item_name', 'unit_price') END AS visible_columns",
        "CASE WHEN currency IS NULL THEN array('tax', 'amount') ELSE array() END AS hidden_columns")
    lines = V.lines(spark, sf, with_part=True).withColumn("expected_flags", F.expr("CASE WHEN quantity IS NULL THEN array('missing_quantity') ELSE array() END"))
    return heads, lines


def observed_lines(spark, sf) -> DataFrame:
    return actual_lines(spark, sf).withColumns({
        "quantity": F.coalesce("quantity", F.lit("7").cast("decimal(18,2)")), "unit_price": F.expr("CASE WHEN line_no = 2 THEN NULL WHEN line_no = 3 THEN CAST(unit_price + 1 AS DECIMAL(18,2)) ELSE unit_price END"),
        "specification": F.expr("CASE WHEN line_no = 5 THEN replace(specification, ' ', '') WHEN line_no = 6 THEN 'other' ELSE specification END"),
        "item_name": F.expr("CASE WHEN line_no = 7 THEN 'Vendor SKU 9' WHEN line_no = 1 AND part_key % 2 = 0 THEN 'Grand Total' ELSE item_name END")})


def _cmp(e: str, a: str, text: bool) -> str:
    return f"lower(regexp_replace({e}, '\\s+', '', 'g')) <> lower(regexp_replace({a}, '\\s+', '', 'g'))" if text else f"{e} <> {a}"


QG14 = f"""obs AS (SELECT * REPLACE (coalesce(quantity, 7) AS quantity, CASE WHEN line_no = 2 THEN NULL WHEN line_no = 3 THEN unit_price + 1 ELSE unit_price END AS unit_price, CASE WHEN line_no = 5 THEN replace(specification, ' ', '') WHEN line_no = 6 THEN 'other' ELSE specification END AS specification,
   CASE WHEN line_no = 7 THEN 'Vendor SKU 9' WHEN line_no = 1 AND part_key % 2 = 0 THEN 'Grand Total' ELSE item_name END AS item_name) FROM act),
hc AS (SELECT e.document_id, e.line_index, min(a.line_index) AS ai FROM lnp e JOIN obs a USING (document_id) WHERE a.item_code IS NOT NULL AND list_contains([{sql_item('e.item_code')}, {sql_item('e.document_item_code')}], {sql_item('a.item_code')}) GROUP BY ALL),
hn AS (SELECT e.document_id, e.line_index, min(a.line_index) AS ai FROM lnp e JOIN obs a USING (document_id) WHERE e.item_name IS NOT NULL AND (contains(lower(coalesce(a.item_name, '')), lower(e.item_name)) OR contains(lower(e.item_name), lower(coalesce(a.item_name, ''))) OR {sql_item('e.item_name')} = {sql_item('a.item_name')}) GROUP BY ALL),
prs AS (SELECT l.*, coalesce(hc.ai, hn.ai) AS ai, d.currency AS cur FROM lnp l JOIN docs d USING (document_id) LEFT JOIN hc USING (document_id, line_index) LEFT JOIN hn USING (document_id, line_index)),
px AS (SELECT p.document_id, p.line_no, p.cur, p.ai, p.item_name AS e_name, p.specification AS e_spec, p.quantity AS e_q, p.unit_price AS e_p, p.line_total AS e_t, o.item_name AS a_name, o.specification AS a_spec, o.quantity AS a_q, o.unit_price AS a_p, o.line_total AS a_t FROM prs p LEFT JOIN obs o ON o.document_id = p.document_id AND o.line_index = p.ai),
chk AS (SELECT document_id, CAST(NULL AS BIGINT) AS line_no, 'no_price_document_amount_blocker' AS code FROM docs WHERE document_type = 'delivery_note' AND (currency IS NOT NULL OR subtotal IS NOT NULL OR tax IS NOT NULL OR extracted_amount IS NOT NULL)
 UNION ALL SELECT document_id, line_no, 'no_price_line_amount_created' FROM obs JOIN docs USING (document_id) WHERE document_type = 'delivery_note'
 UNION ALL SELECT document_id, line_no, 'row_amount_hidden_do_not_infer' FROM obs JOIN docs USING (document_id) WHERE currency IS NULL AND obs.tax_amount IS NOT NULL UNION ALL SELECT document_id, line_no, 'row_amount_hidden_do_not_infer' FROM obs JOIN docs USING (document_id) WHERE currency IS NULL AND obs.line_total IS NOT NULL
 UNION ALL SELECT document_id, line_no, 'summary_total_not_line_item' FROM obs WHERE regexp_matches(lower(item_name), '총액|합계|subtotal|total|tax|vat|공급가액|세액') UNION ALL SELECT document_id, line_no, 'vendor_sku_not_item_row' FROM obs WHERE starts_with(lower(item_name), 'vendor sku ')
 UNION ALL SELECT document_id, line_no, 'visible_row_missing' FROM px WHERE ai IS NULL UNION ALL SELECT document_id, line_no, 'blank_quantity_preservation_failed' FROM px WHERE ai IS NOT NULL AND e_q IS NULL AND a_q IS NOT NULL
 UNION ALL SELECT document_id, line_no, 'visible_field_missing' FROM px WHERE ai IS NOT NULL AND cur = 'USD' AND e_spec IS NOT NULL AND a_spec IS NULL UNION ALL SELECT document_id, line_no, 'visible_field_mismatch' FROM px WHERE cur = 'USD' AND {_cmp('e_spec', 'a_spec', True)}
 UNION ALL SELECT document_id, line_no, 'visible_field_mismatch' FROM px WHERE cur = 'USD' AND e_q <> a_q UNION ALL SELECT document_id, line_no, 'visible_field_missing' FROM px WHERE ai IS NOT NULL AND cur = 'USD' AND e_t IS NOT NULL AND a_t IS NULL
 UNION ALL SELECT document_id, line_no, 'visible_field_mismatch' FROM px WHERE cur = 'USD' AND e_t <> a_t
 UNION ALL SELECT document_id, line_no, 'visible_field_missing' FROM px WHERE ai IS NOT NULL AND coalesce(cur, '') <> 'USD' AND e_name IS NOT NULL AND a_name IS NULL UNION ALL SELECT document_id, line_no, 'visible_field_mismatch' FROM px WHERE coalesce(cur, '') <> 'USD' AND {_cmp('e_name', 'a_name', True)}
 UNION ALL SELECT document_id, line_no, 'visible_field_missing' FROM px WHERE ai IS NOT NULL AND coalesce(cur, '') <> 'USD' AND e_p IS NOT NULL AND a_p IS NULL UNION ALL SELECT document_id, line_no, 'visible_field_mismatch' FROM px WHERE coalesce(cur, '') <> 'USD' AND e_p <> a_p)"""


@query("qg14_expectation_checks", sql("SELECT document_id, line_no, code FROM chk WHERE code <> 'exchange_rate_not_total'", DOCS, LNP, ACT, QG14))
def _(spark, sf):
    out = E.expectation_checks(*expectations(spark, sf), V.documents(spark, sf), observed_lines(spark, sf))
    return out.filter("code <> 'exchange_rate_not_total'").select("document_id", "line_no", "code")


def outputs(spark, sf) -> DataFrame:
    """Documents as produced texts: the first line is the title, the second the short summary, the whole text the long one."""
    return V.table(spark, sf, "documents").selectExpr("doc_id AS document_id", "split(text, '\\n', 2)[0] AS title", "coalesce(try_element_at(split(text, '\\n', 3), 2), '') AS summary_short", "text AS summary_detailed", "array(lang, source, 'the') AS keywords")


def _rule(cond: str, severity: str, code: str) -> str:
    return f"SELECT document_id, '{severity}' AS severity, '{code}' AS code FROM o WHERE {cond}"


def _times(t: str, p: str) -> str:
    return f"(length({t}) - length(replace({t}, '{p}', ''))) / length('{p}')"


OUT = """o AS (SELECT doc_id AS document_id, string_split(text, chr(10))[1] AS title, coalesce(string_split(text, chr(10))[2], '') AS s, text AS l, lower(text) AS low, [lang, source, 'the'] AS kw,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS lw, len(list_filter(regexp_split_to_array(coalesce(string_split(text, chr(10))[2], ''), '\\s+'), lambda w: w <> '')) AS sw,
  len(list_filter(regexp_split_to_array(string_split(text, chr(10))[1], '\\s+'), lambda w: w <> '')) AS tw FROM documents)"""


@query("qg15_text_checks", sql(" UNION ALL ".join([
    _rule("trim(title) = ''", "fail", "title_missing"), _rule("tw >= 8 AND regexp_matches(lower(title), '\\b(is|are|will|introduces|provides|covers|describes|contains)\\b')", "warn", "title_body_like"),
    _rule("s = ''", "fail", "summary_short_missing"), _rule("s <> '' AND sw < 4", "warn", "summary_short_thin"), _rule("l <> '' AND lw < 12", "warn", "summary_detailed_thin"),
    _rule("regexp_matches(l, ',\\s*and\\.$') OR regexp_matches(l, ';\\s*and\\b') OR regexp_matches(l, '\\band\\.\\s*$') OR regexp_matches(l, '\\.\\s*\\.\\s*')", "fail", "summary_malformed"),
    _rule(f"{_times('low', ', along with ')} >= 2 OR {_times('low', ' it highlights ')} >= 2 OR (regexp_matches(l, '\\b[A-Za-z].+?, .+?, and .+?\\.') AND lw < 18)", "warn", "summary_fragment_dump"),
    _rule("len(regexp_extract_all(low, '\\b(review|document|details)\\b')) >= 5", "warn", "summary_repetitive"),
    _rule(f"len(list_filter({lst(E.IDENTITY_WORDS)}, lambda w: contains(low, w))) = 0", "warn", "summary_missing_identity"),
    _rule("len(list_filter(kw, lambda k: contains(low, k))) = 0", "warn", "summary_missing_substance"),
    _rule("len(list_filter(kw, lambda k: contains(lower(s || chr(10) || l), k))) < 2", "warn", "summary_keyword_coverage")]), OUT))
def _(spark, sf):
    return E.text_checks(outputs(spark, sf))


# --- upserts -----------------------------------------------------------------

def uploads(spark, sf) -> DataFrame:
    """An upload: half of the parts re-priced (some twice) and as many new codes."""
    part = V.item_master(spark, sf)
    again = part.filter("unit = 'EA'").withColumns({"standard_price": F.expr("CAST(standard_price + 1 AS DECIMAL(18,2))"), "row_number": F.col("item_id") * 2})
    twice = part.filter("unit = 'EA' AND category = 'PROMO'").withColumns({"standard_price": F.expr("CAST(standard_price + 2 AS DECIMAL(18,2))"), "row_number": F.col("item_id") * 2 + 1})
    fresh = part.filter("unit = 'BOX'").withColumns({"internal_item_code": F.concat(F.lit("NEW-"), "internal_item_code"), "row_number": F.col("item_id") * 2})
    return again.unionByName(twice).unionByName(fresh)


@query("up01_upsert_master", sql("""SELECT internal_item_code, CAST(standard_price + CASE WHEN unit = 'EA' THEN CASE WHEN category = 'PROMO' THEN 2 ELSE 1 END ELSE 0 END AS DOUBLE) AS standard_price FROM master
 UNION ALL SELECT 'NEW-' || internal_item_code, CAST(standard_price AS DOUBLE) FROM master WHERE unit = 'BOX'""", MASTER))
def _(spark, sf):
    out, _ = U.upsert_master(V.item_master(spark, sf), uploads(spark, sf))
    return out.select("internal_item_code", "standard_price")


@query("up01_upsert_counts", sql("SELECT count(*) FILTER (WHERE unit = 'BOX') AS inserted, count(*) FILTER (WHERE unit = 'EA') AS updated FROM master", MASTER))
def _(spark, sf):
    return U.upsert_master(V.item_master(spark, sf), uploads(spark, sf))[1].drop("skipped")


@query("up01_upload_counts", sql("SELECT count(*) FILTER (WHERE item_id % 2 = 1 AND item_id % 7 <> 0) AS inserted, count(*) FILTER (WHERE item_id % 2 = 0 AND item_id % 7 <> 0) AS updated, count(*) FILTER (WHERE item_id % 7 = 0) AS skipped FROM master", MASTER))
def _(spark, sf):
    """An uploaded table with new, known and unusable rows."""
    master = V.item_master(spark, sf)
    raw = master.selectExpr("concat(IF(item_id % 2 = 1, 'N-', ''), internal_item_code) AS internal_item_code", "IF(item_id % 7 = 0, ' ', item_name) AS item_name", "unit")
    rows, errors = item_master_rows(raw)
    return U.upsert_master(master, rows, errors=errors)[1]


@query("up03_deactivate", sql("SELECT item_id, active AND item_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.07 AND l_tax = 0.01) AS active FROM master", MASTER))
def _(spark, sf):
    ids = V.table(spark, sf, "lineitem").filter("l_discount = 0.07 AND l_tax = 0.01").select(F.col("l_partkey").alias("item_id"))
    return U.deactivate(V.item_master(spark, sf), ids, "item_id").select("item_id", "active")


@query("up06_bulk_delete", sql("SELECT document_id FROM docs WHERE document_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.07 AND l_tax = 0.01)", DOCS))
def _(spark, sf):
    ids = V.table(spark, sf, "lineitem").filter("l_discount = 0.07 AND l_tax = 0.01").select(F.col("l_orderkey").alias("document_id"))
    return U.bulk_delete(V.documents(spark, sf), ids).select("document_id")


@query("up07_enforce_default", "SELECT c_custkey AS template_id, c_custkey IN (SELECT arg_max(c_custkey, (c_acctbal, c_custkey)) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_nationkey) AS is_default FROM customer")
def _(spark, sf):
    t = V.table(spark, sf, "customer").selectExpr("c_custkey AS template_id", "c_nationkey AS scope", "c_acctbal AS updated_at", "c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_default")
    return U.enforce_default(t).select("template_id", "is_default")


@query("up08_replace_key_date", sql("""SELECT document_id, array_to_string(CASE WHEN key_dates IS NULL THEN ['2030-01-01'] WHEN currency = 'USD' THEN [key_dates[1], '2030-01-01', key_dates[3]] ELSE list_append(key_dates, '2030-01-01') END, '|') AS key_dates FROM docs""", DOCS))
def _(spark, sf):
    docs = V.documents(spark, sf).withColumns({"original_date": F.expr("CASE WHEN currency = 'USD' THEN substring(key_dates[1], 6) END"), "new_date": F.lit("2030-01-01")})
    return U.replace_key_date(docs).select("document_id", "key_dates")
