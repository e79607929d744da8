"""Line-item and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bizdocs.catalog.registry import query
from bizdocs.catalog.twins import DOCS, LNP, LNS, sql
from bizdocs.operators import line_items as L
from bizdocs.plans import export as X
from bizdocs.sources import views as V

KEY = ["document_id", "line_no", "part_key"]
KEY_SQL = "document_id, line_no, part_key"


def lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FLAGS = "list_concat(validation_warnings, review_flags)"


def repeated(spark, sf) -> DataFrame:
    """Every line, plus a second delivery of the lines with return flag A."""
    lines = V.lines(spark, sf, with_part=True)
    again = lines.filter("return_flag = 'A'").withColumn("line_index", F.col("line_index") + 1)
    return lines.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))


REP = "rep AS (SELECT *, 0 AS copy FROM lnp UNION ALL SELECT * REPLACE (line_index + 1 AS line_index), 1 AS copy FROM lnp WHERE return_flag = 'A')"


def receipts(spark, sf) -> DataFrame:
    """Headers where USD quotations act as receipts and FURNITURE rows are filed as credit notes."""
    return V.documents(spark, sf).withColumns({
        "document_type": F.expr("CASE WHEN currency = 'USD' AND document_type = 'quotation' THEN 'receipt' ELSE document_type END"),
        "category": F.expr("CASE WHEN category = 'delivery_note' THEN 'credit_note' ELSE category END")})


RCP = """rcp AS (SELECT * REPLACE (CASE WHEN currency = 'USD' AND document_type = 'quotation' THEN 'receipt' ELSE document_type END AS document_type,
  CASE WHEN category = 'delivery_note' THEN 'credit_note' ELSE category END AS category) FROM docs),
rcp2 AS (SELECT *, coalesce(category, '') = 'credit_note' AND document_type IN ('purchase_order','quotation','invoice','transaction_statement')
  AND NOT list_contains(document_profiles, 'return_document') AS conflict FROM rcp)"""
DIRTY_NAME = "regexp_matches(lower(coalesce(item_name,'')), 'tax|vat|total|합계|세액|총액')"
EXPORTABLE = f"""exl AS (SELECT l.* FROM rep l JOIN rcp2 d USING (document_id) WHERE NOT list_contains({FLAGS}, 'invalid_line_amount') AND NOT conflict
  AND NOT (document_type = 'receipt' AND (list_has_any({FLAGS}, {lst(L.DIRTY_RECEIPT_FLAGS)}) OR {DIRTY_NAME}))),
safe AS (SELECT * REPLACE (CASE WHEN NOT bad THEN unit_price END AS unit_price, CASE WHEN NOT bad THEN supply_amount END AS supply_amount,
  CASE WHEN NOT bad THEN tax_amount END AS tax_amount, CASE WHEN NOT bad THEN line_total END AS line_total)
  FROM (SELECT *, list_has_any({FLAGS}, {lst(L.BAD_AMOUNT_FLAGS)}) AS bad FROM exl)),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(regexp_replace(coalesce(item_name,''), '\\s+', '', 'g')),
   lower(coalesce(document_item_code, item_code)), lower(regexp_replace(coalesce(specification,''), '\\s+', '', 'g')), quantity, loose,
   CASE WHEN NOT loose THEN unit_price END, CASE WHEN NOT loose THEN supply_amount END, CASE WHEN NOT loose THEN tax_amount END, CASE WHEN NOT loose THEN line_total END
   ORDER BY line_index) AS rn FROM (SELECT *, list_contains({FLAGS}, 'ai_parsed_document_table_review_required') AS loose FROM safe)) WHERE rn = 1)"""
EXPORT_VIEWS = (DOCS, LNP, REP, RCP, EXPORTABLE)


@query("jn01_lines_of", sql("SELECT document_id, count(line_no) AS n_lines, CAST(sum(supply_amount) AS DOUBLE) AS supply FROM docs LEFT JOIN lns USING (document_id) GROUP BY document_id", DOCS, LNS))
def _(spark, sf):
    nested = V.lines(spark, sf).groupBy("document_id").agg(F.collect_list(F.struct("line_no", "supply_amount")).alias("line_items"))
    flat = L.lines_of(V.documents(spark, sf).select("document_id").join(nested, "document_id", "left"))
    return flat.groupBy("document_id").agg(F.count("line_no").alias("n_lines"), F.sum("supply_amount").alias("supply"))


@query("fl08_exportable_lines", sql(f"SELECT {KEY_SQL}, copy::BIGINT AS copy FROM exl", *EXPORT_VIEWS))
def _(spark, sf):
    return L.exportable_lines(receipts(spark, sf), repeated(spark, sf)).select(*KEY, "copy")


@query("pr11_safe_amounts", sql(f"""SELECT {KEY_SQL}, CAST(CASE WHEN NOT bad THEN supply_amount END AS DOUBLE) AS supply_amount, CAST(CASE WHEN NOT bad THEN line_total END AS DOUBLE) AS line_total
 FROM (SELECT *, list_has_any({FLAGS}, {lst(L.BAD_AMOUNT_FLAGS)}) AS bad FROM lns)""", LNS))
def _(spark, sf):
    return L.safe_amounts(V.lines(spark, sf)).select(*KEY, "supply_amount", "line_total")


@query("wn05_dedupe_lines", sql(f"SELECT {KEY_SQL}, copy::BIGINT AS copy FROM dd", *EXPORT_VIEWS))
def _(spark, sf):
    return X.exportable_items(receipts(spark, sf), repeated(spark, sf)).select(*KEY, "copy")


ITEM_KEY = "regexp_replace(lower(coalesce({}, '')), '[^0-9a-z가-힣]+', '', 'g')"
PARSED = f"""par AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, {ITEM_KEY.format('item_name')}, {ITEM_KEY.format('document_item_code')}, {ITEM_KEY.format('item_code')},
  {ITEM_KEY.format('specification')}, quantity, unit_price, supply_amount, tax_amount, line_total ORDER BY line_index) AS rn FROM rep) WHERE rn = 1)"""


@query("wn06_dedupe_parsed_lines", sql(f"SELECT {KEY_SQL}, copy::BIGINT AS copy FROM par", LNP, REP, PARSED))
def _(spark, sf):
    return L.dedupe_parsed_lines(repeated(spark, sf)).select(*KEY, "copy")


def candidates(spark, sf) -> DataFrame:
    """Competing reads of one document: codes vanish for flag N, amounts for the second copy."""
    c = repeated(spark, sf)
    return c.withColumns({"item_code": F.expr("CASE WHEN return_flag <> 'N' THEN item_code END"), "unit_price": F.expr("CASE WHEN copy = 0 THEN NULL ELSE unit_price END")})


@query("wn07_dedupe_candidates", sql("""SELECT document_id, line_no, part_key, copy::BIGINT AS copy FROM (SELECT *, row_number() OVER (PARTITION BY document_id, c, CASE WHEN c = '' THEN lower(coalesce(item_name,'')) END, CASE WHEN c = '' THEN coalesce(line_total, supply_amount) END
 ORDER BY -(CASE WHEN line_total IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN supply_amount IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN tax_amount IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN quantity IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN up IS NOT NULL THEN 1 ELSE 0 END),
  -(CASE WHEN c <> '' THEN 1 ELSE 0 END + CASE WHEN specification IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN item_name IS NOT NULL THEN 1 ELSE 0 END), length(coalesce(item_name, '')), line_index) AS rn
 FROM (SELECT *, CASE WHEN return_flag <> 'N' THEN item_code ELSE '' END AS c, CASE WHEN copy = 0 THEN NULL ELSE unit_price END AS up FROM rep)) WHERE rn = 1""", LNP, REP))
def _(spark, sf):
    return L.dedupe_candidates(candidates(spark, sf)).select(*KEY, "copy")


LSUM = "lsum AS (SELECT document_id, sum(line_total) AS line_sum FROM lns GROUP BY document_id)"
TOL = {
    "quality": "greatest(1, abs(extracted_amount) * 0.02)",
    "enrichment": "CASE coalesce(currency, 'KRW') WHEN 'USD' THEN 0.05 WHEN 'KRW' THEN 10 ELSE 1 END",
    "approval": "0.01",
}


def clean_totals(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """Confirmed documents get a header total near their lines, so the clean branch is met too."""
    return docs.join(sums.select("document_id", F.col("line_sum").alias("_ls")), "document_id", "left").withColumn(
        "extracted_amount", F.expr("CASE WHEN processing_status = 'confirmed' AND _ls IS NOT NULL THEN CAST(_ls + 0.05 AS DECIMAL(18,2)) ELSE extracted_amount END")).drop("_ls")


CLEAN = "cln AS (SELECT d.* REPLACE (CASE WHEN processing_status = 'confirmed' AND line_sum IS NOT NULL THEN CAST(line_sum + 0.05 AS DECIMAL(18,2)) ELSE extracted_amount END AS extracted_amount), line_sum FROM docs d LEFT JOIN lsum USING (document_id))"

for _policy, _tol in TOL.items():
    def _register(policy=_policy, tol=_tol):
        @query(f"ag16_total_mismatch_{policy}", sql(f"SELECT document_id, coalesce(abs(extracted_amount - line_sum) > {tol}, false) AS mismatch FROM cln", DOCS, LNS, LSUM, CLEAN))
        def _(spark, sf):
            lines = V.lines(spark, sf)
            return L.total_mismatch(clean_totals(V.documents(spark, sf), L.line_sum(lines)), lines, policy).select("document_id", "mismatch")
    _register()


@query("ag17_confirmed_sum", sql(f"""SELECT document_id, CAST(sum(supply_amount) FILTER (WHERE NOT (list_has_any({FLAGS}, {lst(L.UNCONFIRMED_FLAGS)}) OR coalesce(contains(note, '별도 협의'), false))) AS DOUBLE) AS confirmed_sum
 FROM lns GROUP BY document_id""", LNS))
def _(spark, sf):
    return L.confirmed_sum(V.lines(spark, sf), "supply_amount")


def doubled(spark, sf):
    """Every line read twice (the second read lost its tax); confirmed headers carry the single sum."""
    lines = V.lines(spark, sf, with_part=True).withColumn("copy", F.lit(0))
    again = lines.withColumns({"line_index": F.col("line_index") + 1, "tax_amount": F.lit(None).cast("decimal(18,2)"), "copy": F.lit(1)})
    single = lines.filter(~L.has_flag(L.UNTRUSTED_TOTAL_FLAGS, "validation_warnings")).groupBy("document_id").agg(F.sum("line_total").alias("line_sum"))
    docs = V.documents(spark, sf).join(single, "document_id", "left").withColumn(
        "extracted_amount", F.expr("CASE WHEN processing_status = 'confirmed' THEN line_sum ELSE extracted_amount END"))
    return docs, lines.unionByName(again)


DBL = f"""dbl AS (SELECT *, 0 AS copy FROM lnp UNION ALL SELECT * REPLACE (line_index + 1 AS line_index, CAST(NULL AS DECIMAL(18,2)) AS tax_amount), 1 AS copy FROM lnp),
sgl AS (SELECT document_id, sum(line_total) AS line_sum FROM lnp WHERE NOT list_has_any(validation_warnings, {lst(L.UNTRUSTED_TOTAL_FLAGS)}) GROUP BY document_id),
ddoc AS (SELECT document_id, CASE WHEN processing_status = 'confirmed' THEN line_sum ELSE extracted_amount END AS total FROM docs LEFT JOIN sgl USING (document_id)),
dpar AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, {ITEM_KEY.format('item_name')}, {ITEM_KEY.format('document_item_code')}, {ITEM_KEY.format('item_code')},
  {ITEM_KEY.format('specification')}, quantity, unit_price, supply_amount, tax_amount, line_total ORDER BY line_index) AS rn FROM dbl) WHERE rn = 1),
dsum AS (SELECT document_id, sum(line_total) FILTER (WHERE NOT list_has_any(validation_warnings, {lst(L.UNTRUSTED_TOTAL_FLAGS)})) AS s FROM dpar GROUP BY document_id),
sus AS (SELECT document_id, s FROM dsum JOIN ddoc USING (document_id) WHERE total > 0 AND s > 0 AND round(CAST(s AS DOUBLE) / CAST(total AS DOUBLE)) >= 2
  AND abs(CAST(s AS DOUBLE) / CAST(total AS DOUBLE) - round(CAST(s AS DOUBLE) / CAST(total AS DOUBLE))) <= 0.03),
red AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, {ITEM_KEY.format('item_code')}, {ITEM_KEY.format('item_name')}, {ITEM_KEY.format('specification')}, coalesce(line_total, supply_amount)
  ORDER BY -(CASE WHEN item_name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN document_item_code IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN specification IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN quantity IS NOT NULL THEN 1 ELSE 0 END
   + CASE WHEN unit_price IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN supply_amount IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN tax_amount IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN line_total IS NOT NULL THEN 1 ELSE 0 END), line_index) AS rn
  FROM dpar WHERE document_id IN (SELECT document_id FROM sus)) WHERE rn = 1),
low AS (SELECT document_id FROM (SELECT document_id, sum(line_total) FILTER (WHERE NOT list_has_any(validation_warnings, {lst(L.UNTRUSTED_TOTAL_FLAGS)})) AS r FROM red GROUP BY document_id) JOIN sus USING (document_id) WHERE r < s)"""


@query("ag18_collapse_duplicate_sets", sql(f"""SELECT {KEY_SQL}, copy::BIGINT AS copy FROM dpar WHERE document_id NOT IN (SELECT document_id FROM low)
 UNION ALL SELECT {KEY_SQL}, copy::BIGINT FROM red WHERE document_id IN (SELECT document_id FROM low)""", DOCS, LNP, DBL))
def _(spark, sf):
    docs, lines = doubled(spark, sf)
    return L.collapse_duplicate_sets(docs, lines, [*KEY, "copy"])


SHAKY = """shk AS (SELECT * REPLACE (CASE WHEN return_flag = 'A' AND unit = 'EA' THEN -supply_amount WHEN note IS NOT NULL THEN supply_amount * 3 ELSE supply_amount END AS supply_amount,
  CASE WHEN return_flag = 'A' AND unit = 'EA' THEN -tax_amount WHEN line_no = 3 THEN tax_amount * 90 ELSE tax_amount END AS tax_amount,
  CASE WHEN return_flag = 'A' AND unit = 'EA' THEN -line_total ELSE line_total END AS line_total) FROM lns)"""


def shaky(spark, sf) -> DataFrame:
    """Lines with adjustments (all negative) and damaged amounts."""
    neg = "return_flag = 'A' AND unit = 'EA'"
    return V.lines(spark, sf).selectExpr(
        "* EXCEPT (supply_amount, tax_amount, line_total)",
        f"CASE WHEN {neg} THEN -supply_amount WHEN note IS NOT NULL THEN supply_amount * 3 ELSE supply_amount END AS supply_amount",
        f"CASE WHEN {neg} THEN -tax_amount WHEN line_no = 3 THEN tax_amount * 90 ELSE tax_amount END AS tax_amount",
        f"CASE WHEN {neg} THEN -line_total ELSE line_total END AS line_total")


@query("fn19_line_warnings", sql("""SELECT document_id, line_no, part_key, array_to_string(CASE WHEN coalesce((supply_amount < 0 OR tax_amount < 0 OR line_total < 0) AND abs(abs(supply_amount) + abs(tax_amount) - abs(line_total)) <= greatest(1, abs(line_total) * 0.02), false) THEN []
 ELSE list_filter([CASE WHEN line_total >= 0 AND tax_amount > line_total THEN 'invalid_tax_greater_than_total' END, CASE WHEN supply_amount > 0 AND tax_amount > supply_amount THEN 'invalid_tax_greater_than_supply' END,
  CASE WHEN supply_amount > line_total THEN 'invalid_supply_greater_than_total' END, CASE WHEN abs(supply_amount + tax_amount - line_total) > greatest(1, abs(line_total) * 0.02) THEN 'invalid_line_total' END], lambda x: x IS NOT NULL) END, '|') AS warnings FROM shk""", LNS, SHAKY))
def _(spark, sf):
    return L.line_warnings(shaky(spark, sf)).select(*KEY, F.col("amount_warnings").alias("warnings"))


@query("fn20_repair_unit_price", sql("""SELECT document_id, line_no, part_key, CAST(CASE WHEN fix THEN s / quantity ELSE p END AS DOUBLE) AS unit_price, fix AS price_repaired FROM (
 SELECT *, coalesce(quantity > 0 AND s > 0 AND NOT coalesce(abs(quantity * p - s) <= greatest(1, abs(s) * 0.02), false) AND NOT coalesce(p > s, false)
  AND s % quantity = 0 AND s / quantity BETWEEN 10 AND 1000000, false) AS fix FROM (
  SELECT *, CASE WHEN unit = 'EA' THEN CAST(quantity * part_key AS DECIMAL(18,2)) ELSE supply_amount END AS s, CASE WHEN return_flag = 'R' THEN NULL WHEN return_flag = 'A' THEN CAST(1 AS DECIMAL(18,2)) ELSE unit_price END AS p FROM lns))""", LNS))
def _(spark, sf):
    lines = V.lines(spark, sf).withColumns({
        "supply_amount": F.expr("CASE WHEN unit = 'EA' THEN CAST(quantity * part_key AS DECIMAL(18,2)) ELSE supply_amount END"),
        "unit_price": F.expr("CASE WHEN return_flag = 'R' THEN NULL WHEN return_flag = 'A' THEN CAST(1 AS DECIMAL(18,2)) ELSE unit_price END")})
    return L.repair_unit_price(lines).select(*KEY, "unit_price", "price_repaired")


@query("fn21_guard_quantity", sql("""SELECT document_id, line_no, part_key, CAST(CASE WHEN NOT dropped THEN q END AS DOUBLE) AS quantity, CAST(CASE WHEN NOT dropped THEN unit_price END AS DOUBLE) AS unit_price, dropped AS quantity_suppressed FROM (
 SELECT *, coalesce(q > 5000, false) AND NOT (coalesce(abs(tax_amount - supply_amount * 0.1) <= greatest(1, abs(supply_amount) * 0.02), false) AND coalesce(abs(supply_amount + tax_amount - line_total) <= greatest(1, abs(line_total) * 0.02), false)) AS dropped
 FROM (SELECT *, quantity * 200 AS q FROM lns))""", LNS))
def _(spark, sf):
    lines = V.lines(spark, sf).withColumn("quantity", F.expr("CAST(quantity * 200 AS DECIMAL(18,2))"))
    return L.guard_quantity(lines).select(*KEY, "quantity", "unit_price", "quantity_suppressed")


@query("fn22_guard_total", sql("""SELECT document_id, cleared AS total_cleared, CAST(CASE WHEN NOT cleared THEN extracted_amount END AS DOUBLE) AS extracted_amount, CAST(CASE WHEN NOT cleared THEN subtotal END AS DOUBLE) AS subtotal FROM (
 SELECT d.*, coalesce(n >= 2 AND s >= 10000 AND extracted_amount > 0 AND extracted_amount < s * 0.2, false) AS cleared FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n, sum(line_total) AS s FROM lns WHERE line_total > 0 GROUP BY document_id) USING (document_id))""", DOCS, LNS))
def _(spark, sf):
    return L.guard_total(V.documents(spark, sf), V.lines(spark, sf)).select("document_id", "total_cleared", "extracted_amount", "subtotal")


def vat_lines(spark, sf):
    """Lines restated with 10 % VAT, except one damaged kind; headers equal the undamaged sums."""
    lines = V.lines(spark, sf).filter("supply_amount IS NOT NULL").withColumn("tax_amount", F.expr("CAST(round(supply_amount * 0.1BD, 2) AS DECIMAL(18,2))"))
    lines = lines.withColumn("line_total", F.expr("CAST(supply_amount + tax_amount AS DECIMAL(18,2))"))
    docs = lines.groupBy("document_id").agg(*[F.sum(a).cast("decimal(18,2)").alias(b) for a, b in (("supply_amount", "subtotal"), ("tax_amount", "tax"), ("line_total", "extracted_amount"))])
    damaged = lines.withColumns({"tax_amount": F.expr("CASE WHEN line_no = 2 THEN supply_amount ELSE tax_amount END")})
    return docs, damaged


VAT = """v0 AS (SELECT * REPLACE (CAST(round(supply_amount * 0.1, 2) AS DECIMAL(18,2)) AS tax_amount, CAST(supply_amount + CAST(round(supply_amount * 0.1, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS line_total) FROM lns WHERE supply_amount IS NOT NULL),
vd AS (SELECT document_id, sum(supply_amount) AS ds, sum(tax_amount) AS dt, sum(line_total) AS dtot FROM v0 GROUP BY document_id),
v1 AS (SELECT * REPLACE (CASE WHEN line_no = 2 THEN supply_amount ELSE tax_amount END AS tax_amount) FROM v0),
v2 AS (SELECT v1.*, ds, dt, dtot, coalesce(abs(supply_amount + tax_amount - line_total) <= greatest(1, abs(line_total) * 0.02) AND abs(tax_amount - supply_amount * 0.1) <= greatest(1, abs(supply_amount) * 0.02) AND line_total > dtot * 0.05, false) AS good FROM v1 JOIN vd USING (document_id)),
v3 AS (SELECT document_id, count(*) FILTER (WHERE NOT good) AS bad, coalesce(sum(supply_amount) FILTER (WHERE good), 0) AS gs, coalesce(sum(tax_amount) FILTER (WHERE good), 0) AS gt, coalesce(sum(line_total) FILTER (WHERE good), 0) AS gtot FROM v2 GROUP BY document_id),
v4 AS (SELECT v2.*, NOT good AND bad = 1 AND ds - gs > 0 AND dt - gt >= 0 AND dtot - gtot > 0 AND abs((ds - gs) + (dt - gt) - (dtot - gtot)) <= greatest(1, (dtot - gtot) * 0.02) AS filled, ds - gs AS rs, dt - gt AS rt, dtot - gtot AS rtot FROM v2 JOIN v3 USING (document_id))"""


@query("fn23_fill_residual_line", sql("""SELECT document_id, line_no, part_key, filled AS residual_filled, CAST(CASE WHEN filled THEN rs ELSE supply_amount END AS DOUBLE) AS supply_amount,
 CAST(CASE WHEN filled THEN rt ELSE tax_amount END AS DOUBLE) AS tax_amount, CAST(CASE WHEN filled THEN rtot ELSE line_total END AS DOUBLE) AS line_total FROM v4""", LNS, VAT))
def _(spark, sf):
    return L.fill_residual_line(*vat_lines(spark, sf)).select(*KEY, "residual_filled", "supply_amount", "tax_amount", "line_total")


@query("qg03_incomplete_lines", sql("SELECT document_id, bool_or(item_name IS NULL OR quantity IS NULL OR (unit_price IS NULL AND line_total IS NULL)) AS incomplete FROM lnp GROUP BY document_id", LNP))
def _(spark, sf):
    return L.incomplete_lines(V.lines(spark, sf, with_part=True))


# --- exports -----------------------------------------------------------------

POLICY = """pol AS (SELECT d.*, coalesce(tax_amount_required, NOT list_has_any(document_profiles, ['no_price_document','inventory_movement_document']) AND document_type NOT IN ('delivery_note','inspection_report')) AS need,
  list_contains(document_profiles, 'tax_document') AS is_tax, list_contains(document_profiles, 'return_document') AS is_ret, line_sum FROM rcp2 d LEFT JOIN lsum USING (document_id)),
policy AS (SELECT document_id, need AS amount_required, NOT list_contains(document_profiles, 'inventory_movement_document') AS party_required,
  CASE WHEN list_contains(document_profiles, 'inventory_movement_document') THEN 'inventory_movement_no_price' WHEN is_ret THEN 'return_or_credit_review' WHEN is_tax THEN 'tax_document_consistency'
   WHEN list_contains(document_profiles, 'foreign_currency_document') THEN 'foreign_currency_document' WHEN NOT need THEN 'no_price_document' ELSE 'priced_document' END AS export_policy, conflict AS export_blocked,
  array_to_string(list_filter([CASE WHEN list_contains(document_profiles, 'no_price_document') THEN 'amount_not_required' END,
   CASE WHEN is_tax AND (subtotal IS NULL OR tax IS NULL OR extracted_amount IS NULL) THEN 'tax_amount_fields_missing' END,
   CASE WHEN is_tax AND abs(subtotal + tax - extracted_amount) > 0.01 THEN 'subtotal_tax_total_mismatch' END, CASE WHEN is_tax AND abs(line_sum - extracted_amount) > 0.01 THEN 'line_items_total_mismatch' END,
   CASE WHEN is_ret THEN 'amount_direction_requires_review' END, CASE WHEN is_ret THEN 'related_document_missing' END, CASE WHEN review_required AND NOT approved THEN 'review_required' END,
   CASE WHEN conflict THEN 'return_credit_source_conflicts_with_priced_export_blocked' END], lambda x: x IS NOT NULL), ', ') AS export_warning FROM pol)"""


@query("pr07_export_policy", sql("SELECT * FROM policy", DOCS, LNS, LSUM, RCP, POLICY))
def _(spark, sf):
    return X.export_policy(receipts(spark, sf), V.lines(spark, sf))


@query("sk01_erp_rows", sql("""SELECT d.document_id, coalesce(row_number() OVER (PARTITION BY d.document_id ORDER BY dd.line_index), 1) AS line_index, item_name AS "품목명", CAST(supply_amount AS DOUBLE) AS "공급가액",
 CASE WHEN fresh THEN 'invoice' ELSE d.document_type END AS "문서유형", coalesce(CASE WHEN fresh THEN m_customer_name END, d.customer_name) AS "고객사",
 CASE WHEN dd.document_id IS NOT NULL THEN CAST(line_total AS VARCHAR) WHEN NOT conflict THEN coalesce(CASE WHEN fresh THEN coalesce(m_document_total, m_estimated_total) END, CAST(extracted_amount AS VARCHAR)) END AS "합계금액",
 coalesce(document_item_code, item_code) AS document_item_code, export_policy, export_warning
 FROM (SELECT *, NOT review_required AND coalesce(mapping_at >= confirmed_at, false) AS fresh FROM rcp2) d LEFT JOIN dd USING (document_id) JOIN policy p ON p.document_id = d.document_id""", *EXPORT_VIEWS, LNS, LSUM, POLICY))
def _(spark, sf):
    rows = X.to_erp_rows(receipts(spark, sf), repeated(spark, sf).drop("copy"))
    return rows.select("document_id", "line_index", "품목명", "공급가액", "문서유형", "고객사", "합계금액", "document_item_code", "export_policy", "export_warning")


@query("sk01_mapped_rows", sql("""SELECT d.document_id, coalesce(row_number() OVER (PARTITION BY d.document_id ORDER BY dd.line_index), 1) AS line_index, CASE WHEN fresh THEN 'M-' || d.document_id ELSE d.document_number END AS "문서번호",
 CASE WHEN NOT conflict THEN CASE WHEN fresh AND d.document_id % 2 = 0 THEN 'EUR' ELSE d.currency END END AS "통화", CAST(approved AS VARCHAR) AS approved,
 CASE WHEN list_contains(document_profiles, 'return_document') THEN 'return_note' END AS document_subtype, CASE WHEN dd.document_id IS NOT NULL THEN CAST(part_key AS VARCHAR) END AS internal_item_code
 FROM (SELECT *, NOT review_required AND coalesce(mapping_at >= confirmed_at, false) AS fresh FROM rcp2) d LEFT JOIN dd USING (document_id)""", *EXPORT_VIEWS))
def _(spark, sf):
    """Number and currency of a fresh mapping, and columns of the review, the taxonomy and the item match."""
    mapped = F.col("mapping").withField("fields.document_number", F.concat(F.lit("M-"), "document_id")).withField("fields.currency", F.expr("IF(document_id % 2 = 0, 'EUR', '')"))
    lines = repeated(spark, sf).drop("copy").withColumn("internal_item_code", F.col("part_key"))
    rows = X.to_erp_rows(receipts(spark, sf).withColumn("mapping", mapped), lines)
    return rows.select("document_id", "line_index", "문서번호", "통화", "approved", "document_subtype", "internal_item_code")


TEMPLATE = [
    {"header": "번호", "source_field": "document_number"}, {"header": "일자", "source_field": "document_date"}, {"header": "공급사", "source_field": "supplier_name"},
    {"header": "품목", "source_field": "line_items.item_name"}, {"header": "수량", "source_field": "line_items.quantity"}, {"header": "총액", "source_field": "total_amount"},
    {"header": "빈칸", "source_field": "__blank__"}, {"header": "사업장", "source_field": "__static__", "static_value": "본사"}, {"header": "상태", "source_field": "review_status"},
]


@query("sk02_apply_template", sql("""SELECT document_number AS "번호", CAST(coalesce(issue_date, extracted_date) AS VARCHAR) AS "일자", coalesce(vendor_name, merchant_name) AS "공급사", item_name AS "품목", CAST(quantity AS VARCHAR) AS "수량",
 CASE WHEN NOT conflict THEN CAST(extracted_amount AS VARCHAR) END AS "총액", '' AS "빈칸", '본사' AS "사업장", CASE WHEN review_required THEN '검토 필요' ELSE '확정 가능' END AS "상태",
 coalesce(nullif(customer_name, ''), vendor_name, merchant_name, '미분류') AS party_tab FROM rcp2 LEFT JOIN dd USING (document_id)""", *EXPORT_VIEWS))
def _(spark, sf):
    return X.apply_template(receipts(spark, sf), repeated(spark, sf).drop("copy"), TEMPLATE)


@query("sk03_party_tabs", sql("""SELECT coalesce(nullif(trim(coalesce(nullif(customer_name, ''), vendor_name, merchant_name)), ''), '미분류') AS party_tab, count(*) AS rows FROM rcp2 LEFT JOIN dd USING (document_id) GROUP BY 1""", *EXPORT_VIEWS))
def _(spark, sf):
    rows = X.apply_template(receipts(spark, sf), repeated(spark, sf).drop("copy"), TEMPLATE)
    return rows.groupBy(F.coalesce(F.nullif(F.trim("party_tab"), F.lit("")), F.lit(X.UNSORTED_PARTY)).alias("party_tab")).agg(F.count("*").alias("rows"))


@query("sk04_canonical_json")
def _(spark, sf):
    return X.to_canonical_json(receipts(spark, sf), repeated(spark, sf).drop("copy"))


@query("sk04_json_fragments", sql("""SELECT d.document_id, 0::BIGINT AS part, 0::BIGINT AS line, document_number AS text, CAST(extracted_amount AS DOUBLE) AS amount FROM rcp2 d
 UNION ALL SELECT document_id, (n - 1) // 2 + 1, n, item_name, CAST(supply_amount AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_index) AS n FROM dd SEMI JOIN rcp2 USING (document_id))
 UNION ALL SELECT d.document_id, (coalesce(n, 0) + 1) // 2 + 1, NULL, ']}', NULL FROM rcp2 d LEFT JOIN (SELECT document_id, count(*) AS n FROM dd GROUP BY document_id) USING (document_id)""", *EXPORT_VIEWS))
def _(spark, sf):
    """Fragments of two lines each, read back: the head, every line with its place, the end."""
    parts = X.to_json_fragments(receipts(spark, sf), repeated(spark, sf).drop("copy"), lines_per_part=2)
    kind = F.when(F.col("part") == 0, "head").when(F.col("json") == "]}", "tail").otherwise("lines")
    head = F.from_json(F.concat("json", F.lit("]}")), "document struct<document_number string, total string>")
    lines = F.from_json(F.concat(F.lit("["), F.regexp_replace("json", "^,", ""), F.lit("]")), "array<struct<item_name string, supply_amount string>>")
    row = lambda line, text, amount: F.struct(line.cast("long").alias("line"), text.alias("text"), amount.cast("double").alias("amount"))
    none = F.lit(None).cast("string")
    rows = (
        F.when(kind == "head", F.array(row(F.lit(0), head["document"]["document_number"], head["document"]["total"])))
        .when(kind == "tail", F.array(row(none, F.col("json"), none)))
        .otherwise(F.transform(lines, lambda v, i: row((F.col("part") - 1) * 2 + i + 1, v["item_name"], v["supply_amount"]))))
    return parts.select("document_id", "part", F.explode(rows).alias("r")).select("document_id", "part", "r.*")


@query("sk06_blocked_documents", sql("SELECT document_id, title, processing_status FROM docs WHERE processing_status <> 'confirmed'", DOCS))
def _(spark, sf):
    return X.blocked_documents(V.documents(spark, sf))


@query("qg13_validate_tax_invoice", sql("""SELECT document_id, array_to_string(list_filter([CASE WHEN document_type <> 'invoice' THEN '전자세금계산서 XML 초안은 인보이스/세금계산서 문서만 지원합니다.' END,
 CASE WHEN coalesce(vendor_name, merchant_name) IS NULL THEN '공급업체 필드가 필요합니다.' END, CASE WHEN nullif(customer_name, '') IS NULL THEN '고객사 필드가 필요합니다.' END, CASE WHEN document_number IS NULL THEN '계산서번호 필드가 필요합니다.' END,
 CASE WHEN coalesce(issue_date, extracted_date) IS NULL THEN '발행일 필드가 필요합니다.' END, CASE WHEN subtotal IS NULL THEN '공급가액 필드가 필요합니다.' END, CASE WHEN tax IS NULL THEN '세액 필드가 필요합니다.' END, CASE WHEN extracted_amount IS NULL THEN '합계금액 필드가 필요합니다.' END,
 CASE WHEN subtotal + tax <> extracted_amount THEN '공급가액 + 세액이 합계금액과 일치하지 않습니다.' END, CASE WHEN abs(s - extracted_amount) > 0.01 THEN '품목 합계가 문서 총액과 일치하지 않습니다.' END,
 CASE WHEN n IS NULL THEN '품목 목록이 필요합니다.' END], lambda x: x IS NOT NULL), '|') AS errors FROM docs LEFT JOIN (SELECT document_id, sum(line_total) AS s, count(*) AS n FROM lns GROUP BY document_id) USING (document_id)""", DOCS, LNS))
def _(spark, sf):
    return X.validate_tax_invoice(V.documents(spark, sf), V.lines(spark, sf))
