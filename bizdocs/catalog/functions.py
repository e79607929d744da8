"""Function families over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizdocs.catalog.browse import LEAF, sql_category, sql_label
from bizdocs.catalog.registry import query
from bizdocs.catalog.twins import DOCS, LNP, LNS, SLIPS, sql
from bizdocs.functions import dates as D
from bizdocs.functions import numbers as N
from bizdocs.functions import text as T
from bizdocs.sources import views as V


def _replace_chain(expr: str, words) -> str:
    for a, b in words:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


def _pattern_chain(expr: str, patterns) -> str:
    for p, r in patterns:
        p = p.replace("(?U)", "").replace("'", "''")
        r = r.replace("$1", "\\1").replace("$2", "\\2")
        expr = f"regexp_replace({expr}, '{p}', '{r}', 'g')"
    return expr


def low(e: str) -> str:
    return f"trim(lower(coalesce(CAST({e} AS VARCHAR), '')))"


def strip(e: str, keep: str = "0-9a-z가-힣") -> str:
    return f"regexp_replace({e}, '[^{keep}]+', '', 'g')"


def sql_item(e: str) -> str:
    return strip(_pattern_chain(_replace_chain(low(e), T.MATCH_WORDS), T.MATCH_PATTERNS))


def sql_item_search(e: str) -> str:
    return strip(_pattern_chain(_replace_chain(low(e), T.SEARCH_WORDS), T.SEARCH_PATTERNS))


def sql_spec(e: str) -> str:
    return strip(_pattern_chain(f"replace(replace({low(e)}, '×', 'x'), '*', 'x')", [(r"(\d+)\.0+t\b", "$1t")]), "0-9a-z가-힣x.")


def sql_label_key(e: str) -> str:
    return f"regexp_replace({low(e)}, '[\\s:/._·\\-]+', '', 'g')"


def sql_party(e: str) -> str:
    return strip(f"replace(regexp_replace({low(e)}, '^\\(?주\\)?', ''), '㈜', '')")


def sql_value(e: str) -> str:
    return strip(low(e))


ITEMS = sql_items = "SELECT document_id, line_no, part_key, {} FROM lnp"


def items(name: str, spark_cols, sql_cols: str):
    """A per-line function check on names, specs and codes."""

    @query(name, sql(ITEMS.format(sql_cols), LNP))
    def _(spark, sf):
        return V.lines(spark, sf, with_part=True).select("document_id", "line_no", "part_key", *spark_cols())


items("fn01_normalize_item_text", lambda: [T.normalize_item_text("item_name").alias("k")], f"{sql_item('item_name')} AS k")
items("fn02_normalize_item_text_search", lambda: [T.normalize_item_text_search("item_name").alias("k")], f"{sql_item_search('item_name')} AS k")
items("fn03_normalize_spec", lambda: [T.normalize_spec("specification").alias("k"), T.normalize_spec_search("specification").alias("k2")],
      f"{sql_spec('specification')} AS k, {strip(_pattern_chain(low('specification'), [(chr(40) + chr(92) + 'd+)' + chr(92) + '.0t' + chr(92) + 'b', '$1t')]), '0-9a-z가-힣.')} AS k2")
THICK = f"regexp_extract({sql_item('item_name')}, '(\\d+(?:\\.\\d+)?)t', 1)"
GRADE = "CASE " + " ".join(f"WHEN regexp_matches({sql_item('item_name')}, '{p}') THEN '{g}'" for g, p in T.GRADE_PATTERNS) + " END"
items("fn24_thickness_grade", lambda: [T.thickness("item_name").alias("thickness"), T.material_grade("item_name").alias("grade")],
      f"CASE WHEN {THICK} <> '' THEN regexp_replace(regexp_replace({THICK}, '0+$', ''), '\\.$', '') || 't' END AS thickness, {GRADE} AS grade")


def customers(name: str, text_spark: str, text_sql: str, spark_cols, sql_cols: str):
    """A function check on text rendered from each customer row."""

    @query(name, f"SELECT c_custkey, {sql_cols} FROM (SELECT *, {text_sql} AS t FROM customer)")
    def _(spark, sf):
        return V.table(spark, sf, "customer").select("*", F.expr(text_spark).alias("t")).select("c_custkey", *spark_cols())


customers("fn04_normalizers", "concat(' (주)', c_mktsegment, ' / ', c_name, '㈜ : A·B')", "' (주)' || c_mktsegment || ' / ' || c_name || '㈜ : A·B'",
          lambda: [T.normalize_label("t").alias("label"), T.normalize_party("t").alias("party"), T.normalize_value("t").alias("value"),
                   T.normalize_for_type(F.when(F.col("c_nationkey") < 10, "party").otherwise("item"), "t").alias("typed")],
          f"{sql_label_key('t')} AS label, {sql_party('t')} AS party, {sql_value('t')} AS value, CASE WHEN c_nationkey < 10 THEN {sql_party('t')} ELSE {sql_item('t')} END AS typed")
AMOUNT_S = "concat('잔액 ', format_number(CAST(c_acctbal AS DECIMAL(18,2)), 2), ' 원')"
AMOUNT_D = "'잔액 ' || format('{:,.2f}', c_acctbal) || ' 원'"
customers("fn07_loose_decimal", AMOUNT_S, AMOUNT_D, lambda: [N.loose_decimal("t").alias("v")], "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS v")
customers("fn08_strict_decimal",
          "concat(CASE WHEN c_mktsegment = 'BUILDING' THEN '약 ' ELSE ' ₩' END, format_number(CAST(c_acctbal AS DECIMAL(18,2)), 2), '원')", "''",
          lambda: [N.strict_decimal("t").alias("v")], "CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS v")
customers("fn09_digits_decimal", "concat('USD ', format_number(CAST(c_acctbal AS DECIMAL(18,2)), 2), ' (', c_mktsegment, ')')", "''",
          lambda: [N.digits_decimal("t").alias("v")], "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS v")
customers("fn10_business_decimal",
          """CASE c_mktsegment WHEN 'BUILDING' THEN concat('₩', replace(format_number(c_custkey + 1000000, 0), ',', '.')) WHEN 'MACHINERY' THEN concat('qty 12 x ', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING))
             WHEN 'FURNITURE' THEN '1997-05-28' ELSE format_number(CAST(c_acctbal AS DECIMAL(18,2)), 2) END""", "''",
          lambda: [N.business_decimal("t").alias("v")],
          """CASE c_mktsegment WHEN 'BUILDING' THEN CAST(c_custkey + 1000000 AS DOUBLE) WHEN 'MACHINERY' THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE)
             WHEN 'FURNITURE' THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS v""")
BOOL = "CASE c_mktsegment WHEN 'BUILDING' THEN ' 사용 ' WHEN 'MACHINERY' THEN 'N' WHEN 'FURNITURE' THEN '' WHEN 'HOUSEHOLD' THEN 'maybe' END"
customers("fn11_parse_bool", BOOL, BOOL, lambda: [T.parse_bool("t").alias("truthy"), T.parse_bool_search("t").alias("not_falsy")],
          "(t IS NULL OR t = '' OR lower(trim(t)) IN ('1','true','yes','y','활성','사용','사용중')) AS truthy, (t IS NULL OR lower(trim(t)) NOT IN ('false','0','no','n','비활성')) AS not_falsy")
customers("fn17_money", "''", "''", lambda: [N.money(F.col("c_acctbal").cast("decimal(18,2)") * F.lit("0.125").cast("decimal(4,3)")).alias("v")],
          """CAST(CASE WHEN (u - floor(u / 1000) * 1000) > 500 OR ((u - floor(u / 1000) * 1000) = 500 AND CAST(floor(u / 1000) AS BIGINT) % 2 <> 0) THEN floor(u / 1000) + 1 ELSE floor(u / 1000) END AS DOUBLE) / 100 AS v""".replace("u", "(CAST(round(c_acctbal * 100) AS BIGINT) * 125)"))
customers("fn25_split_quantity", "concat(' ', format_number(c_custkey + 1000, 0), CASE c_mktsegment WHEN 'BUILDING' THEN ' EA' WHEN 'MACHINERY' THEN '박스' ELSE ' / box' END)", "''",
          lambda: [N.split_quantity("t")["quantity"].alias("quantity"), N.split_quantity("t")["unit"].alias("unit")],
          "CAST(c_custkey + 1000 AS DOUBLE) AS quantity, CASE c_mktsegment WHEN 'BUILDING' THEN 'EA' WHEN 'MACHINERY' THEN '박스' ELSE 'box' END AS unit")
CURRENCY = """CASE c_mktsegment WHEN 'BUILDING' THEN '통화: USD
합계 100원' WHEN 'MACHINERY' THEN 'price $ 100 and 20원' WHEN 'FURNITURE' THEN '단가 100' WHEN 'HOUSEHOLD' THEN concat('pay $', c_custkey) ELSE c_name END"""
customers("fn26_currency", CURRENCY, "''", lambda: [N.currency("t").alias("currency")],
          "CASE c_mktsegment WHEN 'BUILDING' THEN 'USD' WHEN 'MACHINERY' THEN 'KRW' WHEN 'FURNITURE' THEN 'KRW' WHEN 'HOUSEHOLD' THEN 'USD' END AS currency")
customers("fn31_price_unit_score", "''", "''",
          lambda: [N.price_score(F.when(F.col("c_nationkey") > 0, F.col("c_acctbal").cast("decimal(18,2)")), F.col("c_custkey").cast("decimal(18,2)")).alias("price"),
                   N.unit_score(F.when(F.col("c_nationkey") < 5, F.lit(" EA")).when(F.col("c_nationkey") < 10, F.lit("box")), F.lit("ea ")).alias("unit")],
          """CASE WHEN c_nationkey = 0 OR c_custkey = 0 THEN 0.5 WHEN abs(c_acctbal - c_custkey) / c_custkey <= 0.02 THEN 1.0 WHEN abs(c_acctbal - c_custkey) / c_custkey <= 0.10 THEN 0.7 ELSE 0.0 END::DOUBLE AS price,
             CASE WHEN c_nationkey < 5 THEN 1.0 WHEN c_nationkey < 10 THEN 0.0 ELSE 0.5 END::DOUBLE AS unit""")
customers("fn32_number_tokens", "concat('-', c_custkey, ' of 1,234.50 / ', c_mktsegment)", "'-' || c_custkey || ' of 1,234.50 / ' || c_mktsegment",
          lambda: [N.number_tokens("t").alias("tokens"), N.is_amount_like(F.col("c_custkey").cast("string")).alias("n"), N.is_amount_like("c_mktsegment").alias("w"),
                   N.is_amount_like(F.when(F.col("c_nationkey") > 9, "1,200.5A").otherwise("O0C")).alias("c")],
          "array_to_string(regexp_extract_all(t, '-?\\d[\\d,]*(?:\\.\\d+)?'), '|') AS tokens, true AS n, false AS w, true AS c")
customers("fl11_usable_party", "CASE c_mktsegment WHEN 'BUILDING' THEN ' 12-3 / 4 ' WHEN 'MACHINERY' THEN 'x' WHEN 'FURNITURE' THEN NULL ELSE c_name END",
          "CASE c_mktsegment WHEN 'BUILDING' THEN ' 12-3 / 4 ' WHEN 'MACHINERY' THEN 'x' WHEN 'FURNITURE' THEN NULL ELSE c_name END",
          lambda: [T.usable_party("t").alias("usable")],
          "(length(trim(coalesce(t, ''))) >= 2 AND NOT regexp_full_match(trim(coalesce(t, '')), '[-_/0-9., ]+')) AS usable")


@query("fn05_category", sql(f"SELECT document_id, {sql_category('category')} AS whole, {LEAF} AS leaf, {sql_label(LEAF)} AS label FROM docs", DOCS))
def _(spark, sf):
    return V.documents(spark, sf).select(
        "document_id", T.normalize_category("category").alias("whole"), T.category_leaf("category").alias("leaf"), T.display_label(T.category_leaf("category")).alias("label"))


def _sql_tags() -> str:
    ctx = sql_category("category")
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in T.TAG_CONFLICTS.items())
    blocked = f"CASE {ctx} {arms} ELSE {T.DEFAULT_TAG_CONFLICTS!r} END"
    kept = f"list_filter([{sql_category('document_type')}, {sql_category('mk')}, 'time_sensitive', 'other'], lambda t: NOT list_contains({blocked}, t))"
    timed = f"(key_dates IS NOT NULL OR coalesce({ctx} IN ('meeting_notice', 'policy_notice'), false))"
    kept = f"CASE WHEN {timed} THEN {kept} ELSE list_filter({kept}, lambda t: t <> 'time_sensitive') END"
    return f"array_to_string(CASE WHEN list_contains({kept}, document_type) THEN {kept} ELSE list_prepend(document_type, {kept}) END, '|')"


@query("fn06_clean_tags", sql(f"SELECT document_id, {_sql_tags()} AS tags FROM (SELECT *, tags[2] AS mk FROM docs)", DOCS))
def _(spark, sf):
    return V.documents(spark, sf).select(
        "document_id", T.clean_tags("tags", F.col("category"), F.lit(None).cast("string"), F.col("document_type"), key_dates=F.col("key_dates")).alias("tags"))


@query("fn12_split_aliases", "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS aliases FROM part")
def _(spark, sf):
    text = F.expr("concat(p_name, ' | ', p_brand, ';', p_type, ', ,')")
    return V.table(spark, sf, "part").select("p_partkey", T.split_aliases(text).alias("aliases"))


@query("fn13_extract_date", sql("""SELECT slip_id, CAST(coalesce(extracted_date, CASE WHEN document_number IS NOT NULL THEN CAST(strptime(string_split(document_number, '-')[2], '%Y%m%d') AS DATE) END, due_date) AS VARCHAR) AS date FROM slips""", DOCS, LNP, SLIPS))
def _(spark, sf):
    return V.slips(spark, sf).select("slip_id", D.extract_date("text").alias("date"))


@query("fn14_date_list", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderstatus = 'F' THEN '|2024-03-05' ELSE '' END AS dates FROM orders")
def _(spark, sf):
    text = F.expr("""concat('due ', date_format(o_orderdate, 'yyyy-M-d'), ', ship ', date_format(o_orderdate, 'M/d/yyyy'), ', again ', date_format(o_orderdate, 'MMMM d, yyyy'),
        ', bad 13/45/1999', CASE WHEN o_orderstatus = 'F' THEN ' then Mar. 5, 2024' ELSE '' END)""")
    return V.table(spark, sf, "orders").select("o_orderkey", D.date_list(text).alias("dates"))


@query("fn15_repair_date", """SELECT o_orderkey, CAST(list_filter(list_transform(flatten(list_transform(ms, lambda m: list_transform(ds, lambda x: '20' || yy || '-' || m || '-' || x))), lambda s: TRY_CAST(s AS DATE)), lambda v: v IS NOT NULL)[1] AS VARCHAR) AS date FROM (
 SELECT *, list_filter([mp, CASE WHEN mp[1] IN ('8','9','6','5') THEN '0' || mp[2] END, CASE WHEN mp[2] IN ('8','9','6','5') THEN mp[1] || '0' END], lambda v: CAST(v AS INT) BETWEEN 1 AND 12) AS ms,
  list_filter([dp, CASE WHEN dp[1] IN ('8','9','6','5') THEN '0' || dp[2] END, CASE WHEN dp[2] IN ('8','9','6','5') THEN dp[1] || '0' END], lambda v: CAST(v AS INT) BETWEEN 1 AND 31) AS ds FROM (
  SELECT o_orderkey, strftime(o_orderdate, '%y') AS yy, replace(strftime(o_orderdate, '%m'), '0', '8') AS mp,
   CASE WHEN o_orderstatus = 'F' THEN replace(strftime(o_orderdate, '%d'), '0', '6') ELSE strftime(o_orderdate, '%d') END AS dp FROM orders))""")
def _(spark, sf):
    text = F.expr("""concat('20', date_format(o_orderdate, 'yy'), replace(date_format(o_orderdate, 'MM'), '0', '8'),
        CASE WHEN o_orderstatus = 'F' THEN replace(date_format(o_orderdate, 'dd'), '0', '6') ELSE date_format(o_orderdate, 'dd') END)""")
    return V.table(spark, sf, "orders").select("o_orderkey", D.repair_date(text).alias("date"))


@query("fn16_month_range", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS start, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS stop, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    orders = V.table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("start")).agg(F.count("*").alias("n"))
    years = orders.agg(F.year(F.min("start")).alias("lo"), F.year(F.max("start")).alias("hi")).first()
    months = [D.resolve_range(year=y, month=m)[:2] for y in range(years["lo"], years["hi"] + 1) for m in range(1, 13)]
    return orders.join(spark.createDataFrame(months, "start date, stop date"), "start")


@query("fn18_amount_checks", sql("""SELECT document_id, coalesce(abs(subtotal * 1.1 - extracted_amount) <= greatest(1, abs(extracted_amount) * 0.02), false) AS is_close,
 coalesce(abs(subtotal + tax - extracted_amount) <= greatest(1, abs(extracted_amount) * 0.02), false) AS triplet FROM docs""", DOCS))
def _(spark, sf):
    docs = V.documents(spark, sf)
    return docs.select("document_id", N.amount_close(F.col("subtotal") * F.lit("1.1").cast("decimal(2,1)"), "extracted_amount").alias("is_close"),
                       N.triplet_ok("subtotal", "tax", "extracted_amount").alias("triplet"))


@query("fn27_keyword_hits", """SELECT doc_id, array_to_string(list_slice(list_filter(['the', 'und', 'que', 'of', 'tion', 'der', 'les'], lambda w: contains(lower(text), w)), 1, 3), '|') AS hits FROM documents""")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.keyword_hits("text", ["the", "und", "que", "of", "tion", "der", "les"], 3).alias("hits"))


CONTACT_SQL = "(https?://\\S+|www\\.\\S+|[\\w.+-]+@[\\w-]+\\.[\\w.-]+|linkedin\\.com/\\S+|github\\.com/\\S+)"


@query("fn28_contact_links", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i){CONTACT_SQL}', 1), '|') AS links FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.contact_links("text").alias("links"))


@query("fn30_sanitize", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    dirty = V.table(spark, sf, "conversations").withColumn("text", F.concat(F.lit("\u0000"), "text", F.lit("\u0000")))
    return T.sanitize(dirty)


@query("se04_merge_flags", sql("SELECT document_id, line_no, part_key, array_to_string(list_filter(list_concat(review_flags, validation_warnings, ['invalid_line_total']), lambda v, i: list_position(list_concat(review_flags, validation_warnings, ['invalid_line_total']), v) = i), '|') AS flags FROM lns", LNS))
def _(spark, sf):
    return V.lines(spark, sf).select("document_id", "line_no", "part_key", T.merge_flags("review_flags", "validation_warnings", F.array(F.lit("invalid_line_total"))).alias("flags"))


@query("se06_has_profile", sql("SELECT document_id, list_has_any(document_profiles, ['no_price_document', 'return_document']) AS free, array_to_string(list_intersect(document_profiles, ['no_price_document', 'return_document']), '|') AS shared FROM docs", DOCS))
def _(spark, sf):
    profiles = F.col("taxonomy.document_profiles")
    return V.documents(spark, sf).select(
        "document_id", T.has_profile(profiles, "no_price_document", "return_document").alias("free"),
        F.array_intersect(profiles, F.array(F.lit("no_price_document"), F.lit("return_document"))).alias("shared"))
