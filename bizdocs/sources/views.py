"""Domain views over the driver's star-schema tables.

Every view is a narrow projection (plus at most key joins) of the base tables,
so column pruning and filter pushdown reach the Parquet scans. None of them
needs a window: ``line_index`` is packed from the line's own columns, which
keeps a hot order from being gathered into one task just to number its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Order priority -> document type and number prefix.
DOCUMENT_TYPES = {
    "1-URGENT": ("purchase_order", "PO"),
    "2-HIGH": ("quotation", "QT"),
    "3-MEDIUM": ("transaction_statement", "TS"),
    "4-NOT SPECIFIED": ("delivery_note", "DN"),
    "5-LOW": ("invoice", "INV"),
}


def _case(column: str, pairs: dict, pick) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{pick(v)}'" for k, v in pairs.items())
    return f"CASE {column} {arms} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as it lies there; pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows: ``orders`` with its ``customer``."""
    base = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), _eq("o_custkey", "c_custkey"), "left")
        .selectExpr(
            "*",
            "CAST(o_orderdate AS DATE) AS d",
            "day(o_orderdate) AS dd",
            "month(o_orderdate) AS mm",
            "date_format(o_orderdate, 'yyyyMMdd') AS ymd",
            "CAST(o_totalprice AS DECIMAL(18,2)) AS amt",
            "CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.1BD, 2) AS DECIMAL(18,2)) AS vat",
            f"{_case('o_orderpriority', DOCUMENT_TYPES, lambda v: v[0])} AS document_type",
            f"{_case('o_orderpriority', DOCUMENT_TYPES, lambda v: v[1])} AS prefix",
        )
    )
    fields = """named_struct(
        'customer_name', CASE WHEN dd IN (1,3,5,7,9) THEN concat('매핑 ', c_name) END,
        'vendor_name', CAST(NULL AS STRING),
        'issue_date', CASE WHEN dd <> 4 THEN CAST(date_add(d, 1) AS STRING) END,
        'document_total', CASE WHEN dd = 2 THEN '0' WHEN dd = 3 THEN NULL ELSE concat('₩', CAST(amt AS STRING)) END,
        'payment_total', CAST(NULL AS STRING),
        'estimated_total', CASE WHEN dd = 3 THEN '견적 미정' END,
        'krw_converted', CAST(NULL AS STRING),
        'total_usd', CAST(NULL AS STRING))"""
    mapped = "o_orderstatus = 'F' AND dd <= 10"
    return base.selectExpr(
        "o_orderkey AS document_id",
        "document_type",
        "CASE WHEN dd <> 28 THEN concat(prefix, '-', ymd, '-', CAST(o_orderkey AS STRING)) END AS document_number",
        "concat(document_type, '_', ymd, CASE WHEN dd > 15 THEN '.PDF' ELSE '.pdf' END) AS original_filename",
        "CASE WHEN dd = 31 THEN NULL WHEN o_orderstatus = 'F' THEN 'pdf' WHEN o_orderstatus = 'O' THEN 'xlsx' ELSE 'jpg' END AS source_file_type",
        "concat(document_type, ' ', c_name) AS title",
        "CASE WHEN dd IN (5,6) THEN NULL ELSE concat(c_mktsegment, ' 상사') END AS vendor_name",
        "CASE WHEN dd = 13 THEN NULL WHEN dd = 14 THEN '' WHEN dd = 15 THEN '  ' ELSE c_name END AS customer_name",
        "CASE WHEN dd = 13 AND mm <= 6 THEN 'Walk-in' END AS merchant_name",
        "CASE WHEN dd <> 21 THEN d END AS issue_date",
        "CASE WHEN NOT (dd = 21 AND mm <= 3) THEN d END AS extracted_date",
        "CASE WHEN NOT (o_orderstatus = 'P' AND dd <= 10) THEN date_add(d, 30) END AS due_date",
        "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS created_at",
        "timestampadd(SECOND, o_custkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY) AS updated_at",
        "CASE WHEN c_nationkey < 5 THEN 'USD' WHEN c_nationkey > 5 THEN 'KRW' END AS currency",
        "CASE WHEN mm = 2 THEN NULL WHEN dd = 9 THEN CAST(0 AS DECIMAL(18,2)) ELSE amt END AS extracted_amount",
        "CASE WHEN dd = 11 THEN NULL ELSE CAST(amt - vat AS DECIMAL(18,2)) END AS subtotal",
        "CASE WHEN dd = 12 THEN NULL ELSE vat END AS tax",
        """CASE WHEN o_orderstatus = 'F' THEN 'confirmed'
                WHEN o_orderstatus = 'O' THEN CASE WHEN dd <= 2 THEN 'completed' WHEN dd = 3 THEN 'processing'
                                                   WHEN dd = 4 THEN 'queued' ELSE 'ready' END
                WHEN dd = 30 THEN 'failed' ELSE 'needs_review' END AS processing_status""",
        "(o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')) AS review_required",
        "(c_mktsegment = 'MACHINERY' AND dd <= 3) AS is_favorite",
        """CASE c_mktsegment WHEN 'BUILDING' THEN 'Purchase Order' WHEN 'AUTOMOBILE' THEN 'document > Repair Service Receipt'
                WHEN 'MACHINERY' THEN 'utilities' WHEN 'FURNITURE' THEN 'delivery_note' END AS category""",
        "array(document_type, lower(c_mktsegment), 'time-sensitive', 'other', document_type) AS tags",
        """CASE WHEN dd <> 20 THEN array(CAST(date_add(d, 30) AS STRING), concat('ship ', CAST(date_add(d, 7) AS STRING)), 'n/a') END AS key_dates""",
        "CAST(pmod(CAST(amt * 100 AS BIGINT), 100) * 0.01BD AS DECIMAL(4,3)) AS confidence_score",
        "CASE o_orderstatus WHEN 'F' THEN 'pdf_text' WHEN 'O' THEN 'xlsx_direct' ELSE 'image_ocr' END AS extraction_method",
        "named_struct('approved', o_orderstatus = 'O' AND dd BETWEEN 20 AND 25) AS review",
        """named_struct(
             'document_subtype', CASE WHEN o_orderpriority = '2-HIGH' AND dd = 17 THEN 'return_note' END,
             'document_profile', CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND mm = 7 THEN 'no_price_document'
                                      WHEN o_orderpriority = '5-LOW' THEN 'tax_document' END,
             'document_profiles', CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND mm <= 6 THEN array('no_price_document', 'delivery')
                                       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN array('delivery')
                                       WHEN o_orderpriority = '5-LOW' THEN array('tax_document')
                                       WHEN o_orderpriority = '2-HIGH' AND dd = 17 THEN array('return_document')
                                       WHEN o_orderpriority = '2-HIGH' AND dd = 18 THEN array('inventory_movement_document')
                                       WHEN o_orderpriority = '2-HIGH' AND dd = 19 THEN array('foreign_currency_document')
                                       ELSE array() END,
             'amount_required', CASE WHEN o_orderpriority = '3-MEDIUM' AND mm = 12 THEN false END) AS taxonomy""",
        f"""named_struct(
             'created_at', CASE WHEN {mapped} THEN CAST(o_orderdate AS TIMESTAMP) + (CASE WHEN dd <= 5 THEN INTERVAL 61 MINUTE ELSE INTERVAL 59 MINUTE END) END,
             'confirmed_at', CASE WHEN {mapped} THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 60 MINUTE END,
             'category', CASE WHEN {mapped} THEN 'invoice' END,
             'fields', {fields}) AS mapping""",
    )


def _eq(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)


LINE_COLUMNS = [
    "l_orderkey AS document_id",
    "l_linenumber AS line_no",
    # linenumber | partkey | price in cents, packed so that one BIGINT orders a document's lines
    "shiftleft(CAST(l_linenumber AS BIGINT), 59) + shiftleft(l_partkey, 24) + CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS line_index",
    "l_partkey AS part_key",
    "l_suppkey AS supp_key",
    "CASE WHEN NOT (tx = 0.08BD AND l_returnflag = 'N') THEN CAST(l_quantity AS DECIMAL(18,2)) END AS quantity",
    "CASE WHEN NOT (tx = 0.04BD AND dc = 0.04BD) THEN CAST(CAST(CAST(ext * 100 AS BIGINT) div CAST(l_quantity AS BIGINT) AS DECIMAL(18,0)) * 0.01BD AS DECIMAL(18,2)) END AS unit_price",
    "CASE WHEN NOT (dc = 0.00BD AND l_returnflag = 'R') THEN sup END AS supply_amount",
    "CAST(round(sup * tx, 2) AS DECIMAL(18,2)) AS tax_amount",
    "CASE WHEN NOT (dc = 0.00BD AND tx = 0.02BD) THEN CAST(sup + CAST(round(sup * tx, 2) AS DECIMAL(18,2)) AS DECIMAL(18,2)) END AS line_total",
    "CASE l_linestatus WHEN 'O' THEN 'EA' ELSE 'BOX' END AS unit",
    """CASE WHEN dc = 0.10BD AND l_returnflag = 'A' THEN array('invalid_line_amount')
            WHEN tx = 0.07BD THEN array('handwritten_requires_review', 'ai_parsed_document_table_review_required')
            ELSE array() END AS review_flags""",
    """CASE WHEN tx = 0.08BD AND dc = 0.05BD THEN array('invalid_line_total')
            WHEN tx = 0.06BD THEN array('option_amount_not_confirmed', 'untrusted_ocr_amount')
            ELSE array() END AS validation_warnings""",
    "CASE WHEN day(l_shipdate) = 1 THEN '단가 별도 협의' END AS note",
    "CAST(l_shipdate AS DATE) AS ship_date",
    "l_returnflag AS return_flag",
]


def lines(spark: SparkSession, sf_dir: str, with_part: bool = False) -> DataFrame:
    """Flat line items; ``with_part`` joins the part for names, codes and specs."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS ext",
        "CAST(l_discount AS DECIMAL(4,2)) AS dc",
        "CAST(l_tax AS DECIMAL(4,2)) AS tx",
        "CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1BD - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS sup",
    )
    if not with_part:
        return li.selectExpr(*LINE_COLUMNS)
    parts = table(spark, sf_dir, "part")
    return li.join(parts, _eq("l_partkey", "p_partkey"), "left").selectExpr(
        *LINE_COLUMNS,
        """CASE WHEN p_size = 50 THEN NULL
                WHEN p_type = 'ECONOMY' THEN concat('STS 3O4 ', p_name, ' ', p_size, '.0T')
                WHEN p_type = 'SMALL' THEN concat('스테인리스 304 ', p_name)
                WHEN p_type = 'MEDIUM' THEN concat('철판 ', p_name, ' ', p_size, 't')
                WHEN p_type = 'LARGE' THEN concat(p_name, ' (Lot-', p_size, ')')
                WHEN p_type = 'PROMO' THEN concat('SUS_304 ', p_name)
                ELSE p_name END AS item_name""",
        "CASE WHEN p_size <> 49 THEN concat(p_size, ' × ', p_size * 2, '*3.0T') END AS specification",
        "concat('IT-', lpad(CAST(l_partkey AS STRING), 9, '0')) AS item_code",
        """CASE l_returnflag WHEN 'A' THEN concat('it-', lpad(CAST(l_partkey AS STRING), 9, '0'))
                WHEN 'N' THEN substring(concat('IT-', lpad(CAST(l_partkey AS STRING), 9, '0')), 1, 11)
                END AS document_item_code""",
    )


def item_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS item_id",
        "concat('IT-', lpad(CAST(p_partkey AS STRING), 9, '0')) AS internal_item_code",
        "p_name AS item_name",
        "concat(p_size, 'x', p_size * 2, 'x3t') AS spec",
        "CASE WHEN p_size % 2 = 0 THEN 'EA' ELSE 'BOX' END AS unit",
        "p_type AS category",
        "CAST(p_retailprice AS DECIMAL(18,2)) AS standard_price",
        "p_size <> 13 AS active",
        "array(concat(p_name, ' ', p_brand), concat(p_brand, '-', CAST(p_partkey AS STRING))) AS aliases",
    )


def item_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias records: one per part, inactive for the largest sizes."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS item_id",
        "concat(p_brand, ' ', p_name) AS alias_name",
        "CASE WHEN p_size > 25 THEN concat(p_size, 'x', p_size * 2) END AS alias_spec",
        "p_size <= 45 AS active",
    )


def slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered text document per line item: a title, labelled header lines,
    a pipe table with one row, and labelled totals. Row-local, so no grouping."""
    header = documents(spark, sf_dir).selectExpr(
        "document_id", "document_type", "document_number", "vendor_name", "customer_name",
        "extracted_date", "due_date", "currency", "review_required",
    )
    title = """CASE document_type WHEN 'purchase_order' THEN '발주서' WHEN 'quotation' THEN '견적서'
        WHEN 'transaction_statement' THEN '거래명세서' WHEN 'delivery_note' THEN '납품서' ELSE '세금계산서' END"""
    text = f"""concat_ws('\\n',
        {title},
        concat('문서번호: ', document_number),
        concat('발행일: ', CASE WHEN unit = 'EA' THEN CAST(extracted_date AS STRING) ELSE date_format(extracted_date, 'yyyy.MM.dd') END),
        '  ',
        concat('납기일 : ', date_format(due_date, 'yyyyMMdd')),
        concat('공급업체: ', vendor_name),
        concat('고객사: ', customer_name),
        concat('통화: ', currency),
        '품목명 | 규격 | 수량 | 단위 | 단가 | 공급가액 | 세액 | 합계금액',
        concat_ws(' | ', coalesce(item_name, '-'), coalesce(specification, '-'), coalesce(CAST(quantity AS STRING), '-'), unit,
                  coalesce(CAST(unit_price AS STRING), '-'), coalesce(CAST(supply_amount AS STRING), '-'),
                  CAST(tax_amount AS STRING), coalesce(CAST(line_total AS STRING), '-')),
        concat('공급가액 ', coalesce(CAST(supply_amount AS STRING), '-')),
        concat('세액 ', CAST(tax_amount AS STRING)),
        concat('합계 ', coalesce(CAST(line_total AS STRING), '-')),
        CASE WHEN note IS NOT NULL THEN concat('비고: ', note, ' / computed 합계 1.00') END)"""
    return (
        lines(spark, sf_dir, with_part=True)
        .join(header, "document_id", "inner")
        .selectExpr("*", f"{text} AS text",
                    "concat(document_id, '/', line_index) AS slip_id")
    )
