"""The declared document table: a scan that casts, checks and defaults every column and keeps rejected rows with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

# --- fixed values: declared columns as (type, longest text or None) ------------
TEXT_COLUMNS = {
    "original_filename": 255, "stored_file_path": 1024, "mime_type": 100, "source_file_type": 40, "extraction_method": 80, "title": 255, "raw_text": None,
    "currency": 8, "merchant_name": 255, "vendor_name": 255, "customer_name": 255, "document_number": 120, "category": 80, "ai_extraction_notes": None,
    "summary": None, "extraction_provider": 80, "refinement_provider": 80, "provider_chain": 255, "merge_strategy": 120, "workflow_summary": None,
    "urgency_level": 20, "preview_image_path": 1024, "processing_error": None,
}
TYPED_COLUMNS = {
    "extracted_date": "date", "issue_date": "date", "due_date": "date", "extracted_amount": "decimal(12,2)", "subtotal": "decimal(12,2)", "tax": "decimal(12,2)",
    "confidence_score": "decimal(4,3)", "ai_confidence_score": "decimal(4,3)", "review_required": "boolean", "follow_up_required": "boolean", "is_favorite": "boolean",
    "created_at": "timestamp", "updated_at": "timestamp",
}
LIST_COLUMNS = ["low_confidence_fields", "tags", "action_items", "warnings", "key_dates"]
JSON_COLUMNS = ["ingestion_metadata", "line_items", "field_sources", "workflow_metadata"]
DOCUMENT_TYPES = [
    "purchase_order", "quotation", "transaction_statement", "delivery_note", "invoice", "packing_list", "inspection_report", "contract", "general_document",
    "receipt", "notice", "document", "memo", "presentation", "other",
]
PROCESSING_STATUSES = ["uploaded", "queued", "processing", "ready", "needs_review", "confirmed", "completed", "failed"]
ENUM_COLUMNS = {"document_type": DOCUMENT_TYPES, "ai_document_type": DOCUMENT_TYPES, "processing_status": PROCESSING_STATUSES}
REQUIRED_COLUMNS = ["document_id", "original_filename", "stored_file_path", "mime_type"]
DEFAULTS = {"document_type": "general_document", "processing_status": "uploaded", "review_required": False, "follow_up_required": False, "is_favorite": False, "line_items": "[]"}
# ------------------------------------------------------------------------------


def document_schema(id_type: str = "bigint") -> T.StructType:
    """The declared columns. JSON columns are JSON texts."""
    types = {"document_id": id_type, **dict.fromkeys([*TEXT_COLUMNS, *ENUM_COLUMNS, *JSON_COLUMNS], "string"), **TYPED_COLUMNS, **dict.fromkeys(LIST_COLUMNS, "array<string>")}
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in types.items()))


def check_documents(raw: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The declared columns of a raw table, ``reasons`` (empty for a good row) and ``source``, the raw row as JSON.

    Columns are found by name in any case, the first of equal names; missing ones are null, extra ones stay in ``source``.
    A value is rejected if it can't be read as its type, is too long, or is no value of its enumeration; a null takes the
    column's default, and is rejected in a required column. Rejected values are null."""
    given = raw.toDF(*[f"c{i}" for i in range(len(raw.columns))])
    names: dict[str, int] = {}
    for i, name in enumerate(raw.columns):
        names.setdefault(name.strip().lower(), i)
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)

    def text(i: int) -> Column:
        return F.to_json(f"c{i}") if isinstance(given.schema[i].dataType, nested) else F.col(f"c{i}").cast("string")

    out, reasons = [], []
    for field in document_schema(id_type):
        name, to = field.name, field.dataType
        i = names.get(name)
        value, problem = F.lit(None).cast(to), None
        if i is not None:
            t = text(i)
            if given.schema[i].dataType == to:
                value = F.col(f"c{i}")
            elif name in LIST_COLUMNS:
                value = F.from_json(t, to)
            else:
                value = t.try_cast(to)
            bad = value.isNull()
            if name in ENUM_COLUMNS:
                problem, bad = "unknown value", ~value.isin(ENUM_COLUMNS[name])
            elif TEXT_COLUMNS.get(name):
                problem, bad = "too long", F.length(value) > TEXT_COLUMNS[name]
            elif name in JSON_COLUMNS:
                problem, bad = "malformed", F.try_parse_json(t).isNull()
            elif name not in TEXT_COLUMNS:
                problem = "wrong type"
            if problem:
                bad = t.isNotNull() & F.coalesce(bad, F.lit(False))
                reasons.append(F.when(bad, f"{name}: {problem}"))
                value = F.when(~bad, value)
        if name in REQUIRED_COLUMNS:
            reasons.append(F.when(F.lit(True) if i is None else text(i).isNull(), f"{name}: missing"))
        if name in LIST_COLUMNS:
            value = F.coalesce(value, F.array().cast(to))
        elif name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]))
        out.append(value.alias(name))
    found = F.array_compact(F.array(*reasons))
    source = F.to_json(F.struct(*[F.col(f"c{i}").alias(n) for n, i in names.items()]))
    return given.select(*out, found.alias("reasons"), F.when(F.size(found) > 0, source).alias("source"))


def quarantine(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write checked rows once, good and rejected ones into folders of their own: (rows, rejected, counts).

    ``rejected`` holds document_id, reasons and the raw row; ``counts`` the rows read and rejected, observed during the write."""
    seen = Observation()
    ok = F.size("reasons") == 0
    watched = checked.withColumn("ok", ok).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("ok")).alias("rejected"))
    watched.write.mode("overwrite").partitionBy("ok").parquet(path)
    schema = T.StructType([*checked.schema.fields, T.StructField("ok", T.BooleanType())])
    stored = checked.sparkSession.read.schema(schema).parquet(path)
    rows = stored.filter("ok").drop("ok", "reasons", "source")
    return rows, stored.filter("NOT ok").select("document_id", "reasons", "source"), {"rows": 0, "rejected": 0, **seen.get}


def load_documents(spark: SparkSession, path: str, to: str, format: str = "parquet", id_type: str = "bigint", **options) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Read a table of documents in any Spark format, check it and write it to ``to``; see ``quarantine``."""
    return quarantine(check_documents(spark.read.format(format).options(**options).load(path), id_type), to)
