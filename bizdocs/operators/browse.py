"""Search, listing, paging, folders, calendar, notifications and dashboards."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bizdocs.functions.text import category_leaf, display_label, filename_key
from bizdocs.operators.resolve import UNKNOWN_PARTY, present

SEARCH_FIELDS = [
    "title", "summary", "workflow_summary", "merchant_name", "vendor_name", "customer_name",
    "document_number", "raw_text", "original_filename", "category",
]
SORT_FIELDS = ["created_at", "updated_at", "extracted_date", "extracted_amount", "title"]
DUE_LABELS = {
    "purchase_order": "납기일", "delivery_note": "납품일", "invoice": "지급기한",
    "quotation": "유효기간", "transaction_statement": "거래일자",
}
NOTICES = {
    "processing": ("문서 처리 중", "문서 유형 분류와 업무 데이터 추출이 진행 중입니다."),
    "failed": ("처리 실패", "문서를 확인한 뒤 다시 처리하세요."),
    "review": ("검토 필요", "확정 처리 전에 사람이 확인해야 하는 항목이 있습니다."),
    "processed": ("자동 추출 완료", "문서 처리가 완료되어 업무데이터/엑셀 입력용 데이터로 검토할 수 있습니다."),
}


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def search(docs: DataFrame, text: str, lines: DataFrame | None = None) -> DataFrame:
    """AND over whitespace-split terms, OR over the fields, wildcards in a term pass through.

    Lines are searched through their JSON text. Only lines that match some term are
    shuffled, already reduced to one row of flags per document."""
    terms = text.split()
    if not terms:
        return docs
    hit = lambda c, t: F.coalesce(c.cast("string"), F.lit("")).ilike(f"%{t}%")
    fields = [F.col(c) for c in SEARCH_FIELDS if c in docs.columns]
    if lines is None:
        return docs.filter(reduce(lambda a, b: a & b, [_any([hit(c, t) for c in fields]) for t in terms]))
    keep = [c for c in lines.columns if c not in ("document_id", "line_index")]
    flagged = lines.select("document_id", F.to_json(F.struct(*keep)).alias("json"))
    flags = [hit(F.col("json"), t) for t in terms]
    per_doc = (
        flagged.filter(_any(flags)).groupBy("document_id")
        .agg(*[F.bool_or(f).alias(f"_t{i}") for i, f in enumerate(flags)])
    )
    joined = docs.join(per_doc, "document_id", "left")
    cond = [_any([hit(c, t) for c in fields] + [F.coalesce(F.col(f"_t{i}"), F.lit(False))]) for i, t in enumerate(terms)]
    return joined.filter(reduce(lambda a, b: a & b, cond)).select(docs.columns)


def list_documents(docs: DataFrame, *, document_type=None, category=None, source_file_type=None, processing_status=None,
                   is_favorite=None, date_from=None, date_to=None, amount_min=None, amount_max=None) -> DataFrame:
    """Conjunction of the given filters; every one is a plain comparison that can be pushed down."""
    tests = [
        ("document_type", "==", document_type), ("source_file_type", "==", source_file_type),
        ("processing_status", "==", processing_status), ("is_favorite", "==", is_favorite),
        ("extracted_date", ">=", date_from), ("extracted_date", "<=", date_to),
        ("extracted_amount", ">=", amount_min), ("extracted_amount", "<=", amount_max),
    ]
    for name, op, value in tests:
        if value is None:
            continue
        c, v = F.col(name), F.lit(value)
        docs = docs.filter(c == v if op == "==" else c >= v if op == ">=" else c <= v)
    if category:
        docs = docs.filter(F.col("category") == category_leaf(F.lit(category)))
    return docs


def page(df: DataFrame, sort_by: str = "updated_at", order: str = "desc", page: int = 1, size: int = 25, tie: str = "document_id") -> DataFrame:
    """One page; descending puts nulls first, ascending last."""
    if order not in ("asc", "desc"):
        raise ValueError(order)
    key = F.col(sort_by).desc_nulls_first() if order == "desc" else F.col(sort_by).asc_nulls_last()
    return df.orderBy(key, tie).offset((page - 1) * size).limit(size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def recent(df: DataFrame, n: int, by: str = "updated_at", where: Column | None = None) -> DataFrame:
    df = df if where is None else df.filter(where)
    return df.orderBy(F.col(by).desc_nulls_first(), "document_id").limit(n)


def review_queue(df: DataFrame) -> DataFrame:
    return df.filter(F.col("processing_status") == "needs_review").orderBy(F.col("updated_at").desc_nulls_first(), "document_id")


def favorites(df: DataFrame) -> DataFrame:
    return df.filter("is_favorite").orderBy(F.col("updated_at").desc_nulls_first(), "document_id")


def select_for_export(df: DataFrame, ids: DataFrame | list | None = None, document_type=None, category=None) -> DataFrame:
    """Short id lists become ``IN``; an id DataFrame becomes a left-semi join."""
    if isinstance(ids, list):
        df = df.filter(F.col("document_id").isin(ids))
    elif ids is not None:
        df = df.join(ids.select("document_id"), "document_id", "left_semi")
    return list_documents(df, document_type=document_type, category=category)


def stats(df: DataFrame) -> DataFrame:
    s = F.col("processing_status")
    n = lambda *v: F.count_if(s.isin(*v))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("document_type") == "receipt").alias("receipts"),
        F.count_if(F.col("document_type") == "notice").alias("notices"),
        n("completed", "ready").alias("completed"), n("confirmed").alias("confirmed"),
        n("processing", "queued").alias("processing"), n("failed").alias("failed"),
        n("needs_review").alias("needs_review"), n("queued").alias("queued"),
    )


def _status_counts() -> list[Column]:
    s = F.col("processing_status")
    return [
        F.count("*").alias("count"),
        F.count_if(s == "needs_review").alias("needs_review"),
        F.count_if(s == "confirmed").alias("confirmed"),
        F.count_if(s.isin("processing", "queued")).alias("processing"),
    ]


def folder_summary(df: DataFrame, by: str) -> DataFrame:
    out = df.filter(present(by).isNotNull()).groupBy(F.col(by).alias("value")).agg(*_status_counts())
    return out.withColumn("label", display_label("value")).orderBy(F.desc("count"), "value")


def category_folders(df: DataFrame, folders: DataFrame) -> DataFrame:
    """Document categories plus custom folders that hold nothing."""
    leaf = F.coalesce(category_leaf("category"), F.lit("uncategorized"))
    grouped = df.groupBy(leaf.alias("value")).agg(*_status_counts()).withColumn("label", display_label("value")).withColumn("custom", F.lit(False))
    extra = folders.join(grouped.select("value"), "value", "left_anti").select("value", "label", F.lit(True).alias("custom"))
    return grouped.unionByName(extra, allowMissingColumns=True).fillna(0).orderBy(F.desc("count"), "label")


def folder_tree(df: DataFrame, mode: str) -> DataFrame:
    """Nested counts in one pass with a rollup; ``mode`` is party, document_type, party_type or type_party."""
    party = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("customer_name", "vendor_name", "merchant_name")], F.lit(UNKNOWN_PARTY))
    kind = display_label("document_type")
    pick = {"party": [party], "document_type": [kind], "party_type": [party, kind], "type_party": [kind, party]}[mode]
    keys = [c.alias(n) for c, n in zip(pick, ("first", "second"))]
    base = df.select(*keys)
    if len(keys) == 1:
        return base.groupBy("first").agg(F.count("*").alias("documents")).withColumn("second", F.lit(None).cast("string"))
    return (
        base.rollup("first", "second").agg(F.grouping_id().alias("g"), F.count("*").alias("documents"))
        .filter(F.col("g") < 3).select("first", "second", "documents")
    )


def duplicate_filenames(df: DataFrame) -> DataFrame:
    key = F.nullif(filename_key("original_filename"), F.lit(""))
    groups = df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).filter(F.col("k").isNotNull() & (F.col("n") > 1))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_documents"))


PROVIDER_SCHEMA = """ocr_provider_succeeded STRING, ocr_engine STRING, retry_used BOOLEAN, ocr_worker_retry_used BOOLEAN,
    provider_reset_used BOOLEAN, ocr_worker_provider_reset_used BOOLEAN, ocr_fallback_used BOOLEAN,
    processing_time_ms DOUBLE, ocr_worker_elapsed_ms DOUBLE, elapsed_ms DOUBLE"""


def provider_metadata(col: str = "ingestion_metadata") -> Column:
    """Typed file metadata: nested under ``file_metadata`` when present, else at the top level."""
    parsed = F.from_json(col, f"{PROVIDER_SCHEMA}, file_metadata STRUCT<{PROVIDER_SCHEMA.replace(' STRING', ':STRING').replace(' BOOLEAN', ':BOOLEAN').replace(' DOUBLE', ':DOUBLE')}>")
    names = [p.split()[0] for p in PROVIDER_SCHEMA.split(",")]
    nested = parsed["file_metadata"]
    return F.struct(*[F.when(nested.isNotNull(), nested[n]).otherwise(parsed[n]).alias(n) for n in names])


def ocr_metrics(df: DataFrame) -> DataFrame:
    m = df.select("processing_status", provider_metadata().alias("m"))
    provider = F.coalesce(present("m.ocr_provider_succeeded"), present("m.ocr_engine"), F.lit(""))
    flag = lambda *names: F.count_if(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"m.{n}"), F.lit(False)) for n in names]))
    zero = lambda n: F.nullif(F.col(f"m.{n}"), F.lit(0.0))
    elapsed = F.coalesce(zero("processing_time_ms"), zero("ocr_worker_elapsed_ms"), F.col("m.elapsed_ms"))
    s = F.col("processing_status")
    return m.agg(
        F.count("*").alias("total_documents"),
        F.count_if(provider.contains("paddleocr")).alias("provider_success"),
        flag("retry_used", "ocr_worker_retry_used").alias("provider_retry"),
        flag("provider_reset_used", "ocr_worker_provider_reset_used").alias("provider_reset"),
        F.count_if(F.coalesce(F.col("m.ocr_fallback_used"), F.lit(False)) | (provider == "tesseract")).alias("fallback"),
        F.count_if(s == "failed").alias("failed"),
        F.count_if(s.isin("ready", "confirmed", "completed")).alias("ready"),
        F.count_if(s == "needs_review").alias("needs_review"),
        F.coalesce(F.round(F.avg(elapsed), 1), F.lit(0.0)).alias("average_processing_ms"),
    )


def master_stats(master: DataFrame, alias: DataFrame) -> DataFrame:
    """Counts, and the latest upload and change where the master has these columns."""
    times = [c for c in ("last_uploaded_at", "updated_at") if c in master.columns]
    rows = master.select(F.lit(True).alias("item"), "active", *times).unionByName(alias.select(F.lit(False).alias("item"), "active"), allowMissingColumns=True)
    item, live = F.col("item"), F.col("active")
    return rows.agg(
        F.count_if(item).alias("total_items"), F.count_if(item & live).alias("active_items"), F.count_if(item & ~live).alias("inactive_items"),
        F.count_if(~item & live).alias("alias_count"), *[F.max(c).alias(f"last_{c.removeprefix('last_')}") for c in times])


def dictionary_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("dictionary_type").agg(F.count("*").alias("total"), F.count_if("active").alias("active"))


def list_dictionary(entries: DataFrame, text=None, dictionary_type=None, active=None) -> DataFrame:
    if text:
        cols = [c for c in ("canonical_value", "field", "memo") if c in entries.columns]
        entries = entries.filter(_any([F.coalesce(F.col(c).ilike(f"%{text.strip()}%"), F.lit(False)) for c in cols]))
    if dictionary_type:
        entries = entries.filter(F.col("dictionary_type") == dictionary_type)
    return entries if active is None else entries.filter(F.col("active") == F.lit(active))


def list_master(master: DataFrame, text=None, category=None, active=None) -> DataFrame:
    if text:
        master = master.filter(_any([F.coalesce(F.col(c).ilike(f"%{text.strip()}%"), F.lit(False)) for c in ("internal_item_code", "item_name", "spec")]))
    if category:
        master = master.filter(F.col("category") == category)
    return master if active is None else master.filter(F.col("active") == F.lit(active))


def calendar_dates(docs: DataFrame, *keep: str) -> DataFrame:
    """Issue, due and key dates per document. Built inside the row and exploded, so no
    union, join or shuffle; a key date equal to an already listed date is dropped."""
    issue = F.coalesce("issue_date", "extracted_date")
    labels = F.create_map(*[F.lit(x) for kv in DUE_LABELS.items() for x in kv])
    iso = lambda v: F.try_to_date(F.nullif(F.regexp_extract(v, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    keys = F.array_distinct(F.filter(F.transform(F.coalesce("key_dates", F.array().cast("array<string>")), iso), lambda d: d.isNotNull()))
    keys = F.filter(keys, lambda d: ~F.coalesce(d == issue, F.lit(False)) & ~F.coalesce(d == F.col("due_date"), F.lit(False)))
    row = lambda role, label, date: F.struct(F.lit(role).alias("role"), label.alias("label"), date.alias("date"))
    due_label = F.coalesce(F.try_element_at(labels, F.col("document_type")), F.lit("기한"))
    rows = F.concat(
        F.when(issue.isNotNull(), F.array(row("issue_date", F.lit("발행일"), issue))).otherwise(F.array()),
        F.when(F.col("due_date").isNotNull(), F.array(row("due_date", due_label, F.col("due_date")))).otherwise(F.array()),
        F.transform(keys, lambda d: row("key_date", F.lit("문서 일정"), d)),
    )
    return docs.select("document_id", *keep, F.explode(rows).alias("c")).select("document_id", *keep, "c.role", "c.label", "c.date")


def preferred_calendar(items: DataFrame) -> DataFrame:
    """Issue-date rows survive only where a document has no other row."""
    scheduled = items.filter(F.col("role") != "issue_date")
    lonely = items.filter(F.col("role") == "issue_date").join(scheduled.select("document_id"), "document_id", "left_anti")
    return scheduled.unionByName(lonely)


def calendar_status(items: DataFrame, today: dt.date) -> DataFrame:
    days = F.date_diff(F.col("date"), F.lit(today))
    label = F.when(days == 0, "오늘").when(days < 0, "지난 일정").when(days <= 7, "임박").otherwise("예정")
    return items.withColumn("days_from_today", days).withColumn("status", label)


def calendar(items: DataFrame, today: dt.date, limit: int = 120, date_from=None, date_to=None) -> DataFrame:
    if date_from:
        items = items.filter(F.col("date") >= F.lit(date_from))
    if date_to:
        items = items.filter(F.col("date") <= F.lit(date_to))
    out = calendar_status(items, today)
    return out.orderBy(F.abs("days_from_today"), "date", "document_id", "role").limit(limit)


def notifications(docs: DataFrame, newest: int = 40, kept: int = 30) -> DataFrame:
    """The ``newest`` documents as notices, of which ``kept`` are shown."""
    s = F.col("processing_status")
    kind = F.when(s.isin("processing", "queued"), "processing").when(s == "failed", "failed").when(s == "needs_review", "review").otherwise("processed")
    text = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in NOTICES.items() for x in (k, v[i])]), F.col("kind"))
    rows = docs.orderBy(F.col("updated_at").desc_nulls_first(), "document_id").limit(newest).withColumn("kind", kind)
    return (
        rows.select("document_id", "kind", "updated_at", text(0).alias("title"), text(1).alias("message"),
                      F.col("kind").isin("review", "failed").alias("action_required"))
        .orderBy(F.col("updated_at").desc_nulls_first(), "document_id").limit(kept)
    )


def bulk_status(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids (``pos, document_id``) in order, duplicates collapsed to the first, with a missing flag."""
    wanted = ids.groupBy("document_id").agg(F.min("pos").alias("pos"))
    found = docs.select("document_id", "processing_status")
    return wanted.join(found, "document_id", "left").withColumn("missing", F.col("processing_status").isNull())
