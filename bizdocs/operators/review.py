"""Review issues in long form: rules, collapse, states, approval and progress.

Issues are rows (``document_id, pos, code, field, item_index, severity, message``),
never a per-document list, so a document with very many issues stays spread out.
``pos`` is an orderable struct giving the place in the document's issue order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bizdocs.functions.text import has_profile
from bizdocs.operators import line_items as L
from bizdocs.operators.ordering import first_per, last_per
from bizdocs.operators.resolve import present
from bizdocs.session import cut

# --- fixed values -------------------------------------------------------------
CRITICAL = [
    "missing_document_number", "missing_line_items", "missing_item_name", "missing_quantity",
    "missing_price_or_total", "amount_mismatch", "invalid_line_amount", "item_code_name_conflict",
]
RESOLVED = ["resolved", "ignored"]
STATUSES = ["open", "resolved", "ignored", "blocked"]
COLLAPSIBLE = {
    "missing_quantity": ("여러 품목의 수량 확인이 필요합니다.", "line_items.quantity"),
    "missing_price_or_total": ("여러 품목의 단가 또는 합계금액 확인이 필요합니다.", "line_items.unit_price"),
    "missing_document_item_code": ("여러 품목의 문서 품목코드 확인이 필요합니다.", "line_items.item_code"),
}
GENERIC_CODES = ["", "validation_warning", "review_required"]
AMOUNT_WARNINGS = {
    "invalid_tax_greater_than_total": ("세액이 합계금액보다 큽니다.", "line_items.tax_amount"),
    "invalid_tax_greater_than_supply": ("세액이 공급가액보다 큽니다.", "line_items.tax_amount"),
    "invalid_supply_greater_than_total": ("공급가액이 합계금액보다 큽니다.", "line_items.supply_amount"),
    "invalid_line_total": ("공급가액, 세액, 합계금액 계산이 맞지 않습니다.", "line_items.line_total"),
}
ITEM_TYPES = ["purchase_order", "quotation", "transaction_statement", "delivery_note", "invoice", "inspection_report"]
SUMMARIES = {
    "missing_price_or_total": "금액/총액 누락", "untrusted_ocr_amount": "금액 OCR 신뢰도 낮음", "amount_mismatch": "문서 총액과 품목 합계 불일치",
    "line_items_total_mismatch": "문서 총액과 품목 합계 불일치", "amount_direction_requires_review": "반품/차감 금액 방향 확인",
    "statement_balance_summary_requires_review": "정산 요약 확인", "option_quote_total_requires_selection": "옵션 견적 최종 합계 확인",
    "related_document_missing": "관련 원문서 번호 확인", "ambiguous_item_match": "품목 매칭 모호", "internal_item_ambiguous": "내부 품목 후보 참고",
    "internal_item_unmatched": "내부 품목 미매칭 참고", "item_matching_skipped": "내부 품목 매칭 건너뜀", "item_code_name_conflict": "품목명/코드 충돌",
    "missing_line_items": "품목 정보 누락", "missing_quantity": "수량 누락",
}
# ------------------------------------------------------------------------------

ISSUE_COLUMNS = ["document_id", "pos", "code", "field", "item_index", "severity", "message"]


def _reason(cond: Column, code: str, field: str, message, severity="warning") -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), as_col(severity).alias("severity"), as_col(message).alias("message")))


def _emit(df: DataFrame, rules: list[Column], phase: int, line: Column, index: Column) -> DataFrame:
    numbered = F.array_compact(F.array(*[
        F.when(r.isNotNull(), F.struct(F.lit(i).alias("rule"), r.alias("r"))) for i, r in enumerate(rules)]))
    out = df.select("document_id", line.cast("long").alias("_line"), index.cast("int").alias("item_index"), F.explode(numbered).alias("e"))
    pos = F.struct(F.lit(phase).alias("phase"), F.col("_line").alias("line"), F.col("e.rule").alias("rule"))
    return out.select("document_id", pos.alias("pos"), "e.r.code", "e.r.field", "item_index", "e.r.severity", "e.r.message")


def review_reasons(docs: DataFrame, lines: DataFrame, index: str = "line_index") -> DataFrame:
    """Rule table over headers and lines; the header meets the lines once, the lines' totals once."""
    profiles, t = "taxonomy.document_profiles", F.col("document_type")
    ret = has_profile(profiles, "return_document")
    no_price = has_profile(profiles, "no_price_document") | F.coalesce(F.col("taxonomy.amount_required") == F.lit(False), F.lit(False))
    optional_party = no_price | has_profile(profiles, "inventory_movement_document")
    none = lambda c: present(c).isNull()
    skipped = (F.col("item_master_match_status") == "skipped_no_item_master") & none("item_code") if "item_master_match_status" in lines.columns else F.lit(False)
    stats = lines.groupBy("document_id").agg(
        F.count("*").alias("_n"), F.sum(L.money_col(lines, "line_total")).alias("_sum"),
        F.bool_or(present("item_code").isNotNull()).alias("_codes"),
        F.bool_or(skipped).alias("_skipped"),
        F.bool_or(F.arrays_overlap("validation_warnings", F.array(*[F.lit(w) for w in AMOUNT_WARNINGS]))).alias("_invalid"))
    head = docs.join(stats, "document_id", "left").withColumns({"_ret": ret, "_noprice": no_price, "_optparty": optional_party})
    tax_doc = has_profile(profiles, "tax_document") | F.coalesce(F.col("taxonomy.document_profile") == "tax_document", F.lit(False))
    front = _emit(head, [
        _reason(F.col("_ret"), "amount_direction_requires_review", "total_amount", "반품/차감 문서는 금액의 차감 방향과 원문서 반영 방식을 확인해야 합니다."),
        _reason(F.col("_ret"), "related_document_missing", "related_document_number", "반품/차감 문서의 관련 원문서 번호를 확인해야 합니다.", "info"),
        _reason(~F.col("_optparty") & none("vendor_name") & none("merchant_name"), "missing_vendor_name", "vendor_name", "공급업체가 추출되지 않았습니다."),
        _reason(~F.col("_optparty") & none("customer_name"), "missing_customer_name", "customer_name", "고객사가 추출되지 않았습니다."),
        _reason(none("document_number"), "missing_document_number", "document_number", "문서번호 미확인"),
        _reason(F.col("issue_date").isNull() & F.col("extracted_date").isNull(), "missing_issue_date", "issue_date", "날짜 미확인"),
        _reason((t == "purchase_order") & F.col("due_date").isNull(), "missing_due_date", "due_date", "납기일 미확인"),
        _reason((t == "invoice") & ~tax_doc & F.col("due_date").isNull(), "missing_payment_due_date", "due_date", "지급기한 미확인"),
        _reason(F.col("_n").isNull(), "missing_line_items", "line_items", "품목 정보가 추출되지 않았습니다."),
    ], 0, F.lit(0), F.lit(None))
    body = lines.join(head.select("document_id", "document_type", "_noprice", "_codes"), "document_id")
    nth = lambda text: F.concat((F.col(index)).cast("string"), F.lit(f"번째 품목{text}"))
    coded = none("internal_item_code") if "internal_item_code" in lines.columns else F.lit(True)
    code_severity = F.when(F.col("_codes") & coded & ~F.col("_noprice"), "warning").otherwise("info")
    rules = [
        _reason(none("item_name"), "missing_item_name", "line_items.item_name", nth("의 품목명이 비어 있습니다.")),
        _reason(present(F.col("quantity").cast("string")).isNull(), "missing_quantity", "line_items.quantity", nth("의 수량이 비어 있습니다.")),
        _reason(~F.col("_noprice") & (t != "delivery_note") & present(F.col("unit_price").cast("string")).isNull() & present(F.col("line_total").cast("string")).isNull(),
                "missing_price_or_total", "line_items.unit_price", nth("의 단가 또는 합계금액을 확인해야 합니다.")),
        *[_reason(F.array_contains("validation_warnings", w) & ~F.col("_noprice"), "invalid_line_amount", f, nth(f"의 {m}")) for w, (m, f) in AMOUNT_WARNINGS.items()],
        _reason(F.array_contains("validation_warnings", "item_code_name_conflict"), "item_code_name_conflict", "line_items.internal_item_code", nth("의 품목명과 품목코드 매칭이 충돌합니다.")),
        _reason(none("item_code"), "missing_document_item_code", "line_items.item_code", nth(" 문서 품목코드 미확인"), code_severity),
    ]
    if "item_master_match_status" in lines.columns:
        status = F.col("item_master_match_status")
        rules += [
            _reason(status == "ambiguous", "internal_item_ambiguous", "line_items.internal_item_code", nth(" 내부 품목코드 후보 확인 필요")),
            _reason(status == "unmatched", "internal_item_unmatched", "line_items.internal_item_code", nth(" 내부 품목코드 미매칭"), "info"),
        ]
    middle = _emit(body, rules, 1, F.col("line_index"), F.col(index) - 1)
    off = F.coalesce(F.abs(F.col("extracted_amount") - F.col("_sum")) > L.amount_tolerance("enrichment"), F.lit(False))
    back = _emit(head, [
        _reason(F.coalesce("_skipped", F.lit(False)), "item_matching_skipped", "line_items.internal_item_code", "내부 품목마스터가 없어 품목코드 매칭을 건너뛰었습니다.", "info"),
        _reason(off, "amount_mismatch", "total_amount", "문서 합계금액과 품목 합계금액이 일치하지 않습니다."),
        _reason(~off & F.coalesce("_invalid", F.lit(False)) & ~F.col("_noprice"), "amount_mismatch", "total_amount", "품목 금액 계산 오류가 있어 문서 합계금액도 함께 확인해야 합니다."),
    ], 2, F.lit(0), F.lit(None))
    return front.unionByName(middle).unionByName(back)


def message_key(col: str = "message") -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"\s+", " "))


def dedupe_reasons(issues: DataFrame, by_message: bool = False) -> DataFrame:
    """First issue per key; optionally a pass by message runs before it."""
    if by_message:
        worded = issues.filter(message_key() != "")
        issues = first_per(worded, [F.col("document_id").alias("_k0"), message_key().alias("_k1")], "pos").unionByName(issues.filter(message_key() == ""))
    generic = F.coalesce("code", F.lit("")).isin(GENERIC_CODES)
    keys = ["document_id", "code", "field", "item_index"]
    return first_per(issues, [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] + [F.when(generic, message_key()).otherwise("").alias("_k4")], "pos")


def collapse_issues(issues: DataFrame, at_least: int = 4) -> DataFrame:
    """Four or more item-level issues of a collapsible code become one row at the first place."""
    per_item = F.col("code").isin(list(COLLAPSIBLE)) & F.col("item_index").isNotNull()
    issues = cut(issues)  # read by three branches
    groups = issues.filter(per_item).groupBy("document_id", "code").agg(F.count("*").alias("_n"), F.min("pos").alias("pos")).filter(F.col("_n") >= at_least)
    kept = issues.filter(~per_item).unionByName(issues.filter(per_item).join(groups.select("document_id", "code"), ["document_id", "code"], "left_anti"))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in COLLAPSIBLE.items() for x in (k, v[i])]), F.col("code"))
    merged = groups.select(
        "document_id", "pos", "code", pick(1).alias("field"), F.lit(None).cast("int").alias("item_index"), F.lit("warning").alias("severity"),
        F.concat(pick(0), F.lit(" ("), F.col("_n").cast("string"), F.lit("건)")).alias("message"))
    return dedupe_reasons(kept.select(ISSUE_COLUMNS).unionByName(merged.select(ISSUE_COLUMNS)), by_message=True)


def parse_issue_key(key) -> Column:
    """``[unresolved:]code:field:index`` or the legacy ``code:item_N`` to (code, field, item_index)."""
    k = F.regexp_replace(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")), "^unresolved:", "")
    parts = F.split(k, ":")
    at = lambda i: F.nullif(F.try_element_at(parts, F.lit(i)), F.lit(""))
    code = F.coalesce(at(1), F.lit("review_required"))

    def index(token: Column) -> Column:
        nth = F.regexp_replace(token, "^item_", "").try_cast("int")
        return F.when(token.startswith("item_"), F.greatest(nth - 1, F.lit(0))).otherwise(token.try_cast("int"))

    legacy = F.coalesce((code == "missing_inventory_item_or_quantity") & at(2).startswith("item_"), F.lit(False))
    return F.struct(
        code.alias("code"), F.when(legacy, "line_items.quantity").otherwise(F.coalesce(at(2), F.lit("document"))).alias("field"),
        F.when(legacy, index(at(2))).otherwise(index(at(3))).alias("item_index"))


def issue_key() -> Column:
    return F.concat_ws(":", F.coalesce("code", F.lit("review_required")), F.coalesce("field", F.lit("document")), F.coalesce(F.col("item_index").cast("string"), F.lit("")))


def issue_states(issues: DataFrame, states: DataFrame) -> DataFrame:
    """Issues with their stored status; no stored state means open."""
    parsed = states.select("document_id", parse_issue_key("key").alias("k"), "status", "updated_at")
    latest = parsed.groupBy("document_id", F.col("k.code").alias("_code"), F.col("k.field").alias("_field"), F.coalesce("k.item_index", F.lit(-1)).alias("_idx")).agg(
        F.max_by("status", "updated_at").alias("_status"))
    keyed = issues.withColumn("_idx", F.coalesce("item_index", F.lit(-1))).withColumns({"_code": F.col("code"), "_field": F.col("field")})
    joined = keyed.join(latest, ["document_id", "_code", "_field", "_idx"], "left")
    return joined.select(*issues.columns, F.coalesce("_status", F.lit("open")).alias("status"))


def apply_issue_updates(states: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest status per issue key; resolved and ignored also stamp who and when."""
    if "resolved_by" not in states.columns:
        states = states.withColumns({"resolved_by": F.lit(None).cast("string"), "resolved_at": F.lit(None).cast("timestamp")})
    done = F.col("status").isin(RESOLVED)
    stamped = updates.withColumns({"resolved_by": F.when(done, F.col("updated_by")), "resolved_at": F.when(done, F.col("updated_at"))})
    both = states.unionByName(stamped, allowMissingColumns=True).withColumn("k", parse_issue_key("key"))
    keys = [F.col("document_id").alias("_k0"), F.col("k.code").alias("_k1"), F.col("k.field").alias("_k2"), F.coalesce("k.item_index", F.lit(-1)).alias("_k3")]
    return last_per(both, keys, "updated_at").drop("k")


def approval_findings(docs: DataFrame, issues: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per blocking finding or warning (``document_id, kind, key``). ``issues`` carry a status."""
    profiles = "taxonomy.document_profiles"
    movement = has_profile(profiles, "inventory_movement_document")
    need_amount = F.coalesce("taxonomy.amount_required", ~has_profile(profiles, "no_price_document", "inventory_movement_document"))
    head = docs.withColumns({"_amt": need_amount, "_party": ~movement})
    live = issues.filter(~F.col("status").isin(RESOLVED) & ~F.col("severity").isin("info", "low") & F.col("code").isin(CRITICAL))
    live = live.join(head.select("document_id", "_amt"), "document_id").filter((F.col("code") != "missing_price_or_total") | F.col("_amt"))
    from_issues = live.select("document_id", F.lit("blocking").alias("kind"), F.concat(F.lit("unresolved:"), issue_key()).alias("key"))
    counts = lines.groupBy("document_id").agg(F.count("*").alias("_n"))
    head = head.join(counts, "document_id", "left")
    none = lambda c: present(c).isNull()
    tax = has_profile(profiles, "tax_document")
    gone = F.col("subtotal").isNull() | F.col("tax").isNull() | F.col("extracted_amount").isNull()
    off = F.abs(F.col("subtotal") + F.col("tax") - F.col("extracted_amount")) > F.lit("0.01").cast("decimal(3,2)")
    ret = has_profile(profiles, "return_document")
    found = lambda cond, kind, key: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key")))
    rules = F.array_compact(F.array(
        found(none("document_number"), "warning", "missing_document_number"),
        found(F.col("_party") & none("vendor_name") & none("merchant_name"), "warning", "missing_vendor_name"),
        found(F.col("_party") & none("customer_name"), "warning", "missing_customer_name"),
        found((F.col("document_type").isin(ITEM_TYPES) | has_profile(profiles, "return_document", "inventory_movement_document", "quality_document")) & F.col("_n").isNull(), "blocking", "missing_line_items"),
        found(F.col("_amt") & F.coalesce(F.col("extracted_amount") == 0, F.lit(True)), "warning", "missing_total"),
        found(tax & gone, "blocking", "tax_amount_fields_missing"), found(tax & ~gone & off, "blocking", "subtotal_tax_total_mismatch"),
        found(ret, "warning", "amount_direction_requires_review"),
        found(ret & (F.col("document_type") == "delivery_note"), "blocking", "return_document_misclassified_as_delivery_note"),
        found(ret, "warning", "related_document_missing"),
    ))
    from_head = head.select("document_id", F.explode(rules).alias("f")).select("document_id", "f.kind", "f.key")
    moved = docs.filter(movement).select("document_id")
    bad_line = none("item_name") | present(F.col("quantity").cast("string")).isNull()
    nth = "line_no" if "line_no" in lines.columns else "line_index"
    from_lines = lines.filter(bad_line).join(moved, "document_id", "left_semi").select(
        "document_id", F.lit("blocking").alias("kind"), F.concat(F.lit("missing_inventory_item_or_quantity:item_"), F.col(nth).cast("string")).alias("key"))
    return from_issues.unionByName(from_head).unionByName(from_lines).distinct()


def validate_approval(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdict per document; the code list is bounded by the rule vocabulary, not by the document."""
    code = F.regexp_extract(F.regexp_replace("key", "^unresolved:", ""), "^([^:]*)", 1)
    agg = findings.groupBy("document_id").agg(
        F.count_if(F.col("kind") == "blocking").alias("n_blocking"), F.count_if(F.col("kind") == "warning").alias("n_warnings"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "blocking", code))).alias("blocking_codes"))
    out = docs.select("document_id").join(agg, "document_id", "left")
    return out.select("document_id", F.coalesce("n_blocking", F.lit(0)).alias("n_blocking"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"),
                      F.coalesce("blocking_codes", F.array().cast("array<string>")).alias("blocking_codes"),
                      (F.coalesce("n_blocking", F.lit(0)) == 0).alias("ok"))


def apply_approvals(docs: DataFrame, validation: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested documents become approved or blocked by their verdict; ``reopen`` requests go back to review."""
    df = docs.join(requests.select("document_id", "action"), "document_id", "left").join(validation.select("document_id", "ok"), "document_id", "left")
    ok = F.coalesce("ok", F.lit(False))
    state = F.when(F.col("action") == "reopen", "in_review").when((F.col("action") == "approve") & ok, "approved").when(F.col("action") == "approve", "blocked")
    approved = F.when(F.col("action") == "approve", ok).when(F.col("action") == "reopen", F.lit(False)).otherwise(F.coalesce("review.approved", F.lit(False)))
    return df.select("document_id", approved.alias("approved"), state.alias("review_state"))


def group_issues(issues: DataFrame) -> DataFrame:
    """Issues with the same summary and description as one row with a count, in first-seen order."""
    labels = F.create_map(*[F.lit(x) for kv in SUMMARIES.items() for x in kv])
    summary = F.coalesce(F.try_element_at(labels, F.col("code")), F.col("message"))
    return issues.groupBy("document_id", summary.alias("summary"), F.col("field").alias("description")).agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"))


def issue_progress(docs: DataFrame, states: DataFrame, fallback: Column | None = None) -> DataFrame:
    done = F.col("status").isin(RESOLVED)
    agg = states.groupBy("document_id").agg(F.count_if(F.coalesce(~done, F.lit(True))).alias("_open"), F.count_if(done).alias("_done"))
    other = F.lit(0) if fallback is None else fallback
    return docs.join(agg, "document_id", "left").select("document_id", F.coalesce("_open", other).alias("open"), F.coalesce("_done", F.lit(0)).alias("resolved"))


def candidate_summary(cands: DataFrame) -> DataFrame:
    """Per document: counts, ordered-distinct issue codes and gate reasons, first gate decision.

    Codes come from a fixed vocabulary, so they are aggregated as distinct
    (code, first place) pairs before the per-document list is built."""
    counts = cands.groupBy("document_id").agg(
        F.count("*").alias("candidate_count"), F.count_if(F.col("validation_severity") == "warn").alias("warning_count"),
        F.count_if(F.col("validation_severity") == "fail").alias("failure_count"),
        F.min_by("gate_decision", F.when(F.col("gate_decision").isNotNull(), F.col("candidate_index"))).alias("gate_decision"))

    def ordered(column: str) -> DataFrame:
        seen = cands.select("document_id", "candidate_index", F.posexplode(column).alias("i", "v")).groupBy("document_id", "v").agg(F.min(F.struct("candidate_index", "i")).alias("at"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"])
        return seen.groupBy("document_id").agg(listed.alias(column))

    return counts.join(ordered("issue_codes"), "document_id", "left").join(ordered("gate_reasons"), "document_id", "left")


def last_n(events: DataFrame, keys: list[str], at: str, n: int) -> DataFrame:
    """Only the newest ``n`` events per key; each map task forwards at most ``n`` rows per key."""
    from bizdocs.operators.ordering import top_per

    tie = [c for c in events.columns if c not in keys and c != at][:1]
    return top_per(events, keys, [F.col(at).desc(), *[F.col(c).desc() for c in tie]], n)
