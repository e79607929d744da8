"""Text normalisers and predicates as JVM-side ``Column`` expressions."""

from __future__ import annotations

from functools import reduce
from re import _constants as rx, _parser

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
# Word substitutions of the matcher's normaliser, applied in this order.
MATCH_WORDS = [
    ("에스유에스", "sus"), ("스테인레스", "sus"), ("스테인리스", "sus"), ("써스", "sus"),
    ("철판", "plate"), ("판재", "plate"), ("플레이트", "plate"), ("와샤", "와셔"), ("육각볼트", "육각 볼트"),
]
# Grade and thickness patterns of the matcher's normaliser, applied in this order.
MATCH_PATTERNS = [
    (r"(?U)\b(sus|sts)\s*3[o0]4\b", "$1304"),
    (r"(?U)\b(sus|sts)\s*3[o0]4\s*([_-]?\s*\d+t)?\b", "$1304$2"),
    (r"(?U)\bsus[\s\-_]*304\b", "sus304"),
    (r"(?U)\bsts[\s\-_]*304\b", "sus304"),
    (r"(?U)(\d+)\.0+t\b", "$1t"),
]
# Word substitutions and patterns of the list-search normaliser.
SEARCH_WORDS = [("에스유에스", "sus"), ("스테인리스", "sus"), ("스텐레스", "sus"), ("스텐", "sus")]
SEARCH_PATTERNS = [(r"sus\s*[-_ ]?\s*304", "sus304"), (r"(?U)(\d+)\.0t\b", "$1t")]
NOT_KEY = "[^0-9a-z가-힣]+"
# Category aliases, display labels and tag conflicts.
CATEGORY_ALIASES = {
    "repair_service_receipt": "repair_service", "receipt": "retail", "tax_invoice": "invoice",
    "commercial_invoice": "invoice", "incoming_inspection": "inspection_report", "return_credit": "credit_note",
    "return_credit_note": "credit_note", "utilities": "utility_bill", "utility": "utility_bill",
    "profile": "profile_record", "education_record": "profile_record", "setup_guide": "installation_guide",
    "technical_guide": "installation_guide", "technical_documentation": "installation_guide",
    "project_setup": "installation_guide", "project_tracker": "implementation_schedule",
    "engineering_planning": "implementation_schedule", "development_roadmap": "implementation_schedule",
}
ROOT_LABELS = {
    "purchase_order": "발주서", "quotation": "견적서", "transaction_statement": "거래명세서", "delivery_note": "납품서",
    "invoice": "인보이스/세금계산서", "packing_list": "포장명세서", "inspection_report": "검사성적서",
    "return_note": "반품 문서", "credit_note": "차감/크레딧 문서", "internal_transfer": "내부 이동서",
    "pos_daily_settlement": "POS 일일정산", "purchase_memo": "구매 메모", "contract": "계약서",
    "general_document": "일반 문서", "receipt": "Receipt", "document": "Document", "memo": "Memo",
    "notice": "Notice", "presentation": "Presentation", "other": "Other",
}
EXTRA_LABELS = {
    "retail": "소매", "repair_service": "수리 서비스", "utility_bill": "공과금", "syllabus": "강의계획서",
    "course_guide": "수업 안내", "presentation_guide": "발표 자료", "speaking_notes": "발표 노트",
    "resume_profile": "이력 프로필", "profile_record": "프로필 기록", "installation_guide": "설치 안내",
    "implementation_schedule": "구현 일정", "meeting_notice": "회의 공지", "instructional_memo": "업무 메모",
}
TRADE_TYPES = ["purchase_order", "quotation", "transaction_statement", "delivery_note", "invoice"]
_TRADE_CONFLICTS = TRADE_TYPES + ["packing_list", "general_document", "other"]
TAG_CONFLICTS = {
    **{t: [x for x in _TRADE_CONFLICTS if x != t] for t in TRADE_TYPES if t != "invoice"},
    "invoice": ["retail", "food_drink", "utility_bill", "receipt", "notice", "memo", "time_sensitive", "generic_document", "other"],
    "syllabus": ["memo", "notice", "office", "time_sensitive", "generic_document", "other"],
    "course_guide": ["memo", "notice", "office", "time_sensitive", "generic_document", "other"],
    "presentation_guide": ["receipt", "retail", "food_drink", "repair_service", "utility_bill", "notice", "memo", "generic_document", "other"],
    "speaking_notes": ["receipt", "retail", "food_drink", "repair_service", "utility_bill", "notice", "memo", "generic_document", "other"],
    "resume_profile": ["receipt", "retail", "food_drink", "utility_bill", "memo", "notice", "profile_record", "generic_document", "other", "time_sensitive"],
    "profile_record": ["receipt", "retail", "food_drink", "utility_bill", "memo", "notice", "generic_document", "other", "time_sensitive"],
    "installation_guide": ["receipt", "retail", "food_drink", "utility_bill", "memo", "notice", "profile_record", "generic_document", "other", "time_sensitive"],
    "implementation_schedule": ["receipt", "retail", "food_drink", "utility_bill", "memo", "notice", "profile_record", "generic_document", "other"],
    "repair_service": ["utility_bill", "notice", "memo", "time_sensitive", "generic_document", "other"],
    "utility_bill": ["invoice", "repair_service", "retail", "receipt", "notice", "memo", "time_sensitive", "generic_document", "other"],
    "meeting_notice": ["receipt", "retail", "food_drink", "utility_bill", "generic_document", "other"],
    "instructional_memo": ["receipt", "retail", "food_drink", "repair_service", "utility_bill", "notice", "generic_document", "other", "time_sensitive"],
}
DEFAULT_TAG_CONFLICTS = ["generic_document", "other"]
TIMED_CATEGORIES = ["meeting_notice", "policy_notice"]
TRUE_WORDS = ["1", "true", "yes", "y", "활성", "사용", "사용중"]
FALSE_WORDS = ["false", "0", "no", "n", "비활성"]
GRADE_PATTERNS = [
    ("sus304", "304"), ("sus316", "316"), ("ss400", "ss400"), ("al6061", "6061"), ("s45c", "s45c"),
]
BROAD_MATERIAL = r"(스텐|스테인리스|스테인레스|sus(?!\s*\d)|stainless|plate|철판|판재)"
PLACEHOLDER_CODE = "(미확인|신뢰도|검토|장부|비어)"
CONTACT_PATTERN = r"(?i)(https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+|linkedin\.com/\S+|github\.com/\S+)"
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Bind a subexpression once; inside lambdas Spark does not share common parts."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(col) -> Column:
    """White space to single spaces; a space that stands alone is not touched, so most texts need no replacement there."""
    return F.regexp_replace(_c(col), r"\s(?:\s+|(?<! ))", " ")


def signs(pattern: str) -> list[str]:
    """Literals one of which is in every match of the pattern, the longest to be had; none if there are no such."""
    def longest(items) -> list[str]:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is rx.LITERAL:
                run += chr(value)
                continue
            found, run = [*found, *([[run]] if run else [])], ""
            if op is rx.SUBPATTERN:
                found.append(longest(value[3]))
            elif op is rx.BRANCH:
                arms = [longest(arm) for arm in value[1]]
                found.append(sum(arms, []) if all(arms) else [])
            elif op in (rx.MAX_REPEAT, rx.MIN_REPEAT) and value[0] > 0:
                found.append(longest(value[2]))
        return max((f for f in found if f), key=lambda ws: min(map(len, ws)), default=[])

    return sorted(set(longest(_parser.parse(pattern))))


def found(t: Column, pattern: str) -> Column:
    """``t.rlike(pattern)`` for long patterns in lambdas: there ``rlike`` decodes its pattern once more for every text, which
    costs more than most searches; the place of the first match comes of a pattern that is kept."""
    return F.regexp_instr(t, F.lit(pattern)) > 0


def matches(t: Column, low: Column, pattern: str) -> Column:
    """``t.rlike(pattern)``, tried only on texts that hold a literal the pattern can't do without; ``low`` is ``t`` in lower
    case. A search for a literal costs a small part of a search for an alternative of a pattern."""
    caseless = bool(_parser.parse(pattern).state.flags & rx.SRE_FLAG_IGNORECASE)
    held = [low.contains(w.lower()) if caseless and w.lower() != w.upper() else t.contains(w) for w in signs(pattern)]
    return reduce(lambda a, b: a | b, held) & t.rlike(pattern) if held else t.rlike(pattern)


def blank_to_null(col) -> Column:
    return F.nullif(F.trim(_c(col)), F.lit(""))


def low(col) -> Column:
    return F.trim(F.lower(F.coalesce(_c(col).cast("string"), F.lit(""))))


def _words(col: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def _patterns(col: Column, pairs) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, col)


def normalize_item_text(col) -> Column:
    """Matcher key: material words folded, grades repaired, punctuation removed."""
    return F.regexp_replace(_patterns(_words(low(col), MATCH_WORDS), MATCH_PATTERNS), NOT_KEY, "")


def normalize_item_text_search(col) -> Column:
    """List-search key; deliberately different from the matcher's."""
    return F.regexp_replace(_patterns(_words(low(col), SEARCH_WORDS), SEARCH_PATTERNS), NOT_KEY, "")


def normalize_spec(col) -> Column:
    t = F.replace(F.replace(low(col), F.lit("×"), F.lit("x")), F.lit("*"), F.lit("x"))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)(\d+)\.0+t\b", "$1t"), "[^0-9a-z가-힣x.]+", "")


def normalize_spec_search(col) -> Column:
    return F.regexp_replace(F.regexp_replace(low(col), r"(?U)(\d+)\.0t\b", "$1t"), "[^0-9a-z가-힣.]+", "")


def normalize_label(col) -> Column:
    return F.regexp_replace(low(col), r"[\s:/._·\-]+", "")


def normalize_party(col) -> Column:
    t = F.regexp_replace(low(col), r"^\(?주\)?", "")
    return F.regexp_replace(F.replace(t, F.lit("㈜"), F.lit("")), NOT_KEY, "")


def normalize_value(col) -> Column:
    return F.regexp_replace(low(col), NOT_KEY, "")


def item_key(col) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_c(col).cast("string"), F.lit(""))), NOT_KEY, "")


def normalize_for_type(type_col, col) -> Column:
    t = _c(type_col)
    return (
        F.when(t == "field_label", normalize_label(col))
        .when(t == "party", normalize_party(col))
        .when(t == "item", normalize_item_text(col))
        .otherwise(normalize_value(col))
    )


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_category(col) -> Column:
    t = F.regexp_replace(F.lower(F.trim(_c(col))), r"[\s/\-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9_]+", ""), "_+", "_")
    t = F.nullif(F.regexp_replace(t, "^_|_$", ""), F.lit(""))
    return let(t, lambda k: F.coalesce(F.try_element_at(_lookup(CATEGORY_ALIASES), k), k))


def category_leaf(col) -> Column:
    return normalize_category(F.element_at(F.split(_c(col), ">"), -1))


def display_label(col) -> Column:
    n = normalize_category(col)
    known = F.try_element_at(_lookup({**EXTRA_LABELS, **ROOT_LABELS}), n)
    return F.coalesce(known, F.initcap(F.replace(n, F.lit("_"), F.lit(" "))), F.lit("Uncategorized"))


def clean_tags(tags, category, profile, document_type, key_dates=None, follow_up=None, urgency=None) -> Column:
    """Normalised, ordered-distinct tags without those the category contradicts."""
    cleaned = F.array_distinct(F.filter(F.transform(F.coalesce(_c(tags), F.array().cast("array<string>")), normalize_category), lambda t: t.isNotNull()))
    context = F.coalesce(normalize_category(profile), normalize_category(category))
    blocked_map = F.create_map(*[x for k, v in TAG_CONFLICTS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    blocked = F.coalesce(F.try_element_at(blocked_map, context), F.array(*[F.lit(t) for t in DEFAULT_TAG_CONFLICTS]))
    timed = context.isin(TIMED_CATEGORIES)
    if key_dates is not None:
        timed = timed | (F.size(_c(key_dates)) > 0)
    if follow_up is not None:
        timed = timed | _c(follow_up)
    if urgency is not None:
        timed = timed | F.lower(_c(urgency)).isin("medium", "high")
    broad = normalize_category(document_type)
    kept = F.filter(cleaned, lambda t: ~F.array_contains(blocked, t) & ((t != "time_sensitive") | F.coalesce(timed, F.lit(False))))
    add = lambda k: F.coalesce(broad.isin(list(ROOT_LABELS)) & ~F.array_contains(k, broad), F.lit(False))
    return let(kept, lambda k: F.when(add(k), F.array_prepend(k, broad)).otherwise(k))


def parse_bool(col) -> Column:
    """Truthy list, missing is true."""
    t = _c(col).cast("string")
    return F.when(t.isNull() | (t == ""), F.lit(True)).otherwise(low(t).isin(TRUE_WORDS))


def parse_bool_search(col) -> Column:
    """Falsy list, null is true."""
    t = _c(col).cast("string")
    return t.isNull() | ~low(t).isin(FALSE_WORDS)


def split_aliases(col) -> Column:
    return F.filter(F.transform(F.split(_c(col), "[|;,]"), lambda p: F.trim(p)), lambda p: p != "")


def thickness(col) -> Column:
    n = F.regexp_extract(normalize_item_text(col), r"(\d+(?:\.\d+)?)t", 1)
    return F.when(n != "", F.concat(F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", ""), F.lit("t")))


def material_grade(col) -> Column:
    n = normalize_item_text(col)
    return reduce(lambda c, p: c.when(n.rlike(p[1]), p[0]), GRADE_PATTERNS[1:], F.when(n.rlike(GRADE_PATTERNS[0][1]), GRADE_PATTERNS[0][0]))


def mentions_broad_material(col) -> Column:
    return F.lower(F.coalesce(_c(col), F.lit(""))).rlike(BROAD_MATERIAL)


def real_code(col) -> Column:
    return F.coalesce(blank_to_null(col).isNotNull() & ~_c(col).rlike(PLACEHOLDER_CODE), F.lit(False))


def keyword_hits(col, words: list[str], n: int) -> Column:
    hits = lambda lowered: F.slice(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: lowered.contains(w)), 1, n)
    return let(F.lower(F.coalesce(_c(col), F.lit(""))), hits)


def contact_links(col, most: int | None = None) -> Column:
    """URLs and e-mail addresses in order; the first ``most`` if given."""
    found = F.regexp_extract_all(_c(col), F.lit(CONTACT_PATTERN), F.lit(1))
    return found if most is None else F.slice(found, 1, most)


def usable_party(col) -> Column:
    t = F.trim(F.coalesce(_c(col), F.lit("")))
    return (F.length(t) >= 2) & ~t.rlike("^[-_/0-9., ]+$")


def party_key(col) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\s+", ""))


def is_noisy_line(col) -> Column:
    t = _c(col)
    tokens = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    odd = F.length(F.regexp_replace(t, r"[A-Za-z0-9\s.,:/$%-]", ""))
    return ((tokens <= 2) & (odd >= 2)) | t.rlike(r"(.)\1{4,}")


def sanitize(df):
    """Drop NUL characters from every string column."""
    return df.select([F.translate(c, "\u0000", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def merge_flags(*cols, ignore_case: bool = False) -> Column:
    """Ordered-distinct concatenation of arrays; optionally case-insensitive."""
    empty = F.array().cast("array<string>")
    merged = F.concat(*[F.coalesce(_c(c), empty) for c in cols])
    if not ignore_case:
        return F.array_distinct(merged)
    cleaned = F.filter(F.transform(merged, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")
    both = let(cleaned, lambda c: F.struct(c.alias("c"), F.transform(c, lambda v: F.lower(v)).alias("keys")))
    return let(both, lambda b: F.filter(b["c"], lambda v, i: F.array_position(b["keys"], F.lower(v)) == i + 1))


def has_profile(col, *profiles: str) -> Column:
    return F.coalesce(F.arrays_overlap(_c(col), F.array(*[F.lit(p) for p in profiles])), F.lit(False))


def filename_key(col) -> Column:
    """Whitespace-free lower case; NFKC is skipped, so exact for ASCII names."""
    return F.lower(F.regexp_replace(_c(col), r"\s+", ""))
