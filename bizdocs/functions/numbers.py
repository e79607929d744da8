"""Number and amount functions. Money stays DECIMAL end to end."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,2)"
LOOSE = "decimal(20,4)"
# Unit words, currency patterns.
UNIT_PATTERN = r"(?i)\b(ea|pcs|set|kg|box|can|roll|pack|pk|m)\b|(?<=\d)\s*(개|식|대|매|박스|세트|봉|장|본|통|캔)"
STRONG_USD = (
    r"(?im)^\s*(?:currency|통화)\s*[:：]?\s*USD\s*$|\b(?:total|subtotal|amount\s+due|invoice\s+total|grand\s+total)\s+USD\b"
    r"|\bUSD\s+(?:total|subtotal|amount\s+due|invoice\s+total|grand\s+total)\b"
)
KRW_MARK = r"(?i)\bKRW\b|₩|원"
AMOUNT_WORD = "(공급가액|세액|합계|단가|금액|부가세|청구금액)"
WEAK_USD = r"(?i)\bUSD\b|US\$|\$\s*\d|\d[\d,]*(?:\.\d+)?\s*(?:USD|US\$)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_text(df, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def loose_decimal(col) -> Column:
    """First signed number in the text, thousands commas removed."""
    token = F.regexp_extract(F.trim(_c(col)), r"[-+]?\d[\d,]*(?:\.\d+)?", 0)
    return F.replace(F.nullif(token, F.lit("")), F.lit(","), F.lit("")).try_cast(LOOSE)


def amount(df, name: str) -> Column:
    """A column as money: text is parsed loosely, numbers are only cast."""
    return loose_decimal(name) if is_text(df, name) else F.col(name)


def strict_decimal(col) -> Column:
    """The whole string must be a number once ``, ₩ 원`` are gone."""
    return F.nullif(F.trim(F.translate(_c(col), ",₩원", "")), F.lit("")).try_cast(LOOSE)


def digits_decimal(col) -> Column:
    """Keep only digits, dots and minus signs, then parse."""
    return F.regexp_replace(_c(col), r"[^0-9.\-]", "").try_cast(LOOSE)  # nothing left is no number either


def business_decimal(col) -> Column:
    """``1.234.567`` is 1234567; of several tokens the last parseable wins; a date is no number."""
    t = F.trim(F.coalesce(_c(col), F.lit("")))
    compact = F.regexp_replace(t, r"[^0-9.\-]", "")
    dotted = (~t.contains(",")) & compact.rlike(r"^-?\d{1,3}(\.\d{3})+$")

    def one(token: Column) -> Column:
        c = F.regexp_replace(token, r"[^0-9.\-]", "")
        thousands = (~token.contains(",")) & c.rlike(r"^-?\d{1,3}(\.\d{3})+$")
        return F.when(thousands, F.replace(c, F.lit("."), F.lit(""))).otherwise(c).try_cast(LOOSE)

    tokens = F.regexp_extract_all(t, F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0))
    parsed = F.filter(F.transform(tokens, one), lambda v: v.isNotNull())
    return (
        F.when(t.rlike(r"^-?\d+(?:\.\d{1,2})?\z"), t.try_cast(LOOSE))  # a plain number, as most are
        .when(t.rlike(r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}$"), F.lit(None).cast(LOOSE))
        .when(dotted, F.replace(compact, F.lit("."), F.lit("")).try_cast(LOOSE))
        .when((F.size(tokens) > 1) & (F.size(parsed) > 0), F.try_element_at(parsed, F.lit(-1)))
        .otherwise(compact.try_cast(LOOSE))
    )


def money(col) -> Column:
    """Half-even rounding to cents."""
    return F.bround(_c(col), 2)


def amount_close(left, right) -> Column:
    tol = F.greatest(F.lit(1).cast(LOOSE), F.abs(_c(right)) * F.lit("0.02").cast("decimal(3,2)"))
    return F.coalesce(F.abs(_c(left) - _c(right)) <= tol, F.lit(False))


def triplet_ok(subtotal, tax, total) -> Column:
    return amount_close(_c(subtotal) + _c(tax), total)


def krw_tax(subtotal) -> Column:
    """10 % VAT to whole won, half-even."""
    return F.bround(_c(subtotal) * F.lit("0.1").cast("decimal(2,1)"), 0)


def vat_ok(supply, tax) -> Column:
    tenth = _c(supply) * F.lit("0.1").cast("decimal(2,1)")
    tol = F.greatest(F.lit(1).cast(LOOSE), F.abs(_c(supply)) * F.lit("0.02").cast("decimal(3,2)"))
    return F.coalesce(F.abs(_c(tax) - tenth) <= tol, F.lit(False))


def split_quantity(col):
    """``120 EA`` -> (quantity, unit)."""
    t = F.trim(F.coalesce(_c(col), F.lit("")))
    pattern = r"([-+]?\d[\d,]*(?:\.\d+)?)\s*([A-Za-z가-힣]+)?"
    q = F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    known = F.coalesce(F.nullif(F.regexp_extract(t, UNIT_PATTERN, 1), F.lit("")), F.nullif(F.regexp_extract(t, UNIT_PATTERN, 2), F.lit("")))
    unit = F.coalesce(F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")), known)
    return F.struct(digits_decimal(q).alias("quantity"), unit.alias("unit"))


def currency(col) -> Column:
    t = _c(col)
    return (
        F.when(t.rlike(STRONG_USD), "USD")
        .when(t.rlike(KRW_MARK), "KRW")
        .when(t.rlike("[가-힣]") & t.rlike(AMOUNT_WORD), "KRW")
        .when(t.rlike(WEAK_USD), "USD")
    )


def price_score(source, target) -> Column:
    s, t = _c(source), _c(target)
    ratio = F.abs(s - t).cast("double") / t.cast("double")
    return (
        F.when(s.isNull() | t.isNull() | (t == 0), F.lit(0.5))
        .when(ratio <= 0.02, F.lit(1.0))
        .when(ratio <= 0.10, F.lit(0.7))
        .otherwise(F.lit(0.0))
    )


def unit_score(source, target) -> Column:
    s, t = F.lower(F.trim(F.coalesce(_c(source), F.lit("")))), F.lower(F.trim(F.coalesce(_c(target), F.lit(""))))
    return F.when((s == "") | (t == ""), F.lit(0.5)).when(s == t, F.lit(1.0)).otherwise(F.lit(0.0))


def number_tokens(col) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0))


def is_amount_like(col) -> Column:
    t = F.trim(F.coalesce(_c(col), F.lit("")))
    return t.rlike(r"^-?\d[\d,]*(\.\d+)?[A-Za-z]?$") | t.rlike("(?i)^[0O]+[CG]?$")
