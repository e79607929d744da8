"""Text lines kept inside the row as arrays: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bizdocs.functions.text import is_noisy_line, let

AMOUNT_PATTERN = r"\b\d{1,6}(?:,\d{3})*\.\d{2}\b"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_lines(col) -> Column:
    """Whitespace-collapsed, trimmed, non-blank lines in order.

    White space is collapsed once over the text, not per line, and lines are cut at a plain character."""
    t = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"[ \t\x0B\f](?:[ \t\x0B\f]+|(?<! ))", " ")
    return F.filter(F.transform(cut_lines(t), lambda v: F.trim(v)), lambda v: v != "")


def cut_lines(t: Column) -> Column:
    """Pieces between line breaks, for callers that drop blank ones: a break of two characters leaves one more."""
    return F.split(F.replace(t, F.lit("\r"), F.lit("\n")), "\n")


def count_where(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def line_stats(col) -> Column:
    """Line count, structured density, amount patterns and noise ratio of one text."""
    t = F.coalesce(_c(col), F.lit(""))

    def stats(lines):
        n = F.size(lines)
        structured = count_where(lines, lambda v: v.contains("|") | v.contains(":") | v.rlike(r"\d+\.\d{2}"))
        noisy = count_where(lines, is_noisy_line)
        share = lambda k: F.when(n > 0, k / n).otherwise(F.lit(0.0))
        return F.struct(n.alias("line_count"), share(structured).alias("structured_density"),
                        F.regexp_count(t, F.lit(AMOUNT_PATTERN)).alias("amount_pattern_count"), share(noisy).alias("noise_ratio"))

    return let(text_lines(t), stats)
