"""Learned quality rules: a decision list of threshold conjunctions over text statistics.

Sequential covering: each rule grows one condition at a time, taking the threshold with the best information
gain over the rows not yet covered, until it covers (almost) none of the other class; it is then pruned from its
end against rows it was not grown on. The list is emitted as one ordered Spark conditional expression. Statistics,
growing and pruning are DataFrame operations; the driver only sees counts per feature and threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, staged, word_array

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_chars"]
FEATURES = {  # name: (statistic, factor, per)
    "word_length": ("word_chars", 1, "n_words"),
    "symbols_per_100_words": ("n_symbols", 100, "n_words"),
    "repeated_words_percent": ("n_repeat_words", 100, "n_words"),
    "dup_lines_per_100_words": ("n_dup_lines", 100, "n_words"),
    "capitals_percent": ("n_capitals", 100, "word_chars"),
    "marks_per_100_words": ("n_marks", 100, "n_words"),
    "words": ("n_words", 1, None),
}
INDEX = (1 << 30) - 1


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``STATS`` (long) of the whole ``text``.

    n_repeat_words: the words inside 3-word windows that occur at least twice. Windows are sorted by a 34-bit hash
    with their position in the low 30 bits, so equal ones are neighbours; neighbours are compared word by word, and
    should two different windows share a hash, that text's windows are sorted as strings instead. Null or empty
    text: all zero.
    """
    get = lambda a, i: F.get(F.col(a), i)
    without = lambda chars: F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), chars, ""))
    d = docs.select(*keep, "text").withColumn("w", F.coalesce(word_array(F.col("text")), F.array().cast("array<string>")))
    d = d.withColumn("lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(WHITE)) != ""))
    windows = F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0)))
    hashed = F.transform(windows, lambda x, i: F.xxhash64(x, get("w", i + 1), get("w", i + 2)).bitwiseAND(F.lit(~INDEX)).bitwiseOR(i.cast("long")))
    d = d.withColumn("k", F.sort_array(hashed))
    same = lambda x, y: F.shiftright(x, 30).eqNullSafe(F.shiftright(y, 30))
    d = d.withColumn("c", F.filter("k", lambda x, i: same(x, get("k", i - 1)) | same(x, get("k", i + 1))))
    at = lambda x: x.bitwiseAND(F.lit(INDEX)).cast("int")
    word = lambda x, j: get("w", at(x) + j)
    differ = lambda x, y: (word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2))
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size("c") - 1, F.lit(1))), lambda i: F.coalesce(same(get("c", i), get("c", i - 1)) & differ(get("c", i), get("c", i - 1)), F.lit(False)))
    d = d.withColumn("clash", F.when(F.size("c") > 0, clash).otherwise(False))
    strings = F.transform(windows, lambda x, i: F.struct(F.concat_ws(" ", x, get("w", i + 1), get("w", i + 2)).alias("g"), i.alias("i")))
    d = d.withColumn("s", F.when(F.col("clash"), F.sort_array(strings)))
    exact = F.filter("s", lambda x, i: x["g"].eqNullSafe(get("s", i - 1)["g"]) | x["g"].eqNullSafe(get("s", i + 1)["g"]))
    starts = F.when(F.col("clash"), F.transform(exact, lambda x: x["i"].cast("int"))).otherwise(F.transform("c", at))
    d = d.withColumn("p", F.sort_array(starts))
    covered = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(get("p", i + 1) - x, F.lit(3))).cast("long"))
    return d.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        (F.length(F.coalesce("text", F.lit(""))) - without(WHITE)).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        without("!?").cast("long").alias("n_marks"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
    )


def base_failed() -> Column:
    """Too short, or more than half of it repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    """A feature as double; 0 where its divisor is 0."""
    of, factor, per = FEATURES[name]
    value = factor * F.col(of)
    return value.cast("double") if per is None else F.coalesce(F.try_divide(value, F.col(per)).cast("double"), F.lit(0.0))


@dataclass
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class Rule:
    verdict: bool
    conditions: list[Condition]
    covered: int = 0
    right: int = 0

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return f"{'keep' if self.verdict else 'reject'} if {' and '.join(map(str, self.conditions))} ({self.right} of {self.covered})"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def column(self) -> Column:
        """One conditional expression over ``STATS`` columns: the first rule that holds decides."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), r.verdict) if out is None else out.when(r.column(), r.verdict)
        return F.lit(self.default) if out is None else out.otherwise(self.default)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_rules: int = 8, max_conditions: int = 3, bins: int = 64, least_precision: float = 0.9, least_cover: int = 10) -> DecisionList:
    """Learn rules that reject low quality from ``labels`` (doc_id, quality).

    The statistics of at most about ``max_rows`` labelled documents are used, picked by a hash of doc_id (the
    documented bound; one in three of them prunes). Rows with a null id, text or quality are left out; labels that
    repeat or contradict each other all count. A rule enters only with ``least_precision`` on both parts and
    ``least_cover`` rows, so without clear evidence the list is empty and keeps everything.
    """
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("_quality")).dropna()
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    picked = known.filter(u < math.ceil((1 << 20) * min(1.0, max_rows / max(n, 1))))
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(picked), "doc_id")
    stats = text_stats(rows, ["doc_id", "_quality"])
    valued = stats.select(
        (F.col("_quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"), *STATS
    )
    rows = staged(staged(valued).coalesce(4))  # written first, so that the scan of all documents keeps its tasks
    values = {f: feature(f) for f in FEATURES}
    cuts = rows.agg(*[F.percentile_approx(v, [i / bins for i in range(bins + 1)], 10_000).alias(f) for f, v in values.items()]).first()
    seen = {f: sorted({float(x) for x in cuts[f] or []}) for f in FEATURES}
    thresholds = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in seen.items()}  # midway, to be as far as can be from both

    def place(f: str) -> Column:
        """How many thresholds of a feature lie below its value."""
        below = F.filter(F.array(*map(F.lit, thresholds[f])).cast("array<double>"), lambda t: t < values[f])
        return F.struct(F.lit(f).alias("f"), F.size(below).alias("b"))

    binned = rows.select("bad", "prune", *STATS, F.array(*map(place, FEATURES)).alias("x"))
    binned = staged(binned)

    def counts(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        return r["p"], r["n"]

    def grow(df: DataFrame) -> list[Condition]:
        chosen: list[Condition] = []
        p, n = counts(df)
        while n and p and len(chosen) < max_conditions:
            table: dict[str, dict[int, tuple[int, int]]] = {}
            for r in df.select(F.explode("x").alias("x"), "bad").groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count("*").alias("n")).collect():
                table.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"] - r["p"])
            best, found = 0.0, None
            for f in FEATURES:
                below_p = below_n = 0
                for i, t in enumerate(thresholds[f]):
                    a, b = table.get(f, {}).get(i, (0, 0))
                    below_p, below_n = below_p + a, below_n + b
                    for above, cp, cn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                        if cp >= least_cover:
                            gain = cp * (math.log2(cp / (cp + cn)) - math.log2(p / (p + n)))
                            if gain > best + 1e-9:
                                best, found = gain, (Condition(f, above, t), cp, cn)
            if not found:
                break
            condition, p, n = found
            chosen.append(condition)
            df = df.filter(condition.column())
        return chosen

    out, left = DecisionList(), binned
    while len(out.rules) < max_rules:
        conditions = grow(left.filter(~F.col("prune")))
        if not conditions:
            break
        options = [Rule(False, conditions[:k]) for k in range(1, len(conditions) + 1)]
        tests = [c for i, r in enumerate(options) for c in (F.count_if(r.column() & F.col("bad")).alias(f"p{i}"), F.count_if(r.column()).alias(f"n{i}"))]
        tally = {bool(r["prune"]): r for r in left.groupBy("prune").agg(*tests).collect()}
        held, grown = tally.get(True), tally.get(False)
        score = lambda i: (held[f"p{i}"] - (held[f"n{i}"] - held[f"p{i}"])) / max(held[f"n{i}"], 1) if held else 0  # noqa: B023, E731
        i = max(range(len(options)), key=lambda i: (round(score(i), 9), -i))
        precise = lambda r: r is not None and r[f"n{i}"] and r[f"p{i}"] >= least_precision * r[f"n{i}"]  # noqa: B023, E731
        if not (precise(grown) and precise(held)):
            break
        rule = options[i]
        rule.right, rule.covered = held[f"p{i}"] + grown[f"p{i}"], held[f"n{i}"] + grown[f"n{i}"]
        out.rules.append(rule)
        left = left.filter(~rule.column())
    return out


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Add base_failed and kept to rows with ``STATS``."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that base rules and learned rules keep."""
    names = docs.columns
    rules = learn(docs, labels, **options)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    # the row number keeps the optimizer from pushing the filter, with a copy of every statistic, below the projections
    judged = judge(text_stats(wrapped, ["_row"]), rules).withColumn("_at", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_at") >= 0)).select(*[F.col("_row").getField(c).alias(c) for c in names])
