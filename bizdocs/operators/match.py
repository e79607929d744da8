"""Item-master matching: exact tiers as equi-joins, the rest by an exact top-k rank join.

Lines are first reduced to distinct *probes*.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from bizdocs.functions import numbers as N
from bizdocs.functions.similarity import grams, sequence_ratio, similarity
from bizdocs.functions.text import material_grade, mentions_broad_material, normalize_item_text, normalize_spec, real_code, thickness
from bizdocs.operators import rank_join as R
from bizdocs.operators.ordering import top_per
from bizdocs.session import cut

AUTO, REVIEW, FLOOR, GAP = 0.90, 0.65, 0.35, 0.03
PROBE = ["item_code", "item_name", "specification", "unit", "unit_price"]


def with_probe(lines: DataFrame) -> DataFrame:
    """Add ``probe_id``: equal for lines whose matching inputs are equal."""
    return lines.withColumn("probe_id", F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in PROBE]))))


def probes(lines: DataFrame) -> DataFrame:
    keyed = with_probe(lines)
    return keyed.groupBy("probe_id").agg(*[F.any_value(c).alias(c) for c in PROBE])


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("active", F.lit(True)))


def alias_entries(master: DataFrame, alias: DataFrame) -> DataFrame:
    """Inline alias arrays and active alias records of active items: (item_id, name, spec)."""
    m = active(master)
    inline = m.select("item_id", F.explode("aliases").alias("name"), F.lit(None).cast("string").alias("spec"))
    records = active(alias).join(m.select("item_id"), "item_id", "left_semi").select("item_id", F.col("alias_name").alias("name"), F.col("alias_spec").alias("spec"))
    return inline.unionByName(records).filter(F.coalesce(F.trim("name"), F.lit("")) != "")


def match_exact_code(p: DataFrame, master: DataFrame) -> DataFrame:
    code = F.nullif(F.lower(F.trim("item_code")), F.lit(""))
    m = active(master).select("item_id", "internal_item_code", F.lower(F.trim("internal_item_code")).alias("_k"))
    return p.withColumn("_k", code).filter(F.col("_k").isNotNull()).join(m, "_k").select("probe_id", "item_id", "internal_item_code")


def match_alias_code(p: DataFrame, aliases: DataFrame) -> DataFrame:
    a = aliases.select("item_id", normalize_item_text("name").alias("_k")).filter("_k <> ''").distinct()
    s = p.select("probe_id", normalize_item_text("item_code").alias("_k")).filter("_k <> ''")
    return s.join(a, "_k").select("probe_id", "item_id")


def match_prefix_code(p: DataFrame, master: DataFrame, min_len: int = 8) -> DataFrame:
    """Strict-prefix codes as an equi-join: each master emits its own prefixes, so a common
    leading block of all codes never becomes one hot join key. Codes and thicknesses are read before the join, once per
    probe and per item; the prefixes of an item carry nothing but its id."""
    n = normalize_item_text("internal_item_code")
    right = thickness(F.concat_ws(" ", "internal_item_code", "item_name", "spec"))
    m = active(master).select("item_id", "internal_item_code", right.alias("_right"), n.alias("_n")).filter(F.length("_n") > min_len)
    m = m.select("item_id", "internal_item_code", "_right", F.explode(F.transform(F.sequence(F.lit(min_len), F.length("_n") - 1), lambda i: F.substring(F.col("_n"), 1, i))).alias("_k"))
    left = thickness(F.concat_ws(" ", "item_name", "specification", "item_code"))
    s = p.select("probe_id", left.alias("_left"), normalize_item_text("item_code").alias("_k")).filter(F.length("_k") >= min_len)
    return s.join(m, "_k").select("probe_id", "item_id", "internal_item_code", F.when(F.col("_left") == F.col("_right"), 0.92).otherwise(0.70).alias("floor"))


def spec_scores(pairs: DataFrame) -> DataFrame:
    """(source_spec, target_spec) normalised distinct pairs with a score; the ratio runs only where nothing simpler decides."""
    s, t = F.col("source_spec"), F.col("target_spec")
    simple = F.when((s == "") | (t == ""), 0.5).when(s == t, 1.0).when(t.contains(s) | s.contains(t), 0.75)
    decided = pairs.withColumn("spec_score", simple)
    rest = decided.filter("spec_score IS NULL").withColumn("spec_score", sequence_ratio("source_spec", "target_spec") * 0.80)
    return decided.filter("spec_score IS NOT NULL").unionByName(rest)


def _pair_scores(pairs: DataFrame, names: DataFrame, specs: DataFrame) -> DataFrame:
    """name_score, alias_score and spec_score of given (a, source_spec, item_id); every name of the item counts."""
    hits = cut(pairs.select("a", "source_spec", "item_id").distinct().join(names.withColumnRenamed("name", "b"), "item_id", "left"))
    sims = hits.filter("b IS NOT NULL").select("a", "b").distinct().withColumn("sim", similarity("a", "b"))
    hits = hits.join(sims, ["a", "b"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    alias_specs = spec_scores(hits.filter("spec <> ''").select("source_spec", F.col("spec").alias("target_spec")).distinct()).withColumnsRenamed({"target_spec": "spec", "spec_score": "alias_spec_score"})
    hits = hits.join(alias_specs, ["source_spec", "spec"], "left")
    value = F.when(F.col("is_alias") & F.col("alias_spec_score").isNotNull(), F.col("sim") * R.ALIAS_NAME + F.col("alias_spec_score") * R.ALIAS_SPEC).otherwise(F.col("sim"))
    best = cut(hits.groupBy("a", "source_spec", "item_id").agg(F.max(value).alias("name_score"), F.coalesce(F.max(F.when(F.col("is_alias"), value)), F.lit(0.0)).alias("alias_score")))
    full = best.join(specs, "item_id")
    return full.join(spec_scores(full.select("source_spec", "target_spec").distinct()), ["source_spec", "target_spec"]).drop("target_spec")


def match_fuzzy(p: DataFrame, master: DataFrame, aliases: DataFrame, prefix: DataFrame | None = None, keep: int = 6, block_names: int = 20_000) -> DataFrame:
    """Scored candidates (probe_id, item_id, score, …) with score >= 0.35 for probes without an exact hit.

    Per probe the ``keep`` best of all items by score, then item_id, as comparing every pair would give them, all its
    prefix hits, and two items whose alias is sure where there are so many (a match by alias asks for one alone).
    Ranks, ambiguity and status need no more."""
    m = active(master)
    name = lambda c: F.coalesce(normalize_item_text(c), F.lit(""))
    names = (
        m.select("item_id", name("item_name").alias("name"), F.lit("").alias("spec"), F.lit(False).alias("is_alias"))
        .unionByName(aliases.select("item_id", name("name").alias("name"), F.coalesce(normalize_spec("spec"), F.lit("")).alias("spec"), F.lit(True).alias("is_alias")))
        .filter("name <> ''").distinct()
    )
    lower = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    price = F.col("unit_price") if not N.is_text(p, "unit_price") else N.strict_decimal("unit_price")
    src = cut(p.withColumns({"a": name("item_name"), "source_spec": F.coalesce(normalize_spec("specification"), F.lit("")), "source_unit": lower("unit"), "source_price": price.cast("double")}))
    specs = m.select("item_id", F.coalesce(normalize_spec("spec"), F.lit("")).alias("target_spec"))
    known = names.groupBy("item_id").agg(F.collect_list(F.struct("name", "spec", "is_alias")).alias("names"))
    items = m.select("item_id", lower("unit").alias("target_unit"), F.col("standard_price").cast("double").alias("target_price")).join(specs, "item_id").join(known, "item_id", "left")
    found = R.top_items(src, items.withColumn("names", F.coalesce("names", F.array().cast("array<struct<name:string,spec:string,is_alias:boolean>>"))), keep, block_names)
    same = F.col("s.source_price").eqNullSafe(F.col("f.source_price"))
    for c in R.PROBE_KEYS[:3]:
        same = same & (F.col(f"s.{c}") == F.col(f"f.{c}"))
    found = src.alias("s").join(found.alias("f"), same).select("s.*", "f.item_id", "f.name_score", "f.alias_score", "f.spec_score", F.lit(None).cast("double").alias("floor"))
    if prefix is not None:
        pairs = prefix.select("probe_id", "item_id", "floor").join(src, "probe_id")
        pairs = pairs.join(_pair_scores(pairs, names, specs), ["a", "source_spec", "item_id"]).select(*found.columns)
        found = pairs.unionByName(found.join(prefix.select("probe_id", "item_id"), ["probe_id", "item_id"], "left_anti").select(*found.columns))
    cols = m.select("item_id", "internal_item_code", F.col("item_name").alias("master_name"), F.col("spec").alias("master_spec"), F.col("unit").alias("master_unit"), "standard_price")
    full = found.join(cols, "item_id")
    raw = F.col("name_score") * R.NAME + F.col("spec_score") * R.SPEC + N.unit_score("unit", "master_unit") * R.UNIT + N.price_score(price, "standard_price") * R.PRICE
    out = full.withColumn("score", F.round(F.greatest(raw, F.coalesce("floor", F.lit(0.0))), 3)).filter(F.col("score") >= FLOOR)
    return out.select(
        "probe_id", "item_id", "internal_item_code", "master_name", "master_spec", "score", F.lit(False).alias("direct"), F.lit(False).alias("alias_code"),
        (F.col("alias_score") >= R.SURE_ALIAS).alias("alias_name"), F.col("floor").isNotNull().alias("prefix"))


def match_candidates(lines: DataFrame, master: DataFrame, alias: DataFrame) -> DataFrame:
    """All candidates per probe: exact ones alone where there are any, else the scored rest."""
    p = cut(probes(lines))
    aliases = alias_entries(master, alias)
    direct = match_exact_code(p, master).select("probe_id", "item_id", F.lit(True).alias("direct"), F.lit(False).alias("alias_code"))
    by_alias = match_alias_code(p, aliases).select("probe_id", "item_id", F.lit(False).alias("direct"), F.lit(True).alias("alias_code"))
    exact = direct.unionByName(by_alias).groupBy("probe_id", "item_id").agg(F.bool_or("direct").alias("direct"), F.bool_or("alias_code").alias("alias_code"))
    m = active(master).select("item_id", "internal_item_code", F.col("item_name").alias("master_name"), F.col("spec").alias("master_spec"))
    exact = exact.join(m, "item_id").withColumns({"score": F.lit(1.0), "alias_name": F.lit(False), "prefix": F.lit(False)})
    rest = cut(p.join(exact.select("probe_id"), "probe_id", "left_anti"))
    return exact.unionByName(match_fuzzy(rest, master, aliases, match_prefix_code(rest, master)))


def _order() -> list[Column]:
    return [F.col("direct").desc(), F.col("score").desc(), F.col("item_id").asc()]


def rank_candidates(scored: DataFrame, keep: int = 5) -> DataFrame:
    return top_per(scored, ["probe_id"], _order(), keep)


def leading_items(master: DataFrame, alike: list[str], keep: int = 6) -> DataFrame:
    """The first ``keep`` items by id of those that score alike (equal in ``alike``) for every probe: as an equal score goes
    to the smaller id, no other item can be among the ``keep`` best of a probe."""
    return top_per(master, alike, [F.col("item_id").asc()], keep, "_place").drop("_place")


def leading(scored: DataFrame, keep: int = 6) -> DataFrame:
    """What ranks, ambiguity and status need of the candidates: per probe the ``keep`` best with and without an alias."""
    by_alias = F.col("alias_code") | F.col("alias_name")
    return top_per(scored.withColumn("_by_alias", by_alias), ["probe_id", "_by_alias"], _order(), keep, "_place").drop("_by_alias", "_place")


def ambiguity(scored: DataFrame) -> DataFrame:
    """Best candidate per probe with the runner-up's score; within 0.03 is ambiguous."""
    two = top_per(scored, ["probe_id"], _order(), 2)
    best = two.groupBy("probe_id").agg(
        F.max_by(F.struct(*[c for c in scored.columns if c != "probe_id"]), -F.col("rank")).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    gap = F.round(F.col("best.score") - F.col("second"), 6)
    return best.select("probe_id", "best.*", "second", F.coalesce(gap <= GAP, F.lit(False)).alias("ambiguous"))


def grade_ambiguity(scored: DataFrame, p: DataFrame) -> DataFrame:
    """Two or more material grades among the first six candidates while the source names only a broad material."""
    six = top_per(scored, ["probe_id"], _order(), 6).filter(F.col("score") >= FLOOR)
    grade = material_grade(F.concat_ws(" ", "internal_item_code", "master_name", "master_spec"))
    n = six.groupBy("probe_id").agg(F.count_distinct(grade).alias("n_grades"))
    source = F.concat_ws(" ", F.coalesce("item_name", F.lit("")), F.coalesce("specification", F.lit("")))
    broad = mentions_broad_material(source) & material_grade(source).isNull()
    return p.join(n, "probe_id", "left").select("probe_id", F.coalesce(broad & (F.col("n_grades") >= 2), F.lit(False)).alias("material_ambiguous"))


def assign_match_status(scored: DataFrame, p: DataFrame, has_master: bool = True) -> DataFrame:
    """Status, reason and internal code per probe."""
    if not has_master:
        none = F.lit(None)
        return p.select("probe_id", none.cast("string").alias("internal_item_code"), none.cast("double").alias("confidence"),
                        F.lit("skipped_no_item_master").alias("status"), F.lit("NO_ITEM_MASTER").alias("reason"))
    ties = scored.groupBy("probe_id").agg(F.count_if(F.col("alias_code") | F.col("alias_name")).alias("n_alias"))
    df = p.select("probe_id").join(ambiguity(scored), "probe_id", "left").join(ties, "probe_id", "left").join(grade_ambiguity(scored, p), "probe_id", "left")
    alias_hit = (F.col("alias_code") | F.col("alias_name")) & (F.col("n_alias") <= 1)
    broad = F.col("material_ambiguous")
    auto = (F.col("score") >= AUTO) & ~F.col("ambiguous") & ~broad
    out = lambda s, r, keep: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"), F.lit(keep).alias("keep"))
    verdict = (
        F.when(F.col("direct"), out("direct_code_match", "DOCUMENT_CODE_MATCHED_INTERNAL_CODE", True))
        .when(alias_hit & broad & ~F.col("alias_code"), out("ambiguous", "BROAD_MATERIAL_GRADE_REVIEW_REQUIRED", False))
        .when(alias_hit, out("alias_matched", "DOCUMENT_CODE_MATCHED_ITEM_ALIAS", True))
        .when(F.col("prefix") & auto, out("auto_matched", "PARTIAL_DOCUMENT_CODE_WITH_EXPLICIT_NAME_SPEC_MATCH", True))
        .when(auto, out("auto_matched", "HIGH_CONFIDENCE_MATCH", True))
        .when(F.col("score") >= REVIEW, out("ambiguous", "CANDIDATE_REVIEW_REQUIRED", False))
        .otherwise(out("unmatched", "NO_CONFIDENT_MATCH", False))
    )
    return df.withColumn("v", verdict).select(
        "probe_id", F.when(F.col("v.keep"), F.col("internal_item_code")).alias("internal_item_code"), F.col("score").alias("confidence"), "v.status", "v.reason",
        F.when(F.col("v.keep"), F.col("master_spec")).alias("master_spec"))


def match_lines(lines: DataFrame, master: DataFrame, alias: DataFrame) -> DataFrame:
    """Lines with their match status; the per-probe result is joined back on the probe."""
    status = assign_match_status(cut(match_candidates(lines, master, alias)), probes(lines))
    return with_probe(lines).join(status.withColumnRenamed("internal_item_code", "matched_code"), "probe_id", "left")


def resolve_spec_conflict(matched: DataFrame) -> DataFrame:
    """Where the matched master's spec is unlike the line's (< 0.45): keep both, flag, and drop the
    line's own spec unless it must stay visible."""
    names = set(matched.columns)
    has = lambda c: (F.col(c).isNotNull() & (F.col(c).cast("string") != "")) if c in names else F.lit(False)
    keep = has("received_quantity") | has("accepted_quantity") | has("defective_quantity") | has("inspection_result")
    if "no_price_document" in names:
        keep = keep | (F.coalesce("no_price_document", F.lit(False)) & (has("quantity") | has("requested_quantity") | has("delivered_quantity")))
    if "spec_visible" in names:
        keep = keep | F.coalesce("spec_visible", F.lit(False))
    # a specification is normalised and scored once, however many lines have it
    written = matched.select(F.col("specification").alias("_s"), F.col("master_spec").alias("_t")).distinct()
    written = cut(written.withColumns({"source_spec": normalize_spec("_s"), "target_spec": normalize_spec("_t")}))
    scores = spec_scores(written.select("source_spec", "target_spec").distinct())
    scores = written.join(scores, ["source_spec", "target_spec"]).select("_s", "_t", "spec_score")
    same = F.col("specification").eqNullSafe(F.col("_s")) & F.col("master_spec").eqNullSafe(F.col("_t"))
    both = F.coalesce(F.nullif("specification", F.lit("")), F.lit(None)).isNotNull() & F.nullif(F.col("master_spec"), F.lit("")).isNotNull()
    df = matched.join(scores, same, "left").withColumn("spec_conflict", F.coalesce(both & (F.col("spec_score") < 0.45), F.lit(False)))
    suppressed = F.col("spec_conflict") & ~keep
    flag = F.array(F.lit("specification_conflict_with_item_master"))
    add = lambda c: F.when(F.col("spec_conflict"), F.array_union(F.coalesce(c, F.array().cast("array<string>")), flag)).otherwise(F.col(c))
    return df.withColumns({
        "source_specification": F.when(F.col("spec_conflict"), F.col("specification")), "specification": F.when(~suppressed, F.col("specification")),
        "suppressed_reason": F.when(suppressed, "item_master_conflict"), "review_flags": add("review_flags"), "validation_warnings": add("validation_warnings"),
    }).drop("_s", "_t")


def ratio_candidates(left: DataFrame, right: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """All pairs of distinct texts (``by…, text``) whose sequence ratio can reach ``threshold`` (> 2/3), exactly.

    With ratio >= t over total length n, at least t·n/2 characters match in at most (1-t)·n+1 blocks,
    so the texts share at least n·(1.5t-1)-1 bigrams (copies numbered). That allows a prefix filter on
    rarest-first bigrams; for pairs too short for the bound (n below 1/(1.5t-1)) single characters are used."""
    slope = 1.5 * threshold - 1
    if slope <= 0:
        raise ValueError("threshold must be above 2/3")
    short = math.ceil(1 / slope)
    size = F.length("text")
    need = F.greatest(F.ceil(size * F.lit(2 / (2 - threshold) * slope) - 1 - 1e-9), F.lit(1))
    freq = left.select(*by, F.explode(grams(F.col("text"), 2)).alias("g")).unionByName(
        right.select(*by, F.explode(grams(F.col("text"), 2)).alias("g"))).groupBy(*by, "g").agg(F.count("*").alias("f"))

    def keys(df: DataFrame) -> DataFrame:
        exploded = df.select(*by, "text", need.cast("int").alias("need"), F.explode(grams(F.col("text"), 2)).alias("g")).join(freq, [*by, "g"])
        ordered = F.array_sort(F.collect_list(F.struct("f", "g")))  # bounded by one text's length
        pre = exploded.groupBy(*by, "text").agg(F.slice(ordered, F.lit(1), F.greatest(F.count("*") - F.first("need") + 1, F.lit(1)).cast("int")).alias("pre"))
        main = pre.select(*by, "text", F.explode("pre.g").alias("g"))
        tiny = df.filter(size < short).select(*by, "text", F.explode(F.array_distinct(F.split("text", ""))).alias("g"))
        return main.unionByName(tiny)

    a, b = keys(left).withColumnRenamed("text", "a"), keys(right).withColumnRenamed("text", "b")
    la, lb = F.length("a"), F.length("b")
    fits = (F.least(la, lb) * 2 >= (la + lb) * F.lit(threshold))  # M <= shorter length
    return a.join(b, [*by, "g"]).filter(fits).select(*by, "a", "b").distinct()
