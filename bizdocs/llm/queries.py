"""One query per corpus operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, decontaminate, html_wrapper, language_id, lexical_search, license_scan, ngram_join, packing, quality_rules, structure_repair, token_count, toxicity, url_filter
from .common import read
from .registry import query


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, read(spark, sf_dir, "labels"))
    stats = quality_rules.text_stats(docs, ["doc_id"])
    return quality_rules.judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _normal_sql(column: str) -> str:
    out = f"trim(regexp_replace(lower(regexp_replace({column}, '{license_scan.COPYRIGHT}', '', 'g')), '{license_scan.PUNCTUATION}', ' ', 'g'))"
    for pattern, to in license_scan.SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return out


def _known_sql() -> str:
    rows = [(i, n.format(x)) for i, names in license_scan.NAMES.items() for x in names for n in license_scan.NOTICES] + list(license_scan.TEXTS.items())
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)
    return f"SELECT form, min(license_id) AS license_id FROM (SELECT license_id, {_normal_sql('text')} AS form FROM (VALUES {values}) k(license_id, text)) GROUP BY form"


OP2_SQL = f"""
WITH known AS ({_known_sql()}),
lines AS (SELECT doc_id, {_normal_sql('line')} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
notices AS (SELECT doc_id, string_agg(DISTINCT license_id, '|' ORDER BY license_id) AS notices FROM lines JOIN known USING (form) GROUP BY doc_id),
whole AS (SELECT doc_id, {_normal_sql('text')} AS form FROM documents)
SELECT doc_id, sha256(whole.form) AS digest, license_id, coalesce(notices, '') AS notices FROM whole LEFT JOIN known USING (form) LEFT JOIN notices USING (doc_id)"""


@query("op2_license_scan", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents"), license_scan.known_texts(spark))
    return found.withColumn("notices", F.array_join("notices", "|"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


URL_RULES = [url_filter.Rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def _rule_sql(host: str, path: str, pick: str) -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r.pattern))
    arms = " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{getattr(r, pick)}'" for r in rules)
    return f"CASE {arms} END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _node_sql(host: str, path: str, query: str) -> str:
    parts = f"list_reduce([[x] for x in string_split({path}, '/')], lambda a, s: CASE WHEN s[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1 : len(a) - 1] ELSE a END WHEN s[1] = '.' THEN a ELSE a || s END)"
    whole = f"CASE WHEN contains({path}, '/.') THEN array_to_string({parts}, '/') || CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN '/' ELSE '' END WHEN {path} = '' THEN '/' ELSE {path} END"
    return f"regexp_replace({host}, '{url_filter.DEFAULT_PORT}', '') || {whole} || {query}"


def _resolved_sql(target: str, host: str, path: str) -> str:
    whole = f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"
    return (
        f"CASE WHEN regexp_matches({target}, '{url_filter.ABSOLUTE}') THEN {target} WHEN starts_with({target}, '//') THEN 'http:' || {target} "
        f"WHEN starts_with({target}, '/') THEN 'http://' || {host} || {target} WHEN left({target}, 1) IN ('?', '#') THEN 'http://' || {host} || {whole} || {target} "
        f"ELSE 'http://' || {host} || regexp_extract({whole}, '^(.*/)?[^/]*$', 1) || {target} END"
    )


OP4_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, url, html, regexp_extract(url, {_quoted(url_filter.PARTS)}, ['h', 'p', 'q']) AS x FROM pages),
p AS (SELECT page_id, url, html, coalesce(translate(x.h, '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host, coalesce(x.p, '') AS path, x.q AS query FROM u),
n AS (SELECT *, CASE WHEN host <> '' THEN {_node_sql('host', 'path', 'query')} END AS node FROM p),
t AS (SELECT node, url, host, path, replace(regexp_extract(html, {_quoted(url_filter.BASE)}, 1), '&amp;', '&') AS base, unnest(regexp_extract_all(html, {_quoted(url_filter.TAGS)})) AS tag FROM n),
l AS (SELECT node, url, host, path, base, replace(CASE WHEN regexp_matches(tag, {_quoted(url_filter.CANONICAL)}) THEN regexp_extract(tag, {_quoted(url_filter.HREF)}, 1)
      WHEN regexp_matches(tag, {_quoted(url_filter.REFRESH)}) THEN regexp_extract(tag, {_quoted(url_filter.TARGET)}, 1) END, '&amp;', '&') AS dst FROM t),
f AS (SELECT node, dst, regexp_extract(CASE WHEN base = '' THEN url ELSE {_resolved_sql('base', 'host', 'path')} END, {_quoted(url_filter.PARTS)}, ['h', 'p', 'q']) AS x FROM l WHERE dst <> ''),
w AS (SELECT node AS a, regexp_extract({_resolved_sql('dst', f"translate(x.h, '{url_filter.UPPER}', '{url_filter.LOWER}')", 'x.p')}, {_quoted(url_filter.PARTS)}, ['h', 'p', 'q']) AS x FROM f),
e AS (SELECT a, {_node_sql(f"translate(x.h, '{url_filter.UPPER}', '{url_filter.LOWER}')", 'x.p', 'x.q')} AS b FROM w WHERE x.h <> ''),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS v, a AS c FROM g UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v),
v AS (SELECT c, max(CASE verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS best FROM
      (SELECT c, {_rule_sql("regexp_extract(v, '^[^/]*')", "regexp_extract(v, '^[^/]*([^?]*)', 1)", 'verdict')} AS verdict FROM r) GROUP BY c)
SELECT page_id, host, path, {_rule_sql('host', 'path', 'pattern')} AS rule,
       coalesce({_rule_sql('host', 'path', 'verdict')}, CASE best WHEN 2 THEN 'allow' WHEN 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM n LEFT JOIN v ON v.c = n.node"""


@query("op4_url_filter", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_count.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_count.count_tokens(read(spark, sf_dir, "documents"), scores)


OP6_SQL = f"""
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
v AS (SELECT s.conv_id, perspective, CAST(greatest(coalesce(floor(turn / 64), 0), 0) AS BIGINT) AS block, turn, role, text,
      '{chat_format.START}' || CASE WHEN role = 'system' THEN role WHEN role = perspective THEN 'assistant' ELSE 'user name=' || replace(role, '<|', '< |') END || chr(10) AS head,
      replace(text, '<|', '< |') || '{chat_format.END}' AS body FROM s JOIN m USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, role, text) - length(body) - 1 AS pos FROM v)
SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CASE WHEN role = perspective THEN CAST(pos AS BIGINT) || '-' || CAST(pos + length(body) AS BIGINT) END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM o GROUP BY conv_id, perspective, block"""


@query("op6_chat_perspectives", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_format.perspectives(read(spark, sf_dir, "conversations"))
    return views.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ","))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(s) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM d, ks, unnest(range(1, greatest(len(w) - k + 2, 1))) AS r(s)),
h AS (SELECT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""


@query("op10_benchmark_decontamination", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.n_hit(decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return leaks.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated")
    )


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(s) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(c) AS component_id FROM r GROUP BY v) c USING (doc_id)"""


@query("op9_ngram_jaccard_join", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:h1|p)>') AS parts FROM pages),
t AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) for x in parts] AS blocks FROM a),
f AS (SELECT page_id, url, [x for x in blocks if x <> ''] AS blocks FROM t)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(blocks, chr(10)), '')) AS BIGINT) AS n_chars FROM f"""


@query("op13_html_extraction", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(read(spark, sf_dir, "pages"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS terms FROM d WHERE len(words) > 0),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT doc_id, term, 10 + (90 * n * docs) // terms AS m, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d), s WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM b JOIN t USING (term) JOIN w USING (term) GROUP BY item_id, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ord(x) AS BIGINT) for x in string_split(key, '')]), lambda a, b:
        list_reduce(list_prepend(xor(a, b), range(8)), lambda p, q: xor(p >> 1, CASE WHEN p & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) % 20 AS h FROM (SELECT DISTINCT key FROM k)),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM k JOIN h USING (key), (VALUES (1), (2)) AS v(i) WHERE h <> 0 AND (i = 1 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS core FROM d),
t AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
        CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM t GROUP BY conv_id),
move AS (SELECT * FROM (VALUES ('0', 's', 'h'), ('0', 'u', 'u'), ('h', 'u', 'u'), ('p', 'u', 'u'), ('u', 'a', 'p')) AS v(s, r, s2)),
ins AS (SELECT * FROM (VALUES ('0', '0', ''), ('h', 'h', ''), ('u', 'u', ''), ('p', 'p', ''), ('0', 'u', 'I'), ('0', 'p', 'II'), ('h', 'u', 'I'), ('h', 'p', 'II'), ('u', 'p', 'I'), ('p', 'u', 'I')) AS v(s, s2, a)),
step AS (SELECT conv_id, pos, s, s2, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS c, 'K' AS a FROM t JOIN move ON r = ini WHERE fault IN ('', 'truncated')
   UNION ALL SELECT conv_id, pos, s, s2, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R' FROM t JOIN move ON r <> 's' WHERE fault IN ('', 'truncated')
   UNION ALL SELECT conv_id, pos, s, s, 4, 'D' FROM t, (VALUES ('0'), ('h'), ('u'), ('p')) AS v(s)),
r AS (SELECT conv_id, 0::BIGINT AS pos, s2 AS s, {'c': 3 * len(a), 'a': a} AS w FROM n, ins WHERE s = '0'
   UNION ALL SELECT r.conv_id, any_value(r.pos) + 1, ins.s2, min({'c': r.w.c + step.c + 3 * len(ins.a), 'a': r.w.a || step.a || ins.a})
   FROM r JOIN step ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND step.pos = r.pos + 1 AND step.s = r.s JOIN ins ON ins.s = step.s2 GROUP BY r.conv_id, ins.s2),
e AS (SELECT r.conv_id, min(w) AS w FROM r JOIN n ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.pos = n.n WHERE s IN ('0', 'p') GROUP BY r.conv_id),
x AS (SELECT conv_id, i, w.a[i] AS edit FROM e, unnest(range(1, len(w.a) + 1)) AS g(i)),
y AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM x),
z AS (SELECT y.conv_id, i, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, sum(CASE WHEN edit = 'K' AND ini = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY y.conv_id ORDER BY i) AS m
      FROM y LEFT JOIN t ON y.conv_id IS NOT DISTINCT FROM t.conv_id AND y.pos = t.pos WHERE edit <> 'D'),
q AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN m % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole FROM z GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(e.w.c, 0) AS BIGINT) AS cost, coalesce(e.w.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN q ON c.conv_id IS NOT DISTINCT FROM q.conv_id"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with the faults that the query plants: a row is dropped, emptied, cut, repeated or reroled."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("_")


@query("op12_structure_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    found = structure_repair.repair_summary(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in structure_repair.SUMMARY]
    nothing = F.sha2(F.lit(""), 256)
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
