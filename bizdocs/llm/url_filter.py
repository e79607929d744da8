"""URL filtering with redirect equivalence, in DataFrame operations only.

A url is judged by the longest host-and-path rule that fits it. One without a rule takes the verdict of its
aliases: urls that redirects or canonical links connect form components, and a block on any member blocks the
others, unless a member is explicitly allowed (allow takes precedence). Without either it is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged
from .graph import components

PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
TAGS = "(?is)<(?:link|meta)\\b[^>]*>"
CANONICAL = "(?is)\\brel\\s*=\\s*[\"']?canonical\\b"
REFRESH = "(?is)\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b"
HREF = "(?is)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
BASE = "(?is)<base\\b[^>]*?\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
DEFAULT_PORT = ":(80|443)$"
ABSOLUTE = "^[A-Za-z][A-Za-z0-9+.-]*://"
TARGET = "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str  # host/path

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.element_at(parts, 1)), step)
    whole = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(path.contains("/."), whole).otherwise(path)


def resolved(target: Column, host: Column, path: Column) -> Column:
    """The absolute url of a link on a page of ``host`` and ``path``."""
    site = F.concat(F.lit("http://"), host)
    whole = F.when(path == "", "/").otherwise(path)
    folder = F.regexp_extract(whole, "^(.*/)?[^/]*$", 1)
    return (
        F.when(target.rlike(ABSOLUTE), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?") | target.startswith("#"), F.concat(site, whole, target))
        .otherwise(F.concat(site, folder, target))
    )


def with_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Add host (A-Z lower-cased), path, and node: what identifies a page, its host without port 80 or 443, its path
    without dot segments and its query, without scheme and fragment. Null and urls without ``://`` have an empty host
    and path and a null node."""
    host, path, node = (prefix + c for c in ("host", "path", "node"))
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), PARTS, i), F.lit(""))
    df = df.withColumns({host: F.translate(part(1), UPPER, LOWER), path: part(2), "_query": part(3)})
    whole = F.concat(F.regexp_replace(F.col(host), DEFAULT_PORT, ""), F.when(F.col(path) == "", "/").otherwise(without_dots(F.col(path))), F.col("_query"))
    return df.withColumn(node, F.when(F.col(host) != "", whole)).drop("_query")


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(verdict, pattern), else null; equally long: allow first, then by text.

    A rule fits its host and all subdomains where the path starts with the rule's path.
    """
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.pattern), r.verdict != "allow", r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,pattern:string>") if out is None else out


def page_links(pages: DataFrame) -> DataFrame:
    """src, dst urls of the canonical links and refresh redirects in ``html``; relative targets are resolved against
    the page's ``base`` where it has one, else against its url."""
    tags = F.explode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0)))
    plain = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    base = plain(F.regexp_extract("html", BASE, 1)).alias("base")
    found = pages.filter(F.col("html").rlike(CANONICAL) | F.col("html").rlike(REFRESH)).select("url", base, tags.alias("tag"))
    raw = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1))
    found = staged(found.select("url", "base", plain(raw).alias("to")))  # urls only
    found = with_parts(found.filter("to <> ''"), "url")
    found = found.withColumn("from", F.when(F.col("base") == "", F.col("url")).otherwise(resolved(F.col("base"), F.col("host"), F.col("path"))))
    found = with_parts(found, "from", "from_")
    return found.select(F.col("url").alias("src"), resolved(F.col("to"), F.col("from_host"), F.col("from_path")).alias("dst"))


def alias_verdicts(links: DataFrame, rules: list[Rule]) -> DataFrame:
    """node, alias_verdict for every url in a component where some member has a rule."""
    edges = with_parts(with_parts(staged(links.select("src", "dst")), "src", "a_"), "dst", "b_")
    edges = staged(edges.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    found = components(edges.filter("a <> b"))
    parts = with_parts(found.withColumn("url", F.concat(F.lit("x://"), F.col("vertex"))), "url")
    voted = parts.select("component", rule_for(F.col("host"), F.col("path"), rules)["verdict"].alias("v")).filter("v IS NOT NULL")
    votes = staged(voted.groupBy("component").agg(F.min("v").alias("alias_verdict")))  # allow comes before block
    return staged(found.join(votes, "component").select(F.col("vertex").alias("node"), "alias_verdict"))


def judge_urls(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The ``keep`` columns and host, path, rule, verdict of every row.

    ``pages`` needs url, and html unless ``links`` (src, dst urls) are given. Null or malformed urls have an empty
    host and path, no rule and no aliases, so they are allowed. Repeated rows each get their row.
    """
    verdicts = alias_verdicts(page_links(pages) if links is None else links, rules)
    base = with_parts(pages.select(*keep, F.col("url").alias("_url")), "_url").drop("_url")
    ruled = base.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    return ruled.join(verdicts, "node", "left").select(
        *keep, "host", "path", F.col("_rule.pattern").alias("rule"), F.coalesce("_rule.verdict", "alias_verdict", F.lit("allow")).alias("verdict")
    )
