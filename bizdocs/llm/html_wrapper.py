"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a balanced stream of block tags and text runs. Repeats in it become repeated groups; then the pages of a
host are aligned one after the other: differing texts become slots, blocks that some pages lack become optional,
runs that one page repeats and another has once become repeated groups. Wrappers of the same host are aligned in
the same way, so inference is an aggregate: every task aligns the pages it reads, the partial wrappers of a host
meet in rounds of small groups, whatever share of the pages the host has. No page is left out.

The wrapper says where a host keeps its articles: in ``article`` or ``main`` elements, else in the block where most
of the slots' unlinked text lies (text that all pages share is no slot). Each page is then aligned with the wrapper of
its host and gives the text of its blocks there, without menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Remember, staged
from .url_filter import with_parts

#: The element and class names that HTML and common site templates use.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg math canvas object audio video nav footer aside form menu dialog button select datalist input label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote figure td th li dd".split())
NOT_MAIN = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement adsense banner sponsor sponsored promo "
    "promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations comment comments commentlist reply replies respond disqus pager pagination toolbar complementary contentinfo search dialog".split()
)
NEGATED = frozenset("has with no without".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[A-Za-z/!?][^>]*\Z", re.S
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
UNSEEN = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

MANY = 2  # the upper quantifier of a repeated group
DEEPEST = 100  # blocks further down become children of the block at this level


class Block:
    """A block of one page, or of a wrapper, where its counts add up over pages."""

    __slots__ = ("label", "children", "items", "members", "pages", "chars", "linked", "slot", "const", "free", "text", "kinds")

    def __init__(self, label: str, text: str | None = None, linked: int = 0):
        self.label, self.text = label, text
        self.children: list[Block] = []
        self.items: list[Item] = []
        self.members: list[Block] | None = None
        self.kinds: frozenset[str] | None = None  # labels of the children, once asked for
        self.pages, self.linked, self.free = 1, linked, False
        self.chars = len(text or "")
        self.slot = 0  # chars of texts that differ between pages
        self.const = None if text is None else xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


class Item:
    """A group of blocks with its quantifier: lo 0 or 1, hi 1 or MANY."""

    __slots__ = ("lo", "hi", "blocks")

    def __init__(self, lo: int, hi: int, blocks: list[Block]):
        self.lo, self.hi, self.blocks = lo, hi, blocks

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(b.label for b in self.blocks)


# --- tokens of a page ---


def label_of(tag: str, attrs: str) -> str:
    """The tag with its id, classes and role, without digits; '!' in front where it is never main text."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)} if "=" in attrs else {}
    names = " ".join(found.get(k, "") for k in ("id", "class", "role", "itemprop"))
    names = re.sub(r"[\d\s]+", " ", names).strip()
    drop = tag in DROPPED
    if names and not drop and tag not in ("html", "body", "main"):
        words = [w.lower() for w in WORD.findall(names)]
        drop = any(w in NOT_MAIN and not (i and words[i - 1] in NEGATED) for i, w in enumerate(words))
    drop = drop or HIDDEN.search(QUOTED.sub("", attrs)) is not None or UNSEEN.search(attrs) is not None
    return ("!" if drop else "") + tag + ("." + ".".join(sorted(set(names.split()))) if names else "")


def tag_of(label: str) -> str:
    return label.lstrip("!").partition(".")[0]


LABELS = Remember(lambda key: label_of(*key), 50_000)


def parse(page: str | None) -> Block:
    """The block tree of a page. Inline tags vanish, ``br`` is white space, unclosed and stray tags are mended."""
    root = Block("#root")
    stack, run, links, linked, deeper = [root], [], 0, 0, Counter()
    page, at, size = page or "", 0, len(page or "")

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            if text:
                stack[-1].children.append(Block("#", text, min(linked, len(text))))
            run, linked = [], 0

    while at < size:
        m = TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            run.append(page[at:stop])
            linked += (stop - at) if links else 0
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m["close"] or m["close2"])
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                links = max(links - 1, 0) if closing else links + 1
            continue
        flush()
        if closing and deeper[tag]:
            deeper[tag] -= 1
            continue
        if closing:
            k = next((i for i in range(len(stack) - 1, 0, -1) if tag_of(stack[i].label) == tag), 0)
            if k:
                del stack[k:]
                links = 0
            continue
        attrs = m["attrs"] or ""
        ends = ENDS_SAME.get(tag, ()) or (("p",) if tag in CLOSES_P else ())
        for i in range(len(stack) - 1, 0, -1):
            t = tag_of(stack[i].label)
            if t in ends:
                del stack[i:]
                if tag != "tr":
                    break
            elif t in SCOPE:
                break
        block = Block(LABELS[tag, attrs] if len(attrs) < 500 else label_of(tag, attrs))
        stack[-1].children.append(block)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                at = page.find(">", at) + 1 or size
        elif tag not in VOID and not attrs.endswith("/") or tag in SCOPE:
            if len(stack) <= DEEPEST:
                stack.append(block)
            else:
                deeper[tag] += 1
    flush()
    fold_tree(root)
    return root


# --- repeated groups ---


def kinds(b: Block) -> frozenset[str]:
    if b.kinds is None:
        b.kinds = frozenset(c.label for c in inner_blocks(b))
    return b.kinds


def inner_blocks(b: Block) -> list[Block]:
    """The blocks below a page's block, or a wrapper's."""
    return b.children or [x for i in b.items for x in i.blocks]


def alike(a: Block, b: Block) -> float:
    """0 for different labels, else 1 plus the share of the kinds of children that both have."""
    if a.label != b.label:
        return 0.0
    x, y = kinds(a), kinds(b)
    return 2.0 if x == y else 1.0 + len(x & y) / len(x | y)


def fold(blocks: list[Block], longest_group: int = 8) -> list[Item]:
    """Runs of like blocks, or of like groups of up to ``longest_group`` blocks, as repeated groups."""
    out: list[Item] = []
    i, n = 0, len(blocks)
    while i < n:
        for p in range(1, min(longest_group, (n - i) // 2) + 1):
            end = i + p
            while end + p <= n and all(alike(blocks[i + k], blocks[end + k]) >= 1.5 for k in range(p)):
                end += p
            if end > i + p:
                group = []
                for k in range(p):
                    whole = blocks[i + k]
                    members = list(blocks[i + k : end : p])
                    for other in members[1:]:
                        whole = merged(whole, other)
                    if len(members) > 1:
                        whole.members, whole.pages = members, 1
                    group.append(whole)
                out.append(Item(1, MANY, group))
                i = end
                break
        else:
            out.append(Item(1, 1, [blocks[i]]))
            i += 1
    return out


def fold_tree(root: Block) -> None:
    """Fold children from the leaves up, without recursion."""
    order, todo = [], [root]
    while todo:
        b = todo.pop()
        order.append(b)
        todo += b.children
    for b in reversed(order):
        if b.children:
            b.chars = sum(c.chars for c in b.children)
            b.linked = sum(c.linked for c in b.children)
            b.items = fold(b.children)


# --- alignment ---


def absorb(items: list[Item], groups: set[tuple[str, ...]]) -> list[Item]:
    """Blocks that stand once where the other side repeats their group are one turn of that group."""
    for labels in groups:
        p, i, out = len(labels), 0, []
        while i < len(items):
            part = items[i : i + p]
            if len(part) == p and all(x.hi == 1 and len(x.blocks) == 1 and x.blocks[0].label == l for x, l in zip(part, labels, strict=True)):
                out.append(Item(min(x.lo for x in part), 1, [x.blocks[0] for x in part]))
                i += p
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def pairs(a: list[Item], b: list[Item]) -> list[tuple[Item | None, Item | None]]:
    """The alignment of two item lists that keeps most alike; unmatched items stand alone, in order."""
    groups = {i.labels for i in a + b if i.hi == MANY and len(i.blocks) > 1}
    if groups:
        a, b = absorb(a, groups), absorb(b, groups)
    n, m = len(a), len(b)
    if n == m and all(x.labels == y.labels and (len(x.blocks) > 1 or alike(x.blocks[0], y.blocks[0]) >= 1.5 or x.blocks[0].label != "div") for x, y in zip(a, b, strict=True)):
        return list(zip(a, b, strict=True))
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    score = [[sum(map(alike, x.blocks, y.blocks)) / len(x.blocks) if x.labels == y.labels else 0.0 for y in b] for x in a]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], score[i][j] + best[i + 1][j + 1] if score[i][j] else 0.0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and score[i][j] and best[i][j] == score[i][j] + best[i + 1][j + 1]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i][j] == best[i + 1][j]):
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


def collapse(items: list[Item]) -> list[Item]:
    """Neighbours that repeat the same group become one repeated group."""
    out: list[Item] = []
    for item in items:
        if out and out[-1].labels == item.labels and all(alike(x, y) >= 1.5 for x, y in zip(out[-1].blocks, item.blocks, strict=True)):
            last = out[-1]
            last.blocks = [merged(x, y) for x, y in zip(last.blocks, item.blocks, strict=True)]
            last.lo, last.hi = max(last.lo, item.lo), MANY
        else:
            out.append(item)
    return out


def copied(b: Block) -> Block:
    """A wrapper block of its own, without the page's texts and members."""
    new = Block(b.label)
    new.pages, new.chars, new.linked, new.slot, new.const, new.free = b.pages, b.chars, b.linked, b.slot, b.const, b.free
    new.items = [Item(i.lo, i.hi, [copied(x) for x in i.blocks]) for i in b.items]
    return new


def merged(a: Block, b: Block, most_items: int = 64) -> Block:
    """The wrapper of what ``a`` and ``b`` stand for. A list of more than ``most_items`` groups becomes free content."""
    out = Block(a.label)
    out.pages, out.chars, out.linked = a.pages + b.pages, a.chars + b.chars, a.linked + b.linked
    if a.label == "#":
        same = a.const is not None and a.const == b.const
        out.const = a.const if same else None
        out.slot = 0 if same else out.chars
        return out
    out.free = a.free or b.free or max(len(a.items), len(b.items)) > 8 * most_items
    if not out.free:
        items = []
        for x, y in pairs(a.items, b.items):
            if x and y:
                items.append(Item(min(x.lo, y.lo), max(x.hi, y.hi), [merged(p, q, most_items) for p, q in zip(x.blocks, y.blocks, strict=True)]))
            else:
                one = x or y
                items.append(Item(0, one.hi, [copied(p) for p in one.blocks]))
        out.items = collapse(items)
        out.free = len(out.items) > most_items
    if out.free:
        out.items, out.slot = [], out.chars
    else:
        out.slot = sum(x.slot for i in out.items for x in i.blocks)
    return out


# --- wrappers as rows ---


def dump(b: Block) -> list:
    return [b.label, b.pages, b.chars, b.linked, b.slot, b.const, int(b.free), [[i.lo, i.hi, [dump(x) for x in i.blocks]] for i in b.items]]


def load(row: list) -> Block:
    b = Block(row[0])
    _, b.pages, b.chars, b.linked, b.slot, b.const, free, items = row
    b.free = bool(free)
    b.items = [Item(lo, hi, [load(x) for x in blocks]) for lo, hi, blocks in items]
    return b


def pattern(b: Block) -> str:
    """The wrapper as a regular expression over tags; ``#`` is a text slot, other texts are ``=``."""
    if b.label == "#":
        return "#" if b.const is None else "="
    inner = ".*" if b.free else "".join(
        ("({})".format("".join(map(pattern, i.blocks))) if (i.lo, i.hi) != (1, 1) else "".join(map(pattern, i.blocks))) + {(1, 1): "", (0, 1): "?", (1, MANY): "+", (0, MANY): "*"}[i.lo, i.hi] for i in b.items
    )
    return inner if b.label == "#root" else f"<{b.label}>{inner}</>"


def infer_wrappers(pages: DataFrame, fan_in: int = 64, most_hosts: int = 2000) -> DataFrame:
    """host, pages (long) and wrapper (JSON) of every host of the table's urls; pages without a host share host ''.

    Null and empty html count as empty pages. Repeated rows count again. An empty table gives no rows. A task holds
    the wrappers of at most ``most_hosts`` hosts and writes them out when more come, and ``fan_in`` partial wrappers
    of a host, more or less, meet in one group.
    """
    source = with_parts(pages.select(F.col("url").alias("_url"), F.col("html").cast("string").alias("_html")), "_url").select("host", "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, known = TaskContext.get().partitionId(), 0, {}

        def out() -> pa.RecordBatch:
            n = len(known)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(known)), pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array([w.pages for w in known.values()], pa.int64()), pa.array([json.dumps(dump(w)) for w in known.values()], pa.string())],
                ["host", "part", "seq", "pages", "wrapper"],
            )

        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = parse(text.as_py())
                if host in known:
                    known[host] = merged(known[host], page)
                else:
                    if len(known) >= most_hosts:
                        yield out()
                        known, seq = {}, seq + 1
                    known[host] = copied(page)
        if known:
            yield out()

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "seq"])
        whole = None
        for row in frame["wrapper"]:
            own = load(json.loads(row))
            whole = own if whole is None else merged(whole, own)
        first = frame.iloc[0]
        return pd.DataFrame({"host": [first["host"]], "part": [first["part"]], "seq": [first["seq"]], "pages": [whole.pages], "wrapper": [json.dumps(dump(whole))]})

    schema = "host string, part long, seq long, pages long, wrapper string"
    partial = staged(source.mapInArrow(run, schema))
    while True:
        n = staged(partial.groupBy("host").agg(F.count("*").alias("n")).filter("n > 1"))
        if n.isEmpty():
            return partial.select("host", "pages", "wrapper")
        several = partial.join(n, "host").withColumn("bucket", F.pmod(F.xxhash64("part", "seq"), F.ceil(F.col("n") / fan_in)))
        met = several.groupBy("host", "bucket").applyInPandas(meet, schema)
        partial = staged(partial.join(n, "host", "left_anti").select("host", "part", "seq", "pages", "wrapper").unionByName(met))


# --- where the article is ---


def is_root(label: str) -> bool:
    tag, _, names = label.partition(".")
    return tag in ("article", "main") or "articleBody" in names.split(".") or "main" in names.split(".")


def dropped(label: str) -> bool:
    return label[0] == "!"


def article_roots(b: Block) -> list[Block]:
    """The topmost article blocks, or the main blocks that hold none with half of their text."""
    out = []
    for c in inner_blocks(b):
        if dropped(c.label) or c.label == "#":
            continue
        if is_root(c.label):
            below = [] if tag_of(c.label) == "article" else article_roots(c)
            out += below if 2 * sum(x.chars for x in below) >= c.chars > 0 else [c]
        else:
            out += article_roots(c)
    return [x for x in out if x.chars]


def mass(b: Block, several: bool) -> int:
    """Chars of unlinked text below ``b`` that counts as content: slots only, where there are several pages."""
    if dropped(b.label) or tag_of(b.label) in ("header", "footer"):
        return 0
    if b.label == "#" or b.free:
        return max((b.slot if several else b.chars) - b.linked, 0)
    return sum(mass(c, several) for c in inner_blocks(b))


def densest(b: Block, several: bool, share: float = 0.7) -> Block:
    """The lowest block that holds ``share`` of the content."""
    whole = mass(b, several)
    while True:
        below = [c for c in inner_blocks(b) if c.label != "#" and whole and mass(c, several) >= share * whole and not is_text_block(c)]
        if len(below) != 1 or below[0].members:
            return b
        b = below[0]


def is_text_block(b: Block) -> bool:
    return tag_of(b.label) in HEADINGS or tag_of(b.label) in ("p", "li", "pre", "td", "blockquote", "dd", "dt")


class Place:
    """Where a host's wrapper, or a single page, has its article."""

    def __init__(self, root: Block):
        roots = article_roots(root)
        self.explicit = bool(roots)
        self.several = root.pages >= 3 and mass(root, True) > 0
        self.roots = {id(x) for x in roots} if roots else {id(densest(root, self.several))}
        self.root = root


def texts(page: Block, explicit: bool) -> list[str]:
    """The texts of a block in page order, without what is no main text. Of a header only headings count."""
    out: list[str] = []
    todo = [(page, False)]
    while todo:
        b, in_header = todo.pop()
        if b.label == "#":
            if not in_header:
                out.append(b.text)
            continue
        for c in reversed(b.children):
            if dropped(c.label):
                continue
            tag = tag_of(c.label)
            header = (in_header or tag == "header") and tag not in HEADINGS
            if not explicit and c.children and not is_text_block(c) and c.chars and 2 * c.linked > c.chars:
                continue  # a list of links
            todo.append((c, header))
    return out


def main_text(page: Block, place: Place | None) -> str:
    """The blocks of a page that lie where its host has its articles, joined by line feeds."""
    found: list[str] = []
    if place and not place.explicit and article_roots(page):
        place = None
    if place:
        todo = [(page, place.root)]
        while todo:
            b, w = todo.pop()
            if id(w) in place.roots:
                kept = texts(b, place.explicit)
                if not place.explicit and place.several:
                    shared = template_texts(w)
                    kept = [t for t in kept if not shared or xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 not in shared]
                found.append(kept)
                continue
            if w.free:
                continue
            below = []
            for x, y in pairs(b.items, w.items):
                if x and y:
                    for p, q in zip(x.blocks, y.blocks, strict=True):
                        if p.label != "#" and not dropped(p.label):
                            below += [(c, q) for c in p.members or [p]]
            order = {id(c): i for i, c in enumerate(b.children)}
            todo += sorted(below, key=lambda t: -order.get(id(t[0]), 0))
        lines = [t for part in found for t in part]
        if lines:
            return "\n".join(lines)
    own = Place(page)
    roots = article_roots(page) if own.explicit else [densest(page, False)]
    return "\n".join(t for r in roots for t in texts(r, own.explicit))


def template_texts(w: Block) -> frozenset[int]:
    """Texts directly below a wrapper block that all of several pages share."""
    out, todo = set(), [(w, False)]
    while todo:
        b, repeated = todo.pop()
        if b.label == "#" and b.const is not None and b.pages >= 3 and not repeated:
            out.add(b.const)
        todo += [(x, repeated or i.hi == MANY) for i in b.items for x in i.blocks]
    return frozenset(out)


def extract(pages: DataFrame, wrappers: DataFrame | None = None, keep: tuple[str, ...] = ("page_id", "url"), hot_parts: int = 200) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points, long) of every row, in any order.

    A block's white space is one space, blocks are joined by one line feed; ``br`` is white space. Null and empty
    html and pages without text give ''. A page of a host without a wrapper, or whose blocks are none of the wrapper's,
    is judged by itself. Repeated rows each get their row, columns that are not kept are ignored, an empty table gives
    none. Hosts with more than one in ``hot_parts`` of the pages (at most that many) are dealt over ``hot_parts`` keys.
    """
    wrappers = staged(infer_wrappers(pages) if wrappers is None else wrappers)
    total = wrappers.agg(F.sum("pages")).first()[0] or 0
    hot = wrappers.filter(F.col("pages") * hot_parts > total).select(F.col("host").alias("_hot"))  # fewer than hot_parts rows
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = with_parts(pages.select(*kept, F.col("url").alias("_url"), F.col("html").cast("string").alias("_html")), "_url")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_url", "_html"), F.lit(hot_parts))).otherwise(0)
    rows = rows.join(F.broadcast(hot), F.col("host") == F.col("_hot"), "left").withColumn("_salt", salt.cast("int"))
    many = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(hot_parts - 1))).otherwise(F.array(F.lit(0)))
    dealt = wrappers.join(F.broadcast(hot), F.col("host") == F.col("_hot"), "left").select("host", "wrapper", F.explode(many).alias("_salt"))
    dealt = staged(dealt)  # its size tells Spark whether to broadcast it
    met = rows.join(dealt, ["host", "_salt"], "left").select(*[f"_k{i}" for i in range(len(keep))], "_html", "wrapper")
    types = dict(pages.select(*keep).dtypes)
    schema = ", ".join(f"_k{i} {types[c]}" for i, c in enumerate(keep)) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Remember(lambda w: Place(load(json.loads(w))), 500)
        for batch in batches:
            n = len(keep)
            out = []
            for page, wrapper in zip(batch.column(n), batch.column(n + 1).to_pylist(), strict=True):
                page = page.as_py()
                out.append(main_text(parse(page), None if wrapper is None else places[wrapper]) if page else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], [f"_k{i}" for i in range(n)] + ["text", "n_chars"])

    found = met.mapInArrow(run, schema)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
