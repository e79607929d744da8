"""Ranked search, structure repair and main text against brute force, on tables with nulls, long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from bizdocs.llm import html_wrapper, lexical_search, structure_repair

rng = random.Random(11)

# --- 11 ranked lexical search ---

TERMS = [f"t{i}" for i in range(40)] + ["Été", "ñ", "t'x"]


def text_of(n):
    return " ".join(TERMS[min(int(rng.expovariate(0.12)), len(TERMS) - 1)] for _ in range(n))


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute_search(docs, items, k):
    counted = [(i, terms_of(t)) for i, t in docs]
    counted = [(i, t) for i, t in counted if t]
    n_docs, n_terms = len(counted), sum(len(t) for _, t in counted)
    df = {}
    for _, t in counted:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, t in counted:
            m = 10 + 90 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms if x in df)
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms,chunk", [(200_000, 4096), (50, 37)])
def test_search_is_exact(spark, block_terms, chunk):
    docs = [(i, text_of(rng.randrange(1, 60))) for i in range(300)]
    docs += [(i, docs[5][1]) for i in range(300, 380)]  # ties
    docs += [(7, docs[7][1]), (400, None), (401, ""), (402, " ,; "), (403, text_of(20_000)), (None, text_of(30))]
    items = [(f"i{i}", text_of(12)) for i in range(9)] + [("i9", docs[5][1]), ("i9", "t39 only"), ("none", "absent words"), ("empty", ""), ("null", None), (None, "t1 t2 T30")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, n long")
    found = lexical_search.search(d, q, 10, block_terms, chunk)
    assert dict(found.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, found.collect()), key=str) == brute_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "word")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_bounds_hold_for_every_node():
    import numpy as np

    docs = [sorted(rng.sample(range(30), rng.randrange(1, 12))) for _ in range(200)]
    starts = np.cumsum([0, *map(len, docs)])
    terms = np.array([t for d in docs for t in d])
    tf = np.array([rng.randrange(1, 9) for _ in terms])
    trie = lexical_search.Trie(np.arange(200), np.array([rng.randrange(10, 300) for _ in docs]), starts, terms, tf, leaf=4)
    item, weights = np.arange(0, 30, 3), np.array([rng.randrange(0, 900) for _ in range(10)])
    bounds = trie.bounds(item, weights, np.array([0]))[:, 0]
    for node, bound in zip(trie.nodes, bounds, strict=True):
        for j in range(node.lo, node.hi):
            own = slice(trie.starts[j], trie.starts[j + 1])
            score = sum(int(weights[t // 3]) * (10**9 * int(f) // (1000 * int(f) + 8 * int(trie.m[j]))) for t, f in zip(trie.terms[own], trie.tf[own], strict=True) if t % 3 == 0)
            assert score <= bound


# --- 12 conversation structure repair ---


def brute_repair(turns):
    """Cheapest (cost, audit, repaired) over all edits, by dynamic programming over what was read and the roles so far."""
    best = {("", 0): (0, "", ())}  # (state, number of turns read)
    order = ["", "s", "u", "a"]

    def nexts(state):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    for i in range(len(turns) + 1):
        for _ in range(4):  # inserts
            for s in order:
                if (s, i) in best:
                    c, a, r = best[s, i]
                    for x in nexts(s):
                        if x != "s":
                            new = (c + 3, a + "I", (*r, ("user" if x == "u" else "assistant", "")))
                            if (x, i) not in best or new[:2] < best[x, i][:2]:
                                best[x, i] = new
        if i == len(turns):
            break
        role, text, fault = turns[i]
        for s in order:
            if (s, i) not in best:
                continue
            c, a, r = best[s, i]
            options = [(s, c + 4, a + "D", r)]
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                if role[:1] and role[:1] in nexts(s):
                    options.append((role[:1], c + extra, a + "K", (*r, (role, text))))
                options += [(x, c + extra + 3, a + "R", (*r, ("user" if x == "u" else "assistant", text))) for x in nexts(s) if x != "s"]
            for state, *new in options:
                if (state, i + 1) not in best or tuple(new[:2]) < best[state, i + 1][:2]:
                    best[state, i + 1] = tuple(new)
    return min((best[s, len(turns)] for s in ("", "a") if (s, len(turns)) in best), key=lambda x: x[:2])


def brute_summary(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role, text, fault))
    known = [t for t, _, _ in rows if t is not None]
    count = lambda f: sum(t[2] == f for t in turns)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit, repaired = brute_repair(turns)
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest), repaired


@pytest.fixture(scope="module")
def dialogues():
    out = {}
    roles = ["user", "assistant", "system", "tool", "", None, "admin"]
    texts = ["Hello.", "Yes!", "cut off", " \n ", "", None, "Why?  ", "A. b"]
    for conv in range(60):
        n = rng.randrange(1, 14)
        out[conv] = [(rng.choice([None, *range(n)]) if conv % 5 == 0 else i, rng.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], f"{rng.choices(texts, [9, 9, 3, 2, 1, 1, 5, 4])[0] or ''}{i if conv % 2 else ''}." if conv % 3 else rng.choice(texts)) for i in range(n)]
    out[100] = [(i, rng.choice(roles[:3]), rng.choice(["", "cut", f"Answer {i}.", "Same."])) for i in range(900)]  # a long one
    out[101] = [(3, "user", "Same.")] * 5
    out[102] = [(None, None, None)]
    out[103] = [(0, "user", "x" * 50_000 + "."), (1, "assistant", "Ok.")]
    return out


def frame(spark, dialogues, kind="long"):
    rows = [(c if kind == "long" else f"c{c}", t, r, x, 5, "a") for c, turns in dialogues.items() for t, r, x in turns]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string, cost long, audit string").repartition(4)


@pytest.mark.parametrize("rows,kind", [(256, "long"), (3, "long"), (1, "string")])
def test_repair_is_the_cheapest(spark, dialogues, rows, kind):
    df = frame(spark, dialogues, kind)
    name = (lambda c: c) if kind == "long" else (lambda c: f"c{c}")
    got = {r["conv_id"]: tuple(r)[1:] for r in structure_repair.repair_summary(df, rows).collect()}
    want = {name(c): brute_summary(turns) for c, turns in dialogues.items()}
    assert got == {c: w[0] for c, w in want.items()}
    turns = {}
    for r in structure_repair.repair_turns(df, rows).orderBy("conv_id", "position").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: list(w[1]) for c, w in want.items() if w[1]}


def test_repair_of_null_and_no_conversations(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (1, 0, "assistant", "Alone.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in structure_repair.repair_summary(df).collect()}
    assert got == {None: (0, "KK"), 1: (3, "IK")}
    assert structure_repair.repair_summary(df.limit(0)).count() == 0


# --- 13 main text ---


def wrapped(*pages):
    whole = html_wrapper.copied(html_wrapper.parse(pages[0]))
    for p in pages[1:]:
        whole = html_wrapper.merged(whole, html_wrapper.parse(p))
    return whole


def test_mismatches_become_slots_optional_and_repeated_groups():
    assert html_wrapper.pattern(wrapped("<div><h1>A</h1><p>same</div>", "<div><h1>B</h1><p>same</div>")) == "<div><h1>#</><p>=</></>"
    assert html_wrapper.pattern(wrapped("<div><h1>A</h1><p>x</div>", "<div><p>x</div>")) == "<div>(<h1>=</>)?<p>=</></>"
    assert html_wrapper.pattern(wrapped("<ul><li>a<li>b<li>c</ul>", "<ul><li>a</ul>")) == "<ul>(<li>#</>)+</>"
    assert html_wrapper.pattern(wrapped("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>e<dd>f</dl>")) == "<dl>(<dt>#</><dd>#</>)+</>"
    assert html_wrapper.pattern(wrapped("<ul><li>a<li>b</ul>", "<p>x")) == "(<ul>(<li>#</>)+</>)?(<p>=</>)?"


def test_every_page_matches_the_wrapper_of_its_host():
    def regex(b):
        if b.label == "#":
            return "#"
        inner = ".*" if b.free else "".join("(?:" + "".join(map(regex, i.blocks)) + ")" + {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[i.lo, i.hi] for i in b.items)
        return inner if b.label == "#root" else f"<{re.escape(b.label)}>{inner}</>"

    def stream(b):
        return "#" if b.label == "#" else "".join(map(stream, b.children)) if b.label == "#root" else f"<{b.label}>" + "".join(map(stream, b.children)) + "</>"

    for _ in range(60):
        tags = ["p", "ul", "h2", "div", "table"]
        pages = ["<body>" + "".join(f"<{t}>{'<li>x' * rng.randrange(1, 4) if t == 'ul' else rng.choice(['w', 'v <p>deep'])}</{t}>" for t in rng.choices(tags, k=rng.randrange(1, 7))) + "</body>" for _ in range(rng.randrange(1, 6))]
        whole = html_wrapper.load(json.loads(json.dumps(html_wrapper.dump(wrapped(*pages)))))
        for p in pages:
            assert re.fullmatch(regex(whole), stream(html_wrapper.parse(p))), (p, html_wrapper.pattern(whole))


ARTICLE = """<html><head><title>no</title><style>p{{}}</style></head><body class="home comments-open"><header><h1>Site</h1></header><nav><a href=/>menu</a></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h2>Head {0}</h2><span>By me</span></header><p>First&nbsp;&amp; <b>bold</b>er
 line<br>broken<p>Second &eacute;t&#233;<div class="share">Share this</div><form><p>Name <input></form><ul><li>One<li>Two</ul><script>var x = "<p>no</p>";</script>
<blockquote>Quote</blockquote><!-- <p>gone</p> --><p hidden>unseen</p><footer>Tags</footer></article><section id="comments"><article class="comment"><p>Nice!</article></section></main>
<aside>side</aside><footer>&copy; us</footer></body></html>"""


def test_article_without_what_surrounds_it(spark):
    lines = "First & bolder line broken\nSecond été\nOne\nTwo\nQuote"
    plain = "<body><div><div><a href=/>Home</a></div><div>{}</div></div><div>Made by us</div>"
    body = lambda i: plain.format(f"<h2>Title {i}</h2>" + "".join(f"<p>Paragraph {i} {k} with some words to read</p>" for k in range(1 + i % 3)) + "<div>Subscribe to our letter</div>")
    rows = [(1, "http://a.org/1", ARTICLE.format(1)), (2, "http://a.org/2", ARTICLE.format(2)), (2, "http://a.org/2", ARTICLE.format(2)), (3, None, None), (4, "nonsense", ""), (5, "http://a.org/5", "<p>other page"), (None, "http://A.org/6", "<article>x &lt;b&gt; &am &copy"), (7, "http://a.org/7", "no tags at all")]
    rows += [(10 + i, f"http://b.org/{i}", body(i)) for i in range(6)]
    rows += [(20, "http://c.org/", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after"), (21, "http://c.org/l", "<article>" + "<p>w w" * 20_000 + "</article>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long").repartition(3)
    got = sorted((tuple(r) for r in html_wrapper.extract(df).collect()), key=str)
    want = [(i, f"http://a.org/{i}", f"Head {i}\n{lines}") for i in (1, 2, 2)]
    want += [(3, None, ""), (4, "nonsense", ""), (5, "http://a.org/5", "other page"), (None, "http://A.org/6", "x <b> &am ©"), (7, "http://a.org/7", "no tags at all")]
    want += [(10 + i, f"http://b.org/{i}", "\n".join([f"Title {i}", *(f"Paragraph {i} {k} with some words to read" for k in range(1 + i % 3))])) for i in range(6)]
    want += [(20, "http://c.org/", "deep\nafter"), (21, "http://c.org/l", "\n".join(["w w"] * 20_000))]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)
    assert html_wrapper.extract(df.limit(0)).count() == 0


def test_partial_wrappers_meet_in_rounds(spark):
    pages = [(i, f"http://h.org/{i}", f"<body><div>Menu</div><div><h1>T{i}</h1>{'<p>text of the page</p>' * (1 + i % 4)}</div></body>") for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(30)
    found = html_wrapper.infer_wrappers(df, fan_in=3).collect()
    assert [(r["host"], r["pages"]) for r in found] == [("h.org", 120)]
    assert html_wrapper.pattern(html_wrapper.load(json.loads(found[0]["wrapper"]))) == "<body><div>=</><div><h1>#</>(<p>=</>)+</></>"
    texts = {r["page_id"]: r["text"] for r in html_wrapper.extract(df).collect()}
    assert texts == {i: "\n".join([f"T{i}", *["text of the page"] * (1 + i % 4)]) for i in range(120)}


def test_given_pages_keep_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_wrapper.extract(pages).join(pages.select("page_id", "html"), "page_id").filter(F.col("html").isNotNull()).collect():
        inside = re.search("<article>(.*?)(?:</article>|$)", r["html"], re.S)
        if inside:
            assert re.sub("<[^>]*>|\\s+|&amp;?|&quot;", "", inside[1]) == re.sub("\\s+|&|\"", "", r["text"])
