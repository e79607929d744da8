"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bizdocs.llm import chat_format, decontaminate, graph, language_id, license_scan, ngram_join, packing, quality_rules, token_count, toxicity, url_filter

rng = random.Random(7)
WORDS = [f"w{i}" for i in range(60)] + ["Été", "naïve", "straße", "über,"]


def sentence(n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


EDGE = [None, "", " \n\t ", "one", "a b c d", "x " * 40, "É é word", "line\nline\nline\n\nother line", "## $$ %% || <>", "word" * 3000, sentence(9000)]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases, copies, near copies, repeated rows, a null id, and columns named like outputs."""
    texts = list(EDGE)
    base = [sentence(n) for n in (30, 60, 120, 200)]
    for t in base:
        ws = t.split()
        for k in (0, 1, 2, 3):
            own = list(ws)
            for _ in range(k):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
        texts.append(t.upper())
        texts.append(t)
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, base[0], "en", "s", 0, "clash"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept string").repartition(3)


def collected(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def white(t):
    return [w.decode() for w in (t or "").encode().split()]


# --- 1 quality rules ---

def brute_stats(t):
    words, lines = white(t), [x for x in (t or "").split("\n") if x.encode().split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_text_stats(docs):
    got = collected(quality_rules.text_stats(docs, ["doc_id"]), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((r.doc_id, *brute_stats(r.text)) for r in docs.collect()), key=str)


def test_text_stats_when_window_hashes_clash(docs, monkeypatch):
    """With only two hash bits nearly all windows collide, so the exact path decides."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.crc32(c[0].cast("binary")) % 2 * (1 << 40))
    got = collected(quality_rules.text_stats(docs.filter("length(text) < 5000 OR text IS NULL"), ["doc_id"]), "doc_id", "n_repeat_words")
    assert got == sorted(((r.doc_id, brute_stats(r.text)[4]) for r in docs.collect() if len(r.text or "") < 5000), key=str)


def test_learned_rules(spark):
    clean = [(i, sentence(80), 1) for i in range(120)]
    junk = [(1000 + i, " ".join(w + "###" for w in sentence(80).split()), 0) for i in range(60)]
    rows = spark.createDataFrame(clean + junk, "doc_id long, text string, quality int")
    rules = quality_rules.learn(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    assert rules.rules and rules.default
    kept = {r.doc_id for r in quality_rules.filter_quality(rows.withColumn("n_words", F.lit("clash")), rows.select("doc_id", "quality")).collect()}
    assert kept == {i for i, _, _ in clean}


def test_learning_scans_in_all_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(70)], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, quality int")
    tasks, write = [], quality_rules.staged
    monkeypatch.setattr(quality_rules, "staged", lambda df: tasks.append(df.rdd.getNumPartitions()) or write(df))
    quality_rules.learn(docs, labels)
    assert tasks[0] == 7


def test_no_labels_keep_everything(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn(docs, labels).rules == []
    out = quality_rules.filter_quality(docs, labels)
    assert out.columns == docs.columns
    ok = lambda s: s[0] >= 50 and 100 * s[4] <= 50 * s[0]
    assert collected(out, "doc_id", "text") == sorted(((r.doc_id, r.text) for r in docs.collect() if ok(brute_stats(r.text))), key=str)
    assert quality_rules.filter_quality(docs.limit(0), labels).count() == 0


# --- 2 licence scan ---

def test_license_scan(spark):
    mit = license_scan.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit), (2, mit.upper().replace(",", ";")), (3, "Text.\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0."), (4, None), (5, ""), (6, mit + " more"), (1, "x")]
    out = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)), license_scan.known_texts(spark))
    got = {(r.doc_id, r.license_id, tuple(r.notices)) for r in out.collect()}
    # a line of its own that is the licence counts as a notice, and rows of one doc_id share notices
    assert got == {(1, "MIT", ("MIT",)), (1, None, ("MIT",)), (2, "MIT", ("MIT",)), (3, None, ("CC-BY-NC-4.0", "MIT")), (4, None, ()), (5, None, ()), (6, None, ())}
    assert {r.license_id for r in out.collect() if r.doc_id in (1, 2)} == {"MIT", None}
    empty = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.known_texts(spark).limit(0))
    assert empty.filter("license_id IS NOT NULL").count() == 0


def test_whole_licenses(spark):
    texts = {f.stem: f.read_text("utf-8") for f in license_scan.FILES.glob("*.txt")}
    assert set(texts) == {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    start, source, binary, names, end = license_scan.BSD
    end = end.format("COPYRIGHT HOLDERS", "COPYRIGHT OWNER")
    bsd = ["Copyright (c) 2020, Someone", "All rights reserved.", "", start, "", "1. " + source, "", "2. " + binary, "", "3. " + names.format("copyright holder"), "", end]
    texts |= {"BSD-3-Clause": "\n".join(bsd), "BSD-2-Clause": "\n".join(["BSD 2-Clause License", "", *bsd[:9], end]), "MIT": "MIT License\n\nCopyright (c) 2020 Someone\n\n" + license_scan.TEXTS["MIT"]}
    rows = list(texts.items()) + [("Apache-2.0", texts["Apache-2.0"].split(license_scan.END)[0] + license_scan.END)]
    rows += [(i, "\r\n".join(t.upper().split("\n"))) for i, t in rows if i != "MIT"]
    more = [(f"not {i}", t + " one more word") for i, t in rows]
    out = license_scan.scan_licenses(spark.createDataFrame(rows + more, "doc_id string, text string"), license_scan.known_texts(spark)).collect()
    assert len(out) == len(rows + more)
    assert all(r.license_id == (None if r.doc_id.startswith("not ") else r.doc_id) for r in out)


# --- 3 packing ---

def brute_best_fit(lengths, size):
    """Document-by-document best-fit decreasing, a linear scan per document."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(open_) if r >= n]
        if fits:
            open_[min(fits, key=lambda i: open_[i])] -= n
        else:
            open_.append(size - n)
    return len(open_)


@pytest.mark.parametrize("size", [1, 7, 50, 1024])
def test_plan_equals_document_by_document(size):
    for _ in range(30):
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        histogram = Counter(lengths)
        runs = packing.plan(dict(histogram), size)
        used: dict[int, list] = {}
        for length, n in histogram.items():
            for rank in range(n):
                _, first, per, seq, offset = max((r for r in runs if r[0] == length and r[1] <= rank), key=lambda r: r[1])
                used.setdefault(seq + (rank - first) // per, []).append((offset + length * ((rank - first) % per), length))
        for spans in used.values():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at <= size
        assert len(used) == brute_best_fit(lengths, size)


def test_pack_round_trip(docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)] if len(ids) > head else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r.doc_id, k, a, tuple(ids[a:b]), zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids), r.ids_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 1024
    assert len(by) == brute_best_fit([r.length for r in out], 1024)
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.TokenBytes(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    cases = [*(t for t in EDGE if t), "a  b", "a \n b", "a\n \nb", " lead", "trail ", "it's we'll 'S", "x　y z", "<|endoftext|> a", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>x", "a<|endoftext", "tab\t x", "5 000 a1b2", "日本 語", "é o"]
    for t in cases:
        assert np.frombuffer(fast(t), "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, t


# --- 4 urls ---

RULES = [url_filter.Rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("block", "com/de/"))]


def test_urls_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.example.org/es/x", ""), (2, "https://EXAMPLE.org/en/12?q#f", ""), (3, "http://other.net/p", link("http://x.com/de/1")), (4, "http://other.net/q", link("/p")),
        (5, "http://free.org/x", link("http://x.com/de/1")), (6, None, None), (7, "no scheme", "<b>"), (8, "http://lone.net", None), (9, "http://z.net/a/b", '<meta http-equiv="refresh" content="0; url=c&amp;d">'),
        (10, "http://z.net/a/c&d", link("http://bad.com/de/")), (11, "http://notexample.org/es/", ""), (8, "http://lone.net", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, RULES).collect()}
    assert got == {
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "other.net", "/p", None, "allow"), (4, "other.net", "/q", None, "allow"),
        (5, "free.org", "/x", "org/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "lone.net", "", None, "allow"), (9, "z.net", "/a/b", None, "block"),
        (10, "z.net", "/a/c&d", None, "block"), (11, "notexample.org", "/es/", "org/", "allow"),
    }
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0


def test_relative_links_ports_and_base(spark, tmp_path):
    """Every page below is an alias of a blocked one; the SQL twin gives the same."""
    import duckdb

    from bizdocs.llm import queries

    link = '<link rel="canonical" href="{}">'.format
    blocked = "http://x.com/de/1"
    rows = [
        (1, "http://a.net/z", link(blocked)), (2, "http://a.net/b/y", link("../z")), (3, "http://a.net/w", link("./z")), (4, "http://a.net/v", link("x/../z")),
        (5, "http://a.net:80/u", link("z")), (6, "https://a.net:443/z#top", ""), (7, "http://a.net/q", link("?k=1")), (8, "http://a.net/q?k=1", link("/b/c/../../z")),
        (9, "http://far.net/deep/page", '<base href="http://a.net/b/">' + link("../z")), (10, "http://a.net/k/l", '<base target="x" href="/b/c/">' + link("../../z")), (11, "http://a.net/z/", ""), (12, "http://a.net/a/../z", ""),
        (13, "http://a.net:8080/z", ""), (14, "http://long.net/" + "p/" * 2000, "<p>" * 5000 + link("//a.net/z")), (15, "http://up.net/x", link("../../../y")), (16, "http://up.net/y", link(blocked)), (17, "http://a.net/dir/.", link("/z")), (18, "http://a.net/dir/", None),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in queries.op4(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()}
    assert {r[0] for r in got if r[4] == "allow"} == {11, 13}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP4_SQL})").fetchall())


def test_rules_of_equal_length(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/x")], "page_id long, url string").withColumn("html", F.lit(""))
    rules = [url_filter.Rule("block", "a.com/"), url_filter.Rule("allow", "a.com/"), url_filter.Rule("block", "b.com/")]
    assert {(r.page_id, r.verdict) for r in url_filter.judge_urls(df, rules).collect()} == {(1, "allow"), (2, "block")}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    n = 60
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)], "chain": [(i, i + 1) for i in range(n)], "star": [(7, i) for i in range(n)]}[kind]
    parent = list(range(n + 1))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {(v, root(v)) for e in edges for v in e}
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    assert {tuple(r) for r in graph.components(df).collect()} == want


# --- 5 token counts ---

def test_token_counts_equal_the_unigram_model(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    scores = token_count.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items()], unk_id=0, byte_fallback=False))
    exact.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    lowest = min(scores.values())
    few = {p: float(s) for p, s in (("▁", -2), ("a", -1), ("b", -1), ("ab", -2), ("▁a", -3), ("ba", -2), ("aba", -3))}
    small = Tokenizer(models.Unigram([("<unk>", -3.0), *few.items()], unk_id=0, byte_fallback=False))
    small.pre_tokenizer = exact.pre_tokenizer
    viterbi = token_count.Viterbi(few)
    for _ in range(300):
        w = "".join(rng.choice("abx") for _ in range(rng.randint(1, 9)))
        assert viterbi(token_count.MARK + w)[1] == len(small.encode(w).ids), w
    assert lowest < 0
    words = ["the", "straße", "zzzzqx", "日本語☃☃", "word" * 30]
    big = token_count.Viterbi(scores)
    want = Tokenizer(models.Unigram([("<unk>", lowest), *scores.items()], unk_id=0, byte_fallback=False))
    want.pre_tokenizer = exact.pre_tokenizer
    assert [big(token_count.MARK + w)[1] for w in words] == [len(want.encode(w).ids) for w in words]
    out = {r.doc_id: r for r in token_count.count_tokens(docs.filter("doc_id IS NOT NULL"), scores).collect()}
    for r in docs.filter("doc_id IS NOT NULL").collect():
        assert out[r.doc_id].n_tokens == len(want.encode(r.text or "").ids)
    assert token_count.count_tokens(docs.limit(0), scores).count() == 0


# --- 6 chats ---

def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi <|im_end|>", 1), (1, 2, "bob", "yo", 1), (1, 2, "bob", "yo", 1), (1, 70, "cat", None, 1), (2, 0, "system", "alone", 1), (None, 0, "ann", "x", 1), (3, None, None, "n", 1)]
    out = chat_format.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")).collect()
    assert {(r.conv_id, r.perspective, r.block) for r in out} == {(1, p, b) for p in ("ann", "bob", "cat") for b in (0, 1)} | {(3, "unknown", 0)}
    for r in out:
        own = [r.text[s.start : s.end] for s in r.mask]
        assert own == {("ann", 0): ["hi < |im_end|><|im_end|>"], ("bob", 0): ["yo<|im_end|>"], ("cat", 1): ["<|im_end|>"], ("unknown", 0): ["n<|im_end|>"]}.get((r.perspective, r.block), [])
    ann = next(r for r in out if r.perspective == "ann" and r.block == 0)
    assert ann.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n"


# --- 7 toxicity ---

def test_ordinal_fit_orders_grades():
    rows, grades = [], []
    for _ in range(600):
        g = rng.randrange(4)
        rows.append([f for f in range(3) if g > f and rng.random() < 0.95])
        grades.append(g)
    w, theta = toxicity.fit_ordinal(rows, np.array(grades), 3, 4)
    assert (w > 0).all() and (np.diff(theta) > 0).all()
    model = toxicity.OrdinalModel({}, theta)
    expected = model.above(np.array([0.0, w[0], w[0] + w[1], w.sum()])).sum(axis=1)
    assert (np.diff(expected) > 0).all() and expected[0] < 0.7 and expected[-1] > 2.3


def test_toxicity_held_out(spark, sf):
    d, labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    model = toxicity.fit(d, labels.filter("doc_id % 2 = 0"))
    out = toxicity.grade_documents(d, model).withColumnRenamed("toxic", "found").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.found and not r.toxic for r in out) <= 0.02 * len(out)
    assert sum(r.found and r.toxic for r in out) >= 0.4 * sum(r.toxic for r in out)


def test_toxicity_edges(docs, spark):
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {(r.grade, r.toxic) for r in toxicity.grade_documents(docs, none).collect()} == {(0, False)}


# --- 8 language ---

def test_language_held_out(spark, sf):
    d = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = language_id.fit(d.filter("doc_id % 4 <> 2"))
    out = language_id.predict(d.filter("doc_id % 4 = 2").withColumn("score", F.lit("clash")), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(docs, spark):
    labelled = spark.createDataFrame([(i, "the quick brown fox jumps", "en") for i in range(5)] + [(9 + i, "der schnelle braune Fuchs springt über", "de") for i in range(5)], "doc_id long, text string, lang string")
    model = language_id.fit(labelled)
    out = language_id.predict(docs, model, ["doc_id"]).collect()
    letters = {(r.doc_id, bool(re.search(r"[^\W\d_]", r.text or ""))) for r in docs.collect()}
    assert {(r.doc_id, r.lang_pred != "und") for r in out} == letters
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns
    nothing = language_id.fit(labelled.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.keep_known(docs.limit(0), model).count() == 0


def test_left_out_languages_and_junk_are_rejected(spark, sf):
    d = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").filter("text IS NOT NULL")
    foreign = ["Wszystkie dzieci poszły wczoraj do szkoły.", "Kaikki lapset menivät eilen kouluun.", "Bütün çocuklar dün okula gitti.", "qxzj vkwq zzxj qqkv jxwz"]
    for left_out in ("de", "fr"):
        model = language_id.fit(d.filter(F.col("doc_id") % 4 != 2).filter(F.col("lang") != left_out))
        out = language_id.predict(d.filter("doc_id % 4 = 2"), model, ["lang"]).collect()
        gone = [r.rejected for r in out if r.lang == left_out]
        lost = [r.rejected for r in out if r.lang != left_out]
        assert sum(gone) >= 0.9 * len(gone) and sum(lost) <= 0.02 * len(lost)
        junk = language_id.predict(spark.createDataFrame([(t,) for t in foreign], "text string"), model).collect()
        assert all(r.rejected for r in junk)


def test_odd_rows_start_no_clusters():
    r = np.random.default_rng(1)
    two = np.repeat(np.eye(50, dtype=np.float32)[:2], 100, axis=0) + r.random((200, 50), np.float32) * 0.05
    x = language_id.unit(np.concatenate([two, np.eye(50, dtype=np.float32)[10:12]]))
    c = language_id.cluster(x, 3)
    assert sorted(np.bincount((x @ c.T).argmax(axis=1)))[0] >= 2
    assert len({int(i) for i in (x[[0, 100]] @ c.T).argmax(axis=1)}) == 2


def test_long_text_counts_do_not_depend_on_blocks():
    text = sentence(5000).encode()
    assert (language_id.counts(text, 512, block=777) == language_id.counts(text, 512)).all()


# --- 9 near duplicates ---

def shingle_set(t):
    ws = [w.decode() for w in (t or "").encode().lower().split()]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_classes(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for y in sets[:a]:
            inter = len(x[1] & y[1])
            if inter and 100 * inter >= 80 * (len(x[1]) + len(y[1]) - inter):
                lo, hi = sorted((root(x[0]), root(y[0])))
                parent[hi] = lo
    return {i: root(i) for i in parent}


def check_classes(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute_classes(rows)
    got = collected(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, len(shingle_set(t)), want.get(i)) for i, t in rows), key=str)


def test_near_duplicates(docs):
    check_classes(docs)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_many_kinds(spark):
    """Families around the threshold, shared boilerplate, a doc_id with two texts, low thresholds for "frequent"."""
    shared, rows = sentence(40, [f"s{i}" for i in range(500)]), []
    for family in range(6):
        words = sentence(60 + 30 * family, [f"f{i}" for i in range(900)]).split()
        for _ in range(12):
            own = list(words)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, sentence(50, [f"u{i}" for i in range(900)]) + " " + shared) for i in range(40)]
    rows += [(3, rows[40][1]), (len(rows) + 7, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_classes(rows)
    for least in (2, 16):
        got = {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df, least_df=least).collect()}
        both = brute_classes([*rows])
        linked = {i: both[i] for i in want}
        a, b = sorted((linked[3], linked[40]))
        assert got == {(i, a if c == b else c) for i, c in linked.items()}


def test_keep_first(docs):
    out = ngram_join.keep_first(docs)
    assert out.columns == docs.columns
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(r.doc_id for r in out.collect()) == Counter([i for i, c in want.items() if i == c] + [None, None])


def test_bitmap_distance_bounds_the_difference():
    for n, m in ((5, 9), (300, 340), (3000, 2500)):
        x = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: m // 2], np.random.default_rng(m).integers(0, 2**63, m).astype(np.uint64)]))
        assert ngram_join.bitmap_distance(ngram_join.parity_bitmap(x), ngram_join.parity_bitmap(y)) <= len(np.setxor1d(x, y))


# --- 10 decontamination ---

def ascii_words(t):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]


def brute_leaks(t, items):
    ws, hit, found = ascii_words(t), set(), set()
    for item, text in items:
        own = ascii_words(text)
        k = min(13, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1 if k else 0):
            if tuple(ws[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(ws), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_find_leaks(spark, docs, block):
    long_item, short = sentence(45), "tiny test item"
    items = [(1, long_item), (2, short), (3, None), (4, " "), (5, long_item.upper()), (None, "w1"), (6, "w1 w2")]
    ws = long_item.split()
    more = [(900, sentence(20) + " " + " ".join(ws[5:25]) + " " + sentence(9)), (901, "A TINY, test-item!"), (902, " ".join(ws[:12])), (903, " ".join(ws)), (903, " ".join(ws))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("items", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.n_hit(decontaminate.find_leaks(df, benchmark, max_windows=block))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect()), key=str)
    valid = [(i, t) for i, t in items if i is not None]
    assert got == sorted(((r.doc_id, *brute_leaks(r.text, valid)) for r in df.collect()), key=str)


def test_decontaminate_modes(spark):
    item = sentence(20, [f"b{i}" for i in range(50)])
    rows = [(1, "start " + item + " end"), (2, "clean text"), (None, item), (3, sentence(900) + " " + item)]
    df, benchmark = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit(1)).drop("_spans"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(df, benchmark).collect()} == {2, None, 3}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(df, benchmark, mode="span").collect()}
    assert ascii_words(spans[1]) == ["start", "end"] and spans[2] == "clean text" and item not in spans[3]
    assert decontaminate.decontaminate(df.limit(0), benchmark).count() == 0
    assert decontaminate.decontaminate(df, benchmark.limit(0)).count() == 4


def test_links_of_ids_with_several_texts(spark):
    """A document with two texts has the links of both, wherever its other text stands in its group."""
    rows = []
    for family in range(24):
        words, base = sentence(60, [f"q{family}x{i}" for i in range(400)]).split(), 100 * family
        near = lambda k, words=words: " ".join([*words[: 50 + k], *(f"n{k}" for _ in range(10 - k))])
        rows += [(base, " ".join(words)), (base + 5, near(9)), (base + 5, sentence(50, [f"z{family}y{i}" for i in range(300)])), (base + 7, " ".join([*words[:-1], "end"]))]
        other = rows[-2][1].split()
        rows += [(base + 8, " ".join([*other[:-1], "last"])), (base + 9, ""), (base + 9, " ".join(other))]
    rng.shuffle(rows)
    check_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
