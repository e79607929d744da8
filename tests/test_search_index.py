"""The search index against the scan it replaces."""

import random
import re

from bizdocs.operators.browse import search
from bizdocs.operators.search_index import indexed_search, literal_runs, write_search_index

DOCS = "document_id long, title string, raw_text string, extra int"
LINES = "document_id long, line_index long, item_name string, quantity int"
WORDS = ["Widget", "bolt-12", "강철 파이프", "ΟΔΟΣ", "50%", "a_b", 'say "hi"', "İstanbul", "nut", "\\x", "tab\tbed", "😀ok"]


def rows(rng, ids):
    text = lambda: rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randrange(1, 5)))])
    docs = [(i, text(), text(), 1) for i in ids]
    lines = [(i, n, text(), rng.choice([None, n])) for i in ids for n in range(rng.randrange(3))]
    return docs, lines


def test_runs():
    assert literal_runs("%red_wid%") == ["red", "wid"]
    assert literal_runs("%50\\%off%") == ["50%off"]
    assert literal_runs("%%") == []


def test_same_as_scan(spark, tmp_path):
    rng = random.Random(5)
    path, all_docs, all_lines = str(tmp_path / "i"), [], []
    for batch, ids in enumerate([range(60), range(60, 90)]):
        docs, lines = rows(rng, ids)
        docs.append((None, "no id widget", None, 1))
        for _ in range(2 - batch):  # writing the first batch again replaces it
            write_search_index(spark.createDataFrame(docs, DOCS), path, spark.createDataFrame(lines, LINES), batch, docs_per_range=4, ranges_per_part=3)
        all_docs += docs
        all_lines += lines
    docs, lines = spark.createDataFrame(all_docs, DOCS), spark.createDataFrame(all_lines, LINES)
    found = 0
    for term in ["widget", "WIDGET nut", "wid%et", "a_b", "파이프", "οδος", "istanbul", "i̇stan", "12", "bolt-12 강철", "zzz", "50\\%", '\\\\"hi', "ed b", "😀ok", "", "item_name"]:
        want = sorted((r[0] or -1 for r in search(docs, term, lines).collect()))
        got = sorted((r[0] or -1 for r in indexed_search(spark, path, term).collect()))
        assert got == want, term
        found += 0 < len(want) < len(all_docs)
    assert found > 8


def test_reads_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = [(i, "needle here" if i == 77 else "plain straw", None, 1) for i in range(200)]
    write_search_index(spark.createDataFrame(docs, DOCS), path, docs_per_range=5, ranges_per_part=4)
    out = indexed_search(spark, path, "needle")
    assert [r.document_id for r in out.collect()] == [77]
    plan = out._jdf.queryExecution().executedPlan().toString()
    parts = re.findall(r"_part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert parts and all(len((a or b).split(",")) == 1 for a, b in parts), plan


def test_empty(spark, tmp_path):
    path = str(tmp_path / "i")
    write_search_index(spark.createDataFrame([], DOCS), path, spark.createDataFrame([], LINES))
    for term in ("needle", "x", ""):
        assert indexed_search(spark, path, term).count() == 0
