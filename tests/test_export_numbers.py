"""Places of exported lines: short documents are numbered where they meet, long ones by ranges, with the same numbers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from bizdocs.catalog import lines as C, load
from bizdocs.catalog.registry import QUERIES
from bizdocs.operators import line_items as L, ordering as O
from bizdocs.plans import export as X
from tests.conftest import SF

load()


@pytest.mark.parametrize("whole", [5, 65_536])
def test_numbers_of_short_and_long_keys(spark, whole):
    rows = [("hot", i * 7 % 101) for i in range(101)] + [("a", 3), ("a", 1), ("b", 9)]
    df = spark.createDataFrame(rows, "g string, o long").repartition(4)
    got = {(r["g"], r["o"]): (r["n"], r["n_of"]) for r in O.number_short(df, "g", "o", "n", df, whole).collect()}
    assert got == {("hot", i): (i + 1, 101) for i in range(101)} | {("a", 1): (1, 2), ("a", 3): (2, 2), ("b", 9): (1, 1)}


@pytest.mark.parametrize("name", ["sk01_erp_rows", "sk01_mapped_rows", "sk04_json_fragments"])
def test_no_ranges_and_no_unread_columns(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in text and "cut-" not in text
    kept = [line for line in text.split("\n") if "min_by" in line]
    assert kept and not any("ship_date" in line for line in kept)


def test_fragments_join_to_the_object(spark, monkeypatch):
    docs, lines = C.receipts(spark, SF), C.repeated(spark, SF).drop("copy")
    want = {r["document_id"]: json.loads(r["json"]) for r in X.to_canonical_json(docs, lines).collect()}
    monkeypatch.setattr(O, "WHOLE", 2)
    for part in (1, 3):
        parts = X.to_json_fragments(docs, lines, lines_per_part=part)
        whole = parts.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "json"))), lambda p: p["json"]), "").alias("j"))
        got = {r["document_id"]: json.loads(r["j"]) for r in whole.collect()}
        assert got.keys() == want.keys()
        assert all(got[d]["document"] == want[d]["document"] and got[d]["line_items"] == want[d]["line_items"] and got[d]["policy"] == want[d]["policy"] for d in want)


def test_collapsed_sets_move_no_unread_columns(spark, monkeypatch):
    written = []
    monkeypatch.setattr(L, "cut", lambda df: written.append(set(df.columns)) or df)
    docs, lines = C.doubled(spark, SF)
    some = L.collapse_duplicate_sets(docs, lines, ["document_id", "line_no", "part_key", "copy"])
    assert written and not any({"ship_date", "note", "unit", "review_flags"} & w for w in written)
    every = L.collapse_duplicate_sets(docs, lines)
    assert every.columns == lines.columns
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.select(*some.columns).collect()))
