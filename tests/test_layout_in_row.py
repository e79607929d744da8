"""Layout of pages read in the page's row: no tokens shuffled for rows, each page labelled once, documents of several pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bizdocs.catalog import load
from bizdocs.catalog.registry import QUERIES
from bizdocs.operators import layout as Y
from tests.conftest import SF

load()
TOKEN = "doc_id string, page int, text string, confidence double, x_min double, y_min double, x_max double, y_max double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["wn08_group_rows_exact", "wn09_group_rows_fixed"])
def test_rows_are_found_without_a_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange hashpartitioning" not in text and text.count("ArrowEvalPython") == 1


def test_header_labels_once_and_moves_one_row_a_document(spark):
    text = plan(QUERIES["wn12_best_header"](spark, SF))
    assert text.count("ArrowEvalPython") == 1 and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["tx23_assign_columns", "tx24_structured_rows", "tx24_line_item_candidates"])
def test_tokens_are_moved_once(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("ArrowEvalPython") == 2 and text.count("Exchange hashpartitioning") == 2


def page(doc, number, *rows):
    return [(doc, number, text, 0.9, float(x), 30.0 * i, x + 20.0, 30.0 * i + 12) for i, row in enumerate(rows) for x, text in row]


def test_documents_of_several_pages_and_without_header(spark):
    tokens = page("a", 2, [(0, "품명"), (100, "수량"), (200, "합계")], [(2, "pipe"), (98, "3"), (205, "1,200")]) + page("a", 1, [(0, "no header")]) + page("a", 3, [(0, "bolt"), (101, "7"), (202, "90")])
    tokens += page("b", 1, [(0, "nut 5 6 7")], [(0, " ")])
    random.Random(1).shuffle(tokens)
    pages = Y.page_rows(Y.as_pages(spark.createDataFrame(tokens, TOKEN).repartition(5)))
    header = Y.best_header(Y.table_rows(pages), Y.column_boundaries(Y.columns_from_header("tokens")).alias("columns"))
    assert [(r["doc_id"], r["page"], r["row_index"], r["score"]) for r in header.collect()] == [("a", 2, 1, 3)]
    both = Y.with_header(pages, header)
    assigned = Y.assign_columns(both).filter("doc_id = 'b'").select("text", "column").collect()
    assert [tuple(r) for r in assigned] == [("nut 5 6 7", None)]
    rows = Y.structured_rows(both).orderBy("doc_id", "page", "row_index").select("doc_id", "page", "row_index", "item_name", "quantity", "line_total").collect()
    assert [tuple(r) for r in rows] == [("a", 2, 2, "pipe", 3.0, 1200.0), ("a", 3, 1, "bolt", 7.0, 90.0), ("b", 1, 1, "nut 5 6 7", None, 7.0)]
