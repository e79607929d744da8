"""Pages of an order index and by cursor against one sort."""

import random
import re

import pytest

from bizdocs.operators.order_index import indexed_page, page_after, write_order_index

SCHEMA = "document_id long, amount int"


@pytest.mark.parametrize("order", ["desc", "asc"])
def test_pages(spark, tmp_path, order):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 5, 5, 5, 5, rng.randrange(40)])) for i in range(400)]
    rng.shuffle(rows)
    nulls = (lambda v: v is None) if order == "asc" else (lambda v: v is not None)
    want = sorted(rows, key=lambda r: (nulls(r[1]), (r[1] or 0) * (1 if order == "asc" else -1), r[0]))
    df = spark.createDataFrame(rows, SCHEMA)
    write_order_index(df, str(tmp_path / "i"), "amount", order, rows_per_part=50)
    for page in (1, 4, 8, 9):  # whole, across ranges, last and shorter, past the end
        got = indexed_page(spark, str(tmp_path / "i"), df.schema, "amount", order, page, 53)
        assert [tuple(r) for r in got.collect()] == want[(page - 1) * 53:page * 53]
    for page in (1, 4):  # pruned to the ranges of the page, of eight; a range has about 50 rows
        plan = indexed_page(spark, str(tmp_path / "i"), df.schema, "amount", order, page, 53)._jdf.queryExecution().executedPlan().toString()
        chosen = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
        asked = re.search(r"_p#\d+ (?:IN \(([\d,]+)\)|= (\d+))", chosen)
        assert len((asked.group(1) or asked.group(2)).split(",")) <= 4, plan
    for at in (0, 60, 200, 390, 399):
        got = page_after(df, "amount", order, want[at][1], want[at][0], 53)
        assert [tuple(r) for r in got.collect()] == want[at + 1:at + 54]


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    write_order_index(df, str(tmp_path / "i"), "amount")
    assert indexed_page(spark, str(tmp_path / "i"), df.schema, "amount").count() == 0
