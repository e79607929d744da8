"""A text's table is read once per text, not again in a filter that Spark infers from an explode."""

from bizdocs.operators import text_tables as X

TEXT = "품목명 | 수량 | 합계\n볼트 | 2 | 30\n너트 | 1 | 5"


def test_table_is_read_once(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "x"), (3, None)], "id int, text string")
    t = df.select("id", X.table_of("text").alias("t")).select("id", "t.headers", "t.rows")
    for made in (X.semantic_items(t, "id", "headers", "rows"), X.canonical_rows(t, "id", "headers", "rows"), X.table_items(df, "id")):
        filters = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if line.lstrip(" +-:").startswith("Filter")]
        assert not any(r"\r\n|\n|\r" in line or "split(" in line and "coalesce(text" in line for line in filters)
        assert [(r["id"], r["row"], r["item_name"]) for r in made.orderBy("row").collect()] == [(1, 0, "볼트"), (1, 1, "너트")]
