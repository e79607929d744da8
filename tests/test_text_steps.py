"""Steps over a text are taken once: repeated ones gave the same rows, only later."""

from __future__ import annotations

from bizdocs.operators import text_tables as X


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def slip(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_a_labelled_number_is_read_once(spark):
    """The pattern of labelled numbers stood in the plan once for every mention of the number, now once."""
    df = slip(spark, "참조\n문서번호: po_2024_0O12").select(X.document_number("text").alias("n"))
    assert plan(df).count("([A-Za-z0-9가-힣._/-]+)") == 1
    assert df.first()["n"] == "PO-2024-0012"


def test_long_patterns_are_not_decoded_for_every_line(spark):
    df = slip(spark, "문서번호: A-1\n공급가액 10").select("id", X.key_value_pairs("text").alias("kv"))
    tests = plan(df).split("RLIKE(")[1:]
    assert tests and not any(X.KNOWN_LABELS in t.split("RLIKE(")[0].split("regexp_")[0] for t in tests)
    assert [tuple(p) for p in df.first()["kv"]] == [("문서번호", "A-1"), ("공급가액", "10")]


def test_one_word_before_the_only_colon(spark):
    df = slip(spark, "x：1\n고객사: a b\n상호 : c: d\nx: 2 문서번호: 3").select(X.key_value_pairs("text").alias("kv"))
    assert [tuple(p) for p in df.first()["kv"]] == [("x", "1"), ("고객사", "a b"), ("상호", "c: d"), ("문서번호", "3")]


def test_known_labels_serve_the_fields_that_the_rules_give(spark):
    rules = spark.createDataFrame([(k, ts) for k, ts in X._known_targets().items()], "k string, t array<string>")
    ruled = rules.select("t", X._ruled_targets(rules["k"]).alias("r")).collect()
    assert ruled and all(t == r for t, r in ruled)


def test_a_table_row_is_mapped_below_its_filter(spark):
    """The filter on mapped rows was moved below the mapping and mapped the row again for every field it reads."""
    t = spark.createDataFrame([(1, ["품목명", "수량"], [["볼트", "3"], ["합계", ""]])], "id int, h array<string>, rows array<array<string>>")
    for made in (X.semantic_items(t, "id", "h", "rows"), X.canonical_rows(t, "id", "h", "rows")):
        assert plan(made).count("zip_with(") == 1
    assert [r["item_name"] for r in X.semantic_items(t, "id", "h", "rows").collect()] == ["볼트"]


def test_numbers_of_a_line_are_read_once_for_all_windows(spark):
    df = slip(spark, "공급가액 1000\n세액 100\n합계 1,100\nx\n공급가액 2000\n세액 200\n합계 2,200").select(X.amount_triples("text").alias("t"))
    assert plan(df).count("\\d[\\d,]*(?:\\.\\d+)?[A-Za-z]?") == 1
    assert [float(v) for v in df.first()["t"]] == [2200.0, 2000.0, 200.0]
