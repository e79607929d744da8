"""Patterns are tried only on texts that hold one of their literals; results are those of the bare patterns."""

import re

import pytest
from pyspark.sql import functions as F

from bizdocs.functions.lines import text_lines
from bizdocs.functions.text import collapse, matches, signs
from bizdocs.operators import text_tables as X

PATTERNS = [X.FORMAL_TITLE, X.RECEIPT_SIGNAL, X.RETURN_WORDS, X.TRANSFER_WORDS, X.POS_WORDS, X.MEMO_WORDS, X.DOLLAR_WORDS, X.AMOUNT_SIGNAL, X.TOTAL_LABEL, X.PROFILE_LINES[1]]
TEXTS = ["자재 \t이동", "TRF-2024", "trf2024", "Credit  Memo", "US$ 5", "$", "", "합계", "총  합계: 5", " Student ID : 7", "pos메인", "POS 메인", "RC 2024", "영수증\n", "purchase\nmemo", "price", "v.a.t", "크레딧 메모", "İTRF 2024"]


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_signs_of_a_pattern():
    assert signs(r"(?i)\bTRF[-_ ]?\d{4}|자재\s*이동") == ["TRF", "자재"]
    assert signs(r"\d+|x") == [] and signs("a?b*") == [] and signs("(?:ab)?cd{2,}") == ["c"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_sign_is_in_every_match(pattern):
    assert signs(pattern)
    for text in TEXTS:
        if re.search(pattern, text):
            assert any(w.lower() in text.lower() for w in signs(pattern)), text


def test_matches_is_the_bare_pattern(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "id int, t string")
    pairs = [(matches(F.col("t"), F.lower("t"), p), F.col("t").rlike(p)) for p in PATTERNS]
    for same in df.select(*[a.eqNullSafe(b) for a, b in pairs]).collect():
        assert all(same)


@pytest.mark.parametrize("name", ["classify_profile", "classify_type", "classify_category", "taxonomy", "preclassify"])
def test_no_pattern_is_tried_without_its_sign(spark, name):
    args = {"taxonomy": ["t", "t"], "preclassify": ["t", F.array("t")]}.get(name, ["t"])
    text = plan(spark.createDataFrame([("x",)], "t string").select(getattr(X, name)(*args)))
    searched = re.findall(r"(.{12})RLIKE\(", text, re.S)
    assert searched and all(re.search(r"\) AND $", before) for before in searched)


def test_lines_are_collapsed_once(spark):
    df = spark.createDataFrame([(" a  b\t\tc \r\n\r \x0b\fd\te\n \n f g\rh ",)], "t string")
    assert df.select(text_lines("t")).first()[0] == ["a b c", "d e", "f g", "h"]
    assert df.select(collapse("t")).first()[0] == re.sub(r"\s+", " ", df.first().t)
    lines = plan(df.select(text_lines("t").alias("x")))
    assert "lambdafunction(trim(regexp_replace" not in lines and lines.count("regexp_replace") == 1


def test_amount_below_a_lone_label_with_a_currency(spark):
    texts = ["합계\n1,100", "합 계 : KRW\n2,200", "총 합계 원\n3,300원", "금액원\n4,400", "합계 5,500 computed", "합계: $ 6,600"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select(X.labelled_amount("text", ["합계", "총합계", "금액원"]).cast("int").alias("a")).collect()
    assert [r.a for r in got] == [1100, 2200, 3300, None, None, 6600]


def test_pairs_of_a_text_are_read_once(spark):
    read = X.key_values(spark.createDataFrame([(1, "합계 5")], "id int, text string"), "id")
    lines = read._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [v for v in lines if "Filter" in v and "transform(" in v]
