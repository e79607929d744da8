"""Document-number rules, title rules and key-value forms on small texts."""

import pytest
from pyspark.sql import functions as F

from bizdocs.operators import text_tables as X

NUMBERS = [
    ("발주 번호:\nPO-2024\n0002\n비고", None, "PO-2024-0002"), ("발주번호\nPO-2024\n\n0013\n12\nA-77", None, "PO-2024-0013-12"), ("문서번호\n비고", None, None),
    ("견적번호: QT-2O24-OO12", None, "QT-2024-0012"), ("IOC-2024-0003", None, "IQC-2024-0003"), ("QT-2024-0001-AB\nrcm-2024-0007", None, "RCM-2024-0007"),
    ("MV-2024-0001\nTRF_2024_0002", None, "TRF-2024-0002"), ("원문서: INV-2024-0001\nPO-2024-0002", None, "PO-2024-0002"),
    ("원문서\n참조문서\nDN-2024-0009", None, "DN-2024-0009"), ("원문서\n\nDN-2024-0009", None, "DN-2024-0009"), ("원문서\nDN-2024-0009", None, None),
    ("승인번호\n12345678\n영수증번호: RC-2024-0005", "receipt", "RC-2024-0005"), ("원문서: DN-2024-0001", "receipt", "DN-2024-0001"), ("", None, None), (None, None, None),
]


def test_numbers(spark):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(NUMBERS)], "i int, text string, type string, want string")
    for r in df.withColumn("got", X.document_number("text", "type")).collect():
        assert r.got == r.want, r.text


@pytest.mark.parametrize("lines,title", [
    (["Mary Ann Smith", "Quarterly review: plan"], "Quarterly review: plan"), (["Setup Guide", "notes"], "Setup Guide"), (["년도. 월. 일.", "abcd|"], "abcd|"),
])
def test_titles(spark, lines, title):
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    assert df.select(X.best_title("text").alias("t")).first().t.title == title


PAIRS = [
    ("합계금액1,000", [("합계금액", "1,000")]), ("상호가나다 상사", [("상호", "가나다 상사")]), ("상호가", []), ("문서번호: PO\n-2024", [("문서번호", "PO-2024")]),
    ("작성일\n2024-01-02", [("작성일", "2024-01-02")]), ("사업자 번호:\n123-45", [("사업자 번호", "123-45")]), ("담당\n공급자\n김", []), ("담당\n상호\n가나", [("상호", "가나")]),
    ("담당\n|\n김", [("담당", "김")]), ("담당\n비고: x", [("비고", "x")]), ("담당", []), ("비고: x\n세액\n10", [("비고", "x"), ("세액", "10")]), (None, []),
]


def test_pairs(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(PAIRS)], "doc int, text string")
    got = {}
    for r in X.key_values(df, "doc").orderBy("doc", "pos").collect():
        got.setdefault(r.doc, []).append((r.key, r.value))
    for i, (text, want) in enumerate(PAIRS):
        assert got.get(i, []) == want, text


def test_two_line_pairs_have_their_section(spark):
    df = spark.createDataFrame([(1, "공급자\n상호\n가나\n공급받는자\n상호: 다라")], "doc int, text string")
    assert {(r.section, r.key, r.value) for r in X.carry_sections(df, "doc").collect()} == {("공급자", "공급자 상호", "가나"), ("공급받는자", "공급받는자 상호", "다라")}
