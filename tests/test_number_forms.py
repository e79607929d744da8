"""The letters that open a number form are never missing where the form matches."""

import random
import re

from bizdocs.operators import text_tables as X

STARTS = ["FAX-ABC-PO-", "FAXx-PO", "PO0-", "po ", "QT-", "Inv-US-", "INV AB ", "DN_", "TS-", "IQC-", "QC", "I0C-", "ioc-", "rtn-", "RCM", "TRF-", "MV-", "IDOC-", "doc", "PM-", "P0S-", "POS-X1-", "RC-"]


def test_no_form_is_shut_out():
    rng, seen = random.Random(3), set()
    for _ in range(20_000):
        tail = "".join(rng.choice(["2024", "001", "0123", "-", "-", "_", " ", "A1", "XY", "O12"]) for _ in range(rng.randint(1, 5)))
        text = rng.choice(["", "번호 ", "x "]) + rng.choice(STARTS) + tail
        for place, (form, letters) in enumerate(zip(X.NUMBER_FORMS, X.NUMBER_FORM_LETTERS, strict=True)):
            if re.search("(?i)" + form, text):
                seen.add(place)
                assert any(w in text.upper() for w in letters), (text, form)
    assert seen == set(range(len(X.NUMBER_FORMS)))


def test_same_number_twice_and_references(spark):
    texts = ["po-2024-0001\nPO-2024-0001", "참조문서: INV-2023-0099\nDN-2024-0007", "견적 qt-2024-0001-ab\nTRF-2024-0003", "없음", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.document_number("t")).collect()] == ["PO-2024-0001", "DN-2024-0007", "TRF-2024-0003", None, None]
