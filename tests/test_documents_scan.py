"""The declared scan and JSON in fragments."""

import json
import random

from pyspark.sql import functions as F

from bizdocs.plans import export as X
from bizdocs.sources.documents import check_documents, document_schema, load_documents, quarantine


def test_checks(spark, tmp_path):
    good = {"document_id": "1", "original_filename": "a.pdf", "stored_file_path": "/a", "mime_type": "x"}
    cases = [
        ({}, []), ({"document_id": "one"}, ["document_id: wrong type"]), ({"document_id": None}, ["document_id: missing"]), ({"mime_type": "m" * 101}, ["mime_type: too long"]),
        ({"mime_type": "m" * 100}, []), ({"document_type": "Invoice"}, ["document_type: unknown value"]), ({"document_type": "invoice"}, []),
        ({"extracted_amount": "12345678901.00"}, ["extracted_amount: wrong type"]), ({"extracted_amount": "12.345"}, []), ({"issue_date": "31/12/2024"}, ["issue_date: wrong type"]),
        ({"tags": '["a", "b"]'}, []), ({"tags": "a,b"}, ["tags: wrong type"]), ({"line_items": '[{"q": 1}]'}, []), ({"line_items": "[{"}, ["line_items: malformed"]),
        ({"is_favorite": "maybe", "currency": "DOLLARS/US"}, ["currency: too long", "is_favorite: wrong type"]), ({"processing_status": ""}, ["processing_status: unknown value"]),
    ]
    names = sorted({*good, *(c for case, _ in cases for c in case)})
    raw = spark.createDataFrame([tuple({**good, **case}.get(n) for n in names) for case, _ in cases], ", ".join(f"{n} string" for n in names)).withColumn("surprise", F.lit(5))
    checked = check_documents(raw)
    assert checked.drop("reasons", "source").schema.simpleString() == document_schema().simpleString()
    got = sorted(sorted(r.reasons) for r in checked.select("reasons").collect())
    assert got == sorted(sorted(reasons) for _, reasons in cases)
    rows, rejected, counts = quarantine(checked, str(tmp_path / "q"))
    bad = sum(1 for _, reasons in cases if reasons)
    assert counts == {"rows": len(cases), "rejected": bad}
    assert (rows.count(), rejected.count()) == (len(cases) - bad, bad)
    assert all(json.loads(r.source)["surprise"] == 5 for r in rejected.collect())
    assert {r.document_type for r in rows.collect()} == {"general_document", "invoice"} and {tuple(r.tags) for r in rows.collect()} == {(), ("a", "b")}


def test_typed_clashing_missing_and_empty(spark, tmp_path):
    """Typed columns, names equal but for case (the first counts), nested values for JSON, missing columns, no rows."""
    raw = spark.sql("SELECT 7 AS Document_ID, 8L AS document_id, 'f' AS original_filename, '/f' AS stored_file_path, array(struct(1 AS q)) AS line_items, timestamp'2024-05-01 10:00:00' AS issue_date, array('t') AS tags")
    row = check_documents(raw).first()
    assert (row.document_id, row.line_items, str(row.issue_date), row.tags, row.reasons) == (7, '[{"q":1}]', "2024-05-01", ["t"], ["mime_type: missing"])
    rows, rejected, counts = quarantine(check_documents(raw.limit(0)), str(tmp_path / "q"))
    assert counts == {"rows": 0, "rejected": 0} and rows.count() == rejected.count() == 0


def test_load(spark, tmp_path):
    spark.createDataFrame([("1", "a", "/a", "m"), ("x", "b", "/b", "m")], "document_id string, original_filename string, stored_file_path string, mime_type string").write.option("header", True).csv(str(tmp_path / "in"))
    rows, rejected, counts = load_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), "csv", header=True)
    assert [r.document_id for r in rows.collect()] == [1] and counts == {"rows": 2, "rejected": 1}
    assert rejected.first().reasons == ["document_id: wrong type"]


def test_fragments_are_the_document(spark, sf):
    """Joined in order they parse to the object of ``to_canonical_json``, for any size of a fragment."""
    from bizdocs.catalog.lines import receipts, repeated

    docs, lines = receipts(spark, sf).filter("document_id < 900"), repeated(spark, sf).drop("copy").filter("document_id < 900")
    want = {r.document_id: json.loads(r.json) for r in X.to_canonical_json(docs, lines).collect()}
    for size in (1, 3, 4096):
        parts = X.to_json_fragments(docs, lines, lines_per_part=size).collect()
        random.Random(1).shuffle(parts)
        joined = {}
        for r in sorted(parts, key=lambda r: (r.document_id, r.part)):
            joined.setdefault(r.document_id, []).append((r.part, r.json))
        assert all([p for p, _ in v] == list(range(len(v))) for v in joined.values())
        assert {k: json.loads("".join(j for _, j in v)) for k, v in joined.items()} == want
