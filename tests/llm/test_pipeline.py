"""Stages of the pipeline on their own inputs, and the registered queries."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from bizdocs.llm import registry


def test_stages_chain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    ids = {r.doc_id for r in docs.collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == ids
    assert len({(r.doc_id, r.piece) for r in out}) == len(out)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    order = [d[0] for d in con.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(order).collect()))) == sorted(map(str, want))


def test_every_operator_is_registered():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries()
