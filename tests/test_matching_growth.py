"""Matching on a master with many items that score alike: same rows as the SQL, without meeting every item."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from bizdocs.catalog import load, matching
from bizdocs.catalog.registry import ORACLES, QUERIES
from bizdocs.operators import match as M
from bizdocs.sources import views as V
from tests.conftest import SF
from tests.oracle_check import compare

load()
TIMES = 30


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """sf0.001 with its parts repeated under new keys."""
    out = str(tmp_path_factory.mktemp("grown"))
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{out}/lineitem.parquet")
    part = spark.read.parquet(f"{SF}/part.parquet")
    n = part.agg(F.max("p_partkey") + 1).first()[0]
    part.crossJoin(spark.range(TIMES)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * n).drop("id").write.parquet(f"{out}/part.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{name}.parquet/*.parquet'")
    return out, con


@pytest.mark.parametrize("name", ["jn05_match_prefix_code", "wn01_rank_candidates", "wn03_ambiguity", "wn04_grade_ambiguity", "qg16_assign_match_status"])
def test_same_as_sql(spark, grown, name):
    assert compare(spark, grown[1], name, QUERIES[name], ORACLES[name], grown[0]) is None


def test_few_candidates_a_probe(spark, grown):
    _, scored = matching.native_scored(spark, grown[0])
    assert scored.groupBy("probe_id").count().agg(F.max("count")).first()[0] <= 12


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_patterns_run_before_the_join(spark):
    p = M.probes(matching.code_lines(spark, SF))
    above = optimized(M.match_prefix_code(p, V.item_master(spark, SF))).split("Join")[0]
    assert "regexp" not in above


def test_specifications_are_normalised_once(spark):
    lines = V.lines(spark, SF, with_part=True).withColumns({"master_spec": F.lit("zz-qq"), "inspection_result": F.lit(None).cast("string")})
    assert "regexp" not in optimized(M.resolve_spec_conflict(lines))
