"""Registered queries against their SQL twins. ``BIZDOCS_ALL=1`` runs every query instead of a spread."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SLOW = {"jn06_match_fuzzy", "jn07_suggest", "ud02_alias_score", "tx24_structured_rows", "tx24_line_item_candidates"}
NAMES = sorted(entry.queries())
CHOSEN = NAMES if os.environ.get("BIZDOCS_ALL") else [n for n in NAMES[::5] if n not in SLOW]


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, sf, duck, name):
    assert compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), sf) is None


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "document_count", "total_amount"]
