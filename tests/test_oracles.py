"""Registered queries against their SQL oracles on whole tables.

A sample of every family runs by default; ``GEOPANEL_ALL=1`` runs all of them.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = (
    "c00_top_opportunities", "c08_full_composition", "a01_distinct_entities", "a12_coverage_report", "a16_zone_summary", "w02_quantile_classes",
    "p08_no_data_reason", "j05_repeat_last_cut", "j08_overlay_areas", "e03_shrinkage", "e12_supply_posterior", "e15_leave_one_out", "m06_replicate_summary",
    "b03_leave_group_out", "b11_adoption_decision", "b12_backtest_run", "c15_headline", "q05_root_aggregate", "q06_group_distribution", "q08_reconcile_levels", "s13_contract_documents", "d03_family_drift", "w08_entity_churn", "q07_record_violations", "s08_wide_projection", "f10_ring_area_and_orientation",
)
NAMES = sorted(entry_point.oracle_sql()) if os.environ.get("GEOPANEL_ALL") else SAMPLE


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(v):
    if isinstance(v, float):
        assert not math.isnan(v)
        return repr(v)
    return "~" if v is None else str(v)


def _sorted(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, db, sf_dir, name):
    df = entry_point.queries()[name](spark, sf_dir)
    res = db.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(res.fetchall(), columns)


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
