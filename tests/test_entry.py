"""Driver contract, and a sample of the registered queries against their checking SQL.

``HARVESTLAKE_ALL=1`` checks every registered query; scripts/verify_oracle.py does the same
at any scale.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "scan_sitemap_xml", "canonicalize_urls", "extract_links", "link_drop_stats", "filter_links", "classify_pages", "jsonld_products", "gtm_products", "script_inventory_summary",
    "upsert_latest", "run_stats", "record_issues", "quality_summary_gate", "coverage_funnel", "batch_pressure", "endpoint_cooldown", "profile_health_score", "politeness_schedule",
    "repair_plan", "frontier_add", "robots_verdict", "scan_catalog_json", "paged_assembly", "strategy_scorecard", "select_fields", "stream_fetch_metrics", "stream_resume", "sink_export",
]


def text(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["host", "reason", "links"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("HARVESTLAKE_ALL") else SAMPLE)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(row[names.index(c)]) for c in cols) for row in cur.fetchall())
    assert got == want
