"""Panel queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tidepanel.plans import config_queries, more_queries, vendor_queries  # noqa: F401  add to QUERIES and SQL
from tidepanel.plans.queries import QUERIES, SQL

PLACE = "/root/testdata/sf0.001"
NAMES = ["asof_latest_price", "expression_factors", "price_volume_plain_alphas", "derived_fundamentals", "factor_diagnostics", "parsed_values", "group_signals", "pit_snapshot_universe", "rebalance_disclosures", "grouped_diagnostics", "universe_profile", "strict_universe_panel", "contract_checks", "memberships_by_mode", "group_allocation_constraints", "rebalance_fundamentals", "lookback_expressions", "vendor_listings", "vendor_prices", "vendor_statements", "vendor_benchmark", "price_sample", "statement_numbers", "enriched_listings", "basket_values", "rebalance_date_differences", "event_stream_counts", "price_readings", "retargeted_shares"]
pytestmark = pytest.mark.skipif(not os.path.isdir(PLACE), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in sorted(os.listdir(PLACE)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{PLACE}/{name}')")
    return con


def plain(value):
    """Numbers to six digits, the sign of zero kept; NaN and null alike."""
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else f"{float(value):.6g}"
    return value if value is None else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, database, name):
    ours = QUERIES[name](spark, PLACE)
    columns = sorted(ours.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=repr)
    found = database.execute("SELECT {} FROM ({})".format(", ".join(f'"{c}"' for c in columns), SQL[name])).fetchall()
    assert got == sorted((tuple(plain(x) for x in r) for r in found), key=repr)
