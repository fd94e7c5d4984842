"""Cases in which a query once differed from its SQL."""

from __future__ import annotations

import os
from dataclasses import replace

import duckdb
from pyspark.sql import functions as F

from tidepanel.functions.numeric import rounded
from tidepanel.plans import checks, config_queries  # noqa: F401  adds to QUERIES and SQL
from tidepanel.plans.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def tables_of(folder, **given):
    """A connection that sees the folder's tables, with those of given in their place."""
    con = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        table = name.removesuffix(".parquet")
        rows = given.get(table, "SELECT * FROM old").replace("old", f"read_parquet('{SMALL}/{name}')")
        con.execute(f"COPY ({rows}) TO '{folder}/{name}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def test_contract_checks_count_repeats_with_a_blank_period(spark, tmp_path):
    twice = "SELECT * FROM old UNION ALL SELECT * REPLACE (o_orderkey + 1000000 AS o_orderkey) FROM old WHERE o_orderpriority = '5-LOW'"
    con = tables_of(tmp_path, orders=twice)
    ours = QUERIES["contract_checks"](spark, str(tmp_path))
    found = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in ours.columns)} FROM ({SQL['contract_checks']})").fetchall()
    got = sorted(map(tuple, ours.collect()), key=str)
    assert got == sorted(found, key=str) and any(r[0] == "fundamentals" and r[1] == "duplicate_key" for r in got)


def test_blank_adaptive_parts_count_where_asked(spark):
    rows = [("a", "2020-01-01", "9", "x", ""), ("a", "2020-01-01", "9", "x", ""), ("b", "2020-01-01", "9", "x", "2019-12-31"), ("", "2020-01-01", "9", "x", ""), ("", "2020-01-01", "9", "x", "")]
    df = spark.createDataFrame(rows, "code string, available_date string, available_time string, document_type string, period_end string")
    plain = checks.fundamentals_contract()
    repeats = lambda c: [(r["n"], r["example"]) for r in checks.check_table(df, c).where("check = 'duplicate_key'").collect()]
    assert repeats(plain) == [] and repeats(replace(plain, blank_adaptive=True)) == [(1, "a")]


def test_doubles_round_as_the_sql_rounds_them(spark):
    """Scores of eight decimals that lie half way between two of six."""
    ties = [(s * (k / 10**8 + 50 / 10**8 + 0.519)).__round__(8) for k in range(0, 40_000, 100) for s in (1, -1)] + [-0.5192545, 0.49999999999999994e-6, 2.5e-6, 1e300, 4.4e15, None, float("inf")]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in ties]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ties)], "i int, x double")
    got = [r["y"] for r in df.select("i", rounded(F.col("x"), 6).alias("y")).orderBy("i").collect()]
    assert got == want and got[ties.index(-0.5192545)] == -0.519254
