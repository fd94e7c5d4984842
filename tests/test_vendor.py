from __future__ import annotations

import hashlib
from datetime import date

import pytest

from tidepanel.plans import contract_panels as cp
from tidepanel.session import shared_path
from tidepanel.sources import tables, vendor


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_instrument_classes(spark):
    cases = [
        ("7203", "Motor", "プライム", "輸送", "common_stock"), ("1306", "Index", "", "", "etf"), ("1306", "Index", "プライム", "", "common_stock"), ("2000", "x", "その他", "その他", "etf"),
        ("2000", "x", "その他", "銀行", "common_stock"), ("2000", "My REIT", "グロース", "", "etf"), ("2000", "x", "インフラファンド", "", "etf"), ("2000", None, None, None, "common_stock"), ("1400", None, None, None, "etf"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "Code string, CoName string, MktNm string, S33Nm string").coalesce(1)
    out = vendor.listings(df, "2024-01-04")
    assert [r["security_type"] for r in out.collect()] == [c[4] for c in cases]
    first = out.collect()[0]
    assert first["source_date"] == "2024-01-04" and first["market_code"] == "" and first["is_common_stock"] == "true" and first["lot_size"] == "100"
    assert vendor.listings(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vendor.contract_table(df, "bonds")


def test_bars_and_their_flags(spark):
    df = spark.createDataFrame([("2024-01-05 00:00:00", "1", "10", "5", "", "0", ""), ("2024-01-04", "2", "10", "", "1,000.5", "1", "0"), ("2024-01-04", "1", "-", "5", "5", "", "2"), (None, "3", "0", "5", "5", None, None), ("2024-01-04", "1", "3", "0", "0", None, None)], "Date string, Code string, C string, Vo string, Va string, UL string, LL string")
    got = rows(vendor.contract_table(df, "prices"), "date", "code", "unadjusted_close", "unadjusted_open", "tradable_flag", "price_limit_flag")
    assert sorted(got) == sorted([("", "3", "0", "", "false", "false"), ("2024-01-04", "1", "-", "", "false", "true"), ("2024-01-04", "1", "3", "", "false", "false"), ("2024-01-04", "2", "10", "", "true", "true"), ("2024-01-05", "1", "10", "", "true", "false")])
    assert [g[:2] for g in got] == sorted(g[:2] for g in got)


def test_codes_and_months(spark):
    lines = spark.createDataFrame(list(enumerate(["Code,name", " 7203 ,Motor", "# none", "", "code", "7203", ",x", "9984"])), "position int, line string")
    codes = vendor.code_list(lines)
    assert [c for c, _ in sorted(rows(codes, "code", "position"), key=lambda r: r[1])] == ["7203", "code", "9984"]
    bars = spark.createDataFrame([("7203",), ("7203",), ("1",), (None,)], "Code string")
    assert vendor.only_codes(bars, codes).count() == 2
    keys = spark.createDataFrame([("bars/2023/12/x_202401.csv.gz",), ("bars_2024-02.csv",), ("bars_2024_3.csv",), ("2024/13",), (None,)], "Key string")
    assert sorted(str(r[0]) for r in rows(vendor.in_months(keys, "Key", "2024-02", "2024-12"), "Key")) == ["2024/13", "None", "bars_2024-02.csv", "bars_2024_3.csv"]
    assert vendor.in_months(keys, "Key").count() == 5 and vendor.in_months(keys, "Key", end="202401").count() == 4


def test_aliases_and_moments(spark):
    df = spark.createDataFrame([("-", "1,5", None, "2024-01-04 15:30", "", ""), ("7", "9", "3", " ", "2024-01-04", "09:00:10"), ("", "", "", "", "2024-01-04", ""), (None, None, None, None, None, "09:00")], "sales string, revenue string, Profit string, announcement_datetime string, available_date string, available_time string").coalesce(1)
    numbers = vendor.statement_numbers(df)
    assert rows(numbers, "sales", "net_profit", "equity") == [(15.0, None, None), (7.0, 3.0, None), (None, None, None), (None, None, None)]
    assert "revenue" not in numbers.columns and "available_date" in numbers.columns
    assert [str(r[0]) for r in rows(df.select(vendor.event_moment(df).alias("m")), "m")] == ["2024-01-04 15:30:00", "2024-01-04 09:00:10", "2024-01-04 00:00:00", "None"]
    bad = spark.createDataFrame([("soon",)], "announcement_datetime string")
    with pytest.raises(Exception, match="invalid announcement"):
        bad.select(vendor.event_moment(bad)).collect()
    assert rows(df.select(vendor.numeric_column(df, ["none", "sales", "revenue"]).alias("x")), "x") == [(None,), (7.0,), (None,), (None,)]


def test_stocks_of_samples(spark):
    df = spark.createDataFrame([("true", "", "プライム", "銀行", "A", ""), ("yes", "no", "グロース", "銀行", "NEXT ETF", "Common Stock"), ("1", "true", "グロース", "銀行", "A", ""), ("", "", "グロース", "銀行", "A", ""), ("true", None, "その他", "その他", None, "etf")], "is_common_stock string, is_etf_reit_infra string, market string, sector string, name string, security_type string").coalesce(1)
    assert [tuple(r) for r in df.select(vendor.is_research_stock(df), vendor.is_sample_stock(df)).collect()] == [(True, True), (True, False), (False, False), (False, False), (False, False)]


def test_enriched_listings(spark):
    listed = spark.createDataFrame([("1 ", "", "x", 1), ("2", "2001-01-01", "", 2), ("3", None, None, 3), ("4", "", "y", 4)], "code string, listed_date string, source string, status int")
    life = spark.createDataFrame([("1", "1999-01-01", "2005-05-05", "2005-05-04", "delisted", "a|b"), ("2", "1999-01-01", "2005-05-05", "2005-05-04", "active", None), ("3", None, None, None, "odd", "c")], "code string, inferred_listed_date string, inferred_delisted_date string, inferred_last_trading_date string, lifecycle_status string, evidence_flags string")
    out = cp.enriched_listings(listed, life).orderBy("status")
    assert rows(out, "listed_date", "delisted_date", "last_trading_date", "listing_lifecycle_status", "source", "lifecycle_evidence_flags") == [
        ("1999-01-01", "2005-05-05", "2005-05-04", "pit_inferred_lifecycle_terminal", "x+inferred_lifecycle", "a|b"),
        ("2001-01-01", "", "", "pit_inferred_lifecycle_active", "inferred_lifecycle", ""),
        ("", "", "", "pit_inferred_lifecycle_unknown", "inferred_lifecycle", "c"),
        ("", "", "", "", "y", ""),
    ]


def test_expected_dates(spark):
    ends = cp.month_ends(spark, "2024-01-15", "2024-04-29")
    assert sorted(r[0] for r in rows(ends, "rebalance_date")) == [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)]
    assert rows(cp.month_ends(spark, "2024-01-15", "2024-06-30", "quarterly").orderBy("rebalance_date"), "rebalance_date") == [(date(2024, 3, 31),), (date(2024, 6, 30),)]
    assert cp.month_ends(spark, "2024-02-15", "2024-01-15").count() == 0
    cp.assert_dates(ends, ends)
    panel = ends.where("rebalance_date <> date'2024-02-29'").unionAll(spark.sql("SELECT date'2024-01-30'"))
    with pytest.raises(ValueError, match="missing rebalance date 2024-02-29"):
        cp.assert_dates(panel, ends)
    with pytest.raises(ValueError, match="unexpected rebalance date 2024-01-31"):
        cp.assert_dates(ends, ends.where("rebalance_date > date'2024-01-31'"))


def test_baskets_of_the_latest_closes(spark):
    members = spark.sql("SELECT code, 'sector' AS group_type, g AS group_id, date'2024-01-01' AS available_date, w AS membership_weight FROM VALUES ('a', 'x', 1d), ('b', 'x', 3d), ('c', 'x', 4d), ('c', 'y', 1d) t(code, g, w)")
    prices = spark.sql("SELECT code, d AS date, close FROM VALUES ('a', date'2024-01-02', 10d), ('a', date'2024-01-09', 99d), ('b', date'2024-01-03', 20d) t(code, d, close)")
    out = cp.basket_values(members, prices, spark.sql("SELECT date'2024-01-05' AS date")).orderBy("group_id")
    assert rows(out, "group_id", "basket_value", "coverage") == [("x", 17.5, 0.5), ("y", None, 0.0)]


def test_provenance(spark, tmp_path):
    place = tmp_path / "panel"
    (place / "sub").mkdir(parents=True)
    (place / "b.txt").write_bytes(b"two")
    (place / "sub" / "a.txt").write_bytes(b"one")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert tables.checksum(spark, str(place / "b.txt")) == sha(b"two")
    assert tables.checksum(spark, str(place)) == sha(f"b.txt:{sha(b'two')}\nsub/a.txt:{sha(b'one')}".encode())
    assert tables.file_digests(spark, str(place)).count() == 2
    manifest = shared_path(spark, "manifest")
    for name in ("a", "b"):
        tables.append_manifest(spark, manifest, source=name, checksum=sha(b"two"))
    kept = tables.read_table(spark, manifest, "csv")
    assert kept.columns == tables.MANIFEST_FIELDS and sorted(r["source"] for r in kept.collect()) == ["a", "b"] and all(r["downloaded_at"] for r in kept.collect())
    with pytest.raises(ValueError, match="no fields"):
        tables.append_manifest(spark, manifest, color="red")


def test_ledgers_by_policy(spark):
    ledger = spark.createDataFrame([("r1", "old"), ("r2", "old"), (None, "old")], "run_id string, note string")
    fresh = spark.createDataFrame([("r1", "new", "9"), ("r3", "new", "9")], "run_id string, note string, score string")
    one = lambda df: sorted((r["run_id"], r["note"], r["score"]) for r in df.collect())
    assert one(tables.upserted(ledger, fresh, "replace")) == [("", "old", ""), ("r1", "new", "9"), ("r2", "old", ""), ("r3", "new", "9")]
    assert len(one(tables.upserted(ledger, fresh, "allow"))) == 5
    assert len(one(tables.upserted(ledger, fresh.where("run_id = 'r3'")))) == 4
    with pytest.raises(Exception, match="the ledger has run r1"):
        tables.upserted(ledger, fresh).collect()
    with pytest.raises(ValueError):
        tables.upserted(ledger, fresh, "merge")
