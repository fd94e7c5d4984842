from __future__ import annotations

from tidepanel.session import shared_path
from tidepanel.streaming import event_log


def test_events_once_with_prices_and_closed_days(spark):
    folder = shared_path(spark, "landing")
    rows = "VALUES (1, '2024-01-01 09:00', 'a', 'x'), (1, '2024-01-01 09:00', 'a', 'x'), (2, '2024-01-01 10:00', 'a', 'x'), (3, '2024-01-02 00:00', 'b', 'y'), (4, '2024-01-09 00:00', NULL, 'y') t(event_id, at, code, event_label)"
    spark.sql(f"SELECT CAST(event_id AS LONG) AS event_id, CAST(at AS TIMESTAMP) AS announced, code, event_label FROM {rows}").write.parquet(folder)
    once = event_log.drained(event_log.unique_events(event_log.read_events(spark, folder)), "once")
    assert sorted(r["event_id"] for r in once.collect()) == [1, 2, 3, 4]
    latest = spark.createDataFrame([("a", 5.0)], "code string, close double")
    priced = event_log.drained(event_log.with_latest_price(event_log.read_events(spark, folder), latest), "priced")
    assert sorted((r["event_id"], r["latest_close"] or 0.0) for r in priced.collect()) == [(1, 5.0), (1, 5.0), (2, 5.0), (3, 0.0), (4, 0.0)]
    days = event_log.drained(event_log.daily_counts(event_log.read_events(spark, folder)), "days")
    assert sorted((str(r["day"]), r["code"], r["n"]) for r in days.collect()) == [("2024-01-01", "a", 3), ("2024-01-02", "b", 1)]


def test_an_empty_folder_gives_no_rows(spark):
    folder = shared_path(spark, "landing")
    spark.createDataFrame([], event_log.EVENT_SCHEMA).write.parquet(folder)
    assert event_log.drained(event_log.daily_counts(event_log.read_events(spark, folder)), "days").count() == 0
