"""Group memberships and external panels, scale profiles and sketches."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidepanel.plans import group_panels as gp, profile

D = date
MEMBERS = "code string, group_type string, group_id string, membership_weight string, purity_score string, {at} string"


def members(spark, rows, at):
    return spark.createDataFrame(rows, MEMBERS.format(at=at))


def at(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "date date")


def test_snapshots_and_changes(spark):
    rows = [("a", "t", "x", "", None, "2020-01-31"), ("b", "t", "x", "2", "0.5", "2020-01-31"), ("a", "t", "y", "3", "", "2020-03-31"), ("a", "t", "x", "4", "1", "2020-03-31")]
    days = at(spark, D(2020, 1, 1), D(2020, 2, 1), D(2020, 4, 1), None)
    exact = gp.membership_panel(members(spark, rows, "rebalance_date"))
    got = sorted((r["date"].month, r["code"], r["group_id"], r["membership_weight"]) for r in gp.members_at(days, exact).collect())
    assert exact.exact and got == [(2, "a", "x", 1.0), (2, "b", "x", 2.0), (4, "a", "x", 4.0), (4, "a", "y", 3.0)]  # b left with the snapshot
    asof = gp.membership_panel(members(spark, rows, "available_date"))
    got = sorted((r["date"].month, r["code"], r["group_id"], r["membership_weight"], r["purity_score"]) for r in gp.members_at(days, asof).collect())
    assert not asof.exact and got == [(2, "a", "x", 1.0, None), (2, "b", "x", 2.0, 0.5), (4, "a", "x", 4.0, 1.0), (4, "a", "y", 3.0, None), (4, "b", "x", 2.0, 0.5)]
    both = members(spark, rows, "available_date").withColumn("rebalance_date", F.lit("2020-05-05"))
    assert gp.membership_panel(both.dropDuplicates(["code", "group_id"])).exact and not gp.membership_panel(both, "available_date").exact


@pytest.mark.parametrize(
    ("row", "text"),
    [((None, "t", "x", "1", "", "2020-01-01"), "lacks"), (("a", " ", "x", "1", "", "2020-01-01"), "lacks"), (("a", "t", "x", "1", "", "soon"), "lacks"), (("a", "t", "x", "0", "", "2020-01-01"), "above zero"), (("a", "t", "x", "?", "", "2020-01-01"), "above zero"), (("a", "t", "x", "1", "2", "2020-01-01"), "purity"), (("a", "t", "x", "1", "low", "2020-01-01"), "purity")],
)
def test_broken_memberships(spark, row, text):
    with pytest.raises(Exception, match=text):
        gp.membership_panel(members(spark, [row], "rebalance_date")).rows.collect()


def test_repeated_memberships_and_columns(spark):
    twice = members(spark, [("a", "t", "x", "1", "0.5", "2020-01-01"), ("a", "t", "x", "2", "", "2020-01-01")], "rebalance_date")
    with pytest.raises(Exception, match="repeated"):
        gp.membership_panel(twice).rows.collect()
    assert [(r["membership_weight"], r["purity_score"]) for r in gp.membership_panel(twice, aggregate=True).rows.collect()] == [(3.0, 0.5)]
    for bad in (twice.drop("code"), twice.drop("rebalance_date")):
        with pytest.raises(ValueError):
            gp.membership_panel(bad)
    assert gp.members_at(at(spark, D(2020, 1, 1)), gp.membership_panel(twice.where("false"))).collect() == []


def test_group_external_modes(spark):
    groups = spark.createDataFrame([(D(2020, 1, 31), "t", "x", "old"), (D(2020, 2, 29), "t", "x", None)], "date date, group_type string, group_id string, missing_flags string")
    panel = spark.createDataFrame([("2020-01-31", "t", "x", 1.0), ("2020-01-31", "t", None, 2.0), (None, "t", "x", 3.0)], "day string, group_type string, group_id string, f double")
    told = lambda p, **how: {r["date"].month: (r["f"], r["missing_flags"]) for r in gp.with_group_external(groups, p, ["f"], **how).collect()}
    assert told(panel.withColumnRenamed("day", "date")) == {1: (1.0, "old"), 2: (None, "f")}
    assert told(panel.withColumnRenamed("day", "available_date")) == {1: (1.0, "old"), 2: (1.0, "")} == told(panel, asof_field="day")
    for bad in (panel, panel.withColumnRenamed("day", "date").drop("f"), panel.withColumnRenamed("day", "date").unionByName(panel.withColumnRenamed("day", "date"))):
        with pytest.raises(ValueError):
            gp.with_group_external(groups, bad, ["f"])
    with pytest.raises(ValueError):
        gp.with_group_external(groups.withColumn("f", F.lit(1)), panel.withColumnRenamed("day", "date"), ["f"])


def test_scale_profile_of_blank_codes(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1)), ("a", None), (" ", D(2020, 1, 3)), (None, D(2020, 1, 2)), ("b", D(2020, 1, 2))], "code string, day date")
    got = {(r["data"], r["target_codes"]): r for r in profile.scale_profile({"x": (df, "code", "day"), "none": (df.where("false"), "code", "day")}, [1, 3]).collect()}
    assert (got["x", 3]["codes"], got["x", 3]["rows_per_code"], got["x", 3]["projected_rows"], got["x", 1]["projected_rows"]) == (2, 2.5, 7, 2)
    assert (got["none", 3]["codes"], got["none", 3]["projected_rows"], got["none", 3]["first_date"]) == (0, 0, None)


def test_merged_sketches_keep_their_errors(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("code"), (F.col("id") * 7919 % 200_003).cast("double").alias("value"), (F.col("id") % 7).alias("slice"))
    slices = profile.sketch_slices(df, "slice", "code", "value")
    whole, part = (profile.merged_profile(s, [0.1, 0.5, 0.99]).first() for s in (slices, slices.where("slice < 3")))
    assert whole["rows"] == 200_000 and abs(whole["codes"] - 50_000) <= whole["code_error"] * 50_000
    for share, name in ((0.1, "p10"), (0.5, "p50"), (0.99, "p99")):
        assert abs(whole[name] / 200_003 - share) <= whole["rank_error"] + 1e-3 and abs(part[name] / 200_003 - share) <= part["rank_error"] + 1e-2
    assert part["rows"] == sum(1 for i in range(200_000) if i % 7 < 3)
