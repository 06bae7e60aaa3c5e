import math
import random
from collections import Counter

import numpy as np
import pytest
from frames import collect, day, fleet_days, one_row
from pyspark.sql import functions as F

from tillwatch.functions import clip, half_even, half_up, ratio
from tillwatch.operators import alerts, fleet, geo, scoring
from tillwatch.operators.features import features

FIELDS = ("cash_stress_indicator double, deposit_bin_utilization double, error_acceleration double, "
          "days_since_maintenance long, operational_status string, failure_probability double")


@pytest.mark.parametrize(
    "values, expected",
    [
        ((0.85, 0.0, 0.0, 0, "in_service", 0.0), ["CASH_CRITICAL"]),
        ((0.60, 0.0, 0.0, 0, "in_service", 0.0), ["CASH_LOW"]),
        ((0.70, 0.0, 0.0, 0, "in_service", 0.0), ["CASH_LOW"]),
        ((0.20, 0.0, 0.0, 0, "in_service", 0.0), []),
        ((0.0, 0.95, 0.0, 0, None, 0.0), ["DEPOSIT_BIN_CRITICAL"]),
        ((0.0, 0.0, 0.75, 0, None, 0.0), ["ERROR_SPIKE"]),
        ((0.0, 0.0, 0.0, 45, None, 0.0), ["MAINTENANCE_DUE"]),
        ((0.0, 0.0, 0.0, 60, None, 0.0), ["MAINTENANCE_DUE"]),
        ((0.0, 0.0, 0.0, 90, None, 0.0), ["MAINTENANCE_OVERDUE"]),
        ((0.0, 0.0, 0.0, 0, "out_of_service", 0.0), ["OUT_OF_SERVICE"]),
        ((0.0, 0.0, 0.0, 0, None, 0.85), ["CRITICAL_ERROR"]),
        ((None, None, None, None, None, None), []),
        ((0.9, 0.95, 0.6, 61, "out_of_service", 0.8),
         ["CASH_CRITICAL", "DEPOSIT_BIN_CRITICAL", "ERROR_SPIKE", "MAINTENANCE_OVERDUE", "OUT_OF_SERVICE", "CRITICAL_ERROR"]),
    ],
)
def test_alert_rules(spark, values, expected):
    assert alerts.with_alerts(spark.createDataFrame([values], FIELDS)).first()["alerts"] == expected


def test_alerts_of_an_empty_record(spark):
    assert alerts.with_alerts(spark.range(1)).first()["alerts"] == []


def test_own_rules_can_be_added(spark):
    df = spark.createDataFrame([(5,)], "queue int")
    assert alerts.with_alerts(df, [("LONG_QUEUE", F.col("queue") > 3)]).first()["alerts"] == ["LONG_QUEUE"]


def test_overlay_lets_current_fields_win(spark):
    preds = spark.createDataFrame([("A", 0.1, "in_service"), ("B", 0.2, "in_service")], "atm_id string, p double, operational_status string")
    now = spark.createDataFrame([("A", "out_of_service")], "atm_id string, operational_status string")
    got = collect(scoring.overlay(preds, now), "atm_id")
    assert [(r["p"], r["operational_status"]) for r in got] == [(0.1, "out_of_service"), (0.2, "in_service")]


def test_feed_and_counts(spark):
    table = spark.createDataFrame([("A", 50.0, ["CASH_LOW", "OUT_OF_SERVICE"]), ("B", 40.0, ["CASH_CRITICAL"]), ("C", 1.0, [])],
                                  "atm_id string, health_score double, alerts array<string>")
    feed = alerts.alert_feed(table)
    assert {(r["atm_id"], r["code"], r["severity"]) for r in collect(feed)} == {
        ("A", "CASH_LOW", "MEDIUM"), ("A", "OUT_OF_SERVICE", "CRITICAL"), ("B", "CASH_CRITICAL", "CRITICAL")}
    assert {r["severity"]: r["alerts"] for r in collect(alerts.alert_counts(feed))} == {"CRITICAL": 2, "HIGH": 0, "MEDIUM": 1, "LOW": 0}
    assert [r["code"] for r in alerts.top_alerts(feed, 2).collect()] == ["CASH_CRITICAL", "CASH_LOW"]
    high = alerts.alert_feed(table, high=("CASH_LOW",))
    assert high.filter("severity = 'HIGH'").count() == 1


def test_rounding_and_clipping(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (1.115,), (0.5,), (None,)], "v double")
    got = df.select(half_even("v", 2), half_up("v", 2), half_even("v"), clip("v", 0.2, 1.0), ratio("v", F.lit(0))).collect()
    for (v,), r in zip(df.collect(), got):
        if v is None:
            assert list(r) == [None] * 5
        else:
            assert r[0] == round(v, 2) and r[1] == math.floor(v * 100 + 0.5) / 100 and r[2] == round(v)
            assert r[3] == min(max(v, 0.2), 1.0) and r[4] is None


@pytest.mark.parametrize(
    "change, expected",
    [
        ({"ending_cash_balance": 0.0}, 0.0),
        ({"ending_cash_balance": -5.0}, 0.0),
        ({}, round(700_000 / 3_000_000, 2)),  # a long estimate is cut to the upper bound
        ({"record_date": day("2026-03-26")}, 0.15),  # pay day: lowest quarter of 0.1167 .. 0.2333
        ({"starting_cash_balance": 600_000.0}, 0.23),  # negative rate: seven days, cut to the bound
    ],
)
def test_depletion_bounds(spark, change, expected):
    latest = scoring.latest_features(features(one_row(spark, **change)))
    assert scoring.with_rounded(latest, {"days": scoring.formula_depletion(latest.columns)}).first()["days"] == pytest.approx(expected, abs=0.005)


def test_week_and_months(spark):
    daily = fleet_days(spark, n_days=40, machines=1)
    got = scoring.newest_with_series(features(daily), "2026-02-04").first()
    by_day = {r["record_date"]: r for r in daily.collect()}
    want = [0] * 7
    for d in [day("2026-01-29"), day("2026-01-30"), day("2026-01-31"), day("2026-02-01"), day("2026-02-02"), day("2026-02-03"), day("2026-02-04")]:
        want[(d.weekday() + 1) % 7] = by_day[d]["transaction_count"]
    assert got["weekly_txns"] == want
    january = sum(r["error_count"] for d, r in by_day.items() if d.month == 1)
    assert got["monthly_inactive"] == [0, 0, january]
    volume = scoring.weekly_volume(daily, "2026-02-04").first()[1]
    assert volume == round(sum(want) / len([w for w in want if w]))
    assert scoring.week_labels("2026-02-04") == ["s", "m", "t", "W", "t", "f", "s"]


def test_defaults_for_unknown_machines(spark):
    rows = spark.createDataFrame([("A",), ("B",)], "atm_id string")
    preds = scoring.predictions(features(fleet_days(spark, 10, 1)), "2026-01-10").withColumn("atm_id", F.lit("A"))
    got = collect(scoring.with_defaults(rows, preds), "atm_id")
    assert (got[1]["health_score"], got[1]["failure_probability"], got[1]["days_to_depletion"]) == (75, 0.05, 7)
    assert got[1]["activity_level"] == "Moderate" and got[0]["health_score"] != 75


def _km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("centre, radius", [((17.9, -76.9), 2.0), ((0.0, 179.99), 5.0), ((89.95, 10.0), 8.0), ((-60.0, -180.0), 30.0)])
def test_distance_join_equals_brute_force(spark, centre, radius):
    rng = random.Random(1)
    span = radius / 111 * 2
    place = lambda: (max(-90.0, min(90.0, centre[0] + rng.uniform(-span, span))),
                     (centre[1] + rng.uniform(-span, span) / max(0.05, math.cos(math.radians(centre[0]))) + 540) % 360 - 180)
    # A third of the machines stand in one place.
    machines = [(f"m{i}", *(centre if i % 3 == 0 else place())) for i in range(300)] + [("nowhere", None, 1.0)]
    points = [(f"p{i}", *place()) for i in range(12)]
    m = spark.createDataFrame(machines, "atm_id string, lat double, lng double")
    p = spark.createDataFrame(points, "point_id string, point_lat double, point_lng double")
    got = {(r["point_id"], r["atm_id"]) for r in collect(geo.near_points(m, p, radius))}
    want = {(a, b) for a, la, lo in points for b, ma, mo in machines[:-1] if _km(la, lo, ma, mo) <= radius}
    assert got == want and want
    one = geo.near_point(m, points[0][1], points[0][2], radius)
    assert {r["atm_id"] for r in collect(one)} == {b for a, b in want if a == "p0"}


def test_distance_join_deals_pairs_of_one_cell_to_tasks(spark):
    """All in one cell: its points go to several partitions, every pair is there once, and copies of rows stay."""
    rng = random.Random(2)
    place = lambda: (17.901 + rng.uniform(0, 0.01), -76.889 + rng.uniform(0, 0.01))
    m = spark.createDataFrame([(f"m{i}", *place()) for i in range(200)], "atm_id string, lat double, lng double")
    p = spark.createDataFrame([(f"p{i % 90}", 17.905, -76.885) for i in range(100)], "point_id string, point_lat double, point_lng double")
    found = geo.near_points(m, p, part_pairs=1000, cell_machines=50).withColumn("task", F.spark_partition_id()).collect()
    pairs = Counter((r["point_id"], r["atm_id"]) for r in found)
    assert len(found) == 100 * 200 and len(pairs) == 90 * 200 and set(pairs.values()) == {1, 2}
    assert len({r["task"] for r in found}) > 2 and sum(r["task"] == found[0]["task"] for r in found) < len(found) / 2


def test_kpis_of_an_empty_fleet(spark):
    rows = spark.createDataFrame([], "atm_id string, health_score double, cash_stress_indicator double, "
                                     "failure_probability double, operational_status string")
    assert list(fleet.fleet_kpis(rows).first()) == [0, 0, 0, 0, 0, 0]


def test_machine_filter_reaches_the_scan(spark):
    from tillwatch.plans.fleet_queries import job

    plan = job(spark, "/root/testdata/sf0.001").machine("7")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "= 7)" in line]
    assert len(filters) >= 4


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_rounding_equals_pythons(spark, digits):
    """Random values, exact halves, and values next to a half."""
    rng = np.random.default_rng(digits)
    halves = (rng.integers(-10**6, 10**6, 2000) + 0.5) / 10**digits
    values = np.concatenate([rng.normal(0, 10.0 ** rng.integers(-3, 7, 4000)), halves, np.nextafter(halves, 0), np.nextafter(halves, 1e9)])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r["r"] for r in rows.select(half_even("v", digits).alias("r")).collect()]
    assert got == [round(float(v), digits) for v in values]
