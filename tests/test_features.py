import math
import statistics as st

import pytest
from frames import collect, day, fleet_days, one_row, rows

from tillwatch.operators.features import HEALTH_WEIGHTS, features


def one(df):
    return collect(features(df))[0]


def test_single_row_formulas(spark):
    f = one(one_row(spark))
    assert f["utilization_rate"] == pytest.approx(0.2)
    assert f["cash_consumption_rate"] == pytest.approx(300_000 / (0.92 * 24 + 1))
    assert f["transaction_velocity"] == pytest.approx(200 / (0.92 * 24 + 0.01))
    assert f["consecutive_downtime_mins"] == pytest.approx(8 / 100 * 1440)
    assert f["peak_hour_transactions"] == 48
    assert f["days_since_maintenance"] == 999 and f["maintenance_count_30d"] == 0
    assert f["estimated_deposit_notes"] == 25
    assert (f["day_of_week"], f["month"], f["is_weekend"], f["is_month_end"], f["is_salary_day"]) == (6, 3, 1, 0, 0)
    assert f["health_trend_7d"] == 0 and f["error_type_diversity"] == 0 and f["transaction_volatility"] == 0
    assert f["error_acceleration"] == 1.0
    # A lone Sunday: weekend mean 200 over (1 + 1).
    assert f["weekend_vs_weekday_ratio"] == 100.0
    assert f["avg_daily_consumption"] == 300_000
    assert f["cash_stress_indicator_raw"] == pytest.approx(700_000 / 300_000)
    assert f["cash_stress_indicator"] == pytest.approx(1 - 700_000 / 300_000 / 60)


def test_weights_add_up_to_the_score(spark):
    for f in collect(features(fleet_days(spark))):
        parts = ["uptime_weight", "error_inverse_weight", "maintenance_inverse_weight", "cash_stress_inverse_weight"]
        assert sum(f[p] for p in parts) * 100 == pytest.approx(f["composite_health_score"])
        assert 0 <= f["composite_health_score"] <= 100
        assert 0 <= f["cash_stress_indicator"] <= 1 and 0 <= f["time_to_predicted_empty"] <= 720
        assert all(v is not None and not (isinstance(v, float) and math.isnan(v))
                   for k, v in f.items() if k != "service_date")
    assert sum(HEALTH_WEIGHTS.values()) == pytest.approx(1)


def test_hourly_counts_give_population_spread(spark):
    f = one(one_row(spark, hourly_counts=[float(i) for i in range(24)]))
    assert f["transaction_volatility"] == pytest.approx(6.922, abs=1e-3)
    assert one(one_row(spark, hourly_counts=[]))["transaction_volatility"] == 0
    assert one(one_row(spark, hourly_counts=None))["transaction_volatility"] == 0


def test_deposit_bin(spark):
    f = one(one_row(spark, daily_deposit_amount=60_000.0, daily_deposit_count=5))
    assert f["estimated_deposit_notes"] == 30 and f["deposit_bin_utilization"] == pytest.approx(0.01)
    capped = one(one_row(spark, daily_deposit_amount=6_000_000.0, daily_deposit_count=1))
    assert capped["estimated_deposit_notes"] == 30


def test_deposits_count_from_the_service_day_on(spark):
    base = {"atm_id": "A", "uptime_percentage": 99.0, "error_count": 0, "transaction_count": 10,
            "starting_cash_balance": 10.0, "ending_cash_balance": 5.0, "service_date": day("2026-03-10"),
            "daily_deposit_amount": 60_000.0, "daily_deposit_count": 5}
    got = collect(features(rows(spark, [base | {"record_date": day("2026-03-09")}, base | {"record_date": day("2026-03-11")}])),
                  "record_date")
    assert [f["days_since_maintenance"] for f in got] == [-1, 1]
    assert [f["deposit_bin_utilization"] for f in got] == [0.0, pytest.approx(0.01)]


def _series(spark, **columns):
    n = len(next(iter(columns.values())))
    base = {"atm_id": "A", "uptime_percentage": 99.0, "error_count": 0, "transaction_count": 10,
            "starting_cash_balance": 10.0, "ending_cash_balance": 5.0}
    dicts = [base | {"record_date": day("2026-02-01").replace(day=i + 1)} | {k: v[i] for k, v in columns.items()}
             for i in range(n)]
    return collect(features(rows(spark, dicts)), "record_date")


def test_error_runs(spark):
    got = _series(spark, error_count=[0, 0, 1, 2, 0, 3, 0, 0])
    assert [f["time_since_last_error"] for f in got] == [0, 0, 1, 2, 0, 1, 0, 0]
    leading = _series(spark, error_count=[2, 1, None, 4])
    assert [f["time_since_last_error"] for f in leading] == [0, 1, 0, 1]


def test_replenishment_restarts_at_each_increase(spark):
    got = _series(spark, starting_cash_balance=[50.0, 40.0, 90.0, 80.0, 80.0, 85.0, 10.0])
    assert [f["days_since_replenishment"] for f in got] == [0, 1, 0, 1, 2, 0, 1]


def test_rolling_windows_count_rows(spark):
    errors = [1, 0, 2, 5, 0, 0, 3, 4, 1]
    got = _series(spark, error_count=errors, uptime_percentage=[90.0, 92.0, 91.0, 95.0, 99.0, 97.0, 96.0, 80.0, 85.0])
    for i, f in enumerate(got):
        last = errors[max(0, i - 6): i + 1]
        assert f["error_count_7d"] == pytest.approx(sum(last) / len(last))
        assert f["error_count_7d_sum"] == sum(last) and f["error_count_30d"] == sum(errors[: i + 1])
        assert f["error_type_diversity"] == pytest.approx(st.stdev(last) if len(last) > 1 else 0)
    ups = [90.0, 92, 91, 95, 99, 97, 96]
    slope = st.linear_regression(range(7), ups).slope
    assert got[6]["health_trend_7d"] == pytest.approx(slope)


def test_null_uptime_flattens_the_trend(spark):
    got = _series(spark, uptime_percentage=[90.0, None, 95.0, 99.0])
    assert [f["health_trend_7d"] for f in got] == [0, 0, 0, 0]
    assert got[1]["cash_stress_indicator"] is not None and got[1]["uptime_weight"] is None


def test_weekend_surge(spark):
    tx = [800 if day("2026-02-01").replace(day=i + 1).weekday() >= 5 else 100 for i in range(14)]
    got = _series(spark, transaction_count=tx)
    assert got[0]["weekend_vs_weekday_ratio"] == pytest.approx(800 / 101)
    thursday, monday = got[4], got[1]
    assert thursday["avg_daily_consumption"] == pytest.approx(5 * 800 / 101)
    assert monday["avg_daily_consumption"] == 5


@pytest.mark.parametrize(
    "change, column, value",
    [
        ({"transaction_count": 0}, "utilization_rate", 0),
        ({"ending_cash_balance": 0.0}, "cash_stress_indicator", 1),
        ({"ending_cash_balance": 1_000_000.0}, "cash_consumption_rate", 0),
        ({"uptime_percentage": 0.0}, "consecutive_downtime_mins", 1440),
        ({"uptime_percentage": 100.0}, "consecutive_downtime_mins", 0),
        ({"error_count": 0}, "error_acceleration", 0),
        ({"service_capacity": 0}, "utilization_rate", None),
        ({"service_capacity": 400}, "utilization_rate", 0.5),
    ],
)
def test_edges(spark, change, column, value):
    assert one(one_row(spark, **change))[column] == value


def test_service_time_of_day_rounds_down(spark):
    df = one_row(spark).selectExpr("*", "timestamp_ntz'2026-03-15 10:00:00' AS service_date")
    assert one(df)["days_since_maintenance"] == -1
    text = one_row(spark).selectExpr("*", "'not a date' AS service_date")
    assert one(text)["days_since_maintenance"] == 999


def test_empty_frame(spark):
    assert features(one_row(spark).limit(0)).count() == 0


def test_wide_projections_are_compiled_under_default_settings(spark):
    """Generated methods of more than 8,000 bytes stay interpreted; a session's own limit is kept."""
    limit, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        for given, kept in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(limit, given)
            features(fleet_days(spark, 3, 1)).count()
            assert spark.conf.get(limit) == kept
    finally:
        spark.conf.set(limit, before)
