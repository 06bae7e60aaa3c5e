"""Queries over the feature columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwatch.operators.carry import FeatureHistory, features_in_segments
from tillwatch.operators.features import features, hourly_spread
from tillwatch.operators.scoring import hourly_counts
from tillwatch.plans.catalog import query
from tillwatch.plans.check_sql import AS_OF, FIXTURE_HOLIDAYS
from tillwatch.plans.raw_queries import daily, readings_daily
from tillwatch.session import store, work_path
from tillwatch.sources import tables as t


def fleet_features(spark, d):
    return features(daily(spark, d), FIXTURE_HOLIDAYS)


def supplier_features(spark, d):
    return features(t.supplier_days(spark, d), FIXTURE_HOLIDAYS)


_KEY = "atm_id record_date:d"
_MEANS = (
    "uptime_percentage_7d:f error_count_7d:f transaction_count_7d:f ending_cash_balance_7d:f "
    "daily_withdrawal_amount_7d:f avg_transaction_amount_7d:f"
)
_CALENDAR = "day_of_week:i month:i is_holiday:i is_month_end:i is_salary_day:i is_weekend:i"
_RATIOS = "utilization_rate:f cash_consumption_rate:f transaction_velocity:f consecutive_downtime_mins:f peak_hour_transactions:i"
_DEPOSITS = "estimated_deposit_notes:f cumulative_deposit_notes:f deposit_bin_utilization:f"
_HEALTH = (
    "uptime_weight:f error_inverse_weight:f maintenance_inverse_weight:f cash_stress_inverse_weight:f "
    "composite_health_score:f"
)
_ALL = (
    f"{_KEY} {_CALENDAR} day_sin:f day_cos:f month_sin:f month_cos:f {_MEANS} error_count_30d:i error_count_7d_sum:i "
    f"{_RATIOS} avg_daily_consumption:f days_since_replenishment:i days_since_maintenance:i maintenance_count_30d:i "
    "health_trend_7d:f time_since_last_error:i error_type_diversity:f weekend_vs_weekday_ratio:f "
    f"{_DEPOSITS} error_acceleration:f cash_stress_indicator_raw:f cash_stress_indicator:f transaction_volatility:f "
    f"time_to_predicted_empty:f {_HEALTH} activity_level_raw:i failure_risk_score:f"
)

# name -> (columns after the key, machine-day table): the supplier table has gaps between days and
# several years, the fleet table has service dates, deposits and balances.
_VIEWS = {
    "calendar_features": (_CALENDAR, "sfeat"),
    "cyclical_features": ("day_sin:f day_cos:f month_sin:f month_cos:f", "sfeat"),
    "rolling_means": (_MEANS, "sfeat"),
    "rolling_error_sums": ("error_count_30d:i error_count_7d_sum:i", "sfeat"),
    "rolling_std": ("error_type_diversity:f transaction_volatility:f", "sfeat"),
    "replenishment_islands": ("days_since_replenishment:i", "sfeat"),
    "uptime_trend": ("health_trend_7d:f", "sfeat"),
    "error_runs": ("time_since_last_error:i", "sfeat"),
    "weekend_ratio": ("weekend_vs_weekday_ratio:f", "sfeat"),
    "error_acceleration": ("error_acceleration:f", "sfeat"),
    "ratios": (_RATIOS, "feat"),
    "consumption": ("avg_daily_consumption:f", "feat"),
    "maintenance_recency": ("days_since_maintenance:i maintenance_count_30d:i", "feat"),
    "deposit_bin": (_DEPOSITS, "feat"),
    "cash_stress": ("cash_stress_indicator_raw:f cash_stress_indicator:f time_to_predicted_empty:f", "feat"),
    "health_score": (_HEALTH, "feat"),
    "failure_risk": ("failure_risk_score:f", "feat"),
}

for _name, (_columns, _base) in _VIEWS.items():
    query(_name, f"{_KEY} {_columns}", f"SELECT * FROM {_base}_all")(
        fleet_features if _base == "feat" else supplier_features
    )

query("features", _ALL, "SELECT * FROM feat_all")(fleet_features)
query("features_supplier_days", _ALL, "SELECT * FROM sfeat_all")(supplier_features)


@query("features_all_readings", _ALL.replace(_KEY, f"{_KEY} reading:i"), "SELECT * FROM rfeat_all")
def features_all_readings(spark, d):
    """A row per reading, so a machine's history has no bound: computed over ranges of (machine, day, reading)."""
    return features_in_segments(readings_daily(spark, d), FIXTURE_HOLIDAYS, order=["record_date", "reading"])


@query("features_by_day", _ALL, "SELECT * FROM feat_all")
def features_by_day(spark, d):
    """The features of the last days come from stored states, three batches of days after the first."""
    rows = store(daily(spark, d), "daily-rows")
    history = FeatureHistory(spark, work_path(spark, "feature-history"), rows.schema, FIXTURE_HOLIDAYS)
    last = F.lit(AS_OF).cast("date")
    cuts = [None, *[F.date_sub(last, n) for n in (9, 5, 1)], None]
    day = F.col("record_date")
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = rows if low is None else rows.filter(day >= low)
        history.add(part if high is None else part.filter(day < high), batch)
    return history.read()


@query(
    "hourly_volatility",
    f"{_KEY} transaction_volatility:f",
    """SELECT atm_id, record_date, stddev_pop(n) AS transaction_volatility FROM (
         SELECT m.atm_id, m.record_date, h.hour, count(tx.transaction_id) AS n
         FROM (SELECT DISTINCT atm_id, record_date FROM tx) m CROSS JOIN (SELECT unnest(range(24)) AS hour) h
         LEFT JOIN tx ON tx.atm_id = m.atm_id AND tx.record_date = m.record_date
           AND hour(tx.transaction_time) = h.hour
         GROUP BY ALL) GROUP BY atm_id, record_date""",
)
def hourly_volatility(spark, d):
    counts = hourly_counts(t.transactions(t.event_log(spark, d)))
    return counts.withColumn("transaction_volatility", hourly_spread("hourly_counts"))
