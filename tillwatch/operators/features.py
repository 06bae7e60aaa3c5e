"""Feature columns of the machine-day table.

Every window is partitioned by machine and ordered by day, so the planner needs one shuffle
and one sort by (machine, day) for all of them. Two passes are enough: the first numbers the
rows and looks one row back, the second uses those columns in its frames.

Frames count rows, not days: a gap of missing days does not shorten a frame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tillwatch.functions import clip, ratio
from tillwatch.session import compile_wide

# Public holidays known to the feature set. Callers may pass their own list.
HOLIDAYS = [
    "2025-01-01", "2025-02-19", "2025-03-12", "2025-04-18", "2025-04-21", "2025-05-23",
    "2025-06-09", "2025-08-01", "2025-08-06", "2025-10-20", "2025-12-25", "2025-12-26",
    "2026-01-01", "2026-02-18", "2026-03-11", "2026-04-03", "2026-04-06", "2026-05-25",
    "2026-06-08", "2026-08-01", "2026-08-06", "2026-10-19", "2026-12-25", "2026-12-26",
    "2027-01-01", "2027-02-17", "2027-03-10", "2027-03-26", "2027-03-29", "2027-05-24",
    "2027-06-07", "2027-08-02", "2027-08-06", "2027-10-18", "2027-12-25", "2027-12-27",
]
# Pay days, hardware limits and the weights of the two scores.
SALARY_DAYS = [25, 26, 27]
SERVICE_CAPACITY = 1000
BIN_CAPACITY_NOTES = 3000
NOTE_VALUE = 2000
NOTES_PER_DEPOSIT = 30
NEVER_SERVICED = 999
STRESS_CAP_DAYS = 60
EMPTY_CAP_HOURS = 720
PEAK_HOUR_SHARE = 0.24
HEALTH_WEIGHTS = {"uptime": 0.40, "errors": 0.30, "maintenance": 0.20, "cash": 0.10}
RISK_WEIGHTS = {"acceleration": 0.30, "downtime": 0.25, "trend": 0.20, "run": 0.15, "diversity": 0.10}

WORK_COLUMNS = ["_pos", "_prev_start", "_burn", "_service", "_burn_7d", "_tx_spread"]
ROLLING_MEAN_COLUMNS = [
    "uptime_percentage", "error_count", "transaction_count", "ending_cash_balance",
    "daily_withdrawal_amount", "avg_transaction_amount",
]

def _history() -> WindowSpec:
    """A machine's rows by day. The balance only settles the order of several rows of one day; it is
    the order of the roll-up's own window too, so rows that come from there need no new sort."""
    return Window.partitionBy("atm_id").orderBy("record_date", "ending_cash_balance")


def _last(rows: int, history: WindowSpec | None = None) -> WindowSpec:
    return (history or _history()).rowsBetween(1 - rows, 0)


def _so_far(history: WindowSpec | None = None) -> WindowSpec:
    return (history or _history()).rowsBetween(Window.unboundedPreceding, 0)


def _whole_history() -> WindowSpec:
    return _history().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def calendar(daily: DataFrame, holidays: Sequence[str] = HOLIDAYS) -> DataFrame:
    """Weekday (Monday = 0), month, and 0/1 flags for holiday, month end, pay day and weekend."""
    day = F.col("record_date")
    return daily.withColumns(
        {
            "day_of_week": F.weekday(day),
            "month": F.month(day),
            "is_holiday": _flag(day.isin([F.lit(h).cast("date") for h in holidays])),
            "is_month_end": _flag(day == F.last_day(day)),
            "is_salary_day": _flag(F.dayofmonth(day).isin(SALARY_DAYS)),
            "is_weekend": _flag(F.weekday(day) >= 5),
        }
    )


def cyclical(days: DataFrame) -> DataFrame:
    week = F.lit(2 * math.pi) * F.col("day_of_week") / 7
    year = F.lit(2 * math.pi) * F.col("month") / 12
    return days.withColumns(
        {"day_sin": F.sin(week), "day_cos": F.cos(week), "month_sin": F.sin(year), "month_cos": F.cos(year)}
    )


def _previous_rows(days: DataFrame) -> DataFrame:
    """First window pass: row number, previous starting balance, last known service."""
    new = {
        "_pos": F.row_number().over(_history()),
        "_prev_start": F.lag("starting_cash_balance").over(_history()),
        "_burn": clip(F.col("starting_cash_balance") - F.col("ending_cash_balance"), 0.0),
    }
    if "service_date" in days.columns:
        if dict(days.dtypes)["service_date"] == "string":
            days = days.withColumn("service_date", F.col("service_date").try_cast("timestamp_ntz"))
        new["_service"] = F.last("service_date", ignorenulls=True).over(_so_far())
    return days.withColumns(new)


def _whole_days_since_service(days: DataFrame) -> Column:
    """Whole days from the last service to the row's day, rounded down also where it lies ahead.

    Counted in calendar days, so a clock change in the session's time zone plays no part; a service
    later than midnight has not yet completed its last day.
    """
    kind = dict(days.dtypes)["_service"]
    service_day = F.to_date("_service")
    whole = F.datediff("record_date", service_day)
    return whole if kind == "date" else whole - _flag(F.col("_service") > service_day.cast(kind))


def since_service(days: DataFrame) -> DataFrame:
    if "_service" not in days.columns:
        return days.withColumn("days_since_maintenance", F.lit(NEVER_SERVICED).cast("long"))
    since = _whole_days_since_service(days)
    return days.withColumn("days_since_maintenance", F.coalesce(since, F.lit(NEVER_SERVICED)).cast("long"))


def _deposit_notes(days: DataFrame) -> DataFrame:
    """Notes put into the bin: by value, but no more than fit through the slot per deposit."""
    if "daily_deposit_amount" not in days.columns:
        days = days.withColumns({"daily_deposit_amount": F.lit(0.0), "daily_deposit_count": F.lit(0).cast("long")})
    by_value = F.coalesce(F.col("daily_deposit_amount") / NOTE_VALUE, F.lit(0.0))
    by_count = F.coalesce(F.col("daily_deposit_count"), F.lit(0)) * NOTES_PER_DEPOSIT
    return days.withColumn("estimated_deposit_notes", F.least(by_value, by_count.cast("double")))


def rolling_columns(columns: Sequence[str], history: WindowSpec | None = None) -> dict[str, Column]:
    """Means over the last seven rows. ``error_count_7d`` is therefore a mean; the sum has its own name."""
    return {f"{c}_7d": F.avg(c).over(_last(7, history)) for c in ROLLING_MEAN_COLUMNS if c in columns}


def frame_columns(columns: Sequence[str], history: WindowSpec | None = None) -> dict[str, Column]:
    """The columns over the last seven or thirty rows."""
    last_7, last_30 = _last(7, history), _last(30, history)
    errors = F.col("error_count")
    gap_in_trend = F.count("uptime_percentage").over(last_7) < F.count("*").over(last_7)
    serviced = F.sum(_flag(F.col("service_date").isNotNull())).over(last_30) if "service_date" in columns else F.lit(0).cast("long")
    return {
        **rolling_columns(columns, history),
        "error_count_30d": F.sum(errors).over(last_30),
        "error_count_7d_sum": F.sum(errors).over(last_7),
        "error_type_diversity": F.coalesce(F.stddev_samp(errors).over(last_7), F.lit(0.0)),
        "_tx_spread": F.coalesce(F.stddev_samp("transaction_count").over(last_7), F.lit(0.0)),
        "_burn_7d": F.avg("_burn").over(last_7),
        "maintenance_count_30d": serviced,
        "health_trend_7d": F.when(gap_in_trend, 0.0).otherwise(
            F.coalesce(F.regr_slope("uptime_percentage", "_pos").over(last_7), F.lit(0.0))
        ),
    }


def refill_position() -> Column:
    """The row's position where its balance starts higher than the row before it did."""
    return F.when(F.col("starting_cash_balance") > F.col("_prev_start"), F.col("_pos"))


def clean_position() -> Column:
    return F.when(F.coalesce("error_count", F.lit(0)) <= 0, F.col("_pos"))


def notes_after_service() -> Column:
    return F.when(F.col("days_since_maintenance") >= 0, F.col("estimated_deposit_notes")).otherwise(0.0)


def _history_columns(days: DataFrame) -> DataFrame:
    """Second window pass: all frames at once, on the partitioning and order of the first."""
    so_far, whole = _so_far(), _whole_history()
    tx, position = F.col("transaction_count"), F.col("_pos")
    refill_row = F.last(refill_position(), True).over(so_far)
    clean_row = F.last(clean_position(), True).over(so_far)
    first_row = F.lit(1)
    weekend = F.col("is_weekend") == 1
    weekend_mean = F.when(F.max("is_weekend").over(whole) == 1, F.avg(F.when(weekend, tx)).over(whole)).otherwise(0.0)
    weekday_mean = F.when(F.min("is_weekend").over(whole) == 0, F.avg(F.when(~weekend, tx)).over(whole)).otherwise(1.0)
    return days.withColumns(
        {
            **frame_columns(days.columns),
            # Rows since the start of the current run; the run starts at its refill or clean row.
            "days_since_replenishment": position - F.coalesce(refill_row, first_row),
            "time_since_last_error": position - F.coalesce(clean_row, first_row),
            "weekend_vs_weekday_ratio": F.coalesce(weekend_mean / (weekday_mean + 1), F.lit(1.0)),
            "cumulative_deposit_notes": F.sum(notes_after_service()).over(so_far),
        }
    )


def _rates(days: DataFrame) -> DataFrame:
    """Row-local ratios of the day's own figures."""
    up_hours = F.col("uptime_percentage") / 100.0 * 24
    rate_hours = F.col("uptime_minutes") / 60 if "uptime_minutes" in days.columns else up_hours
    capacity = F.col("service_capacity") if "service_capacity" in days.columns else F.lit(SERVICE_CAPACITY)
    tx = F.col("transaction_count")
    spent = F.col("starting_cash_balance") - F.col("ending_cash_balance")
    return days.withColumns(
        {
            "utilization_rate": ratio(tx, capacity),
            "cash_consumption_rate": spent / (rate_hours + 1),
            "transaction_velocity": tx / (up_hours + 0.01),
            "consecutive_downtime_mins": clip(100 - F.col("uptime_percentage"), 0.0) / 100.0 * 1440,
            "peak_hour_transactions": F.rint(tx * F.lit(PEAK_HOUR_SHARE)),
            "activity_level_raw": tx,
        }
    )


def _volatility(days: DataFrame) -> Column:
    """Spread of the 24 hourly counts where a row has them (population), else of daily counts (sample)."""
    if "hourly_counts" not in days.columns:
        return F.col("_tx_spread")
    return hourly_spread("hourly_counts")


def hourly_spread(column: str) -> Column:
    """Population spread of an array in one pass: sums and squares of the distances from the first value."""
    counts = F.transform(column, lambda x: x.cast("double"))
    n = F.size(column)

    def add(acc, x):
        d = x - acc["first"]
        return F.struct(acc["first"].alias("first"), (acc["s"] + d).alias("s"), (acc["q"] + d * d).alias("q"))

    start = F.struct(F.get(counts, F.lit(0)).alias("first"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    variance = F.aggregate(counts, start, add, lambda acc: (acc["q"] - acc["s"] * acc["s"] / n) / n)
    return F.when(n > 0, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0)


def scores(days: DataFrame) -> DataFrame:
    """Columns built from the history columns: stress, health and failure risk."""
    surge = clip(F.col("weekend_vs_weekday_ratio") - 1.0, 0.0)
    before_weekend = F.col("day_of_week").isin(3, 4).cast("double")
    days = days.withColumns(
        {
            "avg_daily_consumption": clip("_burn_7d", 1.0) * (1.0 + before_weekend * surge),
            "deposit_bin_utilization": clip(F.col("cumulative_deposit_notes") / BIN_CAPACITY_NOTES, 0.0, 1.0),
            "error_acceleration": F.when(
                F.col("error_count_30d") > 0, F.col("error_count_7d_sum") / F.col("error_count_30d")
            ).otherwise(0.0),
            "transaction_volatility": _volatility(days),
            "time_to_predicted_empty": clip(
                F.col("ending_cash_balance") / clip("cash_consumption_rate", 0.01), 0.0, float(EMPTY_CAP_HOURS)
            ),
        }
    )
    days = days.withColumn(
        "cash_stress_indicator_raw",
        clip(F.col("ending_cash_balance") / F.col("avg_daily_consumption"), 0.0, float(STRESS_CAP_DAYS)),
    )
    days = days.withColumn(
        "cash_stress_indicator", clip(1 - F.col("cash_stress_indicator_raw") / STRESS_CAP_DAYS, 0.0, 1.0)
    )
    h, r = HEALTH_WEIGHTS, RISK_WEIGHTS
    days = days.withColumns(
        {
            "uptime_weight": F.col("uptime_percentage") / 100.0 * h["uptime"],
            "error_inverse_weight": 1 / (F.col("error_count_7d_sum") + 1) * h["errors"],
            "maintenance_inverse_weight": 1 / (clip("days_since_maintenance", 0) + 1) * h["maintenance"],
            "cash_stress_inverse_weight": (1 - F.col("cash_stress_indicator")) * h["cash"],
        }
    )
    return days.withColumns(
        {
            "composite_health_score": (
                F.col("uptime_weight")
                + F.col("error_inverse_weight")
                + F.col("maintenance_inverse_weight")
                + F.col("cash_stress_inverse_weight")
            )
            * 100,
            "failure_risk_score": F.col("error_acceleration") * r["acceleration"]
            + 1 / (F.col("consecutive_downtime_mins") + 1) * r["downtime"]
            - F.col("health_trend_7d") * r["trend"]
            + 1 / (F.col("time_since_last_error") + 1) * r["run"]
            + 1 / (F.col("error_type_diversity") + 1) * r["diversity"],
        }
    )


def day_columns(daily: DataFrame, holidays: Sequence[str] = HOLIDAYS) -> DataFrame:
    """The columns that follow from the day's own row."""
    return calendar(daily, holidays).transform(cyclical).transform(_rates).transform(_deposit_notes)


def features(daily: DataFrame, holidays: Sequence[str] = HOLIDAYS) -> DataFrame:
    """The machine-day table with every feature column."""
    compile_wide(daily.sparkSession)
    wide = (
        day_columns(daily, holidays)
        .transform(_previous_rows)
        .transform(since_service)
        .transform(_history_columns)
        .transform(scores)
    )
    return wide.drop(*WORK_COLUMNS)
