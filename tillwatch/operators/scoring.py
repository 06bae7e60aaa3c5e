"""From features to one prediction record per machine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import clip, half_even

# The record of a machine without a prediction.
DEFAULT_PREDICTION = {
    "health_score": 75.0,
    "failure_probability": 0.05,
    "activity_level": "Moderate",
    "days_to_depletion": 7.0,
    "cash_stress_indicator": 0.3,
    "error_acceleration": 0.1,
}
DEFAULT_AVG_AMOUNT = 3800.0
DEFAULT_DAILY_WITHDRAWAL = 300000.0
# Depletion heuristic and activity classes.
FULL_MACHINE = 3_000_000.0
PEAK_SHARES = {"is_holiday": 0.3, "is_salary_day": 0.4, "is_month_end": 0.2}
BUSY_ABOVE = 220
MODERATE_ABOVE = 100
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAY_LETTERS = ["s", "m", "t", "w", "t", "f", "s"]


_NEWEST = ("record_date", "ending_cash_balance")


def latest_features(feats: DataFrame) -> DataFrame:
    """The newest feature row of each machine.

    An aggregate rather than a ranking: features come out partitioned and sorted by machine, so
    this needs neither a shuffle nor another sort.
    """
    newest = F.max_by(F.struct(*feats.columns), F.struct(*_NEWEST))
    return feats.groupBy("atm_id").agg(newest.alias("_row")).select("_row.*")


# A column and the digits it is rounded to; None leaves it as it is.
Figure = tuple[Column, int | None]


def with_rounded(rows: DataFrame, figures: dict[str, Figure], *kept: Column | str) -> DataFrame:
    """Select ``kept`` and the figures, rounded exactly.

    The rounding reads its argument about nine times. Computed into a column of its own first, the
    argument appears once in the generated code, however long it is.
    """
    rounded = {n: c for n, (c, digits) in figures.items() if digits is not None}
    staged = rows.withColumns({f"_exact_{n}": c for n, c in rounded.items()})
    shown = [
        (c if digits is None else half_even(f"_exact_{n}", digits)).alias(n) for n, (c, digits) in figures.items()
    ]
    return staged.select(*kept[:1], *shown, *kept[1:])


def record_figures(columns: list[str]) -> dict[str, Figure]:
    """The figures of a prediction record, from the columns of the newest feature row."""

    def optional(column: str) -> Figure:
        return (F.col(column), 2) if column in columns else (F.lit(0.0), None)

    status = F.col("operational_status") if "operational_status" in columns else F.lit(None)
    return {
        "record_date": (F.col("record_date"), None),
        "health_score": (F.col("composite_health_score"), 1),
        "cash_stress_indicator": (F.col("cash_stress_indicator"), 3),
        "error_acceleration": (F.col("error_acceleration"), 3),
        "uptime_percentage": (F.col("uptime_percentage"), 1),
        "transactions_24h": (F.col("transaction_count").cast("long"), None),
        "avg_daily_withdrawal": optional("daily_withdrawal_amount_7d"),
        "avg_amount": optional("avg_transaction_amount_7d"),
        "days_since_maintenance": (F.coalesce(F.col("days_since_maintenance"), F.lit(999)).cast("long"), None),
        "deposit_bin_utilization": (F.col("deposit_bin_utilization"), 3),
        "operational_status": (F.coalesce(status, F.lit("in_service")), None),
    }


def base_record(feats: DataFrame) -> DataFrame:
    latest = latest_features(feats)
    return with_rounded(latest, record_figures(latest.columns), "atm_id")


def activity_by_count(tx: Column) -> Column:
    return F.when(tx > BUSY_ABOVE, "High").when(tx > MODERATE_ABOVE, "Moderate").otherwise("Low")


def bounded_depletion(days: Column, columns: list[str]) -> Figure:
    """Keep an estimate between half a day and a day of a full machine, scaled by how full it is.

    Peak days shorten the estimate and pull it into the lowest quarter of that range.
    """
    balance = F.col("ending_cash_balance")
    peak = F.lit(1.0)
    for column, share in PEAK_SHARES.items():
        if column in columns:
            peak = peak + F.col(column) * F.lit(share)
    fill = clip(balance / FULL_MACHINE, 0.0, 1.0)
    low, high = 0.5 * fill, fill
    shortened = days / peak
    shortened = F.when(peak > 1.0, F.least(shortened, low + (high - low) * 0.25)).otherwise(shortened)
    return F.when(balance <= 0, 0.0).otherwise(F.greatest(low, F.least(high, shortened))), 2


def formula_depletion(columns: list[str]) -> Figure:
    balance, rate = F.col("ending_cash_balance"), F.col("cash_consumption_rate")
    return bounded_depletion(F.when(rate > 0, balance / rate).otherwise(7.0), columns)


def formula_heads(columns: list[str]) -> dict[str, Figure]:
    """The four predictions without trained models: the documented fallbacks."""
    return {
        "health_score": (F.col("composite_health_score"), 1),
        "failure_probability": (clip("failure_risk_score", 0.0, 1.0), 3),
        "activity_level": (activity_by_count(F.col("transaction_count")), None),
        "days_to_depletion": formula_depletion(columns),
    }


def as_day(day) -> dt.date:
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def week_slots(as_of) -> list[Column]:
    """Transactions of the seven days up to ``as_of``, one aggregate per weekday (Sunday first)."""
    end = as_day(as_of)
    in_week = F.col("record_date").between(F.lit(end - dt.timedelta(days=6)), F.lit(end))
    slot = (F.weekday("record_date") + 1) % 7
    picks = []
    for i in range(7):
        here = in_week & (slot == i)
        newest = F.max_by(F.when(here, F.col("transaction_count")), F.when(here, F.struct(*_NEWEST)))
        picks.append(F.coalesce(newest, F.lit(0)).cast("long"))
    return picks


def week_labels(as_of) -> list[str]:
    today = (as_day(as_of).weekday() + 1) % 7
    return [c.upper() if i == today else c for i, c in enumerate(WEEKDAY_LETTERS)]


def past_months(as_of) -> list[int]:
    """Month numbers of the three months before the month of ``as_of``, oldest first."""
    return [(as_day(as_of).month - 1 - back) % 12 + 1 for back in (3, 2, 1)]


def month_errors(as_of) -> list[Column]:
    """Errors summed by month name, so the same month of several years counts together."""
    return [
        F.coalesce(F.sum(F.when(F.month("record_date") == m, F.col("error_count"))), F.lit(0)).cast("long")
        for m in past_months(as_of)
    ]


def weekly_series(feats: DataFrame, as_of) -> DataFrame:
    slots = feats.groupBy("atm_id").agg(F.array(*week_slots(as_of)).alias("weekly_txns"))
    return slots.withColumn("weekly_labels", F.array(*[F.lit(x) for x in week_labels(as_of)]))


def steady_volume(series: str) -> Column:
    """Mean of the non-zero days of a week, rounded."""
    total = F.aggregate(series, F.lit(0).cast("long"), lambda a, x: a + x)
    busy = F.size(F.filter(series, lambda x: x > 0))
    return F.when(total > 0, F.rint(total / busy)).otherwise(0.0).cast("long")


def weekly_volume(feats: DataFrame, as_of) -> DataFrame:
    week = weekly_series(feats, as_of)
    return week.select("atm_id", steady_volume("weekly_txns").alias("transactions_24h_predicted"))


def monthly_errors(feats: DataFrame, as_of) -> DataFrame:
    errors = feats.groupBy("atm_id").agg(F.array(*month_errors(as_of)).alias("monthly_inactive"))
    labels = [F.lit(MONTH_NAMES[m - 1]) for m in past_months(as_of)]
    return errors.withColumn("monthly_labels", F.array(*labels))


def hourly_profile(tx: DataFrame) -> DataFrame:
    """Transactions per hour of day: one aggregation with 24 conditional counts."""
    hour = F.hour("transaction_time")
    counts = [F.count_if(hour == h) for h in range(24)]
    return tx.filter(F.col("atm_id").isNotNull()).groupBy("atm_id").agg(F.array(*counts).alias("hourly_txns"))


def hourly_counts(tx: DataFrame) -> DataFrame:
    """The 24 hourly counts per machine-day, for the volatility feature."""
    hour = F.hour("transaction_time")
    counts = F.array(*[F.count_if(hour == h) for h in range(24)])
    day = F.to_date("transaction_time").alias("record_date")
    return tx.filter(F.col("atm_id").isNotNull()).groupBy("atm_id", day).agg(counts.alias("hourly_counts"))


def machine_profile(tx: DataFrame, cash: DataFrame) -> DataFrame:
    """Last balance, transactions per day and the amount's mean and spread, per machine.

    Machines without transactions or without balances are left out. A machine whose
    transactions span less than a day has no rate.
    """
    amount = "amount" if "amount" in tx.columns else "withdrawal_amount"
    last = F.max_by("remaining_cash", F.struct("timestamp", "cash_id"))
    balances = cash.groupBy("atm_id").agg(F.max("timestamp").alias("last_date"), last.alias("current_cash"))
    span = F.timestamp_diff("DAY", F.min("transaction_time"), F.max("transaction_time"))
    volumes = tx.groupBy("atm_id").agg(
        F.try_divide(F.count("*"), span).alias("daily_vol"),
        F.avg(amount).alias("avg_withdraw"),
        F.stddev_samp(amount).alias("std_withdraw"),
    )
    return balances.join(volumes, "atm_id")


# Feature columns a prediction record and its formula heads are made from.
RECORD_INPUTS = [
    "atm_id", "record_date", "starting_cash_balance", "ending_cash_balance", "transaction_count", "error_count",
    "uptime_percentage", "composite_health_score", "cash_stress_indicator", "error_acceleration",
    "daily_withdrawal_amount_7d", "avg_transaction_amount_7d", "days_since_maintenance",
    "deposit_bin_utilization", "operational_status", "failure_risk_score", "cash_consumption_rate", *PEAK_SHARES,
]


def record_inputs(feats: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Only what scoring reads, so that the planner drops the windows of all other features."""
    wanted = dict.fromkeys([*RECORD_INPUTS, *(extra or [])])
    return feats.select(*[c for c in wanted if c in feats.columns])


def newest_with_series(feats: DataFrame, as_of) -> DataFrame:
    """Newest feature row, week and months of each machine.

    All three come from one aggregation over the features, on the partitioning the features
    already have.
    """
    newest = F.max_by(F.struct(*[c for c in feats.columns if c != "atm_id"]), F.struct(*_NEWEST))
    rows = feats.groupBy("atm_id").agg(
        newest.alias("_row"),
        F.array(*week_slots(as_of)).alias("weekly_txns"),
        F.array(*month_errors(as_of)).alias("monthly_inactive"),
    )
    return rows.select("atm_id", "_row.*", "weekly_txns", "monthly_inactive")


def predictions(feats: DataFrame, as_of) -> DataFrame:
    """One prediction record per machine: figures, the four formula heads and the history series."""
    return finish_record(newest_with_series(record_inputs(feats), as_of), as_of, formula_heads(feats.columns))


def finish_record(latest: DataFrame, as_of, heads: dict[str, Figure], carry: dict[str, str] | None = None) -> DataFrame:
    """Prediction records from the newest rows. ``carry`` keeps further columns under new names."""
    series = F.struct(
        "weekly_txns",
        F.array(*[F.lit(x) for x in week_labels(as_of)]).alias("weekly_labels"),
        "monthly_inactive",
        F.array(*[F.lit(MONTH_NAMES[m - 1]) for m in past_months(as_of)]).alias("monthly_labels"),
    )
    return with_rounded(
        latest,
        {**record_figures(latest.columns), **heads},
        "atm_id",
        steady_volume("weekly_txns").alias("transactions_24h_predicted"),
        series.alias("historical_series"),
        *[F.col(c).alias(n) for n, c in (carry or {}).items()],
    )


def with_defaults(rows: DataFrame, preds: DataFrame) -> DataFrame:
    """Rows with their machine's prediction; where there is none, the fixed default record."""
    joined = rows.join(preds, "atm_id", "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULT_PREDICTION.items() if c in preds.columns}
    return joined.withColumns(filled)


def overlay(preds: DataFrame, current: DataFrame) -> DataFrame:
    """Prediction records with the machine's own current fields written over equal-named ones.

    A machine absent from ``current`` keeps its prediction; a present one wins.
    """
    shared = [c for c in current.columns if c in preds.columns and c != "atm_id"]
    renamed = current.withColumnsRenamed({c: f"_now_{c}" for c in shared})
    joined = preds.join(renamed, "atm_id", "left")
    winners = {c: F.coalesce(F.col(f"_now_{c}"), F.col(c)) for c in shared}
    return joined.withColumns(winners).drop(*[f"_now_{c}" for c in shared])
