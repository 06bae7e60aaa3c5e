"""Fleet views: KPIs, health table, bands, maintenance queue, finder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import half_even, half_up
from tillwatch.operators.alerts import alert_codes
from tillwatch.operators.geo import DEFAULT_RADIUS_KM, near_point
from tillwatch.operators.scoring import DEFAULT_AVG_AMOUNT, DEFAULT_DAILY_WITHDRAWAL, with_defaults
from tillwatch.schemas import ATM_METADATA

MASTER_COLUMNS = [c for c in ATM_METADATA.names if c != "atm_id"]

# Display bands as (lowest value, label), best first.
HEALTH_BANDS = [(80, "Healthy"), (55, "Fair")]
CASH_BANDS = [(50, "good"), (30, "warn")]
UPTIME_BANDS = [(95, "good"), (88, "warn")]
ERROR_BANDS = [(8, "bad"), (4, "warn")]
FAILURE_BANDS = [(0.5, "bad"), (0.2, "warn")]
# Thresholds of the maintenance queue and the finder.
LOW_CASH_LEVEL = 30
QUEUE_HEALTH, QUEUE_CASH, QUEUE_CRITICAL, QUEUE_TODAY = 80, 35, 55, 3
PEAK_HOURS = [(10, 12), (15, 17)]


# The day's own figures a fleet row shows next to the prediction, by their names in such a row.
DAY_FIGURES = {
    "day_uptime": "uptime_percentage",
    "day_errors": "error_count",
    "day_transactions": "transaction_count",
    "day": "record_date",
}
_RECORD_NAMES = {"operational_status": "record_status", "record_date": "record_day"}


def fleet_rows(snapshot: DataFrame, preds: DataFrame) -> DataFrame:
    """Snapshot rows (newest day and master columns) with their machine's prediction or the defaults."""
    days = snapshot.select(
        "atm_id",
        *[F.col(c).alias(n) for n, c in DAY_FIGURES.items()],
        *[c for c in MASTER_COLUMNS if c in snapshot.columns],
    )
    return with_defaults(days, preds.withColumnsRenamed(_RECORD_NAMES))


def fleet_rows_of(records: DataFrame, master: DataFrame) -> DataFrame:
    """The same from records that carry their day's figures: one join, no second roll-up."""
    columns = [c for c in ("atm_id", *MASTER_COLUMNS) if c in master.columns]
    return records.withColumnsRenamed(_RECORD_NAMES).join(master.select(*columns), "atm_id", "left")


def fleet_kpis(rows: DataFrame, in_snapshot: Column | None = None) -> DataFrame:
    """Fleet figures in one row. ``in_snapshot`` tells which rows count as machines of the
    snapshot; health and risk figures cover all rows. Everything is zero for an empty snapshot."""
    member = F.lit(True) if in_snapshot is None else in_snapshot
    active = member & (F.col("operational_status") == "in_service") if "operational_status" in rows.columns else member
    figures = rows.agg(
        F.count_if(member).alias("total_atms"),
        F.count_if(active).alias("active_atms"),
        half_even(F.avg("health_score"), 1).alias("fleet_health_pct"),
        F.count_if(F.col("cash_stress_indicator") > 0.70).alias("low_cash_alerts"),
        F.count_if(F.col("failure_probability") > 0.50).alias("high_risk_atms"),
    )
    shown = ["fleet_health_pct", "low_cash_alerts", "high_risk_atms"]
    return figures.select(
        *[F.when(F.col("total_atms") > 0, F.col(c)).otherwise(0).alias(c) for c in shown],
        "active_atms",
        "total_atms",
        (F.col("total_atms") - F.col("active_atms")).alias("offline_count"),
    )


def exact_cash_level() -> Column:
    return (1 - F.coalesce("cash_stress_indicator", F.lit(0.3))) * 100


def cash_level(digits: int) -> Column:
    return half_even(exact_cash_level(), digits)


def fleet_table(rows: DataFrame, status_from_master: bool = True) -> DataFrame:
    """Every machine of the snapshot with prediction, cash level and alerts (unordered).

    ``status_from_master`` lets the master's status into the alert rules. Without it the rules see
    the status of the prediction record only.
    """
    status = F.coalesce("operational_status", F.lit("in_service"))
    if not status_from_master:
        rows = rows.withColumn("_status", status).withColumn("operational_status", F.col("record_status"))
        status = F.col("_status")
    rows = rows.withColumn("_level", exact_cash_level())  # rounded from a plain column
    return rows.select(
        "atm_id",
        F.col("atm_bank").alias("bank_name"),
        "location",
        F.col("atm_bank").alias("manufacturer"),
        F.col("atm_model").alias("model"),
        status.alias("status"),
        "health_score",
        "failure_probability",
        "days_to_depletion",
        "activity_level",
        F.coalesce("day_uptime", F.lit(95.0)).alias("uptime"),
        F.coalesce("day_errors", F.lit(0)).cast("long").alias("error_count"),
        F.coalesce("transactions_24h_predicted", "day_transactions", F.lit(0)).cast("long").alias("transactions_24h"),
        F.coalesce("avg_amount", F.lit(DEFAULT_AVG_AMOUNT)).alias("avg_amount"),
        F.coalesce("avg_daily_withdrawal", F.lit(DEFAULT_DAILY_WITHDRAWAL)).alias("avg_daily_withdrawal"),
        half_even("_level", 1).alias("cash_level"),
        F.coalesce("deposit_bin_utilization", F.lit(0.0)).alias("deposit_bin_utilization"),
        "error_acceleration",
        alert_codes(rows).alias("alerts"),
        "historical_series",
    )


def _ranked(fleet: DataFrame, *order: str) -> DataFrame:
    """A global sort first samples its input to find the range bounds. Shuffling the one row per
    machine before it lets the sample read those rows instead of computing all windows a second
    time. (By a hash, since a shuffle by machine alone is already there.)"""
    return fleet.repartition(F.xxhash64("atm_id")).orderBy(*order)


def worst_first(fleet: DataFrame) -> DataFrame:
    return _ranked(fleet, "health_score", "atm_id")


def dashboard_kpis(fleet: DataFrame) -> DataFrame:
    return fleet.agg(
        F.count("*").alias("machines"),
        F.count_if(half_up("health_score", 2) < 55).alias("critical_count"),
        F.count_if(F.size("alerts") > 0).alias("alert_machines"),
        F.coalesce(F.sum(F.size("alerts")), F.lit(0)).cast("long").alias("alert_total"),
        half_up(F.avg(half_up("health_score", 2)), 2).alias("avg_health"),
        F.coalesce(F.sum("transactions_24h"), F.lit(0)).alias("total_transactions"),
        F.count_if(F.col("status") != "in_service").alias("offline_count"),
        F.count_if(F.col("cash_level") < LOW_CASH_LEVEL).alias("cash_alerts"),
    )


def band(value: Column, bands: list[tuple[float, str]], otherwise: str, inclusive: bool) -> Column:
    """Label of the first band whose bound the value reaches (or passes)."""
    label = F
    for bound, name in bands:
        hit = value >= bound if inclusive else value > bound
        label = label.when(hit, name)
    return label.otherwise(otherwise)


def derived_rates(fleet: DataFrame) -> DataFrame:
    """Display figures: error rate over a week, hourly velocity, two-decimal roundings."""
    return fleet.withColumns(
        {
            "error_rate": half_up(F.col("error_count") / 7, 2),
            "hourly_velocity": F.floor(F.col("transactions_24h") / 24 + 0.5),
            "health_2dp": half_up("health_score", 2),
            "uptime_2dp": half_up("uptime", 2),
            "cash_level_2dp": half_up("cash_level", 2),
            "cash_stress_2dp": half_up(1 - F.col("cash_level") / 100, 2),
            "failure_2dp": half_up("failure_probability", 2),
            "acceleration_2dp": half_up("error_acceleration", 2),
            "depletion_days": F.floor(F.col("days_to_depletion") + 0.5),
        }
    )


def bands(fleet: DataFrame) -> DataFrame:
    shown = derived_rates(fleet)
    return shown.withColumns(
        {
            "health_band": band(F.col("health_2dp"), HEALTH_BANDS, "Critical", True),
            "cash_band": band(F.col("cash_level_2dp"), CASH_BANDS, "bad", True),
            "uptime_band": band(F.col("uptime_2dp"), UPTIME_BANDS, "bad", False),
            "error_band": band(F.col("error_rate"), ERROR_BANDS, "good", False),
            "failure_band": band(F.col("failure_2dp"), FAILURE_BANDS, "good", False),
        }
    )


def fleet_filter(fleet: DataFrame, which: str) -> DataFrame:
    """Machines of a health class (all, critical, warning, healthy) or of a status."""
    health = half_up("health_score", 2)
    conditions = {
        "all": F.lit(True),
        "critical": health < 55,
        "warning": (health >= 55) & (health < 80),
        "healthy": health >= 80,
    }
    return fleet.filter(conditions.get(which, F.col("status") == which))


def _plain_number(c: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def maintenance_queue(fleet: DataFrame) -> DataFrame:
    health, cash = half_up("health_score", 2), half_up("cash_level", 2)
    queue = fleet.filter((health < QUEUE_HEALTH) | (cash < QUEUE_CASH))
    return queue.select(
        "atm_id",
        F.when(health < QUEUE_CRITICAL, "CRITICAL").otherwise("HIGH").alias("priority"),
        # Fixed value: wording of the queue entry.
        F.format_string(
            "Automated ML flag. Cash: %s%%, Health: %s%%.", _plain_number(cash), _plain_number(health)
        ).alias("issue"),
        F.when(F.floor(F.col("days_to_depletion") + 0.5) < QUEUE_TODAY, "Today").otherwise("Tomorrow").alias("eta"),
    )


def depletion_ranking(fleet: DataFrame) -> DataFrame:
    """Soonest empty first, by whole days; equal ones stay in health order."""
    days = F.floor(F.col("days_to_depletion") + 0.5).alias("depletion_days")
    ranked = fleet.select("atm_id", days, "days_to_depletion", "cash_level", "health_score")
    return _ranked(ranked, "depletion_days", "health_score", "atm_id")


def service_filter(machines: DataFrame, service: str) -> DataFrame:
    """Machines whose service list matches the pattern (a regular expression); null never does."""
    return machines.filter(F.coalesce(F.col("services").rlike(service), F.lit(False)))


def finder(
    rows: DataFrame,
    *,
    service: str | None = None,
    lat: float | None = None,
    lng: float | None = None,
    radius_km: float = DEFAULT_RADIUS_KM,
) -> DataFrame:
    """Machines offering a service near a point, with what a customer needs to know."""
    if service:
        rows = service_filter(rows, service)
    located = lat is not None and lng is not None
    if located:
        rows = near_point(rows, lat, lng, radius_km)
    level = cash_level(0)
    return rows.select(
        F.trim("atm_id").alias("atm_id"),
        F.trim("location").alias("name"),
        F.trim("atm_bank").alias("short"),
        F.trim("location").alias("building"),
        F.coalesce("operational_status", F.lit("in_service")).alias("status"),
        F.col("health_score").alias("health"),
        "activity_level",
        F.when(level < 0, 0.0).otherwise(level).alias("cash_level"),
        F.coalesce("deposit_bin_utilization", F.lit(0.0)).alias("deposit_bin_utilization"),
        "days_to_depletion",
        F.coalesce("transactions_24h_predicted", "day_transactions", F.lit(0)).cast("long").alias("transactions_24h"),
        "services",
        "card_types",
        "historical_series",
        "lat",
        "lng",
        (half_even("distance_km", 2) if located else F.lit(None).cast("double")).alias("distance_km"),
    )


def text_search(found: DataFrame, text: str, show_unavailable: bool = False) -> DataFrame:
    wanted = text.lower()
    hit = F.lower("name").contains(wanted) | F.lower("building").contains(wanted)
    if not show_unavailable:
        hit = hit & (F.col("status") == "in_service")
    return found.filter(hit)


def split_list(column: str) -> Column:
    """A comma-separated text as a list of trimmed items."""
    return F.transform(F.split(column, ","), lambda x: F.trim(x))


def services_view(machines: DataFrame, service: str = "Deposits", shown: int = 3) -> DataFrame:
    items = machines.withColumn("service_list", split_list("services"))
    return items.withColumns(
        {
            "has_service": F.array_contains("service_list", service),
            "first_services": F.slice("service_list", 1, shown),
            "more_services": F.greatest(F.size("service_list") - shown, F.lit(0)),
        }
    )


def wait_class(tx: Column) -> dict[str, Column]:
    """Activity level, wait text and description of a daily transaction count."""
    steps = lambda high, moderate, low, none: (
        F.when(tx > 220, high).when(tx > 100, moderate).when(tx > 0, low).otherwise(none)
    )
    # Display texts.
    return {
        "level": steps("High", "Moderate", "Low", "—"),
        "wait": steps("5–10 min wait", "2–5 min wait", "No wait", "Unavailable"),
        "description": steps(
            "Expect queues", "Some wait expected", "Usually available immediately", "Machine offline"
        ),
    }


def is_peak(hour: Column) -> Column:
    hit = F.lit(False)
    for first, last in PEAK_HOURS:
        hit = hit | hour.between(first, last)
    return hit


def peak_share(tx: DataFrame) -> DataFrame:
    """Transactions of a machine inside and outside the peak hours."""
    peak = is_peak(F.hour("transaction_time"))
    return tx.groupBy("atm_id").agg(
        F.count_if(peak).alias("peak_transactions"), F.count_if(~peak).alias("other_transactions")
    )


def normalised(series: str) -> dict[str, Column]:
    """A series relative to its own maximum (at least 1), and as bar heights in percent."""
    top = F.greatest(F.array_max(series), F.lit(1).cast("long"))
    share = F.transform(series, lambda v: v / top)
    return {
        "share": share,
        "bar_pct": F.transform(series, lambda v: F.greatest(v / top * 100, F.when(v > 0, 4.0).otherwise(0.0))),
    }


def low_cash_badge() -> Column:
    return (F.col("status") == "in_service") & (F.col("cash_level") < LOW_CASH_LEVEL)


def finder_counts(found: DataFrame) -> DataFrame:
    """How many machines of a result are available, and how many of those run low on cash."""
    return found.agg(
        F.count("*").alias("machines"),
        F.count_if(F.col("status") == "in_service").alias("available"),
        F.count_if(low_cash_badge()).alias("low_cash"),
    )
