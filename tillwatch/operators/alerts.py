"""Alert rules, the alert feed and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule codes in the order they are reported, with the field each one looks at
# and its open lower and closed upper bound.
RANGE_RULES = [
    ("CASH_CRITICAL", "cash_stress_indicator", 0.70, None),
    ("CASH_LOW", "cash_stress_indicator", 0.50, 0.70),
    ("DEPOSIT_BIN_CRITICAL", "deposit_bin_utilization", 0.90, None),
    ("ERROR_SPIKE", "error_acceleration", 0.50, None),
    ("MAINTENANCE_DUE", "days_since_maintenance", 30, 60),
    ("MAINTENANCE_OVERDUE", "days_since_maintenance", 60, None),
    ("OUT_OF_SERVICE", "operational_status", None, None),
    ("CRITICAL_ERROR", "failure_probability", 0.70, None),
]
# Severities and the code fragments that raise them.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
CRITICAL_PARTS = ("CRITICAL", "OUT_OF_SERVICE")
HIGH_PARTS = ("LOW_CASH", "HIGH_RISK")


def default_rules(columns: list[str]) -> list[tuple[str, Column]]:
    """(code, condition) pairs; a field that is absent or null counts as zero."""
    rules = []
    for code, field, above, up_to in RANGE_RULES:
        if field not in columns:
            continue
        if above is None:
            rules.append((code, F.coalesce(F.col(field), F.lit("")) == "out_of_service"))
            continue
        value = F.coalesce(F.col(field), F.lit(0))
        hit = value > above
        rules.append((code, hit if up_to is None else hit & (value <= up_to)))
    return rules


def alert_codes(records: DataFrame, rules: list[tuple[str, Column]] | None = None) -> Column:
    """All codes that apply to a row, in rule order. Pass other rules to extend the list."""
    rules = default_rules(records.columns) if rules is None else rules
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(hit, F.lit(code)) for code, hit in rules]))


def with_alerts(records: DataFrame, rules: list[tuple[str, Column]] | None = None) -> DataFrame:
    return records.withColumn("alerts", alert_codes(records, rules))


def severity(code: Column, critical=CRITICAL_PARTS, high=HIGH_PARTS) -> Column:
    def any_of(parts) -> Column:
        hit = F.lit(False)
        for part in parts:
            hit = hit | code.contains(part)
        return hit

    return F.when(any_of(critical), "CRITICAL").when(any_of(high), "HIGH").otherwise("MEDIUM")


def alert_feed(fleet: DataFrame, **parts) -> DataFrame:
    """One row per machine and alert code, with its severity."""
    feed = fleet.select("atm_id", "health_score", F.posexplode("alerts").alias("alert_order", "code"))
    return feed.withColumn("severity", severity(F.col("code"), **parts))


def alert_counts(feed: DataFrame) -> DataFrame:
    """Alerts per severity, zero counts included. A one-row aggregate unpivoted to four rows."""
    counts = feed.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.unpivot([], SEVERITIES, "severity", "alerts")


def top_alerts(feed: DataFrame, n: int = 5) -> DataFrame:
    """First alerts of the feed in its order: worst machine first, then rule order."""
    return feed.orderBy("health_score", "atm_id", "alert_order").limit(n)
