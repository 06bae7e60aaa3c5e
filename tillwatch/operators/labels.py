"""Training labels and validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import clip, stable_normal, stable_uniform
from tillwatch.operators.ordering import row_positions

# Noise of the synthetic labels.
HEALTH_NOISE = 2.5
CASH_NOISE = 0.5
FLIP_RATE = 0.02


def pseudo_labels(feats: DataFrame) -> DataFrame:
    """Labels from the formulas: health score, failure flag, days until the cash is used up."""
    per_day = clip("cash_consumption_rate", 1.0) * 24
    return feats.withColumns(
        {
            "y_health": clip("composite_health_score", 0.0, 100.0),
            "y_failure": (F.col("failure_risk_score") > 0.5).cast("int"),
            "y_cash": clip(F.col("ending_cash_balance") / per_day, 0.0, 60.0),
        }
    )


def noisy_labels(
    labelled: DataFrame,
    seed: int = 42,
    health_sigma: float = HEALTH_NOISE,
    cash_sigma: float = CASH_NOISE,
    flip_rate: float = FLIP_RATE,
) -> DataFrame:
    """Gaussian noise on the two numbers and a few flipped classes. The draws hang on the row's
    key, so a re-run or a retried task gives the same labels."""
    key = ("atm_id", "record_date")
    flip = stable_uniform(seed + 20, *key) < flip_rate
    return labelled.withColumns(
        {
            "y_health": clip(F.col("y_health") + health_sigma * stable_normal(seed, *key), 0.0, 100.0),
            "y_cash": clip(F.col("y_cash") + cash_sigma * stable_normal(seed + 10, *key), 0.0, 60.0),
            "y_failure": F.when(flip, 1 - F.col("y_failure")).otherwise(F.col("y_failure")),
        }
    )


def join_labels(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Measured labels: rows without one drop out."""
    named = labels.select(
        "atm_id",
        "record_date",
        F.col("actual_health_score").alias("y_health"),
        F.col("actual_failed_next_7_days").cast("int").alias("y_failure"),
        F.col("actual_days_to_depletion").alias("y_cash"),
    )
    return feats.join(named, ["atm_id", "record_date"], "inner")


def fold_count(rows: int) -> int:
    return min(5, max(2, rows // 10))


def expanding_folds(rows: DataFrame) -> DataFrame:
    """Fold number per row: 0 is never tested, block i is tested by a fit on all rows before it.

    Rows are ordered by machine and day, so blocks cut the fleet rather than the calendar. The
    table's size comes along with the positions; it needs no count of its own.
    """
    n, index = F.col("row_count"), F.col("row_index")
    k = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 10)))
    size = F.floor(n / (k + 1))
    first = n - k * size
    block = F.floor(F.try_divide(index - first, size)) + 1
    fold = F.when((index < first) | (size == 0), 0).otherwise(block).cast("int")
    return row_positions(rows).withColumn("fold", fold).drop("row_count")
