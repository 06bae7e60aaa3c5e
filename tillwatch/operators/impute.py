"""Filling gaps in uploaded metrics by repeated regression of each column on the others.

The regression needs only sums of products. Rows without gaps never change, so their sums
are taken once; each later step reads the gappy rows alone.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import clip, half_even
from tillwatch.operators.ordering import running_offsets
from tillwatch.session import Stored, store
from tillwatch.sources.ingest import coerce_dates, coerce_numbers

# Allowed range per imputed metric.
BOUNDS = {
    "uptime_percentage": (0.0, 100.0),
    "error_count": (0.0, 1000.0),
    "transaction_count": (0.0, 5000.0),
    "starting_cash_balance": (0.0, 10_000_000.0),
    "ending_cash_balance": (0.0, 10_000_000.0),
}
METRICS = list(BOUNDS)
WHOLE_METRICS = ["error_count", "transaction_count", "starting_cash_balance", "ending_cash_balance"]
PREDICTORS = ["_code", "_dow", *METRICS]
MAX_ROUNDS = 10
TOLERANCE = 1e-3


def impute_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0, subset=[m for m in METRICS if m in df.columns])


def domain_rules(df: DataFrame) -> DataFrame:
    """A day cannot end with more cash than it started with; counts and balances are whole."""
    df = df.withColumn("ending_cash_balance", F.least("ending_cash_balance", "starting_cash_balance"))
    return df.withColumns({c: half_even(c).cast("long") for c in WHOLE_METRICS})


def _prepare(df: DataFrame) -> DataFrame:
    """Typed metrics plus the two context columns: machine number in alphabetical order, weekday."""
    df = coerce_numbers(df, METRICS)
    df = df.withColumns({m: F.lit(None).cast("double") for m in METRICS if m not in df.columns})
    if "record_date" in df.columns:
        df = coerce_dates(df, ["record_date"])
        df = df.withColumn("_dow", F.coalesce(F.weekday("record_date"), F.lit(0)).cast("double"))
    else:
        df = df.withColumn("_dow", F.lit(0.0))
    if "atm_id" not in df.columns:
        return df.withColumn("_code", F.lit(0.0))
    df = df.withColumn("_machine", F.coalesce("atm_id", F.lit("UNKNOWN")))
    counts = df.groupBy("_machine").agg(F.count("*").alias("_rows"))
    ranks = running_offsets(counts, "_machine", "_rows").select("_machine", F.col("key_rank").cast("double").alias("_code"))
    return df.join(ranks, "_machine").drop("_machine")


class _Moments:
    """Count, sums and product sums of the shifted predictors (at most 36 numbers)."""

    def __init__(self, n: float, s: np.ndarray, p: np.ndarray):
        self.n, self.s, self.p = n, s, p

    def __add__(self, other: "_Moments") -> "_Moments":
        return _Moments(self.n + other.n, self.s + other.s, self.p + other.p)


def _moments(df: DataFrame, shift: dict[str, float]) -> _Moments:
    """One aggregate. Values are shifted by the column means first, which keeps the sums exact enough."""
    x = [F.col(c) - F.lit(shift[c]) for c in PREDICTORS]
    pairs = list(combinations_with_replacement(range(len(x)), 2))
    row = df.agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.sum(x[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(x))],
        *[F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)).alias(f"p{i}_{j}") for i, j in pairs],
    ).first()
    p = np.zeros((len(x), len(x)))
    for i, j in pairs:
        p[i, j] = p[j, i] = row[f"p{i}_{j}"]
    return _Moments(float(row["n"]), np.array([row[f"s{i}"] for i in range(len(x))]), p)


def bayesian_ridge(n: float, gram: np.ndarray, xy: np.ndarray, yy: float) -> np.ndarray:
    """Ridge weights with both precisions chosen by evidence maximisation, from centred sums."""
    tiny = 1e-6
    values, vectors = np.linalg.eigh(gram)
    values = np.clip(values, 0.0, None)
    noise, prior = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    projected = vectors.T @ xy
    weights = None
    for _ in range(300):
        new = vectors @ (projected / (values + prior / noise))
        residual = max(yy - 2 * new @ xy + new @ gram @ new, 0.0)
        used = float(np.sum(noise * values / (prior + noise * values)))
        prior = (used + 2 * tiny) / (new @ new + 2 * tiny)
        noise = (n - used + 2 * tiny) / (residual + 2 * tiny)
        if weights is not None and np.abs(weights - new).sum() < 1e-3:
            return vectors @ (projected / (values + prior / noise))
        weights = new
    return weights


def _predictor_expression(target: str, m: _Moments, shift: dict[str, float]):
    t = PREDICTORS.index(target)
    others = [i for i in range(len(PREDICTORS)) if i != t]
    mean = m.s / m.n
    centred = m.p - m.n * np.outer(mean, mean)
    w = bayesian_ridge(m.n, centred[np.ix_(others, others)], centred[others, t], float(centred[t, t]))
    value = F.lit(float(mean[t] + shift[target]))
    for weight, i in zip(w, others):
        name = PREDICTORS[i]
        value = value + F.lit(float(weight)) * (F.col(name) - F.lit(float(mean[i] + shift[name])))
    return clip(value, *BOUNDS[target])


def impute_metrics(df: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Fill the five metrics, then apply the domain rules.

    Each round visits the columns with gaps, fewest gaps first: regress on the rows where the
    column was observed, predict where it was not, clip to the column's range. Rounds end when
    no value moves by more than a thousandth of the largest observed one.

    Only rows with gaps are rewritten, into one version per round, and a version goes as soon as
    the next one is written. The complete rows and the last version stay for the result to read.
    """
    original = df.columns
    ready = store(_prepare(df), "impute-input")
    stats = ready.agg(
        F.count("*").alias("n"),
        *[F.count(m).alias(f"n_{m}") for m in METRICS],
        *[F.avg(c).alias(f"mean_{c}") for c in PREDICTORS],
        F.max(F.greatest(*[F.abs(c) for c in PREDICTORS])).alias("largest"),
    ).first()
    keep = [*original, *[m for m in METRICS if m not in original]]
    if stats["n"] == 0 or any(stats[f"n_{m}"] == 0 for m in METRICS):
        return domain_rules(impute_zero(ready).select(*keep))
    gaps = {m: stats["n"] - stats[f"n_{m}"] for m in METRICS}
    targets = sorted((m for m in METRICS if gaps[m] > 0), key=lambda m: gaps[m])
    if not targets:
        return domain_rules(ready.select(*keep))
    shift = {c: float(stats[f"mean_{c}"]) for c in PREDICTORS}

    whole = F.lit(True)
    for m in METRICS:
        whole = whole & F.col(m).isNotNull()
    complete = ready.filter(whole)
    fixed = _moments(complete, shift)
    gappy = ready.filter(~whole)
    gappy = gappy.withColumns({f"_seen_{m}": F.col(m).isNotNull() for m in METRICS})
    version = Stored(gappy.withColumns({m: F.coalesce(F.col(m), F.lit(shift[m])) for m in METRICS}), "impute-round")

    for _ in range(max_rounds):
        current = version.frame.withColumns({f"_old_{m}": F.col(m) for m in targets})
        for target in targets:
            seen = F.col(f"_seen_{target}")
            m = fixed + _moments(current.filter(seen), shift)
            filled = F.when(seen, F.col(target)).otherwise(_predictor_expression(target, m, shift))
            current = current.withColumn(target, filled)
        change = F.greatest(*[F.abs(F.col(m) - F.col(f"_old_{m}")) for m in targets], F.lit(0.0))
        last, version = version, Stored(current.withColumn("_moved", change).drop(*[f"_old_{m}" for m in targets]), "impute-round")
        last.drop()
        moved = version.frame.agg(F.max("_moved")).first()[0]
        version.frame = version.frame.drop("_moved")
        if moved < TOLERANCE * stats["largest"]:
            break
    return domain_rules(complete.select(*keep).unionByName(version.frame.select(*keep)))
