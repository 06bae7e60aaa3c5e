import numpy as np
import pytest
from frames import collect, day

from tillwatch.operators.impute import BOUNDS, METRICS, domain_rules, impute_metrics

NAMES = ["atm_id", "record_date", *METRICS]
SCHEMA = "atm_id string, record_date string, " + ", ".join(f"{m} double" for m in METRICS)


def messy(spark):
    return spark.createDataFrame(
        [
            ("ATM-001", "2026-04-01", 98.5, 2.0, 150.0, 1e6, 8e5),
            ("ATM-001", "2026-04-02", None, None, 160.0, 1e6, None),
            ("ATM-002", "2026-04-01", 90.0, 15.0, None, 5e5, 1e5),
            ("ATM-002", "2026-04-02", None, 20.0, 310.0, 5e5, None),
            ("ATM-003", "2026-04-01", 45.0, None, 10.0, 2e5, None),
        ],
        SCHEMA,
    )


def test_messy_frame_comes_out_clean(spark):
    got = impute_metrics(messy(spark))
    types = dict(got.dtypes)
    assert all(types[m] == "bigint" for m in METRICS if m != "uptime_percentage")
    assert got.columns == NAMES
    rows = collect(got, "atm_id", "record_date")
    assert len(rows) == 5
    for r in rows:
        assert all(r[m] is not None for m in METRICS)
        assert r["ending_cash_balance"] <= r["starting_cash_balance"]
        assert all(BOUNDS[m][0] <= r[m] <= BOUNDS[m][1] for m in METRICS)
    assert rows[0]["uptime_percentage"] == 98.5 and rows[0]["error_count"] == 2


def _ridge(x, y):
    """The published algorithm on the data matrix (singular values), for comparison with the sums-only form."""
    mean_x, mean_y = x.mean(0), y.mean()
    xc, yc = x - mean_x, y - mean_y
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        w = vt.T @ (s / (s**2 + lam / alpha) * (u.T @ yc))
        sse = ((yc - xc @ w) ** 2).sum()
        gamma = (alpha * s**2 / (lam + alpha * s**2)).sum()
        lam = (gamma + 2e-6) / ((w**2).sum() + 2e-6)
        alpha = (len(y) - gamma + 2e-6) / (sse + 2e-6)
        if old is not None and np.abs(old - w).sum() < 1e-3:
            break
        old = w
    w = vt.T @ (s / (s**2 + lam / alpha) * (u.T @ yc))
    return lambda z: (z - mean_x) @ w + mean_y


def _by_matrix(records):
    codes = {a: i for i, a in enumerate(sorted({r["atm_id"] for r in records}))}
    x = np.array([[codes[r["atm_id"]], day(r["record_date"]).weekday(), *[np.nan if r[m] is None else r[m] for m in METRICS]]
                  for r in records], dtype=float)
    gap = np.isnan(x)
    largest = np.nanmax(np.abs(x))
    x = np.where(gap, np.nanmean(x, 0), x)
    order = [c for c in np.argsort(gap.sum(0), kind="stable") if gap[:, c].any()]
    bounds = [(-np.inf, np.inf), (0, 6), *BOUNDS.values()]
    for _ in range(10):
        before = x.copy()
        for c in order:
            rest = [i for i in range(x.shape[1]) if i != c]
            f = _ridge(x[~gap[:, c]][:, rest], x[~gap[:, c], c])
            x[gap[:, c], c] = np.clip(f(x[gap[:, c]][:, rest]), *bounds[c])
        if np.abs(x - before).max() < 1e-3 * largest:
            break
    return x


def test_same_values_as_the_algorithm_on_the_whole_matrix(spark):
    rng = np.random.default_rng(3)
    records = []
    for i in range(300):
        load = rng.uniform(0, 1)
        r = {"atm_id": f"M{i % 7}", "record_date": f"2026-03-{i % 28 + 1:02d}", "uptime_percentage": 99 - 10 * load + rng.normal(0, 1),
             "error_count": 20 * load + rng.normal(0, 1) + 2, "transaction_count": 400 * load + rng.normal(0, 9) + 50,
             "starting_cash_balance": 9e5 + rng.normal(0, 1e5), "ending_cash_balance": 8e5 - 3e5 * load + rng.normal(0, 1e4)}
        for m in METRICS:
            if m != "starting_cash_balance" and rng.uniform() < 0.12:
                r[m] = None
        records.append({k: (float(v) if isinstance(v, np.floating) else v) for k, v in r.items()})
    df = spark.createDataFrame([(i, *[r[n] for n in NAMES]) for i, r in enumerate(records)], "id int, " + SCHEMA)
    got = collect(impute_metrics(df), "id")
    want = _by_matrix(records)
    up = np.array([r["uptime_percentage"] for r in got])
    assert np.abs(up - want[:, 2]).max() < 0.05
    tx = np.array([r["transaction_count"] for r in got])
    assert np.abs(tx - want[:, 4]).max() <= 1.5
    end = np.array([r["ending_cash_balance"] for r in got])
    assert np.abs(end - np.minimum(want[:, 6], want[:, 5])).max() / 8e5 < 2e-3


def test_a_wholly_missing_metric_falls_back_to_zero(spark):
    bad = messy(spark).selectExpr(*["'bad' AS error_count" if n == "error_count" else n for n in NAMES])
    got = collect(impute_metrics(bad), "atm_id", "record_date")
    assert [r["error_count"] for r in got] == [0] * 5 and got[1]["uptime_percentage"] == 0


def test_nothing_missing_changes_nothing(spark):
    full = messy(spark).fillna(1.0)
    got = collect(impute_metrics(full), "atm_id", "record_date")
    assert [r["transaction_count"] for r in got] == [150, 160, 1, 310, 10]


def test_rules_round_half_to_even(spark):
    df = spark.createDataFrame([(1.0, 2.5, 3.5, 10.5, None), (1.0, 0.4, 0.6, 11.5, 20.0)], ", ".join(f"{m} double" for m in METRICS))
    assert [tuple(r) for r in domain_rules(df).collect()] == [(1.0, 2, 4, 10, 10), (1.0, 0, 1, 12, 12)]
