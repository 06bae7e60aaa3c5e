"""Windows over ranges, and features from stored states, against the plain windows."""

import datetime as dt
import random

import pytest
from frames import collect, day, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillwatch.operators.carry import FeatureHistory, features_in_segments
from tillwatch.operators.features import features
from tillwatch.operators.segments import cut, previous_value, with_halo
from tillwatch.session import work_path

KEY = ("atm_id", "record_date", "ending_cash_balance")


def history(spark, machines):
    """Machines with a given number of rows each; missing values, refills, services and gaps between days."""
    rng = random.Random(12)
    out = []
    for name, n in machines.items():
        date, service = day("2025-12-01"), None
        for i in range(n):
            date += dt.timedelta(days=rng.choice([1, 1, 1, 2, 9]))
            start = rng.uniform(1e5, 1e6)
            service = date if rng.random() < 0.02 else service
            out.append({
                "atm_id": name, "record_date": date, "uptime_percentage": rng.choice([None, 99.0, 80.0, rng.uniform(50, 100)]) if n > 2 else 90.0,
                "error_count": rng.choice([0, 0, 1, 2, None]), "transaction_count": rng.choice([0, 5, 300, None]),
                "starting_cash_balance": start, "ending_cash_balance": start - rng.uniform(-1e4, 3e5),
                "daily_withdrawal_amount": rng.uniform(0, 1e5), "avg_transaction_amount": rng.uniform(1, 100),
                "daily_deposit_count": rng.randint(0, 9), "daily_deposit_amount": float(rng.randint(0, 90_000)),
                "service_date": service if rng.random() < 0.1 else None,
            })
    return rows(spark, out)


def same(got, want):
    assert len(got) == len(want) and got[0].keys() == want[0].keys()
    for g, w in zip(got, want):
        for k in w:
            assert g[k] == (pytest.approx(w[k], rel=1e-9, abs=1e-7) if isinstance(w[k], float) else w[k]), (k, g["atm_id"], g["record_date"])


def shown(df, names):
    return collect(df.select(*names), *KEY)


@pytest.fixture(scope="module")
def long_and_short(spark):
    return history(spark, {"HOT": 700, **{f"M{i}": 1 + i * 3 for i in range(20)}})


def test_ranges_give_the_features_of_whole_windows(spark, long_and_short):
    """Also with ranges shorter than the halo, which then comes from several of them."""
    want = features(long_and_short)
    names = sorted(want.columns)
    expected = shown(want, names)
    for segments in (7, 60):
        got = features_in_segments(long_and_short, segments=segments)
        assert sorted(got.columns) == names
        same(shown(got, names), expected)


def test_a_hot_machine_is_spread(spark, long_and_short):
    """One machine holds half of all rows; the largest group of any window stays near a range's share."""
    total, segments = long_and_short.count(), 20
    near = with_halo(cut(long_and_short, ["record_date", "ending_cash_balance"], segments), 29)
    sizes = near.groupBy("atm_id", "_segment").agg(F.count_if("_halo").alias("halo"), F.count("*").alias("n")).collect()
    assert max(r["n"] for r in sizes) < 29 + 4 * total / segments
    assert max(r["halo"] for r in sizes) == 29
    assert sum(r["n"] - r["halo"] for r in sizes) == total


def test_previous_value_equals_lag(spark, long_and_short):
    w = Window.partitionBy("atm_id").orderBy("record_date", "ending_cash_balance")
    want = long_and_short.withColumn("_previous", F.lag("ending_cash_balance").over(w))
    got = previous_value(long_and_short, "ending_cash_balance", ["record_date", "ending_cash_balance"], 40)
    names = sorted(want.columns)
    assert shown(got, names) == shown(want, names)
    assert previous_value(long_and_short.limit(0), "ending_cash_balance", ["record_date"]).count() == 0


def test_days_added_one_after_the_other(spark):
    base = history(spark, {"A": 45, "B": 31, "C": 2, "D": 12})
    want = features(base)
    names = sorted(want.columns)
    store = FeatureHistory(spark, work_path(spark, "history-test"), base.schema, buckets=2)
    dates = sorted({r[0] for r in base.select("record_date").collect()})
    cuts = [dates[0], dates[20], dates[21], dates[22], dates[40], dt.date(2030, 1, 1)]
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = base.filter((F.col("record_date") >= low) & (F.col("record_date") < high))
        store.add(part, batch)
        store.add(part, batch)  # a repeated batch changes nothing
    same(shown(store.read(), names), shown(want, names))
    with pytest.raises(ValueError, match="not later"):
        store.add(base.filter(F.col("record_date") == dates[5]), 99)


def test_a_batch_broken_off_between_the_tables_is_finished(spark, monkeypatch):
    base = history(spark, {"A": 40, "B": 3})
    names = sorted(features(base).columns)
    store = FeatureHistory(spark, work_path(spark, "history-broken"), base.schema, buckets=2)
    middle = F.col("record_date") < sorted(r[0] for r in base.filter("atm_id = 'A'").select("record_date").collect())[25]
    store.add(base.filter(middle), 0)

    def broken(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.states, "replace", broken)
        with pytest.raises(OSError):
            store.add(base.filter(~middle), 1)
    store.add(base.filter(~middle), 1)
    same(shown(store.read(), names), shown(features(base), names))
