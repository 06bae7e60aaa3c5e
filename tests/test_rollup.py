import datetime as dt
import random
from collections import defaultdict

import pytest
from frames import collect, day

from tillwatch.operators import rollup
from tillwatch.schemas import CASH_STATUS, MAINTENANCE_RECORDS, OPERATIONAL_LOGS, TRANSACTIONS


def at(text):
    return dt.datetime.fromisoformat(text)


def raw(spark):
    tx = spark.createDataFrame(
        [
            (1, "A", at("2026-01-02 09:00"), 100.0, "Withdrawal", 1),
            (2, "A", at("2026-01-02 10:00"), 50.0, "W", 0),
            (3, "A", at("2026-01-02 11:00"), 70.0, "deposit", 1),
            (4, "A", at("2026-01-02 12:00"), 9.0, "transfer", 1),
            (5, "A", at("2026-01-03 12:00"), 9.0, "transfer", 1),
            (6, "B", at("2026-01-02 12:00"), 30.0, "D", 1),
            (7, None, at("2026-01-02 12:00"), 30.0, "w", 1),
            (8, "C", at("2026-01-02 12:00"), 30.0, None, 1),
            (9, "Z", at("2026-01-02 12:00"), 30.0, "w", 1),
        ],
        TRANSACTIONS,
    )
    cash = spark.createDataFrame(
        [(1, "A", day("2026-01-01"), 500.0), (2, "A", day("2026-01-02"), 400.0), (3, "A", day("2026-01-03"), 900.0),
         (4, "B", day("2026-01-02"), 10.0)],
        CASH_STATUS,
    )
    logs = spark.createDataFrame(
        [(1, "A", at("2026-01-02 01:00"), 0, "E1", 2000), (2, "A", at("2026-01-02 02:00"), 1, None, 5),
         (3, "B", at("2026-01-02 02:00"), None, None, None)],
        OPERATIONAL_LOGS,
    )
    maint = spark.createDataFrame(
        [(1, "A", at("2026-01-05 10:00"), "Preventive", 1.0), (2, "A", at("2026-01-01 10:00"), "Corrective", 1.0)],
        MAINTENANCE_RECORDS,
    )
    return cash, tx, logs, maint


def test_daily_metrics(spark):
    got = collect(rollup.daily_metrics(*raw(spark)), "atm_id", "record_date")
    assert [(r["atm_id"], r["record_date"].day) for r in got] == [("A", 1), ("A", 2), ("A", 3), ("B", 2)]
    first, second, third, b = got
    assert (first["starting_cash_balance"], second["starting_cash_balance"], third["starting_cash_balance"]) == (500, 500, 400)
    assert (second["transaction_count"], second["daily_withdrawal_amount"], second["avg_transaction_amount"]) == (2, 150, 75)
    assert (second["daily_deposit_count"], second["daily_deposit_amount"]) == (1, 70)
    assert (second["error_count"], second["downtime_duration"], second["uptime_minutes"]) == (1, 2005, 0)
    assert (third["transaction_count"], third["uptime_percentage"]) == (0, 100)
    assert (b["transaction_count"], b["daily_deposit_amount"], b["error_count"], b["downtime_duration"]) == (0, 30, 0, 0)
    # The latest service overall, also on days before it.
    assert first["service_date"] == day("2026-01-05") and b["service_date"] is None


def test_day_range_keeps_the_balance_before_it(spark):
    for anchor in (None, "2026-01-03"):
        got = collect(rollup.daily_metrics(*raw(spark), days=0, anchor=anchor), "atm_id")
        assert [(r["atm_id"], r["record_date"].day, r["starting_cash_balance"]) for r in got] == [("A", 3, 400)]


def test_repeated_readings(spark):
    cash = spark.createDataFrame(
        [(1, "A", day("2026-01-01"), 5.0), (3, "A", day("2026-01-01"), 7.0), (2, "A", day("2026-01-01"), 9.0),
         (4, "A", day("2026-01-02"), 1.0)],
        CASH_STATUS,
    )
    got = collect(rollup.cash_balances(cash), "record_date")
    assert [(r["starting_cash_balance"], r["ending_cash_balance"]) for r in got] == [(7, 7), (7, 1)]
    every = collect(rollup.cash_balances(cash, keep_all_readings=True), "record_date", "ending_cash_balance")
    assert [(r["starting_cash_balance"], r["ending_cash_balance"]) for r in every] == [(5, 5), (9, 7), (5, 9), (7, 1)]


def test_plain_transactions_count_failed_ones(spark):
    cash, tx, logs, _ = raw(spark)
    plain = tx.drop("transaction_type").withColumnRenamed("amount", "withdrawal_amount")
    got = {(r["atm_id"], r["record_date"].day): r["transaction_count"] for r in collect(rollup.transactions_daily(plain))}
    assert got[("A", 2)] == 4 and (None, 2) not in got


def test_two_forms_of_the_typed_rollup_agree(spark):
    _, tx, _, _ = raw(spark)
    names = rollup.transactions_by_type(tx).columns
    a = collect(rollup.transactions_by_type(tx).select(names), "atm_id", "record_date")
    b = collect(rollup.transactions_by_type_joined(tx).select(names), "atm_id", "record_date")
    assert a == b


def test_a_third_of_all_rows_on_one_machine(spark):
    rng = random.Random(5)
    data = []
    for i in range(6000):
        machine = "HOT" if i % 3 == 0 else f"M{rng.randrange(200)}"
        data.append((i, machine, at("2026-01-01") + dt.timedelta(minutes=rng.randrange(14400)), float(rng.randrange(100)),
                     rng.choice(["w", "d"]), 1))
    got = collect(rollup.transactions_by_type(spark.createDataFrame(data, TRANSACTIONS)))
    want = defaultdict(lambda: [0, 0.0, 0, 0.0])
    for _, m, t, a, k, _ in data:
        w = want[(m, t.date())]
        w[0 if k == "w" else 2] += 1
        w[1 if k == "w" else 3] += a
    assert len(got) == len(want)
    for r in got:
        n, s, dn, ds = want[(r["atm_id"], r["record_date"])]
        assert (r["transaction_count"], r["daily_withdrawal_amount"]) == (n, s)
        assert (r["daily_deposit_count"], r["daily_deposit_amount"]) == (dn, ds)


def test_literal_anchor_reaches_the_scan(spark):
    from tillwatch.sources import tables as t

    log = t.event_log(spark, "/root/testdata/sf0.001")
    days = rollup.daily_metrics(
        t.cash_status(log), t.transactions(log), t.operational_logs(log), days=5, anchor="2024-01-30"
    )
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(ts,2024-01-25") == 2  # transactions and logs; not balances


def test_snapshot_forms_differ(spark):
    cash, tx, logs, maint = raw(spark)
    old = cash.unionByName(spark.createDataFrame([(9, "OLD", day("2025-10-01"), 3.0)], CASH_STATUS))
    daily = rollup.daily_metrics(old, tx, logs, maint)
    master = spark.createDataFrame([("A", "x"), ("OLD", "y")], "atm_id string, location string")
    assert {r["atm_id"] for r in collect(rollup.fleet_snapshot(daily, master))} == {"A", "B"}
    assert {r["atm_id"] for r in collect(rollup.fleet_snapshot_sql(daily, master))} == {"A", "OLD"}


@pytest.mark.parametrize("days, expected", [(0, 1), (1, 3)])
def test_last_n_days_includes_both_ends(spark, days, expected):
    daily = rollup.daily_metrics(*raw(spark))
    assert rollup.last_n_days(daily, days).count() == expected
    assert rollup.since_as_of(daily, days, "2026-01-03").count() == expected
