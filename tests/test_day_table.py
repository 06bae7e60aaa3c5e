"""Stored day tables: versions, failed writes, repeated batches, late rows."""

import pytest
from frames import collect, day, rows
from pyspark.sql import functions as F

from tillwatch.operators.rollup import days_from_partials, transactions_by_type
from tillwatch.session import work_path
from tillwatch.sources.day_table import DayTable
from tillwatch.sources.ingest import upsert_daily, write_upsert
from tillwatch.streaming import ingest as stream

METRICS = ["uptime_percentage", "error_count", "transaction_count", "starting_cash_balance", "ending_cash_balance"]


def days(spark, *entries):
    return rows(spark, [dict(zip(["atm_id", "record_date", *METRICS], (m, day(d), 90.0, 0, n, 5.0, 4.0))) for m, d, n in entries])


@pytest.fixture()
def table(spark):
    base = days(spark, ("A", "2026-01-01", 1), ("B", "2026-01-01", 2), ("A", "2026-01-02", 3), ("A", "2026-01-03", 4))
    made = DayTable(spark, work_path(spark, "day-table-test"), base.schema)
    made.replace(base, made.keys_of(base))
    return made


def counts(table):
    return {(r["atm_id"], str(r["record_date"])): r["transaction_count"] for r in table.read().collect()}


def test_upsert_reads_and_writes_only_touched_days(spark, table):
    before = table.manifest()
    update = days(spark, ("A", "2026-01-02", 30), ("C", "2026-01-04", 5)).withColumn("sent", F.lit(1))
    expected = {(r["atm_id"], str(r["record_date"])): r["transaction_count"] for r in upsert_daily(table.read(), update, "sent").collect()}
    assert write_upsert(table, update, "sent") == 2
    assert counts(table) == expected
    after = table.manifest()["days"]
    assert {d for d in after if after[d] != before["days"].get(d)} == {"2026-01-02", "2026-01-04"}
    assert write_upsert(table, update.limit(0), "sent") == 2


def test_a_failed_write_changes_nothing(spark, table):
    before, content = table.manifest(), counts(table)
    broken = days(spark, ("A", "2026-01-01", 7), ("B", "2026-01-02", 8)).withColumn("sent", F.lit(1))
    bad = F.when(F.col("atm_id") == "B", F.raise_error(F.lit("disk is full"))).otherwise(F.col("ending_cash_balance"))
    with pytest.raises(Exception, match="disk is full"):
        table.replace(broken.withColumn("ending_cash_balance", bad), ["2026-01-01", "2026-01-02"])
    assert table.manifest() == before and counts(table) == content
    table.clean()
    assert counts(table) == content
    whole = table.read()
    table.replace(whole, table.keys_of(whole))
    assert table.clean() == 1 and counts(table) == content  # the first version's files


def test_versions_meet_and_strangers_are_refused(spark, table):
    stale = table.manifest()
    update = days(spark, ("A", "2026-01-02", 9))
    table.replace(update, ["2026-01-02"])
    with pytest.raises(RuntimeError, match="another job"):
        table._commit(stale | {"version": stale["version"] + 1})
    with pytest.raises(ValueError, match="not replaced"):
        table.replace(update, ["2026-01-03"])
    table.replace(update.limit(0), ["2026-01-02"])  # a day without rows goes
    assert {d for _, d in counts(table)} == {"2026-01-01", "2026-01-03"}


def test_null_days_and_empty_tables(spark):
    odd = rows(spark, [{"atm_id": "A", "record_date": None, "error_count": 1}, {"atm_id": None, "record_date": day("2026-01-01"), "error_count": 2}])
    made = DayTable(spark, work_path(spark, "odd-days"), odd.schema)
    assert made.read().count() == 0 and made.clean() == 0
    made.replace(odd, made.keys_of(odd))
    assert sorted(map(str, made.read().collect())) == sorted(map(str, odd.collect()))


def _transactions(spark, entries):
    return spark.createDataFrame(
        entries, "transaction_id long, atm_id string, transaction_time timestamp_ntz, amount double, transaction_type string"
    )


def test_late_rows_and_repeated_batches(spark):
    import datetime as dt

    entries = [
        (i, f"M{i % 3}" if i % 11 else None, dt.datetime(2026, 1, 1 + i % 5, i % 24), None if i % 7 == 0 else float(i), ["w", "Deposit", "fee", "withdrawal"][i % 4])
        for i in range(200)
    ]
    tx, folder = _transactions(spark, entries), work_path(spark, "late-test")
    for k in (3, 0, 4, 1, 2):  # a file per residue, so every day is touched by every file
        tx.filter(F.col("transaction_id") % 5 == k).coalesce(1).write.mode("append").parquet(folder)
    sums = stream.daily_sums(spark, work_path(spark, "sums-test"))
    read = stream.read_files(spark, folder, tx.schema, max_files=1)
    stream.roll_up_late(read, sums, work_path(spark, "sums-check")).awaitTermination()
    key = ("atm_id", "record_date")
    assert collect(days_from_partials(sums.read()), *key) == collect(transactions_by_type(tx), *key)
    version = sums.manifest()["version"]
    # A new checkpoint repeats all batch numbers, as a restart after a failure repeats the last one.
    stream.roll_up_late(read, sums, work_path(spark, "sums-check-again")).awaitTermination()
    assert sums.manifest()["version"] == version
    assert collect(days_from_partials(sums.read()), *key) == collect(transactions_by_type(tx), *key)
