import datetime as dt

import pytest
from frames import collect, day

from tillwatch.schemas import TRANSACTIONS
from tillwatch.session import work_path
from tillwatch.sources import ingest, readers
from tillwatch.streaming import ingest as stream
from tillwatch.sources import tables as t


def test_table_types():
    assert ingest.table_type(["atm_id", "timestamp", "remaining_cash", "uptime_status"]) == "cash_status"
    assert ingest.table_type(["atm_id", "timestamp", "uptime_status", "x"]) == "operational_logs"
    assert ingest.table_type(["atm_id", "transaction_time", "withdrawal_amount"]) == "transactions"
    assert ingest.table_type(["atm_id", "maintenance_date", "maintenance_type"]) == "maintenance_records"
    assert ingest.table_type(["atm_id", "atm_bank", "location", "atm_model"]) == "atm_metadata"
    assert ingest.table_type(ingest.LEGACY_METRICS_COLUMNS) == "legacy_metrics"
    with pytest.raises(ValueError, match="accepted"):
        ingest.table_type(["atm_id", "timestamp"])


def test_append_removes_duplicates_of_both_sides(spark):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "b", 1), (3, "c", 1)], "id long, v string, extra int")
    got = collect(ingest.append_distinct(old, new), "id", "extra")
    assert [(r["id"], r["extra"]) for r in got] == [(1, None), (2, None), (2, 1), (3, 1)]
    only_old = ingest.appended_rows(old, old.limit(0)).first()
    assert only_old["rows_added"] == -1


def test_first_source_wins(spark):
    a = spark.createDataFrame([(1, "raw"), (2, "raw")], "id long, v string")
    b = spark.createDataFrame([(2, "backup"), (3, "backup")], "id long, v string")
    got = collect(ingest.merge_first_source([a, b], "id"), "id")
    assert [(r["id"], r["v"]) for r in got] == [(1, "raw"), (2, "raw"), (3, "backup")]


def test_a_third_of_all_rows_with_one_key(spark):
    rows = [(i if i % 3 else 0, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = ingest.merge_first_source([df, df], "id")
    assert got.count() == len({k for k, _ in rows})
    assert got.filter("id = 0").first()["v"] == 0
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_upsert(spark):
    schema = ("atm_id string, record_date date, uptime_percentage double, error_count long, transaction_count long, "
              "starting_cash_balance double, ending_cash_balance double")
    base = spark.createDataFrame([("A", day("2026-01-01"), 90.0, 1, 2, 3.0, 4.0), ("A", day("2026-01-02"), 91.0, 1, 2, 3.0, 4.0)], schema)
    upd = spark.createDataFrame(
        [("A", day("2026-01-02"), 50.0, 9, 9, 9.0, 9.0, 1), ("A", day("2026-01-02"), None, 8, 8, 8.0, 8.0, 2),
         ("B", day("2026-01-01"), 70.0, 0, 0, 0.0, 0.0, 1)], schema + ", seq int")
    for extended in (False, True):
        b = base.selectExpr("*", "'note' AS note") if extended else base
        got = collect(ingest.upsert_daily(b, upd, order="seq"), "atm_id", "record_date")
        assert [(r["atm_id"], r["record_date"].day, r["uptime_percentage"], r["error_count"]) for r in got] == [
            ("A", 1, 90.0, 1), ("A", 2, None, 8), ("B", 1, 70.0, 0)]
        if extended:
            assert [r["note"] for r in got] == ["note", "note", None]


def test_csv_round_trip(spark):
    tx = spark.createDataFrame([(1, "A", dt.datetime(2026, 1, 2, 3, 4, 5), 1.5, "w", 1)], TRANSACTIONS)
    path = work_path(spark, "csv-test")
    ingest.write_raw_csv(tx, path, "transaction_time")
    assert readers.read_raw_csv(spark, path, TRANSACTIONS).collect() == tx.collect()
    with pytest.raises(ValueError, match="header"):
        tx.write.csv(path + "-bare")
        readers.read_raw_csv(spark, path + "-bare", TRANSACTIONS)


def test_upload_appends_only_what_is_new(spark):
    tables, sent = work_path(spark, "tables"), work_path(spark, "sent")
    rows = [("A", "2026-01-01", "5.00"), ("A", "2026-01-01", "5.0"), ("B", "2026-01-02", "n/a"), ("B", "soon", "7")]
    spark.createDataFrame(rows, "atm_id string, timestamp string, remaining_cash string").write.option("header", True).csv(sent)
    assert ingest.upload_csv(spark, sent, tables) == {"table": "cash_status", "rows_added": 3, "status": "ok"}
    assert ingest.upload_csv(spark, sent, tables)["rows_added"] == 0
    wider = sent + "-wider"
    spark.createDataFrame([("A", "2026-01-01", 5.0, 1), ("C", "2026-01-01", 1.0, 2)], "atm_id string, timestamp string, remaining_cash double, cash_id long").write.option("header", True).csv(wider)

    def broken():
        raise RuntimeError("no model today")

    assert ingest.upload_csv(spark, wider, tables, broken) == {
        "table": "cash_status", "rows_added": 2, "status": "partial", "error": "no model today"}
    got = ingest.read_table(spark, f"{tables}/cash_status")
    assert got.count() == 5 and dict(got.dtypes)["remaining_cash"] == "double" and dict(got.dtypes)["timestamp"] == "date"


def test_late_and_repeated_rows_of_a_stream(spark):
    folder, target = work_path(spark, "late"), work_path(spark, "late-out")
    make = lambda *days: spark.createDataFrame(
        [(d, "A", dt.datetime(2026, 1, d), 1.0, "w", 1) for d in days], TRANSACTIONS).coalesce(1)
    for days in ((10,), (20,), (5, 21), (10,)):
        make(*days).write.mode("append").parquet(folder)
    rows = stream.read_files(spark, folder, TRANSACTIONS, max_files=1)
    stream.ingest_all(rows, target, work_path(spark, "late-cp"), "transaction_time").awaitTermination()
    assert sorted(r["transaction_id"] for r in ingest.read_table(spark, target).collect()) == [5, 10, 20, 21]


def test_a_whole_table_read_by_one_task_must_be_asked_for(spark):
    with pytest.raises(ValueError, match="bounds"):
        readers.daily_metrics_jdbc(spark, "jdbc:none")


def test_metrics_read_filters_reach_a_parquet_scan(spark):
    path = work_path(spark, "metrics")
    spark.createDataFrame([("A", day("2026-01-01")), ("B", day("2026-01-09"))], "atm_id string, record_date date").write.parquet(path)
    got = readers.select_metrics(spark.read.parquet(path), since="2026-01-05", atm_id="B")
    assert got.count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(record_date,2026-01-05)" in plan and "EqualTo(atm_id,B)" in plan


def test_coercion_gives_null_for_bad_text(spark):
    df = spark.createDataFrame([("1.5", "2026-01-01"), ("x", "soon")], "n string, d string")
    got = ingest.coerce_dates(ingest.coerce_numbers(df, ["n", "absent"]), ["d"]).collect()
    assert [tuple(r) for r in got] == [(1.5, day("2026-01-01")), (None, None)]


def test_stream_keeps_its_place(spark):
    """A second run of the same job over a grown folder adds the new files' rows only."""
    folder, target, checkpoint = (work_path(spark, n) for n in ("in", "out", "cp"))
    tx = lambda i, h: (i, "A", dt.datetime(2026, 1, 1, h), 1.0, "w", 1)
    for batch in ([tx(1, 1), tx(2, 2), tx(2, 2)], [tx(2, 2), tx(3, 3)]):
        spark.createDataFrame(batch, TRANSACTIONS).write.mode("append").parquet(folder)
        rows = stream.distinct_rows(stream.read_files(spark, folder, TRANSACTIONS), "transaction_id", "transaction_time")
        stream.append_to(rows, target, checkpoint).awaitTermination()
    got = spark.read.parquet(target)
    assert sorted(r[0] for r in got.select("transaction_id").collect()) == [1, 2, 3]


def test_refresh_recomputes_touched_machines(spark):
    log = t.event_log(spark, "/root/testdata/sf0.001")
    from tillwatch.operators.rollup import daily_metrics

    daily = daily_metrics(t.cash_status(log), t.transactions(log), t.operational_logs(log))
    folder, target, checkpoint = (work_path(spark, n) for n in ("touched", "feats", "cp"))
    spark.createDataFrame([("3",), ("3",), ("5",)], "atm_id string").write.parquet(folder)
    changed = stream.read_files(spark, folder, "atm_id string")
    stream.refresh_features(changed, daily, target, checkpoint).awaitTermination()
    got = spark.read.parquet(target)
    assert {r[0] for r in got.select("atm_id").distinct().collect()} == {"3", "5"}
    assert got.count() == daily.filter("atm_id in ('3', '5')").count()
