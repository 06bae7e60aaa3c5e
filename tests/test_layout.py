"""Filtered appends, sorted CSV, footers, Z-order, trigram index."""

import datetime as dt
import glob
import os
import random

import pytest
from frames import collect
from pyspark.sql import functions as F

from tillwatch.operators.fleet import text_search
from tillwatch.operators.geo import near_point
from tillwatch.session import work_path
from tillwatch.sources.day_table import DayTable
from tillwatch.sources.filtered import FilteredTable
from tillwatch.sources.ingest import append_new_rows, read_table
from tillwatch.sources.layout import (
    append_sorted_csv,
    files_near,
    footers,
    near_point_by_place,
    newest_day,
    newest_day_frame,
    read_in_order,
    write_by_place,
    z_key,
)
from tillwatch.sources.text_index import TextIndex

TX = "transaction_id long, atm_id string, transaction_time timestamp_ntz, amount double"


def transactions(spark, ids, machine=None):
    made = [(i, machine or f"M{i * 7 % 6}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=3 * i), None if i % 9 == 0 else float(i)) for i in ids]
    return spark.createDataFrame(made, TX)


def rows_of(df):
    return sorted(map(str, df.collect()))


# --- filtered appends ---


def test_appends_equal_the_plain_way(spark):
    plain, filtered = work_path(spark, "plain"), FilteredTable(spark, work_path(spark, "filtered-test"), "transaction_time")
    first = transactions(spark, range(60))
    odd = first.filter("transaction_id < 3").withColumn("transaction_time", F.lit(None).cast("timestamp_ntz"))
    uploads = [first, transactions(spark, range(40, 90)).unionByName(odd), first.withColumn("note", F.lit(None).cast("string")).unionByName(
        odd.withColumn("note", F.lit("late"))), first.limit(0)]
    for upload in uploads:
        assert filtered.append(upload).rows_added == append_new_rows(upload, plain, "transaction_time")
        assert rows_of(read_table(spark, filtered.path)) == rows_of(read_table(spark, plain))


def test_days_without_a_hit_are_not_read(spark):
    table = FilteredTable(spark, work_path(spark, "unread"), "transaction_time")
    table.append(transactions(spark, range(0, 80)))
    for day in ("2026-01-03", "2026-01-04"):  # unreadable from now on
        for part in glob.glob(f"{table.path}/_day={day}/*.parquet"):
            os.chmod(part, 0o600)
            with open(part, "wb") as f:
                f.write(b"broken")
    more = transactions(spark, range(16, 32), "NEW").withColumn("transaction_id", F.col("transaction_id") + 1000)
    done = table.append(more)
    assert (done.rows_added, done.days_read) == (16, []) and set(done.days_touched) == {"2026-01-03", "2026-01-04"}


def test_a_table_without_filters_and_a_broken_append(spark, monkeypatch):
    path = work_path(spark, "taken-on")
    append_new_rows(transactions(spark, range(30)), path, "transaction_time")
    table = FilteredTable(spark, path, "transaction_time")
    assert table.append(transactions(spark, range(20, 40))).rows_added == 10
    again = table.append(transactions(spark, range(50)))
    assert again.rows_added == 10

    def broken(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(DayTable, "replace", broken)
        with pytest.raises(OSError):
            table.append(transactions(spark, range(60)))
    assert table.append(transactions(spark, range(60))).rows_added == 10
    assert read_table(spark, path).count() == 60


# --- sorted CSV ---


def test_files_in_name_order_are_sorted(spark):
    """One machine has most of the rows; a second append stands behind the first."""
    path = work_path(spark, "sorted-csv")
    for ids, files in ((range(400), 7), (range(30), 3)):
        rows = transactions(spark, ids, "HOT").unionByName(transactions(spark, list(ids)[:30]))
        append_sorted_csv(rows, path, "transaction_time", files=files)
    batches = sorted(os.listdir(path))
    assert batches == ["batch-000000001", "batch-000000002"]
    sizes = []
    for batch, n in zip(batches, (430, 60)):
        lines = []
        for name in sorted(glob.glob(f"{path}/{batch}/part-*")):
            with open(name) as f:
                part = f.read().splitlines()[1:]
            lines += [line.split(",")[1:3] for line in part]
            sizes.append(len(part))
        assert lines == sorted(lines) and len(lines) == n
    assert max(sizes) < 250  # the hot machine is spread over files
    read = read_in_order(spark, path, "transaction_id bigint, atm_id string, transaction_time timestamp_ntz, amount double")
    assert read.count() == 490


# --- footers ---


def test_newest_day_reads_no_row_group(spark):
    path = work_path(spark, "footers")
    days = spark.range(5000).select(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("record_date"), "id")
    days.repartition(4).write.parquet(path)
    assert newest_day(spark, path, "record_date") == dt.date(2026, 1, 1) + dt.timedelta(days=399)
    with footers(spark):
        plan = newest_day_frame(spark, path, "record_date")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(record_date)]" in plan
    empty = work_path(spark, "no-rows")
    days.limit(0).write.parquet(empty)
    assert newest_day(spark, empty, "record_date") is None


# --- places ---


def machines(spark, n=3000):
    rng = random.Random(6)
    made = [(f"A{i}", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(n)]
    made += [(f"B{i}", 17.9 + rng.uniform(0, 1), -76.9 + rng.uniform(0, 1)) for i in range(n // 3)]
    return spark.createDataFrame([*made, ("none", None, None), ("half", 17.95, None), ("pole", 90.0, 180.0)], "atm_id string, lat double, lng double")


def test_z_key_interleaves_the_bits(spark):
    def plain(lat, lng):
        y, x = (min(65535, int((v + low) / width * 65536)) for v, low, width in ((lat, 90, 180), (lng, 180, 360)))
        return sum((y >> b & 1) << (2 * b + 1) | (x >> b & 1) << (2 * b) for b in range(16))

    for r in machines(spark, 200).withColumn("z", z_key()).collect():
        assert r["z"] == (None if r["lng"] is None else plain(r["lat"], r["lng"]))


def test_files_read_fall_with_the_radius(spark):
    rows, path = machines(spark), work_path(spark, "places")
    write_by_place(rows, path, files=24)
    read = []
    for radius in (30_000.0, 3000.0, 300.0, 3.0):
        got = near_point_by_place(spark, path, 17.95, -76.85, radius)
        assert collect(got.select("atm_id", "distance_km"), "atm_id") == collect(near_point(rows, 17.95, -76.85, radius).select("atm_id", "distance_km"), "atm_id")
        read.append(len(files_near(spark, path, 17.95, -76.85, radius)))
    assert read == sorted(read, reverse=True) and read[0] > 20 and read[-1] <= 8
    for lat, lng, radius in ((89.9, 10.0, 500.0), (0.0, 179.9, 400.0), (-40.0, -100.0, 0.001)):
        got = near_point_by_place(spark, path, lat, lng, radius)
        assert rows_of(got.select("atm_id")) == rows_of(near_point(rows, lat, lng, radius).select("atm_id"))


# --- text ---


def test_index_equals_the_scan(spark):
    rng = random.Random(9)
    names = ["Main Street", "main", "Maine", "Ünal Çarşı", "日本橋", "ab", "", None, "aXbXc", "mall of mains", "İstanbul"]
    made = [(f"A{i}", rng.choice(names), rng.choice(names), "in_service") for i in range(120)] + [("A1", "Main Gate", None, "in_service")]
    master = spark.createDataFrame(made, "atm_id string, name string, building string, status string")
    index = TextIndex(spark, work_path(spark, "text-test"), ["name", "building"], buckets=8).build(master)
    for text in ("main", "MAIN", "ain", "ab", "", "ünal", "日本橋", "xbx", "nothing here", "main street", "street main"):
        assert rows_of(index.search(text)) == rows_of(text_search(master, text)), text


def test_folders_of_other_texts_are_not_opened(spark):
    master = spark.createDataFrame([(f"A{i}", "needle" if i == 5 else f"hay {i}") for i in range(200)], "atm_id string, name string")
    index = TextIndex(spark, work_path(spark, "text-unread"), ["name"], buckets=32).build(master)
    home = spark.read.parquet(f"{index.path}/rows").filter("name = 'needle'").select("_bucket").first()[0]
    kept = glob.glob(f"{index.path}/rows/_bucket={home}/*.parquet")
    others = sorted(set(glob.glob(f"{index.path}/rows/*/*.parquet")) - set(kept))
    for part in others[1:]:  # the first one gives the schema
        with open(part, "wb") as f:
            f.write(b"broken")
    assert [r["atm_id"] for r in index.search("needle").collect()] == ["A5"]
