"""Queries over the raw tables: sources, sinks, ingest, daily roll-up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillwatch.operators import rollup
from tillwatch.operators.impute import METRICS, domain_rules, impute_zero
from tillwatch.plans.catalog import query
from tillwatch.plans.check_sql import AS_OF
from tillwatch.schemas import RAW_TABLES
from tillwatch.session import work_path
from tillwatch.sources import ingest, readers
from tillwatch.sources import tables as t
from tillwatch.sources.day_table import DayTable
from tillwatch.sources.filtered import FilteredTable
from tillwatch.sources.layout import append_sorted_csv, newest_day, read_in_order

_TX_DAY = (
    "atm_id record_date:d transaction_count:i daily_withdrawal_amount:f avg_transaction_amount:f "
    "daily_deposit_count:i daily_deposit_amount:f"
)
_DAILY = (
    f"{_TX_DAY} error_count:i downtime_duration:i starting_cash_balance:f ending_cash_balance:f "
    "uptime_minutes:i uptime_percentage:f service_date:d"
)
_MASTER = "atm_id atm_bank location atm_model services card_types operational_status lat:f lng:f"


def daily(spark, d, **days):
    log = t.event_log(spark, d)
    return rollup.daily_metrics(
        t.cash_status(log), t.transactions(log), t.operational_logs(log), t.maintenance_records(log), **days
    )


def readings_daily(spark, d):
    log = t.event_log(spark, d)
    return rollup.daily_metrics(
        t.cash_readings(log), t.transactions(log), t.operational_logs(log), t.maintenance_records(log),
        keep_all_readings=True, keep_reading_order=True,
    )


# --- sources and sinks -----------------------------------------------------------------


def _through_csv(spark, name, df, *, order=None):
    """Write a table as CSV in a layout of its own and read it back by its header."""
    path = work_path(spark, f"{name}-csv")
    df.select(*(order or df.columns)).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return readers.read_raw_csv(spark, path, RAW_TABLES[name])


@query(
    "scan_raw",
    "transaction_id:i atm_id transaction_time:t amount:f transaction_type transaction_status:i",
    "SELECT * FROM tx",
)
def scan_raw(spark, d):
    path = work_path(spark, "transactions-csv")
    ingest.write_raw_csv(t.transactions(t.event_log(spark, d)), path, "transaction_time")
    return readers.read_raw_csv(spark, path, RAW_TABLES["transactions"])


@query(
    "scan_transactions",
    "transaction_id:i atm_id transaction_time:t withdrawal_amount:f transaction_status:i",
    "SELECT *, amount AS withdrawal_amount FROM tx WHERE transaction_type = 'withdrawal'",
)
def scan_transactions(spark, d):
    """The documented layout without types."""
    tx = t.transactions_untyped(t.event_log(spark, d))
    layout = ["transaction_id", "atm_id", "transaction_time", "withdrawal_amount", "transaction_status"]
    return _through_csv(spark, "transactions", tx, order=layout)


@query("scan_cash", "atm_id timestamp:d remaining_cash:f", "SELECT atm_id, record_date AS timestamp, remaining_cash FROM cash")
def scan_cash(spark, d):
    """Without the record id."""
    return _through_csv(spark, "cash_status", t.cash_status(t.event_log(spark, d)), order=["atm_id", "timestamp", "remaining_cash"])


@query(
    "scan_logs",
    "atm_id timestamp:t uptime_status:i error_code downtime_duration:i note",
    "SELECT *, ts AS timestamp, 'n' AS note FROM status_log",
)
def scan_logs(spark, d):
    """Columns in another order, no record id, and a column of the sender's own."""
    logs = t.operational_logs(t.event_log(spark, d)).withColumn("note", F.lit("n"))
    layout = ["error_code", "note", "downtime_duration", "timestamp", "atm_id", "uptime_status"]
    return _through_csv(spark, "operational_logs", logs, order=layout)


@query("scan_maintenance", "atm_id maintenance_date:t maintenance_type amount_added:f", "SELECT * FROM maint")
def scan_maintenance(spark, d):
    layout = ["atm_id", "maintenance_date", "maintenance_type", "amount_added"]
    return _through_csv(spark, "maintenance_records", t.maintenance_records(t.event_log(spark, d)), order=layout)


@query("scan_metadata", "atm_id atm_bank location atm_model lat:f lng:f", "SELECT * FROM master")
def scan_metadata(spark, d):
    layout = ["atm_id", "atm_bank", "location", "atm_model", "lat", "lng"]
    return _through_csv(spark, "atm_metadata", t.atm_metadata(spark, d), order=layout)


@query("daily_from_csv", _DAILY, "SELECT * FROM daily")
def daily_from_csv(spark, d):
    """The roll-up over CSV files, columns in reverse order, equals the one over parquet."""
    raw = {n: df for n, df in t.raw_tables(spark, d).items() if n != "atm_metadata"}
    read = {n: _through_csv(spark, n, df, order=df.columns[::-1]) for n, df in raw.items()}
    return rollup.daily_metrics(
        read["cash_status"], read["transactions"], read["operational_logs"], read["maintenance_records"]
    )


@query(
    "merge_raw_backup",
    "table_name rows_kept:i from_raw:i",
    """SELECT * FROM (
         SELECT 'transactions' AS table_name, count(*) AS rows_kept, count(*) FILTER (WHERE transaction_id % 3 <> 0) AS from_raw FROM tx
         UNION ALL SELECT 'cash_status', count(*), count(*) FILTER (WHERE cash_id % 3 <> 0) FROM cash
         UNION ALL SELECT 'operational_logs', count(*), count(*) FILTER (WHERE log_id % 3 <> 0) FROM status_log
         UNION ALL SELECT 'maintenance_records', count(*), count(*) FILTER (WHERE maintenance_id % 3 <> 0) FROM maint
         UNION ALL SELECT 'atm_metadata', count(*), count(*) FILTER (WHERE CAST(atm_id AS BIGINT) % 3 <> 0) FROM master)""",
)
def merge_raw_backup(spark, d):
    """A raw folder that lacks every third record and a backup folder with all of them."""
    tables = t.raw_tables(spark, d)
    keys = readers.RECORD_IDS
    raw = {n: df.filter(F.col(keys[n]).cast("long") % 3 != 0).withColumn("origin", F.lit("raw")) for n, df in tables.items()}
    merged = readers.merge_raw_and_backup(raw, {n: df.withColumn("origin", F.lit("backup")) for n, df in tables.items()})
    counts = [
        df.agg(F.lit(n).alias("table_name"), F.count("*").alias("rows_kept"), F.count_if(F.col("origin") == "raw").alias("from_raw"))
        for n, df in merged.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "format_times",
    "transaction_id:i atm_id transaction_time day_text",
    "SELECT transaction_id, atm_id, strftime(transaction_time, '%Y-%m-%d %H:%M:%S') AS transaction_time, "
    "strftime(transaction_time, '%Y-%m-%d') AS day_text FROM tx",
)
def format_times(spark, d):
    tx = t.transactions(t.event_log(spark, d)).withColumn("day_text", F.col("transaction_time"))
    return ingest.format_time(ingest.format_time(tx, "transaction_time", True), "day_text", False)


@query("master_lookup", _MASTER, "SELECT * FROM master WHERE atm_id = '7'")
def master_lookup(spark, d):
    return readers.machine_master(t.atm_metadata(spark, d), "7")


@query(
    "maintenance_log",
    "maintenance_id:i atm_id service_date:t maintenance_type amount_added:f",
    "SELECT *, maintenance_date AS service_date FROM maint",
)
def maintenance_log(spark, d):
    return readers.maintenance_log(t.maintenance_records(t.event_log(spark, d)))


@query(
    "merge_keep_first",
    "o_orderkey:i o_custkey:i o_orderpriority origin",
    """SELECT o_orderkey, o_custkey, o_orderpriority,
         CASE WHEN o_orderstatus IN ('F', 'O') THEN 'raw' ELSE 'backup' END AS origin FROM orders""",
)
def merge_keep_first(spark, d):
    orders = t.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    raw = orders.filter(F.col("o_orderstatus").isin("F", "O")).withColumn("origin", F.lit("raw"))
    backup = orders.withColumn("origin", F.lit("backup"))
    return ingest.merge_first_source([raw, backup], "o_orderkey")


def _two_uploads(spark, d):
    orders = t.table(spark, d, "orders")
    old = orders.filter(F.col("o_orderstatus").isin("F", "O")).select("o_custkey", "o_orderstatus")
    new = orders.filter(F.col("o_orderstatus").isin("O", "P")).select("o_custkey", "o_orderstatus", "o_orderpriority")
    return old, new


_UPLOADS_SQL = """
    SELECT o_custkey, o_orderstatus, NULL AS o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')
    UNION SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P')"""


@query("append_dedupe", "o_custkey:i o_orderstatus o_orderpriority", _UPLOADS_SQL)
def append_dedupe(spark, d):
    return ingest.append_distinct(*_two_uploads(spark, d))


@query(
    "append_new_rows",
    "rows_before:i rows_after:i rows_added:i",
    f"""SELECT rows_before, rows_after, rows_after - rows_before AS rows_added
        FROM (SELECT count(*) AS rows_before FROM orders WHERE o_orderstatus IN ('F', 'O')),
             (SELECT count(*) AS rows_after FROM ({_UPLOADS_SQL}))""",
)
def append_new_rows(spark, d):
    return ingest.appended_rows(*_two_uploads(spark, d))


@query(
    "upload_flow",
    "transaction_id:i atm_id transaction_time:t amount:f transaction_type transaction_status:i",
    """SELECT * FROM tx WHERE transaction_id % 2 = 0
       UNION SELECT * REPLACE (CASE WHEN transaction_id % 7 = 0 THEN NULL ELSE amount END AS amount) FROM tx""",
)
def upload_flow(spark, d):
    """Half of the transactions are in the table; an upload brings all of them as text, some cells spoilt, and comes twice."""
    tables, sent = work_path(spark, "tables"), work_path(spark, "upload")
    tx = t.transactions(t.event_log(spark, d)).withColumn("transaction_time", F.date_trunc("second", "transaction_time").cast("timestamp_ntz"))
    ingest.append_new_rows(tx.filter("transaction_id % 2 = 0").withColumn("withdrawal_amount", F.col("amount")), f"{tables}/transactions", "transaction_time")
    spoilt = tx.withColumns({
        "amount": F.when(F.col("transaction_id") % 7 == 0, "n/a").otherwise(F.col("amount").cast("string")),
        "withdrawal_amount": F.col("amount"),
        "transaction_time": F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss"),
    })
    spoilt.write.option("header", True).csv(sent)
    first, again = ingest.upload_csv(spark, sent, tables), ingest.upload_csv(spark, sent, tables)
    if first["rows_added"] == 0 or again["rows_added"] != 0:
        raise AssertionError(f"{first}, then {again}")
    return ingest.read_table(spark, f"{tables}/transactions")


def _in_seconds(tx):
    return tx.withColumn("transaction_time", F.date_trunc("second", "transaction_time").cast("timestamp_ntz"))


@query(
    "upload_filtered",
    "upload:i rows_added:i days_touched:i days_read:i",
    """SELECT 1 AS upload, count(*) FILTER (WHERE early) AS rows_added, count(DISTINCT record_date) FILTER (WHERE early) AS days_touched, 0 AS days_read
       FROM (SELECT *, record_date < (SELECT max(record_date) FROM tx) - 10 AS early FROM tx)
       UNION ALL
       SELECT 2, count(*) FILTER (WHERE NOT early), count(DISTINCT record_date) FILTER (WHERE NOT early OR repeated),
         count(DISTINCT record_date) FILTER (WHERE repeated)
       FROM (SELECT *, early AND record_date >= (SELECT max(record_date) FROM tx) - 12 AS repeated
             FROM (SELECT *, record_date < (SELECT max(record_date) FROM tx) - 10 AS early FROM tx))
       UNION ALL
       SELECT 3, 0, count(DISTINCT record_date), count(DISTINCT record_date) FROM tx""",
)
def upload_filtered(spark, d):
    """Three uploads: all but the newest days, then the newest with two days of repeats, then everything again. Of each:
    rows added, days that it has, and days of the table that had to be read."""
    tx = _in_seconds(t.transactions(t.event_log(spark, d)))
    day, newest = F.to_date("transaction_time"), tx.agg(F.max(F.to_date("transaction_time"))).scalar()
    table = FilteredTable(spark, work_path(spark, "filtered"), "transaction_time")
    uploads = [tx.filter(day < F.date_sub(newest, 10)), tx.filter(day >= F.date_sub(newest, 12)), tx]
    done = [(n, table.append(upload)) for n, upload in enumerate(uploads, 1)]
    rows = [(n, a.rows_added, len(a.days_touched), len(a.days_read)) for n, a in done]
    return spark.createDataFrame(rows, "upload long, rows_added long, days_touched long, days_read long")


@query(
    "csv_in_order",
    "row_index:i atm_id transaction_time:t transaction_id:i",
    """SELECT row_number() OVER (ORDER BY late, atm_id, date_trunc('second', transaction_time)) - 1 AS row_index, * FROM (
         SELECT atm_id, transaction_time, transaction_id, transaction_id % 3 = 0 AS late,
           count(*) OVER (PARTITION BY transaction_id % 3 = 0, atm_id, date_trunc('second', transaction_time)) AS n FROM tx) WHERE n = 1""",
)
def csv_in_order(spark, d):
    """Two appends of CSV, read back in the order of the files' names: each is sorted by machine and time as a whole,
    the second stands behind the first. Times that a machine has twice within a second are left out: their order is free."""
    tx = t.transactions(t.event_log(spark, d)).select("atm_id", "transaction_time", "transaction_id")
    tx = tx.withColumns({"late": F.col("transaction_id") % 3 == 0, "second": F.date_trunc("second", "transaction_time")})
    single = tx.groupBy("late", "atm_id", "second").agg(F.count("*").alias("n")).filter("n = 1")
    tx = tx.join(single, ["late", "atm_id", "second"], "left_semi")
    path = work_path(spark, "ordered-csv")
    for late in (False, True):
        append_sorted_csv(tx.filter(F.col("late") == late).select("atm_id", "transaction_time", "transaction_id"), path, "transaction_time", files=5)
    rows = read_in_order(spark, path, "atm_id string, transaction_time timestamp_ntz, transaction_id bigint")
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return rows.withColumn("nth", nth).join(starts, "file").withColumn("row_index", F.col("start") + F.col("nth") - 1)


@query(
    "last_days_by_footer", "atm_id timestamp:d remaining_cash:f",
    "SELECT atm_id, record_date AS timestamp, remaining_cash FROM cash WHERE record_date >= (SELECT max(record_date) FROM cash) - 7",
)
def last_days_by_footer(spark, d):
    """The newest day comes from the footers of the files, and cuts the scan as a pushed filter."""
    path = work_path(spark, "readings")
    t.cash_status(t.event_log(spark, d)).write.parquet(path)
    return spark.read.parquet(path).filter(F.col("timestamp") >= rollup.window_start(None, 7, newest_day(spark, path, "timestamp")))


def _correction(days):
    """New figures for the days with errors, and one more day per machine after its last."""
    fixed = days.filter(F.col("error_count") > 0).select(
        "atm_id", "record_date", F.lit(None).cast("double").alias("uptime_percentage"),
        F.lit(0).cast("long").alias("error_count"), (F.col("transaction_count") + 1).alias("transaction_count"),
        "starting_cash_balance", (F.col("ending_cash_balance") + 5).alias("ending_cash_balance"),
    )
    added = days.groupBy("atm_id").agg(F.date_add(F.max("record_date"), 1).alias("record_date")).select(
        "atm_id", "record_date", F.lit(100.0).alias("uptime_percentage"), F.lit(0).cast("long").alias("error_count"),
        F.lit(0).cast("long").alias("transaction_count"), F.lit(1.0).alias("starting_cash_balance"),
        F.lit(1.0).alias("ending_cash_balance"),
    )
    return fixed.unionByName(added)


_UPSERT = (
    "atm_id record_date:d uptime_percentage:f error_count:i transaction_count:i starting_cash_balance:f "
    "ending_cash_balance:f downtime_duration:i"
)
_UPSERT_SQL = """SELECT atm_id, record_date, CASE WHEN error_count > 0 THEN NULL ELSE uptime_percentage END AS uptime_percentage,
         0 AS error_count, CASE WHEN error_count > 0 THEN transaction_count + 1 ELSE transaction_count END
           AS transaction_count,
         starting_cash_balance,
         CASE WHEN error_count > 0 THEN ending_cash_balance + 5 ELSE ending_cash_balance END AS ending_cash_balance,
         downtime_duration FROM daily
       UNION ALL
       SELECT atm_id, max(record_date) + 1, 100, 0, 0, 1, 1, NULL FROM daily GROUP BY atm_id"""


@query("upsert_daily", _UPSERT, _UPSERT_SQL)
def upsert_daily(spark, d):
    days = daily(spark, d)
    return ingest.upsert_daily(days, _correction(days).withColumn("sent", F.lit(1)), order="sent")


@query("upsert_written", _UPSERT, _UPSERT_SQL)
def upsert_written(spark, d):
    """The same through a stored table: it is written, takes the correction in two uploads, of which the second repeats
    and overrules a part of the first, and is read back."""
    days = daily(spark, d)
    table = DayTable(spark, work_path(spark, "daily-table"), days.schema)
    table.replace(days, table.keys_of(days))
    sent = _correction(table.read()).withColumn("sent", F.lit(2))
    wrong = sent.filter(F.col("error_count") == 0).withColumns({"sent": F.lit(1), "ending_cash_balance": F.lit(-1.0)})
    for upload in (sent.filter(F.crc32("atm_id") % 2 == 0).unionByName(wrong), sent):
        ingest.write_upsert(table, upload, "sent")
    return table.read()


@query(
    "coerce_types",
    "event_id:i amount:f day:d",
    """SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS amount,
         CASE WHEN event_type <> 'view' THEN record_date END AS day FROM ev""",
)
def coerce_types(spark, d):
    texts = t.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(F.col("event_type") == "view", "yesterday").otherwise(F.to_date("ts").cast("string")).alias("day"),
    )
    return ingest.coerce_dates(ingest.coerce_numbers(texts, ["amount"]), ["day"])


# --- daily roll-up ---------------------------------------------------------------------


@query("daily_tx_typed", _TX_DAY, "SELECT * FROM tx_days")
def daily_tx_typed(spark, d):
    return rollup.transactions_by_type(t.transactions(t.event_log(spark, d)))


@query("daily_tx_outer", _TX_DAY, "SELECT * FROM tx_days")
def daily_tx_outer(spark, d):
    return rollup.transactions_by_type_joined(t.transactions(t.event_log(spark, d)))


@query(
    "daily_tx_plain",
    _TX_DAY,
    """SELECT atm_id, record_date, count(*) AS transaction_count, sum(amount) AS daily_withdrawal_amount,
         avg(amount) AS avg_transaction_amount, 0 AS daily_deposit_count, 0 AS daily_deposit_amount
       FROM tx WHERE transaction_type = 'withdrawal' GROUP BY atm_id, record_date""",
)
def daily_tx_plain(spark, d):
    return rollup.transactions_daily(t.transactions_untyped(t.event_log(spark, d)))


@query("daily_errors", "atm_id record_date:d error_count:i", "SELECT * FROM error_days")
def daily_errors(spark, d):
    return rollup.errors_daily(t.operational_logs(t.event_log(spark, d)))


@query("daily_downtime", "atm_id record_date:d downtime_duration:i", "SELECT * FROM downtime_days")
def daily_downtime(spark, d):
    return rollup.downtime_daily(t.operational_logs(t.event_log(spark, d)))


@query("cash_balances", "atm_id record_date:d starting_cash_balance:f ending_cash_balance:f", "SELECT * FROM balances")
def cash_balances(spark, d):
    return rollup.cash_balances(t.cash_status(t.event_log(spark, d)))


@query(
    "cash_balances_all_readings", "atm_id record_date:d reading:i starting_cash_balance:f ending_cash_balance:f", "SELECT * FROM readings"
)
def cash_balances_all_readings(spark, d):
    """A row per reading; a machine's readings are looked through in ranges, not in one window."""
    return rollup.starting_balance(rollup.cash_days(t.cash_readings(t.event_log(spark, d)), keep_all_readings=True))


@query("daily_metrics", _DAILY, "SELECT * FROM daily")
def daily_metrics(spark, d):
    return daily(spark, d)


@query("daily_uptime", "atm_id record_date:d downtime_duration:i uptime_minutes:i uptime_percentage:f",
       """SELECT atm_id, record_date, downtime_duration,
            1440 - CASE WHEN downtime_duration < 0 THEN 0 WHEN downtime_duration > 1440 THEN 1440
                        ELSE downtime_duration END AS uptime_minutes,
            (1440 - CASE WHEN downtime_duration < 0 THEN 0 WHEN downtime_duration > 1440 THEN 1440
                         ELSE downtime_duration END) / 1440e0 * 100 AS uptime_percentage FROM downtime_days""")
def daily_uptime(spark, d):
    return rollup.add_uptime(rollup.downtime_daily(t.operational_logs(t.event_log(spark, d))))


@query("latest_service", "atm_id service_date:d", "SELECT * FROM services_seen")
def latest_service(spark, d):
    return rollup.latest_service(t.maintenance_records(t.event_log(spark, d)))


@query("last_n_days", _DAILY, "SELECT * FROM daily WHERE record_date >= (SELECT max(record_date) FROM daily) - 7")
def last_n_days(spark, d):
    return daily(spark, d, days=7)


@query("since_as_of", _DAILY, f"SELECT * FROM daily WHERE record_date >= DATE '{AS_OF}' - 10")
def since_as_of(spark, d):
    return rollup.since_as_of(daily(spark, d), 10, AS_OF)


@query(
    "metrics_with_maint",
    "atm_id record_date:d uptime_percentage:f service_date:d",
    """SELECT s.atm_id, s.record_date, s.uptime_percentage, m.service_date
       FROM sup s LEFT JOIN services_seen m ON s.atm_id = m.atm_id""",
)
def metrics_with_maint(spark, d):
    return rollup.with_latest_service(t.supplier_days(spark, d), t.maintenance_records(t.event_log(spark, d)))


@query("fleet_snapshot", f"{_DAILY} atm_bank location atm_model operational_status lat:f lng:f", "SELECT * FROM snapshot")
def fleet_snapshot(spark, d):
    return rollup.fleet_snapshot(daily(spark, d), t.atm_metadata(spark, d))


@query(
    "fleet_snapshot_sql",
    f"{_DAILY} atm_bank location operational_status",
    """SELECT d.*, m.atm_bank, m.location, m.operational_status FROM master m JOIN daily d ON m.atm_id = d.atm_id
       WHERE d.record_date = (SELECT max(x.record_date) FROM daily x WHERE x.atm_id = m.atm_id)""",
)
def fleet_snapshot_sql(spark, d):
    return rollup.fleet_snapshot_sql(daily(spark, d), t.atm_metadata(spark, d))


@query("distinct_machines", "atm_id", "SELECT DISTINCT atm_id FROM sup_days")
def distinct_machines(spark, d):
    return rollup.machines(t.supplier_days(spark, d))


# --- cleaning --------------------------------------------------------------------------

_GAPPY = "atm_id record_date:d uptime_percentage:f error_count:f transaction_count:f starting_cash_balance:f ending_cash_balance:f"
_GAPPY_SQL = """
    SELECT atm_id, record_date, CASE WHEN error_count = 1 THEN NULL ELSE uptime_percentage END AS uptime_percentage,
      CASE WHEN transaction_count = 2 THEN NULL ELSE error_count END AS error_count,
      CASE WHEN daily_deposit_count >= 1 AND error_count >= 1 THEN NULL ELSE transaction_count + 0.5e0 END
        AS transaction_count,
      starting_cash_balance + 0.5e0 AS starting_cash_balance,
      CASE WHEN daily_deposit_count = 1 THEN NULL ELSE ending_cash_balance + 0.25e0 END AS ending_cash_balance
    FROM daily"""


def gappy(days):
    """The daily table with values missing by rules that leave gaps in four of the five metrics."""
    return days.select(
        "atm_id",
        "record_date",
        F.when(F.col("error_count") != 1, F.col("uptime_percentage")).alias("uptime_percentage"),
        F.when(F.col("transaction_count") != 2, F.col("error_count").cast("double")).alias("error_count"),
        F.when((F.col("daily_deposit_count") < 1) | (F.col("error_count") < 1), F.col("transaction_count") + 0.5).alias(
            "transaction_count"
        ),
        (F.col("starting_cash_balance") + 0.5).alias("starting_cash_balance"),
        F.when(F.col("daily_deposit_count") != 1, F.col("ending_cash_balance") + 0.25).alias("ending_cash_balance"),
    )


@query("impute_zero", _GAPPY, f"""SELECT atm_id, record_date, {', '.join(f'coalesce({m}, 0) AS {m}' for m in METRICS)}
                                  FROM ({_GAPPY_SQL})""")
def zero_filled(spark, d):
    return impute_zero(gappy(daily(spark, d)))


@query(
    "impute_constraints",
    "atm_id record_date:d uptime_percentage:f error_count:i transaction_count:i starting_cash_balance:i "
    "ending_cash_balance:i",
    f"""SELECT atm_id, record_date, uptime_percentage, error_count, round_even(transaction_count, 0) AS transaction_count,
          round_even(starting_cash_balance, 0) AS starting_cash_balance,
          round_even(least(ending_cash_balance, starting_cash_balance), 0) AS ending_cash_balance FROM ({_GAPPY_SQL})""",
)
def constrained(spark, d):
    return domain_rules(gappy(daily(spark, d)))
