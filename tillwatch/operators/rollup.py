"""Raw tables to one row per machine and day.

Raw rows are reduced by partial aggregation before any shuffle, so a machine that holds a
large share of the transactions arrives as a few partial rows per day. Windows run only on
the reduced table, where a machine has one row per calendar day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import clip
from tillwatch.operators.segments import previous_value

DAY_KEYS = ["atm_id", "record_date"]
MINUTES_PER_DAY = 1440

# Accepted spellings of the two transaction types, lower case.
WITHDRAWAL_TYPES = ["withdrawal", "w"]
DEPOSIT_TYPES = ["deposit", "d"]


def _with_day(df: DataFrame, time_column: str) -> DataFrame:
    """Add the calendar day; rows without a machine never form a group."""
    return df.filter(F.col("atm_id").isNotNull()).withColumn("record_date", F.to_date(time_column))


def _zero_if_null(c: Column, zero=0.0) -> Column:
    return F.coalesce(c, F.lit(zero))


def _amount(tx: DataFrame) -> Column:
    return F.col("amount" if "amount" in tx.columns else "withdrawal_amount")


def _kind() -> tuple[Column, Column]:
    kind = F.lower("transaction_type")
    return kind.isin(WITHDRAWAL_TYPES), kind.isin(DEPOSIT_TYPES)


def transactions_by_type(tx: DataFrame) -> DataFrame:
    """Withdrawal and deposit figures per machine-day in a single aggregation."""
    out, into = _kind()
    amount = _amount(tx)
    return (
        _with_day(tx, "transaction_time")
        .filter(out | into)
        .groupBy(*DAY_KEYS)
        .agg(
            F.count_if(out).alias("transaction_count"),
            _zero_if_null(F.sum(F.when(out, amount))).alias("daily_withdrawal_amount"),
            _zero_if_null(F.avg(F.when(out, amount))).alias("avg_transaction_amount"),
            F.count_if(into).alias("daily_deposit_count"),
            _zero_if_null(F.sum(F.when(into, amount))).alias("daily_deposit_amount"),
        )
    )


#: Sums from which the daily figures follow, and which add up over any parts of a day's rows.
PARTIAL_DAY = (
    "atm_id string, record_date date, withdrawals long, withdrawn double, amounts long, deposits long, deposited double"
)


def partial_days(tx: DataFrame) -> DataFrame:
    """Mergeable sums per machine-day of the typed transactions."""
    out, into = _kind()
    amount = _amount(tx)
    return (
        _with_day(tx, "transaction_time")
        .filter(out | into)
        .groupBy(*DAY_KEYS)
        .agg(
            F.count_if(out).alias("withdrawals"),
            F.sum(F.when(out, amount)).alias("withdrawn"),
            F.count(F.when(out, amount)).alias("amounts"),
            F.count_if(into).alias("deposits"),
            F.sum(F.when(into, amount)).alias("deposited"),
        )
    )


def merged_days(partials: DataFrame) -> DataFrame:
    """One row per machine-day from the sums of several parts."""
    sums = ["withdrawals", "withdrawn", "amounts", "deposits", "deposited"]
    return partials.groupBy(*DAY_KEYS).agg(*[F.sum(c).alias(c) for c in sums])


def days_from_partials(partials: DataFrame) -> DataFrame:
    """The figures of ``transactions_by_type`` from merged sums."""
    return partials.select(
        *DAY_KEYS,
        F.col("withdrawals").alias("transaction_count"),
        _zero_if_null(F.col("withdrawn")).alias("daily_withdrawal_amount"),
        _zero_if_null(F.try_divide("withdrawn", "amounts")).alias("avg_transaction_amount"),
        F.col("deposits").alias("daily_deposit_count"),
        _zero_if_null(F.col("deposited")).alias("daily_deposit_amount"),
    )


def transactions_by_type_joined(tx: DataFrame) -> DataFrame:
    """The same figures from two aggregations and a full outer join (for comparison)."""
    out, into = _kind()
    amount = _amount(tx)
    days = _with_day(tx, "transaction_time")
    withdrawals = days.filter(out).groupBy(*DAY_KEYS).agg(
        F.count("*").alias("transaction_count"),
        F.sum(amount).alias("daily_withdrawal_amount"),
        F.avg(amount).alias("avg_transaction_amount"),
    )
    deposits = days.filter(into).groupBy(*DAY_KEYS).agg(
        F.count("*").alias("daily_deposit_count"), F.sum(amount).alias("daily_deposit_amount")
    )
    return withdrawals.join(deposits, DAY_KEYS, "full_outer").fillna(0)


def transactions_plain(tx: DataFrame) -> DataFrame:
    """Every row is a withdrawal; status is not looked at, so failed ones count too."""
    return (
        _with_day(tx, "transaction_time")
        .groupBy(*DAY_KEYS)
        .agg(
            F.count("*").alias("transaction_count"),
            _zero_if_null(F.sum("withdrawal_amount")).alias("daily_withdrawal_amount"),
            _zero_if_null(F.avg("withdrawal_amount")).alias("avg_transaction_amount"),
        )
        .withColumns({"daily_deposit_count": F.lit(0).cast("long"), "daily_deposit_amount": F.lit(0.0)})
    )


def transactions_daily(tx: DataFrame) -> DataFrame:
    return transactions_by_type(tx) if "transaction_type" in tx.columns else transactions_plain(tx)


def errors_daily(logs: DataFrame) -> DataFrame:
    """Machine-days with at least one failed status row, and how many."""
    return (
        _with_day(logs, "timestamp")
        .filter(F.col("uptime_status") == 0)
        .groupBy(*DAY_KEYS)
        .agg(F.count("*").alias("error_count"))
    )


def downtime_daily(logs: DataFrame) -> DataFrame:
    return (
        _with_day(logs, "timestamp")
        .groupBy(*DAY_KEYS)
        .agg(_zero_if_null(F.sum("downtime_duration"), 0).cast("long").alias("downtime_duration"))
    )


def logs_daily(logs: DataFrame) -> DataFrame:
    """Errors and downtime in one aggregation over the log."""
    return (
        _with_day(logs, "timestamp")
        .groupBy(*DAY_KEYS)
        .agg(
            F.count_if(F.col("uptime_status") == 0).alias("error_count"),
            _zero_if_null(F.sum("downtime_duration"), 0).cast("long").alias("downtime_duration"),
        )
    )


def cash_days(cash: DataFrame, keep_all_readings: bool = False) -> DataFrame:
    """End-of-day balance per machine and day: the last reading of the day wins, as in an upsert.

    That makes (machine, day) unique, so the history of a machine is bounded by the calendar and
    no window over it can grow with the data. ``keep_all_readings`` keeps a row per reading, in
    reading order, for tables in which repeated readings are meant.
    """
    reading = "cash_id" if "cash_id" in cash.columns else "remaining_cash"
    days = _with_day(cash, "timestamp")
    if keep_all_readings:
        return days.select(*DAY_KEYS, F.col("remaining_cash").alias("ending_cash_balance"), F.col(reading).alias("reading"))
    is_day = dict(cash.dtypes)["timestamp"] == "date"
    order = F.col(reading) if is_day else F.struct("timestamp", reading)
    return days.groupBy(*DAY_KEYS).agg(F.max_by("remaining_cash", order).alias("ending_cash_balance"))


def starting_balance(days: DataFrame) -> DataFrame:
    """A day starts with the previous row's ending balance; the first row with its own.

    With a row per reading a machine's history has no bound, so it is looked through in ranges.
    """
    if "reading" in days.columns:
        rows = previous_value(days, "ending_cash_balance", ["record_date", "reading"])
        return rows.withColumn("starting_cash_balance", F.coalesce("_previous", "ending_cash_balance")).drop("_previous")
    previous = F.lag("ending_cash_balance").over(Window.partitionBy("atm_id").orderBy("record_date", "ending_cash_balance"))
    return days.withColumn("starting_cash_balance", F.coalesce(previous, F.col("ending_cash_balance")))


def cash_balances(cash: DataFrame, keep_all_readings: bool = False) -> DataFrame:
    return starting_balance(cash_days(cash, keep_all_readings)).drop("reading")


def add_uptime(days: DataFrame) -> DataFrame:
    up = F.lit(MINUTES_PER_DAY) - clip("downtime_duration", 0, MINUTES_PER_DAY)
    return days.withColumn("uptime_minutes", up).withColumn(
        "uptime_percentage", F.col("uptime_minutes") / MINUTES_PER_DAY * 100
    )


def latest_service(maintenance: DataFrame) -> DataFrame:
    """Day of the last service per machine: the latest overall, not the latest before a row."""
    return (
        _with_day(maintenance, "maintenance_date")
        .groupBy("atm_id")
        .agg(F.max("record_date").alias("service_date"))
    )


def as_date(day) -> Column:
    """A day given as text, date or column."""
    return day if isinstance(day, Column) else F.lit(str(day) if isinstance(day, dt.date) else day).cast("date")


def window_start(frame: DataFrame, days: int, anchor=None) -> Column:
    """First day of the range: ``days`` before the anchor, or before the newest day of ``frame``.

    A literal anchor reaches the file scan as a pushed filter. Without one the newest day is a
    scalar subquery (one row), evaluated once before the filter.
    """
    newest = as_date(anchor) if anchor is not None else frame.agg(F.max("record_date")).scalar()
    return F.date_sub(newest, days)


def newest_days(cash: DataFrame) -> DataFrame:
    """The days of the balance readings, for finding the newest one in a single narrow scan."""
    return _with_day(cash, "timestamp").select("record_date")


def last_n_days(daily: DataFrame, days: int, anchor=None) -> DataFrame:
    """Rows from ``days`` before the newest day on; the bound counts too, so days + 1 dates."""
    return daily.filter(F.col("record_date") >= window_start(daily, days, anchor))


def since_as_of(daily: DataFrame, days: int, as_of) -> DataFrame:
    """The same, anchored at a given day instead of the newest row."""
    return daily.filter(F.col("record_date") >= F.date_sub(as_date(as_of), days))


def _facts(cash: DataFrame, tx: DataFrame, logs: DataFrame) -> DataFrame:
    """The rows of the three tables in one narrow shape; each fills its own columns."""
    amount = _amount(tx) if "transaction_type" in tx.columns else F.col("withdrawal_amount")
    sales = _with_day(tx, "transaction_time")
    if "transaction_type" in tx.columns:
        out, into = _kind()
        sales = sales.filter(out | into)
    else:
        out, into = F.lit(True), F.lit(False)
    reading = "cash_id" if "cash_id" in cash.columns else "remaining_cash"
    is_day = dict(cash.dtypes)["timestamp"] == "date"
    order = F.struct(reading) if is_day else F.struct("timestamp", reading)
    parts = [
        _with_day(cash, "timestamp").select(
            *DAY_KEYS, F.lit(True).alias("read"), order.alias("reading"), F.col("remaining_cash").alias("balance")
        ),
        sales.select(
            *DAY_KEYS, out.alias("out"), F.when(out, amount).alias("withdrawn"), into.alias("into"),
            F.when(into, amount).alias("deposited"),
        ),
        _with_day(logs, "timestamp").select(
            *DAY_KEYS, (F.col("uptime_status") == 0).alias("failed"), F.col("downtime_duration").alias("down")
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def _days_from_facts(facts: DataFrame) -> DataFrame:
    """One aggregation for balances, transactions and logs; days without a balance reading drop out."""
    return (
        facts.groupBy(*DAY_KEYS)
        .agg(
            F.max("read").alias("_read"),
            F.max_by("balance", "reading").alias("ending_cash_balance"),
            F.count_if("out").alias("transaction_count"),
            _zero_if_null(F.sum("withdrawn")).alias("daily_withdrawal_amount"),
            _zero_if_null(F.avg("withdrawn")).alias("avg_transaction_amount"),
            F.count_if("into").alias("daily_deposit_count"),
            _zero_if_null(F.sum("deposited")).alias("daily_deposit_amount"),
            F.count_if("failed").alias("error_count"),
            _zero_if_null(F.sum("down"), 0).cast("long").alias("downtime_duration"),
        )
        .filter("_read")
        .drop("_read")
    )


def daily_metrics(
    cash: DataFrame,
    tx: DataFrame,
    logs: DataFrame,
    maintenance: DataFrame | None = None,
    *,
    days: int | None = None,
    anchor=None,
    keep_all_readings: bool = False,
    keep_reading_order: bool = False,
) -> DataFrame:
    """The machine-day table. Balance readings are the spine: a day without one has no row.

    The three tables are brought to one shape and aggregated together, with map-side combine: one
    shuffle by (machine, day) instead of three and two joins. The previous balance and everything
    later needs the rows by machine only, so that table is shuffled by machine once. With
    ``keep_all_readings`` a day has a row per reading, and the daily figures are joined to them;
    ``keep_reading_order`` leaves the column ``reading`` in, which tells a day's rows apart.

    With ``days`` the other tables are cut to the range before they are aggregated. Balances
    are not: the first day of the range starts with the balance of the day before it.
    """
    if days is not None:
        start = window_start(newest_days(cash), days, anchor)
        tx = tx.filter(F.to_date("transaction_time") >= start)
        logs = logs.filter(F.to_date("timestamp") >= start)
    if keep_all_readings:
        spine = cash_days(cash, keep_all_readings)
        joined = spine.join(transactions_daily(tx), DAY_KEYS, "left").join(logs_daily(logs), DAY_KEYS, "left")
        whole = ["transaction_count", "daily_deposit_count", "error_count", "downtime_duration"]
        amounts = ["daily_withdrawal_amount", "daily_deposit_amount", "avg_transaction_amount"]
        daily = joined.withColumns(
            {c: _zero_if_null(F.col(c), 0).cast("long") for c in whole} | {c: _zero_if_null(F.col(c)) for c in amounts}
        )
    else:
        daily = _days_from_facts(_facts(cash, tx, logs))
    daily = daily.transform(starting_balance).transform(add_uptime)
    if not keep_reading_order:
        daily = daily.drop("reading")
    if maintenance is not None:
        daily = with_latest_service(daily, maintenance)
    if days is not None:
        daily = daily.filter(F.col("record_date") >= start)
    return daily


def with_latest_service(metrics: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Each row gets its machine's latest service day, null where there is none.

    No broadcast hint: the right side has a row per machine, and the adaptive planner
    broadcasts it only where its measured size allows.
    """
    return metrics.drop("service_date").join(latest_service(maintenance), "atm_id", "left")


def latest_per_machine(rows: DataFrame, *tie: str) -> DataFrame:
    """The newest row of each machine; candidates are pruned to one per task before the shuffle."""
    w = Window.partitionBy("atm_id").orderBy(F.desc("record_date"), *[F.desc(c) for c in tie])
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def fleet_snapshot(daily: DataFrame, master: DataFrame, days: int = 30, anchor=None) -> DataFrame:
    """Newest row per machine of the last ``days`` days with its master record, if it has one."""
    recent = last_n_days(daily, days, anchor)
    return latest_per_machine(recent, "ending_cash_balance").join(master, "atm_id", "left")


def fleet_snapshot_sql(daily: DataFrame, master: DataFrame) -> DataFrame:
    """Every row of a machine's newest day, machines with a master record only, no day limit."""
    return daily.sparkSession.sql(
        """
        SELECT am.*, adm.* EXCEPT (atm_id)
        FROM {master} am
        JOIN {daily} adm ON am.atm_id = adm.atm_id
        WHERE adm.record_date = (SELECT max(d.record_date) FROM {daily} d WHERE d.atm_id = am.atm_id)
        """,
        master=master,
        daily=daily,
    )


def machines(daily: DataFrame) -> DataFrame:
    return daily.select("atm_id").distinct()
