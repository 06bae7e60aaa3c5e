"""The raw tables, derived from the star-schema test tables.

``events`` acts as the log of a fleet (user = machine), ``customer`` and ``nation`` as the
machine master. ``lineitem`` gives a larger machine-day table (supplier = machine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.operators.rollup import add_uptime, starting_balance


# Declared so that opening a table needs no look into its files.
TABLE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(table(spark, sf_dir, "events"))


def event_rows(events: DataFrame) -> DataFrame:
    """Events with the user as machine id and the number inside ``props``. Works on a stream as well."""
    return events.select(
        "event_id", "ts", F.col("user_id").cast("string").alias("atm_id"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def transactions(log: DataFrame) -> DataFrame:
    """Purchases are withdrawals, signups are deposits. Works on a stream as well."""
    return log.filter(F.col("event_type").isin("purchase", "signup")).select(
        F.col("event_id").alias("transaction_id"),
        "atm_id",
        F.col("ts").alias("transaction_time"),
        F.col("value").alias("amount"),
        F.when(F.col("event_type") == "purchase", "withdrawal").otherwise("deposit").alias("transaction_type"),
        F.lit(1).alias("transaction_status"),
    )


def transactions_untyped(log: DataFrame) -> DataFrame:
    return (
        transactions(log)
        .filter(F.col("transaction_type") == "withdrawal")
        .drop("transaction_type")
        .withColumnRenamed("amount", "withdrawal_amount")
    )


def operational_logs(log: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    return log.filter(F.col("event_type").isin("error", "view")).select(
        F.col("event_id").alias("log_id"),
        "atm_id",
        F.col("ts").alias("timestamp"),
        F.when(failed, 0).otherwise(1).alias("uptime_status"),
        F.when(failed, F.col("k").cast("string")).alias("error_code"),
        F.when(failed, F.floor(F.col("value") * 10)).otherwise(0).alias("downtime_duration"),
    )


def cash_status(log: DataFrame) -> DataFrame:
    """The last event of each machine and day is its balance reading (one row per machine-day).

    An aggregate with map-side combine: a busy machine reaches the shuffle as one row per task and day.
    """
    last = F.max(F.struct("ts", "event_id", "value"))
    daily = log.groupBy("atm_id", F.to_date("ts").alias("timestamp")).agg(last.alias("e"))
    return daily.select(
        F.col("e.event_id").alias("cash_id"),
        "atm_id",
        "timestamp",
        F.floor(F.col("e.value") * 1000).cast("double").alias("remaining_cash"),
    )


def cash_readings(log: DataFrame) -> DataFrame:
    """Every event as a balance reading, so that a busy machine has many on one day."""
    return log.select(
        F.col("event_id").alias("cash_id"), "atm_id", F.col("ts").alias("timestamp"),
        F.floor(F.col("value") * 1000).cast("double").alias("remaining_cash"),
    )


def maintenance_records(log: DataFrame) -> DataFrame:
    return log.filter((F.col("event_type") == "error") & (F.col("k") % 10 == 0)).select(
        F.col("event_id").alias("maintenance_id"),
        "atm_id",
        F.col("ts").alias("maintenance_date"),
        F.when(F.col("k") % 20 == 0, "Corrective").otherwise("Preventive").alias("maintenance_type"),
        F.floor(F.col("value") * 100).cast("double").alias("amount_added"),
    )


def atm_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    key = F.col("c_custkey")
    services = F.concat(
        F.lit("Withdrawal, Balance Check"),
        F.when(key % 2 == 0, ", Deposits").otherwise(""),
        F.when(key % 3 == 0, ", Transfer").otherwise(""),
    )
    return (
        table(spark, sf_dir, "customer")
        .join(users, "c_custkey", "left_semi")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.cast("string").alias("atm_id"),
            F.col("c_mktsegment").alias("atm_bank"),
            F.col("n_name").alias("location"),
            F.concat(F.lit("M"), (key % 5).cast("string")).alias("atm_model"),
            services.alias("services"),
            F.lit("Visa, Mastercard").alias("card_types"),
            F.when(F.col("c_acctbal") < 0, "out_of_service").otherwise("in_service").alias("operational_status"),
            (F.lit(17.9) + (key % 100) * F.lit(0.001)).alias("lat"),
            (F.lit(-76.9) + (key % 37) * F.lit(0.002)).alias("lng"),
        )
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    log = event_log(spark, sf_dir)
    return {
        "transactions": transactions(log),
        "operational_logs": operational_logs(log),
        "cash_status": cash_status(log),
        "maintenance_records": maintenance_records(log),
        "atm_metadata": atm_metadata(spark, sf_dir),
    }


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine-day table at ``lineitem`` scale: suppliers as machines, ship days as days."""
    price = F.col("l_extendedprice")
    deposit = F.col("l_returnflag") == "A"
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("atm_id"), F.to_date("l_shipdate").alias("record_date"))
        .agg(
            F.count("*").alias("transaction_count"),
            F.sum(price).alias("daily_withdrawal_amount"),
            F.avg(price).alias("avg_transaction_amount"),
            F.count_if(F.col("l_returnflag") == "R").alias("error_count"),
            (F.sum("l_quantity").cast("long") * 10).alias("downtime_duration"),
            F.count_if(deposit).alias("daily_deposit_count"),
            F.coalesce(F.sum(F.when(deposit, price)), F.lit(0.0)).alias("daily_deposit_amount"),
            F.floor(F.max(price) * 10).cast("double").alias("ending_cash_balance"),
        )
    )
    return daily.transform(starting_balance).transform(add_uptime)
