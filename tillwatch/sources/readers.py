"""Readers: typed CSV, machine master, maintenance log, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.schemas import RAW_TABLES
from tillwatch.sources.ingest import merge_first_source


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType, corrupt_column: str | None = None) -> DataFrame:
    """One CSV table; its header line says which columns there are, and in which order.

    Only that line is read beforehand. Columns of the schema get their declared type, others stay
    text, absent ones stay absent. Files of a folder whose header differs from the first one's are
    refused, not read by position. ``corrupt_column`` names a column for lines that do not parse.
    """
    names = spark.read.option("header", True).csv(path).columns
    if "atm_id" not in names:
        raise ValueError(f"{path} has no column atm_id but {names}; is there a header line?")
    known = {f.name: f for f in schema}
    fields = [known.get(name, T.StructField(name, T.StringType())) for name in names]
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if corrupt_column is not None:
        fields.append(T.StructField(corrupt_column, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.schema(T.StructType(fields)).csv(path)


def read_raw_tables(spark: SparkSession, raw_dir: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The five raw tables of a folder, as CSV files or as parquet."""
    if fmt == "csv":
        return {n: read_raw_csv(spark, f"{raw_dir}/{n}.csv", s) for n, s in RAW_TABLES.items()}
    return {n: spark.read.format(fmt).load(f"{raw_dir}/{n}") for n in RAW_TABLES}


RECORD_IDS = {
    "cash_status": "cash_id", "operational_logs": "log_id", "transactions": "transaction_id",
    "maintenance_records": "maintenance_id", "atm_metadata": "atm_id",
}


def merge_raw_and_backup(raw: dict[str, DataFrame], backup: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All five tables from a raw and a backup folder: one row per record id, the raw one first.

    Where a table has no id column on both sides, rows count as the same when they are equal.
    """
    merged = {}
    for name, key in RECORD_IDS.items():
        sides = [t[name] for t in (raw, backup) if name in t]
        if all(key in s.columns for s in sides):
            merged[name] = merge_first_source(sides, key)
        else:
            both = sides[0]
            for other in sides[1:]:
                both = both.unionByName(other, allowMissingColumns=True)
            merged[name] = both.dropDuplicates()
    return merged


def machine_master(master: DataFrame, atm_id: str | None = None) -> DataFrame:
    return master if atm_id is None else master.filter(F.col("atm_id") == atm_id)


def maintenance_log(maintenance: DataFrame, atm_id: str | None = None, newest_first: bool = True) -> DataFrame:
    """Maintenance records with ``service_date`` as the name of the event time."""
    log = maintenance.withColumnRenamed("maintenance_date", "service_date")
    if atm_id is not None:
        log = log.filter(F.col("atm_id") == atm_id)
    return log.orderBy(F.desc("service_date"), "maintenance_id") if newest_first else log


def daily_metrics_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "atm_daily_metrics",
    *,
    since: str | None = None,
    atm_id: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    num_partitions: int = 16,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Daily metrics from a database. The two filters reach the database as WHERE clauses.

    Without a column and bounds to split by, one task would read the whole table; that is allowed only
    for ``num_partitions=1``, said by the caller.
    """
    if not (partition_column and bounds) and num_partitions != 1:
        raise ValueError("give partition_column and bounds, or num_partitions=1 for a small table")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", num_partitions)
        )
    return select_metrics(reader.load(), since=since, atm_id=atm_id)


def select_metrics(daily: DataFrame, *, since: str | None = None, atm_id: str | None = None) -> DataFrame:
    """The parameters of a metrics read, as plain filters that any source can push down."""
    if since is not None:
        daily = daily.filter(F.col("record_date") >= F.lit(since).cast("date"))
    if atm_id is not None:
        daily = daily.filter(F.col("atm_id") == atm_id)
    return daily
