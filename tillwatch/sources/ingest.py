"""Taking new rows in: type detection, append with de-duplication, upsert, merge, CSV output."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.schemas import DAILY_METRICS, RAW_TABLES
from tillwatch.session import Stored, path_exists
from tillwatch.sources.day_table import DayTable

# The columns by which an uploaded table is recognised, in order of precedence.
TABLE_SIGNATURES = {
    "cash_status": {"atm_id", "timestamp", "remaining_cash"},
    "operational_logs": {"atm_id", "timestamp", "uptime_status"},
    "transactions": {"atm_id", "transaction_time", "withdrawal_amount"},
    "maintenance_records": {"atm_id", "maintenance_date", "maintenance_type"},
    "atm_metadata": {"atm_id", "atm_bank", "location", "atm_model"},
}
# Columns of the ready-aggregated upload format.
LEGACY_METRICS_COLUMNS = [
    "atm_id", "record_date", "uptime_percentage", "error_count", "transaction_count",
    "starting_cash_balance", "ending_cash_balance",
]


def table_type(columns: Iterable[str]) -> str:
    """Name the kind of table from its column names; an unknown layout is an error."""
    present = set(columns)
    for name, needed in TABLE_SIGNATURES.items():
        if needed <= present:
            return name
    if set(LEGACY_METRICS_COLUMNS) <= present:
        return "legacy_metrics"
    raise ValueError(
        f"unrecognised columns {sorted(present)}; accepted: {list(TABLE_SIGNATURES)} "
        f"or daily metrics with {LEGACY_METRICS_COLUMNS}"
    )


def coerce_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text to double, null where it does not parse."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def coerce_dates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text to date, null where it does not parse."""
    return df.withColumns({c: F.col(c).try_cast("date") for c in columns if c in df.columns})


def add_missing_columns(df: DataFrame, columns: Iterable[str], value=0) -> DataFrame:
    missing = [c for c in dict.fromkeys(columns) if c not in df.columns]
    return df.withColumns({c: F.lit(value) for c in missing}) if missing else df


def append_distinct(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both inputs together without exact duplicate rows; columns only one side has become null.

    ``dropDuplicates`` is a hash aggregate, so copies of a row shrink to one before the shuffle.
    """
    return existing.unionByName(new, allowMissingColumns=True).dropDuplicates()


def appended_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Row count of the result less that of the old table (negative if the old one held duplicates)."""
    before = existing.agg(F.count("*")).scalar()
    counts = append_distinct(existing, new).agg(F.count("*").alias("rows_after")).withColumn("rows_before", before)
    return counts.withColumn("rows_added", F.col("rows_after") - F.col("rows_before"))


def typed_by(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns in the types of a table; a cell that does not parse becomes null, never an error."""
    known = {f.name: f.dataType.simpleString() for f in schema}
    return df.withColumns({c: F.col(c).try_cast(known[c]) for c in df.columns if c in known})


def rows_not_in(new: DataFrame, old: DataFrame) -> DataFrame:
    """Distinct rows of ``new`` that ``old`` does not hold; nulls are equal, columns only one side has are null.

    Both sides meet on a hash of the whole row, and the row itself decides.
    """
    new = new.dropDuplicates()
    columns = list(dict.fromkeys([*new.columns, *old.columns]))
    pad = lambda df: [F.col(c) if c in df.columns else F.lit(None) for c in columns]
    held = old.select(F.xxhash64(*pad(old)).alias("_hash"), F.struct(*[c.alias(n) for n, c in zip(columns, pad(old))]).alias("_row"))
    own = new.withColumns({"_new_hash": F.xxhash64(*pad(new)), "_new_row": F.struct(*[c.alias(n) for n, c in zip(columns, pad(new))])})
    same = (F.col("_new_hash") == F.col("_hash")) & F.col("_new_row").eqNullSafe(F.col("_row"))
    return own.join(held, same, "left_anti").drop("_new_hash", "_new_row")


DAY_PARTITION = "_day"


def read_table(spark: SparkSession, target: str) -> DataFrame:
    """A day-partitioned table without its partition column."""
    return spark.read.option("mergeSchema", True).parquet(target).drop(DAY_PARTITION)


def append_new_rows(new: DataFrame, target: str, time_column: str | None) -> int:
    """Append the rows that the table at ``target`` does not hold yet; returns their number.

    The table is partitioned by day, and only the days of the upload are read. Nothing is rewritten.
    Equal rows have the same day, so no other day can hold a copy.
    """
    spark = new.sparkSession
    day = F.to_date(time_column) if time_column else F.lit(None).cast("date")
    fresh = new.dropDuplicates().withColumn(DAY_PARTITION, day)
    if path_exists(spark, target):
        old = spark.read.option("mergeSchema", True).parquet(target)
        days = fresh.select(F.col(DAY_PARTITION).alias("_touched")).distinct()
        old = old.join(days, F.col(DAY_PARTITION).eqNullSafe(F.col("_touched")), "left_semi")
        fresh = rows_not_in(fresh, old.withColumn(DAY_PARTITION, F.col(DAY_PARTITION).cast("date")))
    with Stored(fresh, "upload") as rows:  # counted and written from one result
        added = rows.count()
        if added:
            rows.write.mode("append").partitionBy(DAY_PARTITION).parquet(target)
    return added


TIME_COLUMNS = {
    "cash_status": "timestamp", "operational_logs": "timestamp", "transactions": "transaction_time",
    "maintenance_records": "maintenance_date", "atm_metadata": None, "legacy_metrics": "record_date",
}


def upload_csv(spark: SparkSession, new_path: str, tables_dir: str, retrain: Callable[[], object] | None = None) -> dict:
    """One upload as a user runs it: find the table, type the cells, append what is new, retrain if asked.

    Returns the table's name, the number of rows added and the status: ``partial`` when the rows are in
    but the training failed.
    """
    incoming = spark.read.option("header", True).csv(new_path)
    name = table_type(incoming.columns)
    typed = typed_by(incoming, DAILY_METRICS if name == "legacy_metrics" else RAW_TABLES[name])
    result = {"table": name, "rows_added": append_new_rows(typed, f"{tables_dir}/{name}", TIME_COLUMNS[name]), "status": "ok"}
    if retrain is not None:
        try:
            retrain()
        except Exception as error:  # the upload stands whatever the training does
            result |= {"status": "partial", "error": str(error)}
    return result


def merge_first_source(sources: list[DataFrame], key: str, tie: list[str] | None = None) -> DataFrame:
    """Union of the sources with one row per key, taken from the first source that has it.

    The ranking prunes to one candidate per key and map task before the shuffle
    (WindowGroupLimit), so a key with very many copies does not pile up in one task.
    """
    ranked = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    merged = ranked[0]
    for other in ranked[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    order = ["_source", *(tie or [c for c in merged.columns if c not in (key, "_source")])]
    w = Window.partitionBy(key).orderBy(*order)
    return merged.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_source")


METRIC_VALUES = [
    "uptime_percentage", "error_count", "transaction_count", "starting_cash_balance", "ending_cash_balance",
]


def upsert_daily(base: DataFrame, update: DataFrame, order: str) -> DataFrame:
    """Update rows replace the five metric values of the same (machine, day); new days are added.

    The last update row of a key by ``order`` wins, also where it holds nulls. A frame has no order of
    its own, so the column must be named. Other base columns stay as they are.
    """
    keys = ["atm_id", "record_date"]
    newest = F.max_by(F.struct(*METRIC_VALUES), F.struct(order, *METRIC_VALUES))
    last = update.groupBy(*keys).agg(newest.alias("_last")).select(*keys, "_last.*")
    if set(base.columns) == {*keys, *METRIC_VALUES}:
        kept = base.join(last.select(*keys), keys, "left_anti")
        return kept.unionByName(last)
    u = last.withColumn("_hit", F.lit(True)).withColumnsRenamed({c: f"_new_{c}" for c in METRIC_VALUES})
    joined = base.join(u, keys, "full_outer")
    values = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in METRIC_VALUES}
    return joined.withColumns(values).select(*base.columns)


def write_upsert(table: DayTable, update: DataFrame, order: str) -> int:
    """Upsert into a stored table; returns its new version.

    Only the days of the update are read and written. They change together or, where any task of
    the write fails for good, not at all.
    """
    with Stored(update, "upsert") as rows:  # read for its days and for its rows
        days = table.keys_of(rows)
        return table.replace(upsert_daily(table.read(days), rows, order), days) if days else table.manifest()["version"]


def format_time(df: DataFrame, column: str, with_seconds: bool) -> DataFrame:
    pattern = "yyyy-MM-dd HH:mm:ss" if with_seconds else "yyyy-MM-dd"
    return df.withColumn(column, F.date_format(column, pattern))


def write_raw_csv(df: DataFrame, path: str, time_column: str, with_seconds: bool = True) -> None:
    """CSV sorted by machine and time inside each file, times as text in one format."""
    out = df.repartition("atm_id", F.to_date(time_column)).sortWithinPartitions("atm_id", time_column)
    format_time(out, time_column, with_seconds).write.option("header", True).csv(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, keyed by its machine."""
    return df.select("atm_id", F.to_json(F.struct(*df.columns)).alias("json"))
