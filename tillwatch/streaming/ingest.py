"""Stream jobs: file ingest with de-duplication, and the daily transaction roll-up.

Each returns a started query; with ``available_now`` it ends when the files at hand are done.
Checkpoints live in the shared folder, so a restarted job goes on where the last one stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tillwatch.operators.features import HOLIDAYS, features
from tillwatch.operators.rollup import DEPOSIT_TYPES, PARTIAL_DAY, WITHDRAWAL_TYPES, merged_days, partial_days
from tillwatch.session import Stored
from tillwatch.sources.day_table import DayTable
from tillwatch.sources.ingest import append_new_rows

KEYS = ["atm_id"]


FILES_PER_TRIGGER = 1000


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = FILES_PER_TRIGGER) -> DataFrame:
    """New files of a folder as a stream, some at a time. The schema is given, streams do not infer one."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    return reader.option("header", True).load(path) if fmt == "csv" else reader.load(path)


def with_event_time(rows: DataFrame, column: str, lateness: str) -> DataFrame:
    """Watermarks need an instant, so a zone-less time is taken as session time."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def distinct_rows(rows: DataFrame, key: str, time_column: str, lateness: str = "1 day") -> DataFrame:
    """First arrival of every key; repeats within the lateness are dropped, and so is their state after it."""
    return with_event_time(rows, time_column, lateness).dropDuplicatesWithinWatermark([key])


def daily_transactions(tx: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Withdrawals and deposits per machine and day; a day is emitted once it is closed."""
    kind = F.lower("transaction_type")
    out, into = kind.isin(WITHDRAWAL_TYPES), kind.isin(DEPOSIT_TYPES)
    return (
        with_event_time(tx, "transaction_time", lateness)
        .filter(F.col("atm_id").isNotNull() & (out | into))
        .groupBy("atm_id", F.window("transaction_time", "1 day"))
        .agg(
            F.count_if(out).alias("transaction_count"),
            F.coalesce(F.sum(F.when(out, F.col("amount"))), F.lit(0.0)).alias("daily_withdrawal_amount"),
            F.coalesce(F.avg(F.when(out, F.col("amount"))), F.lit(0.0)).alias("avg_transaction_amount"),
            F.count_if(into).alias("daily_deposit_count"),
            F.coalesce(F.sum(F.when(into, F.col("amount"))), F.lit(0.0)).alias("daily_deposit_amount"),
        )
        .withColumn("record_date", F.to_date("window.start"))
        .drop("window")
    )


def append_to(rows: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(target)


def ingest_all(rows: DataFrame, target: str, checkpoint: str, time_column: str) -> StreamingQuery:
    """Append every distinct row once, however late it comes.

    A watermark would drop late rows. Here each batch is compared with the table itself, of which only
    the batch's days are read; a batch that is repeated after a failure finds its rows there.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        append_new_rows(batch, target, time_column)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def daily_sums(spark: SparkSession, path: str) -> DayTable:
    """The stored sums that ``roll_up_late`` keeps."""
    return DayTable(spark, path, StructType.fromDDL(PARTIAL_DAY))


def roll_up_late(tx: DataFrame, sums: DayTable, checkpoint: str, source: str = "transactions") -> StreamingQuery:
    """Daily figures that every transaction reaches, however late it comes.

    There is no watermark and no state in the stream. A batch is reduced to sums per machine and day, which are
    added to the stored ones of the days it touches; other days are neither read nor written. The version
    that holds a batch also holds its number, so a batch that is repeated after a failure is not added
    twice. The rows themselves must be distinct, as ``ingest_all`` leaves them.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        if sums.manifest()["applied"].get(source, -1) >= batch_id:
            return
        with Stored(partial_days(batch), "partial-days") as fresh:
            days = sums.keys_of(fresh)
            sums.replace(merged_days(sums.read(days).unionByName(fresh)), days, {source: batch_id})

    writer = tx.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def refresh_features(changed: DataFrame, daily: DataFrame, target: str, checkpoint: str, holidays=HOLIDAYS) -> StreamingQuery:
    """Recompute the features of the machines named in each batch, from the whole daily table.

    Row frames and lag are not defined on streams, so this runs as a batch per trigger. Batch
    folders carry the batch number: a repeated batch overwrites its own output only.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(*KEYS).distinct()
        recent = daily.join(touched, KEYS, "left_semi")
        features(recent, holidays).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = changed.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current_features(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of each machine's rows among the batches that ``refresh_features`` wrote."""
    versions = spark.read.parquet(target)
    newest = versions.groupBy("atm_id").agg(F.max("batch").alias("batch"))
    return versions.join(newest, ["atm_id", "batch"], "left_semi").drop("batch")
