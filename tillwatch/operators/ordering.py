"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.session import store

_LOW_BITS = 2**33 - 1


def running_offsets(keys: DataFrame, order: str, weight: str) -> DataFrame:
    """Per key: rank in the global order (``key_rank``, 0-based), the sum of ``weight`` of all keys
    before it (``row_offset``) and of all keys (``row_count``).

    ``keys`` has one row per ``order`` value. It is range-sorted, its rows are tagged with their
    partition, and the tagged rows are stored so that the tags cannot change on a retry. Only
    one total per partition is then summed up globally, and the partition number bounds that.
    """
    tagged = keys.orderBy(order).withColumn("_tag", F.monotonically_increasing_id())
    tagged = store(tagged.withColumn("_part", F.shiftright("_tag", 33)), "offsets")
    totals = tagged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    # One row per partition of the sort: at most spark.sql.shuffle.partitions rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"),
        F.sum("_w").over(everything).alias("row_count"),
    )
    inside = Window.partitionBy("_part").orderBy("_tag").rowsBetween(Window.unboundedPreceding, -1)
    return tagged.join(F.broadcast(starts), "_part").select(
        order,
        (F.col("_n0") + F.col("_tag").bitwiseAND(_LOW_BITS)).alias("key_rank"),
        (F.col("_w0") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).alias("row_offset"),
        "row_count",
    )


def row_positions(rows: DataFrame, *tie: str) -> DataFrame:
    """0-based position of every row in the (machine, day) order of the table, and the table's size."""
    counts = rows.groupBy("atm_id").agg(F.count("*").alias("_rows"))
    offsets = running_offsets(counts, "atm_id", "_rows").drop("key_rank")
    w = Window.partitionBy("atm_id").orderBy("record_date", *tie)
    return (
        rows.withColumn("_in_machine", F.row_number().over(w) - 1)
        .join(offsets, "atm_id")
        .withColumn("row_index", F.col("row_offset") + F.col("_in_machine"))
        .drop("_in_machine", "row_offset")
    )
