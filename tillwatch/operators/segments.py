"""Windows over histories of any length: each is cut into ranges that are worked on apart.

Rows are range-sorted by machine and order, so a machine with half of all rows is spread over as many
tasks as its share takes. Inside a range, frames need the rows just before it (copied as a halo), and running figures
need a start value: a prefix over one summary row per machine and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.session import store

SEGMENT = ["atm_id", "_segment"]
_ROW_BITS = 33  # of monotonically_increasing_id: the rest is the partition


def cut(rows: DataFrame, order: Sequence[str], segments: int | None = None) -> DataFrame:
    """The rows with their range (``_segment``), 1-based position in the machine's history (``_pos``), the number of
    its rows before the range (``_start``) and up to its end (``_end``).

    The sorted rows are stored, so that a retried task cannot tag them otherwise. ``order`` should tell a
    machine's rows apart: rows equal in it stay in one range.
    """
    n = segments or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.filter(F.col("atm_id").isNotNull()).repartitionByRange(n, "atm_id", *order)
    tagged = ranged.sortWithinPartitions("atm_id", *order).withColumn("_tag", F.monotonically_increasing_id())
    tagged = store(tagged, "segments").withColumn("_segment", F.shiftright("_tag", _ROW_BITS))
    sizes = tagged.groupBy(*SEGMENT).agg(F.min("_tag").alias("_first"), F.count("*").alias("_rows"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier()), F.lit(0)))
    starts = starts.select(*SEGMENT, "_first", "_start", (F.col("_start") + F.col("_rows")).alias("_end"))
    return tagged.join(starts, SEGMENT).withColumn("_pos", F.col("_start") + F.col("_tag") - F.col("_first") + 1).drop("_tag", "_first")


def earlier():
    """A machine's ranges before the current one, over a table with one row per machine and range: at most
    one row per partition of the sort and machine."""
    return Window.partitionBy("atm_id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)


def with_halo(rows: DataFrame, halo: int) -> DataFrame:
    """The cut rows and, marked ``_halo``, copies of the ``halo`` rows before each range, which may come from
    several short ranges. Only a range's last rows can be wanted, so few rows are copied."""
    later = rows.filter("_start > 0").groupBy("atm_id", F.col("_segment").alias("_to")).agg(
        F.first("_start").alias("_to_start"), F.first("_end").alias("_to_end"), F.floor(F.first("_start") / halo).alias("_block")
    )
    block = F.floor(F.col("_pos") / halo)
    last = rows.filter(F.col("_end") - F.col("_pos") < halo).withColumn("_block", F.explode(F.array(block, block + 1)))
    met = last.join(later, ["atm_id", "_block"]).filter(
        (F.col("_to") > F.col("_segment")) & (F.col("_pos") > F.col("_to_start") - halo) & (F.col("_pos") <= F.col("_to_start"))
    )
    copies = met.withColumns({"_segment": F.col("_to"), "_start": F.col("_to_start"), "_end": F.col("_to_end"), "_halo": F.lit(True)})
    return rows.withColumn("_halo", F.lit(False)).unionByName(copies.drop("_block", "_to", "_to_start", "_to_end"))


def previous_value(rows: DataFrame, column: str, order: Sequence[str], segments: int | None = None) -> DataFrame:
    """The rows with ``_previous``: the value of the machine's row before, over histories of any length."""
    w = Window.partitionBy(*SEGMENT).orderBy("_pos")
    near = with_halo(cut(rows, order, segments), 1).withColumn("_previous", F.lag(column).over(w))
    return near.filter(~F.col("_halo")).drop("_halo", "_segment", "_start", "_end", "_pos")
