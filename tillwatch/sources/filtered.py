"""Appending new rows where most of an upload is new: a filter per day tells which days must be read.

A filter is a Bloom filter in words of 64 bits: a row's hash chooses a word and four bits in it. It has a
bounded size per day, is merged by a bitwise or, and is tested with an equi-join on (day, word), so nothing
of it passes through the driver. A row that the filter does not hold is certainly new. Only days with a possible
repeat are read, and there the rows themselves decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwatch.session import Stored, file_system
from tillwatch.sources.day_table import NO_DAY, DayTable
from tillwatch.sources.ingest import DAY_PARTITION, rows_not_in

WORDS = 1 << 16  # words of a day's filter: 400,000 rows a day give about two false hits in a hundred
_BITS = 4


@dataclass(frozen=True)
class Appended:
    rows_added: int
    days_touched: list[str]
    days_read: list[str]


def _marked(rows: DataFrame, columns: list[str], words: int) -> DataFrame:
    """Rows with their word and the mask of their bits in it.

    Columns are hashed in the order of their names and nulls leave a hash as it is, so a column that only
    later uploads have does not change the hash of a row without it.
    """
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)])
    bits = [F.shiftright("_hash", 20 + 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(_BITS)]
    mask = F.lit(0).cast("long")
    for bit in bits:
        mask = mask.bitwiseOR(F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]), bit + 1))
    marked = rows.withColumn("_hash", h).withColumn("_mask", mask)
    return marked.withColumn("_word", F.pmod(F.xxhash64("_hash"), F.lit(words))).drop("_hash")


class FilteredTable:
    """A day-partitioned table at ``path`` with its filters beside it. Tables that were written without
    filters are taken on: a day without a filter counts as one with a possible repeat."""

    def __init__(self, spark: SparkSession, path: str, time_column: str | None, words: int = WORDS):
        self.spark, self.path, self.time_column, self.words = spark, path.rstrip("/"), time_column, words
        schema = StructType.fromDDL(f"{DAY_PARTITION}_of string, word long, bits long")
        self.filters = DayTable(spark, f"{self.path}-filters", schema, key=F.col(f"{DAY_PARTITION}_of"))

    def _stored_days(self) -> set[str]:
        where, system = file_system(self.spark, self.path)
        if not system.exists(where):
            return set()
        names = [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()]
        days = {n.removeprefix(f"{DAY_PARTITION}=") for n in names if n.startswith(f"{DAY_PARTITION}=")}
        return {NO_DAY if d == "__HIVE_DEFAULT_PARTITION__" else d for d in days}

    def _read(self, days: list[str]) -> DataFrame:
        table = self.spark.read.option("mergeSchema", True).parquet(self.path)
        table = table.withColumn(DAY_PARTITION, F.col(DAY_PARTITION).cast("date"))
        own = F.col(DAY_PARTITION).isin([F.lit(d).cast("date") for d in days if d != NO_DAY])
        return table.filter(own | F.col(DAY_PARTITION).isNull() if NO_DAY in days else own)

    def append(self, new: DataFrame) -> Appended:
        """Append the rows that the table does not hold yet.

        The filters take the rows in before the table does: if the job breaks off between, they
        hold too much, which costs a look at a day and never a row.
        """
        day = F.to_date(self.time_column) if self.time_column else F.lit(None).cast("date")
        of_day = F.coalesce(day.cast("string"), F.lit(NO_DAY))
        distinct = _marked(new.dropDuplicates(), new.columns, self.words).withColumns({DAY_PARTITION: day, f"{DAY_PARTITION}_of": of_day})
        key = [f"{DAY_PARTITION}_of"]
        with Stored(distinct, "upload") as rows:
            touched = sorted(r[0] for r in rows.select(key[0]).distinct().collect())  # one per calendar day
            known = self.filters.read(touched).select(key[0], F.col("word").alias("_word"), "bits")
            met = rows.join(known, [key[0], "_word"], "left")
            possible = F.coalesce(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
            hits = [r[0] for r in met.filter(possible).select(key[0]).distinct().collect()]
            without = (self._stored_days() - set(self.filters.manifest()["days"])) & set(touched)
            days = sorted(set(hits) & self._stored_days() | without)
            if days:
                old = self._read(days)
                again = F.col(key[0]).isin(days)
                seen, unseen = (rows.filter(c).drop("_word", "_mask", key[0]) for c in (again, ~again))
                fresh = rows_not_in(seen, old).unionByName(unseen)
            else:
                old, fresh = None, rows.drop("_word", "_mask", key[0])
            with Stored(fresh, "new-rows") as fresh:
                added = fresh.count()
                if added:
                    self._remember(rows, old.filter(self._of(old).isin(sorted(without))) if without else None, touched)
                    fresh.write.mode("append").partitionBy(DAY_PARTITION).parquet(self.path)
        return Appended(added, touched, days)

    @staticmethod
    def _of(table: DataFrame) -> Column:
        return F.coalesce(F.col(DAY_PARTITION).cast("string"), F.lit(NO_DAY))

    def _remember(self, rows: DataFrame, unfiltered: DataFrame | None, days: list[str]) -> None:
        """Merge the rows, and what lies in days without a filter, into the filters of the touched days."""
        parts = rows.select(f"{DAY_PARTITION}_of", F.col("_word").alias("word"), F.col("_mask").alias("bits"))
        if unfiltered is not None:
            own = [c for c in unfiltered.columns if c != DAY_PARTITION]
            old = _marked(unfiltered, own, self.words).withColumn(f"{DAY_PARTITION}_of", self._of(unfiltered))
            parts = parts.unionByName(old.select(f"{DAY_PARTITION}_of", F.col("_word").alias("word"), F.col("_mask").alias("bits")))
        merged = self.filters.read(days).unionByName(parts).groupBy(f"{DAY_PARTITION}_of", "word").agg(F.bit_or("bits").alias("bits"))
        self.filters.replace(merged, days)
