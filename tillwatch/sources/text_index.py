"""Search for a piece of text in a large master: posting lists of trigrams, then ``contains``.

A text that contains the wanted one holds all of its trigrams. The lists lie in folders by the trigram's hash and
the rows in folders by the id's hash, so a search opens the folders of its own trigrams, and of the rows that
have all of them. The rows themselves decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
BUCKETS = 64


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none of a shorter or missing one."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM))))


class TextIndex:
    """An index over some text columns of a master whose ``id_col`` may repeat."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], id_col: str = "atm_id", buckets: int = BUCKETS):
        self.spark, self.path, self.columns, self.id_col, self.buckets = spark, path, list(columns), id_col, buckets

    def build(self, master: DataFrame) -> "TextIndex":
        """Write rows and lists. A frequent trigram's list is dealt over tasks by the id."""
        placed = master.withColumn("_bucket", _bucket(F.col(self.id_col), self.buckets))
        placed.repartition("_bucket", self.id_col).write.partitionBy("_bucket").parquet(f"{self.path}/rows")
        grams = F.explode(F.array_distinct(F.concat(*[F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in self.columns])))
        lists = master.select(F.col(self.id_col).alias("id"), grams.alias("gram")).distinct()
        lists = lists.withColumn("_bucket", _bucket(F.col("gram"), self.buckets))
        part = F.pmod(F.xxhash64("id"), F.lit(4))
        lists.repartition("_bucket", part).sortWithinPartitions("_bucket", "gram", "id").write.partitionBy("_bucket").parquet(f"{self.path}/lists")
        return self

    def _buckets_of(self, values: list[str]) -> list[int]:
        found = self.spark.createDataFrame([(v,) for v in values], "v string").select(_bucket(F.col("v"), self.buckets)).distinct()
        return sorted(r[0] for r in found.collect())

    def candidates(self, text: str) -> DataFrame | None:
        """(id) of the rows that hold all trigrams of the text; None where it is too short to have one."""
        low = text.lower()
        wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not wanted:
            return None
        lists = self.spark.read.parquet(f"{self.path}/lists").filter(F.col("_bucket").isin(self._buckets_of(wanted)))
        met = lists.filter(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n"))
        return met.filter(F.col("n") == len(wanted)).select("id")

    def search(self, text: str) -> DataFrame:
        """The master's rows of which some indexed column contains the text, in any case of letters."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        own = [c for c in rows.columns if c != "_bucket"]
        ids = self.candidates(text)
        if ids is not None:
            folders = [r[0] for r in ids.select(_bucket(F.col("id"), self.buckets)).distinct().collect()]  # at most BUCKETS
            rows = rows.filter(F.col("_bucket").isin(folders)).join(ids, rows[self.id_col] == ids["id"], "left_semi")
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        return rows.filter(hit).select(*own)
