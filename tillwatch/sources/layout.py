"""How rows lie in files: sorted over all files, along a Z-order curve, and found again by few of them."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.operators.geo import DEFAULT_RADIUS_KM, box, near_point
from tillwatch.session import file_system
from tillwatch.sources.ingest import format_time

# --- CSV in one order ------------------------------------------------------------------------


def append_sorted_csv(df: DataFrame, path: str, time_column: str, with_seconds: bool = True, files: int | None = None) -> str:
    """Append rows as CSV that is sorted by machine and time over all of its files; returns their folder.

    Files read in the order of their names give the sort, and each call's folder comes behind those
    before it. Ranges end inside a machine where it has many rows, and rows of one time are dealt by
    their hash, so a machine with a third of all rows fills as many files as others together.
    """
    spark = df.sparkSession
    where, system = file_system(spark, path)
    there = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    number = 1 + max((int(n.removeprefix("batch-")) for n in there if n.startswith("batch-")), default=0)
    folder = f"{path.rstrip('/')}/batch-{number:09d}"
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("_mark", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    order = ["atm_id", time_column, "_mark"]
    out = marked.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_mark")
    format_time(out, time_column, with_seconds).write.option("header", True).csv(folder)
    return folder


def read_in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches with ``file`` and ``line``: by these two the rows are in file order."""
    rows = spark.read.schema(schema).option("header", True).csv(f"{path.rstrip('/')}/batch-*")
    return rows.withColumns({"file": F.input_file_name(), "line": F.monotonically_increasing_id()})


# --- newest day from the files' footers ---------------------------------------------------------

_PUSH = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def newest_day_frame(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A plan whose result is the largest value of a date column, taken from the statistics in the footers: no
    row group is read. The settings must hold while the plan is made and run."""
    return spark.read.parquet(path).agg(F.max(column).alias("newest"))


@contextmanager
def footers(spark: SparkSession):
    """Within the block, aggregates of Parquet columns come from the footers where these have them."""
    before = {k: spark.conf.get(k, None) for k in _PUSH}
    try:
        for k, v in _PUSH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def newest_day(spark: SparkSession, path: str, column: str):
    """The newest day of a Parquet table, or None for an empty one: an anchor that ``last_n_days`` can push down."""
    with footers(spark):
        return newest_day_frame(spark, path, column).first()["newest"]


# --- Z-order -------------------------------------------------------------------------------------

_Z_BITS = 16


def _spread(c: Column) -> Column:
    """A 16-bit number with a zero bit in front of each of its bits."""
    steps = [(8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)]
    return reduce(lambda x, s: x.bitwiseOR(F.shiftleft(x, s[0])).bitwiseAND(F.lit(s[1]).cast("long")), steps, c.cast("long"))


def z_key(lat: str = "lat", lng: str = "lng") -> Column:
    """Place on the curve that keeps near points near: the bits of both coordinates in turn; null without one."""
    last = F.lit((1 << _Z_BITS) - 1)
    place = lambda c, low, width: F.floor((F.col(c) - low) / width * (1 << _Z_BITS))
    cell = lambda c, low, width: F.when(F.col(c).isNotNull(), F.least(place(c, low, width), last))
    return F.shiftleft(_spread(cell(lat, -90, 180)), 1).bitwiseOR(_spread(cell(lng, -180, 360)))


def write_by_place(machines: DataFrame, path: str, files: int | None = None) -> None:
    """Write machines along the curve, and an index with one row per file: its box and number of rows.

    Machines without a place come first and last in the order; they lie in files without a box or
    beside others, and no search by distance can find them. Machines at one place are dealt by their id.
    """
    n = files or int(machines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = machines.withColumn("_z", z_key())
    keyed = keyed.repartitionByRange(n, "_z", "atm_id").sortWithinPartitions("_z", "atm_id").drop("_z")
    keyed.write.parquet(f"{path}/rows")
    rows = machines.sparkSession.read.parquet(f"{path}/rows").withColumn("file", F.col("_metadata.file_path"))
    boxes = rows.groupBy("file").agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"),
        F.count("*").alias("rows"),
    )
    boxes.coalesce(1).write.parquet(f"{path}/index")


def files_near(spark: SparkSession, path: str, lat: float, lng: float, radius_km: float = DEFAULT_RADIUS_KM) -> list[str]:
    """The files whose box meets that of the circle; at most one name per file comes to the driver."""
    dlat, dlng = box(lat, radius_km)
    index = spark.read.parquet(f"{path}/index")
    meets = (F.col("north") >= lat - dlat) & (F.col("south") <= lat + dlat)
    if -180 <= lng - dlng and lng + dlng <= 180:
        meets = meets & (F.col("east") >= lng - dlng) & (F.col("west") <= lng + dlng)
    return sorted(r["file"] for r in index.filter(meets).select("file").collect())


def near_point_by_place(spark: SparkSession, path: str, lat: float, lng: float, radius_km: float = DEFAULT_RADIUS_KM) -> DataFrame:
    """``near_point`` over a table that ``write_by_place`` wrote; files beyond the circle's box are not opened."""
    whole = spark.read.parquet(f"{path}/rows")
    files = files_near(spark, path, lat, lng, radius_km)
    rows = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    return near_point(rows, lat, lng, radius_km)
