"""Features from a start value: over ranges of long histories, and over new days of a stored history.

What a row's features need of the rows before it is little: the last 29 rows for the frames, the position,
the last service, the rows at which the current runs began, and a running sum. The weekend ratio looks at the whole
history, so it needs sums over all rows. ``features_in_segments`` takes these from the ranges before,
``FeatureHistory`` from what it stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwatch.functions import clip
from tillwatch.operators.features import (
    HOLIDAYS,
    WORK_COLUMNS,
    clean_position,
    day_columns,
    frame_columns,
    notes_after_service,
    refill_position,
    scores,
    since_service,
)
from tillwatch.operators.segments import SEGMENT, cut, earlier, with_halo
from tillwatch.session import Stored, store
from tillwatch.sources.day_table import DayTable

HALO = 29  # rows before the current one in the longest frame
_WEEK = ["_weekend_rows", "_weekend_known", "_weekend_sum", "_weekday_rows", "_weekday_known", "_weekday_sum"]


def _local(rows: DataFrame, keys: Sequence[str], holidays: Sequence[str]) -> DataFrame:
    """All columns that need only the group's rows and ``_service0``. ``_refill`` and ``_clean`` are null where the run
    began before the group; ``_notes`` starts at zero. Halo rows feed the frames and go."""
    history = Window.partitionBy(*keys).orderBy("_pos")
    so_far = history.rowsBetween(Window.unboundedPreceding, 0)
    new = {
        "_prev_start": F.lag("starting_cash_balance").over(history),
        "_burn": clip(F.col("starting_cash_balance") - F.col("ending_cash_balance"), 0.0),
    }
    if "service_date" in rows.columns:
        new["_service"] = F.coalesce(F.last("service_date", True).over(so_far), F.col("_service0"))
    days = since_service(day_columns(rows, holidays).withColumns(new))
    own_notes = F.when(F.col("_halo"), 0.0).otherwise(notes_after_service())
    return days.withColumns(
        {
            **frame_columns(days.columns, history),
            "_refill": F.last(refill_position(), True).over(so_far),
            "_clean": F.last(clean_position(), True).over(so_far),
            "_notes": F.sum(own_notes).over(so_far),
        }
    ).filter(~F.col("_halo"))


def _week_sums() -> list[Column]:
    tx, weekend = F.col("transaction_count"), F.col("is_weekend") == 1
    parts = [F.count_if(weekend), F.count(F.when(weekend, tx)), F.sum(F.when(weekend, tx)),
             F.count_if(~weekend), F.count(F.when(~weekend, tx)), F.sum(F.when(~weekend, tx))]
    return [p.alias(name) for name, p in zip(_WEEK, parts)]


def _runs(days: DataFrame) -> DataFrame:
    """Run lengths and the running sum from positions over the whole history."""
    first = F.lit(1)
    return days.withColumns(
        {
            "days_since_replenishment": F.col("_pos") - F.coalesce("_refill", first),
            "time_since_last_error": F.col("_pos") - F.coalesce("_clean", first),
            "cumulative_deposit_notes": F.col("_notes"),
        }
    )


def _whole(days: DataFrame) -> DataFrame:
    """The ratio from the sums over the whole history, and what is built from it."""
    weekend = F.when(F.col("_weekend_rows") > 0, F.try_divide("_weekend_sum", "_weekend_known")).otherwise(0.0)
    weekday = F.when(F.col("_weekday_rows") > 0, F.try_divide("_weekday_sum", "_weekday_known")).otherwise(1.0)
    return days.withColumn("weekend_vs_weekday_ratio", F.coalesce(weekend / (weekday + 1), F.lit(1.0))).transform(scores)


def _from_before(local: DataFrame) -> DataFrame:
    """Runs that began before the group, and the sum up to it, join the group's own."""
    return local.withColumns(
        {
            "_refill": F.coalesce("_refill", "_refill0"),
            "_clean": F.coalesce("_clean", "_clean0"),
            "_notes": F.col("_notes") + F.coalesce("_notes0", F.lit(0.0)),
        }
    )


def features_in_segments(daily: DataFrame, holidays: Sequence[str] = HOLIDAYS, order: Sequence[str] = ("record_date", "ending_cash_balance"),
                         segments: int | None = None) -> DataFrame:
    """The columns of ``features`` where a machine's history may have any length.

    ``order`` should tell a machine's rows apart. No window sees more than one range and 29 rows; windows over
    whole machines see one summary row per range.
    """
    rows = cut(daily, order, segments)
    near = with_halo(rows, HALO)
    if "service_date" in daily.columns:
        known = F.max_by("service_date", F.when(F.col("service_date").isNotNull(), F.col("_pos")))
        services = rows.groupBy(*SEGMENT).agg(known.alias("_known"))
        services = services.select(*SEGMENT, F.last("_known", True).over(earlier()).alias("_service0"))
        near = near.join(services, SEGMENT)
    local = store(_local(near, SEGMENT, holidays), "segment-features")
    sums = local.groupBy(*SEGMENT).agg(
        F.max("_refill").alias("_refill"), F.max("_clean").alias("_clean"), F.max_by("_notes", "_pos").alias("_notes"), *_week_sums()
    )
    machine = Window.partitionBy("atm_id")
    carried = sums.select(
        *SEGMENT, F.max("_refill").over(earlier()).alias("_refill0"), F.max("_clean").over(earlier()).alias("_clean0"),
        F.sum("_notes").over(earlier()).alias("_notes0"), *[F.sum(c).over(machine).alias(c) for c in _WEEK],
    )
    out = local.join(carried, SEGMENT).transform(_from_before).transform(_runs).transform(_whole)
    return out.drop(*WORK_COLUMNS, *_WEEK, *_INNER)


_INNER = ["_segment", "_start", "_end", "_halo", "_service0", "_refill0", "_clean0", "_notes0", "_refill", "_clean", "_notes"]


class FeatureHistory:
    """Stored features that grow by days. New days cost as much as they hold, whatever lies before them.

    Two day tables: the features by day, without what depends on the weekend ratio, and one state per
    machine (last 29 rows, positions and sums), in a fixed number of buckets. Both note the batch they
    contain, so a batch that is repeated after a failure is added once. Every machine's days must
    come in order; a row that is not later than its machine's last day is refused, because rows behind it would change.
    """

    def __init__(self, spark: SparkSession, path: str, daily: StructType, holidays: Sequence[str] = HOLIDAYS, buckets: int = 64):
        self.spark, self.daily, self.holidays, self.buckets = spark, daily, holidays, buckets
        rows = self._advance(*self._nothing())
        states = self._states(*self._nothing())
        self.rows = DayTable(spark, f"{path}/rows", rows.schema)
        self.states = DayTable(spark, f"{path}/states", states.schema, key=F.pmod(F.xxhash64("atm_id"), F.lit(buckets)))

    def _nothing(self) -> tuple[DataFrame, DataFrame]:
        new = self.spark.createDataFrame([], self.daily)
        service = dict(new.dtypes).get("service_date", "date")
        inner = ", ".join(f"{f}:{t}" for f, t in [*new.dtypes, ("_pos", "bigint")])
        sums = ", ".join(f"{c} long" for c in _WEEK)
        state = f"atm_id string, _last date, _rows long, _service0 {service}, _refill0 long, _clean0 long, _notes0 double, {sums}, _recent array<struct<{inner}>>"
        return new, self.spark.createDataFrame([], state)

    def _numbered(self, new: DataFrame, states: DataFrame) -> DataFrame:
        """New rows with their positions in the machine's history."""
        w = Window.partitionBy("atm_id").orderBy("record_date", "ending_cash_balance")
        known = states.select("atm_id", "_rows")
        numbered = new.withColumn("_nth", F.row_number().over(w)).join(known, "atm_id", "left")
        return numbered.withColumn("_pos", F.coalesce("_rows", F.lit(0)) + F.col("_nth")).drop("_nth", "_rows")

    def _advance(self, new: DataFrame, states: DataFrame) -> DataFrame:
        """The stored columns of new rows: the halo and the start values come from the states."""
        recent = states.select(F.explode("_recent").alias("r")).select("r.*").withColumn("_halo", F.lit(True))
        rows = self._numbered(new, states).withColumn("_halo", F.lit(False)).unionByName(recent)
        carried = rows.join(states.select("atm_id", "_service0", "_refill0", "_clean0", "_notes0"), "atm_id", "left")
        out = _local(carried, ["atm_id"], self.holidays).transform(_from_before).transform(_runs)
        return out.drop("_halo", "_service0", "_refill0", "_clean0", "_notes0", "_prev_start", "_burn")

    def _states(self, new: DataFrame, states: DataFrame, advanced: DataFrame | None = None) -> DataFrame:
        """The states after the new rows. A machine's new rows are as many as the batch has days for it."""
        done = self._advance(new, states) if advanced is None else advanced
        own = [*self.daily.fieldNames(), "_pos"]
        newest = Window.partitionBy("atm_id").orderBy(F.desc("_pos"))
        recent = done.select(*own).unionByName(states.select(F.explode("_recent").alias("r")).select("r.*"))
        recent = recent.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= HALO)
        recent = recent.groupBy("atm_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("_recent"))
        service = F.max_by("_service", "_pos") if "_service" in done.columns else F.lit(None).cast("date")
        sums = done.groupBy("atm_id").agg(
            F.max("record_date").alias("_last"), F.max("_pos").alias("_rows"), service.alias("_service0"), F.max("_refill").alias("_refill0"),
            F.max("_clean").alias("_clean0"), F.max_by("_notes", "_pos").alias("_notes0"), *_week_sums(),
        )
        old = states.select("atm_id", *[F.coalesce(c, F.lit(0)).alias(f"_old{c}") for c in _WEEK])
        total = sums.join(old, "atm_id", "left").withColumns(
            {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_old{c}", F.lit(0)) for c in _WEEK}
        )
        return total.join(recent, "atm_id").select(*[F.col(c).cast(t) for c, t in self._nothing()[1].dtypes])

    def add(self, new: DataFrame, batch: int) -> None:
        """Add the next days of some machines as batch number ``batch``."""
        if min(t.manifest()["applied"].get("days", -1) for t in (self.rows, self.states)) >= batch:
            return
        with Stored(new.select(*self.daily.fieldNames()).filter(F.col("atm_id").isNotNull()), "new-days") as rows:
            touched = self.states.keys_of(rows)
            machines = rows.select("atm_id").distinct()
            with Stored(self.states.read(touched).join(machines, "atm_id", "left_semi"), "states") as states:
                if self.states.manifest()["applied"].get("days", -1) >= batch:
                    raise RuntimeError(f"the states hold batch {batch}, the rows do not: restore the table")
                late = rows.join(states.select("atm_id", "_last"), "atm_id").filter(F.col("record_date") <= F.col("_last")).count()
                if late:
                    raise ValueError(f"{late} rows are not later than their machine's last day; rebuild the history with them")
                with Stored(self._advance(rows, states), "advanced") as advanced:
                    if self.rows.manifest()["applied"].get("days", -1) < batch:
                        days = self.rows.keys_of(advanced)
                        self.rows.replace(self.rows.read(days).unionByName(advanced), days, {"days": batch})
                    others = self.states.read(touched).join(machines, "atm_id", "left_anti")
                    after = others.unionByName(self._states(rows, states, advanced))
                    self.states.replace(after, touched, {"days": batch})

    def read(self) -> DataFrame:
        """All features: what depends on the whole history comes from the machines' current sums."""
        sums = self.states.read().select("atm_id", *_WEEK)
        return self.rows.read().join(sums, "atm_id").transform(_whole).drop(*WORK_COLUMNS, *_WEEK, *_INNER)
