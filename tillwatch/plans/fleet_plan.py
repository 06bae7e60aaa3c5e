"""Whole jobs: raw tables in, fleet answers out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.operators import fleet as views
from tillwatch.operators.features import HOLIDAYS, features
from tillwatch.operators.models import MODEL_FEATURES, FleetModels, model_heads
from tillwatch.operators.rollup import daily_metrics, fleet_snapshot, newest_days, window_start
from tillwatch.operators.scoring import as_day, finish_record, formula_heads, newest_with_series, record_inputs

SNAPSHOT_DAYS = 30
PREDICTION_DAYS = 90


class FleetJob:
    """The frames of one fleet evaluation, all lazy and all on one roll-up.

    ``anchor`` is the newest day of the data. Given as a literal it prunes the scans of the raw
    tables to the prediction range; left out, it is found by a scalar subquery.

    A machine's newest row within the snapshot range is its newest row overall, so the snapshot
    is a filter on the prediction records: the raw tables are read and rolled up once per answer.
    """

    def __init__(
        self,
        raw: dict[str, DataFrame],
        as_of: str | dt.date,
        *,
        anchor: str | dt.date | None = None,
        holidays: Sequence[str] = HOLIDAYS,
        models: FleetModels | None = None,
    ):
        self.raw = raw
        self.master = raw["atm_metadata"]
        self.as_of = as_day(as_of)
        self.anchor = anchor
        self.models = models
        self.daily = daily_metrics(
            raw["cash_status"], raw["transactions"], raw["operational_logs"], raw["maintenance_records"],
            days=PREDICTION_DAYS, anchor=anchor,
        )
        self.holidays = holidays

    def features(self) -> DataFrame:
        return features(self.daily, self.holidays)

    def predictions(self, carry: dict[str, str] | None = None) -> DataFrame:
        """Prediction record per machine; trained models replace the formulas where there are any."""
        feats = record_inputs(self.features(), MODEL_FEATURES if self.models is not None else None)
        latest, heads = newest_with_series(feats, self.as_of), formula_heads(feats.columns)
        if self.models is not None:
            latest, trained = model_heads(latest, self.models)
            heads = {**heads, **trained}
        return finish_record(latest, self.as_of, heads, carry)

    def snapshot(self) -> DataFrame:
        return fleet_snapshot(self.daily, self.master, SNAPSHOT_DAYS, self.anchor)

    def _in_snapshot(self) -> Column:
        return F.col("day") >= window_start(newest_days(self.raw["cash_status"]), SNAPSHOT_DAYS, self.anchor)

    def _rows(self) -> DataFrame:
        return views.fleet_rows_of(self.predictions(views.DAY_FIGURES), self.master)

    def rows(self) -> DataFrame:
        """Machines of the snapshot: prediction record, the day's figures and master columns."""
        return self._rows().filter(self._in_snapshot())

    def table(self) -> DataFrame:
        return views.fleet_table(self.rows())

    def health(self) -> DataFrame:
        return views.worst_first(self.table())

    def kpis(self) -> DataFrame:
        return views.fleet_kpis(self._rows(), self._in_snapshot())

    def finder(self, **request) -> DataFrame:
        return views.finder(self.rows(), **request)

    def machine(self, atm_id: str, status_from_master: bool = True) -> DataFrame:
        """One machine's record. The id filter moves below the windows to the raw scans.

        ``status_from_master`` shows the master's status and lets it into the alert rules, as in the
        fleet table; without it the record's own status stands.
        """
        mine = self.predictions().filter(F.col("atm_id") == atm_id)
        wanted = [c for c in ("location", "services", "card_types", "operational_status") if c in self.master.columns]
        master = self.master.filter(F.col("atm_id") == atm_id).select("atm_id", *wanted)
        if status_from_master and "operational_status" in wanted:
            master = master.withColumnRenamed("operational_status", "_master_status")
            mine = mine.join(master, "atm_id")
            mine = mine.withColumn("operational_status", F.coalesce("_master_status", "operational_status"))
        else:
            mine = mine.join(master.drop("operational_status"), "atm_id")
        return mine.select(
            "atm_id",
            F.col("location").alias("name"),
            "services",
            "card_types",
            F.col("operational_status").alias("status"),
            "health_score",
            "failure_probability",
            "activity_level",
            views.cash_level(0).alias("cash_level"),
            "deposit_bin_utilization",
            "days_to_depletion",
            "uptime_percentage",
            "error_acceleration",
            views.alert_codes(mine).alias("alerts"),
        )
