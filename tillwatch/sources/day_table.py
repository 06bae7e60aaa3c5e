"""A table cut by day (or another key) whose current files a manifest names, so a job changes whole days or nothing.

Every write goes to a folder of its own; the manifest of the next version then points the touched days
to it. A write that fails before that leaves the old version as it was, and readers of an older
version keep their files until ``clean`` is called. A manifest has one entry per day, so it is bounded by the calendar.

One writer at a time: a version that another writer has committed meanwhile is an error, never a loss.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwatch.session import file_system, remove_path

DAY = "_day"
NO_DAY = "none"


class DayTable:
    """Rows stored by day. ``schema`` are the columns as they are read back; ``key`` may name another cut than the
    day of ``record_date``, with a bounded number of values."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Column | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key = F.to_date("record_date") if key is None else key

    # --- manifests -----------------------------------------------------------------------

    def _versions(self) -> list[int]:
        where, system = file_system(self.spark, f"{self.path}/manifests")
        if not system.exists(where):
            return []
        names = [status.getPath().getName() for status in system.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self) -> dict:
        """``version``, ``days`` (day to folder) and ``applied`` (source to its last batch)."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "days": {}, "applied": {}}
        where, system = file_system(self.spark, f"{self.path}/manifests/{versions[-1]:012d}.json")
        stream = system.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        target = f"{self.path}/manifests/{manifest['version']:012d}.json"
        where, system = file_system(self.spark, target)
        draft = file_system(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")[0]
        stream = system.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if system.exists(where) or not system.rename(draft, where):
            system.delete(draft, False)
            raise RuntimeError(f"{target} is there already: another job has written version {manifest['version']}")

    # --- rows ----------------------------------------------------------------------------

    def read(self, days: Iterable[str] | None = None) -> DataFrame:
        """The current rows, or those of some days; files of other days are not looked at."""
        current = self.manifest()["days"]
        wanted = current if days is None else [d for d in days if d in current]
        paths = sorted(f"{self.path}/data/{current[d]}/{DAY}={d}" for d in wanted)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def keys_of(self, rows: DataFrame) -> list[str]:
        """The days that rows touch, as text: one value per calendar day."""
        found = rows.select(self._key_text()).distinct().collect()
        return sorted(r[0] for r in found)

    def _key_text(self) -> Column:
        return F.coalesce(self.key.cast("string"), F.lit(NO_DAY)).alias(DAY)

    def replace(self, rows: DataFrame, days: Iterable[str], applied: dict[str, int] | None = None) -> int:
        """Make ``rows`` the whole content of ``days``, other days stay; returns the new version. ``applied`` notes
        what the version contains, in the same commit."""
        before = self.manifest()
        folder = uuid.uuid4().hex
        target = f"{self.path}/data/{folder}"
        shown = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], self._key_text())
        shown.repartition(DAY, *self._spread(shown)).write.partitionBy(DAY).parquet(target)
        where, system = file_system(self.spark, target)
        written = {s.getPath().getName().removeprefix(f"{DAY}=") for s in system.listStatus(where) if s.isDirectory()}
        strangers = written - set(days)
        if strangers:
            raise ValueError(f"rows of days that are not replaced: {sorted(strangers)[:5]}")
        kept = {d: f for d, f in before["days"].items() if d not in set(days)}
        self._commit({
            "version": before["version"] + 1, "days": kept | dict.fromkeys(written, folder), "applied": before["applied"] | (applied or {}),
        })
        return before["version"] + 1

    def _spread(self, rows: DataFrame) -> list:
        """A day goes to a few tasks by machine, so that one day of a large fleet is not one task's work."""
        return [F.pmod(F.xxhash64("atm_id"), F.lit(8))] if "atm_id" in rows.columns else []

    def clean(self) -> int:
        """Remove folders that the current version does not name; returns their number."""
        used = set(self.manifest()["days"].values())
        where, system = file_system(self.spark, f"{self.path}/data")
        if not system.exists(where):
            return 0
        old = [s.getPath().getName() for s in system.listStatus(where) if s.getPath().getName() not in used]
        for name in old:
            remove_path(self.spark, f"{self.path}/data/{name}")
        return len(old)
