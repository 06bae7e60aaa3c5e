"""Machines near a point, or near each of many points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import distance_km
from tillwatch.functions.expr import EARTH_RADIUS_KM, cos_degrees, haversine

DEFAULT_RADIUS_KM = 2.0
_SLACK = 1e-9


def box(lat: float, radius_km: float) -> tuple[float, float]:
    """Half height and half width in degrees of a box that holds the whole circle."""
    angle = radius_km / EARTH_RADIUS_KM
    dlat = math.degrees(angle)
    if abs(lat) + dlat >= 90:
        return dlat + _SLACK, 360.0
    return dlat + _SLACK, math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(lat)))) + _SLACK


def near_point(machines: DataFrame, lat: float, lng: float, radius_km: float = DEFAULT_RADIUS_KM) -> DataFrame:
    """Machines within the radius, with their distance. The box test reaches the file scan."""
    dlat, dlng = box(lat, radius_km)
    inside = F.col("lat").between(lat - dlat, lat + dlat)
    if -180 <= lng - dlng and lng + dlng <= 180:
        inside = inside & F.col("lng").between(lng - dlng, lng + dlng)
    return (
        machines.filter(inside)
        .withColumn("distance_km", distance_km(F.lit(lat), F.lit(lng), "lat", "lng"))
        .filter(F.col("distance_km") <= radius_km)
    )


CELL_MACHINES = 10_000  # machines of a cell that one task meets
PART_PAIRS = 50_000_000  # pairs of a cell that one task compares


def near_points(machines: DataFrame, points: DataFrame, radius_km: float = DEFAULT_RADIUS_KM,
                cell_machines: int = CELL_MACHINES, part_pairs: int = PART_PAIRS) -> DataFrame:
    """All (point, machine) pairs within the radius.

    Both sides get a grid cell no smaller than the radius; a point is copied to the cells its
    box touches, a machine stays in one, and the pair is found by an equi-join on the cell.
    Cells with more than ``cell_machines`` machines are split by the machine's id into as many parts as
    that takes, and only their points are copied to the parts. Where a part would still compare more than about ``part_pairs``
    pairs, its points are dealt to several turns, and its machines copied to each.
    """
    angle = radius_km / EARTH_RADIUS_KM
    columns = max(1, math.floor(360 / math.degrees(angle)))
    size = 360 / columns
    cell = lambda c: F.floor((F.col(c) + 180) / size)
    dlat = math.degrees(angle) + _SLACK
    polar = F.abs(F.col("point_lat")) + dlat >= 90
    dlng = F.when(polar, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), math.sin(angle) / F.cos(F.radians("point_lat"))))) + _SLACK
    )
    low = F.floor((F.col("point_lng") - dlng + 180) / size)
    high = F.least(F.floor((F.col("point_lng") + dlng + 180) / size), low + columns - 1)
    asked = (
        points.filter(F.col("point_lat").isNotNull() & F.col("point_lng").isNotNull())
        .withColumn("_x", F.explode(F.sequence(low, high)))
        .withColumn("_x", F.pmod("_x", F.lit(columns)))
        .withColumn(
            "_y",
            F.explode(
                F.sequence(
                    F.floor((F.col("point_lat") - dlat + 180) / size), F.floor((F.col("point_lat") + dlat + 180) / size)
                )
            ),
        )
    )
    placed = machines.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumns(
        {"_x": F.pmod(cell("lng"), F.lit(columns)), "_y": cell("lat")}
    )
    # One row per crowded cell; the number of machines and pairs over the bounds limits how many there are.
    there = placed.groupBy("_x", "_y").agg(F.count("*").alias("_machines"))
    met = asked.groupBy("_x", "_y").agg(F.count("*").alias("_points")).join(there, ["_x", "_y"])
    parts, turns = F.coalesce("_parts", F.lit(1)), F.coalesce("_turns", F.lit(1))
    crowded = met.withColumn("_parts", F.ceil(F.col("_machines") / cell_machines).cast("int"))
    crowded = crowded.withColumn("_turns", F.ceil(F.col("_machines") * F.col("_points") / F.col("_parts") / part_pairs).cast("int"))
    crowded = crowded.filter("_parts > 1 OR _turns > 1").select("_x", "_y", "_parts", "_turns")
    whole = [f"`{c}`" for c, kind in points.dtypes if "map<" not in kind]
    asked = asked.join(crowded, ["_x", "_y"], "left").withColumns(
        {"_salt": F.explode(F.sequence(F.lit(0), parts - 1)), "_turn": F.pmod(F.xxhash64(*whole), turns).cast("int"), "_cos1": cos_degrees("point_lat")}
    )
    placed = placed.join(crowded, ["_x", "_y"], "left").withColumns(
        {"_salt": F.pmod(F.hash("atm_id"), parts), "_turn": F.explode(F.sequence(F.lit(0), turns - 1)), "_cos2": cos_degrees("lat")}
    )
    # The work goes with the pairs, of which few bytes make many: a given number of partitions is not merged by their bytes.
    n = int(machines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["_x", "_y", "_salt", "_turn"]
    deal = lambda df: df.drop("_parts", "_turns").repartition(n, *key)
    # Only a pair about as far apart as the radius needs its distance to be told in or out.
    pair = ("point_lat", "point_lng", "lat", "lng", "_cos1", "_cos2")
    edge = math.sin(min(angle / 2, math.pi / 2)) ** 2
    sure, inside = haversine(*pair) < edge * (1 - _SLACK), distance_km(*pair) <= radius_km
    return (
        deal(asked).join(deal(placed), key)
        .filter((F.abs(F.col("lat") - F.col("point_lat")) <= dlat) & (haversine(*pair) <= edge * (1 + _SLACK)) & (sure | inside))
        .withColumn("distance_km", distance_km(*pair))
        .drop(*key, "_cos1", "_cos2")
    )
