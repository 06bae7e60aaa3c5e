"""The list of named queries, each with the SQL that must give the same rows.

A query names its result columns once, with a kind per column. From that list both the Spark
projection and the outer SELECT of the check are made, so that both sides show the same
columns, types and rounding:

    name      as it is            name:i    whole number       name:f    double, 6 decimals
    name:d    date as text        name:t    time as text       name:a    list as text
    name:af   list of doubles as text
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.plans.check_sql import COMMON

# Shown doubles are rounded a little off the half, so that amounts which fall exactly on a half do
# not depend on the order in which an engine summed them up. That concerns the seventh decimal: columns
# that a query has itself rounded to one to three digits lie on the shown grid and stay as they are.
HALF = 0.5003

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None


CATALOG: dict[str, Query] = {}


def _fields(columns: str) -> list[tuple[str, str]]:
    return [tuple((f + ":").split(":")[:2]) for f in columns.split()]


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    micro = lambda x: F.floor(x * 1e6 + HALF)
    shown = {
        "": lambda: c,
        "i": lambda: c.cast("long"),
        "f": lambda: micro(c.cast("double")) / 1e6,
        "d": lambda: c.cast("date").cast("string"),
        "t": lambda: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
        "a": lambda: F.concat_ws(",", c.cast("array<string>")),
        "af": lambda: F.concat_ws(",", F.transform(c, micro).cast("array<string>")),
    }
    return shown[kind]().alias(name)


def _sql_column(name: str, kind: str) -> str:
    shown = {
        "": name,
        "i": f"CAST({name} AS BIGINT)",
        "f": f"floor(CAST({name} AS DOUBLE) * 1e6 + {HALF}) / 1e6",
        "d": f"CAST(CAST({name} AS DATE) AS VARCHAR)",
        "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
        "a": f"array_to_string({name}, ',')",
        "af": f"array_to_string(list_transform({name}, lambda x: CAST(floor(x * 1e6 + {HALF}) AS BIGINT)), ',')",
    }
    return f"{shown[kind]} AS {name}"


def with_common(body: str) -> str:
    """Prefix a query with the common table expressions it uses, directly or through others."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"[a-z_0-9]+", pending.pop()))
        for name in words & COMMON.keys() - needed:
            needed.add(name)
            pending.append(COMMON[name])
    used = [f"{name} AS ({sql})" for name, sql in COMMON.items() if name in needed]
    return f"WITH {', '.join(used)} {body}" if used else body


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under a name. Without SQL only its rows are checked."""
    fields = _fields(columns)

    def register(run: Runner) -> Runner:
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(spark, sf_dir).select(*[_spark_column(n, k) for n, k in fields])

        check = None
        if sql is not None:
            check = with_common(f"SELECT {', '.join(_sql_column(n, k) for n, k in fields)} FROM ({sql}) AS result")
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, shown, check)
        return run

    return register
