"""Small in-memory frames."""

import datetime as dt
import random

DAILY = (
    "atm_id string, record_date date, uptime_percentage double, error_count long, transaction_count long, "
    "starting_cash_balance double, ending_cash_balance double"
)


def day(text):
    return dt.date.fromisoformat(text)


def one_row(spark, **change):
    row = {
        "atm_id": "A", "record_date": day("2026-03-15"), "uptime_percentage": 92.0, "error_count": 3,
        "transaction_count": 200, "starting_cash_balance": 1_000_000.0, "ending_cash_balance": 700_000.0,
        "daily_deposit_count": 10, "daily_deposit_amount": 50_000.0,
    } | change
    return rows(spark, [row])


def rows(spark, dicts, extra=""):
    names = list(dicts[0])
    types = {
        "atm_id": "string", "record_date": "date", "service_date": "date", "error_count": "long",
        "transaction_count": "long", "daily_deposit_count": "long", "hourly_counts": "array<double>",
        "service_capacity": "long", "operational_status": "string",
    }
    schema = ", ".join(f"{n} {types.get(n, 'double')}" for n in names)
    return spark.createDataFrame([tuple(d[n] for n in names) for d in dicts], schema)


def fleet_days(spark, n_days=40, machines=3, seed=42):
    rng = random.Random(seed)
    out = []
    for m in range(machines):
        for i in range(n_days):
            start = rng.uniform(8e5, 1.2e6)
            out.append(
                {
                    "atm_id": f"ATM-{m:03d}", "record_date": day("2026-01-01") + dt.timedelta(days=i),
                    "uptime_percentage": min(100.0, max(60.0, rng.gauss(95, 3))), "error_count": rng.randint(0, 3),
                    "transaction_count": rng.randint(10, 300), "starting_cash_balance": start,
                    "ending_cash_balance": start - rng.uniform(5e4, 3e5),
                    "service_date": day("2026-01-15") if m == 0 else None,
                }
            )
    return rows(spark, out)


def collect(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
