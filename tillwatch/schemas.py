"""Schemas of the raw tables, fixed up front so that no read infers types."""

from pyspark.sql import types as T


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L, _I, _D, _TS = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType())

TRANSACTIONS = _schema(
    transaction_id=_L, atm_id=_S, transaction_time=_TS, amount=_D, transaction_type=_S, transaction_status=_I
)
TRANSACTIONS_UNTYPED = _schema(
    transaction_id=_L, atm_id=_S, transaction_time=_TS, withdrawal_amount=_D, transaction_status=_I
)
CASH_STATUS = _schema(cash_id=_L, atm_id=_S, timestamp=T.DateType(), remaining_cash=_D)
OPERATIONAL_LOGS = _schema(
    log_id=_L, atm_id=_S, timestamp=_TS, uptime_status=_I, error_code=_S, downtime_duration=_L
)
MAINTENANCE_RECORDS = _schema(
    maintenance_id=_L, atm_id=_S, maintenance_date=_TS, maintenance_type=_S, amount_added=_D
)
ATM_METADATA = _schema(
    atm_id=_S, atm_bank=_S, location=_S, atm_model=_S, services=_S, card_types=_S,
    operational_status=_S, lat=_D, lng=_D,
)
DAILY_METRICS = _schema(
    atm_id=_S, record_date=T.DateType(), uptime_percentage=_D, error_count=_L, transaction_count=_L,
    starting_cash_balance=_D, ending_cash_balance=_D,
)
TRAINING_LABELS = _schema(
    atm_id=_S, record_date=T.DateType(), actual_health_score=_D, actual_failed_next_7_days=_I,
    actual_days_to_depletion=_D,
)

# All columns that a raw table may have; a file holds some of them, in any order.
RAW_TABLES = {
    "cash_status": CASH_STATUS,
    "operational_logs": OPERATIONAL_LOGS,
    "transactions": T.StructType([*TRANSACTIONS, TRANSACTIONS_UNTYPED["withdrawal_amount"]]),
    "maintenance_records": MAINTENANCE_RECORDS,
    "atm_metadata": ATM_METADATA,
}
