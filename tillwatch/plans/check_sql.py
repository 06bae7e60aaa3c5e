"""SQL building blocks of the checks, written in the plain textbook form of each operation."""

from __future__ import annotations

from tillwatch.operators.features import HOLIDAYS

# Parameters of the registered queries.
AS_OF = "2024-01-30"
SUPPLIER_AS_OF = "1999-07-15"
FIXTURE_HOLIDAYS = ["1997-01-01", "1998-12-25", "1999-08-06", "2024-01-01", "2024-01-15", *HOLIDAYS]


def half_even(x: str, digits: int) -> str:
    """Exact rounding with ties to even; ``x`` is repeated, so it should be a plain column."""
    v = f"(({x}) * 1e{digits})"
    high = f"(({x}) * 134217729e0 - (({x}) * 134217729e0 - ({x})))"
    lost = f"(({high} * 1e{digits} - {v}) + (({x}) - {high}) * 1e{digits})"
    return (
        f"(CASE WHEN {v} - floor({v}) = 0.5 AND {lost} > 0 THEN floor({v}) + 1 "
        f"WHEN {v} - floor({v}) = 0.5 AND {lost} < 0 THEN floor({v}) "
        f"WHEN {v} - floor({v}) = 0.5 THEN 2 * floor((floor({v}) + 1) / 2) "
        f"ELSE floor({v} + 0.5) END / 1e{digits})"
    )


def half_up(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def distance(lat1, lng1, lat2, lng2) -> str:
    a = (
        f"(power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* power(sin(radians(({lng2}) - ({lng1})) / 2), 2))"
    )
    return f"(6371e0 * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def uniform(seed: int) -> str:
    """The draw of a machine-day."""
    text = f"concat_ws('|', '{seed}', atm_id, CAST(record_date AS VARCHAR))"
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) + 0.5e0) / {2**48}e0)"


def normal(seed: int) -> str:
    return f"(sqrt(-2 * ln({uniform(2 * seed)})) * cos(2 * pi() * {uniform(2 * seed + 1)}))"


_DAYS = ", ".join(f"DATE '{d}'" for d in FIXTURE_HOLIDAYS)

_H = "PARTITION BY atm_id ORDER BY record_date"
_W7 = f"({_H} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
_W30 = f"({_H} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
_WC = f"({_H} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _feature_steps(p: str, base: str) -> dict[str, str]:
    """The feature columns over ``base``, in four steps named with prefix ``p``."""
    return {
        f"{p}_one": f"""
            SELECT *, isodow(record_date) - 1 AS day_of_week, month(record_date) AS month,
              CAST(record_date IN ({_DAYS}) AS INT) AS is_holiday,
              CAST(record_date = last_day(record_date) AS INT) AS is_month_end,
              CAST(day(record_date) IN (25, 26, 27) AS INT) AS is_salary_day,
              CAST(isodow(record_date) >= 6 AS INT) AS is_weekend,
              row_number() OVER ({_H}) AS pos,
              CASE WHEN starting_cash_balance > lag(starting_cash_balance) OVER ({_H}) THEN 1 ELSE 0 END AS up,
              CASE WHEN coalesce(error_count, 0) <= 0 THEN 1 ELSE 0 END AS clean,
              last_value(service_date IGNORE NULLS) OVER {_WC} AS svc,
              greatest(starting_cash_balance - ending_cash_balance, 0) AS burn,
              least(daily_deposit_amount / 2000, CAST(daily_deposit_count * 30 AS DOUBLE)) AS estimated_deposit_notes
            FROM {base}""",
        f"{p}_two": f"""
            SELECT *, coalesce(date_diff('day', svc, record_date), 999) AS days_since_maintenance,
              avg(uptime_percentage) OVER {_W7} AS uptime_percentage_7d,
              avg(error_count) OVER {_W7} AS error_count_7d,
              avg(transaction_count) OVER {_W7} AS transaction_count_7d,
              avg(ending_cash_balance) OVER {_W7} AS ending_cash_balance_7d,
              avg(daily_withdrawal_amount) OVER {_W7} AS daily_withdrawal_amount_7d,
              avg(avg_transaction_amount) OVER {_W7} AS avg_transaction_amount_7d,
              sum(error_count) OVER {_W30} AS error_count_30d,
              sum(error_count) OVER {_W7} AS error_count_7d_sum,
              coalesce(stddev_samp(error_count) OVER {_W7}, 0) AS error_type_diversity,
              coalesce(stddev_samp(transaction_count) OVER {_W7}, 0) AS transaction_volatility,
              greatest(avg(burn) OVER {_W7}, 1) AS base_daily_consumption,
              CASE WHEN count(*) OVER {_W7} < 2 THEN 0e0
                   ELSE regr_slope(uptime_percentage, pos) OVER {_W7} END AS health_trend_7d,
              sum(up) OVER {_WC} AS up_id, sum(clean) OVER {_WC} AS clean_id,
              sum(CASE WHEN service_date IS NOT NULL THEN 1 ELSE 0 END) OVER {_W30} AS maintenance_count_30d
            FROM {p}_one""",
        f"{p}_ratio": f"""
            SELECT atm_id,
              (CASE WHEN max(is_weekend) = 1 THEN avg(transaction_count) FILTER (WHERE is_weekend = 1) ELSE 0 END)
              / ((CASE WHEN min(is_weekend) = 0 THEN avg(transaction_count) FILTER (WHERE is_weekend = 0) ELSE 1 END) + 1)
              AS weekend_vs_weekday_ratio
            FROM {p}_one GROUP BY atm_id""",
        f"{p}_three": f"""
            SELECT t.*, weekend_vs_weekday_ratio,
              row_number() OVER (PARTITION BY t.atm_id, up_id ORDER BY record_date) - 1 AS days_since_replenishment,
              row_number() OVER (PARTITION BY t.atm_id, clean_id ORDER BY record_date) - 1 AS time_since_last_error,
              sum(CASE WHEN days_since_maintenance >= 0 THEN estimated_deposit_notes ELSE 0 END)
                OVER (PARTITION BY t.atm_id ORDER BY record_date ROWS UNBOUNDED PRECEDING) AS cumulative_deposit_notes,
              base_daily_consumption * (1e0 + CASE WHEN day_of_week IN (3, 4)
                THEN greatest(weekend_vs_weekday_ratio - 1e0, 0) ELSE 0 END) AS avg_daily_consumption,
              transaction_count / 1000e0 AS utilization_rate,
              (starting_cash_balance - ending_cash_balance) / (uptime_minutes / 60e0 + 1) AS cash_consumption_rate,
              transaction_count / (uptime_percentage / 100e0 * 24 + 0.01e0) AS transaction_velocity,
              greatest(100 - uptime_percentage, 0) / 100e0 * 1440 AS consecutive_downtime_mins,
              floor(transaction_count * 0.24e0 + 0.5) AS peak_hour_transactions,
              CASE WHEN error_count_30d > 0 THEN CAST(error_count_7d_sum AS DOUBLE) / CAST(error_count_30d AS DOUBLE)
                   ELSE 0 END AS error_acceleration
            FROM {p}_two t JOIN {p}_ratio r ON t.atm_id = r.atm_id""",
        f"{p}_four": f"""
            SELECT *, least(cumulative_deposit_notes / 3000e0, 1) AS deposit_bin_utilization,
              least(greatest(ending_cash_balance / avg_daily_consumption, 0), 60) AS cash_stress_indicator_raw,
              least(greatest(1 - least(greatest(ending_cash_balance / avg_daily_consumption, 0), 60) / 60e0, 0), 1)
                AS cash_stress_indicator,
              least(greatest(ending_cash_balance / greatest(cash_consumption_rate, 0.01e0), 0), 720)
                AS time_to_predicted_empty,
              transaction_count AS activity_level_raw,
              sin(2 * pi() * day_of_week / 7) AS day_sin, cos(2 * pi() * day_of_week / 7) AS day_cos,
              sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos
            FROM {p}_three""",
        f"{p}_five": f"""
            SELECT *, uptime_percentage / 100e0 * 0.40e0 AS uptime_weight,
              1e0 / (error_count_7d_sum + 1) * 0.30e0 AS error_inverse_weight,
              1e0 / (greatest(days_since_maintenance, 0) + 1) * 0.20e0 AS maintenance_inverse_weight,
              (1 - cash_stress_indicator) * 0.10e0 AS cash_stress_inverse_weight
            FROM {p}_four""",
        f"{p}_all": f"""
            SELECT *, (uptime_weight + error_inverse_weight + maintenance_inverse_weight
                       + cash_stress_inverse_weight) * 100 AS composite_health_score,
              error_acceleration * 0.30e0 + 1e0 / (consecutive_downtime_mins + 1) * 0.25e0
              - health_trend_7d * 0.20e0 + 1e0 / (time_since_last_error + 1) * 0.15e0
              + 1e0 / (error_type_diversity + 1) * 0.10e0 AS failure_risk_score
            FROM {p}_five""",
    }


_PEAK = "(1e0 + is_holiday * 0.3e0 + is_salary_day * 0.4e0 + is_month_end * 0.2e0)"
_FILL = "least(greatest(ending_cash_balance / 3000000e0, 0), 1)"
_RAW_DAYS = "(CASE WHEN cash_consumption_rate > 0 THEN ending_cash_balance / cash_consumption_rate ELSE 7e0 END)"
_DAYS_LEFT = f"""greatest(0.5e0 * {_FILL}, least({_FILL}, CASE WHEN {_PEAK} > 1
        THEN least({_RAW_DAYS} / {_PEAK}, 0.5e0 * {_FILL} + ({_FILL} - 0.5e0 * {_FILL}) * 0.25e0)
        ELSE {_RAW_DAYS} / {_PEAK} END))"""

_SLOTS = ", ".join(
    f"coalesce(max(transaction_count) FILTER (WHERE record_date BETWEEN DATE '{AS_OF}' - 6 AND DATE '{AS_OF}' "
    f"AND isodow(record_date) % 7 = {i}), 0)"
    for i in range(7)
)

COMMON: dict[str, str] = {
    "ev": """
        SELECT event_id, ts, CAST(user_id AS VARCHAR) AS atm_id, event_type, value,
          CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(ts AS DATE) AS record_date
        FROM events""",
    "tx": """
        SELECT event_id AS transaction_id, atm_id, ts AS transaction_time, value AS amount, record_date,
          CASE WHEN event_type = 'purchase' THEN 'withdrawal' ELSE 'deposit' END AS transaction_type,
          1 AS transaction_status
        FROM ev WHERE event_type IN ('purchase', 'signup')""",
    "status_log": """
        SELECT event_id AS log_id, atm_id, ts, record_date,
          CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS uptime_status,
          CASE WHEN event_type = 'error' THEN CAST(k AS VARCHAR) END AS error_code,
          CASE WHEN event_type = 'error' THEN floor(value * 10) ELSE 0 END AS downtime_duration
        FROM ev WHERE event_type IN ('error', 'view')""",
    "cash": """
        SELECT event_id AS cash_id, atm_id, record_date, floor(value * 1000) AS remaining_cash
        FROM (SELECT *, row_number() OVER (PARTITION BY atm_id, record_date ORDER BY ts DESC, event_id DESC) AS rn
              FROM ev) WHERE rn = 1""",
    "maint": """
        SELECT event_id AS maintenance_id, atm_id, ts AS maintenance_date, record_date,
          CASE WHEN k % 20 = 0 THEN 'Corrective' ELSE 'Preventive' END AS maintenance_type,
          floor(value * 100) AS amount_added
        FROM ev WHERE event_type = 'error' AND k % 10 = 0""",
    "master": """
        SELECT CAST(c_custkey AS VARCHAR) AS atm_id, c_mktsegment AS atm_bank, n_name AS location,
          'M' || CAST(c_custkey % 5 AS VARCHAR) AS atm_model,
          'Withdrawal, Balance Check' || CASE WHEN c_custkey % 2 = 0 THEN ', Deposits' ELSE '' END
            || CASE WHEN c_custkey % 3 = 0 THEN ', Transfer' ELSE '' END AS services,
          'Visa, Mastercard' AS card_types,
          CASE WHEN c_acctbal < 0 THEN 'out_of_service' ELSE 'in_service' END AS operational_status,
          17.9e0 + (c_custkey % 100) * 0.001e0 AS lat, -76.9e0 + (c_custkey % 37) * 0.002e0 AS lng
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE c_custkey IN (SELECT user_id FROM events)""",
    "tx_days": """
        SELECT atm_id, record_date,
          count(*) FILTER (WHERE transaction_type = 'withdrawal') AS transaction_count,
          coalesce(sum(amount) FILTER (WHERE transaction_type = 'withdrawal'), 0) AS daily_withdrawal_amount,
          coalesce(avg(amount) FILTER (WHERE transaction_type = 'withdrawal'), 0) AS avg_transaction_amount,
          count(*) FILTER (WHERE transaction_type = 'deposit') AS daily_deposit_count,
          coalesce(sum(amount) FILTER (WHERE transaction_type = 'deposit'), 0) AS daily_deposit_amount
        FROM tx GROUP BY atm_id, record_date""",
    "error_days": """
        SELECT atm_id, record_date, count(*) AS error_count
        FROM status_log WHERE uptime_status = 0 GROUP BY atm_id, record_date""",
    "downtime_days": """
        SELECT atm_id, record_date, CAST(sum(downtime_duration) AS BIGINT) AS downtime_duration
        FROM status_log GROUP BY atm_id, record_date""",
    "balances": """
        SELECT atm_id, record_date, remaining_cash AS ending_cash_balance,
          coalesce(lag(remaining_cash) OVER (PARTITION BY atm_id ORDER BY record_date), remaining_cash)
            AS starting_cash_balance
        FROM cash""",
    "services_seen": "SELECT atm_id, max(record_date) AS service_date FROM maint GROUP BY atm_id",
    "daily": """
        SELECT b.atm_id, b.record_date, ending_cash_balance, starting_cash_balance,
          coalesce(transaction_count, 0) AS transaction_count,
          coalesce(daily_withdrawal_amount, 0) AS daily_withdrawal_amount,
          coalesce(avg_transaction_amount, 0) AS avg_transaction_amount,
          coalesce(daily_deposit_count, 0) AS daily_deposit_count,
          coalesce(daily_deposit_amount, 0) AS daily_deposit_amount,
          coalesce(error_count, 0) AS error_count,
          coalesce(downtime_duration, 0) AS downtime_duration,
          1440 - least(greatest(coalesce(downtime_duration, 0), 0), 1440) AS uptime_minutes,
          (1440 - least(greatest(coalesce(downtime_duration, 0), 0), 1440)) / 1440e0 * 100 AS uptime_percentage,
          service_date
        FROM balances b
        LEFT JOIN tx_days t ON b.atm_id = t.atm_id AND b.record_date = t.record_date
        LEFT JOIN error_days e ON b.atm_id = e.atm_id AND b.record_date = e.record_date
        LEFT JOIN downtime_days d ON b.atm_id = d.atm_id AND b.record_date = d.record_date
        LEFT JOIN services_seen s ON b.atm_id = s.atm_id""",
    "sup_days": """
        SELECT CAST(l_suppkey AS VARCHAR) AS atm_id, CAST(l_shipdate AS DATE) AS record_date,
          count(*) AS transaction_count, sum(l_extendedprice) AS daily_withdrawal_amount,
          avg(l_extendedprice) AS avg_transaction_amount,
          count(*) FILTER (WHERE l_returnflag = 'R') AS error_count,
          CAST(sum(l_quantity) AS BIGINT) * 10 AS downtime_duration,
          count(*) FILTER (WHERE l_returnflag = 'A') AS daily_deposit_count,
          coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 0) AS daily_deposit_amount,
          floor(max(l_extendedprice) * 10) AS ending_cash_balance
        FROM lineitem GROUP BY 1, 2""",
    "sup": """
        SELECT *, coalesce(lag(ending_cash_balance) OVER (PARTITION BY atm_id ORDER BY record_date),
                           ending_cash_balance) AS starting_cash_balance,
          1440 - least(greatest(downtime_duration, 0), 1440) AS uptime_minutes,
          (1440 - least(greatest(downtime_duration, 0), 1440)) / 1440e0 * 100 AS uptime_percentage,
          CAST(NULL AS DATE) AS service_date
        FROM sup_days""",
    # Every event as a balance reading: a day has a row per reading.
    "readings": """
        SELECT event_id AS reading, atm_id, record_date, floor(value * 1000) AS ending_cash_balance,
          coalesce(lag(floor(value * 1000)) OVER (PARTITION BY atm_id ORDER BY record_date, event_id), floor(value * 1000))
            AS starting_cash_balance
        FROM ev""",
    "reading_days": """
        SELECT r.*, coalesce(transaction_count, 0) AS transaction_count,
          coalesce(daily_withdrawal_amount, 0) AS daily_withdrawal_amount,
          coalesce(avg_transaction_amount, 0) AS avg_transaction_amount,
          coalesce(daily_deposit_count, 0) AS daily_deposit_count,
          coalesce(daily_deposit_amount, 0) AS daily_deposit_amount,
          coalesce(error_count, 0) AS error_count, coalesce(downtime_duration, 0) AS downtime_duration,
          1440 - least(greatest(coalesce(downtime_duration, 0), 0), 1440) AS uptime_minutes,
          (1440 - least(greatest(coalesce(downtime_duration, 0), 0), 1440)) / 1440e0 * 100 AS uptime_percentage,
          service_date
        FROM readings r
        LEFT JOIN tx_days t ON r.atm_id = t.atm_id AND r.record_date = t.record_date
        LEFT JOIN error_days e ON r.atm_id = e.atm_id AND r.record_date = e.record_date
        LEFT JOIN downtime_days d ON r.atm_id = d.atm_id AND r.record_date = d.record_date
        LEFT JOIN services_seen s ON r.atm_id = s.atm_id""",
    **_feature_steps("feat", "daily"),
    **_feature_steps("sfeat", "sup"),
    **{k: sql.replace("ORDER BY record_date", "ORDER BY record_date, reading") for k, sql in _feature_steps("rfeat", "reading_days").items()},
    "newest": f"""
        SELECT *, {_DAYS_LEFT} AS days_left, least(greatest(failure_risk_score, 0), 1) AS risk
        FROM (SELECT *, row_number() OVER (PARTITION BY atm_id ORDER BY record_date DESC) AS rn FROM feat_all)
        WHERE rn = 1""",
    "week": f"SELECT atm_id, [{_SLOTS}] AS weekly_txns FROM daily GROUP BY atm_id",
    "week_volume": """
        SELECT atm_id, CASE WHEN list_sum(weekly_txns) > 0 THEN round_even(
            CAST(list_sum(weekly_txns) AS DOUBLE) / len(list_filter(weekly_txns, lambda x: x > 0)), 0)
          ELSE 0 END AS transactions_24h_predicted
        FROM week""",
    "pred": f"""
        SELECT n.atm_id, record_date, {half_even("composite_health_score", 1)} AS health_score,
          {half_even("cash_stress_indicator", 3)} AS cash_stress_indicator,
          {half_even("error_acceleration", 3)} AS error_acceleration,
          {half_even("uptime_percentage", 1)} AS uptime_percentage,
          transaction_count AS transactions_24h,
          {half_even("daily_withdrawal_amount_7d", 2)} AS avg_daily_withdrawal,
          {half_even("avg_transaction_amount_7d", 2)} AS avg_amount,
          days_since_maintenance, {half_even("deposit_bin_utilization", 3)} AS deposit_bin_utilization,
          'in_service' AS operational_status,
          {half_even("risk", 3)} AS failure_probability,
          CASE WHEN transaction_count > 220 THEN 'High' WHEN transaction_count > 100 THEN 'Moderate'
               ELSE 'Low' END AS activity_level,
          CASE WHEN ending_cash_balance <= 0 THEN 0e0 ELSE {half_even("days_left", 2)} END AS days_to_depletion, transactions_24h_predicted
        FROM newest n JOIN week_volume w ON n.atm_id = w.atm_id""",
    "snapshot": """
        SELECT d.*, m.* EXCLUDE (atm_id) FROM (
          SELECT *, row_number() OVER (PARTITION BY atm_id ORDER BY record_date DESC) AS rn FROM daily
          WHERE record_date >= (SELECT max(record_date) FROM daily) - 30) d
        LEFT JOIN master m ON d.atm_id = m.atm_id WHERE rn = 1""",
    "fleet": f"""
        SELECT s.atm_id, atm_bank AS bank_name, location, atm_model AS model,
          coalesce(s.operational_status, 'in_service') AS status, health_score, failure_probability,
          days_to_depletion, activity_level, s.uptime_percentage AS uptime, s.error_count,
          transactions_24h_predicted AS transactions_24h, avg_amount, avg_daily_withdrawal,
          {half_even("level", 1)} AS cash_level,
          deposit_bin_utilization, error_acceleration,
          list_filter([
            CASE WHEN cash_stress_indicator > 0.70e0 THEN 'CASH_CRITICAL' END,
            CASE WHEN cash_stress_indicator > 0.50e0 AND cash_stress_indicator <= 0.70e0 THEN 'CASH_LOW' END,
            CASE WHEN deposit_bin_utilization > 0.90e0 THEN 'DEPOSIT_BIN_CRITICAL' END,
            CASE WHEN error_acceleration > 0.50e0 THEN 'ERROR_SPIKE' END,
            CASE WHEN days_since_maintenance > 30 AND days_since_maintenance <= 60 THEN 'MAINTENANCE_DUE' END,
            CASE WHEN days_since_maintenance > 60 THEN 'MAINTENANCE_OVERDUE' END,
            CASE WHEN s.operational_status = 'out_of_service' THEN 'OUT_OF_SERVICE' END,
            CASE WHEN failure_probability > 0.70e0 THEN 'CRITICAL_ERROR' END], lambda x: x IS NOT NULL) AS alerts
        FROM snapshot s JOIN (SELECT *, (1 - cash_stress_indicator) * 100 AS level FROM pred) p ON s.atm_id = p.atm_id""",
    "feed": """
        SELECT atm_id, health_score, alert_order - 1 AS alert_order, alerts[alert_order] AS code,
          CASE WHEN contains(alerts[alert_order], 'CRITICAL') OR contains(alerts[alert_order], 'OUT_OF_SERVICE')
               THEN 'CRITICAL'
               WHEN contains(alerts[alert_order], 'LOW_CASH') OR contains(alerts[alert_order], 'HIGH_RISK') THEN 'HIGH'
               ELSE 'MEDIUM' END AS severity
        FROM (SELECT *, unnest(range(1, len(alerts) + 1)) AS alert_order FROM fleet)""",
    "found": f"""
        SELECT s.atm_id, location AS name, atm_bank AS short, location AS building,
          coalesce(s.operational_status, 'in_service') AS status, health_score AS health, activity_level,
          greatest(round_even((1 - cash_stress_indicator) * 100, 0), 0) AS cash_level, deposit_bin_utilization,
          days_to_depletion, transactions_24h_predicted AS transactions_24h, services, card_types, lat, lng,
          {half_even("km", 2)} AS distance_km
        FROM (SELECT *, {distance("17.95e0", "-76.85e0", "lat", "lng")} AS km FROM snapshot) s
        JOIN pred p ON s.atm_id = p.atm_id WHERE regexp_matches(services, 'Deposits') AND km <= 5""",
}
