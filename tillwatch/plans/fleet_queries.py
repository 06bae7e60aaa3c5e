"""Queries over predictions, alerts, KPIs and the finder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwatch.operators import alerts, fleet, geo, scoring
from tillwatch.plans.catalog import query
from tillwatch.plans.check_sql import AS_OF, FIXTURE_HOLIDAYS, SUPPLIER_AS_OF, distance, half_up
from tillwatch.plans.feature_queries import fleet_features, supplier_features
from tillwatch.plans.fleet_plan import FleetJob
from tillwatch.session import work_path
from tillwatch.sources import layout
from tillwatch.sources import tables as t
from tillwatch.sources.ingest import to_json_rows
from tillwatch.sources.text_index import TextIndex


def job(spark, d) -> FleetJob:
    return FleetJob(t.raw_tables(spark, d), AS_OF, holidays=FIXTURE_HOLIDAYS)


_RECORD = (
    "atm_id record_date:d health_score:f cash_stress_indicator:f error_acceleration:f uptime_percentage:f "
    "transactions_24h:i avg_daily_withdrawal:f avg_amount:f days_since_maintenance:i deposit_bin_utilization:f "
    "operational_status"
)
_HEADS = "failure_probability:f activity_level days_to_depletion:f transactions_24h_predicted:i"
_FLEET = (
    "atm_id bank_name location model status health_score:f failure_probability:f days_to_depletion:f activity_level "
    "uptime:f error_count:i transactions_24h:i avg_amount:f avg_daily_withdrawal:f cash_level:f "
    "deposit_bin_utilization:f error_acceleration:f alerts:a"
)
_FOUND = (
    "atm_id name short building status health:f activity_level cash_level:f deposit_bin_utilization:f "
    "days_to_depletion:f transactions_24h:i services card_types lat:f lng:f distance_km:f"
)


# --- per-machine records ---------------------------------------------------------------


@query("latest_features", _RECORD, "SELECT * FROM pred")
def latest_features(spark, d):
    return scoring.base_record(fleet_features(spark, d))


@query("predict_formula", f"{_RECORD} {_HEADS}", "SELECT * FROM pred")
def predict_formula(spark, d):
    return job(spark, d).predictions()


@query("depletion_days", "atm_id days_to_depletion:f", "SELECT * FROM pred")
def depletion_days(spark, d):
    latest = scoring.latest_features(fleet_features(spark, d))
    depletion = {"days_to_depletion": scoring.formula_depletion(latest.columns)}
    return scoring.with_rounded(latest, depletion, *latest.columns)


_SUP_SLOTS = ", ".join(
    f"coalesce(max(transaction_count) FILTER (WHERE record_date BETWEEN DATE '{SUPPLIER_AS_OF}' - 6 "
    f"AND DATE '{SUPPLIER_AS_OF}' AND isodow(record_date) % 7 = {i}), 0)"
    for i in range(7)
)


@query(
    "weekly_series",
    "atm_id weekly_txns:a weekly_labels:a",
    f"SELECT atm_id, [{_SUP_SLOTS}] AS weekly_txns, ['s', 'm', 't', 'w', 'T', 'f', 's'] AS weekly_labels "
    "FROM sup GROUP BY atm_id",
)
def weekly_series(spark, d):
    return scoring.weekly_series(t.supplier_days(spark, d), SUPPLIER_AS_OF)


@query("weekly_velocity", "atm_id transactions_24h_predicted:i", "SELECT * FROM week_volume")
def weekly_velocity(spark, d):
    return scoring.weekly_volume(job(spark, d).daily, AS_OF)


@query(
    "monthly_errors",
    "atm_id monthly_inactive:a monthly_labels:a",
    """SELECT atm_id, [coalesce(sum(error_count) FILTER (WHERE month(record_date) = 4), 0),
                       coalesce(sum(error_count) FILTER (WHERE month(record_date) = 5), 0),
                       coalesce(sum(error_count) FILTER (WHERE month(record_date) = 6), 0)] AS monthly_inactive,
         ['Apr', 'May', 'Jun'] AS monthly_labels FROM sup GROUP BY atm_id""",
)
def monthly_errors(spark, d):
    return scoring.monthly_errors(t.supplier_days(spark, d), SUPPLIER_AS_OF)


@query(
    "hourly_profile",
    "atm_id hourly_txns:a",
    """SELECT atm_id, list(n ORDER BY hour) AS hourly_txns FROM (
         SELECT m.atm_id, h.hour, count(tx.transaction_id) AS n
         FROM (SELECT DISTINCT atm_id FROM tx) m CROSS JOIN (SELECT unnest(range(24)) AS hour) h
         LEFT JOIN tx ON tx.atm_id = m.atm_id AND hour(tx.transaction_time) = h.hour GROUP BY ALL) GROUP BY atm_id""",
)
def hourly_profile(spark, d):
    return scoring.hourly_profile(t.transactions(t.event_log(spark, d)))


@query(
    "machine_profile",
    "atm_id last_date:d current_cash:f daily_vol:f avg_withdraw:f std_withdraw:f",
    """SELECT c.atm_id, last_date, current_cash, daily_vol, avg_withdraw, std_withdraw
       FROM (SELECT atm_id, max(record_date) AS last_date, arg_max(remaining_cash, record_date) AS current_cash
             FROM cash GROUP BY atm_id) c
       JOIN (SELECT atm_id, avg(amount) AS avg_withdraw, stddev_samp(amount) AS std_withdraw,
               count(*) / CAST(nullif(date_sub('day', min(transaction_time), max(transaction_time)), 0) AS DOUBLE)
                 AS daily_vol
             FROM tx WHERE transaction_type = 'withdrawal' GROUP BY atm_id) v ON c.atm_id = v.atm_id""",
)
def machine_profile(spark, d):
    return scoring.machine_profile(t.transactions_untyped(t.event_log(spark, d)), t.cash_status(t.event_log(spark, d)))


@query(
    "fleet_with_defaults",
    "atm_id health_score:f failure_probability:f activity_level days_to_depletion:f cash_stress_indicator:f "
    "error_acceleration:f",
    """SELECT s.atm_id, coalesce(health_score, 75) AS health_score,
         coalesce(failure_probability, 0.05e0) AS failure_probability,
         coalesce(activity_level, 'Moderate') AS activity_level, coalesce(days_to_depletion, 7) AS days_to_depletion,
         coalesce(cash_stress_indicator, 0.3e0) AS cash_stress_indicator,
         coalesce(error_acceleration, 0.1e0) AS error_acceleration
       FROM snapshot s LEFT JOIN (SELECT * FROM pred WHERE days_since_maintenance < 999) p ON s.atm_id = p.atm_id""",
)
def fleet_with_defaults(spark, d):
    """Only machines that were ever serviced are scored here, so the others take the defaults."""
    j = job(spark, d)
    known = j.predictions().filter(F.col("days_since_maintenance") < 999)
    return fleet.fleet_rows(j.snapshot(), known)


@query(
    "machine_detail",
    "atm_id name services card_types status health_score:f failure_probability:f activity_level cash_level:f "
    "days_to_depletion:f uptime_percentage:f error_acceleration:f alerts:a",
    """SELECT p.atm_id, m.location AS name, m.services, m.card_types, m.operational_status AS status, p.health_score,
         p.failure_probability, p.activity_level, floor((1 - cash_stress_indicator) * 100 + 0.5) AS cash_level,
         p.days_to_depletion, p.uptime_percentage, p.error_acceleration,
         f.alerts
       FROM pred p JOIN master m ON p.atm_id = m.atm_id JOIN fleet f ON f.atm_id = p.atm_id WHERE p.atm_id = '7'""",
)
def machine_detail(spark, d):
    return job(spark, d).machine("7")


@query(
    "alert_overlay",
    "atm_id health_score:f operational_status alerts:a",
    """SELECT p.atm_id, p.health_score, m.operational_status, f.alerts
       FROM pred p JOIN master m ON p.atm_id = m.atm_id JOIN fleet f ON f.atm_id = p.atm_id""",
)
def alert_overlay(spark, d):
    j = job(spark, d)
    current = j.master.select("atm_id", "operational_status")
    return alerts.with_alerts(scoring.overlay(j.predictions(), current))


# --- alerts and KPIs -------------------------------------------------------------------


@query("alerts_array", "atm_id alerts:a", "SELECT * FROM fleet")
def alerts_array(spark, d):
    return job(spark, d).table()


@query("alert_feed", "atm_id code severity", "SELECT * FROM feed")
def alert_feed(spark, d):
    return alerts.alert_feed(job(spark, d).table())


@query(
    "alert_counts",
    "severity alerts:i",
    """SELECT s.severity, count(f.code) AS alerts
       FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS severity) s
       LEFT JOIN feed f ON f.severity = s.severity GROUP BY s.severity""",
)
def alert_counts(spark, d):
    return alerts.alert_counts(alerts.alert_feed(job(spark, d).table()))


@query("top_alerts", "atm_id code severity",
       "SELECT * FROM (SELECT * FROM feed ORDER BY health_score, atm_id, alert_order LIMIT 5)")
def top_alerts(spark, d):
    return alerts.top_alerts(alerts.alert_feed(job(spark, d).table()))


@query(
    "fleet_kpis",
    "fleet_health_pct:f active_atms:i total_atms:i low_cash_alerts:i high_risk_atms:i offline_count:i",
    """SELECT round_even(avg(health_score), 1) AS fleet_health_pct,
         count(*) FILTER (WHERE s.operational_status = 'in_service') AS active_atms, count(*) AS total_atms,
         count(*) FILTER (WHERE cash_stress_indicator > 0.70e0) AS low_cash_alerts,
         count(*) FILTER (WHERE failure_probability > 0.50e0) AS high_risk_atms,
         count(*) - count(*) FILTER (WHERE s.operational_status = 'in_service') AS offline_count
       FROM snapshot s JOIN pred p ON s.atm_id = p.atm_id""",
)
def fleet_kpis(spark, d):
    return job(spark, d).kpis()


@query(
    "dashboard_kpis",
    "machines:i critical_count:i alert_machines:i alert_total:i avg_health:f total_transactions:i offline_count:i "
    "cash_alerts:i",
    f"""SELECT count(*) AS machines, count(*) FILTER (WHERE health_score < 55) AS critical_count,
          count(*) FILTER (WHERE len(alerts) > 0) AS alert_machines, sum(len(alerts)) AS alert_total,
          {half_up("avg(health_score)", 2)} AS avg_health, sum(transactions_24h) AS total_transactions,
          count(*) FILTER (WHERE status <> 'in_service') AS offline_count,
          count(*) FILTER (WHERE cash_level < 30) AS cash_alerts FROM fleet""",
)
def dashboard_kpis(spark, d):
    return fleet.dashboard_kpis(job(spark, d).table())


@query("fleet_health", _FLEET, "SELECT * FROM fleet")
def fleet_health(spark, d):
    return job(spark, d).health()


@query(
    "bands",
    "atm_id health_band cash_band uptime_band error_band failure_band",
    f"""SELECT atm_id, CASE WHEN health_score >= 80 THEN 'Healthy' WHEN health_score >= 55 THEN 'Fair' ELSE 'Critical' END
            AS health_band,
          CASE WHEN cash_level >= 50 THEN 'good' WHEN cash_level >= 30 THEN 'warn' ELSE 'bad' END AS cash_band,
          CASE WHEN {half_up("uptime", 2)} > 95 THEN 'good' WHEN {half_up("uptime", 2)} > 88 THEN 'warn' ELSE 'bad' END
            AS uptime_band,
          CASE WHEN {half_up("error_count / 7e0", 2)} > 8 THEN 'bad' WHEN {half_up("error_count / 7e0", 2)} > 4 THEN 'warn'
               ELSE 'good' END AS error_band,
          CASE WHEN {half_up("failure_probability", 2)} > 0.5e0 THEN 'bad'
               WHEN {half_up("failure_probability", 2)} > 0.2e0 THEN 'warn' ELSE 'good' END AS failure_band FROM fleet""",
)
def bands(spark, d):
    return fleet.bands(job(spark, d).table())


@query("fleet_filter", "atm_id status health_score:f",
       "SELECT * FROM fleet WHERE health_score >= 55 AND health_score < 80")
def fleet_filter(spark, d):
    return fleet.fleet_filter(job(spark, d).table(), "warning")


@query(
    "maintenance_queue",
    "atm_id priority issue eta",
    """SELECT atm_id, CASE WHEN health_score < 55 THEN 'CRITICAL' ELSE 'HIGH' END AS priority,
         'Automated ML flag. Cash: ' || regexp_replace(CAST(cash_level AS VARCHAR), '\\.0$', '') || '%, Health: '
           || regexp_replace(CAST(health_score AS VARCHAR), '\\.0$', '') || '%.' AS issue,
         CASE WHEN floor(days_to_depletion + 0.5) < 3 THEN 'Today' ELSE 'Tomorrow' END AS eta
       FROM fleet WHERE health_score < 80 OR cash_level < 35""",
)
def maintenance_queue(spark, d):
    return fleet.maintenance_queue(job(spark, d).table())


@query("depletion_ranking", "atm_id depletion_days:i days_to_depletion:f cash_level:f",
       "SELECT *, floor(days_to_depletion + 0.5) AS depletion_days FROM fleet")
def depletion_ranking(spark, d):
    return fleet.depletion_ranking(job(spark, d).table())


@query(
    "derived_rates",
    "atm_id error_rate:f hourly_velocity:i uptime_2dp:f cash_stress_2dp:f failure_2dp:f acceleration_2dp:f",
    f"""SELECT atm_id, {half_up("error_count / 7e0", 2)} AS error_rate,
          floor(transactions_24h / 24e0 + 0.5) AS hourly_velocity, {half_up("uptime", 2)} AS uptime_2dp,
          {half_up("1 - cash_level / 100e0", 2)} AS cash_stress_2dp, {half_up("failure_probability", 2)} AS failure_2dp,
          {half_up("error_acceleration", 2)} AS acceleration_2dp FROM fleet""",
)
def derived_rates(spark, d):
    return fleet.derived_rates(job(spark, d).table())


@query(
    "fleet_json",
    "atm_id json",
    """SELECT f.atm_id, to_json({'atm_id': f.atm_id, 'location': location, 'status': status,
         'health_score': health_score, 'days_to_depletion': days_to_depletion, 'alerts': alerts,
         'weekly_txns': weekly_txns}) AS json FROM fleet f JOIN week w ON f.atm_id = w.atm_id""",
)
def fleet_json(spark, d):
    rows = job(spark, d).table().select(
        "atm_id", "location", "status", "health_score", "days_to_depletion", "alerts",
        F.col("historical_series.weekly_txns").alias("weekly_txns"),
    )
    return to_json_rows(rows)


# --- finder ----------------------------------------------------------------------------


@query("service_filter", "atm_id services", "SELECT * FROM master WHERE regexp_matches(services, 'Dep.*, Tra')")
def service_filter(spark, d):
    return fleet.service_filter(t.atm_metadata(spark, d), "Dep.*, Tra")


@query(
    "nearby",
    "atm_id distance_km:f",
    f"""SELECT * FROM (SELECT atm_id, {distance("17.95e0", "-76.85e0", "lat", "lng")} AS distance_km FROM master)
        WHERE distance_km <= 2""",
)
def nearby(spark, d):
    return geo.near_point(t.atm_metadata(spark, d), 17.95, -76.85)


@query(
    "nearby_by_place",
    "radius_km:i atm_id distance_km:f",
    f"""SELECT radius_km, atm_id, distance_km
        FROM (SELECT atm_id, {distance("17.95e0", "-76.85e0", "lat", "lng")} AS distance_km FROM master), (SELECT unnest([1, 2, 5]) AS radius_km)
        WHERE distance_km <= radius_km""",
)
def nearby_by_place(spark, d):
    """Three searches over a master that is stored along a Z-order curve; a smaller circle opens fewer files."""
    path = work_path(spark, "by-place")
    layout.write_by_place(t.atm_metadata(spark, d), path, files=16)
    found = [layout.near_point_by_place(spark, path, 17.95, -76.85, r).withColumn("radius_km", F.lit(r)) for r in (1, 2, 5)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "nearby_join",
    "point_id atm_id distance_km:f",
    f"""SELECT * FROM (
          SELECT p.location AS point_id, m.atm_id, {distance("p.lat", "p.lng", "m.lat", "m.lng")} AS distance_km
          FROM (SELECT atm_id AS location, lat, lng FROM master) p
          CROSS JOIN master m) WHERE distance_km <= 2""",
)
def nearby_join(spark, d):
    """Machines around every machine."""
    master = t.atm_metadata(spark, d)
    points = master.select(F.col("atm_id").alias("point_id"), F.col("lat").alias("point_lat"), F.col("lng").alias("point_lng"))
    return geo.near_points(master, points)


def _found(spark, d):
    return job(spark, d).finder(service="Deposits", lat=17.95, lng=-76.85, radius_km=5.0)


@query("finder", _FOUND, "SELECT * FROM found")
def finder(spark, d):
    return _found(spark, d)


@query("finder_counts", "machines:i available:i low_cash:i",
       """SELECT count(*) AS machines, count(*) FILTER (WHERE status = 'in_service') AS available,
            count(*) FILTER (WHERE status = 'in_service' AND cash_level < 30) AS low_cash FROM found""")
def finder_counts(spark, d):
    return fleet.finder_counts(_found(spark, d))


@query("text_search", "atm_id name status",
       "SELECT * FROM found WHERE contains(lower(name), 'nation_1') AND status = 'in_service'")
def text_search(spark, d):
    return fleet.text_search(_found(spark, d), "Nation_1")


@query(
    "text_search_indexed",
    "wanted atm_id location atm_model",
    """SELECT w AS wanted, atm_id, location, atm_model FROM master, (SELECT unnest(['Nation_1', 'TION_2', 'deposits', 'm3', 'not there']) AS w)
       WHERE contains(lower(location), lower(w)) OR contains(lower(services), lower(w)) OR contains(lower(atm_model), lower(w))""",
)
def text_search_indexed(spark, d):
    """Five searches over posting lists of trigrams; one is too short for them, and one finds nothing."""
    index = TextIndex(spark, work_path(spark, "text-index"), ["location", "services", "atm_model"], buckets=8)
    index.build(t.atm_metadata(spark, d))
    out = None
    for wanted in ("Nation_1", "TION_2", "deposits", "m3", "not there"):
        one = index.search(wanted).withColumn("wanted", F.lit(wanted))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "services_array",
    "atm_id service_list:a has_service:i first_services:a more_services:i",
    """SELECT atm_id, l AS service_list, list_contains(l, 'Deposits') AS has_service, l[1:3] AS first_services,
         greatest(len(l) - 3, 0) AS more_services
       FROM (SELECT *, list_transform(string_split(services, ','), lambda x: trim(x)) AS l FROM master)""",
)
def services_array(spark, d):
    return fleet.services_view(t.atm_metadata(spark, d))


@query(
    "wait_class",
    "atm_id record_date:d level wait description",
    """SELECT atm_id, record_date,
         CASE WHEN n > 220 THEN 'High' WHEN n > 100 THEN 'Moderate' WHEN n > 0 THEN 'Low' ELSE '—' END AS level,
         CASE WHEN n > 220 THEN '5–10 min wait' WHEN n > 100 THEN '2–5 min wait' WHEN n > 0 THEN 'No wait'
              ELSE 'Unavailable' END AS wait,
         CASE WHEN n > 220 THEN 'Expect queues' WHEN n > 100 THEN 'Some wait expected'
              WHEN n > 0 THEN 'Usually available immediately' ELSE 'Machine offline' END AS description
       FROM (SELECT *, transaction_count * 60 AS n FROM daily)""",
)
def wait_class(spark, d):
    """Counts times 60: the small test tables have a few transactions per day only."""
    return job(spark, d).daily.withColumns(fleet.wait_class(F.col("transaction_count") * 60))


@query(
    "peak_flag",
    "atm_id peak_transactions:i other_transactions:i",
    """SELECT atm_id, count(*) FILTER (WHERE h BETWEEN 10 AND 12 OR h BETWEEN 15 AND 17) AS peak_transactions,
         count(*) FILTER (WHERE NOT (h BETWEEN 10 AND 12 OR h BETWEEN 15 AND 17)) AS other_transactions
       FROM (SELECT *, hour(transaction_time) AS h FROM tx) GROUP BY atm_id""",
)
def peak_flag(spark, d):
    return fleet.peak_share(t.transactions(t.event_log(spark, d)))


@query(
    "series_normalised",
    "atm_id share:af bar_pct:af",
    """SELECT atm_id, list_transform(weekly_txns, lambda v: v / greatest(list_max(weekly_txns), 1)::DOUBLE) AS share,
         list_transform(weekly_txns, lambda v: greatest(v / greatest(list_max(weekly_txns), 1)::DOUBLE * 100,
           CASE WHEN v > 0 THEN 4e0 ELSE 0e0 END)) AS bar_pct FROM week""",
)
def series_normalised(spark, d):
    week = scoring.weekly_series(job(spark, d).daily, AS_OF)
    return week.withColumns(fleet.normalised("weekly_txns"))
