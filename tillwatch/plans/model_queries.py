"""Queries over labels, folds, models, imputation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwatch.operators import labels
from tillwatch.operators.impute import BOUNDS, METRICS, impute_metrics
from tillwatch.operators.models import CASH_FEATURES, FleetModels, lasso_conditions, predict_fleet, skill, train
from tillwatch.operators.rollup import days_from_partials
from tillwatch.plans.catalog import query
from tillwatch.plans.check_sql import AS_OF, FIXTURE_HOLIDAYS, normal, uniform
from tillwatch.plans.fleet_plan import FleetJob
from tillwatch.plans.feature_queries import fleet_features
from tillwatch.plans.raw_queries import daily, gappy
from tillwatch.session import work_path
from tillwatch.sources import tables as t
from tillwatch.sources.ingest import read_table
from tillwatch.streaming import ingest as stream

_LABELS = "atm_id record_date:d y_health:f y_failure:i y_cash:f"
_LABELS_SQL = """
    SELECT atm_id, record_date, least(greatest(composite_health_score, 0), 100) AS y_health,
      CASE WHEN failure_risk_score > 0.5e0 THEN 1 ELSE 0 END AS y_failure,
      least(greatest(ending_cash_balance / (greatest(cash_consumption_rate, 1) * 24), 0), 60) AS y_cash FROM feat_all"""


@query("pseudo_labels", _LABELS, _LABELS_SQL)
def pseudo_labels(spark, d):
    return labels.pseudo_labels(fleet_features(spark, d))


def _training(spark, d):
    return labels.noisy_labels(labels.pseudo_labels(fleet_features(spark, d)))


@query(
    "noisy_labels",
    _LABELS,
    f"""SELECT atm_id, record_date, least(greatest(y_health + 2.5e0 * {normal(42)}, 0), 100) AS y_health,
          CASE WHEN {uniform(62)} < 0.02 THEN 1 - y_failure ELSE y_failure END AS y_failure,
          least(greatest(y_cash + 0.5e0 * {normal(52)}, 0), 60) AS y_cash FROM ({_LABELS_SQL})""",
)
def noisy_labels(spark, d):
    return _training(spark, d)


def _measured(spark, d):
    """A label table: every second machine, with the clean formula values as measurements."""
    clean = labels.pseudo_labels(fleet_features(spark, d)).filter(F.col("atm_id").cast("long") % 2 == 0)
    return clean.select(
        "atm_id",
        "record_date",
        F.col("y_health").alias("actual_health_score"),
        F.col("y_failure").alias("actual_failed_next_7_days"),
        F.col("y_cash").alias("actual_days_to_depletion"),
    )


@query(
    "label_join",
    f"{_LABELS} composite_health_score:f",
    f"""SELECT l.*, f.composite_health_score FROM ({_LABELS_SQL}) l
        JOIN feat_all f ON l.atm_id = f.atm_id AND l.record_date = f.record_date
        WHERE CAST(l.atm_id AS BIGINT) % 2 = 0""",
)
def label_join(spark, d):
    return labels.join_labels(fleet_features(spark, d), _measured(spark, d))


@query(
    "ts_folds",
    "atm_id record_date:d row_index:i fold:i",
    """SELECT *, CASE WHEN row_index < n - k * size THEN 0
                      ELSE 1 + (row_index - (n - k * size)) // size END AS fold
       FROM (SELECT *, n // (k + 1) AS size FROM (
         SELECT atm_id, record_date, row_number() OVER (ORDER BY atm_id, record_date) - 1 AS row_index,
           count(*) OVER () AS n, least(5, greatest(2, count(*) OVER () // 10)) AS k FROM sup_days))""",
)
def ts_folds(spark, d):
    return labels.expanding_folds(t.supplier_days(spark, d).select("atm_id", "record_date"))


# Fitted values differ between libraries. What is exact: who gets a prediction, the ranges, the folds, and that
# every head explains at least so much of its labels (a constant explains nothing).
_MACHINES = "SELECT DISTINCT atm_id FROM feat_all"
LEAST_SKILL = {"health": 0.6, "cash": 0.1, "failure": 0.5, "activity": 0.4}
LEAST_FOLD_R2 = 0.5


@query(
    "r2_per_fold",
    "fold:i is_share beats_mean",
    """SELECT unnest(range(1, k + 1)) AS fold, true AS is_share, true AS beats_mean
       FROM (SELECT least(5, greatest(2, count(*) // 10)) AS k FROM feat_all)""",
)
def r2_per_fold(spark, d):
    """One score per fold: at most 1, and well above that of the mean, which is 0."""
    models = train(_training(spark, d), heads=("health",))
    scores = spark.createDataFrame(list(models.metrics["r2_by_fold"].items()), "fold int, r2 double")
    return scores.select("fold", (F.col("r2") <= 1).alias("is_share"), (F.col("r2") >= LEAST_FOLD_R2).alias("beats_mean"))


def _skilled(models, rows, head):
    return F.lit(skill(models, rows, head) >= LEAST_SKILL[head])


def _apply(spark, d, head):
    """The predictions of one trained head, and whether it explains its labels."""
    rows = _training(spark, d)
    models = train(rows, heads=(head,), score=False)
    return predict_fleet(fleet_features(spark, d), AS_OF, models).withColumn("explains_labels", _skilled(models, rows, head))


def _within(column, low, high):
    return F.col(column).between(low, high).alias("in_range")


_HEAD = "atm_id in_range explains_labels"
_HEAD_SQL = f"SELECT atm_id, true AS in_range, true AS explains_labels FROM ({_MACHINES})"


@query("train_health", _HEAD, _HEAD_SQL)
def train_health(spark, d):
    return _apply(spark, d, "health").select("atm_id", _within("health_score", 0, 100), "explains_labels")


@query("train_cash", _HEAD, _HEAD_SQL)
def train_cash(spark, d):
    return _apply(spark, d, "cash").select("atm_id", _within("days_to_depletion", 0, 1), "explains_labels")


@query(
    "cash_optimum",
    "feature optimal",
    f"SELECT unnest([{', '.join(repr(c) for c in CASH_FEATURES)}]) AS feature, true AS optimal",
)
def cash_optimum(spark, d):
    """The optimality conditions of the fitted lasso on its training rows, per feature."""
    rows = _training(spark, d)
    return lasso_conditions(rows, train(rows, heads=("cash",)).cash, 1e-4).select("feature", "optimal")


@query("train_failure", _HEAD, _HEAD_SQL)
def train_failure(spark, d):
    """Also: its log loss on the labels is at most half of the label rate's."""
    return _apply(spark, d, "failure").select("atm_id", _within("failure_probability", 0, 1), "explains_labels")


@query(
    "train_activity",
    "atm_id known_level levels:i explains_labels",
    f"SELECT atm_id, true AS known_level, 3 AS levels, true AS explains_labels FROM ({_MACHINES})",
)
def train_activity(spark, d):
    """Also: every training row is in the cluster of its nearest centre, and the clusters are much tighter than one."""
    rows = _training(spark, d)
    models = train(rows, heads=("activity",))
    levels = predict_fleet(fleet_features(spark, d), AS_OF, models)
    known = F.col("activity_level").isin("Low", "Moderate", "High")
    return levels.select(
        "atm_id", known.alias("known_level"), F.lit(len(models.activity_names())).alias("levels"),
        _skilled(models, rows, "activity").alias("explains_labels"),
    )


@query(
    "training_summary",
    "rows_trained:i used_real_labels is_share beats_mean",
    "SELECT count(*) AS rows_trained, true AS used_real_labels, true AS is_share, true AS beats_mean FROM feat_all WHERE CAST(atm_id AS BIGINT) % 2 = 0",
)
def training_summary(spark, d):
    labelled = labels.join_labels(fleet_features(spark, d), _measured(spark, d))
    m = train(labelled, real_labels=True, heads=("health",)).metrics
    return spark.createDataFrame(
        [(m["rows_trained"], m["used_real_labels"], m["health_r2"] <= 1, m["health_r2"] >= LEAST_FOLD_R2)],
        "rows_trained long, used_real_labels boolean, is_share boolean, beats_mean boolean",
    )


_HEAD_FIGURES = ["health_score", "failure_probability", "days_to_depletion", "activity_level"]


@query(
    "predict_fleet",
    "atm_id transactions_24h_predicted:i in_range same_as_trained explains_labels",
    "SELECT atm_id, transactions_24h_predicted, true AS in_range, true AS same_as_trained, true AS explains_labels FROM pred",
)
def fleet_predictions(spark, d):
    """All four heads, trained, stored, loaded again and applied to the last 90 days of the fleet. The loaded ones
    give the figures of the trained ones, and each explains its labels."""
    path = work_path(spark, "models")
    rows, raw = _training(spark, d), t.raw_tables(spark, d)
    trained = train(rows, score=False)
    trained.save(path)
    loaded = FleetModels.load(spark, path)
    ranges = {"health_score": (0, 100), "failure_probability": (0, 1), "days_to_depletion": (0, 1)}
    good = F.col("activity_level").isin("Low", "Moderate", "High")
    for column, (low, high) in ranges.items():
        good = good & F.col(column).between(low, high)
    skilled = all(skill(loaded, rows, head) >= LEAST_SKILL[head] for head in FleetModels.HEADS)
    before = FleetJob(raw, AS_OF, anchor=AS_OF, models=trained).predictions()
    before = before.select("atm_id", F.struct(*_HEAD_FIGURES).alias("_before"))
    after = FleetJob(raw, AS_OF, anchor=AS_OF, models=loaded).predictions().join(before, "atm_id", "left")
    return after.select(
        "atm_id", "transactions_24h_predicted", good.alias("in_range"),
        F.struct(*_HEAD_FIGURES).eqNullSafe(F.col("_before")).alias("same_as_trained"), F.lit(skilled).alias("explains_labels"),
    )


@query(
    "impute_metrics",
    "atm_id n_rows:i n_null:i n_out:i n_changed:i",
    "SELECT atm_id, count(*) AS n_rows, 0 AS n_null, 0 AS n_out, 0 AS n_changed FROM daily GROUP BY atm_id",
)
def imputed(spark, d):
    """Per machine: rows, nulls left, rows out of bounds or with an end above the start, and observed
    values that changed by more than the rounding to whole numbers."""
    given = gappy(daily(spark, d))
    filled = impute_metrics(given)
    before = given.select("atm_id", "record_date", *[F.col(m).alias(f"_old_{m}") for m in METRICS])
    both = filled.join(before, ["atm_id", "record_date"])
    null, out, changed = (F.lit(False) for _ in range(3))
    for m in METRICS:
        low, high = BOUNDS[m]
        old = F.col(f"_old_{m}")
        null = null | F.col(m).isNull()
        out = out | ~F.col(m).between(low, high)
        if m == "ending_cash_balance":  # an observed end above the start is cut to it by the domain rules
            old = F.when(old.isNotNull(), F.least(old, F.col("starting_cash_balance")))
        changed = changed | F.coalesce(F.abs(F.col(m) - old) > 0.5, F.lit(False))
    out = out | (F.col("ending_cash_balance") > F.col("starting_cash_balance"))
    return both.groupBy("atm_id").agg(
        F.count("*").alias("n_rows"), F.count_if(null).alias("n_null"), F.count_if(out).alias("n_out"),
        F.count_if(changed).alias("n_changed"),
    )


# --- streams ------------------------------------------------------------------------------


def _event_stream(spark, d):
    return stream.read_files(spark, f"{d}/events*.parquet", t.TABLE_SCHEMAS["events"])


def _finished(spark, rows, purpose):
    """Run the stream over the files at hand and read what it wrote."""
    target, checkpoint = work_path(spark, purpose), work_path(spark, f"{purpose}-checkpoint")
    stream.append_to(rows, target, checkpoint).awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


@query("stream_ingest", "transaction_id:i atm_id transaction_time:t amount:f transaction_type", "SELECT * FROM tx")
def stream_ingest(spark, d):
    """The same files arrive twice; each transaction is kept once."""
    once, again = (t.transactions(t.event_rows(_event_stream(spark, d))) for _ in range(2))
    return _finished(spark, stream.distinct_rows(once.union(again), "transaction_id", "transaction_time"), "ingest")


@query(
    "stream_daily_tx",
    "atm_id record_date:d transaction_count:i daily_withdrawal_amount:f avg_transaction_amount:f "
    "daily_deposit_count:i daily_deposit_amount:f",
    "SELECT * FROM tx_days WHERE record_date + INTERVAL 1 DAY <= (SELECT max(transaction_time) FROM tx) - INTERVAL 1 DAY",
)
def stream_daily_tx(spark, d):
    """Equals the batch roll-up for the days that are closed."""
    tx = t.transactions(t.event_rows(_event_stream(spark, d)))
    return _finished(spark, stream.daily_transactions(tx), "daily-tx")


def _parts_by_day():
    """Conditions that cut the transactions into early, middle and newest days."""
    day, newest = F.to_date("transaction_time"), F.lit(AS_OF).cast("date")
    return day < F.date_sub(newest, 20), day.between(F.date_sub(newest, 20), F.date_sub(newest, 6)), day >= F.date_sub(newest, 5)


@query("stream_late_rows", "transaction_id:i atm_id transaction_time:t amount:f transaction_type transaction_status:i", "SELECT * FROM tx")
def stream_late_rows(spark, d):
    """Four files, one per trigger: late days first, then the newest, then the oldest, then the first again."""
    folder, target = work_path(spark, "late-files"), work_path(spark, "late-table")
    tx = t.transactions(t.event_log(spark, d))
    first, middle, last = _parts_by_day()
    for part in (first, last, middle, first):
        tx.filter(part).coalesce(1).write.mode("append").parquet(folder)
    rows = stream.read_files(spark, folder, tx.schema, max_files=1)
    stream.ingest_all(rows, target, work_path(spark, "late-checkpoint"), "transaction_time").awaitTermination()
    return read_table(spark, target)


@query(
    "stream_daily_late",
    "atm_id record_date:d transaction_count:i daily_withdrawal_amount:f avg_transaction_amount:f "
    "daily_deposit_count:i daily_deposit_amount:f",
    "SELECT * FROM tx_days",
)
def stream_daily_late(spark, d):
    """Files of newest, oldest and middle days, each day's rows spread over several of them: every day is complete."""
    folder = work_path(spark, "late-sums")
    tx = t.transactions(t.event_log(spark, d))
    first, middle, last = _parts_by_day()
    odd = F.col("transaction_id") % 2 == 1
    for part in (last & odd, first & ~odd, middle, first & odd, last & ~odd):
        tx.filter(part).coalesce(1).write.mode("append").parquet(folder)
    sums = stream.daily_sums(spark, work_path(spark, "daily-sums"))
    rows = stream.read_files(spark, folder, tx.schema, max_files=1)
    stream.roll_up_late(rows, sums, work_path(spark, "daily-sums-checkpoint")).awaitTermination()
    return days_from_partials(sums.read())


@query(
    "stream_features",
    "atm_id record_date:d composite_health_score:f",
    "SELECT atm_id, record_date, composite_health_score FROM feat_all WHERE CAST(atm_id AS BIGINT) % 2 = 0",
)
def stream_features(spark, d):
    """Two batches name the even machines, some of them twice; each machine has one current version."""
    folder, target = work_path(spark, "changed"), work_path(spark, "current-features")
    even = daily(spark, d).select("atm_id").distinct().filter(F.col("atm_id").cast("long") % 2 == 0)
    even.coalesce(1).write.parquet(folder)
    even.filter(F.col("atm_id").cast("long") % 4 == 0).coalesce(1).write.mode("append").parquet(folder)
    changed = stream.read_files(spark, folder, even.schema, max_files=1)
    stream.refresh_features(changed, daily(spark, d), target, work_path(spark, "changed-checkpoint"), FIXTURE_HOLIDAYS).awaitTermination()
    return stream.current_features(spark, target)
