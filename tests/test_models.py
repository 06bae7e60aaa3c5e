import numpy as np
import pytest
from frames import collect, fleet_days, one_row
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from tillwatch.operators import labels, models
from tillwatch.operators.features import features
from tillwatch.operators.ordering import row_positions, running_offsets
from tillwatch.session import work_path, workspace

SMALL = models.Sizes(trees=5, tree_depth=4, boosting_rounds=3, cluster_starts=2, lasso_alphas=20)
AS_OF = "2026-02-09"


@pytest.fixture(scope="module")
def labelled(spark):
    return labels.noisy_labels(labels.pseudo_labels(features(fleet_days(spark)))).cache()


def test_row_positions_have_no_gaps(spark):
    df = spark.range(2000).selectExpr("concat('m', id % 37) AS atm_id", "date_add(date'2026-01-01', int(id / 37)) AS record_date")
    rows = row_positions(df.repartition(13)).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(2000))
    assert [(r["atm_id"], r["record_date"]) for r in rows] == sorted((r["atm_id"], r["record_date"]) for r in rows)


def test_offsets_of_keys(spark):
    keys = spark.createDataFrame([("c", 5), ("a", 2), ("b", 7)], "k string, n long")
    got = collect(running_offsets(keys, "k", "n"), "k")
    assert [(r["key_rank"], r["row_offset"]) for r in got] == [(0, 0), (1, 2), (2, 9)]


@pytest.mark.parametrize("n", [5, 23, 60])
def test_folds_follow_the_expanding_scheme(spark, n):
    df = spark.range(n).selectExpr("'a' AS atm_id", "date_add(date'2026-01-01', int(id)) AS record_date")
    got = [r["fold"] for r in labels.expanding_folds(df).orderBy("row_index").collect()]
    k = min(5, max(2, n // 10))
    size = n // (k + 1)
    assert got == [0] * (n - k * size) + [i for i in range(1, k + 1) for _ in range(size)]


def test_labels_do_not_depend_on_partitioning(spark):
    base = labels.pseudo_labels(features(fleet_days(spark, 20, 2)))
    order = ["atm_id", "record_date"]
    a = labels.noisy_labels(base).select(*order, "y_health", "y_cash", "y_failure").orderBy(*order).collect()
    b = labels.noisy_labels(base.repartition(5, "record_date")).select(*order, "y_health", "y_cash", "y_failure")
    assert a == b.orderBy(*order).collect()


def test_noise_has_its_size(spark):
    rows = spark.range(20000).selectExpr(
        "cast(id AS string) AS atm_id", "date'2026-01-01' AS record_date", "50D AS y_health", "30D AS y_cash", "0 AS y_failure")
    s = labels.noisy_labels(rows).agg(F.stddev("y_health"), F.stddev("y_cash"), F.avg("y_failure"), F.avg("y_health")).first()
    assert s[0] == pytest.approx(2.5, rel=0.05) and s[1] == pytest.approx(0.5, rel=0.05)
    assert s[2] == pytest.approx(0.02, abs=0.005) and s[3] == pytest.approx(50, abs=0.1)


def test_the_health_forest_is_fitted_in_parts_of_bounded_size(spark, labelled, monkeypatch):
    """The task that stores a model holds all nodes of its trees; one of 200 full trees is too large for a cluster."""
    rows = models.model_input(labelled)
    for most, want in ((1 << 19, [20, 20, 5]), (120 * 8, [8] * 5 + [5]), (1, [1] * 45)):
        monkeypatch.setattr(models, "FOREST_TREE_ROWS", most, raising=False)
        model = models.health_estimator(models.Sizes(trees=45, tree_depth=3)).fit(rows)
        forests = [s for s in model.stages if isinstance(s, RandomForestRegressionModel)]
        assert [f.getNumTrees for f in forests] == want
        if len(want) < 10:
            scored = model.transform(rows).select("_health_x", "_health_pred").limit(5).collect()
            trees = [tree for f in forests for tree in f.trees]
            assert len({tree.toDebugString for tree in trees}) > 30  # no part repeats another one
            for r in scored:
                assert r["_health_pred"] == pytest.approx(np.mean([tree.predict(r["_health_x"]) for tree in trees]))
        assert sum(models.FleetModels(health=model).health_importances().values()) == pytest.approx(1)
        assert "_health_pred_0" not in model.transform(rows).columns


def test_train_store_load_score(spark, labelled):
    trained = models.train(labelled, SMALL)
    assert trained.metrics["rows_trained"] == 120 and not trained.metrics["used_real_labels"]
    assert set(trained.metrics["r2_by_fold"]) == {1, 2, 3, 4, 5}
    assert sum(trained.health_importances().values()) == pytest.approx(1)
    assert sorted(trained.activity_names().values()) == ["High", "Low", "Moderate"]
    path = work_path(spark, "models-test")
    trained.save(path)
    loaded = models.FleetModels.load(spark, path)
    feats = features(fleet_days(spark))
    a = collect(models.predict_fleet(feats, AS_OF, trained), "atm_id")
    b = collect(models.predict_fleet(feats, AS_OF, loaded), "atm_id")
    assert a == b and len(a) == 3
    for r in a:
        assert 0 <= r["health_score"] <= 100 and 0 <= r["failure_probability"] <= 1
        assert r["activity_level"] in {"Low", "Moderate", "High"} and 0 <= r["days_to_depletion"] <= 1


def test_a_large_forest_is_stored_and_scored_in_parts(spark, labelled, monkeypatch):
    """The driver holds no more than a pass of it; a forest that it holds whole gives the same figures."""
    rows, sizes = models.model_input(labelled), models.Sizes(trees=45, tree_depth=6)
    whole = models.health_estimator(sizes).fit(rows)
    monkeypatch.setattr(models, "FOREST_HELD", 0)
    monkeypatch.setattr(models, "FOREST_NODES", 1)
    monkeypatch.setattr(models, "FOREST_TREE_ROWS", 120 * 20)
    path, predictions = work_path(spark, "forest-test"), []
    with workspace(spark):
        model = models.health_estimator(sizes).fit(rows)
        assert not [s for s in model.stages if isinstance(s, RandomForestRegressionModel)]
        assert [[p.trees for p in some] for some in model.stages[-1].passes()] == [[20], [20], [5]]
        monkeypatch.setattr(models, "FOREST_NODES", sum(p.nodes for p in model.stages[-1].parts[:2]))
        assert [[p.trees for p in some] for some in model.stages[-1].passes()] == [[20, 20], [5]]
        models.FleetModels(health=model).save(path)
        predictions += [collect(model.transform(rows), "atm_id", "record_date")]
    loaded = models.FleetModels.load(spark, path)
    assert loaded.health_importances() == models.FleetModels(health=whole).health_importances()
    predictions += [collect(m.transform(rows), "atm_id", "record_date") for m in (loaded.health, whole)]
    for r in zip(*predictions):
        assert r[0]["_health_pred"] == r[1]["_health_pred"] == pytest.approx(r[2]["_health_pred"], abs=1e-12)
    assert len(predictions[0]) == 120 and list(predictions[0][0]) == list(predictions[2][0])
    rows = labelled.union(labelled).union(labelled.filter("false"))  # repeated rows are scored one by one
    assert loaded.health.transform(models.model_input(rows)).count() == 240
    assert loaded.health.transform(models.model_input(labelled.limit(0))).count() == 0


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_heads_in_parts_give_records(spark, labelled, monkeypatch, held):
    monkeypatch.setattr(models, "FOREST_HELD", held)
    trained = models.train(labelled, SMALL, score=False)
    got = collect(models.predict_fleet(features(fleet_days(spark)), AS_OF, trained), "atm_id")
    assert len(got) == 3 and all(0 <= r["health_score"] <= 100 for r in got)
    by_fold = models.train(labelled, SMALL, heads=("health",)).metrics["r2_by_fold"]
    assert set(by_fold) == {1, 2, 3, 4, 5} and all(v <= 1 for v in by_fold.values())
    assert models.skill(trained, labelled, "health") > 0.3


def test_one_class_skips_the_failure_model(spark, labelled):
    trained = models.train(labelled.withColumn("y_failure", F.lit(0)), SMALL, heads=("failure",))
    assert trained.failure is None


def test_no_data_and_few_rows(spark, labelled):
    assert models.train(labelled.limit(0), SMALL).metrics == {"status": "no_data"}
    few = models.train(labelled.filter("atm_id = 'ATM-000'").orderBy("record_date").limit(5), SMALL, heads=("health",))
    assert few.metrics["rows_trained"] == 5


def test_missing_and_null_features_become_zero(spark):
    rows = models.model_input(one_row(spark, uptime_percentage=None))
    r = rows.first()
    assert r["uptime_percentage"] == 0 and r["error_acceleration"] == 0


def test_penalty_search_equals_search_on_the_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    y = x @ np.array([3, 0, -2, 0, 0.5, 0, 0, 0]) + rng.normal(0, 1.0, 400)
    df = spark.createDataFrame([(int(i * 5 // 400), [float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y))],
                               "_fold int, _x array<double>, y_cash double")
    got = models.best_alpha(models._fold_sums(df, 8), 30)
    yc, xc = y - y.mean(), x - x.mean(0)
    top = np.abs(xc.T @ yc / 400).max()
    errors = []
    for alpha in np.geomspace(top, top * 1e-3, 30):
        total = 0
        for f in range(5):
            held = np.arange(400) * 5 // 400 == f
            mx, my = x[~held].mean(0), y[~held].mean()
            a, b, w = x[~held] - mx, y[~held] - my, np.zeros(8)
            for _ in range(200):
                for j in range(8):
                    r = b - a @ w + a[:, j] * w[j]
                    rho = a[:, j] @ r / len(b)
                    w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (a[:, j] @ a[:, j] / len(b))
            total += ((y[held] - my - (x[held] - mx) @ w) ** 2).mean()
        errors.append(total)
    assert got == pytest.approx(np.geomspace(top, top * 1e-3, 30)[int(np.argmin(errors))])
