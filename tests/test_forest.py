"""The trees of a forest against a recursive search over all splits, and against Spark's own forest."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tillwatch.operators import forest, models


def _searched(codes, n, s, q, depth, leaf_rows):
    """(feature, cut, left, right) or the leaf's mean, by trying every split."""
    total, mean = n.sum(), s.sum() / n.sum()
    best = None
    for f in range(len(codes)):
        for cut in np.unique(codes[f])[:-1]:
            left = codes[f] <= cut
            if min(n[left].sum(), n[~left].sum()) < leaf_rows:
                continue
            score = s[left].sum() ** 2 / n[left].sum() + s[~left].sum() ** 2 / n[~left].sum()
            if best is None or score > best[0] + 1e-9:
                best = score, f, cut, left
    if depth == 0 or best is None or best[0] - s.sum() ** 2 / total <= 1e-9 * total:
        return mean
    _, f, cut, left = best
    below = [_searched(codes[:, some], n[some], s[some], q[some], depth - 1, leaf_rows) for some in (left, ~left)]
    return f, cut, *below


def _nested(tree, node=0):
    if tree["feature"][node] < 0:
        return tree["value"][node]
    left = tree["left"][node]
    return tree["feature"][node], tree["cut"][node], _nested(tree, left), _nested(tree, left + 1)


def _same(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b)
    return a[:2] == b[:2] and _same(a[2], b[2]) and _same(a[3], b[3])


@pytest.mark.parametrize("cells, bins, depth, leaf_rows", [(1, 3, 30, 1), (2, 2, 30, 1), (60, 4, 30, 1), (300, 8, 30, 1), (300, 8, 3, 1), (200, 6, 30, 5)])
def test_a_tree_equals_a_search_over_all_splits(cells, bins, depth, leaf_rows):
    rng = np.random.default_rng(cells)
    codes = np.unique(rng.integers(0, bins, (3, cells)), axis=1).astype(np.int16)
    n = rng.integers(1, 4, codes.shape[1]).astype(float)
    y = rng.normal(size=len(n))
    y[codes[0] == 0] = 1.0  # some nodes have equal labels
    tree = forest.grow(codes, n, n * y, n * y * y, depth, leaf_rows)
    assert _same(_nested(tree), _searched(codes, n, n * y, n * y * y, depth, leaf_rows))
    inner = tree["feature"] >= 0
    children = np.concatenate([tree["left"][inner], tree["left"][inner] + 1])
    assert sorted(children) == list(range(1, len(inner)))
    assert tree["count"][0] == n.sum() and tree["count"][~inner].sum() == n.sum()


def test_an_empty_bag_is_a_leaf():
    none = np.zeros(0)
    tree = forest.grow(np.zeros((2, 0), np.int16), none, none, none, 30)
    assert list(tree["feature"]) == [-1] and list(tree["value"]) == [0]


def test_thresholds_lie_between_all_few_values_or_at_equal_ranks(spark):
    rows = spark.range(6000).select(F.array(
        (F.col("id") % 3).cast("double"), F.when(F.col("id") == 5, 9.0).otherwise(1.0), F.col("id").cast("double"), F.lit(2.0),
        F.when(F.col("id") < 5000, 0.0).otherwise(F.col("id").cast("double"))).alias("x"), F.lit(0.0).alias("y"))
    few, rare, even, constant, heavy = forest.find_thresholds(rows.repartition(5), 5, 32)
    assert list(few) == [0.5, 1.5] and list(rare) == [5.0] and list(constant) == []
    assert len(even) == 31 and np.abs(np.diff(even) - 6000 / 32).max() < 8
    assert len(heavy) > 5 and heavy[0] < 5000  # the rows beside the heavy value are told apart
    codes = forest.binned(np.array([[0.5, 1, 0, 2, 0.0], [0.6, 9, 5999, 2, 1e9]]), [few, rare, even, constant, heavy])
    assert codes.T.tolist() == [[0, 0, 0, 0, 0], [1, 1, 31, 0, len(heavy)]]


def _rows(spark, n):
    x = [(F.xxhash64("id", F.lit(i)) % 1000 / 1000.0) for i in range(5)]
    rows = spark.range(n).select("id", *[c.alias(name) for c, name in zip(x, models.HEALTH_FEATURES)])
    noise = F.xxhash64("id", F.lit(9)) % 100 / 100.0
    return rows.withColumn("y_health", 50 + 20 * F.col("uptime_percentage") * F.col("error_count_7d") + 5 * F.col("transaction_velocity") + noise)


def _error(model, rows):
    return model.transform(rows).agg(F.avg(F.pow(F.col("_health_pred") - F.col("y_health"), 2))).first()[0]


def test_the_forest_predicts_new_rows_as_well_as_sparks(spark):
    known, new = _rows(spark, 3000).cache(), _rows(spark, 4000).filter("id >= 3000").cache()
    sizes = models.Sizes(trees=30, tree_depth=12)
    own = models.health_estimator(sizes).fit(known)
    prepared = [own.stages[1].transform(own.stages[0].transform(rows)) for rows in (known, new)]
    spark_errors = []
    for seed in (1, 11):  # one seed's error on new rows is up to a third above another's
        sparks = RandomForestRegressor(featuresCol="_health_x", labelCol="y_health", predictionCol="_health_pred", numTrees=30, maxDepth=12,
                                       maxBins=32, featureSubsetStrategy="all", seed=seed).fit(prepared[0])
        spark_errors.append([_error(sparks, rows) for rows in prepared])
    on_known, on_new = np.mean(spark_errors, axis=0)
    assert _error(own, known) < 1.15 * on_known
    assert _error(own, new) < 1.25 * on_new


def test_a_forest_does_not_hang_on_partitions_or_tasks(spark, monkeypatch):
    """Bags are drawn by rows: cells of many rows are dealt out, and every row is drawn with mean 1."""
    monkeypatch.setattr(models, "FOREST_HELD", 0)
    rows = _rows(spark, 900).withColumns({c: F.lit(0.0) for c in models.HEALTH_FEATURES[2:]})
    sizes = models.Sizes(trees=6, tree_depth=30, tree_bins=4)
    fits = [models.health_estimator(sizes).fit(rows.repartition(n)) for n in (1, 7)]
    first, second = (m.stages[-1].parts for m in fits)
    assert [(p.trees, p.nodes) for p in first] == [(p.trees, p.nodes) for p in second]
    assert first[0].importances == pytest.approx(second[0].importances)
    monkeypatch.setattr(models, "FOREST_ROWS", 20)  # a cell has about 56 rows
    dealt = models.health_estimator(sizes).fit(rows)
    assert 0.9 < _error(dealt, rows) / _error(fits[0], rows) < 1.1
    vectors = spark.createDataFrame([([1.0, 1.0], 2.0)] * 4000 + [([0.0, 1.0], 2.0)], "x array<double>, y double")
    cells = forest.cells_of(vectors, [np.array([0.5]), np.array([])], 1.0)
    assert sorted((r["cell"], r["label"], r["m"]) for r in cells.collect()) == [(0, 1.0, 1), (1, 1.0, 4000)]
    trees = forest.trees_of(cells, [np.array([0.5]), np.array([])], 1.0, forest.Growth(40, 30, 32, 1, 42), 100, True).collect()
    count = [np.frombuffer(r["count"], np.float64)[0] for r in trees]
    assert sorted(r["tree"] for r in trees) == list(range(40)) and abs(np.mean(count) - 4001) < 4 * 4001**0.5 / 40**0.5


def test_rows_without_a_label_are_refused(spark):
    rows = _rows(spark, 20).withColumn("y_health", F.when(F.col("id") > 3, F.col("y_health")))
    with pytest.raises(ValueError, match="4 of 20"):
        models.health_estimator(models.Sizes(trees=2)).fit(rows)


def _jobs(spark, name, call):
    spark.sparkContext.setJobGroup(name, name)
    try:
        result = call()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_a_fit_and_a_score_are_a_few_jobs(spark, monkeypatch):
    """However deep the trees are; fits by levels took a job or more per level and part, for each of the folds anew."""
    monkeypatch.setattr(models, "FOREST_HELD", 0)
    monkeypatch.setattr(models, "FOREST_TREE_ROWS", 1)
    rows = _rows(spark, 1200).cache()
    model, jobs = _jobs(spark, "fit", lambda: models.health_estimator(models.Sizes(trees=12)).fit(rows))
    assert jobs < 25 and max(p.nodes for p in model.stages[-1].parts) > 500
    _, jobs = _jobs(spark, "score", lambda: model.transform(rows))
    assert jobs <= 2  # the trees are loaded; the rows wait until they are asked for
