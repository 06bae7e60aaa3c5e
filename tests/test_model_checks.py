"""A head that answers a constant turns the check of every model query red."""

import functools

import pytest
from check import differences, duck
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tillwatch.operators import models as m
from tillwatch.plans import model_queries
from tillwatch.plans.all_queries import CATALOG
from tillwatch.plans.feature_queries import fleet_features
from tillwatch.session import store

SF = "/root/testdata/sf0.001"
SMALL = m.Sizes(trees=5, tree_depth=5, boosting_rounds=3, cluster_starts=2)


class Constant:
    """Stands for an estimator and for the model it fits."""

    def __init__(self, column, value):
        self.column, self.value = column, value
        self.stages = [self]

    def fit(self, *_):
        return self

    def transform(self, rows):
        if self.column == "_cluster":
            rows = rows.withColumn("_activity_x", array_to_vector(F.array(*[F.col(c).cast("double") for c in m.ACTIVITY_FEATURES])))
        return rows.withColumn(self.column, self.value)

    def clusterCenters(self):
        return [Vectors.dense([float(i)] * len(m.ACTIVITY_FEATURES)).toArray() for i in range(3)]


STUBS = {
    "health": ("health_estimator", lambda: Constant("_health_pred", F.lit(77.0))),
    "failure": ("failure_estimator", lambda: Constant("_failure_prob", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))),
    "cash": ("fit_cash", lambda: Constant("_cash_pred", F.lit(0.4))),
    "activity": ("fit_activity", lambda: Constant("_cluster", F.lit(1))),
}


@pytest.fixture(scope="module")
def feats(spark):
    """The features, computed once for all cases."""
    return store(fleet_features(spark, SF), "test-features")


@pytest.mark.parametrize(
    "name, head",
    [("r2_per_fold", "health"), ("train_health", "health"), ("training_summary", "health"), ("train_failure", "failure"),
     ("train_activity", "activity"), ("train_cash", "cash"), ("predict_fleet", "failure")],
)
def test_constant_head_is_seen(spark, feats, monkeypatch, name, head):
    monkeypatch.setattr(model_queries, "fleet_features", lambda *_: feats)
    function, stub = STUBS[head]
    made = stub()
    monkeypatch.setattr(m, function, (lambda *a, **k: made))
    monkeypatch.setattr(model_queries, "train", functools.partial(m.train, sizes=SMALL))
    saved = []
    monkeypatch.setattr(m.FleetModels, "save", lambda self, path: saved.append(self))
    monkeypatch.setattr(m.FleetModels, "load", classmethod(lambda cls, spark, path: saved[-1]))
    found = differences(spark, duck(SF), CATALOG[name], SF)
    assert found and "rows differ" in found[0]


def test_skill_of_a_head_that_is_missing(spark):
    assert m.skill(m.FleetModels(), spark.createDataFrame([("A", 1.0)], "atm_id string, y_health double"), "health") == 0.0
