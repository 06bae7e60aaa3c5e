"""Every named query gives the rows of its SQL."""

import functools

import pytest
from check import differences, duck

import __spark_entry__ as contract
from tillwatch.operators.models import Sizes, train
from tillwatch.plans import model_queries
from tillwatch.plans.all_queries import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query_equals_sql(spark, con, name, monkeypatch):
    # The queries fit models of full size; here smaller ones keep the suite short.
    small = Sizes(trees=5, tree_depth=5, boosting_rounds=3, cluster_starts=2)
    monkeypatch.setattr(model_queries, "train", functools.partial(train, sizes=small))
    assert differences(spark, con, CATALOG[name], SF) == []


def test_every_query_has_sql():
    assert [n for n, q in CATALOG.items() if q.sql is None] == []


@pytest.mark.parametrize("name", ["fleet_with_defaults", "fleet_health", "predict_formula", "finder", "maintenance_queue"])
def test_generated_code_compiles_under_default_settings(spark, name):
    own = {"spark.sql.codegen.hugeMethodLimit": "65535", "spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        assert CATALOG[name].run(spark, SF).count() > 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
