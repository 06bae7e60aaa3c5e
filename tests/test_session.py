"""Where a cluster's jobs store what they write."""

import functools

import pytest
from check import differences, duck

from tillwatch import session
from tillwatch.operators.models import Sizes, train
from tillwatch.plans import model_queries
from tillwatch.plans.all_queries import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture
def settings(spark, monkeypatch):
    """Settings that the session is to show instead of its own."""
    shown, get = {}, type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: shown[key] if key in shown else get(self, key, *a))
    return shown


@pytest.fixture
def cluster(spark, settings, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_SHARED", set(), raising=False)
    return spark


@pytest.fixture
def named(cluster, settings, tmp_path):
    settings["spark.checkpoint.dir"] = f"file://{tmp_path}/shared"
    return cluster


def test_a_shared_folder_of_scheme_file_is_taken(named, tmp_path):
    assert session.shared_dir(named) == f"file://{tmp_path}/shared"
    assert list((tmp_path / "shared" / "tillwatch").iterdir()) == []


def test_a_folder_that_lacks_written_rows_is_refused(named, monkeypatch):
    monkeypatch.setattr(session, "rows_seen", lambda spark, folder, rows: rows - 1)
    with pytest.raises(RuntimeError, match="cannot see it"):
        session.shared_dir(named)


def test_without_a_named_folder_a_cluster_uses_the_warehouse(cluster, settings, tmp_path, monkeypatch):
    monkeypatch.setattr(cluster.sparkContext, "getCheckpointDir", lambda: None)
    settings |= {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": f"file:{tmp_path}"}
    assert session.shared_dir(cluster) == f"file:{tmp_path}/tillwatch-shared"


STORING = [
    "cash_balances_all_readings", "cash_optimum", "csv_in_order", "daily_from_csv", "features_by_day", "impute_metrics", "last_days_by_footer",
    "nearby_by_place", "scan_cash", "stream_daily_tx", "stream_late_rows", "text_search_indexed", "upsert_written",
]


@pytest.mark.parametrize("name", STORING)
def test_storing_queries_run_on_a_cluster(named, name, monkeypatch):
    small = Sizes(trees=5, tree_depth=5, boosting_rounds=3, cluster_starts=2)
    monkeypatch.setattr(model_queries, "train", functools.partial(train, sizes=small))
    assert differences(named, duck(SF), CATALOG[name], SF) == []


OTHERS = [
    "features_all_readings", "scan_logs", "scan_maintenance", "scan_metadata", "scan_raw",
    "scan_transactions", "stream_daily_late", "stream_features", "stream_ingest",
]


@pytest.mark.parametrize("name", OTHERS)
def test_the_other_storing_queries_run_on_a_cluster(named, name):
    assert differences(named, duck(SF), CATALOG[name], SF) == []


@pytest.mark.parametrize("name", ["predict_fleet", "r2_per_fold"])
def test_queries_with_a_forest_in_parts_run_on_a_cluster(named, name, monkeypatch):
    """Its parts are fitted, stored, loaded and averaged; the figures of small models need not reach the least skill."""
    small = Sizes(trees=25, tree_depth=6, boosting_rounds=3, cluster_starts=2)
    monkeypatch.setattr(model_queries, "train", functools.partial(train, sizes=small))
    monkeypatch.setattr(model_queries, "LEAST_SKILL", dict.fromkeys(model_queries.LEAST_SKILL, -1e9))
    monkeypatch.setattr(model_queries, "LEAST_FOLD_R2", -1e9)
    assert differences(named, duck(SF), CATALOG[name], SF) == []
