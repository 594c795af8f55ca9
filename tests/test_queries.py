import pytest

from ampflow.operators.features import TARGET
from ampflow.plans import oracle, queries
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()
QUERIES = queries.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), SQL[name], FOLDER)


def test_every_query_is_native_but_for_the_recursive_ones(spark):
    python = {"kalman_smooth", "trip_discrepancy", "isolation_confidence", "boosted_trees_predictions"}
    for name in ("trip_carbon", "gps_summary", "rolling_features", "bms_anomalies", "delayed_devices"):
        assert name not in python
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan


def test_windows_of_one_device_share_a_shuffle(spark):
    plan = QUERIES["rolling_features"](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan
    ran = QUERIES["rolling_features"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert ran.count("Exchange hashpartitioning") == 1


def test_isolation_confidence_spans_zero_to_one(spark):
    found = [r.confidence for r in QUERIES["isolation_confidence"](spark, FOLDER).collect()]
    assert min(found) == 0.0 and max(found) == 1.0


def test_entry_gives_trips(spark):
    import __spark_entry__

    assert "net_tco2e" in __spark_entry__.entry(spark).columns


def test_tracks_keep_more_than_a_few_positions(spark):
    found = [r.n_points for r in QUERIES["trip_track_km"](spark, "/root/testdata/sf0.01").collect()]
    assert max(found) > 4 and max(found) <= 50


def test_scored_anomalies_carry_the_confidence_of_the_forest(spark):
    scored = QUERIES["bms_anomalies_scored"](spark, FOLDER)
    of = {(r.device_id, r.ts): r.confidence for r in QUERIES["isolation_confidence"](spark, FOLDER).collect()}
    found = [(r.confidence_score, of[r.device_id, r.ts]) for r in scored.collect()]
    assert len({c for c, _ in found}) > 1 and all(abs(a - b) <= 1e-4 for a, b in found)


def test_models_are_reached_by_queries(spark):
    few = queries._boosted_grid(queries.telemetry(spark, FOLDER), {"stepSize": (0.1,), "maxDepth": (2,), "maxIter": (1, 2)})
    for found in (few, QUERIES["sequence_model_predictions"](spark, FOLDER)):
        assert found.columns == ["device_id", "ts", TARGET, "prediction"]
        assert found.where("prediction is null").count() == 0
    assert "boosted_trees_grid_predictions" in QUERIES
