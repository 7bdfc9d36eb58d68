import pytest
from pyspark.sql import functions as F

from fluxloom.operators import preprocess as P
from fluxloom.operators import stats as S
from fluxloom.operators import subset as U
from fluxloom.schema import LightCurves

SCHEMA = "object_id long, event_id long, mjd double, filter string, flux double, flux_error double, detected boolean"


def curves(spark, *objects):
    rows = [(o, i, float(t), "lsstr", 1.0, 1.0, bool(d)) for o, points in enumerate(objects) for i, (t, d) in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def times(df):
    out = {}
    for r in df.orderBy("object_id", "mjd").collect():
        out.setdefault(r.object_id, []).append(r.mjd)
    return out


def test_gap_sides(spark):
    obs = curves(
        spark,
        [(5, 0)],  # a single observation
        [(0, 1), (2, 1)],  # a gap equal to the threshold is not above it
        [(0, 1), (1, 0), (9, 1), (10, 0)],  # a tie in both keeps the earlier side
        [(0, 1), (9, 1), (10, 0)],  # more observations win a tie of detections
        [(0, 0), (1, 1), (9, 0)],  # more detections win
        [(0, 1), (2, 1), (9, 0)],  # the cut is at the first gap that reaches the threshold, and detections tie
    )
    assert times(P.remove_gap(obs, 2.0)) == {0: [0.0], 1: [0.0, 2.0], 2: [0.0, 1.0], 3: [0.0, 1.0], 4: [0.0, 1.0], 5: [0.0, 7.0]}


def test_transients(spark):
    obs = curves(spark, [(0, 0), (5, 1), (6, 1), (8, 0), (9, 0)], [(0, 0), (5, 1), (50, 0)])
    assert times(P.select_transients(obs, 3.0)) == {0: [0.0, 1.0, 3.0], 1: [0.0, 5.0, 50.0]}


def test_window_needs_a_limit(spark):
    with pytest.raises(ValueError):
        P.select_window(curves(spark, [(0, 0)]))


def test_single_observation_has_no_gap(spark):
    row = S.gap_counts(curves(spark, [(3, 0)]), 1.0).first()
    assert row.max_gap is None and row.n_gaps is None


def test_subset_errors(spark):
    obs = curves(spark, [(0, 0)], [(1, 0)])
    data = LightCurves(obs, obs.select("object_id").distinct())
    assert U.update_to_subset(data, spark.createDataFrame([(1,)], "object_id long")).observations.count() == 1
    with pytest.raises(ValueError):
        U.update_to_subset(data, spark.createDataFrame([(7,)], "object_id long"))
    with pytest.raises(ValueError):
        U.merge(data, data)
    assert U.merge(data, data, suffix="_b").objects.count() == 4


def test_redshift_sentinels(spark):
    df = spark.createDataFrame([(-9.0, 0.3), (float("nan"), 0.3), (0.1, 0.3)], "s double, p double")
    assert [r[0] for r in df.select(P.redshift(F.col("s"), F.col("p"))).collect()] == [0.3, 0.3, 0.1]


def test_folds_are_inherited(spark):
    rows = [(str(i), i % 2, None) for i in range(20)] + [(f"{i}_aug0", i % 2, str(i)) for i in range(20)]
    found = {r.object_id: r.fold for r in U.grouped_folds(spark.createDataFrame(rows, "object_id string, target int, original_event string"), 5, 1).collect()}
    assert all(found[f"{i}_aug0"] == found[str(i)] for i in range(20)) and len(set(found.values())) == 5
