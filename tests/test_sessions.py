"""Streamed sessions: they span triggers, late events count, each trigger writes its own part only."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fluxloom.streaming import sessions


def _events(spark, rows):
    day = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, day + timedelta(hours=h), u, "view", float(v), "{}") for i, (u, h, v) in enumerate(rows)], sessions.EVENTS)


def _rows(df):
    return sorted(tuple(r) for r in df.select("user_id", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "n_obs", "peak").collect())


def test_sessions_span_triggers(spark, tmp_path):
    rows = [(u, (k * 7 * (u + 1)) % 700, k) for u in range(4) for k in range(60)] + [(9, 0, 1.0), (9, 36, 2.0), (9, 71.5, 3.0)]
    events = _events(spark, rows)
    for i in range(5):  # dealt so that sessions are cut up and arrive out of order
        events.where(F.col("event_id") % 5 == i).coalesce(1).write.parquet(str(tmp_path / f"in/{4 - i}"))
    stream = spark.readStream.schema(sessions.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    found = _rows(sessions.drain_sessions(stream, str(tmp_path / "out")))
    assert found == _rows(sessions.gap_sessions(events.withColumn("ts", F.col("ts").cast("timestamp"))))
    assert len(list((tmp_path / "out/rows").glob("batch=*"))) == 5
    mine = [r for r in found if r[0] == 9]
    assert [(r[3], r[4]) for r in mine] == [(3, 3.0)]  # a gap of just that length joins


def test_parts_of_sessions_are_joined(spark):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    parts = spark.createDataFrame([(1, t(0), t(50), 3, 1.0), (1, t(10), t(20), 1, 9.0), (1, t(49), t(85), 2, 2.0), (1, t(85.5), t(121), 1, 4.0), (2, t(0), t(36), 1, 5.0), (None, t(0), t(36), 1, 6.0), (None, t(1), t(37), 1, None)], "user_id long, start timestamp, end timestamp, n_obs long, peak double")
    got = sorted(((r.user_id, r.start, r.end, r.n_obs, r.peak) for r in sessions.merged_sessions(parts).collect()), key=str)
    assert got == sorted([(1, t(0), t(85), 6, 9.0), (1, t(85.5), t(121), 1, 4.0), (2, t(0), t(36), 1, 5.0), (None, t(0), t(37), 2, 6.0)], key=str)
