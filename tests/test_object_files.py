"""Object files read back equal, tries that fail leave nothing, kept subsets, draws with replacement, feature sinks."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxloom.operators import subset as U
from fluxloom.schema import DES, LightCurves
from fluxloom.sources import object_files, sinks, spcc


def _data(spark):
    obs = [(f"SN{i}.DAT", 0.1 * k * (i + 1), "des" + "griz"[k % 4], "X1", 1.5 * k - 2 + 1 / 3, 0.1 + 1e-7 * k) for i in range(30) for k in range(i % 5 + 1)]
    objs = [(f"SN{i}.DAT", 56_000.125 + i / 7, None if i % 4 == 0 else i / 11, None if i % 4 == 0 else 0.01 + i / 1000, [1, 2, 32, 66, None][i % 5]) for i in range(30)]
    observations = spark.createDataFrame(obs, "object_id string, mjd double, filter string, field string, flux double, flux_error double")
    return LightCurves(observations, spark.createDataFrame(objs, "object_id string, initial_observation_time double, z double, z_err double, target int"), None, DES)


def _rows(df, *columns):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=str)


def test_read_back_equal(spark, tmp_path):
    data = _data(spark)
    sinks.save_list(data, str(tmp_path / "x"), "SURVEY")
    assert (tmp_path / "x/SURVEY.LIST").read_text().split() == sorted(f"SN{i}.DAT" for i in range(30))
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == sorted([*(f"SN{i}.DAT" for i in range(30)), "SURVEY.LIST"])
    back = spcc.read(spark, str(tmp_path / "x"), spcc.names_in_list(spark, str(tmp_path / "x/SURVEY.LIST")))
    columns = ("object_id", "mjd", "filter", "field", "flux", "flux_error")
    assert _rows(back.observations, *columns) == _rows(data.observations, *columns)
    known = ("object_id", F.round("initial_observation_time", 6), "z", "z_err", "target")
    assert _rows(back.objects, *known) == _rows(data.objects, *known)
    sinks.save_list(back, str(tmp_path / "y"), "SURVEY")  # and once more
    again = spcc.read(spark, str(tmp_path / "y"))
    assert _rows(again.observations, *columns) == _rows(data.observations, *columns)


def test_ids_get_an_ending_and_saving_again_replaces(spark, tmp_path):
    obs = spark.createDataFrame([(7, 0.0, "desg", 1.0, 0.1), (8, 0.0, "desr", 1.0, 0.1)], "object_id long, mjd double, filter string, flux double, flux_error double")
    data = LightCurves(obs, obs.select("object_id"))
    sinks.save_list(data, str(tmp_path), "A")
    sinks.save_list(LightCurves(obs.where("object_id = 8"), obs.select("object_id")), str(tmp_path), "A")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["8.DAT", "A.LIST"]
    with pytest.raises(Exception, match="is there already"):
        object_files.save_lines(spark.createDataFrame([("b.DAT", "x")], "file string, line string"), str(tmp_path), "A")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["8.DAT", "A.LIST"]
    assert spcc.read(spark, str(tmp_path)).observations.count() == 1


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(200).select(F.concat(F.lit("o"), (F.col("id") % 20).cast("string"), F.lit(".DAT")).alias("file"), F.when(F.col("id") == 150, F.raise_error(F.lit("no"))).otherwise("line").cast("string").alias("line"))
    with pytest.raises(Exception, match="no"):
        object_files.save_lines(bad, str(tmp_path / "z"), "L")
    assert not (tmp_path / "z").exists() or list((tmp_path / "z").iterdir()) == []


def test_many_lines_in_few_files(spark, tmp_path):
    rows = spark.range(30_000).select(F.when(F.col("id") < 29_000, F.lit("hot.DAT")).otherwise(F.concat((F.col("id") % 3).cast("string"), F.lit(".DAT"))).alias("file"), F.format_string("%08d", "id").alias("line"))
    object_files.save_lines(rows, str(tmp_path), "L")
    assert (tmp_path / "hot.DAT").read_text().split() == [f"{i:08d}" for i in range(29_000)]
    assert (tmp_path / "L.LIST").read_text().split() == ["0.DAT", "1.DAT", "2.DAT", "hot.DAT"]


def test_kept_subset(spark, tmp_path):
    objects = spark.range(100).select(F.col("id").alias("object_id"))
    first = {r[0] for r in U.kept_subset(objects, 10, 1, str(tmp_path / "k")).collect()}
    assert first == {r[0] for r in U.random_subset(objects, 10, 1).collect()}
    assert {r[0] for r in U.kept_subset(objects, 50, 2, str(tmp_path / "k")).collect()} == first
    assert {r[0] for r in U.kept_subset(objects.where(F.col("object_id") != min(first)), 50, 2, str(tmp_path / "k")).collect()} == first - {min(first)}


def test_draws_with_replacement(spark):
    rows = spark.createDataFrame([(i // 2, "ab"[i % 2]) for i in range(13)] + [(None, "n")], "object_id long, v string")
    found = U.sample_with_replacement(rows.repartition(3), 200, 5).collect()
    order = sorted(rows.collect(), key=lambda r: (r.object_id is not None, r.object_id or 0, f'{{"object_id":{r.object_id},"v":"{r.v}"}}'))
    want = [order[int(hashlib.md5(f"5:{j}".encode()).hexdigest()[:15], 16) % 14] for j in range(200)]
    assert [(r.draw, r.object_id, r.v) for r in sorted(found, key=lambda r: r.draw)] == [(j, r.object_id, r.v) for j, r in enumerate(want)]
    copies = Counter((r.object_id, r.v) for r in found)
    assert all(sorted(r.copy for r in found if (r.object_id, r.v) == k) == list(range(n)) for k, n in copies.items())
    assert U.sample_with_replacement(rows.limit(0), 5, 1).count() == 0


def test_feature_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "object_id long, features array<double>")
    b = spark.createDataFrame([(1, 0.5, 9), (3, 0.7, 8)], "object_id long, z double, n int")
    sinks.save_features(a, str(tmp_path), "reduced")
    sinks.save_features(b, str(tmp_path), "raw")
    assert [tuple(r) for r in sinks.load_features(spark, str(tmp_path), ["reduced", "raw"]).collect()] == [(1, [1.0, 2.0, 0.5, 9.0])]
    sinks.save_features(b.limit(1), str(tmp_path), "raw")
    with pytest.raises(ValueError, match="several rows"):
        sinks.save_features(a.unionByName(a), str(tmp_path), "twice")


def test_files_of_several_tasks(spark, tmp_path):
    """Each name is moved from the folder of its own task."""
    object_files.register(spark)
    rows = spark.range(300).select(F.format_string("%03d.DAT", F.col("id") % 100).alias("file"), F.col("id").cast("string").alias("line"))
    dealt = rows.repartition(5, "file").sortWithinPartitions("file", "line")
    dealt.write.format("object_files").option("list", "ALL.LIST").mode("overwrite").save(str(tmp_path))
    names = (tmp_path / "ALL.LIST").read_text().split()
    assert names == [f"{i:03}.DAT" for i in range(100)] and sorted(p.name for p in tmp_path.iterdir()) == sorted([*names, "ALL.LIST"])
    for i, name in enumerate(names):
        assert (tmp_path / name).read_text().split() == sorted(str(i + j) for j in (0, 100, 200))
