"""Synthesised objects: the whole redshift table, many surveys at once."""

import numpy as np
from pyspark.sql import functions as F

from fluxloom.operators import augment as A
from fluxloom.sources.fixtures import objects, observations


def test_redshift_tables_are_whole(spark):
    rows = spark.range(150_000).select((F.col("id") % 7 / 100.0).alias("z_diff"), F.lit(0.1).alias("hostgal_photoz_err"))
    table = A.redshift_table(None, z_table=rows)
    assert len(table) == 150_000 and len(table.rows) == 7
    numbers = np.unique([table[i][0] for i in range(0, 150_000, 10)], return_counts=True)[1]
    assert len(numbers) == 7 and abs(numbers - 15_000 / 7).max() <= 1


def test_draws_from_a_large_redshift_table_are_the_same(spark, small):
    obs, obj = observations(spark, small), objects(spark, small)
    copies, rules = A.quota(obj, "all", each=2), ["plasticc_wfd", "plasticc_ddf"]
    table = spark.range(400).select((F.col("id") / 400.0 - 0.95).alias("z_diff"), F.when(F.col("id") % 3 > 0, 0.1).otherwise(0.0).alias("hostgal_photoz_err"))
    made = [sorted(map(str, A.augment_surveys(obs, obj, copies, rules, seed=3, z_table=table, sent=n).collect())) for n in (A.SENT_REDSHIFTS, 10)]
    assert made[0] == made[1] and made[0]


def test_surveys_at_once_are_those_by_themselves(spark, small):
    obs, obj = observations(spark, small), objects(spark, small)
    copies, rules = A.quota(obj, "all", each=1), ["plasticc_wfd", "baseline_v20_plasticc_wfd", "presto_v20_wfd"]
    own = sorted(str((*r, s)) for s in rules for r in A.augment(obs, obj, copies, s, seed=4).collect())
    assert own == sorted(str(tuple(r)) for r in A.augment_surveys(obs, obj, copies, rules, seed=4).collect()) and own
