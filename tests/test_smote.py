import numpy as np

from fluxloom.operators.augment import smote


def test_neighbours_of_large_classes_are_their_own(spark):
    # pairs of rows close together and far from all others: a synthetic row lies within its pair
    rows = [(i, 0, [float(i // 2 * 10 + i % 2), 0.0]) for i in range(2500)] + [(10_000 + i, 1, [float(i), 1.0]) for i in range(2900)]
    made = smote(spark.createDataFrame(rows, "object_id long, label int, features array<double>"), k=1).collect()
    assert len(made) == 400 and {r.label for r in made} == {0}
    assert all(np.floor(r.features[0] / 10) == int(r.original_event) // 2 and r.features[0] % 10 <= 1 for r in made)
