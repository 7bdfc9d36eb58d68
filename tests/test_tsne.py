import numpy as np

from fluxloom.operators.tsne import tsne


def test_every_row_is_embedded(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(4) * 0.3 + np.eye(4)[i % 3] * 8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:5], "object_id long, features array<double>")
    found = tsne(df, rows=120, perplexity=15).collect()
    assert sorted(r.object_id for r in found) == sorted([*range(300), *range(5)])
    at = {r.object_id: np.array([r.x, r.y]) for r in found}
    centres = [np.mean([at[i] for i in range(g, 300, 3)], axis=0) for g in range(3)]
    near = [int(np.argmin([np.linalg.norm(at[i] - c) for c in centres])) == i % 3 for i in range(300)]
    assert np.mean(near) > 0.95
