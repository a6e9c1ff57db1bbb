"""effective_rank counts every vector."""

import numpy as np

from keelspark.plans import registry


def test_all_vectors_count(spark, tmp_path):
    rng = np.random.default_rng(51)
    v = np.where(np.arange(900)[:, None] < 600, rng.normal(size=(900, 64)) * (np.arange(64) < 3), rng.normal(size=(900, 64))).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    gram = v.astype(np.float64) @ v.astype(np.float64).T
    (row,) = registry.queries()["effective_rank"](spark, str(tmp_path)).collect()
    assert abs(row["rank"] - np.trace(gram) ** 2 / (gram * gram).sum()) < 1e-3
