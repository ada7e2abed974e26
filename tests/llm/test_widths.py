import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import neighbours


@pytest.mark.parametrize("width", [128, 256, 768])
def test_recall_of_wide_vectors(spark, width):
    rng = np.random.default_rng(width)
    n = 1500
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 2 :] += 1.5 * rng.normal(size=(12, width)).astype(np.float32)[rng.integers(0, 12, n - n // 2)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    good, hits = x.astype(np.float64), 0
    for q in range(0, n, 20):
        scores = good @ good[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (n // 20 * 20) >= 0.9
