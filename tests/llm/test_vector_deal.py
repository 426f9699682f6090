"""Shards are dealt one to a task, whatever the hash of their number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import near_vectors as N


@pytest.mark.parametrize("n", [1, 6, 12, 97])
def test_a_place_a_partition(spark, n):
    df = N._dealt(spark.range(10 * n).withColumn("place", (F.col("id") % n).cast("int")), F.col("place"), n)
    got = df.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("place").alias("places"), F.count("*").alias("rows")).collect()
    assert [(r.places, r.rows) for r in got] == [(1, 10)] * n


def test_queries_in_parts_find_the_same_links(spark, monkeypatch):
    """More tasks than shards: links, components and kept rows are those of all pairs."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 16))
    x[200:] = x[:200] + 0.04 * rng.standard_normal((200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(N, "MIN_SHARDS", 2)
    seen, searcher = [], N._dealt

    def told(df, place, n):
        seen.append(n)
        return searcher(df, place, n)

    monkeypatch.setattr(N, "_dealt", told)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.near_vectors(df).collect()}
    assert max(seen) > 2
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[i][0] for i in range(400)] == near.sum(1).tolist()
    for i in np.flatnonzero(near.sum(1) == 1):
        j = int(near[i].argmax())
        if near[j].sum() == 1:
            assert got[i][1:] == (min(i, j), i < j)
