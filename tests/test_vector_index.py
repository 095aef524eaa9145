"""The index gives what a scan of everything gives, and looks into few cells where vectors lie in groups."""

import numpy as np
import pytest

from siltstone.operators import vector_index, vectors


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None)], "id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_is_exact(spark, monkeypatch, metric):
    monkeypatch.setattr(vector_index, "ROWS", 40)  # cells and queries of several groups
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 6)) * 5
    x = (centers[rng.integers(12, size=600)] + rng.standard_normal((600, 6)) * 0.2).astype(np.float32)
    x[7] = x[8] = x[9]  # ties
    items, asked = table(spark, x), table(spark, np.concatenate([x[:60], x[:5] + 0.01])).withColumnRenamed("id", "query_id")
    index = vector_index.build(items, metric)
    found, looked = vector_index.search(index, asked, 5)
    want = vectors.top_k(asked, items, 5, metric)
    key = ["query_id", "rank"]
    assert found.orderBy(*key).collect() == want.orderBy(*key).collect()
    cells = index.cells.count()
    assert 12 <= cells <= 24 and index.items.count() == 600
    assert looked.count() < 0.5 * 65 * cells  # more than half of the pairs of query and cell are left out
    assert looked.distinct().count() == looked.count()


def test_few_vectors(spark):
    none = table(spark, np.zeros((0, 3)))
    one = table(spark, np.array([[1.0, 0, 0]]))
    asked = table(spark, np.array([[0.0, 1, 0], [1, 1, 1]])).withColumnRenamed("id", "query_id")
    assert vector_index.search(vector_index.build(none), asked)[0].count() == 0
    got = vector_index.search(vector_index.build(one), asked)[0].orderBy("query_id").collect()
    assert [(r.query_id, r.id, r["rank"]) for r in got] == [(0, 0, 1), (1, 0, 1)]
    assert vector_index.search(vector_index.build(one), none.withColumnRenamed("id", "query_id"))[0].count() == 0
