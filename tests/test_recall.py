"""Recall of the approximate searches against the exact one."""

from __future__ import annotations

from storyspark.plans import registry


def test_approximate_searches_find_the_neighbours(spark):
    found = {n: {(r.query_id, r.vec_id) for r in registry.queries()[n](spark, "/root/testdata/sf0.1").select("query_id", "vec_id").collect()} for n in ("k5_knn_exact", "k7_knn_approx", "k7_knn_graph", "k7_knn_lsh")}
    want = found.pop("k5_knn_exact")
    assert want
    for name, got in found.items():
        assert len(got & want) >= 0.9 * len(want), name
