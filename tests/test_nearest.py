"""Block-matrix search against plain loops; the graph's recall and comparisons."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.operators import nearest, vectors

SCHEMA = "vec_id long, embedding array<float>"


def made(n=300, size=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size)]) for i in range(n)]  # many ties, some equal
    return rows + [(1000, None), (1001, []), (1002, [1.0] * (size + 1)), (1003, [float("nan")] * size), (1004, [0.0] * size), (1005, [None] + [1.0] * (size - 1)), (5, rows[7][1])]


def slow(rows, asked, k, distinct=False):
    unit = {}
    out = []
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    unit = [(i, v / (np.linalg.norm(v) or 1)) for i, v in good]
    for q, v in asked:
        v = np.array(v, float) / (np.linalg.norm(v) or 1)
        found = [(round(float((u * v).sum()), 9), i) for i, u in unit if i != q and len(u) == len(v)]
        if distinct:
            best = {}
            for s, i in found:
                best[i] = max(s, best.get(i, -9))
            found = [(s, i) for i, s in best.items()]
        out += [(q, p + 1, i, s) for p, (s, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def told(df, key="vec_id"):
    return sorted((r.query_id, r.place, r[key], round(r.score, 9) + 0.0) for r in df.collect())


@pytest.mark.parametrize("most", [nearest.MOST_QUERIES, 7])
def test_exact_search(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "BLOCK", 5)
    rows = made()
    asked = [(i, v) for i, v in rows[:40:2]] + [(1002, [1.0] * 9), (-1, rows[3][1])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    queries = spark.createDataFrame(asked + [(9000, None)], "query_id long, vector array<float>")
    got = nearest.exact(frame.withColumn("score", F.lit("x")), queries, 4, "vec_id", "embedding", max_queries=most)
    assert told(got) == slow(rows, asked, 4)
    twice = [(i % 50, v) for i, v in rows]
    got = nearest.exact(spark.createDataFrame(twice, SCHEMA).repartition(5), queries, 4, "vec_id", "embedding", distinct=True, max_queries=most)
    assert told(got) == slow(twice, asked, 4, True)


def test_no_rows_or_queries(spark):
    rows, none = spark.createDataFrame(made(20), SCHEMA), spark.createDataFrame([], "query_id long, vector array<float>")
    assert nearest.exact(rows, none, 3, "vec_id", "embedding").count() == 0
    asked = spark.createDataFrame([(1, [1.0] * 8)], "query_id long, vector array<float>")
    assert nearest.exact(rows.where("false"), asked, 3, "vec_id", "embedding").count() == 0
    assert nearest.graph_search(nearest.graph_index(rows.where("false")), asked).count() == 0


def test_one_scan_for_many_queries(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = rows.select((F.col("vec_id") + 100_000).alias("query_id"), F.col("embedding").alias("vector"))
    many = asked
    for k in range(1, 12):
        many = many.unionByName(asked.withColumn("query_id", F.col("query_id") + k * 1000))
    assert many.count() > 5000
    plan = vectors.knn_exact(rows, many)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_graph_finds_nine_of_ten_with_a_third_of_the_comparisons(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = {(r.query_id, r.vec_id) for r in vectors.knn_exact(rows, asked).collect()}
    for shard in (nearest.SHARD, 500):
        index = nearest.graph_index(rows, shard=shard).cache()
        got = {(r.query_id, r.vec_id) for r in nearest.graph_search(index, asked).collect()}
        costs = nearest.graph_costs(index, asked).agg(F.sum("vectors"), F.sum("looked_at"), F.max("queries")).first()
        recall, share = len(got & want) / len(want), costs[1] / (costs[0] * costs[2])
        print(f"shards of {shard}: recall {recall:.3f}, {share:.3f} of all comparisons")
        assert recall >= 0.9
        if shard == nearest.SHARD:
            assert share < 1 / 3


def test_graph_of_odd_rows(spark):
    """Few rows, equal rows, other lengths: everything is found."""
    rows = made(30) + [(2000 + i, [1.0] * 8) for i in range(100)]
    asked = [(3, rows[3][1]), (2001, [1.0] * 8), (1002, [1.0] * 9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = nearest.graph_search(nearest.graph_index(frame, shard=40), spark.createDataFrame(asked, "query_id long, vector array<float>"), k=5, width=200)
    assert [r[3] for r in told(got)] == [r[3] for r in slow(rows, asked, 5)]


def test_lists_and_buckets_shuffle_no_pairs(spark):
    rows = made()
    asked = [(i, v) for i, v in rows[:40:2]] + [(1002, [1.0] * 9), (9000, None)]
    frame, queries = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(asked, "query_id long, vector array<float>")
    good = [(q, v) for q, v in asked if v]
    assert told(vectors.knn_approx(frame, queries, 4, lists=5, probe=5)) == slow(rows, good, 4)
    assert told(vectors.knn_lsh(frame, queries, 4, width=100.0, tables=8, radius=3.0)) == slow(rows, good, 4)  # two buckets a table
    for method in (vectors.knn_approx, vectors.knn_lsh):
        plan = method(frame, queries, 4)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan


def test_groups_hold_the_pairs_of_their_lists_and_buckets():
    rng = np.random.default_rng(2)
    unit, asked, centres = rng.standard_normal((200, 6)), rng.standard_normal((30, 6)), rng.standard_normal((7, 6))

    def pairs(groups):
        found = [(int(r), int(q)) for rows, queries in groups(unit, asked) for r in rows for q in queries]
        assert len(found) == len(set(found))
        return set(found)

    far = lambda v: ((v[:, None] - centres) ** 2).sum(axis=2)
    cell, probed = far(unit).argmin(axis=1), far(asked).argsort(axis=1)[:, :3]
    assert pairs(nearest.by_lists(centres, 3)) == {(r, q) for r in range(200) for q in range(30) if cell[r] in probed[q]}
    found = pairs(nearest.by_buckets(0.5, 3, 1))
    drawn = np.random.default_rng(1).standard_normal((6, 3))
    drawn /= np.linalg.norm(drawn, axis=0)
    a, b = np.floor(unit @ drawn / 0.5), np.floor(asked @ drawn / 0.5)
    assert found == {(r, q) for r in range(200) for q in range(30) if (a[r] == b[q]).any()} and 0 < len(found) < 6000


def test_centres_of_few_rows_serve_all(spark, monkeypatch):
    rows = made()
    asked = [(i, v) for i, v in rows[:40:2]]
    frame, queries = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(asked, "query_id long, vector array<float>")
    monkeypatch.setattr(vectors, "TRAINED", 60)
    assert told(vectors.knn_approx(frame, queries, 4, lists=5, probe=5)) == slow(rows, asked, 4)
