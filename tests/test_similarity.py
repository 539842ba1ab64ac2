import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from caseflow.operators import similarity
from caseflow.operators.similarity import Limits

WAYS = {
    "scan stored": Limits(),
    "scan queries": Limits(queries=0),
    "cells": Limits(queries=0, matrix_bytes=0, block=16),
    "one block": Limits(queries=0, matrix_bytes=0, block=100000),
    "small tiles": Limits(queries=0, matrix_bytes=0, block=16, tile=24),
}


def _vectors(seed=1, n=160, dim=6):
    """Clusters, a third of all rows the same vector, zero vectors and a scaled copy."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim)) * 4
    rows = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, dim))
    rows[::3] = rows[0]
    rows[5] = rows[50] = 0.0
    rows[7] = rows[1] * 2
    return rows.astype(np.float32)


def _expected(queries, stored, ids, k):
    def unit(m):
        m = m.astype(np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    scores = np.round(unit(queries) @ unit(stored).T, 10) + 0.0
    return {q: sorted(zip(-scores[q], ids))[:k] for q in range(len(queries))}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("text_ids", [False, True])
def test_every_way_equals_brute_force(spark, way, text_ids):
    rows = _vectors()
    ids = [f"C{i:04d}" if text_ids else i for i in range(len(rows))]
    stored = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, rows)], f"claim_id {'string' if text_ids else 'long'}, embedding array<float>")
    queries = stored.select(F.col("claim_id").alias("query_id"), "embedding")
    found = similarity.cosine_topk(queries, stored.repartition(3), 5, WAYS[way]).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.position, -r.similarity_score, r.claim_id))
    expected = _expected(rows, rows, ids, 5)
    assert len(got) == len(rows)
    for q, wanted in expected.items():
        assert [(s, i) for _, s, i in sorted(got[ids[q]])] == [(pytest.approx(s, abs=1e-9), i) for s, i in wanted], q


def test_fewer_vectors_than_k(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "claim_id long, embedding array<float>")
    queries = stored.select(F.col("claim_id").alias("query_id"), "embedding")
    for limits in WAYS.values():
        assert similarity.cosine_topk(queries, stored, 5, limits).count() == 9


def test_similar_fraud_with_and_without_self(spark):
    rows = [(1, [1.0, 0.0], True), (2, [0.9, 0.1], False), (3, [0.0, 1.0], True), (4, [0.1, 0.9], True)]
    vectors = spark.createDataFrame(rows, "claim_id long, embedding array<float>, is_fraud boolean")
    for limits in WAYS.values():
        counts = {r.claim_id: r.similar_fraud_count for r in similarity.similar_fraud(vectors, 2, limits=limits).collect()}
        assert counts == {1: 1, 2: 1, 3: 2, 4: 2}
        alone = {r.claim_id: r.similar_fraud_count for r in similarity.similar_fraud(vectors, 1, True, limits).collect()}
        assert alone == {1: 0, 2: 1, 3: 1, 4: 1}


def test_empty_sides(spark):
    stored = spark.createDataFrame([(1, [1.0])], "claim_id long, embedding array<float>")
    queries = stored.select(F.col("claim_id").alias("query_id"), "embedding")
    assert similarity.cosine_topk(queries.limit(0), stored, 3).isEmpty()
    assert similarity.cosine_topk(queries, stored.limit(0), 3).isEmpty()


def test_task_functions_need_no_package_on_the_executor(tmp_path):
    """An executor that cannot import this package can still run the helpers."""
    task = tmp_path / "task"
    helpers, result = similarity.vec, similarity._result

    def run():
        rows = helpers.unit(np.eye(3), 0)
        return result(np.arange(3), helpers.nearest(rows, rows, np.arange(3), 1)).num_rows

    task.write_bytes(cloudpickle.dumps(run))
    code = f"import pickle; assert pickle.load(open({str(task)!r}, 'rb'))() == 3"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    spark_path = os.path.dirname(os.path.dirname(cloudpickle.__file__)).removesuffix("/pyspark")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**env, "PYTHONPATH": spark_path}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_text_vectors_have_length_one(spark):
    df = spark.createDataFrame([(1, "slip and fall"), (2, None), (3, "water damage and fall")], "id int, text string")
    rows = {r.id: np.array(r.embedding) for r in similarity.text_vectors(df, "text", 64).collect()}
    assert np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6) and len(rows[1]) == 64


def _random_vectors(spark, n, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, dim))
    rows = [(i, [float(x) for x in centers[i % 20] + 0.3 * rng.normal(size=dim)], i % 3 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "claim_id long, embedding array<float>, is_fraud boolean")


def test_approximate_neighbours_reach_their_recall(spark):
    stored = _random_vectors(spark, 600)
    queries = stored.filter("claim_id % 5 = 0").select(F.col("claim_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.claim_id): r.similarity_score for r in similarity.cosine_topk(queries, stored, 5).collect()}
    near = similarity.cosine_topk_approx(queries, stored, 5, block=50).collect()
    found = {(r.query_id, r.claim_id): r.similarity_score for r in near}
    hits = set(exact) & set(found)
    assert len(hits) >= 0.9 * len(exact) and all(abs(exact[p] - found[p]) < 1e-9 for p in hits)
    assert all(r.position <= 5 for r in near)
    few = similarity.cosine_topk_approx(queries, stored, 5, tables=1, bits=6, block=50)
    assert few.join(spark.createDataFrame(list(exact), "query_id long, claim_id long"), ["query_id", "claim_id"]).count() < len(hits)
    assert similarity.similar_fraud(stored, 3, approx={"tables": 16}).count() == 600


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_approximate_neighbours_reach_their_recall_on_the_supplied_vectors(spark, folder):
    stored = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").withColumnRenamed("vec_id", "claim_id")
    queries = stored.filter("claim_id % 5 = 0").select(F.col("claim_id").alias("query_id"), "embedding")

    def others(found):
        return {(r.query_id, r.claim_id) for r in found.filter("query_id != claim_id").collect()}

    exact = others(similarity.cosine_topk(queries, stored, 6))
    recall = len(exact & others(similarity.cosine_topk_approx(queries, stored, 6))) / len(exact)
    print(folder, recall)
    assert recall >= 0.9


def test_rows_of_a_frequent_vector_are_not_moved(spark):
    same = spark.range(300).select(F.col("id").alias("query_id"), F.lit("v").alias("vector"))
    other = spark.range(300, 310).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("vector"))
    marked = same.unionByName(other)
    found = marked.select(F.col("vector").alias("query")).distinct().withColumn("id", F.lit(1)).withColumn("score", F.lit(0.5))
    distinct = spark.createDataFrame([(1, [1, 2, 3])], "first_id int, ids array<int>")
    for hot in (100, 1000):
        rows = similarity._unfold(found, distinct, marked, 2, hot)
        assert sorted((r.query_id, r.claim_id) for r in rows.collect()) == [(q, c) for q in range(310) for c in (1, 2)]
    plan = similarity._unfold(found, distinct, marked, 2, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_queries_go_once_to_a_group_of_cells():
    """Where nothing can be ruled out, copies of a query grow with the tiles, not with the cells."""
    groups = similarity._groups(np.full(801, 128), 16_384)
    assert groups[0] == 0 and set(np.diff(groups)) == {0, 1} and groups[-1] + 1 == 7
    assert similarity._groups(np.array([0.0, 30.0, 5.0, 5.0, 0.0]), 10).tolist() == [0, 1, 2, 2, 2]
    assert len(similarity._groups(np.zeros(0), 10)) == 0


def test_nearest_in_slices_with_ties(monkeypatch):
    rng = np.random.default_rng(3)
    rows = similarity.vec.unit(rng.integers(-1, 2, size=(200, 3)).astype(float), 0)
    expected = _expected(rows, rows, np.arange(200), 4)
    for cells in (1, 1000, 10**6):
        monkeypatch.setattr(similarity.vec, "_CELLS", cells)
        found = similarity.vec.nearest(rows, rows, np.arange(200), 4)
        got = {q: list(zip(-g["score"], g["id"])) for q, g in found.groupby("query")}
        assert got == expected
