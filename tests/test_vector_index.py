"""Inverted lists of codes against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.operators import similarity, vector_index
from caseflow.sources import store


def _asked(stored, condition="true"):
    return stored.filter(condition).select(F.col("claim_id").alias("query_id"), "embedding")


def _others(found):
    return {(r.query_id, r.claim_id): r.similarity_score for r in found.filter("query_id != claim_id").collect()}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_supplied_vectors(spark, root, folder):
    stored = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").withColumnRenamed("vec_id", "claim_id")
    vector_index.build(stored, root, "v")
    exact = _others(similarity.cosine_topk(_asked(stored), stored, 6))
    found = _others(vector_index.search(_asked(stored), root, "v", 6))
    hits = set(exact) & set(found)
    print(folder, len(hits) / len(exact))
    assert len(hits) >= 0.9 * len(exact) and all(abs(exact[p] - found[p]) < 1e-9 for p in hits)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "claim_id long, embedding array<float>")


def test_all_lists_with_copies_ties_and_odd_vectors(spark, root, monkeypatch):
    pick = np.random.default_rng(4)
    rows = [v.tolist() for v in pick.normal(size=(60, 8))]
    rows += [rows[0]] * 40 + [[0.0] * 8, [0.0] * 8, None, [2 * x for x in rows[0]]]
    stored = _vectors(spark, rows)
    monkeypatch.setattr(vector_index, "LIST_ROWS", 7)
    vector_index.build(stored, root, "v", lists=5)
    assert store.load(spark, root, "v").count() == len(rows) - 1
    # Every list and enough exact comparisons: the exact result, small blocks or large.
    exact = sorted(map(tuple, similarity.cosine_topk(_asked(stored), stored, 3).collect()))
    for block in (6, 4096):
        found = vector_index.search(_asked(stored), root, "v", 3, rerank=200, factor=10.0, power=1.0, block=block)
        assert sorted(map(tuple, found.collect())) == exact


def test_rows_compared_grow_more_slowly_than_the_table(spark, root):
    pick = np.random.default_rng(5)
    shares = []
    for number, rows in enumerate((1_000, 8_000)):
        stored = _vectors(spark, [v.tolist() for v in pick.normal(size=(rows, 16))])
        vector_index.build(stored, root, f"v{number}")
        asked = _asked(stored, "claim_id % 50 = 0").select(F.col("query_id").cast("string").alias("query"), "embedding")
        seen = vector_index.probed(spark, root, f"v{number}", asked).groupBy("query").agg(F.sum("rows").alias("rows"))
        shares.append(seen.agg(F.avg("rows")).first()[0] / rows)
        assert vector_index.reach(rows) / rows <= shares[-1] <= 1.25 * vector_index.reach(rows) / rows
    assert shares[1] < 0.85 * shares[0]


def test_only_visited_lists_are_read(spark, root):
    pick = np.random.default_rng(6)
    centres = 10 * pick.normal(size=(20, 8))
    stored = _vectors(spark, [(centres[i % 20] + pick.normal(size=8)).tolist() for i in range(2_000)])
    vector_index.build(stored, root, "v", lists=20)
    found = vector_index.search(_asked(stored, "claim_id = 7"), root, "v", 5, factor=0.05, power=1.0)
    exact = similarity.cosine_topk(_asked(stored, "claim_id = 7"), stored, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))
    visited = store.load(spark, root, "v").filter(F.col("list").isin([1]))
    assert "PartitionFilters: [isnotnull(list" in visited._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [60, 4096])
def test_queries_go_once_to_a_group_of_lists(spark, root, monkeypatch, block):
    pick = np.random.default_rng(7)
    rows = pick.normal(size=(400, 8)).astype(np.float32)
    stored = _vectors(spark, [v.tolist() for v in rows])
    vector_index.build(stored, root, "v", lists=16)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 50)
    monkeypatch.setattr(vector_index, "CELLS", 640)
    asked = _asked(stored).select(F.md5(F.col("embedding").cast("string")).alias("query"), "embedding", "query_id")
    lists = {}
    for row in vector_index.probed(spark, root, "v", asked, 0.4, 1.0).collect():
        lists.setdefault(row["query"], set()).add(row["cell"])
    centres, sizes = vector_index._known(spark, root, "v")
    groups = similarity._groups(sizes, block)
    sent = vector_index._grouped(asked, centres, sizes, groups, vector_index.reach(400, 0.4, 1.0)).groupBy("query").count().collect()
    # A row for each group that holds a visited list, whatever the number of lists.
    assert {r["query"]: r["count"] for r in sent} == {q: len({groups[i] for i in held}) for q, held in lists.items()}
    assert max(map(len, lists.values())) > 4 and (block == 60 or {r["count"] for r in sent} == {1})
    homes = {r["claim_id"]: r["list"] for r in store.load(spark, root, "v").collect()}
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    names = {r["query_id"]: r["query"] for r in asked.collect()}
    found = vector_index.search(_asked(stored), root, "v", 3, rerank=400, factor=0.4, power=1.0, block=block)
    best = {}
    for row in found.orderBy("query_id", "position").collect():
        best.setdefault(row["query_id"], []).append(row["claim_id"])
    for query, name in names.items():
        among = [i for i in range(400) if homes[i] in lists[name]]
        scores = np.round(unit[among] @ unit[query], 10)
        assert best[query] == [among[j] for j in np.lexsort((among, -scores))[:3]]


def test_ids_that_repeat_or_are_missing(spark, root):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (None, [1.0, 0.05]), (2, [0.0, 1.0]), (3, [0.9, 0.1])]
    stored = spark.createDataFrame(rows, "claim_id long, embedding array<float>")
    vector_index.build(stored, root, "v")
    found = vector_index.search(_asked(stored, "claim_id = 3"), root, "v", 10).collect()
    # A claim without id is no answer; each of two places of an id stands for both of its vectors.
    assert sorted(r["claim_id"] for r in found) == [1, 1, 1, 1, 2, 3]


def test_nothing_to_find(spark, root):
    empty = spark.createDataFrame([], "claim_id long, embedding array<float>")
    vector_index.build(empty, root, "v")
    asked = _asked(_vectors(spark, [[1.0, 2.0]]))
    assert vector_index.search(asked, root, "v").collect() == []
    vector_index.build(_vectors(spark, [[1.0, 2.0]]), root, "w")
    assert vector_index.search(asked.limit(0), root, "w").collect() == []
