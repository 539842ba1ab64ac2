"""Approximate nearest neighbours in a forest of random-projection trees.

Every tree cuts space by hyperplanes between two random vectors of a bounded sample, at the median.
Every row goes to one leaf of each tree. A query walks all trees through one priority queue, the
node with the smallest distance to its hyperplanes first, until the leaves it has reached hold the
wanted share of the sample's rows, each counted once. Candidates of these leaves are then compared exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import ship, stored
from caseflow.llm.vectors import folded, matrix, usable

ship(__name__)

SAMPLE = 16_384
TREES = 16
DEPTH = 7
LEAST_LEAF = 8
# Queries look at this share of all rows, and at no fewer than about this many.
SHARE, LEAST_ROWS = 0.6, 320
GROUP_ROWS = 16_384
QUERY_BLOCK = 16_384
SCORED = 256


@dataclass(frozen=True)
class Forest:
    """Hyperplanes as binary heaps: normals (tree, node, dimension) and cuts (tree, node)."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        found = np.zeros((len(rows), len(self.cuts)), dtype=np.int64)
        for tree in range(len(self.cuts)):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", rows, self.normals[tree, node])
                node = 2 * node + 1 + (side >= self.cuts[tree, node])
            found[:, tree] = node - self.cuts.shape[1]
        return found

    def members(self, sample: np.ndarray) -> np.ndarray:
        """Which rows of the sample each leaf holds, as bits (tree, leaf, byte)."""
        trees, leaves = len(self.cuts), 1 << self.depth
        held = np.zeros((trees, leaves, -(-len(sample) // 8)), dtype=np.uint8)
        found, rows = self.leaves(sample), np.arange(len(sample))
        for tree in range(trees):
            np.bitwise_or.at(held[tree], (found[:, tree], rows >> 3), (1 << (rows & 7)).astype(np.uint8))
        return held

    def visits(self, query: np.ndarray, members: np.ndarray, wanted: int) -> list[int]:
        """Leaves (tree * leaves + leaf) in the order of the shared queue, until they hold ``wanted``
        rows of the sample, a row of several leaves counted once."""
        trees, inner = self.cuts.shape
        away = self.normals @ query - self.cuts
        seen, rows = np.zeros(members.shape[2], dtype=np.uint8), 0
        queue = [(-np.inf, tree, 0) for tree in range(trees)]
        found = []
        while queue and rows < wanted:
            distance, tree, node = heapq.heappop(queue)
            if node >= inner:
                leaf = node - inner
                found.append(tree * members.shape[1] + leaf)
                seen |= members[tree, leaf]
                rows = int(np.bitwise_count(seen).sum())
                continue
            side = away[tree, node]
            near, far = (2 * node + 2, 2 * node + 1) if side >= 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (distance, tree, near))
            heapq.heappush(queue, (max(distance, abs(side)), tree, far))
        return found


def fit(sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
    """Trees over a sample of unit vectors; cuts are medians, so leaves are balanced."""
    noise = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    normals, cuts = np.zeros((trees, inner, sample.shape[1])), np.zeros((trees, inner))
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            own = members.pop(node)
            if len(own) > 1:
                one, other = noise.choice(own, 2, replace=False)
                normal = sample[one] - sample[other]
                length = np.linalg.norm(normal)
                normals[tree, node] = normal / length if length else 0.0
            side = sample[own] @ normals[tree, node]
            cuts[tree, node] = np.median(side) if len(own) else 0.0
            right = side >= cuts[tree, node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return Forest(normals, cuts, depth)


def _dealt(nodes: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """A part for each node by a hash of it: ids may all be multiples of some number."""
    mixed = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.asarray(parts, dtype=np.uint64)).astype(np.int64)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _best(rows: np.ndarray, nodes: np.ndarray, queries: np.ndarray, asked: np.ndarray, wanted: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of a group for each query among the leaves it visits, itself excluded.

    ``wanted`` (query, row) says which rows it visits.
    """
    # A group may hold leaves of several trees, and then a row more than once.
    repeats = int(np.unique(nodes, return_counts=True)[1].max())
    lengths, asked_lengths = np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1)
    parts = []
    for at in range(0, len(queries), SCORED):
        part = slice(at, at + SCORED)
        cosine = (queries[part] @ rows.T) / (asked_lengths[part, None] * lengths[None, :])
        cosine[~wanted[part] | (asked[part, None] == nodes[None, :])] = -np.inf
        keep = min(k * repeats, len(nodes))
        floor = -np.partition(-cosine, keep - 1, axis=1)[:, keep - 1]
        x, y = np.nonzero((cosine >= floor[:, None]) & np.isfinite(cosine))
        found = pd.DataFrame({"asked": asked[part][x], "node": nodes[y], "score": cosine[x, y]})
        found = found.sort_values(["asked", "score", "node"], ascending=[True, False, True]).drop_duplicates(["asked", "node"])
        parts.append(found.groupby("asked", sort=False).head(k))
    return pd.concat(parts) if parts else pd.DataFrame({"asked": [], "node": [], "score": []})


def _search(nodes: DataFrame, asked: DataFrame, width: int, k: int, trees: int, depth: int, share: float, least: int) -> DataFrame:
    """(asked, node, score): the k best candidates of each asked node among vectors of one length."""
    size, questions = nodes.count(), asked.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow()
    chosen = _unit(matrix(sample.column("embedding").combine_chunks(), width))
    depth = max(0, min(depth, int(np.log2(max(1.0, len(chosen) / LEAST_LEAF)))))
    forest = fit(chosen, trees, depth)
    members = forest.members(chosen)
    leaves = 1 << depth

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(0), width)
            found = forest.leaves(_unit(rows)) + np.arange(trees) * leaves
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.list_(pa.int64())), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["leaves", "node", "row"],
            )

    indexed = stored(
        nodes.select("embedding", "node").mapInArrow(index, "leaves array<long>, node long, row binary"), "forest-index"
    )
    sizes = np.zeros((trees, leaves), dtype=np.int64)
    for row in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        sizes[row["leaf"] // leaves, row["leaf"] % leaves] = row["count"]
    # Small leaves of a tree share a group, large ones are split into several.
    splits = np.maximum(1, -(-sizes.reshape(-1) // GROUP_ROWS))
    first, group, room = np.zeros(trees * leaves, dtype=np.int64), -1, 0
    for leaf, rows in enumerate(sizes.reshape(-1)):
        if splits[leaf] > 1 or rows > room:
            group, room = group + 1, GROUP_ROWS
        first[leaf] = group
        room -= rows
        if splits[leaf] > 1:
            group, room = group + int(splits[leaf]) - 1, 0
    # So many rows of the sample stand for the share of all rows.
    wanted = int(np.ceil(len(chosen) * min(1.0, max(share, least / max(1, size)))))
    blocks = max(1, -(-questions // QUERY_BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.stack([np.asarray(x) for x in batch.column(0).to_pylist()]) if len(batch) else np.zeros((0, trees), dtype=np.int64)
            row = np.repeat(np.arange(len(leaf)), trees * blocks)
            place = np.repeat(leaf.reshape(-1), blocks)
            node = batch.column(1).to_numpy()
            part = first[place] + _dealt(node[row], splits[place])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part), pa.array(np.tile(np.arange(blocks), len(leaf) * trees)), pa.array(place),
                    batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)),
                ],
                names=["part", "block", "leaf", "node", "row"],
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(0), width)
            units, asked_nodes = _unit(rows), batch.column(1).to_pylist()
            block = _dealt(batch.column(1).to_numpy(), blocks).tolist()
            out: dict[tuple, list] = {}
            for i, unit in enumerate(units):
                for leaf in forest.visits(unit, members, wanted):
                    for part in range(first[leaf], first[leaf] + splits[leaf]):
                        out.setdefault((part, i), []).append(leaf)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([p for p, _ in out], pa.int64()),
                    "block": pa.array([block[i] for _, i in out], pa.int64()),
                    "visited": pa.array(list(out.values()), pa.list_(pa.int64())),
                    "asked": pa.array([asked_nodes[i] for _, i in out], pa.int64()),
                    "query": pa.array([rows[i].tobytes() for _, i in out], pa.binary()),
                }
            )

    def rerank(key: tuple, stored_rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(stored_rows) or not len(queries):
            return pd.DataFrame({"asked": [], "node": [], "score": []}).astype({"asked": "int64", "node": "int64"})
        leaf = stored_rows["leaf"].to_numpy()
        names, place = np.unique(leaf, return_inverse=True)
        visited = np.zeros((len(queries), len(names)), dtype=bool)
        for i, some in enumerate(queries["visited"]):
            visited[i] = np.isin(names, some)
        rows = np.frombuffer(b"".join(stored_rows["row"]), dtype=np.float64).reshape(-1, width)
        asked_rows = np.frombuffer(b"".join(queries["query"]), dtype=np.float64).reshape(-1, width)
        return _best(rows, stored_rows["node"].to_numpy(), asked_rows, queries["asked"].to_numpy(), visited[:, place], k)

    left = indexed.mapInArrow(deal, "part long, block long, leaf long, node long, row binary")
    right = asked.select("embedding", "node").mapInArrow(
        ask, "part long, block long, visited array<long>, asked long, query binary"
    )
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(
        rerank, "asked long, node long, score double"
    )
    return found.groupBy("asked", "node").agg(F.max("score").alias("score"))


def nearest(
    table: DataFrame, asked, k: int = 5, trees: int = TREES, depth: int = DEPTH, share: float = SHARE, least: int = LEAST_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row where ``asked`` holds.

    ``table`` has vec_id, embedding and anything else; ``asked`` is a condition on vec_id. Nearness
    is the cosine in double precision; equal scores go to the smaller vec_id. Trees are built at every size, with
    8 or more rows of the sample in a leaf. A query's leaves hold at least ``share`` of the sample's vectors, each
    counted once, and ``least`` vectors by the same measure; all rows in them are compared. Up to 16,384 vectors the
    sample is the table. Leaves of any size are split into groups, queries into blocks of about 16,384 by a hash.

    * Vectors that are null, empty, zero or hold null or non-finite components take no part, and
      neither do rows without vec_id. Vectors of different lengths are not compared.
    * Equal vectors are searched once; each stands for its k + 1 smallest ids, which is all that
      any answer can use. Rows repeated with the same id count once; an id is no candidate of its own.
    * Fewer than k candidates: all of them. An empty table, or no query, gives an empty result.
    """
    rows = table.filter(F.col("vec_id").isNotNull() & usable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding"
    )
    nodes = stored(folded(rows, k + 1).drop("copies"), "vectors")
    queries = (
        rows.filter(asked)
        .distinct()
        .join(nodes.select(F.col("embedding").alias("_vector"), "node"), F.col("embedding") == F.col("_vector"))
        .select(F.col("vec_id").alias("query_id"), "node")
    )
    queries = stored(queries, "queries")
    wanted = nodes.join(queries.select("node").distinct(), "node", "left_semi")
    found = None
    for row in wanted.select(F.size("embedding").alias("width")).distinct().collect():
        alike = F.size("embedding") == row["width"]
        part = _search(nodes.filter(alike), wanted.filter(alike), row["width"], k, trees, depth, share, least)
        found = part if found is None else found.unionByName(part)
    own = wanted.select(F.col("node").alias("asked"), "node", _norm_product().alias("score"))
    scored = own if found is None else found.unionByName(own)
    # The k + 1 best different vectors hold the answer, whichever ids stand behind them.
    best = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "node"))
    short = scored.withColumn("_nth", best).filter(F.col("_nth") <= k + 1).drop("_nth")
    expanded = short.join(nodes.select("node", "ids"), "node").select("asked", "score", F.explode("ids").alias("vec_id"))
    matched = queries.join(expanded, queries["node"] == expanded["asked"]).filter("query_id != vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        matched.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _norm_product():
    """Cosine of a vector with itself, computed like any other: 1 up to rounding."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return square / (F.sqrt(square) * F.sqrt(square))
