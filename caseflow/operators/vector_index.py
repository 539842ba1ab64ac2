"""A stored index for vector search (SIM-2, J-10): inverted lists of quantised codes, exact reranking.

``build`` deals the vectors into lists around centres and writes them as a table partitioned by list, with
one byte per dimension beside the exact values. ``search`` compares a query with the codes of the nearest
lists only, and the best of those exactly. How many rows that are grows more slowly than the table. The
exact search of ``similarity`` stays the default; this one is for tables that are searched again and again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import vectors as vec
from caseflow.operators import ranking, similarity
from caseflow.operators.similarity import QUERY, STORED
from caseflow.session import cut_lineage
from caseflow.sources import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_LISTS = 4096
#: Vectors that the centres are fitted on, and the rounds of it.
SAMPLE, ROUNDS = 16_384, 8
#: Rows of a list that are written by one task.
LIST_ROWS = 100_000
#: A query is compared with the codes of about FACTOR * rows ** POWER vectors. Vectors without any structure
#: need that many for nine of their ten nearest; clustered ones need far fewer.
FACTOR, POWER = 1.5, 0.89
#: Vectors of a group of lists, and queries that a task compares with them. A query goes once to a group, however
#: many of its lists it visits.
GROUP_ROWS, QUERY_ROWS = 32_768, 8192
#: Scores of a query with a centre that a task holds at once.
CELLS = 1 << 20


def reach(rows: int, factor: float = FACTOR, power: float = POWER) -> int:
    return min(rows, int(np.ceil(factor * rows**power)))


def encode(rows: np.ndarray) -> list[bytes]:
    """Unit rows as a scale and one signed byte per dimension."""
    scale = np.abs(rows).max(axis=1, initial=0.0) / 127
    codes = np.round(rows / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale.astype("<f4"), codes)]


def decode(codes: pd.Series) -> np.ndarray:
    flat = np.frombuffer(b"".join(codes), dtype=np.int8).reshape(len(codes), -1)
    return flat[:, 4:].astype(np.float64) * flat[:, :4].copy().view("<f4")


def _centres(vectors: DataFrame, rows: int, lists: int, seed: int) -> np.ndarray:
    """Centres from different vectors, chosen by hash; their number is bounded."""
    text = F.col("embedding").cast("string")
    share = min(1.0, 2 * SAMPLE / max(1, rows))
    chosen = vectors.filter(F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = chosen.groupBy(text.alias("text")).agg(F.any_value("embedding").alias("embedding")).orderBy("text").limit(SAMPLE)
    sample = vec.unit(vec.matrix(some.toArrow().column("embedding")), STORED)
    if not len(sample):
        return np.zeros((0, 0))
    pick = np.random.default_rng(seed)
    centres = sample[pick.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


def build(vectors: DataFrame, root: str, name: str, lists: int | None = None, seed: int = 11) -> None:
    """Write the index of ``vectors`` (claim_id, embedding): the tables ``name`` and ``name``_centres.

    Every vector is in one list; NULL vectors are in none. A list of any size is written by several tasks.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("claim_id", "embedding").filter("embedding is not null")
    rows = vectors.count()
    wanted = lists or min(MOST_LISTS, max(1, round(rows**0.5)))
    centres = _centres(vectors, rows, wanted, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(centres)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            if batch.num_rows:
                unit = vec.unit(vec.matrix(batch.column("embedding")), STORED)
                home = pa.array((unit @ centres.T).argmax(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(encode(unit), pa.binary()), home], names=["claim_id", "embedding", "code", "list"]
                )

    fields = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("claim_id", "embedding")]
    placed = cut_lineage(vectors.mapInArrow(assign, ", ".join([*fields, "code binary", "list int"])))
    sizes = cut_lineage(placed.groupBy("list").agg(F.count(F.lit(1)).alias("rows")))
    # One row per list, 4,096 at most.
    spread = placed.join(F.broadcast(sizes), "list").withColumn(
        "side", F.pmod(F.xxhash64("claim_id"), F.ceil(F.col("rows") / LIST_ROWS))
    )
    dealt = spread.repartition("list", "side").select("claim_id", "embedding", "code", "list")
    store.save(dealt, root, name, partition_by=("list",))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    store.save(known.join(sizes, "list", "left").fillna(0, ["rows"]), root, f"{name}_centres")


def _known(spark: SparkSession, root: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Centres of a written index and the rows of their lists."""
    table = store.load(spark, root, f"{name}_centres").orderBy("list").toArrow()  # 4,096 rows at most
    return vec.matrix(table.column("centre")), table.column("rows").to_numpy()


def _visits(
    frames: Iterator[pd.DataFrame], centres: np.ndarray, sizes: np.ndarray, wanted: int
) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Queries, a few at a time, with all lists from the nearest on and which of these places are visited."""
    step = max(1, CELLS // max(1, len(centres)))
    for frame in (f.iloc[at : at + step] for f in frames for at in range(0, len(f), step)):
        if len(centres):
            near = np.argsort(-(vec.unit(vec.matrix(frame["embedding"]), QUERY) @ centres.T), axis=1, kind="stable")
            held = np.cumsum(sizes[near], axis=1)
            yield frame, near, (held - sizes[near] < wanted) & (sizes[near] > 0)


def probed(spark: SparkSession, root: str, name: str, asked: DataFrame, factor: float = FACTOR, power: float = POWER) -> DataFrame:
    """(query, embedding, cell, rows): the lists that each of ``asked`` (query, embedding) is compared with,
    nearest first, until they hold ``reach`` rows."""
    centres, sizes = _known(spark, root, name)
    wanted = reach(int(sizes.sum()), factor, power)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, near, chosen in _visits(frames, centres, sizes, wanted):
            row, place = np.nonzero(chosen)
            cells = near[row, place]
            yield pd.DataFrame(
                {
                    "query": frame["query"].to_numpy()[row], "embedding": frame["embedding"].to_numpy()[row],
                    "cell": cells.astype(np.int32), "rows": sizes[cells],
                }
            )

    kind = asked.schema["embedding"].dataType.simpleString()
    return asked.select("query", "embedding").mapInPandas(route, f"query string, embedding {kind}, cell int, rows long")


def _grouped(
    asked: DataFrame, centres: np.ndarray, sizes: np.ndarray, groups: np.ndarray, wanted: int
) -> DataFrame:
    """(query, embedding, cell, visited): the groups of lists that each query is sent to, and the bits of the lists
    of the group that it visits."""
    first = np.searchsorted(groups, np.arange(groups[-1] + 1)) if len(groups) else np.zeros(0, dtype=int)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, near, chosen in _visits(frames, centres, sizes, wanted):
            visited = np.zeros(near.shape, dtype=bool)
            np.put_along_axis(visited, near, chosen, axis=1)
            for group, lists in enumerate(np.split(visited, first[1:], axis=1)):
                some = np.flatnonzero(lists.any(axis=1))
                yield pd.DataFrame(
                    {
                        "query": frame["query"].to_numpy()[some], "embedding": frame["embedding"].to_numpy()[some],
                        "cell": np.full(len(some), group, dtype=np.int32),
                        "visited": [bits.tobytes() for bits in np.packbits(lists[some], axis=1)],
                    }
                )

    kind = asked.schema["embedding"].dataType.simpleString()
    return asked.select("query", "embedding").mapInPandas(route, f"query string, embedding {kind}, cell int, visited binary")


def _visited(routed: DataFrame, groups: np.ndarray) -> list[int]:
    """The lists that some query visits, 4,096 at most."""
    held = np.bincount(groups)
    first = np.cumsum(held) - held

    def either(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for frame in frames:
            for cell, bits in frame.groupby("cell")["visited"]:
                some = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1)
                seen[cell] = np.bitwise_or.reduce(some, axis=0) | seen.get(cell, 0)
        for cell, bits in seen.items():
            lists = np.flatnonzero(np.unpackbits(bits))
            yield pd.DataFrame({"list": (lists + first[cell]).astype(np.int32)})

    return [r[0] for r in routed.select("cell", "visited").mapInPandas(either, "list int").distinct().collect()]


def _shortlists(routed: DataFrame, homes: DataFrame, groups: np.ndarray, keep: int, block: int, asked_rows: int) -> DataFrame:
    """(query, id): the ``keep`` best by code among the lists that a query visits.

    The codes of a group and its queries are both split into blocks. A block gives one row per query, which holds
    its best, so what is sorted and shuffled are rows of queries and not of pairs.
    """
    kind = homes.schema["id"].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    first = np.searchsorted(groups, np.arange(groups[-1] + 1)) if len(groups) else np.zeros(0, dtype=int)

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query": [], "ids": [], "scores": []})
        held = held.sort_values("id", kind="stable")  # places stand for ids, in the same order
        lists = held["list"].to_numpy() - first[held["cell"].iloc[0]]
        bits = np.frombuffer(b"".join(asked["visited"]), dtype=np.uint8).reshape(len(asked), -1)
        visited = np.unpackbits(bits, axis=1).astype(bool)
        found = vec.nearest(
            vec.unit(vec.matrix(asked["embedding"]), QUERY), decode(held["code"]), np.arange(len(held)), keep, visited, lists
        )
        # Pandas makes floats of whole numbers beside a NULL.
        names = [None if pd.isna(x) else int(x) if whole else x for x in held["id"].tolist()]
        rows, at = np.unique(found["query"].to_numpy(dtype=np.int64), return_index=True)
        edges = [*at.tolist(), len(found)]
        places, scores = found["id"].to_numpy(dtype=np.int64).tolist(), found["score"].to_numpy()
        return pd.DataFrame(
            {
                "query": asked["query"].to_numpy()[rows],
                "ids": [[names[j] for j in places[i:j]] for i, j in zip(edges, edges[1:])],
                "scores": [scores[i:j] for i, j in zip(edges, edges[1:])],
            }
        )

    left, right, keys = similarity._in_blocks(routed, homes, "query", "id", asked_rows, block)
    found = (
        left.select("query", "embedding", "visited", *keys)
        .groupBy(*keys)
        .cogroup(right.select("id", "code", "list", *keys).groupBy(*keys))
        .applyInPandas(compare, f"query string, ids array<{kind}>, scores array<double>")
    )
    # Best first; equal scores go by id.
    pairs = F.arrays_zip(F.transform("scores", lambda x: -x).alias("away"), F.col("ids").alias("id"))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, keep)
    merged = found.select("query", pairs.alias("found")).groupBy("query").agg(best.alias("found"))
    return merged.select("query", F.explode("found.id").alias("id"))


def search(
    queries: DataFrame, root: str, name: str, k: int = 5, rerank: int = 50, factor: float = FACTOR, power: float = POWER,
    block: int = GROUP_ROWS,
) -> DataFrame:
    """As ``similarity.cosine_topk``, from a written index: (query_id, claim_id, similarity_score, position) per
    row of ``queries`` (query_id, embedding).

    The ``rerank`` best by code are compared exactly. Only lists that some query visits are read. Lists travel in
    groups of about ``block`` vectors and are joined with queries block by block, so no task holds a whole large list.
    """
    spark = queries.sparkSession
    queries = queries.select("query_id", "embedding").filter("embedding is not null")
    marked, asked = similarity._fold(queries, "query_id", None)
    asked = cut_lineage(asked.withColumnRenamed("vector", "query"))
    centres, sizes = _known(spark, root, name)
    groups = similarity._groups(sizes, block)
    wanted = reach(int(sizes.sum()), factor, power)
    routed = cut_lineage(_grouped(asked, centres, sizes, groups, wanted))
    index = store.load(spark, root, name).filter(F.col("list").isin(_visited(routed, groups)))
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(groups.tolist())), "list int, cell int"))  # one row per list
    homes = index.select(F.col("claim_id").alias("id"), "code", "list").join(numbers, "list")
    close = _shortlists(routed, homes, groups, max(k, rerank), block, min(block, QUERY_ROWS))
    exact = index.select(F.col("claim_id").alias("id"), F.col("embedding").alias("stored"))
    pairs = close.join(exact, "id").join(asked, "query")

    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left = vec.unit(vec.matrix(batch.column("embedding")), QUERY)
                right = vec.unit(vec.matrix(batch.column("stored")), STORED)
                score = np.round((left * right).sum(axis=1), vec.DECIMALS) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(score)], names=["query", "claim_id", "similarity_score"])

    id_type = index.schema["claim_id"].dataType.simpleString()
    scored = pairs.mapInArrow(rescored, f"query string, claim_id {id_type}, similarity_score double")
    order = [F.col("similarity_score").desc(), F.col("claim_id")]
    short = ranking.top_per_key(scored, ["query"], order, k, "position")
    rows = marked.select("query_id", F.col("vector").alias("query"))
    return rows.join(short, "query").select("query_id", "claim_id", "similarity_score", "position")
