"""Vector similarity (SIM-*): cosine top-k, exact unless ``cosine_topk_approx`` is called by name.

Three exact ways, chosen by measured sizes, all with the same result:

* few queries: their matrix goes to every task, stored vectors are scanned once;
* few stored vectors: their matrix goes to every task, queries are scanned once;
* both large: identical vectors are folded into one, the rest is cut into cells around pivot
  vectors, and a query visits only cells that the triangle inequality cannot rule out. Neighbouring
  cells are joined together, block by block, and a block gives at most k rows per query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import vectors as vec
from caseflow.operators import ranking
from caseflow.session import cut_lineage

# Tasks get the helpers of these modules with their function, so that executors need no copy of
# this package.
for _module in (vec, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

QUERY, STORED = 0, 1
# Queries whose distances to all pivots a task holds at once.
ROUTED_AT_ONCE = 1024


@dataclass(frozen=True)
class Limits:
    """Largest sizes that may be sent to every task, the vectors of a cell, and the rows of a side of the join."""

    queries: int = 1000
    matrix_bytes: int = 64 << 20
    block: int = 4096
    pivots: int = 1024
    tile: int = 16_384


def embedding_table(df: DataFrame, model: str, as_of, column: str = "embedding") -> DataFrame:
    """SIM-3: vectors with their model tag, dimension and load time."""
    return df.withColumns(
        {
            column: F.col(column).cast("array<float>"),
            "embedding_model": F.lit(model),
            "embedding_dim": F.size(column),
            "created_at": F.lit(as_of).cast("timestamp"),
        }
    )


def text_vectors(df: DataFrame, column: str, dim: int = 384) -> DataFrame:
    """SIM-4: hashed TF-IDF vectors of length 1; NULL text counts as empty."""
    text = df.withColumn("_text", F.coalesce(column, F.lit("")))
    stages = [
        Tokenizer(inputCol="_text", outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]
    fitted = Pipeline(stages=stages).fit(text).transform(text)
    return fitted.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_text", "_words", "_counts", "_weights", "_unit"
    )


def _sizes(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes as a float64 matrix), from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    return row["n"], row["n"] * (row["dim"] or 0) * 8


def cosine_topk(queries: DataFrame, stored: DataFrame, k: int = 5, limits: Limits = Limits()) -> DataFrame:
    """SIM-1, J-10: the k most similar stored vectors per query.

    ``queries`` has (query_id, embedding), ``stored`` (claim_id, embedding). Gives (query_id,
    claim_id, similarity_score, position); equal scores go by claim_id.
    """
    queries = queries.select("query_id", "embedding").filter("embedding is not null")
    stored = stored.select("claim_id", "embedding").filter("embedding is not null")
    asked, asked_bytes = _sizes(queries)
    if asked <= limits.queries and asked_bytes <= limits.matrix_bytes:
        found = _scan_stored(queries, stored, k)
    elif _sizes(stored)[1] <= limits.matrix_bytes:
        found = _scan_queries(queries, stored, k)
    else:
        found = _cell_join(queries, stored, k, limits)
    order = [F.col("similarity_score").desc(), F.col("claim_id")]
    return ranking.top_per_key(found, ["query_id"], order, k, "position")


def _local(df: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a frame whose size has been checked."""
    table = df.orderBy(key).toArrow()
    return np.array(table.column(key).to_pylist()), vec.matrix(table.column("embedding"))


def _result_schema(queries: DataFrame, stored: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, " \
           f"claim_id {stored.schema['claim_id'].dataType.simpleString()}, similarity_score double"


def _result(query_ids: np.ndarray, found: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "query_id": query_ids[found["query"].to_numpy(dtype=np.int64)].tolist(),
            "claim_id": found["id"].tolist(),
            "similarity_score": found["score"].to_numpy(dtype=np.float64),
        }
    )


def _scan_stored(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    query_ids, rows = _local(queries, "query_id")
    asked = vec.unit(rows, QUERY) if len(rows) else rows

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows == 0 or len(asked) == 0:
                continue
            block = vec.unit(vec.matrix(batch.column("embedding")), STORED)
            ids = np.array(batch.column("claim_id").to_pylist())
            found = vec.nearest(asked, block, ids, k)
            kept = found if kept is None else vec.best(pd.concat([kept, found]), k)
        if kept is not None:
            yield _result(query_ids, kept)

    return stored.mapInArrow(scan, _result_schema(queries, stored))


def _scan_queries(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    ids, rows = _local(stored, "claim_id")
    block = vec.unit(rows, STORED) if len(rows) else rows

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                asked = vec.unit(vec.matrix(batch.column("embedding")), QUERY)
                yield _result(
                    np.array(batch.column("query_id").to_pylist()), vec.nearest(asked, block, ids, k)
                )

    return queries.mapInArrow(scan, _result_schema(queries, stored))


def _fold(df: DataFrame, key: str, keep: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows with the fingerprint of their vector, distinct vectors). With ``keep`` the distinct
    vectors also get their ``keep`` smallest ids."""
    marked = df.withColumn("vector", F.md5(F.col("embedding").cast("string")))
    if keep is None:
        return marked, marked.groupBy("vector").agg(F.any_value("embedding").alias("embedding"))
    first = ranking.top_per_key(marked, ["vector"], [F.col(key)], keep, "nth")
    distinct = first.groupBy("vector").agg(
        F.any_value("embedding").alias("embedding"),
        F.min(key).alias("first_id"),
        F.sort_array(F.collect_list(key)).alias("ids"),
    )
    return marked, distinct


def _assign(df: DataFrame, pivots: np.ndarray, slot: int) -> DataFrame:
    """Nearest pivot of each distinct vector and the distance to it."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows = vec.unit(vec.matrix(frame["embedding"]), slot)
                away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ pivots.T)))
                frame["cell"] = away.argmin(axis=1).astype(np.int32)
                frame["away"] = away.min(axis=1)
                yield frame

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(scan, f"{fields}, cell int, away double")


def _groups(members: np.ndarray, most: int) -> np.ndarray:
    """Number of the group of each cell: cells in order, together ``most`` vectors or one cell."""
    numbers, held = [], 0
    for n in members.astype(int).tolist():
        new = numbers and held + n > most
        numbers.append(numbers[-1] + 1 if new else numbers[-1] if numbers else 0)
        held = n if new else held + n
    return np.array(numbers, dtype=np.int64)


def _cell_join(queries: DataFrame, stored: DataFrame, k: int, limits: Limits) -> DataFrame:
    marked, asked = _fold(queries, "query_id", None)
    _, distinct = _fold(stored, "claim_id", k)
    distinct = cut_lineage(distinct)
    # Fingerprints are spread at random, so the first ones in order are a fair sample.
    wanted = int(min(limits.pivots, max(1, distinct.count() // limits.block)))
    sample = distinct.select("vector", "embedding").orderBy("vector").limit(wanted)
    pivots = vec.unit(_local(sample, "vector")[1], STORED)
    homes = cut_lineage(_assign(distinct, pivots, STORED))
    asked = cut_lineage(asked)

    shape = homes.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")
    ).toPandas()  # one row per pivot
    shape = shape.set_index("cell").reindex(range(len(pivots)))
    members = shape["n"].fillna(0).to_numpy()
    near, far = shape["near"].fillna(np.inf).to_numpy(), shape["far"].fillna(-np.inf).to_numpy()
    # A query goes once to a group of cells, however many of them it visits: where little can be ruled out, the copies
    # grow with the vectors over the tile, not with the cells.
    groups = _groups(members, limits.tile)
    first_cells = np.searchsorted(groups, np.arange(groups[-1] + 1)) if len(groups) else np.zeros(0, dtype=int)
    numbers = marked.sparkSession.createDataFrame(list(enumerate(groups.tolist())), "cell int, tile int")
    tiles = homes.join(F.broadcast(numbers), "cell").drop("cell").withColumnRenamed("tile", "cell")

    def home_cells(away):
        """Nearest cells up to the first that brings the members to k."""
        order = away.argsort(axis=1, kind="stable")
        before = members[order].cumsum(axis=1) - members[order]
        chosen = np.zeros(away.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen

    def visit(second_round: bool):
        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in (f.iloc[i : i + ROUTED_AT_ONCE] for f in frames for i in range(0, len(f), ROUTED_AT_ONCE)):
                rows = vec.unit(vec.matrix(frame["embedding"]), QUERY)
                away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ pivots.T)))
                chosen = np.logical_or.reduceat(home_cells(away) & (members > 0)[None, :], first_cells, axis=1)
                if second_round:
                    # Widened by more than the rounding of scores and distances.
                    reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (frame["floor"].to_numpy() - 1e-9))) + 1e-6
                    bound = np.maximum(away - far[None, :], near[None, :] - away)
                    left = (bound <= reach[:, None]) & (members > 0)[None, :]
                    chosen = np.logical_or.reduceat(left, first_cells, axis=1) & ~chosen
                row, tile = np.nonzero(chosen)
                yield pd.DataFrame(
                    {
                        "query": frame["vector"].to_numpy()[row],
                        "embedding": frame["embedding"].to_numpy()[row],
                        "cell": tile.astype(np.int32),
                    }
                )

        return scan

    routed = "query string, embedding array<float>, cell int"
    first = cut_lineage(
        _block_join(asked.mapInPandas(visit(False), routed), tiles, k, limits.tile)
    )
    reached = first.groupBy("query").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = asked.join(reached.withColumnRenamed("query", "vector"), "vector", "left").withColumn(
        "floor", F.when(F.col("n") >= k, F.col("floor")).otherwise(-1.0)
    )
    second = _block_join(floors.mapInPandas(visit(True), routed), tiles, k, limits.tile)
    return _unfold(first.unionByName(second), homes, marked, k)


def _unfold(found: DataFrame, distinct: DataFrame, marked: DataFrame, k: int, hot: int = 100_000) -> DataFrame:
    """From the best distinct vectors of each distinct query to the k best ids of each query row.

    Rows of a query vector that more than ``hot`` rows share stay where they are: its k results are
    broadcast, fewer than k rows for every ``hot`` rows of the table.
    """
    order = [F.col("score").desc(), F.col("id")]
    close = ranking.top_per_key(found, ["query"], order, k, "nth").drop("nth")
    # Each close vector stands for its copies: its k smallest ids are enough.
    folded = distinct.select(F.col("first_id").alias("id"), "ids")
    copies = close.join(folded, "id").select("query", "score", F.explode("ids").alias("claim_id"))
    short = cut_lineage(
        ranking.top_per_key(copies, ["query"], [F.col("score").desc(), F.col("claim_id")], k, "nth").drop("nth")
    )
    rows = marked.select("query_id", F.col("vector").alias("query"))
    frequent = F.broadcast(rows.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("query"))
    ordinary = rows.join(frequent, "query", "left_anti").join(short, "query")
    shared = rows.join(F.broadcast(short.join(frequent, "query", "left_semi")), "query")
    return ordinary.unionByName(shared).select("query_id", "claim_id", F.col("score").alias("similarity_score"))


def cosine_topk_approx(
    queries: DataFrame, stored: DataFrame, k: int = 5, tables: int = 32, bits: int = 5, seed: int = 17, block: int = 32_768
) -> DataFrame:
    """The approximate counterpart of ``cosine_topk``, same columns: locality-sensitive hashing.

    A vector's cell in each of ``tables`` tables is the side it lies on of ``bits`` random
    hyperplanes. A query is compared with the vectors that share a cell with it: more tables find
    more, more bits compare less. Every vector is sent to ``tables`` cells, whatever the number
    of vectors; cells of any size are joined block by block. Pairs that share no cell are missed.
    The defaults find nine of ten even among vectors without structure; clustered ones need fewer.
    """
    queries = queries.select("query_id", "embedding").filter("embedding is not null")
    stored = stored.select("claim_id", "embedding").filter("embedding is not null")
    marked, asked = _fold(queries, "query_id", None)
    _, distinct = _fold(stored, "claim_id", k)
    distinct = cut_lineage(distinct)

    def hashed(df: DataFrame, slot: int) -> DataFrame:
        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                rows = vec.unit(vec.matrix(frame["embedding"]), slot)
                planes = np.random.default_rng(seed).normal(size=(rows.shape[1], tables * bits))
                sides = (rows @ planes >= 0).reshape(len(rows), tables, bits)
                cells = sides @ (1 << np.arange(bits)) + np.arange(tables) * (1 << bits)
                routed = frame.loc[frame.index.repeat(tables)].copy()
                routed["cell"] = cells.reshape(-1).astype(np.int32)
                yield routed

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(scan, f"{fields}, cell int")

    homes = cut_lineage(hashed(distinct.drop("ids"), STORED))
    routed = cut_lineage(hashed(asked.withColumnRenamed("vector", "query"), QUERY))
    # The k best of the union are among the k best of every cell that holds them; a pair may come from several cells.
    found = _block_pairs(routed, homes, k, block).groupBy("query", "id").agg(F.max("score").alias("score"))
    order = [F.col("similarity_score").desc(), F.col("claim_id")]
    return ranking.top_per_key(_unfold(found, distinct, marked, k), ["query_id"], order, k, "position")


def _block_join(routed: DataFrame, homes: DataFrame, k: int, block: int) -> DataFrame:
    """Top k per query over the cells it was routed to; a stored vector has one cell."""
    found = _block_pairs(routed, homes, k, block)
    return ranking.top_per_key(found, ["query"], [F.col("score").desc(), F.col("id")], k, "nth").drop("nth")


def _in_blocks(
    routed: DataFrame, homes: DataFrame, key: str, home_key: str, block: int, home_block: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Queries and stored vectors of every cell, dealt to blocks of both, and the columns of a pair of blocks.

    Both sides of a cell are split into blocks of about ``block`` and ``home_block`` rows, so no task holds a whole
    cell however many rows it has.
    """

    def blocks(df, name, most):
        counted = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
        return F.broadcast(counted)  # one row per pivot

    def spread(df, key, own, other, own_blocks, other_blocks):
        placed = df.join(own_blocks, "cell").join(other_blocks, "cell")
        return placed.withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))
        )

    stored_blocks, query_blocks = blocks(homes, "sides", home_block), blocks(routed, "fronts", block)
    left = spread(routed, key, "front", "side", query_blocks, stored_blocks)
    right = spread(homes, home_key, "side", "front", stored_blocks, query_blocks)
    return left, right, ["cell", "side", "front"]


def _block_pairs(routed: DataFrame, homes: DataFrame, k: int, block: int) -> DataFrame:
    """Top k per query and block of the cells it was routed to."""
    left, right, keys = _in_blocks(
        routed, homes.select("vector", "first_id", "embedding", "cell"), "query", "vector", block, block
    )
    id_type = homes.schema["first_id"].dataType.simpleString()

    def join(asked: pd.DataFrame, block_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block_rows):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        found = vec.nearest(
            vec.unit(vec.matrix(asked["embedding"]), QUERY),
            vec.unit(vec.matrix(block_rows["embedding"]), STORED),
            block_rows["first_id"].to_numpy(),
            k,
        )
        found["query"] = asked["query"].to_numpy()[found["query"].to_numpy(dtype=np.int64)]
        return found

    return (
        left.select("query", "embedding", *keys)
        .groupBy(*keys)
        .cogroup(right.select("first_id", "embedding", *keys).groupBy(*keys))
        .applyInPandas(join, f"query string, id {id_type}, score double")
    )


def similar_fraud(
    vectors: DataFrame, k: int = 5, exclude_self: bool = False, limits: Limits = Limits(), approx: dict | None = None
) -> DataFrame:
    """SIM-2: for every claim, how many of its k most similar claims were fraud.

    ``vectors`` has (claim_id, embedding, is_fraud). A claim counts as similar to itself unless
    ``exclude_self``. Neighbours are exact; ``approx`` asks for ``cosine_topk_approx`` with these
    parameters, for tables whose pairs are too many to compare.
    """
    queries = vectors.select(F.col("claim_id").alias("query_id"), "embedding")
    wanted = k + 1 if exclude_self else k
    if approx is None:
        found = cosine_topk(queries, vectors, wanted, limits)
    else:
        found = cosine_topk_approx(queries, vectors, wanted, **approx)
    if exclude_self:
        others = found.filter("query_id != claim_id").drop("position")
        order = [F.col("similarity_score").desc(), F.col("claim_id")]
        found = ranking.top_per_key(others, ["query_id"], order, k, "position")
    return fraud_counts(found, vectors)


def fraud_counts(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """How many of each query's neighbours are fraud, whichever search found them."""
    labels = vectors.select("claim_id", "is_fraud")
    return (
        found.join(labels, "claim_id")
        .groupBy(F.col("query_id").alias("claim_id"))
        .agg(
            F.sum(F.col("is_fraud").cast("int")).alias("similar_fraud_count"),
            F.count(F.lit(1)).alias("total_similar_claims"),
        )
    )


def with_details(topk: DataFrame, claims: DataFrame) -> DataFrame:
    """SIM-5, J-8: claim columns of the hits, score rounded to three decimals."""
    wanted = claims.select("claim_id", "description", "claim_amount", "status", F.col("is_fraud").alias("was_fraud"))
    return (
        topk.join(wanted, "claim_id")
        .withColumn("similarity_score", F.round("similarity_score", 3))
        .select(*topk.columns, "description", "claim_amount", "status", "was_fraud")
    )
