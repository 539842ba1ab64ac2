"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned onto their principal axes, so that the leading dimensions
carry most of every product. Tiles of vectors close to each other on the leading axes are compared
pairwise: products are added up over the leading dimensions first, what the others can still
add is bounded by the norms of the suffixes, and a pair is dropped as soon as it cannot reach the
threshold. Whole pairs of tiles whose boxes are too far apart are never compared. Neighbouring tiles
travel as one group: a vector goes once to each group that holds a tile near its own, so where
nothing can be ruled out the copies grow with the number of groups and not of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import free, replace_columns, ship, stored
from caseflow.llm.graph import components, local_labels
from caseflow.llm.vectors import folded, matrix, usable

ship(__name__)

SAMPLE = 8192
TILE = 4096
MOST_TILES = 1024
# Rows of a group of tiles; a task holds two groups. Smaller tables are cut into about GROUPS of them.
GROUP_ROWS = 49_152
GROUPS = 8
# Copies in one batch on their way to the groups.
DEALT = 16_384
LEADING = 16
BLOCK = 1024
# Rounding of float32 products; pairs this close to the threshold are computed exactly anyway.
SLACK = 1e-4
PENDING = 1 << 20
SURVIVORS = 1 << 16


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, the strongest first; a rotation, so cosines stay."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1]


def _cuts(turned: np.ndarray, depth: int) -> np.ndarray:
    """Median cuts of a sample along axis 0, 1, 2 ... as a binary heap; leaves are the tiles."""
    cuts = np.zeros((1 << depth) - 1)
    members = {0: np.arange(len(turned))}
    for node in range(len(cuts)):
        own = members.pop(node)
        axis = ((node + 1).bit_length() - 1) % turned.shape[1]
        values = turned[own, axis]
        cuts[node] = np.median(values) if len(values) else 0.0
        members[2 * node + 1], members[2 * node + 2] = own[values < cuts[node]], own[values >= cuts[node]]
    return cuts


def _tile_of(turned: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(turned), dtype=np.int64)
    for level in range(depth):
        axis = level % turned.shape[1]
        node = 2 * node + 1 + (turned[:, axis] >= cuts[node])
    return node - len(cuts)


def _far_apart(low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of boxes whose distance alone keeps all cosines below the threshold."""
    gaps = np.zeros((len(low), len(low)))
    for axis in range(low.shape[1]):
        gap = np.maximum(low[:, None, axis] - high[None, :, axis], low[None, :, axis] - high[:, None, axis])
        gaps += np.maximum(gap, 0.0) ** 2
    return 1.0 - gaps / 2.0 < threshold - SLACK


def _stages(width: int) -> list[int]:
    """Numbers of leading dimensions after which pairs are looked at again."""
    stops, at = [], LEADING
    while at < width:
        stops.append(at)
        at *= 2
    return [*stops, width]


def _groups(sizes: np.ndarray, most: int) -> np.ndarray:
    """Group of each tile: tiles in order, together ``most`` rows or one tile."""
    numbers, held = [], 0
    for n in sizes.tolist():
        new = bool(numbers) and held + n > most
        numbers.append(numbers[-1] + 1 if new else numbers[-1] if numbers else 0)
        held = n if new else held + n
    return np.array(numbers, dtype=np.int64)


def _blocks(tiles: np.ndarray) -> list[tuple[int, int, int]]:
    """(tile, start, end) of runs of equal tiles, BLOCK rows at most each."""
    if not len(tiles):
        return []
    edges = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
    found = []
    for start, end in zip(edges, edges[1:]):
        cuts = np.linspace(start, end, -(-(end - start) // BLOCK) + 1).astype(int).tolist()
        found += [(int(tiles[start]), i, j) for i, j in zip(cuts, cuts[1:])]
    return found


def close_pairs(
    left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float, tiles: tuple | None = None, near: np.ndarray | None = None
) -> Iterator[tuple]:
    """Index pairs with cosine >= threshold between the rows of two matrices, block by block.

    With the same matrix twice each pair comes once. ``tiles`` has the tiles of the rows on both sides, in
    order; of these only the ones that ``near`` holds for are compared.
    """
    same = left is right
    stops = _stages(left.shape[1])
    first = stops[0]

    def prepare(rows: np.ndarray) -> tuple:
        # Block by block: the rows may be single floats, and only one block at a time gets a double copy.
        norms, turned = np.empty(len(rows)), np.empty(rows.shape, dtype=np.float32)
        rest = [np.zeros(len(rows), dtype=np.float32) for _ in stops]
        for at in range(0, len(rows), BLOCK):
            some = slice(at, at + BLOCK)
            exact = rows[some].astype(np.float64)
            norms[some] = np.linalg.norm(exact, axis=1)
            spun = _unit(exact) @ axes
            turned[some] = spun
            suffix = np.sqrt(np.maximum(0.0, np.cumsum(spun[:, ::-1] ** 2, axis=1)[:, ::-1]))
            for left_over, stop in zip(rest, stops):
                if stop < rows.shape[1]:
                    left_over[some] = suffix[:, stop]
        # One product of these bounds the cosine: the leading dimensions, and at most the lengths of the others.
        return rows, norms, turned, rest, np.column_stack([turned[:, :first], rest[0]])

    a_rows, a_norm, a_turned, a_rest, a_bound = prepare(left)
    b_rows, b_norm, b_turned, b_rest, b_bound = (a_rows, a_norm, a_turned, a_rest, a_bound) if same else prepare(right)
    a_tiles, b_tiles = tiles or (np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64))
    a_blocks, b_blocks = _blocks(a_tiles), _blocks(b_tiles)
    goal = np.float32(threshold - SLACK)
    for a_tile, i, a_end in a_blocks:
        for b_tile, j, b_end in b_blocks:
            if same and j < i or near is not None and not near[a_tile, b_tile]:
                continue
            # Faster than nonzero, which is most of the time where few are near.
            x, y = np.divmod(np.flatnonzero(a_bound[i:a_end] @ b_bound[j:b_end].T >= goal), b_end - j)
            x, y = x + i, y + j
            if same and i == j:
                later = x < y
                x, y = x[later], y[later]
            for at in range(0, len(x), SURVIVORS):
                part = slice(at, at + SURVIVORS)
                p, q = x[part], y[part]
                partial = np.einsum("ij,ij->i", a_turned[p, :first], b_turned[q, :first])
                for stop, (start, end) in enumerate(zip(stops, stops[1:]), 1):
                    partial = partial + np.einsum("ij,ij->i", a_turned[p, start:end], b_turned[q, start:end])
                    alive = partial + a_rest[stop][p] * b_rest[stop][q] >= goal
                    p, q, partial = p[alive], q[alive], partial[alive]
                products = np.einsum("ij,ij->i", a_rows[p].astype(np.float64), b_rows[q].astype(np.float64))
                close = products / (a_norm[p] * b_norm[q]) >= threshold
                if close.any():
                    yield p[close], q[close]


def _compare(nodes: np.ndarray, copies: np.ndarray, pairs: Iterator[tuple]) -> pd.DataFrame:
    """What one task says: links per vector, and a spanning forest of all links it found."""
    count = np.zeros(len(nodes), dtype=np.int64)
    labels = np.arange(len(nodes))
    left, right, pending = [], [], 0

    def joined() -> np.ndarray:
        every = np.arange(len(nodes))
        return local_labels(len(nodes), np.concatenate([every, *left]), np.concatenate([labels, *right]))

    for a, b in pairs:
        np.add.at(count, a, copies[b])
        np.add.at(count, b, copies[a])
        left.append(a)
        right.append(b)
        pending += len(a)
        if pending > PENDING:
            labels = joined()
            left, right, pending = [], [], 0
    labels = joined()
    some = np.flatnonzero(count)
    return pd.DataFrame({"node": nodes[some], "n_links": count[some], "linked": nodes[labels[some]]})


def _dealt(nodes: DataFrame, width: int, threshold: float) -> tuple[DataFrame, Callable[[pd.DataFrame], pd.DataFrame]]:
    """Vectors of one length dealt to pairs of groups of tiles, (first, second), and what compares such a pair."""
    size = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow()
    chosen = _unit(matrix(sample.column("embedding").combine_chunks(), width))
    axes = _axes(chosen)
    leading = min(LEADING, width)
    depth = max(0, min(int(np.ceil(np.log2(max(1, size / TILE)))), int(np.log2(MOST_TILES))))
    cuts = _cuts((chosen @ axes)[:, :leading], depth)

    # Single floats travel as such; cosines are computed in doubles all the same.
    element = nodes.schema["embedding"].dataType.elementType.typeName()
    kind = np.dtype(np.float32 if element == "float" else np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = (_unit(matrix(batch.column(0), width)) @ axes)[:, :leading]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_tile_of(turned, cuts, depth)), pa.array(list(turned), pa.list_(pa.float64()))], names=["tile", "leading"]
            )

    tiles = 1 << depth
    if tiles > 1:
        bounds = [f(F.get("leading", F.lit(i))).alias(f"{n}{i}") for i in range(leading) for n, f in (("lo", F.min), ("hi", F.max))]
        low, high = np.full((tiles, leading), np.inf), np.full((tiles, leading), -np.inf)
        sizes = np.zeros(tiles, dtype=np.int64)
        placed = nodes.select("embedding").mapInArrow(place, "tile long, leading array<double>")
        for row in placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), *bounds).collect():
            sizes[row["tile"]] = row["n"]
            low[row["tile"]] = [row[f"lo{i}"] for i in range(leading)]
            high[row["tile"]] = [row[f"hi{i}"] for i in range(leading)]
        filled = np.isfinite(low[:, 0])
        near = ~_far_apart(np.nan_to_num(low), np.nan_to_num(high), threshold) & filled[:, None] & filled[None, :]
    else:
        near, sizes = np.ones((1, 1), dtype=bool), np.array([size])
    group_of = _groups(sizes, max(TILE, min(GROUP_ROWS, -(-size // GROUPS))))
    # Which groups hold a tile near each tile.
    visited = np.logical_or.reduceat(near, np.searchsorted(group_of, np.arange(group_of[-1] + 1)), axis=1)
    step = max(1, DEALT // visited.shape[1])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            rows = matrix(batch.column(0), width)
            tile = _tile_of((_unit(rows) @ axes)[:, :leading], cuts, depth)
            own = group_of[tile]
            row, other = np.nonzero(visited[tile])
            first, second = np.minimum(own[row], other), np.maximum(own[row], other)
            place, vector = pa.array(row), pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first), pa.array(second), pa.array(own[row] == second), pa.array(tile[row]),
                    batch.column(1).take(place), batch.column(2).take(place), vector.take(place),
                ],
                names=["first", "second", "last", "tile", "node", "copies", "rows"],
            )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own = group["first"].iloc[0] == group["second"].iloc[0]
        group = group.sort_values(["last", "tile", "node"], kind="stable")
        rows = np.frombuffer(b"".join(group.pop("rows")), dtype=kind).reshape(len(group), width)
        tile, border = group["tile"].to_numpy(), 0 if own else int((~group["last"]).sum())
        left, right = (rows, rows) if own else (rows[:border], rows[border:])
        sides = (tile, tile) if own else (tile[:border], tile[border:])
        found = ((x, y + border) for x, y in close_pairs(left, right, axes, threshold, sides, near))
        return _compare(group["node"].to_numpy(), group["copies"].to_numpy(), found)

    dealt = nodes.select("embedding", "node", "copies").mapInArrow(
        deal, "first long, second long, last boolean, tile long, node long, copies long, rows binary"
    )
    return dealt, compare


def _links(nodes: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, n_links, linked) between vectors of one length, several rows per node."""
    dealt, compare = _dealt(nodes, width, threshold)
    return dealt.groupBy("first", "second").applyInPandas(compare, "node long, n_links long, linked long")


def near_duplicates(table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Rows of ``table`` (vec_id, embedding, anything else) with n_links, component_id and kept.

    Two rows are linked where the cosine of their vectors, in double precision, reaches the
    threshold. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    vec_id reachable by links, ``kept`` marks the rows with that id.

    * Vectors that are null, empty, zero or hold null or non-finite components: no links, a
      component of their own. Vectors of different lengths are not compared.
    * Equal vectors are one node with a number of copies; their rows are linked with each other.
    * NULL vec_id: no links, no component, not kept, and unseen by all others.
    * Repeated rows stay and count as other rows. An empty table stays empty. Columns named like
      the new ones give way.
    """
    part = F.col("vec_id").isNotNull() & usable()
    rows = table.filter(part).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    nodes = stored(folded(rows).drop("ids"), "vectors")
    found = None
    for row in nodes.select(F.size("embedding").alias("width")).distinct().collect():
        links = _links(nodes.filter(F.size("embedding") == row["width"]), row["width"], threshold)
        found = links if found is None else found.unionByName(links)
    links, component, vector = free(table, "_links", "_component", "_vector")
    own = F.coalesce(F.col("copies"), F.lit(1)) - 1
    if found is None:
        linked = nodes.select("embedding", own.alias(links), F.col("node").alias(component))
    else:
        found = stored(found, "vector-links")
        counts = found.groupBy("node").agg(F.sum("n_links").alias("n"))
        joined = components(found.select(F.col("node").alias("a"), F.col("linked").alias("b")))
        linked = (
            nodes.join(counts, "node", "left")
            .join(joined, "node", "left")
            .select(
                "embedding",
                (own + F.coalesce("n", F.lit(0))).alias(links),
                F.coalesce("component", "node").alias(component),
            )
        )
    linked = linked.withColumnRenamed("embedding", vector)
    # A NULL key joins nothing, and each such row keeps to itself.
    kept = [F.col(f"`{c}`") for c in table.columns]
    joined = table.filter(part).join(linked, F.col("embedding") == F.col(vector), "left").select(
        *kept, links, component
    )
    alone = table.filter(~part).select(
        *kept, F.lit(0).cast("long").alias(links), F.col("vec_id").cast("long").alias(component)
    )
    both = joined.unionByName(alone)
    new = {
        "n_links": F.col(links).cast("long"),
        "component_id": F.col(component),
        "kept": F.coalesce(F.col("vec_id") == F.col(component), F.lit(False)),
    }
    return replace_columns(both, new).drop(links, component)
