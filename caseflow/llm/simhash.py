"""SimHash near-duplicates found by a self-join of a binary trie.

Fingerprints are leaves of a binary trie. Two nodes are visited together with the number of bits
in which their paths differ; a pair of nodes is given up as soon as that number exceeds the
budget. The top of the trie is walked over node counts, which yields pairs of subtrees of bounded
size; every pair of subtrees is then walked by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from collections.abc import Iterator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import free, give_back, replace_columns, ship
from caseflow.llm.graph import components, local_labels
from caseflow.session import cut_lineage

ship(__name__)

SEED = 42
BITS = 64
TOP_BITS = 16
WORDS_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 16
LINKS_AT_ONCE = 1 << 20
SMALL = 64


def _bit_counts(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the shingles, and the number of shingles."""
    counts, total = np.zeros(BITS, dtype=np.int64), 0
    if 0 < len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    for start in range(0, len(words) - shingle + 1, WORDS_AT_ONCE):
        part = words[start : start + WORDS_AT_ONCE + shingle - 1]
        rows = len(part) - shingle + 1
        texts = map(b" ".join, zip(*[part[i:] for i in range(shingle)]))
        hashes = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), dtype="<u8", count=rows)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += rows
    return counts, total


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text; 0 without words."""
    # lower() and split() of bytes know ASCII only: A-Z, and exactly space and 09-0D.
    counts, total = _bit_counts((text or "").encode().lower().split(), shingle)
    bits = (2 * counts > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, out: str = "simhash") -> DataFrame:
    """Each document with the SimHash (long) of its whole text's word shingles, repeats included."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(x.as_py(), shingle) for x in batch], pa.int64())
        batch = None
        give_back()

    return replace_columns(docs, {out: simhash(F.col("text").cast("string"))})


def _frontier(counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Nodes (depth, path) that hold at most ``most`` leaves, or lie at the depth of the counts."""
    depth = int(np.log2(len(counts)))
    levels = [counts]
    for _ in range(depth):
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    levels = levels[::-1]
    found, open_nodes = [], [(0, 0)]
    while open_nodes:
        d, path = open_nodes.pop()
        size = levels[d][path]
        if size and (size <= most or d == depth):
            found.append((d, path))
        elif size:
            open_nodes += [(d + 1, 2 * path), (d + 1, 2 * path + 1)]
    return sorted(found, key=lambda node: node[1] << (depth - node[0]))


def _subtree_pairs(nodes: list[tuple[int, int]], depth: int, budget: int) -> list[tuple[int, int]]:
    """Pairs of frontier nodes whose paths differ in at most ``budget`` bits, as far as both go.

    Both paths start at the root; a range of the frontier stands for an inner node.
    """
    starts = [path << (depth - d) for d, path in nodes]
    ends = [(path + 1) << (depth - d) for d, path in nodes]

    def split(lo: int, hi: int, level: int) -> list[tuple[int, int]]:
        middle = (starts[lo] >> (depth - level) << (depth - level)) + (1 << (depth - level - 1))
        cut = int(np.searchsorted(starts, middle, side="left"))
        return [(lo, min(cut, hi)), (max(cut, lo), hi)]

    pairs, open_pairs = [], [(0, len(nodes), 0, len(nodes), 0, 0)] if nodes else []
    while open_pairs:
        alo, ahi, blo, bhi, level, differ = open_pairs.pop()
        if ahi - alo == 1 and bhi - blo == 1:
            shared = min(nodes[alo][0], nodes[blo][0])
            a, b = nodes[alo][1] >> (nodes[alo][0] - shared), nodes[blo][1] >> (nodes[blo][0] - shared)
            if (a ^ b).bit_count() <= budget:
                pairs.append((alo, blo))
            continue

        def children(lo: int, hi: int) -> list[tuple[int, int, int | None]]:
            if hi - lo == 1 and nodes[lo][0] <= level:
                return [(lo, hi, None)]
            if hi - lo == 1:
                return [(lo, hi, starts[lo] >> (depth - level - 1) & 1)]
            return [(x, y, bit) for bit, (x, y) in enumerate(split(lo, hi, level)) if x < y]

        for i, j, one in children(alo, ahi):
            for k, m, other in children(blo, bhi):
                apart = differ + (one is not None and other is not None and one != other)
                if apart <= budget and i <= k:
                    open_pairs.append((i, j, k, m, level + 1, apart))
    return sorted(set(pairs))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where the second child of each node begins; a node is a range of the sorted keys."""
    bit = np.uint64(1 << (BITS - 1 - level))
    first = keys[lo] & ~(bit | (bit - np.uint64(1)))
    return np.clip(np.searchsorted(keys, first | bit), lo, hi)


def close_pairs(left: np.ndarray, right: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted key arrays within ``budget`` bits, walking both tries together.

    With the same array twice, each pair comes once. Open node pairs are kept on a stack of
    blocks of limited size, so memory stays bounded.
    """
    if not len(left) or not len(right):
        return
    same = left is right
    # Ranges of both sides, differing bits; -1 marks a pair of a node with itself by equal ranges.
    stack = [(0, np.array([[0, len(left), 0, len(right), 0]], dtype=np.int64))]
    while stack:
        level, block = stack.pop()
        if len(block) > PAIRS_AT_ONCE:
            half = len(block) // 2
            stack += [(level, block[:half]), (level, block[half:])]
            continue
        rows = (block[:, 1] - block[:, 0]) * (block[:, 3] - block[:, 2])
        done = (rows <= SMALL) | (level == BITS)
        ending, block = block[done], block[~done]
        for part in np.array_split(ending, max(1, int(rows[done].sum()) // PAIRS_AT_ONCE)):
            a, b = _products(part)
            keep = np.bitwise_count(left[a] ^ right[b]) <= budget
            if same:
                keep &= a < b
            if keep.any():
                yield a[keep], b[keep]
        if not len(block):
            continue
        alo, ahi, blo, bhi, differ = block.T
        amid, bmid = _middle(left, alo, ahi, level), _middle(right, blo, bhi, level)
        mirrored = same & (alo == blo) & (ahi == bhi)
        children = []
        for one, (x, y) in enumerate(((alo, amid), (amid, ahi))):
            for other, (z, w) in enumerate(((blo, bmid), (bmid, bhi))):
                apart = differ + (one != other)
                keep = (x < y) & (z < w) & (apart <= budget)
                if one > other:
                    keep &= ~mirrored
                children.append(np.stack([x, y, z, w, apart], axis=1)[keep])
        stack.append((level + 1, np.concatenate(children)))


def _products(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each row's two ranges."""
    if not len(ranges):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    alo, ahi, blo, bhi = ranges[:, :4].T
    wide = bhi - blo
    sizes = (ahi - alo) * wide
    row = np.repeat(np.arange(len(ranges)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return alo[row] + inside // wide[row], blo[row] + inside % wide[row]


def _forest(keys: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the keys as connected as all the pairs do: fewer than there are keys."""
    labels = np.arange(len(keys))
    left, right = [], []
    waiting = 0

    def joined() -> np.ndarray:
        return local_labels(len(keys), np.concatenate([np.arange(len(keys)), *left]), np.concatenate([labels, *right]))

    for a, b in pairs:
        left.append(a)
        right.append(b)
        waiting += len(a)
        if waiting > LINKS_AT_ONCE:
            labels = joined()
            left, right, waiting = [], [], 0
    labels = joined()
    moved = np.flatnonzero(labels != np.arange(len(keys)))
    return keys[moved], keys[labels[moved]]


def links(distinct: DataFrame, budget: int = 2, subtree: int = 250_000, subtrees: int = 4096) -> DataFrame:
    """Links (a, b) between fingerprints (long column ``fp``, distinct) within ``budget`` bits.

    The links are a spanning forest per pair of subtrees, so they connect exactly what all pairs
    would connect, and there are fewer than fingerprints read. A subtree holds at most ``subtree``
    fingerprints, or the ``subtrees``-th part of all where that is more. One count per 16-bit
    prefix comes to the driver.
    """
    shift = BITS - TOP_BITS
    rows = (
        distinct.groupBy(F.shiftrightunsigned("fp", shift).cast("int").alias("top"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    counts = np.zeros(1 << TOP_BITS, dtype=np.int64)
    for row in rows:
        counts[row["top"]] = row["n"]
    nodes = _frontier(counts, max(subtree, int(counts.sum()) // subtrees))
    pairs = np.array(_subtree_pairs(nodes, TOP_BITS, budget), dtype=np.int64).reshape(-1, 2)
    starts = np.array([path << (TOP_BITS - d) for d, path in nodes], dtype=np.int64)
    members = np.concatenate([pairs[:, 0], pairs[pairs[:, 0] != pairs[:, 1], 1]])
    numbers = np.concatenate([np.arange(len(pairs)), np.flatnonzero(pairs[:, 0] != pairs[:, 1])])
    sides = np.concatenate([np.zeros(len(pairs), dtype=np.int8), np.ones(len(members) - len(pairs), dtype=np.int8)])
    order = np.argsort(members, kind="stable")
    members, numbers, sides = members[order], numbers[order], sides[order]
    own = np.array([a == b for a, b in pairs], dtype=bool)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            node = np.searchsorted(starts, keys.view(np.uint64) >> np.uint64(shift), side="right") - 1
            first = np.searchsorted(members, node, side="left")
            often = np.searchsorted(members, node, side="right") - first
            row = np.repeat(np.arange(len(keys)), often)
            at = np.repeat(first, often) + np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
            yield pa.RecordBatch.from_pydict({"pair": numbers[at], "side": sides[at], "fp": keys[row]})

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["fp"].to_numpy().view(np.uint64)
        side = group["side"].to_numpy()
        left = np.sort(keys[side == 0])
        if own[int(group["pair"].iloc[0])]:
            a, b = _forest(left, close_pairs(left, left, budget))
        else:
            right = np.sort(keys[side == 1])
            both = np.concatenate([left, right])
            found = ((x, y + len(left)) for x, y in close_pairs(left, right, budget))
            a, b = _forest(both, found)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "pair long, side byte, fp long")
    return dealt.groupBy("pair").applyInPandas(walk, "a long, b long")


def _grouped(docs: DataFrame, budget: int, shingle: int) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) per row; ``mark`` is a hash of the text."""
    work = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    prints = cut_lineage(fingerprints(work, shingle, "fp").select("doc_id", "mark", "fp"))
    rows = prints.count()
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), rows)
    joined = components(links(nodes, budget), rows)
    placed = nodes.join(joined, nodes["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, simhash, component_id) per row of ``docs`` (doc_id, text, anything else).

    Fingerprints within ``budget`` bits are linked; ``component_id`` is the smallest doc_id
    reachable over links, the row's own included. Rows of equal fingerprint are one node, so
    a group of copies of any size costs one leaf of the trie.

    * NULL or empty text, or text without words: fingerprint 0, linked like any other.
    * Fewer words than a shingle: the whole sequence is the only shingle.
    * Repeated rows stay and get equal results. Rows of a NULL doc_id get the component of their
      fingerprint, NULL where no row around has an id.
    * An empty table gives an empty result; other columns are ignored.
    """
    found = _grouped(docs, budget, shingle)
    return found.select("doc_id", F.col("fp").alias("simhash"), "component_id")


def keep_one(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns.

    The row of the smallest doc_id stays (NULL ids last, then the smaller hash of the text); of
    repeated rows one stays. NULL and empty texts, and texts without words, are one component.
    Texts of any length count whole. An empty table stays empty. Other columns keep their values, whatever
    their names.
    """
    of, kept, mark, nth = free(docs, "_id", "_kept", "_mark", "_nth")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    chosen = (
        _grouped(docs, budget, shingle)
        .groupBy("root")
        .agg(F.min(order).alias("_row"))
        .select(F.col("_row.doc_id").alias(of), F.col("_row.mark").alias(kept))
        .distinct()
    )
    marked = docs.withColumn(mark, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(chosen[of]) & (marked[mark] == chosen[kept])
    once = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(mark))
    return marked.join(chosen, same, "left_semi").withColumn(nth, once).filter(F.col(nth) == 1).drop(mark, nth)
