"""Phrases whose words belong together, from exact counts of all frequent runs of words.

The first pass gives every block of text one summary per hash partition of its runs of one to five
words. Summaries of a partition are merged as Misra and Gries do it: with more counters than the
partition's mass divided by the threshold, no frequent run can be lost. The second pass counts the
survivors exactly, by their words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import ship, stored

ship(__name__)

LEAST = 100
LONGEST = 5
#: Counters of a partition: this many times its mass divided by the threshold.
SLACK = 4
#: Words of a block.
BLOCK_WORDS = 1 << 19
#: Bytes of text per hash partition, and the most partitions.
PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 1 << 15
#: Survivors that are counted (and broadcast) at a time.
ROUND = 4 << 20
#: Words that keep their numbers from block to block.
KNOWN_WORDS = 1 << 17
#: Phrases that a task adds up before it gives them out.
HELD = 1 << 18
#: Phrases that are added up by one task.
PART_PHRASES = 1 << 14
#: Parts of a language that meet its total separately.
SLICES = 64
_CHUNK, _FILTER = 1 << 20, 1 << 25

# What ends a piece, and what lies between words.
ENDS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_BYTES = bytes(10 if b in ENDS else 32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[ \n]")
# Odd multipliers for mixing bits.
_MIX, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """Numbers of words, their hashes, and the words again."""

    def __init__(self):
        self.number, self.names, self.hashes = {}, [], np.zeros(0, dtype=np.uint64)

    def numbers(self, words: list[bytes]) -> list[int]:
        get, names, out = self.number.get, self.names, []
        for word in words:
            n = get(word)
            if n is None:
                n = self.number[word] = len(names)
                names.append(word)
            out.append(n)
        return out

    def hashed(self) -> np.ndarray:
        new = [xxhash.xxh64_intdigest(w) for w in self.names[len(self.hashes) :]]
        self.hashes = np.append(self.hashes, np.array(new, dtype=np.uint64))
        return self.hashes


class Block:
    """Numbers of words with -1 behind every piece, the language of each place, and how many places at the
    beginning only continue the block before."""

    def __init__(self, words: Words, ids: list[int], langs: list[int], names: list[str], context: int):
        self.words, self.names, self.context = words, names, context
        self.ids, self.langs = np.array(ids, dtype=np.int32), np.array(langs, dtype=np.int32)
        place = np.arange(len(self.ids))
        ends = np.maximum.accumulate(np.where(self.ids < 0, place, -1))
        # Words from the last end up to each place.
        self.run = place - ends
        self._hash = None

    def starts(self, length: int) -> np.ndarray:
        """Where the runs of a length begin that this block has to count."""
        stop = np.flatnonzero(self.run >= length)
        return stop[stop >= self.context] - (length - 1)

    def hashes(self, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the runs of a length; ask for the lengths from 1 upwards."""
        own = self.words.hashed()
        if length == 1:
            seeds = np.array([xxhash.xxh64_intdigest(n.encode(), 1) for n in self.names], dtype=np.uint64)
            self._hash = (own[self.ids] ^ seeds[self.langs]) * _MIX
        else:
            n = len(self.ids) - length + 1
            longer = (self._hash[:n] ^ (self._hash[:n] >> np.uint64(29))) * _NEXT + own[self.ids[length - 1 :]]
            self._hash = longer * _MIX
        at = self.starts(length)
        value = self._hash[at]
        return at, (value ^ (value >> np.uint64(31))) * _MIX >> np.uint64(64 - bits)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    """Blocks of about ``size`` words from (lang, text) rows. A long text goes on in the next block, which
    begins with its last words."""
    words, ids, langs, names, context = Words(), [], [], {}, 0
    for batch in batches:
        for lang, text in zip(*batch.columns):
            name, flat, at = lang.as_py(), text.as_py().translate(_BYTES), 0
            while at < len(flat):
                gap = _GAP.search(flat, at + _CHUNK)
                stop = gap.start() if gap else len(flat)
                before = len(ids)
                for i, piece in enumerate(flat[at:stop].split(b"\n")):
                    if i:
                        ids.append(-1)
                    ids += words.numbers(piece.split())
                langs += [names.setdefault(name, len(names))] * (len(ids) - before)
                at = stop
                if len(ids) >= size:
                    if words.names:
                        yield Block(words, ids, langs, list(names), context)
                    # What the next words of this piece continue.
                    tail = [] if at == len(flat) else ids[-(LONGEST - 1) :]
                    while -1 in tail:
                        tail = tail[tail.index(-1) + 1 :]
                    if len(words.names) > KNOWN_WORDS:
                        kept = [words.names[i] for i in tail]
                        words = Words()
                        tail = words.numbers(kept)
                    names = {name: 0}
                    ids, langs, context = list(tail), [0] * len(tail), len(tail)
            ids.append(-1)
            langs.append(names.setdefault(name, len(names)))
    # Without any word there are ends only.
    if words.names:
        yield Block(words, ids, langs, list(names), context)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, as many as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    values = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    values[:, :width] = planes.T
    return values.view("<u8").ravel()


class Summary:
    """Misra-Gries summary of hashes. ``lost`` is the most that any count can be too small."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.hashes, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def merge(self, hashes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Add other summaries; beyond the capacity the largest count that finds no place is taken from all."""
        every, total = np.concatenate([self.hashes, *hashes]), np.concatenate([self.counts, *counts])
        if not len(every):
            return
        order = np.argsort(every)
        every, total = every[order], total[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        self.hashes, self.counts = every[first], np.add.reduceat(total, first)
        if len(self.counts) > self.capacity:
            beyond = len(self.counts) - self.capacity - 1
            taken = int(np.partition(self.counts, beyond)[beyond])
            kept = self.counts > taken
            self.hashes, self.counts, self.lost = self.hashes[kept], self.counts[kept] - taken, self.lost + taken

    def survivors(self, least: int) -> np.ndarray:
        return self.hashes[self.counts + self.lost >= least]


def _text_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))


def _borders(partitions: int, bits: int) -> np.ndarray:
    """First hash of each partition but the first."""
    return np.array([(p << bits) // partitions for p in range(1, partitions)], dtype=np.uint64)


SUMMARIES = "part int, kind int, mass long, hashes binary, counts binary"


def summaries(rows: DataFrame, partitions: int, bits: int, longest: int) -> DataFrame:
    """Per block and hash partition: a row with the mass (kind 0), and one with the counts (kind 1)."""
    names = [part.split()[0] for part in SUMMARIES.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = _borders(partitions, bits)
        for block in blocks(batches, BLOCK_WORDS):
            found = np.concatenate([block.hashes(k, bits)[1] for k in range(1, longest + 1)])
            hashes, counts = np.unique(found, return_counts=True)
            cuts = np.concatenate([[0], np.searchsorted(hashes, borders), [len(hashes)]])
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                h, c = hashes[cuts[p] : cuts[p + 1]], counts[cuts[p] : cuts[p + 1]]
                out.append((p, 0, int(c.sum()), None, None))
                out.append((p, 1, 0, _packed(np.diff(h, prepend=np.uint64(0))), _packed(c)))
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, SUMMARIES)


def survivors(found: DataFrame, least: int, partitions: int) -> DataFrame:
    """Hashes that may belong to a run with ``least`` occurrences: all that do, and a few others.

    The summaries of a hash partition stream through a task of their own in order, the masses first; what is
    held is a few times the capacity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary, waiting, held = None, 0, None, ([], []), 0

        def done() -> pa.RecordBatch:
            if summary is not None:
                summary.merge(*waiting)
            left = summary.survivors(least) if summary is not None else np.zeros(0, dtype=np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(left.astype(np.int64))], names=["hash"])

        for batch in batches:
            for row in zip(*batch.columns):
                p, kind, of_row, hashes, counts = (x.as_py() for x in row)
                if p != part:
                    if part is not None:
                        yield done()
                    part, mass, summary, waiting, held = p, 0, None, ([], []), 0
                if kind == 0:
                    mass += of_row
                    continue
                if summary is None:
                    summary = Summary(SLACK * mass // least + 1)
                waiting[0].append(np.cumsum(_unpacked(hashes), dtype=np.uint64))
                waiting[1].append(_unpacked(counts).astype(np.int64))
                held += len(waiting[1][-1])
                if held > 2 * summary.capacity + BLOCK_WORDS:
                    summary.merge(*waiting)
                    waiting, held = ([], []), 0
        if part is not None:
            yield done()

    return found.repartitionById(partitions, "part").sortWithinPartitions("part", "kind").mapInArrow(run, "hash long")


def _count(block: Block, wanted: np.ndarray, near: np.ndarray, bits: int, longest: int, into: dict) -> None:
    """Add the runs of a block whose hash is wanted to the phrases of their language."""
    names = block.words.names
    mine = [into.setdefault(name, Counter()) for name in block.names]
    for length in range(1, longest + 1):
        at, value = block.hashes(length, bits)
        likely = near[value & np.uint64(len(near) - 1)]
        at, value = at[likely], value[likely]
        place = np.searchsorted(wanted, value)
        hit = wanted[np.minimum(place, len(wanted) - 1)] == value
        order = np.flatnonzero(hit)[np.argsort(value[hit], kind="stable")]
        at, value = at[order], value[order]
        if not len(at):
            continue
        new = np.append(True, value[1:] != value[:-1])
        group, head = np.cumsum(new) - 1, at[new]
        # Equal hashes are taken for equal runs only where language and words are equal.
        same = block.langs[at] == block.langs[head[group]]
        for j in range(length):
            same &= block.ids[at + j] == block.ids[head[group] + j]
        number = np.bincount(group[same], minlength=len(head))
        starts, often = np.concatenate([head, at[~same]]), np.append(number, np.ones(int((~same).sum()), dtype=np.int64))
        runs = block.ids[starts[:, None] + np.arange(length)].tolist()
        for lang, run, n in zip(block.langs[starts].tolist(), runs, often.tolist()):
            mine[lang][b" ".join([names[i] for i in run])] += n


TABLES = "part int, lang string, phrases binary, counts binary"
COUNTS = "lang string, words int, phrase string, n long"


def _tables(rows: DataFrame, wanted: np.ndarray, parts: int, bits: int, longest: int, totals: bool) -> DataFrame:
    """What the tasks count, as tables of phrases and numbers: one per part of the phrases and language."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    names = [part.split()[0] for part in TABLES.split(", ")]
    types = [pa.int32(), pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        # Most hashes are ruled out by a look into a table that fits into the cache better.
        near = np.zeros(min(_FILTER, 1 << max(10, (8 * len(wanted)).bit_length())), dtype=bool)
        near[wanted & np.uint64(len(near) - 1)] = True

        def batch(found: dict) -> pa.RecordBatch:
            dealt: dict[tuple, list] = {}
            for lang, phrases in found.items():
                for phrase in phrases:
                    dealt.setdefault((zlib.crc32(phrase) % parts, lang), []).append(phrase)
            out = [
                (part, lang, b"\n".join(mine), _packed(np.array([found[lang][p] for p in mine])))
                for (part, lang), mine in dealt.items()
            ]
            columns = list(zip(*out)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        found: dict[str, Counter] = {}
        for block in blocks(batches, BLOCK_WORDS):
            if totals:
                number = np.bincount(block.langs[block.starts(1)], minlength=len(block.names)).tolist()
                for name, n in zip(block.names, number):
                    found.setdefault(name, Counter())[b""] += n
            if len(wanted):
                _count(block, wanted, near, bits, longest, found)
            if sum(map(len, found.values())) > HELD:
                yield batch(found)
                found = {}
        yield batch(found)

    return rows.mapInArrow(run, TABLES)


def _summed(tables: DataFrame, parts: int) -> DataFrame:
    """The tables of each part added up; a task holds the phrases of one part. See ``COUNTS``."""
    names = [part.split()[0] for part in COUNTS.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, Counter()

        def done() -> pa.RecordBatch:
            out = [(lang, p.count(b" ") + 1 if p else 0, p.decode(), n) for (lang, p), n in held.items()]
            columns = list(zip(*out)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for row in zip(*batch.columns):
                part, lang, phrases, counts = (x.as_py() for x in row)
                if part != current:
                    yield done()
                    current, held = part, Counter()
                for phrase, n in zip(phrases.split(b"\n"), _unpacked(counts).tolist()):
                    held[lang, phrase] += n
        yield done()

    return tables.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, COUNTS)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, round_size: int = ROUND) -> DataFrame:
    """(lang, words, phrase, n): every run of up to ``longest`` words inside a piece with at least
    ``least`` occurrences, exactly counted per language; and per language a row of no words with the number
    of all word occurrences.

    * ``docs`` have lang, text and anything else. NULL text: empty; NULL lang: ``und``.
    * Repeated rows count as often as they come. An empty table gives an empty result.
    * Texts of any length are cut into blocks; no run across a cut is lost or counted twice.
    """
    rows = _text_rows(docs)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    partitions = min(MOST_PARTITIONS, max(1, math.ceil(size / PARTITION_BYTES)))
    # Wide enough that few of the different runs share a hash.
    bits = min(60, max(40, math.ceil(math.log2(size + 1)) + 12))
    left = stored(survivors(summaries(rows, partitions, bits, longest), least, partitions), "survivors")
    rounds = max(1, math.ceil(left.count() / round_size))
    counted = None
    for number in range(rounds):
        low, high = (number << bits) // rounds, ((number + 1) << bits) // rounds
        mine = left.filter((F.col("hash") >= low) & (F.col("hash") < high))
        wanted = np.sort(mine.toArrow()["hash"].to_numpy()).astype(np.uint64)
        parts = max(1, math.ceil(len(wanted) / PART_PHRASES))
        part = _summed(_tables(rows, wanted, parts, bits, longest, totals=number == 0), parts)
        counted = part if counted is None else counted.union(part)
    return counted.filter(((F.col("words") == 0) & (F.col("n") > 0)) | (F.col("n") >= least))


def _part(first, number) -> F.Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, number), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two and more words in stored ``counts`` (of
    ``frequent``). The cut with the lowest score counts, ties go to the smallest first part.

    Scores are quotients of whole numbers of up to 38 digits, rounded down.
    """
    wide = "decimal(38,0)"
    # Every slice of a language gets the total, so that a common language is no hot key.
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("total"), slices.alias("slice"))
    parts = counts.filter("words > 0").select("lang", "phrase", "n")
    cut = counts.filter("words > 1").select(
        "lang", "phrase", F.col("n").alias("a"), "words", F.pmod(F.hash("phrase"), F.lit(SLICES)).alias("slice"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    )
    cut = cut.withColumn("first", _part(F.lit(1), F.col("k"))).withColumn("rest", _part(F.col("k") + 1, F.col("words") - F.col("k")))
    first = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    joined = cut.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, ["lang", "slice"])
    ratio = F.expr(
        f"(cast(1000 as {wide}) * cast(a as {wide}) * cast(total as {wide})) div (cast(l as {wide}) * cast(r as {wide}))"
    )
    best = joined.withColumn("score", ratio).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("total").alias("n")
    )
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def _covered(counts: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of the phrases that a longer one holds ``share`` per cent of.

    What a phrase two words longer holds, the one between them holds as well, so one word is enough.
    """
    longer = counts.filter("words > 2").select(
        "lang", F.col("n").alias("held"),
        F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words") - 1))).alias("phrase"),
    )
    most = longer.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    own = counts.filter("words > 1").select("lang", "phrase", "n")
    return most.join(own, ["lang", "phrase"]).filter(F.col("held") * 100 >= F.col("n") * share).select("lang", "phrase")


def _ranked(kept: DataFrame, top: int | None) -> DataFrame:
    """``rank`` within each language. Rows are dealt by ranges of the order, so that a language is spread over
    many tasks; ranks go on from one range to the next."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    placed = stored(kept.repartitionByRange("lang", *order).withColumn("range", F.spark_partition_id()), "phrase-ranges")
    sizes = placed.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("lang", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    if top is not None:
        before = before.filter(F.col("before") < top)
    nth = F.row_number().over(Window.partitionBy("lang", "range").orderBy(*order))
    ranked = placed.withColumn("nth", nth).join(before, ["lang", "range"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = 100, top: int | None = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language of ``docs`` (lang, text, anything
    else), best first; ``top`` of each language, or all.

    a, l and r are the occurrences of the phrase, of its first and of its second part, n those of all words;
    the score is 1000 a n / (l r), rounded down, at the cut where it is lowest. Phrases that a longer one
    holds ``share`` per cent of are left out. Equal scores go by a, then by the bytes of the phrase.

    * NULL text: empty; NULL lang: ``und``; repeated rows count as often as they come.
    * An empty table, or one without frequent phrases, gives an empty result.
    """
    counts = stored(frequent(docs, least, longest), "phrase-counts")
    kept = scored(counts).join(_covered(counts, share), ["lang", "phrase"], "left_anti")
    return _ranked(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
