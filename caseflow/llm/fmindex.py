"""Benchmark passages in documents, found by backward search in an FM-index per training shard.

``build`` deals the words of all documents into shards of bounded size and gives one row per shard: the
Burrows-Wheeler transform of its words as a wavelet matrix, sampled suffix positions, and where its
documents lie. ``search`` looks test phrases up in any such index, in blocks of bounded size, and merges
the spans of words to remove. The index knows nothing of the phrases and can be searched again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import ship, stored

ship(__name__)

WINDOW = 10
#: Words of a shard. Longer documents go on in the next shard.
SHARD_WORDS = 1 << 20
#: Words of a segment: copies are told apart after no more than these.
SEGMENT_WORDS = 512
#: Every such suffix position is kept.
SAMPLE = 16
#: Bytes of phrases that are searched at a time (and broadcast).
BLOCK_BYTES = 32 << 20
_CHUNK = 1 << 20

# What belongs to a word (after A-Z are lower-cased), as a class and byte by byte.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
_BYTES = bytes(b if b >= 0x80 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SPACE = re.compile(rb" ")


def pieces(text: bytes, step: int, overlap: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(place of the first word, words, words of its own) of pieces of a text: ``step`` words each, and
    the first ``overlap`` words of the next one. An empty text is one empty piece."""
    flat = text.translate(_BYTES)
    words, offset, at = [], 0, 0
    while at < len(flat):
        gap = _SPACE.search(flat, at + _CHUNK)
        stop = gap.start() if gap else len(flat)
        words += flat[at:stop].split()
        at = stop
        while len(words) > step + overlap:
            yield offset, words[: step + overlap], step
            words, offset = words[step:], offset + step
    yield offset, words, len(words)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Symbol 0 ends a segment; each end counts as different, the
    earlier as the smaller, and the last symbol is an end."""
    n, ends = len(symbols), np.flatnonzero(symbols == 0)
    first = symbols.astype(np.int64) + (len(ends) - 1)
    first[ends] = np.arange(len(ends))
    bits = max(1, int(first.max()).bit_length())
    width = max(1, min(8, 62 // bits))
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        key <<= bits
        key[: max(0, n - j)] |= first[j:]
    order = np.argsort(key)
    key = key[order]
    slots, rank = np.arange(n), np.empty(n, dtype=np.int64)
    while True:
        new = np.ones(len(slots), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        # Alone in its group: the place is final.
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return order
        at = order[slots]
        # Equal so far means no end so far, so there is a symbol at this distance.
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        width *= 2


class Bits:
    """Rows of bits with the number of ones before any place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.ones = np.zeros(words.shape, dtype=np.int64)
        np.cumsum(np.bitwise_count(words[:, :-1]), axis=1, out=self.ones[:, 1:])

    @staticmethod
    def packed(rows: Iterator[np.ndarray], n: int) -> np.ndarray:
        # One word more than needed, so that the place behind the last bit exists.
        width = n // 64 + 2
        made = []
        for bits in rows:
            line = np.zeros(width * 8, dtype=np.uint8)
            line[: (n + 7) // 8] = np.packbits(bits, bitorder="little")
            made.append(line.view("<u8"))
        return np.stack(made)

    def get(self, row: int, at: np.ndarray) -> np.ndarray:
        return ((self.words[row, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, row: int, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[row, at >> 6] + np.bitwise_count(self.words[row, at >> 6] & below)


class FmIndex:
    """Searches one shard. Made from the parts that ``parts`` gives and a table row keeps."""

    def __init__(self, n: int, wavelet: bytes, zeros: bytes, before: bytes, marks: bytes, samples: bytes):
        self.n = n
        self.zeros = np.frombuffer(zeros, dtype="<i8")
        self.levels = len(self.zeros)
        self.bits = Bits(np.frombuffer(wavelet, dtype="<u8").reshape(self.levels, -1))
        self.before = np.frombuffer(before, dtype="<i8")
        self.marks = Bits(np.frombuffer(marks, dtype="<u8").reshape(1, -1))
        self.samples = np.frombuffer(samples, dtype="<i4")
        symbols = np.arange(len(self.before) - 1)
        self.start = self._descend(symbols, np.zeros(len(symbols), dtype=np.int64))

    @staticmethod
    def parts(symbols: np.ndarray, kept: np.ndarray) -> tuple[bytes, ...]:
        """Wavelet matrix of the transform, zeros per level, symbols before each, marks and positions of
        the ``kept`` suffixes."""
        n, order = len(symbols), suffix_order(symbols)
        top = int(symbols.max())
        levels, zeros = max(1, top.bit_length()), []

        def split() -> Iterator[np.ndarray]:
            line = symbols[order - 1]
            for level in reversed(range(levels)):
                ones = ((line >> level) & 1).astype(bool)
                zeros.append(n - int(ones.sum()))
                yield ones
                line = np.concatenate([line[~ones], line[ones]])

        wavelet = Bits.packed(split(), n)
        before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        marked = kept[order]
        return (
            wavelet.tobytes(), np.array(zeros, dtype="<i8").tobytes(), before.astype("<i8").tobytes(),
            Bits.packed(iter([marked]), n).tobytes(), order[marked].astype("<i4").tobytes(),
        )

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self.bits.rank(level, at)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before ``at`` whose suffix has this symbol before it, placed among all suffixes."""
        return self.before[symbol] + self._descend(symbol, at) - self.start[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        symbol, at = np.zeros(len(row), dtype=np.int64), row
        for level in range(self.levels):
            bit, ones = self.bits.get(level, at), self.bits.rank(level, at)
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return self.before[symbol] + at - self.start[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row behind the last) of the phrases (one line of symbols each) that occur."""
        left = np.arange(len(phrases))
        low, high = np.zeros(len(left), dtype=np.int64), np.full(len(left), self.n, dtype=np.int64)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[left, column]
            low, high = self.step(symbol, low), self.step(symbol, high)
            found = low < high
            left, low, high = left[found], low[found], high[found]
        return left, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: back to a kept position, and as many steps on."""
        place, open_, steps = np.empty(len(row), dtype=np.int64), np.arange(len(row)), 0
        while len(open_):
            known = self.marks.get(0, row)
            place[open_[known]] = self.samples[self.marks.rank(0, row[known])] + steps
            open_, row = open_[~known], self.back(row[~known])
            steps += 1
        return place


class _Numbers(dict):
    """Words by number, from 1 in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


INDEX = (
    "shard long, n long, words binary, wavelet binary, zeros binary, before binary, marks binary, samples binary, "
    "segment_at binary, segment_doc binary, segment_word binary, row array<long>, doc_id array<string>, "
    "digest array<string>, own array<long>, offset array<long>"
)
_INDEX_TYPES = [
    pa.int64(), pa.int64(), *[pa.binary()] * 9, pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()),
    pa.list_(pa.int64()), pa.list_(pa.int64()),
]
_INDEX_NAMES = [part.split()[0] for part in INDEX.split(", ")]


class _Shard:
    """Words of documents on their way into an index."""

    def __init__(self):
        self.numbers, self.parts, self.segments, self.docs, self.size, self.held = _Numbers(), [], [], [], 0, 0

    def add(self, row: int, doc_id: str | None, digest: str, offset: int, words: list[bytes], own: int, window: int):
        symbols = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words))
        for at in range(0, max(1, len(words) - window + 1) if words else 0, SEGMENT_WORDS):
            part = symbols[at : at + SEGMENT_WORDS + window - 1]
            self.segments.append((self.held, len(self.docs), at))
            self.parts += [part, np.zeros(1, dtype=np.int32)]
            self.held += len(part) + 1
        self.docs.append((row, doc_id, digest, own, offset))
        self.size += len(words) + 1

    def batch(self, shard: int) -> pa.RecordBatch:
        symbols = np.concatenate(self.parts) if self.parts else np.zeros(1, dtype=np.int32)
        at, doc, word = (np.array(c, dtype="<i4") for c in (zip(*self.segments) if self.segments else ([0], [0], [0])))
        place = np.arange(len(symbols)) - np.repeat(at, np.diff(np.append(at, len(symbols))))
        index = FmIndex.parts(symbols, place % SAMPLE == 0)
        docs = [list(c) for c in zip(*self.docs)]
        values = [
            shard, len(symbols), b" ".join(self.numbers), *index, at.tobytes(), doc.tobytes(), word.tobytes(), *docs,
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _INDEX_TYPES)], names=_INDEX_NAMES)


def build(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One FM-index per shard of ``docs`` (doc_id, text, anything else), see ``INDEX``.

    Phrases of up to ``window`` words are found by it. Store the table: its numbers of rows and
    shards are those of one run.

    * NULL and empty texts are documents without words. Every row has a number of its own, so repeated
      rows, repeated and NULL doc_id stay apart. An empty table has no shards.
    * A text of any length is cut into pieces that overlap by ``window`` - 1 words; the words of one shard are
      held at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        shard, made, seen = _Shard(), 0, 0
        for batch in batches:
            for doc_id, text, digest in zip(*batch.columns):
                for offset, words, own in pieces(text.as_py(), shard_words, window - 1):
                    if shard.docs and shard.size + len(words) > shard_words + window:
                        yield shard.batch(first + made)
                        shard, made = _Shard(), made + 1
                    shard.add(first + seen, doc_id.as_py(), digest.as_py(), offset, words, own, window)
                seen += 1
        if shard.docs:
            yield shard.batch(first + made)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), F.md5(text).alias("digest"))
    return rows.mapInArrow(run, INDEX)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, item_id): the different runs of ``window`` words of every item; the whole of a shorter one.

    Items without words have none; an item without id has phrases without one.
    """
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0))
    run = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))),
        lambda i: F.array_join(F.slice("w", i, F.lit(window)), " "),
    )
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("w"))
    return items.filter(F.size("w") > 0).select("item_id", F.explode(run).alias("phrase")).distinct()


class Phrases:
    """A block of phrases as numbers: words, phrases by length, and the items of each phrase."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        pairs = sorted(pairs, key=lambda p: (p[0], p[1] is not None, p[1] or ""))
        phrases = list(dict.fromkeys(p for p, _ in pairs))
        number = {p: i for i, p in enumerate(phrases)}
        words = _Numbers()
        lines = [np.array([words[w] - 1 for w in p.split(b" ")], dtype=np.int32) for p in phrases]
        self.words = list(words)
        self.items = sorted({item for _, item in pairs if item is not None})
        item_number = {item: i for i, item in enumerate(self.items)}
        known = [(number[p], item_number[item]) for p, item in pairs if item is not None]
        self.item_of = np.array([i for _, i in known], dtype=np.int64)
        self.item_from = np.searchsorted(np.array([p for p, _ in known], dtype=np.int64), np.arange(len(phrases) + 1))
        self.by_length = {}
        for length in sorted({len(line) for line in lines}):
            own = [i for i, line in enumerate(lines) if len(line) == length]
            self.by_length[length] = (np.array(own), np.stack([lines[i] for i in own]))


FOUND = (
    "row long, doc_id string, digest string, own long, "
    "spans array<struct<start:long,stop:long>>, items array<string>"
)
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[new].tolist(), reach[np.append(new[1:], len(reach)) - 1].tolist()))


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) for every value from low to high of each pair."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which]


def _occurrences(shard: dict, phrases: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece of a document, first word, word behind, phrase) of every occurrence in a shard."""
    index = FmIndex(*[shard[k] for k in ("n", "wavelet", "zeros", "before", "marks", "samples")])
    numbers = {w: i + 1 for i, w in enumerate(shard["words"].split(b" "))} if shard["words"] else {}
    symbol = np.array([numbers.get(w, 0) for w in phrases["words"]], dtype=np.int64)
    at, doc, word = (np.frombuffer(shard[f"segment_{k}"], dtype="<i4") for k in ("at", "doc", "word"))
    found = [(np.zeros(0, dtype=np.int64),) * 4]
    for length, (own, lines) in phrases["by_length"].items():
        coded = symbol[lines]
        here = np.flatnonzero((coded > 0).all(axis=1))
        left, low, high = index.search(coded[here])
        which, rows = _expand(low, high)
        place = index.locate(rows)
        segment = np.searchsorted(at, place, side="right") - 1
        start = word[segment] + place - at[segment]
        found.append((doc[segment].astype(np.int64), start, start + length, own[here[left[which]]]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _results(shard: dict, phrases: dict, count: bool) -> list[tuple]:
    """Rows of ``FOUND`` of a shard."""
    doc, start, stop, phrase = _occurrences(shard, phrases)
    base = np.array(shard["offset"], dtype=np.int64)
    start, stop = start + base[doc], stop + base[doc]
    # Items by document, each pair once.
    width = len(phrases["item_from"])
    pairs = np.unique(doc * width + phrase)
    which, at = _expand(phrases["item_from"][pairs % width], phrases["item_from"][pairs % width + 1])
    total = max(1, len(phrases["items"]))
    items = np.unique((pairs // width)[which] * total + phrases["item_of"][at])
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(len(base) + 1))
    item_cuts = np.searchsorted(items // total, np.arange(len(base) + 1))
    names, rows = phrases["items"], []
    for i, (row, doc_id, digest, own) in enumerate(zip(*[shard[k] for k in ("row", "doc_id", "digest", "own")])):
        mine = order[cuts[i] : cuts[i + 1]]
        if count or len(mine):
            listed = [names[j] for j in (items[item_cuts[i] : item_cuts[i + 1]] % total).tolist()]
            rows.append((row, doc_id, digest, own if count else 0, _spans(start[mine], stop[mine]), listed))
    return rows


def _search_block(index: DataFrame, phrases: Phrases, count: bool) -> DataFrame:
    # Plain values only: a broadcast does not carry the class with it.
    shared = index.sparkSession.sparkContext.broadcast(vars(phrases))
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(_SPAN), pa.list_(pa.string())]
    names = [part.split()[0] for part in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                columns = list(zip(*_results(shard, shared.value, count))) or [()] * len(types)
                columns[4] = [[{"start": a, "stop": b} for a, b in spans] for spans in columns[4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return index.mapInArrow(run, FOUND)


def search(index: DataFrame, phrases: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, digest, n_words, spans, items) per document of a stored ``index``; ``phrases`` as
    ``windows`` gives them. ``spans`` are the merged spans of words to remove, ``items`` the items found.

    Phrases are searched in blocks of about ``block_bytes``, each against all shards, so no more than
    that is ever broadcast. doc_id is text here. Without phrases nothing is found.
    """
    phrases = stored(phrases, "phrases")
    size = F.octet_length("phrase") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 16
    total = phrases.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    found = None
    for block in range(blocks):
        mine = phrases.filter(F.pmod(F.xxhash64("phrase", "item_id"), F.lit(blocks)) == block)
        pairs = [(r["phrase"].encode(), r["item_id"]) for r in mine.toLocalIterator()]
        part = _search_block(index, Phrases(pairs), count=block == 0)
        found = part if found is None else found.union(part)
    spans = F.flatten(F.collect_list("spans"))
    merged = found.groupBy("row", "doc_id", "digest").agg(
        F.sum("own").alias("n_words"), spans.alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )

    @F.arrow_udf("array<struct<start:long,stop:long>>")
    def merge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for starts, stops in batches:
            made = [_spans(*(np.array(x.as_py(), dtype=np.int64) for x in pair)) for pair in zip(starts, stops)]
            yield pa.array([[{"start": a, "stop": b} for a, b in spans] for spans in made], pa.list_(_SPAN))

    return merged.select("row", "doc_id", "digest", "n_words", merge("all.start", "all.stop").alias("spans"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``search`` of all items of ``benchmark`` (item_id, text, anything else) in all ``docs`` (doc_id, text,
    anything else): one row per row of ``docs``.

    NULL texts have no words on either side; repeated items count once; other columns take no part.
    """
    return search(stored(build(docs, window), "fm-index"), windows(benchmark, window))


def removed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the spans of ``found`` (of the same documents): from the first byte of a span's first word
    to the last byte of its last. All columns stay as they are; a NULL text stays NULL.

    Equal texts have equal spans, so the texts' digests connect the two.
    """
    hit = found.filter(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    joined = docs.select(F.md5(F.col("text").cast("string").cast("binary")).alias("digest"), row).join(hit, "digest", "left")

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, starts, stops in batches:
            yield pa.array([_cut(*(x.as_py() for x in parts)) for parts in zip(texts, starts, stops)], pa.string())

    text = F.when(F.col("spans").isNull(), F.col("kept.text")).otherwise(
        cut(F.col("kept.text").cast("binary"), F.col("spans.start"), F.col("spans.stop"))
    )
    columns = [text.alias(c) if c.lower() == "text" else F.col(f"kept.`{c}`") for c in docs.columns]
    return joined.select(*columns)


def _cut(text: bytes | None, starts: list[int] | None, stops: list[int] | None) -> str | None:
    if text is None or not starts:
        return None if text is None else text.decode()
    inside = np.frombuffer(text.translate(_BYTES), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, behind = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep, at = [], 0
    for start, stop in zip(starts, stops):
        keep.append(text[at : first[start]])
        at = behind[stop - 1]
    return b"".join([*keep, text[at:]]).decode()
