"""Hierarchical packing of token sequences into windows of several lengths.

A document goes to the shortest context-size tier that holds it; whole windows of the longest tier
are cut off longer documents first. Each tier is packed from the longest to the shortest: the
longest waiting part opens a window of its tier, its gap is filled with the longest parts of
shorter tiers that fit, and the rest of the gap, for which no part is short enough, is closed
by cutting the shortest one. Windows of a block are then dealt to step groups of equal
token counts.

Every task packs its own rows block by block, so nothing is shuffled; only the last window of
a task can be padded.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from caseflow.llm.common import give_back, ship, worker_cache

ship(__name__)

TIERS = (128, 256, 512, 1024, 2048)
CACHED_WORDS = 200_000
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, window long, step_group long"
)

# Fixed value: the split pattern of the word-end vocabulary.
_WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern for lower-case texts of U+0021-7E and U+00A1-FF only.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_PLAIN = re.compile(r"[!-~¡-ÿ]+")
# All bytes of a Latin-1 text of such words and white space of ASCII.
_PLAIN_BYTES = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin1").translate(None, _PLAIN_BYTES)
    except UnicodeEncodeError:
        return False


def _latin_pieces(word: str) -> list[str]:
    """``_LATIN.findall`` of a lower-case word; most are letters, or letters and one mark."""
    if word.isalpha():
        return [word]
    return [word[:-1], word[-1]] if word[:-1].isalpha() else _LATIN.findall(word)


class Recent:
    """The values of the last ``size`` different keys, and of at most as many before them."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers.

    A vocabulary that drops white space and lower-cases is applied word by word, each different
    word once as long as the cache holds it, which a frequent word never leaves; the result is that
    of the library. Any other vocabulary is applied by the library to the whole text.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": _WORD_ENDS}
        )
        model = spec["model"]
        # Without the library's own cache, which costs more than a short piece does.
        self.model = BPE(
            vocab=model["vocab"],
            merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
            end_of_word_suffix=model["end_of_word_suffix"],
            cache_capacity=0,
        ) if self.by_word else None
        self.letters = _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = Recent(cached_words)

    @staticmethod
    def of(path: str) -> Encoder:
        """The encoder of this Python worker."""
        made = worker_cache("encoders")
        if path not in made:
            made[path] = Encoder(path)
        return made[path]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        found = self.words.get(word)
        if found is None:
            text = word.decode()
            if _PLAIN.fullmatch(text):
                found = self._plain_word(text.lower().encode())
            else:
                found = self._whole(text)
            self.words.put(word, found)
        return found

    def _plain_word(self, word: bytes) -> bytes:
        """``_word`` of a lower-case word known to be plain; its pieces are such words, too."""
        found = self.words.get(word)
        if found is None:
            pieces = _latin_pieces(word.decode())
            if len(pieces) > 1:
                found = b"".join([self._plain_word(p.encode()) for p in pieces])
            else:
                # The letters of printable ASCII are the bytes themselves.
                shown = pieces[0] if word.isascii() else word.decode("latin1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(shown)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            self.words.put(word, found)
        return found

    def __call__(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special):
            return self._whole(text)
        plain = _is_plain(text)
        # White space of ASCII never lies inside a token, so words can be taken one by one.
        words = (text.lower() if plain else text).encode().split()
        found = list(map(self.words.new.get, words))
        if None in found:
            encode = self._plain_word if plain else self._word
            found = [encode(w) if f is None else f for w, f in zip(words, found)]
        return b"".join(found)


class Packer:
    """Packs the parts of one task; ``flush`` gives the pieces of the windows closed so far."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers = tuple(sorted(tiers))
        self.step_tokens = step_tokens
        self.next_sequence = self.next_step = task << 40
        # Parts that wait, by length: (length, doc number, start).
        self.waiting: list[tuple[int, int, int]] = []
        self.docs: dict[int, tuple] = {}
        self.number = 0
        self.closed: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.held = 0

    def add(self, doc_id, ids: bytes) -> None:
        tokens = len(ids) // 4
        self.docs[self.number] = (doc_id, ids, tokens)
        longest = self.tiers[-1]
        whole = tokens // longest * longest
        for start in range(0, whole, longest):
            self.closed.append((longest, [(longest, self.number, start)]))
        if tokens > whole:
            bisect.insort(self.waiting, (tokens - whole, self.number, whole))
        self.number += 1
        self.held += tokens

    def _tier(self, length: int) -> int:
        return self.tiers[bisect.bisect_left(self.tiers, length)]

    def _close(self, last: bool) -> None:
        """Pack what waits; parts of a window that stays open wait on, unless it is the last."""
        while self.waiting:
            parts = [self.waiting.pop()]
            window = self._tier(parts[0][0])
            gap = window - parts[0][0]
            while gap and self.waiting:
                at = bisect.bisect_right(self.waiting, (gap, float("inf"), 0)) - 1
                if at >= 0:
                    part = self.waiting.pop(at)
                else:
                    length, doc, start = self.waiting.pop(0)
                    part = (gap, doc, start)
                    bisect.insort(self.waiting, (length - gap, doc, start + gap))
                parts.append(part)
                gap -= part[0]
            if gap and not last:
                for part in parts:
                    bisect.insort(self.waiting, part)
                return
            if gap:
                self._cut_rest(parts)
            else:
                self.closed.append((window, parts))

    def _cut_rest(self, parts: list[tuple[int, int, int]]) -> None:
        """The last open window of the task: full windows of shorter tiers, then one padded window."""
        left = list(reversed(parts))
        total = sum(p[0] for p in parts)
        while total:
            fits = [t for t in self.tiers if t <= total]
            window = fits[-1] if fits else self.tiers[0]
            room, taken = min(window, total), []
            total -= room
            while room:
                length, doc, start = left.pop()
                use = min(room, length)
                taken.append((use, doc, start))
                if use < length:
                    left.append((length - use, doc, start + use))
                room -= use
            self.closed.append((window, taken))

    def flush(self, last: bool = False) -> pa.RecordBatch:
        self._close(last)
        rows = []
        groups = max(1, sum(w for w, _ in self.closed) // self.step_tokens)
        # The group with the fewest tokens takes the longest window left.
        open_groups = [(0, 0, g) for g in range(groups)]
        for window, parts in sorted(self.closed, key=lambda c: -c[0]):
            tokens, cost, group = heapq.heappop(open_groups)
            heapq.heappush(open_groups, (tokens + window, cost + window * window, group))
            offset = 0
            for length, doc, start in parts:
                doc_id, ids, total = self.docs[doc]
                rows.append(
                    (doc_id, start, length, ids[4 * start : 4 * (start + length)], total, self.next_sequence,
                     offset, window, self.next_step + group)
                )
                offset += length
            self.next_sequence += 1
        self.next_step += groups
        self.closed = []
        waiting = {doc for _, doc, _ in self.waiting}
        self.docs = {doc: value for doc, value in self.docs.items() if doc in waiting}
        self.held = 0
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
        names = [c.split()[0] for c in PIECES.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    tiers: tuple[int, ...] = TIERS,
    end: int = 1,
    step_tokens: int = 16 * 2048,
    block_tokens: int = 1 << 20,
) -> DataFrame:
    """Pieces of all documents (doc_id, text, anything else), see ``PIECES`` for the columns.

    ``ids`` holds the piece's token ids (little-endian unsigned 32-bit), ``start`` counts the
    document's ids before it, ``doc_tokens`` all its ids with the ``end`` id. ``offset`` is the
    place in the sequence; a sequence fills a ``window`` of one of the tiers exactly, save for the
    last one of a task. Windows of one ``step_group`` belong in one training step: groups of a
    block hold ``step_tokens`` tokens or a little more, equal within one window.

    * NULL or empty text: a piece with the ``end`` id only.
    * NULL doc_id: packed like any other, doc_id NULL. Repeated rows are packed as often as
      they come. An empty table gives no piece. Other columns are ignored.
    * A text of any length is one document in memory, no more; ``block_tokens`` bounds the rest.
    * Numbers of sequences and steps depend on how rows lie in partitions; a task that runs again
      over the same rows in the same order, as from files, gives the same pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer)
        tail = np.array([end], dtype="<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                packer.add(doc_id.as_py(), encode(text.as_py() or "") + tail)
                if packer.held >= block_tokens:
                    yield packer.flush()
        batch = None
        yield packer.flush(last=True)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
