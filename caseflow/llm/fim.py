"""Fill-in-the-middle by rotating blocks of a text in place.

A text is cut into prefix, middle and suffix at two places that depend on the document's id alone. The
sentinels are inserted into one bytearray, whose blocks then change places by three reversals; the same
rotations, run backwards, give the text back. Nothing but the output and its form is needed for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import replace_columns, ship

ship(__name__)

# The sentinels and the forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that change places at a time.
SWAP = 1 << 16


def starts(raw: np.ndarray) -> np.ndarray:
    """Byte positions where tokens begin: a run of ASCII letters, or any other single code point."""
    letter = ((raw | 0x20) - 97) < 26
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def _reverse(view: np.ndarray) -> None:
    """Reverse bytes in place, a block from each side at a time."""
    left, right = 0, len(view)
    while right - left > 1:
        size = min(SWAP, (right - left) // 2)
        head = view[left : left + size][::-1].copy()
        view[left : left + size] = view[right - size : right][::-1]
        view[right - size : right] = head
        left, right = left + size, right - size


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> None:
    """Let the blocks [start, middle) and [middle, stop) change places: reverse each, then both."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    _reverse(view[start:middle])
    _reverse(view[middle:stop])
    _reverse(view[start:stop])


def write(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The output for a text that is cut before the bytes ``first`` and ``second``."""
    buffer = bytearray(text)
    if form == PLAIN:
        return buffer
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    # Now: prefix, middle, suffix, each behind its sentinel.
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == PSM else 0, suffix, len(buffer))
    return buffer


def read(output: bytes, form: str) -> bytearray:
    """The text that ``write`` was given. No text with a sentinel has a form other than plain, and no
    sentinel begins with the end of another, so each is found where it was put."""
    buffer = bytearray(output)
    if form == PLAIN:
        return buffer
    if form == PSM:
        rotate(buffer, buffer.find(SUFFIX), buffer.find(MIDDLE), len(buffer))
    else:
        rotate(buffer, 0, buffer.find(PREFIX), len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(sentinel)
        del buffer[at : at + len(sentinel)]
    return buffer


def _plan(name: bytes, text: bytes, rate: int, spm: int) -> tuple[int, str, int, int]:
    """(tokens, form, first cut, second cut) of a document; the cuts are byte positions."""
    digest = hashlib.sha256(name).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
    places = starts(np.frombuffer(text, dtype=np.uint8))
    n = len(places)
    if not n or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, 0, 0
    first, second = (int(places[c]) if c < n else len(text) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, SPM if h4 % 100 < spm else PSM, first, second


def _chars(text: bytes, start: int, stop: int) -> int:
    """Code points between two byte positions."""
    return int(((np.frombuffer(text, dtype=np.uint8)[start:stop] & 0xC0) != 0x80).sum())


FIELDS = [
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output", pa.binary()),
]
COLUMNS = tuple(name for name, _ in FIELDS)


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, anything else) with ``n`` (tokens), ``form``, ``prefix_chars``,
    ``middle_chars`` (NULL where plain) and ``output``.

    ``rate`` per cent of the documents are transformed, ``spm`` per cent of those begin with the suffix.
    Cuts and form depend on ``seed``, doc_id and the text, so reruns and repeated rows agree.

    * NULL text: empty. Empty texts and texts with a sentinel stay as they are (plain).
    * NULL doc_id: hashed as an empty id.
    * All other columns stay; those named like an added one give way. An empty table stays empty.
    * Texts of any length: one text at a time is held, with a few numbers per byte.
    """

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output binary")
    def transformed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, texts in batches:
            rows = []
            for name, text in zip(names, texts):
                raw = text.as_py()
                n, form, first, second = _plan(f"{seed}:{name.as_py()}".encode(), raw, rate, spm)
                chars = (None, None) if form == PLAIN else (_chars(raw, 0, first), _chars(raw, first, second))
                rows.append((n, form, *chars, bytes(write(raw, first, second, form))))
            columns = list(zip(*rows)) or [()] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], list(COLUMNS))

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    # The row travels in one struct, so that no name of its columns can clash.
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), transformed(name, text).alias("made"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in COLUMNS]
    return made.select(*kept, *[F.col(f"made.{c}") for c in COLUMNS[:-1]], F.col("made.output").cast("string").alias("output"))


def restore(transformed: DataFrame) -> DataFrame:
    """The same rows with ``restored``: the exact text, from ``output`` and ``form`` alone.

    A NULL output or form gives NULL; a column named ``restored`` gives way.
    """

    @F.arrow_udf("binary")
    def restored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            pairs = ((o.as_py(), f.as_py()) for o, f in zip(outputs, forms))
            yield pa.array([None if o is None or f is None else bytes(read(o, f)) for o, f in pairs], pa.binary())

    text = restored(F.col("output").cast("binary"), F.col("form")).cast("string")
    return replace_columns(transformed, {"restored": text})
