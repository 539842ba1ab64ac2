"""Language identification by compression.

Text that a dictionary of its own language precedes compresses best. One raw-content dictionary per
language is made of a bounded sample of labelled texts; every whole text is encoded with each
of them, segment by segment, and the language with the fewest bytes wins. A narrow margin between
the best two is a rejection.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import fold, free, give_back, replace_columns, ship, stored, worker_cache

ship(__name__)

UNKNOWN = "und"
DICTIONARY_BYTES = 200_000
DICTIONARIES_BYTES = 32 << 20
MOST_LANGUAGES = 1000
EXCERPT = 1024
SAMPLE = 20_000
SEGMENT = 4096
LEVEL = 3
# Share of the bytes by which the best language must beat the next one.
MARGIN = 0.001

_NOT_LETTERS = re.compile(r"[\W\d_]+")
# What is left of a text by ``letters``, for Spark.
_LETTER = r"\p{L}"


def letters(text: str | None) -> bytes:
    """Lower-case letters of a text; anything else becomes one space."""
    plain = _NOT_LETTERS.sub(" ", (text or "").lower())
    # Numbers such as one half or Roman numerals are word characters, but no letters.
    if not plain.replace(" ", "").isalpha():
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    return plain.strip().encode("utf-8", "replace")


def _excerpt(text: Column) -> Column:
    """1,024 characters at a place chosen by the hash of the whole text, or from its first letter
    where that place has none."""
    places = F.greatest(F.length(text) - EXCERPT + 1, F.lit(1))
    part = F.substr(text, (F.pmod(F.xxhash64(text), places) + 1).cast("int"), F.lit(EXCERPT))
    return F.when(part.rlike(_LETTER), part).otherwise(
        F.substr(text, F.regexp_instr(text, F.lit(_LETTER)), F.lit(EXCERPT))
    )


def fit(labelled: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from ``labelled`` (text, lang), the most frequent language first.

    The sample is bounded: of the different excerpts of each language about 20,000 by hash, of these
    the ones with the smallest hashes, until the dictionary is full. An excerpt is 1,024 characters
    at a place that the hash of its text chooses, so copies of a text are one excerpt and texts
    with a common beginning are many. All dictionaries together stay below 32 MB; beyond 1,000
    languages the most frequent ones are learned.
    """
    rows = (
        labelled.filter("lang is not null and text is not null")
        .select(F.col("lang").cast("string").alias("lang"), _excerpt(F.col("text").cast("string")).alias("text"))
    )
    taught = F.approx_count_distinct(F.when(F.col("text").rlike(_LETTER), F.col("text"))).alias("different")
    common = (
        rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), taught).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    )
    sizes = {row["lang"]: row["different"] for row in common.collect()}
    if not sizes:
        return {}
    room = min(dictionary_bytes, DICTIONARIES_BYTES // len(sizes))
    # Letters of an excerpt can be few, so more excerpts are read than fill a dictionary.
    excerpts = min(1000, max(8, 4 * room // EXCERPT))
    # Far more than are read, so that chance and the rounding of the count leave no language short.
    wanted = max(SAMPLE, 8 * excerpts)
    shares = labelled.sparkSession.createDataFrame(
        [(name, min(1.0, wanted / max(1, n))) for name, n in sizes.items()], "lang string, share double"
    )
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    # Copies of one text are one row before any rank is given.
    chosen = (
        rows.join(F.broadcast(shares), "lang")
        .filter((place < F.col("share")) & F.col("text").rlike(_LETTER))
        .select("lang", "text").distinct()
    )
    # Counts per language and range of the hash say up to which range the smallest ones lie, so
    # that a rank is given to little more than the excerpts that are read.
    key = F.xxhash64("text")
    chosen = stored(chosen.withColumn("range", F.shiftright(key, 56).cast("int")), "excerpts")
    counted = chosen.groupBy("lang", "range").count()
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    needed = counted.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    needed = needed.filter(F.col("_before") < excerpts).select("lang", "range")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(key, "text"))
    texts: dict[str, list[bytes]] = {name: [] for name in sizes}
    # 256 ranges of 1,000 languages at most are broadcast.
    near = chosen.join(F.broadcast(needed), ["lang", "range"], "left_semi")
    ranked = near.withColumn("nth", nth).filter(F.col("nth") <= excerpts)
    for row in ranked.orderBy("lang", "nth").toLocalIterator():  # 1,000 excerpts per language at most
        texts[row["lang"]].append(letters(row["text"]))
    made = {name: b" ".join(t for t in dict.fromkeys(parts) if t)[:room] for name, parts in texts.items()}
    return {name: content for name, content in made.items() if content}


class Classifier:
    """Compressors with the dictionaries of one model."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compressors = []
        for name in self.names:
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(dictionaries[name]), source_size=SEGMENT,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=content))

    @staticmethod
    def of(dictionaries: dict[str, bytes]) -> Classifier:
        """The classifier of this Python worker; only the newest model is kept."""
        made = worker_cache("languages")
        key = hash(tuple(dictionaries.items()))
        if key not in made:
            made.clear()
            made[key] = Classifier(dictionaries)
        return made[key]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): ``und`` for a text without a letter.

        The margin is the part of the best size by which the next size is larger. The score is the
        chance of the best language if a saved byte made a text twice as likely, on the scale
        of a text of one segment.
        """
        data = letters(text)
        if not data or not self.names:
            return UNKNOWN, 0.0, 0.0
        parts = [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]
        sizes = [sum(len(c.compress(p)) for p in parts) for c in self.compressors]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        others = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(others) - sizes[best]) / sizes[best] if others else 1.0
        scale = min(1.0, SEGMENT / len(data))
        score = 1.0 / sum(2.0 ** (-min(60.0, (s - sizes[best]) * scale)) for s in sizes)
        return self.names[best], score if math.isfinite(score) else 0.0, margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_rejected, from their ``text`` alone.

    * NULL text, or one without a letter: ``und``, score 0, rejected; so is all without a model.
    * A margin below ``margin``: rejected, lang_pred still names the best; equal sizes go to the
      language that was more frequent in learning, then to the first in code point order.
    * Repeated rows get equal results; an empty table stays empty. Columns named like the new
      ones give way.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Classifier.of(broadcast.value)
        for batch in batches:
            found = [known(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[0] == UNKNOWN or f[2] < margin for f in found], pa.bool_()),
                ],
                ["lang", "score", "rejected"],
            )
        batch = None
        give_back()

    (language,) = free(docs, "_language")
    work = docs.withColumn(language, classify(F.col("text").cast("string")))
    new = {"lang_pred": "lang", "lang_score": "score", "lang_rejected": "rejected"}
    return replace_columns(work, {k: F.col(f"{language}.{v}") for k, v in new.items()}).drop(language)


def learned_from(key: str = "doc_id") -> Column:
    return F.coalesce(fold(key, 3) != 1, F.lit(False))


def held_out(key: str = "doc_id") -> Column:
    """Documents kept out of learning; a NULL id is neither held out nor learned from."""
    return F.coalesce(fold(key, 3) == 1, F.lit(False))
