"""A hidden Markov language model over word classes.

Every word belongs to one class: frequent words have one of their own, the others share a
class by their ending. A text is a chain of hidden states that emit classes, and a word is drawn
from its class by its smoothed count, so that probabilities of all texts add up to 1. States are
trained by Baum-Welch: each partition adds up the expected counts of its texts, Spark sums them
over partitions. The scaled forward recursion gives the exact likelihood of a whole text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import fold, ship, stored, worker_cache

ship(__name__)

STATES = 8
OWN_CLASS = 4096
ENDING_CLASSES = 1024
HEAD = 131_072
ENDING = 3
SMOOTH = 0.1
PRIOR = 50.0
SEGMENT = 1024
TOGETHER = 1024
FLUSH = 300_000
BUFFER = 4_000_000
TEXTS_AT_ONCE = 128
# Groups of classes that the pairs counted for the start of training have in second place, and rounds over these counts.
GROUPS, START_ROUNDS = 64, 100
ROUNDS = 3


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes know ASCII only, and split at 20 and 09-0D."""
    return (text or "").encode().lower().split()


def training(key: str = "doc_id") -> Column:
    """Texts to learn from; a NULL id is learned from and not held out."""
    return F.coalesce(fold(key, 10) != 0, F.lit(True))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, words as UTF-8 bytes; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def take() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > FLUSH:
                    yield take()
        yield take()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the most frequent words and of the classes; its size does not grow with the text."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    different: int
    class_mass: np.ndarray

    @property
    def scale(self) -> float:
        return self.tokens + SMOOTH * (self.different + 1)

    @property
    def end_class(self) -> int:
        return OWN_CLASS + ENDING_CLASSES

    def log_base(self, count) -> np.ndarray:
        return np.log10((np.asarray(count, dtype=float) + SMOOTH) / self.scale)


def ending_class(word: bytes) -> int:
    return OWN_CLASS + zlib.crc32(word[-ENDING:]) % ENDING_CLASSES


def _least_count(counts: DataFrame) -> int:
    """From which count on no more than ``HEAD`` words are left; from one row per step of counts."""
    step = F.floor(F.log2("n") * 8).cast("long")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    kept, least = 0, 1 << 62
    for row in sorted(steps, key=lambda r: -r["step"]):
        kept += row["words"]
        if kept > HEAD:
            break
        least = row["least"]
    return least


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """The bounded part of the counts that every task needs."""
    ending = F.when(F.length("word") <= ENDING, F.col("word")).otherwise(F.expr(f"substring(word, -{ENDING}, {ENDING})"))
    classes = (
        counts.groupBy((F.crc32(ending) % ENDING_CLASSES).alias("class"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
        .collect()
    )
    head = sorted(counts.filter(F.col("n") >= _least_count(counts)).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    words, found = [bytes(r["word"]) for r in head], np.array([r["n"] for r in head], dtype=np.int64)
    # Every ending class keeps room for one unknown word, as the whole vocabulary does.
    mass = np.full(OWN_CLASS + ENDING_CLASSES + 1, SMOOTH)
    for r in classes:
        mass[OWN_CLASS + r["class"]] += r["n"] + SMOOTH * r["words"]
    for i, word in enumerate(words[:OWN_CLASS]):
        mass[i] = found[i] + SMOOTH
        mass[ending_class(word)] -= found[i] + SMOOTH
    mass[-1] = texts + SMOOTH
    mass = np.maximum(mass, SMOOTH)
    tokens = int(sum(r["n"] for r in classes)) + texts
    different = int(sum(r["words"] for r in classes)) + (texts > 0)
    return Vocabulary(words, found, texts, tokens, different, mass)


CODED = (
    "tokens long, known long, base double, in_class double, shared long, "
    "tail array<struct<word:binary,n:int>>, classes binary"
)


def _coder(vocab: Vocabulary):
    """Function of one text's words: numbers of ``CODED``."""
    cache = worker_cache("words")
    key = hashlib.sha256(b"\n".join(vocab.words)).digest()
    if key not in cache:
        cache.clear()
        cache[key] = {w: i for i, w in enumerate(vocab.words)}
    number = cache[key]
    log_head = vocab.log_base(vocab.counts)
    class_of = np.array(
        [i if i < OWN_CLASS else ending_class(w) for i, w in enumerate(vocab.words)] + [0], dtype=np.uint16
    )
    log_end = float(vocab.log_base(vocab.ends))

    def code(words: list[bytes]) -> tuple:
        """Numbers of one text, its rare words with theirs, and its classes."""
        get = number.get
        at = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        rare = np.flatnonzero(at < 0)
        tail = [words[i] for i in rare]
        classes = np.empty(len(words) + 1, dtype="<u2")
        classes[:-1] = class_of[at]
        classes[rare] = [ending_class(w) for w in tail]
        classes[-1] = vocab.end_class
        head = at[at >= 0]
        shared = head[head >= OWN_CLASS]
        return (
            len(words) + 1,
            len(head) + (vocab.ends > 0),
            float(log_head[head].sum()) + log_end,
            float(log_head[shared].sum()),
            len(shared) + len(tail),
            Counter(tail),
            classes.tobytes(),
        )

    return code


def coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, doc_id, learned, ``CODED``) per document: ``base`` and ``known`` of the frequent words and
    the end, the rare words (``tail``) with their numbers, and the classes of the whole text."""
    # Plain values only: a broadcast does not carry the class with it.
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocab))
    kinds = pa.struct(
        [
            ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("in_class", pa.float64()),
            ("shared", pa.int64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))),
            ("classes", pa.binary()),
        ]
    )

    def packed(found: list[tuple]) -> pa.StructArray:
        columns = list(zip(*found))
        tails = columns[5]
        ends = np.cumsum([0, *map(len, tails)])
        words = pa.array([w for tail in tails for w in tail], pa.binary())
        numbers = pa.array([n for tail in tails for n in tail.values()], pa.int32())
        pairs = pa.StructArray.from_arrays([words, numbers], fields=list(kinds.field("tail").type.value_type))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        parts = [listed if f.name == "tail" else pa.array(c, f.type) for c, f in zip(columns, kinds)]
        return pa.StructArray.from_arrays(parts, fields=list(kinds))

    @F.arrow_udf(f"struct<{', '.join(c.strip().replace(' ', ':', 1) for c in CODED.split(', '))}>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = _coder(Vocabulary(**shared.value))
        for batch in batches:
            # A few texts at a time: words as Python objects take many times their bytes.
            parts = [
                packed([one(words_of(x.as_py())) for x in batch.slice(at, TEXTS_AT_ONCE)])
                for at in range(0, len(batch), TEXTS_AT_ONCE)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], kinds)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", training().alias("learned"),
        code(F.col("text").cast("string")).alias("_coded"),
    )
    return rows.select("row", "doc_id", "learned", "_coded.*")


@dataclass(frozen=True)
class Model:
    """Start, transition (from, to) and emission (class, state) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _model(start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray) -> Model:
    """Probabilities from expected counts; the prior keeps all of them above zero."""
    states = len(start)
    start, move = start + 1.0 / states, move + 1.0 / states
    emit = emit + PRIOR * (mass / mass.sum())[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _batches(sequences: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of sequences of similar length, longest first: (places, offsets in one array, lengths)."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), most):
        chosen = order[at : at + most]
        size = lengths[chosen]
        yield chosen, np.cumsum(size) - size, size


def log_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural logarithm of each whole sequence's probability, by the scaled forward recursion.

    Sequences advance together, one class a step; only their state distributions are kept.
    """
    result = np.zeros(len(sequences))
    for chosen, offsets, size in _batches(sequences, 2 * TOGETHER):
        flat = np.concatenate([sequences[i] for i in chosen])
        total = np.zeros(len(chosen))
        alpha = None
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for t, n in enumerate(active):
            emitted = model.emit[flat[offsets[:n] + t]]
            alpha = (model.start if alpha is None else alpha[:n] @ model.move) * emitted
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
        result[chosen] = total
    return result


class Expected:
    """Expected counts of Baum-Welch over the sequences of one task."""

    def __init__(self, model: Model):
        self.model = Model(*[np.ascontiguousarray(x, dtype=np.float32) for x in (model.start, model.move, model.emit)])
        self.start = np.zeros(len(model.start))
        self.move = np.zeros(model.move.shape)
        self.emit = np.zeros(model.emit.shape)

    def add(self, sequences: list[np.ndarray], first: np.ndarray) -> None:
        """Forward and backward over whole segments; ``first`` marks beginnings of texts.

        A segment that goes on inside a text starts with all states equally likely.
        """
        model, states = self.model, len(self.start)
        even = np.full(states, 1.0 / states, dtype=np.float32)
        for chosen, offsets, size in _batches(sequences, TOGETHER):
            if not len(size) or not size[0]:
                continue
            flat = np.concatenate([sequences[i] for i in chosen])
            steps = int(size[0])
            active = np.searchsorted(-size, -np.arange(steps), side="left")
            alphas = np.zeros((steps, len(chosen), states), dtype=np.float32)
            scales = np.ones((steps, len(chosen)), dtype=np.float32)
            begin = np.where(first[chosen][:, None], model.start, even)
            for t, n in enumerate(active):
                a = (begin[:n] if t == 0 else alphas[t - 1, :n] @ model.move) * model.emit[flat[offsets[:n] + t]]
                scales[t, :n] = a.sum(axis=1)
                alphas[t, :n] = a / scales[t, :n, None]
            beta = np.ones((len(chosen), states), dtype=np.float32)
            moved = np.zeros((states, states), dtype=np.float32)
            for t in range(steps - 1, 0, -1):
                n = active[t]
                ahead = model.emit[flat[offsets[:n] + t]] * beta[:n] / scales[t, :n, None]
                alphas[t, :n] *= beta[:n]
                moved += alphas[t - 1, :n].T @ ahead
                beta[:n] = ahead @ model.move.T
            alphas[0] *= beta
            self.move += moved * model.move
            self.start += alphas[0][first[chosen][: len(chosen)] & (size > 0)].sum(axis=0)
            step = np.arange(steps)[:, None]
            real = step < size[None, :]
            classes = flat[np.minimum(offsets[None, :] + step, len(flat) - 1)[real]]
            weights = alphas[real]
            for k in range(states):
                self.emit[:, k] += np.bincount(classes, weights=weights[:, k], minlength=len(self.emit))


def _segments(classes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [c[i : i + SEGMENT] for c in classes for i in range(0, len(c), SEGMENT)]
    first = [i == 0 for c in classes for i in range(0, len(c), SEGMENT)]
    return parts, np.array(first, dtype=bool)


def expected_counts(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of Baum-Welch over all ``rows`` (classes): expected starts, moves and emissions.

    A partition gives one row per class and state number, whatever its size; the sums over
    partitions are made by Spark, so the driver gets one row per class.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))
    states, classes = len(model.start), len(model.emit)
    names = ["key", *[f"s{k}" for k in range(states)]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = Expected(Model(**shared.value))
        waiting, held = [], 0
        for batch in batches:
            for value in batch.column(0):
                waiting.append(np.frombuffer(value.as_py(), dtype="<u2"))
                held += len(waiting[-1])
                if held > BUFFER:
                    expected.add(*_segments(waiting))
                    waiting, held = [], 0
        expected.add(*_segments(waiting))
        # Keys below zero are the starts, then the moves out of each state.
        table = np.vstack([expected.emit, expected.start[None, :], expected.move])
        keys = np.concatenate([np.arange(classes), -1 - np.arange(states + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(table[:, k]) for k in range(states)]], names=names)

    schema = ", ".join(["key long", *[f"{n} double" for n in names[1:]]])
    sums = rows.select("classes").mapInArrow(add, schema).groupBy("key").agg(*[F.sum(n).alias(n) for n in names[1:]])
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    for row in sums.collect():
        values = np.array(row[1:])
        if row["key"] >= 0:
            emit[row["key"]] = values
        elif row["key"] == -1:
            start = values
        else:
            move[-2 - row["key"]] = values
    return start, move, emit


def _groups(classes: int) -> np.ndarray:
    """The group of each class: one of its own for the most frequent words, few for all others."""
    own, every = GROUPS // 2, np.arange(classes)
    return np.where(every < own, every, own + every % (GROUPS - own))


def pair_counts(rows: DataFrame, classes: int) -> np.ndarray:
    """(class, group): how often a class is followed by a class of a group, in all texts of ``rows``.

    A partition gives one row per class, Spark adds them up.
    """
    group = _groups(classes)
    names = ["key", *[f"g{k}" for k in range(GROUPS)]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * GROUPS, dtype=np.int64)
        waiting, held = [np.zeros(0, dtype=np.int64)], 0
        for batch in batches:
            for value in batch.column(0):
                chain = np.frombuffer(value.as_py(), dtype="<u2").astype(np.int64)
                waiting.append(chain[:-1] * GROUPS + group[chain[1:]])
                held += len(chain)
                if held > BUFFER // 4:
                    table += np.bincount(np.concatenate(waiting), minlength=len(table))
                    waiting, held = [np.zeros(0, dtype=np.int64)], 0
        table += np.bincount(np.concatenate(waiting), minlength=len(table))
        table = table.reshape(classes, GROUPS)
        keys = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(table[keys, k]) for k in range(GROUPS)]], names=names)

    schema = ", ".join(f"{n} long" for n in names)
    sums = rows.select("classes").mapInArrow(add, schema).groupBy("key").agg(*[F.sum(n).alias(n) for n in names[1:]])
    counts = np.zeros((classes, GROUPS))
    for row in sums.collect():
        counts[row["key"]] = row[1:]
    return counts


def _begin(rows: DataFrame, vocab: Vocabulary, states: int, seed: int) -> Model:
    """Where training starts: Baum-Welch on all pairs of neighbours, of which the second is known by its group.

    All texts are counted; the rounds see one row per class.
    """
    noise = np.random.default_rng(seed)
    mass = vocab.class_mass
    emit = mass[:, None] * np.exp(noise.normal(0, 0.5, (len(mass), states)))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    model = _model(np.ones(states), 1e3 * move, emit, mass)
    counts, group = pair_counts(rows, len(mass)), _groups(len(mass))
    of_group = (group == np.arange(GROUPS)[:, None]).astype(float)
    here = model.start
    for _ in range(START_ROUNDS if counts.any() else 0):
        ahead = of_group @ model.emit
        left = model.emit * here
        ratio = counts / np.maximum(left @ model.move @ ahead.T, 1e-300)
        first = left * (ratio @ ahead @ model.move.T)
        moved = model.move * (left.T @ ratio @ ahead)
        second = model.emit * (ratio.T @ left @ model.move)[group]
        here = first.sum(axis=0) / first.sum()
        model = _model(first.sum(axis=0), moved, first + second, mass)
    return model


def train(rows: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """States trained on all ``rows`` (classes) in ``rounds`` passes."""
    model = _begin(rows, vocab, states, seed)
    for _ in range(rounds):
        model = _model(*expected_counts(rows, model), vocab.class_mass)
    return model


def _rare_words(rows: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, rare_known, rare_base): the rare words of each row, joined with their counts.

    A word outside the head is rarer than the head's last one, so no key of this join is hot.
    """
    rare = rows.select("row", F.explode("tail").alias("_word")).select(
        "row", F.col("_word.word").alias("word"), F.col("_word.n").alias("often")
    )
    count = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    return (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("often")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("often") * F.log10((count + SMOOTH) / F.lit(float(vocab.scale)))).alias("rare_base"),
        )
    )


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``
    (doc_id, text, anything else), from a model of the rows that ``training`` names.

    * NULL or empty text: the end token alone. Repeated rows: learned as often as they come.
    * NULL doc_id: learned from, not held out.
    * Without any text to learn from, every token has the same base probability 1 and the
      states know the prior only. An empty table gives an empty result.
    * Texts are read twice, for the counts and for the classes; training reads classes only.
    """
    learned = docs.select("doc_id", "text").filter(training())
    counts = stored(count_words(learned), "word-counts")
    vocab = vocabulary(counts, learned.count())
    rows = stored(coded(docs.select("doc_id", "text"), vocab), "word-classes")
    model = train(rows.filter("learned"), vocab, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vars(model), np.log10(vocab.class_mass)))

    @F.arrow_udf("struct<chain:double,mass:double>")
    def chain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, mass = Model(**shared.value[0]), shared.value[1]
        mass = np.where(np.arange(len(mass)) < OWN_CLASS, 0.0, mass)
        mass[-1] = 0.0
        for batch in batches:
            classes = [np.frombuffer(x.as_py(), dtype="<u2") for x in batch]
            likely = log_likelihoods(classes, known) / np.log(10)
            within = np.array([mass[c].sum() for c in classes])
            yield pa.StructArray.from_arrays([pa.array(likely), pa.array(within)], ["chain", "mass"])

    scored = rows.withColumn("_chain", chain("classes")).drop("classes", "tail")
    joined = scored.join(_rare_words(rows, counts, vocab), "row", "left")
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    # Words of a shared class: their share of the class's mass.
    within = F.col("in_class") + rare_base + F.col("shared") * float(np.log10(vocab.scale)) - F.col("_chain.mass")
    return joined.select(
        "doc_id",
        (~F.col("learned")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base).alias("base_score"),
        (F.col("_chain.chain") + within).alias("score"),
    )
