"""Chat formatting from a declarative template.

A finite-state machine over roles validates the order of turns. Every turn becomes text segments
(header, body, end) with a loss flag each. Control strings inside texts are broken by an escape
that ``parse`` undoes, so the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import ship

ship(__name__)

ESCAPE = "\\"
# Breaks a control string; a backslash of the text itself is doubled.
BREAK = ESCAPE + "|"


@dataclass(frozen=True)
class Template:
    """How turns are written and in which order they may come.

    ``labels`` are the headings of known roles; any other role is written as itself behind
    ``other``. ``moves`` maps a state and a role to the next state; ``accepting`` states may end a
    conversation. Texts of the ``learned`` roles are under the loss mask.
    """

    before: str = "### "
    after: str = ": "
    end: str = " </turn>\n"
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    other: str = "Role="
    learned: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        """Strings that must never come from a text: the beginning, the end, and every heading."""
        heads = [f"{self.before}{label}{self.after}" for _, label in self.labels]
        return [*heads, self.before.strip(), self.after, self.end.strip()]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn."""
        label = dict(self.labels).get(role)
        name = label if label is not None else self.other + escape(role, self)
        return [
            (f"{self.before}{name}{self.after}", False),
            (escape(text, self), role in self.learned),
            (self.end, False),
        ]

    def parse(self, formatted: str) -> tuple[str, str, str]:
        """(role, text, text under the loss mask) of one formatted turn."""
        if not formatted.startswith(self.before) or not formatted.endswith(self.end):
            raise ValueError("not a formatted turn")
        name, found, rest = formatted[len(self.before) :].partition(self.after)
        if not found:
            raise ValueError("a turn without the end of its header")
        roles = {label: role for role, label in self.labels}
        role = roles[name] if name in roles else unescape(name[len(self.other) :])
        text = unescape(rest[: len(rest) - len(self.end)])
        return role, text, text if role in self.learned else ""


def _pattern(template: Template) -> re.Pattern:
    """Places right behind the first character of a control string."""
    parts = {re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in template.controls() if c}
    return re.compile("|".join(sorted(parts, key=len, reverse=True)))


_PATTERNS: dict[tuple, re.Pattern] = {}


def escape(text: str, template: Template) -> str:
    key = tuple(template.controls())
    if key not in _PATTERNS:
        _PATTERNS[key] = _pattern(template)
    return _PATTERNS[key].sub(lambda m: m.group() + BREAK, text.replace(ESCAPE, ESCAPE * 2))


_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m.group(1) == ESCAPE else "", text)


SEGMENTS = "conv_id long, turn long, place long, segment int, text string, loss boolean, state string"
_ORDER = ("conv_id", "turn", "role", "text")


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition, in order: one sort, no row is ever grouped."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER)


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of all ``conversations`` (conv_id, turn, role, text, anything else), see ``SEGMENTS``.

    A conversation's formatted text is its segments' texts by ``place`` and ``segment``. ``state`` is
    the machine's state after the turn, ``error`` from the first turn that may not come there.

    * NULL text or role: empty. Rows of one turn go by role, then text; repeated rows stay.
    * NULL conv_id is a conversation of its own, NULL turn comes first.
    * Unknown roles are formatted and read back, and are an error of order.
    * A conversation of any length streams through one task, which keeps only its state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, state = object(), 0, "start"
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if conv != current:
                    current, place, state = conv, 0, "start"
                state = template.moves.get((state, role), "error")
                for number, (part, loss) in enumerate(template.segments(role, text)):
                    out.append((conv, turn, place, number, part, loss, state))
                place += 1
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            names = [c.split()[0] for c in SEGMENTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return _ordered(conversations).mapInArrow(run, SEGMENTS)


READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


class _Reader:
    """What has been read back of one conversation: digests and counts, no texts."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars, self.state = conv, 0, 0, 0, "start"
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, masked: str, template: Template, state: str) -> None:
        role, text, loss = template.parse(formatted)
        if unescape(masked) != loss:
            raise ValueError("the loss mask does not cover the learned text")
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        self.turns, self.loss_chars, self.chars, self.state = (
            self.turns + 1, self.loss_chars + len(loss), self.chars + len(formatted), state,
        )

    def row(self, template: Template) -> tuple:
        return (
            self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
            self.state in template.accepting,
        )


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, parsed from the output of ``format_turns`` alone, see ``READ``.

    ``valid`` tells whether the machine accepted all turns and the end. Segments must lie as
    ``format_turns`` gives them; a written copy is brought back with ``in_order``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, turn, masked = None, [], []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * 7
            names = [c.split()[0] for c in READ.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            done = []
            for conv, _, place, number, text, loss, state in zip(*[c.to_pylist() for c in batch.columns]):
                if number == 0 and place == 0:
                    if reader is not None:
                        done.append(reader.row(template))
                    reader = _Reader(conv)
                turn.append(text)
                if loss:
                    masked.append(text)
                if number == 2:
                    reader.add("".join(turn), "".join(masked), template, state)
                    turn, masked = [], []
            yield made(done)
        yield made([reader.row(template)] if reader is not None else [])

    return segments.mapInArrow(run, READ)


def in_order(segments: DataFrame) -> DataFrame:
    """Written segments as ``format_turns`` gave them."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "place", "segment")
