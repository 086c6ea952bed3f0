"""Operator 5: chat formatting by a finite-state machine over roles.

A declarative template gives each role its prefix, suffix and loss flag, and the states that
allow it. Turns are dealt by conversation and sorted in their partition; a task streams over
them, so no conversation is held in memory, however long it is. The operator emits text
segments with a loss flag each; joined in order they are the formatted conversation.
Texts are escaped: a backslash is doubled, and a control string gets one after its first
character, so no control string survives inside a text and the text can be read back.

Edge cases: a null text is empty; a null or unknown role is formatted with the general marks and
breaks the turn order; broken orders are formatted too and flagged (``valid`` false); repeated
turns are all kept, ordered by turn, role, text; null conversation ids form one conversation;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjectseries.llm.common import small_batches


@dataclass(frozen=True)
class Role:
    prefix: str
    suffix: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """Marks of the roles, and the roles that may follow each state (a state is the last role)."""

    roles: dict[str, Role]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    other: Role = field(default=Role("<<ROLE>>", "<</ROLE>>", False))
    controls: tuple[str, ...] = ()

    def role(self, name: str) -> Role:
        """Marks of a role; a role that the template does not know is named inside its prefix."""
        if name in self.roles:
            return self.roles[name]
        return Role(f"{self.other.prefix}{self.escape(name)}\n", self.other.suffix, False)

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return self._pattern().sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def _pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


START = ""
INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>>\n", "\n<</SYS>>\n", False),
        "user": Role("<s>[INST] ", " [/INST]", False),
        "assistant": Role(" ", " </s>", True),
    },
    follows={
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
    ends=("assistant",),
    controls=(
        "<s>",
        "</s>",
        "[INST]",
        "[/INST]",
        "<<SYS>>",
        "<</SYS>>",
        "<<ROLE>>",
        "<</ROLE>>",
    ),
)

SEGMENTS = "conv_id long, position long, segment int, text string, loss boolean, valid boolean"
_SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        ("segment", pa.int32()),
        ("text", pa.string()),
        ("loss", pa.bool_()),
        ("valid", pa.bool_()),
    ]
)
_FLUSH = 2000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, state = object(), 0, START
        out: list[tuple] = []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current:
                    current, position, state = conv, 0, START
                valid = role in template.follows.get(state, ())
                marks = template.role(role)
                for n, (part, loss) in enumerate(
                    ((marks.prefix, False), (template.escape(text), marks.loss), (marks.suffix, False))
                ):
                    out.append((conv, position, n, part, loss, valid))
                position, state = position + 1, role
                if len(out) >= _FLUSH:
                    yield _batch(out, _SEGMENTS)
                    out = []
        if out:
            yield _batch(out, _SEGMENTS)

    return run


def format_conversations(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Three segments a turn: prefix, text, suffix, in conversation order within a partition.

    ``position`` numbers the turns from 0, ``valid`` is false on a turn that the state before it
    does not allow.
    """
    small_batches(conversations.sparkSession)
    return (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_formatter(template), SEGMENTS)
    )


READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)
_READ = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
    ]
)


def _role_of(template: Template, prefix: str) -> str:
    for name, marks in template.roles.items():
        if marks.prefix == prefix:
            return name
    return unescape(prefix[len(template.other.prefix) : -1])


def _reader(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun = None, False
        out: list[tuple] = []
        turns = loss = hashlib.sha256()
        n_turns = loss_chars = chars = 0
        valid, role = True, ""

        def close() -> tuple:
            whole = valid and role in template.ends
            return (current, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, whole)

        for batch in batches:
            for conv, segment, text, flag, ok in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != current:
                    if begun:
                        out.append(close())
                    current, begun = conv, True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = chars = 0
                    valid = True
                chars += len(text)
                if segment == 0:
                    role = _role_of(template, text)
                    valid = valid and ok
                elif segment == 1:
                    plain = unescape(text)
                    n_turns += 1
                    turns.update(f"{role}\n{plain}\n".encode())
                    if flag:
                        loss_chars += len(plain)
                        loss.update(plain.encode())
            if len(out) >= _FLUSH:
                yield _batch(out, _READ)
                out = []
        if begun:
            out.append(close())
        if out:
            yield _batch(out, _READ)

    return run


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read from segments in the order the formatter emits them.

    ``turns_sha256`` covers role and text of every turn, ``loss_sha256`` and ``loss_chars`` the
    unescaped text under the loss flag, ``formatted_chars`` the whole formatted text. ``valid``
    says that the turn order was allowed and came to an end.
    """
    return segments.select("conv_id", "segment", "text", "loss", "valid").mapInArrow(
        _reader(template), READ
    )
