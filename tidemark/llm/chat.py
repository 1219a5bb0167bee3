"""Chat formatting: a finite-state machine over roles, and a declarative template.

The template is data: the string that opens and closes each role's turn, the roles that
may follow each state, and the roles whose text is learned from. Texts are escaped so that
no control string of the template can appear inside one, and unescaping gives the text
back. Formatting yields the whole string and its segments; the segments of a conversation
lie behind one another without gaps, each with its loss flag.

Turns are ordered by ``turn`` (nulls first), equal turns by role and text. A null text is
empty, a null role is the role ``""``. Conversations whose order of turns is not accepted are
formatted all the same and say what is wrong in ``fault`` (null if nothing is). Rows
with a null conversation id are one conversation of that id. Repeated rows are turns of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, and which order of roles is right.

    ``opens`` and ``closes`` map a role to its strings, ``other`` stands for roles not
    named, its opening string holds ``{role}``. ``after`` maps a state to the roles that may
    come next; the state after a turn is its role, the first state is ``start``, and a
    conversation may end in the states of ``ends``.
    """

    start: str
    opens: dict[str, str]
    closes: dict[str, str]
    other: tuple[str, str]
    after: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    learned: tuple[str, ...]
    escape: str = "\\"
    #: Characters that begin a control string; a text never holds one unescaped.
    guarded: str = field(default="<[")

    def escaped(self, text: str) -> str:
        mark = re.escape(self.escape)
        return re.sub(rf"([{mark}{re.escape(self.guarded)}])", rf"{mark}\1", text)

    def unescaped(self, text: str) -> str:
        return re.sub(rf"{re.escape(self.escape)}(.)", r"\1", text, flags=re.S)

    def fault(self, roles: list[str]) -> str | None:
        """Where the machine stops, if it does."""
        state = "start"
        for place, role in enumerate(roles):
            if role not in self.after.get(state, ()):
                return f"turn {place}: {role or 'no role'} after {state}"
            state = role
        return None if state in self.ends else f"ends after {state}"

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, str | None, bool]]:
        """``(string, role, loss)`` in order; the role is null for control strings."""
        pieces: list[tuple[str, str | None, bool]] = []
        for role, text in turns:
            if role in self.opens:
                opening, closing = self.opens[role], self.closes[role]
            else:
                opening, closing = self.other[0].replace("{role}", self.escaped(role)), self.other[1]
            pieces += [
                (self.start + opening, None, False),
                (self.escaped(text), role, role in self.learned),
                (closing, None, False),
            ]
        return pieces

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted string."""
        mark = re.escape(self.escape)
        body = rf"((?:[^{re.escape(self.escape + self.guarded)}]|{mark}.)*+)"
        turns, at = [], 0
        forms = [(role, re.escape(self.opens[role]), re.escape(self.closes[role])) for role in self.opens]
        head = re.escape(self.other[0]).replace(re.escape("{role}"), body)
        forms.append((None, head, re.escape(self.other[1])))
        known = [(role, re.compile(re.escape(self.start) + opening + body + closing, re.S)) for role, opening, closing in forms]
        while at < len(formatted):
            for role, form in known:
                hit = form.match(formatted, at)
                if hit:
                    break
            else:
                raise ValueError(f"no turn begins at character {at}")
            groups = [self.unescaped(group) for group in hit.groups()]
            turns.append((role, groups[0]) if role is not None else (groups[0], groups[1]))
            at = hit.end()
        return turns


#: Turns in square brackets; system, user, assistant in order, the assistant's text learned.
BRACKETS = Template(
    start="<s>",
    opens={"system": "[SYS]", "user": "[INST]", "assistant": "[ANS]"},
    closes={"system": "[/SYS]</s>", "user": "[/INST]</s>", "assistant": "</s>"},
    other=("[ROLE]{role}[/ROLE]", "</s>"),
    after={
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
    ends=("user", "assistant"),
    learned=("assistant",),
)

_FORMATTED = (
    "conv_id bigint, formatted string, "
    "segments array<struct<start: bigint, length: bigint, role: string, loss: boolean>>, fault string"
)


def _format(template: Template):
    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("length", pa.int64()), ("role", pa.string()), ("loss", pa.bool_())])
    )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, segments, faults = [], [], []
            for turns in batch.column("turns").to_pylist():
                pieces = template.segments([(t["role"], t["text"]) for t in turns])
                at, own = 0, []
                for text, role, loss in pieces:
                    own.append({"start": at, "length": len(text), "role": role, "loss": loss})
                    at += len(text)
                strings.append("".join(text for text, _, _ in pieces))
                segments.append(own)
                faults.append(template.fault([t["role"] for t in turns]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(strings, pa.string()), pa.array(segments, kind), pa.array(faults, pa.string())],
                names=["conv_id", "formatted", "segments", "fault"],
            )

    return formatted


def format_chat(turns: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """One row per conversation: the formatted string, its segments, and what is wrong.

    ``turns`` has ``conv_id, turn, role, text``. A conversation is one string, so it is
    bounded by what a cell may hold; its turns meet in the task that writes the cell.
    """
    text, role = (F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("text", "role"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", role, text).alias("one"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    plain = told.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return plain.mapInArrow(_format(template), _FORMATTED)


def read_chat(formatted: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """Read formatted conversations back: ``conv_id``, the turns, and the text under the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses = [], []
            for whole, segments in zip(batch.column("formatted").to_pylist(), batch.column("segments").to_pylist()):
                turns.append([{"role": role, "text": text} for role, text in template.read(whole)])
                under = (whole[s["start"] : s["start"] + s["length"]] for s in segments if s["loss"])
                losses.append("".join(template.unescaped(part) for part in under))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                    pa.array(losses, pa.string()),
                    batch.column("formatted"),
                ],
                names=["conv_id", "turns", "loss_text", "formatted"],
            )

    schema = "conv_id bigint, turns array<struct<role: string, text: string>>, loss_text string, formatted string"
    return formatted.select("conv_id", "formatted", "segments").mapInArrow(read, schema)
