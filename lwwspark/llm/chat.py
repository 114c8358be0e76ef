r"""Chat formatting by event-sourced reconstruction.

A log of conversation events is dealt out by conversation, sorted by sequence, folded into final messages and rendered.
Kinds of events (null: ``message``; any other kind is ignored):

* ``message`` appends a message (``message`` column: its id, for later edits);
* ``delta`` extends the newest message, or starts one where there is none;
* ``edit`` replaces the text of the message with its id, wherever it stands; an unknown id is ignored;
* ``regenerate`` empties that message to the event's text and drops all messages after it; without an id it takes the
  newest assistant message; an unknown id is ignored.

A turn is rendered as ``### role: text</turn>\n``. Inside roles and texts ``\``, ``#`` and the slash of ``</`` get a
backslash before them (in roles ``:`` too), so neither control string can occur there, and the rendering reads back exactly.

Defined results: null texts and roles are empty; a null sequence sorts first; equal sequences are ordered by kind, role
and text; repeated rows are separate turns; a null conversation id is a conversation of its own; an empty table gives an
empty result; other columns are not read.

Scale: one shuffle, on the conversation id. A task streams its sorted rows: messages leave it once no later edit or
regeneration of the conversation can reach them, in parts of about ``part_chars``, so a conversation that holds a third
of the log passes through as parts and is never held as a whole (only up to its last edit or regeneration).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text starts and ends in it."""
    head = OPEN + escape(role).replace(":", "\\:") + AFTER_ROLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; the inverse of rendering."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Conversation:
    """The messages of one conversation that events can still change."""

    def __init__(self):
        self.messages: list[list] = []  # [id, role, [texts]]

    def find(self, message) -> int | None:
        for i in range(len(self.messages) - 1, -1, -1):
            if message is None and self.messages[i][1] == "assistant" or message is not None and self.messages[i][0] == message:
                return i
        return None

    def add(self, kind: str, message, role: str, text: str) -> None:
        if kind == "message" or kind == "delta" and not self.messages:
            self.messages.append([message, role, [text]])
        elif kind == "delta":
            self.messages[-1][2].append(text)
        elif kind in ("edit", "regenerate") and (at := self.find(message)) is not None:
            self.messages[at][2] = [text]
            if kind == "regenerate":
                del self.messages[at + 1 :]

    def settled(self, all_of_them: bool) -> list[tuple[str, str]]:
        """Takes out what later deltas can't change: all but the newest message."""
        n = len(self.messages) - (not all_of_them)
        done, self.messages = self.messages[: max(0, n)], self.messages[max(0, n) :]
        return [(role, "".join(texts)) for _, role, texts in done]


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class Parts:
    """Collects rendered turns of a conversation and gives them out in parts."""

    def __init__(self, part_chars: int):
        self.most, self.out = part_chars, []

    def start(self, conv):
        self.conv, self.part, self.pieces, self.size, self.spans = conv, 0, [], 0, []

    def turn(self, role: str, text: str):
        piece, start, end = render_turn(role, text)
        if role == "assistant":
            self.spans.append((self.size + start, self.size + end))
        self.pieces.append(piece)
        self.size += len(piece)
        if self.size >= self.most:
            self.close()

    def close(self, last: bool = False):
        if self.pieces or last and not self.part:
            self.out.append((self.conv, self.part, "".join(self.pieces), [s for s, _ in self.spans], [e for _, e in self.spans]))
            self.part, self.pieces, self.size, self.spans = self.part + 1, [], 0, []


_PARTS = "part int, formatted string, loss_starts array<int>, loss_ends array<int>"


def format_conversations(
    log: DataFrame, conv_id: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text",
    kind: str | None = None, message: str | None = None, part_chars: int = 1 << 20,
) -> DataFrame:
    """conv_id, part, formatted, loss_starts, loss_ends: parts of a conversation stand together, in order.

    The loss mask covers the texts of assistant turns, as offsets of code points in the part's ``formatted``.
    """
    key = log.schema[conv_id].dataType.simpleString()
    events = log.select(
        F.col(conv_id).alias("conv_id"), F.col(seq).alias("seq"),
        F.coalesce(F.col(kind) if kind else F.lit(None), F.lit("message")).alias("kind"),
        (F.col(message).cast("string") if message else F.lit(None).cast("string")).alias("message"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).repartition("conv_id")
    if kind:  # the last event that reaches back
        back = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("last")
        ends = events.groupBy(F.col("conv_id").alias("of")).agg(back).where("last is not null")
        events = events.join(ends, events.conv_id.eqNullSafe(ends.of), "left").drop("of")
        events = events.withColumn("open", F.col("last").isNotNull() & (F.col("seq").isNull() | (F.col("seq") <= F.col("last")))).drop("last")
    else:
        events = events.withColumn("open", F.lit(False))
    events = events.sortWithinPartitions("conv_id", "seq", "kind", "role", "text").select("conv_id", "open", "kind", "message", "role", "text")
    schema = f"conv_id {key}, {_PARTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, state, begun = Parts(part_chars), None, False

        def give():
            rows, parts.out = parts.out, []
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [conv_type, pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "formatted", "loss_starts", "loss_ends"])

        def end():
            for r, t in state.settled(True):
                parts.turn(r, t)
            parts.close(last=True)

        conv_type, held = pa.int64(), 0
        for batch in batches:
            conv_type = batch.column(0).type
            for conv, still_open, what, msg, r, t in _rows([batch]):
                if not begun or conv != parts.conv:
                    if begun:
                        end()
                    begun, state = True, Conversation()
                    parts.start(conv)
                state.add(what, msg, r, t)
                if not still_open:
                    for x in state.settled(False):
                        parts.turn(*x)
                held += len(t)
                if held > 1 << 22 and parts.out:
                    yield give()
                    held = 0
            if parts.out:
                yield give()
        if begun:
            end()
            yield give()

    return events.mapInArrow(run, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, read from what ``format_conversations`` returned, in its order, part by part."""
    key = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def ended():
            conv, n, turns, chars, loss, size = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        def pack(rows):
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        conv_type = pa.int64()
        for batch in batches:
            conv_type, rows = batch.column(0).type, []
            for conv, part, formatted, starts, ends in _rows([batch]):
                if part == 0:
                    if state:
                        rows.append(ended())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for s, e in zip(starts, ends, strict=True):
                    under = unescape(formatted[s:e])
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(formatted)
            if rows:
                yield pack(rows)
        if state:
            yield pack([ended()])

    return parts.mapInArrow(run, f"conv_id {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
