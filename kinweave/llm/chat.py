"""Chat formatting from event logs: events are dealt by conversation, sorted by sequence, and folded.

An event is (conv_id, seq, kind, target, role, text). Kinds: ``message`` opens a message, ``delta``
appends to message ``target``, ``edit`` replaces the text of message ``target``, ``regenerate`` drops message
``target`` and all after it and opens a new one. Without a target the last message is meant. The fold
takes sorted rows one by one, as a stream: a task holds the messages of one conversation at a time as
they stand, not its events, however the rows are batched.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Control strings inside texts are
broken by a backslash after their first character and backslashes are doubled, so nothing in a text
reads as control, and reading back gives the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

#: The template's marks, and control strings of common templates.
BEGIN, END = "<|im_start|>", "<|im_end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ESCAPE = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})." for c in CONTROL), re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|im_end\|>))*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the loss mask: spans of the assistant's texts."""
    out, at, mask = [], 0, []
    for role, text in messages:
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Fold:
    """The messages of one conversation as they stand after the events so far."""

    def __init__(self):
        self.messages: list[list] = []

    def apply(self, kind: str, target: int | None, role: str | None, text: str | None) -> None:
        text, role, last = text or "", role or "", len(self.messages) - 1
        at = last if target is None else target
        there = 0 <= at <= last
        if kind == "delta" and last >= 0:
            self.messages[at if there else last][1].append(text)
        elif kind == "edit":
            if there:
                self.messages[at] = [role or self.messages[at][0], [text]]
        else:
            if kind == "regenerate" and there:
                role = role or self.messages[at][0]
                del self.messages[at:]
            self.messages.append([role, [text]])

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages]


def fold(events) -> list[tuple[str, str]]:
    """Final messages of one conversation's events (kind, target, role, text), in order."""
    state = Fold()
    for event in events:
        state.apply(*event)
    return state.final()


_OUT = "conv_id long, formatted string, mask array<struct<start:long,stop:long>>"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _formatted(batches):
    def one(conv, state):
        text, mask = render(state.final())
        return {"conv_id": conv, "formatted": text, "mask": [{"start": a, "stop": b} for a, b in mask]}

    conv, state, out, size = None, None, [], 0
    for batch in batches:
        for c, *event in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if state is None or c != conv:
                if state is not None:
                    out.append(one(conv, state))
                    size += len(out[-1]["formatted"])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                    out, size = [], 0
                conv, state = c, Fold()
            state.apply(*event)
    if state is not None:
        out.append(one(conv, state))
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def format_events(events: DataFrame) -> DataFrame:
    """conv_id, formatted, mask for each conversation of ``events`` (conv_id, seq of any type that has
    an order, kind, target, role, text; other columns are ignored).

    Events are applied by seq; ties by kind, role and text; a null seq comes first; repeated rows are
    events each. Null texts and roles are empty. Deltas without a message open one; edits of a message
    that does not exist are void, regenerations open one. A null conv_id is a conversation of its own. No
    events, no rows.
    """
    e = events.select(F.col("conv_id").cast("long"), "seq", "kind", F.col("target").cast("long"), "role", "text")
    order = ["conv_id", "seq", "kind", "role", "text"]
    return e.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "target", "role", "text").transform(arrow, _formatted, _OUT)


def _digested(batches):
    for batch in batches:
        rows = []
        for c, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
            turns = read_back(text)
            loss = "".join(unescape(text[m["start"] : m["stop"]]) for m in mask)
            whole = hashlib.sha256()
            for role, body in turns:
                whole.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            rows.append((c, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def digests(formatted: DataFrame) -> DataFrame:
    """What reading formatted conversations back gives: turns, and texts under the loss mask."""
    return formatted.select("conv_id", "formatted", "mask").transform(arrow, _digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def messages_as_events(conversations: DataFrame) -> DataFrame:
    """Events of a table of whole messages (conv_id, turn, role, text)."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"), "role", "text")


def logged(conversations: DataFrame) -> DataFrame:
    """Events of a table of whole messages (conv_id, turn, role, text) as a client would log them: by a hash
    of turn and text a message arrives whole, or as its first half and a delta, or as a draft that an
    edit corrects, or as a draft that is regenerated and goes on by a delta. Folded, they give
    the messages, by turn, then role and text."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    event = lambda kind, content, role=None: F.struct(F.lit(kind).alias("kind"), (F.col("role") if role is None else role).alias("role"), content.alias("text"))
    none, draft = F.lit(None).cast("string"), F.concat(F.lit("draft of "), F.reverse(head))
    events = (
        F.when(F.col("way") == 0, F.array(event("message", F.col("text"))))
        .when(F.col("way") == 1, F.array(event("message", head), event("delta", tail, none)))
        .when(F.col("way") == 2, F.array(event("message", draft), event("edit", text, none)))
        .otherwise(F.array(event("message", draft), event("delta", F.lit(" and more"), none), event("regenerate", head, none), event("delta", tail, none)))
    )
    c = conversations.select("conv_id", "turn", "role", "text").withColumn("way", F.pmod(F.xxhash64("turn", "text"), F.lit(4)))
    # equal rows are interchangeable, but their events must not mix
    c = c.withColumn("copy", F.monotonically_increasing_id())
    one = c.select("conv_id", "turn", "role", "text", "copy", F.posexplode(events).alias("part", "event"))
    return one.select("conv_id", F.struct("turn", "role", "text", "copy", "part").alias("seq"), "event.kind", F.lit(None).cast("long").alias("target"), "event.role", "event.text")


#: The same digests in DuckDB's SQL, without formatting: lengths follow from the template.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, 12 + length(role) + 1 + length(text) + 10 + 1
  + len(regexp_extract_all(role || text, '\\|<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id
"""
