"""Chat formatting into budgeted, turn-aligned windows.

A conversation's turns become one or more windows.  Prefix sums of the turns'
token counts choose how many whole turns fit a window; each later window also
repeats the system turn and the last turns before it, up to a limit, and masks
those: the loss covers each assistant text once, where it is new.  A turn that
is longer than the budget gets a window of its own and stays whole.

The template puts marks around each turn.  Control strings inside a text (or a
role) get a backslash after their first character, and those that already have
backslashes there one more, so that the texts can be read back exactly.

Conversations are dealt out by segments of ``SEGMENT`` turn numbers, so a huge
one is shared by many tasks; a task streams through its sorted rows and holds
one block of at most ``BLOCK`` turns.  Windows don't cross segments; history
does, as far as ``SEGMENT_HISTORY`` turn numbers back.

Null texts and roles count as empty.  A null turn number sorts first; equal
turn numbers go by role, then text; repeated rows are turns of their own.  An
empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credo.llm.common import WORD, text_or_empty

#: Most tokens (words and marks) of a window, and of the history it repeats.
BUDGET, HISTORY = 1024, 256
#: Tokens that the marks of a turn count.
MARK_TOKENS = 4
SEGMENT, SEGMENT_HISTORY, BLOCK = 256, 64, 4096

NAMES = {"system": "SYS", "user": "INST", "assistant": "ANS"}
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?(?:SYS|INST|ANS|ROLE)\]|AS\])")
TURN = re.compile(r"<s>\[(SYS|INST|ANS|ROLE)\] (.*?) \[/\1\]</s>", re.DOTALL)
ROLES = {v: k for k, v in NAMES.items()}


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its (escaped) text starts and ends in it."""
    name = NAMES.get(role)
    front = f"<s>[{name}] " if name else f"<s>[ROLE] {escape(role)} [AS] "
    body = escape(text)
    return f"{front}{body} [/{name or 'ROLE'}]</s>", len(front), len(front) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted window."""
    for name, body in TURN.findall(formatted):
        if name == "ROLE":
            role, _, body = body.partition(" [AS] ")
            yield unescape(role), unescape(body)
        else:
            yield ROLES[name], unescape(body)


def spans(tokens: np.ndarray, first: int, system: int, header: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """Turn-aligned windows over ``tokens[first:]``: (first repeated turn, first new turn, end).

    Turns before ``first`` serve as history only.  Windows that start after
    turn ``system`` repeat the system turn, which takes ``header`` tokens.
    """
    sums, out, start = np.r_[0, np.cumsum(tokens)], [], first
    while start < len(tokens):
        room = budget - header if start > system else budget
        # history as allowed, but the first new turn comes before it
        least = max(sums[start] - history, sums[start + 1] - room)
        back = min(start, int(np.searchsorted(sums, least, side="left")))
        if start > system:
            back = max(back, system + 1)
        end = int(np.searchsorted(sums, sums[back] + room, side="right")) - 1
        end = max(end, start + 1)
        out.append((back, start, end))
        start = end
    return out


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of the conversations in ``turns`` (conv_id, turn, role, text).

    One row for each window: conv_id, segment, window (its order: by segment,
    then window), n_repeated (turns in front that earlier windows have),
    n_tokens, formatted and loss_spans, the code points of ``formatted`` that
    the loss covers.
    """
    key = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))
    rows = turns.select(
        "conv_id",
        F.floor(key / SEGMENT).cast("long").alias("segment"),
        F.lit(2).alias("kind"),
        key.alias("at"),
        text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
    )
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + MARK_TOKENS)
    late = F.pmod(F.col("at"), F.lit(SEGMENT)) >= SEGMENT - SEGMENT_HISTORY
    before = rows.filter(late).withColumns({"segment": F.col("segment") + 1, "kind": F.lit(1)})
    # the first system turn of all earlier segments, for each segment
    system = F.struct("at", "role", "text", "tokens")
    first = rows.groupBy("conv_id", "segment").agg(F.min(F.when(F.col("role") == "system", system)).alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    headers = first.withColumn("s", F.first("s", ignorenulls=True).over(earlier)).filter("s is not null")
    headers = headers.select("conv_id", "segment", F.lit(0).alias("kind"), "s.at", "s.role", "s.text", "s.tokens")
    order = ["conv_id", "segment", "kind", "at", "role", "text"]
    dealt = rows.unionByName(before).unionByName(headers).repartition("conv_id", "segment").sortWithinPartitions(*order)
    kind = dict(turns.select("conv_id").dtypes)["conv_id"]
    schema = f"conv_id {kind}, segment long, window long, n_repeated int, n_tokens long, formatted string, loss_spans array<struct<start:int,end:int>>"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(ARROW)

        def stream() -> Iterator[dict]:
            for batch in batches:
                kinds["conv_id"] = batch.schema.field("conv_id").type
                yield from batch.to_pylist()

        for row in windows(stream()):
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds[n]) for n, v in zip(names, row)], names=names)

    def windows(stream: Iterable[dict]) -> Iterator[tuple]:
        group, header, old, new, number = None, None, [], [], 0

        def flush() -> Iterator[tuple]:
            nonlocal old, new, number, header
            if not new:
                return
            both = old + new
            system = -1
            if header is None:
                system = next((i for i in range(len(old), len(both)) if both[i][0] == "system"), len(both))
            front = header or (both[system] if system < len(both) else None)
            tokens = np.array([t[2] for t in both], dtype=np.int64)
            for back, start, end in spans(tokens, len(old), system, front[2] if front else 0, budget, history):
                again = [front] if front and start > system else []
                yield group[0], group[1], number, *built(again + both[back:start], both[start:end])
                number += 1
            after = both if front is header else both[system + 1:] if front else both
            kept = int(np.searchsorted(np.cumsum([t[2] for t in after[::-1]]), history, side="right"))
            header, old, new = front, after[len(after) - kept:], []

        for row in stream:
            if group != (row["conv_id"], row["segment"]):
                yield from flush()
                group, header, old, new, number = (row["conv_id"], row["segment"]), None, [], [], 0
            turn = (row["role"], row["text"], row["tokens"])
            if row["kind"] == 0:
                header = turn
            elif row["kind"] == 1:
                if not (turn[0] == "system" and header == turn):
                    old.append(turn)
            else:
                new.append(turn)
                if len(new) >= BLOCK:
                    yield from flush()
        yield from flush()

    return dealt.mapInArrow(run, schema)


ARROW = {"segment": pa.int64(), "window": pa.int64(), "n_repeated": pa.int32(), "n_tokens": pa.int64(), "formatted": pa.string(),
         "loss_spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}


def built(repeated: list[tuple], new: list[tuple]) -> tuple:
    """n_repeated, n_tokens, text and loss spans of a window."""
    parts, loss, at = [], [], 0
    for n, (role, text, _) in enumerate(repeated + new):
        part, start, end = turn_text(role, text)
        if role == "assistant" and n >= len(repeated):
            loss.append({"start": at + start, "end": at + end})
        parts.append(part)
        at += len(part)
    return len(repeated), sum(t[2] for t in repeated + new), "".join(parts), loss


def digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows in order.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn
    that a window doesn't repeat), loss_chars, loss_sha256 (the text under the
    loss mask, unescaped) and formatted_chars.
    """
    kind = dict(windows.dtypes)["conv_id"]
    order = ["conv_id", "segment", "window"]
    dealt = windows.select(*order, "n_repeated", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None

        def row() -> pa.RecordBatch:
            n, turns, chars, loss, formatted = state
            values = (group[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted)
            return pa.RecordBatch.from_arrays([pa.array([v], ids if n == "conv_id" else None) for n, v in zip(NAMES_OUT, values)], names=NAMES_OUT)

        ids = None
        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for w in batch.to_pylist():
                if group != (w["conv_id"],):
                    if group:
                        yield row()
                    group, state = (w["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for n, (role, text) in enumerate(read_turns(w["formatted"])):
                    if n >= w["n_repeated"]:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                for span in w["loss_spans"]:
                    text = unescape(w["formatted"][span["start"]:span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(w["formatted"])
        if group:
            yield row()

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


NAMES_OUT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
