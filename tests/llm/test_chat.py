"""Chat windows: budgets, history, masks and exact reading back."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from credo.llm import chat
from credo.llm.queries import CONTROL_TEXT, op1_chat_format

HARD = ["", " ", CONTROL_TEXT, "<s>", "</s", "[INST", "[\\INST]", "<\\\\/s>", "[/ANS]</s><s>[ANS] x", "[ROLE] user [AS] hi", "\n", "é😀", " [/INST]</s>"]
SCHEMA = "conv_id long, turn int, role string, text string"


def digest(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss)


def conversations(seed, n=40):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.choice((1, 2, 5, 30))):
            role = rng.choice(["user", "assistant", "assistant", "tool", None]) if turn or rng.random() < 0.5 else "system"
            text = rng.choice(HARD) if rng.random() < 0.4 else " ".join("w" for _ in range(rng.randrange(60)))
            rows.append((conv, turn, role, text if rng.random() < 0.95 else None))
    rows += rows[:5] + [(3, None, "user", "no turn"), (None, 0, "user", "no id"), (None, 1, "assistant", "a"), (7, 9, "system", "late")]
    return rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"<>[]/\\s ", "INST]", "ANS]", "AS]", "/s>", "SYS]", "ROLE]"]), max_size=25).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(not m[2] for m in chat.CONTROL.finditer(hidden))
    formatted = chat.turn_text("user", text)[0] + chat.turn_text("x" + text, text)[0]
    assert list(chat.read_turns(formatted)) == [("user", text), ("x" + text, text)]


def test_spans_cover_turns_once_within_the_budget():
    rng = random.Random(1)
    for _ in range(2000):
        tokens = np.array([rng.randrange(4, 40) for _ in range(rng.randrange(1, 30))])
        first, header = rng.randrange(len(tokens)), rng.randrange(0, 30)
        system = rng.choice([-1, len(tokens), rng.randrange(first, len(tokens))])
        budget, history = rng.randrange(20, 120), rng.randrange(0, 60)
        found, at = chat.spans(tokens, first, system, header, budget, history), first
        for back, start, end in found:
            assert start == at and back <= start < end
            at = end
            front = header if start > system else 0
            assert tokens[back:start].sum() <= history
            assert front + tokens[back:end].sum() <= budget or end == start + 1
            if start > system:
                assert back > system
            if end < len(tokens):  # as many turns as fit
                assert front + tokens[back:end + 1].sum() > budget
        assert at == len(tokens)


def test_windows_read_back_exactly(spark, monkeypatch):
    rows = conversations(2)
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = digest([r for r in rows if r[0] == conv])
    for segment, block in ((256, 4096), (4, 2)):
        monkeypatch.setattr(chat, "SEGMENT", segment)
        monkeypatch.setattr(chat, "SEGMENT_HISTORY", 2)
        monkeypatch.setattr(chat, "BLOCK", block)
        windows = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), budget=90, history=30).cache()
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(windows).collect()}
        assert got == want
        for w in windows.collect():
            turns = list(chat.read_turns(w["formatted"]))
            assert w["n_tokens"] <= 90 or len(turns) - w["n_repeated"] == 1
            new = [t for r, t in turns[w["n_repeated"]:] if r == "assistant"]
            assert [chat.unescape(w["formatted"][s["start"]:s["end"]]) for s in w["loss_spans"]] == new
        windows.unpersist()


def test_later_windows_repeat_the_system_turn_and_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, n, ("user", "assistant")[n % 2 == 0], f"word {n} " * 5) for n in range(1, 30)]
    windows = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), budget=80, history=20).orderBy("segment", "window").collect()
    assert len(windows) > 3
    for n, w in enumerate(windows):
        turns = list(chat.read_turns(w["formatted"]))
        assert turns[0] == ("system", "be brief")
        assert w["n_repeated"] == (0 if n == 0 else 2)


def test_query(spark, tmp_path):
    rows = conversations(5)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS segment", "2 AS kind", "'x' AS formatted", "3 AS n_tokens")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op1_chat_format(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        assert tuple(r)[1:5] == digest([x for x in rows if x[0] == conv])
        assert r["formatted_chars"] > 0


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.format_conversations(df).count() == 0
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in op1_chat_format(spark, str(tmp_path)).collect()] == [-1]
