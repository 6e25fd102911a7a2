"""Conversations against a brute-force version, with small fragments and blocks so that paths cross many of them."""

import datetime
import random

import pytest

from graphloom.llm.conversations import conversations, with_texts

AT = datetime.datetime(2024, 1, 1)
SCHEMA = "chat_id string, user_id string, seq int, status string, user_text string, assistant_text string, turn_id string, loaded_at timestamp_ntz, role string, part int"


def row(chat, seq, user, answer, turn, status="done", late=0):
    return (chat, "u", seq, status, user, answer, turn, AT + datetime.timedelta(seconds=late) if late is not None else None, "clash", 7)


def said(text):
    return text is not None and any(c.isalnum() for c in text) and text.strip().lower() not in ("null", "нет ответа") and not text.strip().lower().startswith("[no ")


def brute(rows):
    latest = {}
    for r in rows:
        if r[6] is not None and (r[6] not in latest or (r[7] or datetime.datetime.min) > (latest[r[6]][7] or datetime.datetime.min)):
            latest[r[6]] = r
    chats = {}
    for r in latest.values():
        if r[0] is not None and r[0].strip():
            chats.setdefault(r[0], []).append(r)
    out = set()
    for chat, held in chats.items():
        if any(r[2] is None or r[3] != "done" or not (said(r[4]) or said(r[5])) for r in held):
            continue
        held.sort(key=lambda r: r[2])
        if [r[2] for r in held] != list(range(1, len(held) + 1)):
            continue
        talk = [(r[6], role, text) for r in held for role, text in (("user", r[4]), ("assistant", r[5])) if said(text)]
        if all(role == ("user", "assistant")[i % 2] for i, (_, role, _) in enumerate(talk)) and len(talk) % 2 == 0:
            out |= {(chat, i + 1, turn, role, text) for i, (turn, role, text) in enumerate(talk)}
    return out


def make(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        chat, n = f"c{c}", rng.choice([1, 2, 3, 5, 9, 17, 33])
        for seq in range(1, n + 1):
            # Few distinct texts, so that runs of neighbouring turns repeat.
            rows.append(row(chat, seq, rng.choice(["да", "ok", "again"]), rng.choice(["yes", "ok"]), f"{chat}-{seq}"))
        fault = rng.randrange(9)
        if fault == 0:
            rows.pop(-1 if n == 1 else -rng.randrange(1, n))
        elif fault == 1:
            rows.append(row(chat, n, "twice", "yes", f"{chat}-x"))
        elif fault == 2:
            rows.append(row(chat, None, "no number", "yes", f"{chat}-n"))
        elif fault == 3:
            rows.append(row(chat, n, "null", "[no answer at all, " + "really " * 20 + "]", f"{chat}-{n}", late=5))
        elif fault == 4:
            rows.append(row(chat, n, "later", "state", f"{chat}-{n}", status="running", late=5))
        elif fault == 5:
            rows.append(row(chat, n, "early", "state", f"{chat}-{n}", status="running", late=None))
        elif fault == 6:
            rows += [row(chat, n + 1, "question", None, f"{chat}-q"), row(chat, n + 2, None, "its answer", f"{chat}-a")]
    rows += [row(None, 1, "a", "b", "none"), row("  ", 1, "a", "b", "blank"), row("c0", 1, "a", "b", None), row("long", 1, "q" * 200_000, "...", "long-1")]
    rng.shuffle(rows)
    return rows + rows[:50]


@pytest.mark.parametrize(("stride", "block"), [(2, 2), (3, 4), (16, 256)])
def test_conversations_equal_brute_force(spark, stride, block):
    rows = make(stride)
    df = spark.createDataFrame(rows, SCHEMA)
    found = with_texts(conversations(df, stride=stride, block=block), df).collect()
    got = {(r["chat_id"], r["msg_no"], r["turn_id"], r["role"], r["text"]) for r in found}
    assert len(got) == len(found)
    want = brute(rows)
    assert len({w[0] for w in want}) > 15
    assert got == want


def test_empty_table(spark):
    assert conversations(spark.createDataFrame([], SCHEMA)).collect() == []
