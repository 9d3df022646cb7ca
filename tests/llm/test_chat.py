from __future__ import annotations

import itertools
import random

from farebox.llm import chat
from farebox.llm.chat import ENDING, MOVES, NEVER, STATES

START = [0, NEVER, NEVER, NEVER]


def brute(roles):
    """Least cost, and of equal ones the first by states compared from the end."""
    best = None
    for states in itertools.product(STATES, repeat=len(roles)):
        cost, at = 0, 0
        for role, to in zip(roles, states, strict=True):
            move = MOVES[role][at][to]
            if move is None:
                break
            cost, at = cost + move.cost, to
        else:
            if ENDING[at] is not None:
                best = min(best or (NEVER, ()), (cost + ENDING[at].cost, states[::-1]))
    return best[0], best[1][::-1]


def test_moves():
    user, assistant, system = 2, 3, 1
    assert MOVES[user][0][user].cost == 0 and MOVES[user][user][user].merged and MOVES[assistant][0][assistant].inserted == (user,)
    assert MOVES[system][assistant][system] is None and MOVES[0][user][assistant].cost == chat.RELABEL
    assert ENDING[user].inserted == (assistant,) and ENDING[assistant].cost == 0


def test_repair_and_its_pieces_against_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        roles = rng.choices(range(4), k=rng.randint(1, 6))
        table = chat.forward(roles, START)
        end = chat._ends_best(table[-1])
        states = chat.path(roles, START, end)
        assert (table[-1][end] + ENDING[end].cost, tuple(q for _, q in states)) == brute(roles)
        cuts = [0, *sorted(rng.sample(range(1, len(roles)), min(len(roles) - 1, 2))), len(roles)]
        parts = [roles[a:b] for a, b in itertools.pairwise(cuts)]
        joined = chat.join_pieces([chat.summary(p) for p in parts])
        assert [s for p, (costs, last, _, _) in zip(parts, joined, strict=True) for s in chat.path(p, costs, last)] == states
        turns = [(i, r, "t") for i, r in enumerate(roles)]
        whole = list(chat.written(1, turns, START, end, 0, 0, True))
        pieces, at = [], 0
        for p, (costs, last, before, merged) in zip(parts, joined, strict=True):
            pieces += chat.written(1, turns[at : at + len(p)], costs, last, before, merged, at + len(p) == len(roles))
            at += len(p)
        assert pieces == whole


def test_conversation_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant", "system", None, "Human "]), f"t{i}") for i in range(400)]
    rows += [(2, None, "assistant", None)] * 3 + [(None, 0, "user", "q"), (3, 0, "user", "hi"), (3, 1, "gpt", "yo" * 20_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS seq")
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.repair(frame).orderBy("conv_id", "position", "part").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)
    turns = [(t, chat.role_code(r), x) for c, t, r, x in rows if c == 1]
    end = chat._ends_best(chat.forward([t[1] for t in turns], START)[-1])
    assert [tuple(r) for r in got if r.conv_id == 1] == list(chat.written(1, turns, START, end, 0, 0, True))
    text = {c: "".join(r.rendered for r in got if r.conv_id == c) for c in (2, 3, None)}
    assert text[2] == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert text[None] == "<|user|>\nq<|end|>\n<|assistant|>\n<|end|>\n"
    assert text[3] == f"<|user|>\nhi<|end|>\n<|assistant|>\n{'yo' * 20_000}<|end|>\n"
    assert chat.repair(frame.limit(0)).count() == 0


def test_equal_turns_without_a_number_are_turns(spark):
    rows = [(1, None, "user", "ok")] * 3 + [(2, 0, "user", "ok")] * 3 + [(3, None, "assistant", None)] * 2 + [(4, None, "user", "")] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.repair(frame).orderBy("conv_id", "position", "part").collect()
    for conv_id, turns in {1: [(None, 2, "ok")] * 3, 2: [(0, 2, "ok")], 3: [(None, 3, "")], 4: [(None, 2, "")] * 2}.items():
        end = chat._ends_best(chat.forward([t[1] for t in turns], START)[-1])
        assert [tuple(r) for r in got if r.conv_id == conv_id] == list(chat.written(conv_id, turns, START, end, 0, 0, True))
    assert "".join(r.rendered for r in got if r.conv_id == 1).count("ok") == 3
