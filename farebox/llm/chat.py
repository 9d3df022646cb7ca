"""Chat formatting: the cheapest repair of a conversation's roles, found by dynamic programming over legal turns.

A legal conversation has at most one system turn, first; then user and assistant turns by turns from a user turn on; and
ends with an assistant turn. A turn that doesn't fit may be merged into the turn before it, be given another role, or
have empty turns put before it. The state is the role of the last turn written; among repairs of equal cost the one is
taken whose states, compared from the last turn backwards, come first in the order of ROLES.

A conversation may be larger than a task. Turns are sorted over the cluster; each sorted partition holds pieces of
conversations. A piece of a conversation that spans partitions is first summed up as a small table: cost, number of
turns and precedence by state at its start and end. These few tables are put together per conversation, and give every
piece the costs it starts with and the state it must end in. Then all pieces are written, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.text import small_batches
from farebox.session import cut

ROLES = ("", "system", "user", "assistant")  # "" is the start, before any turn
SAME_ROLE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}
FOLLOWS = ((1, 2), (2,), (3,), (2,))  # by state: roles of a legal next turn
LAST = 3  # the state a conversation ends in
MERGE, RELABEL, INSERT = 2, 3, 4
STATES = range(len(ROLES))
NEVER = 1 << 40


def role_code(role: str | None) -> int:
    """Index in ROLES; 0 for a role that is missing or unknown, which only a new label mends."""
    low = (role or "").strip().lower()
    low = SAME_ROLE.get(low, low)
    return ROLES.index(low) if low in ROLES[1:] else 0


@dataclass(frozen=True)
class Move:
    """How a turn is written as role `to` after state `since`."""

    cost: int
    inserted: tuple[int, ...] = ()
    merged: bool = False

    @property
    def turns(self) -> int:
        return len(self.inserted) + (not self.merged)


def _inserted(since: int, to: int) -> tuple[int, ...] | None:
    """Fewest empty turns that make a turn `to` legal after `since`."""
    paths = [((), since)]
    for _ in ROLES:
        for path, state in paths:
            if to in FOLLOWS[state]:
                return path
        paths = [((*path, x), x) for path, state in paths for x in FOLLOWS[state]]
    return None


def _move(role: int, since: int, to: int) -> Move | None:
    if to == 0:
        return None
    label = 0 if role == to else RELABEL
    empty = _inserted(since, to)
    options = [] if empty is None else [Move(label + INSERT * len(empty), empty)]
    if since == to:
        options.append(Move(label + MERGE, merged=True))
    return min(options, key=lambda m: (m.cost, m.merged), default=None)


MOVES = [[[_move(r, p, q) for q in STATES] for p in STATES] for r in STATES]  # by role of the turn, state before, after


def _ending(state: int) -> Move | None:
    """The empty turns that end a conversation."""
    if state == LAST:
        return Move(0)
    path = _inserted(state, LAST)
    return None if path is None else Move(INSERT * (len(path) + 1), (*path, LAST))


ENDING = [_ending(q) for q in STATES]


def forward(roles: list[int], costs: list[int]) -> list[list[int]]:
    """By turn, and once more at the end: least cost by state, from given costs at the start."""
    out = [costs]
    for r in roles:
        here = out[-1]
        out.append([
            min((here[p] + m.cost for p in STATES if (m := MOVES[r][p][q]) is not None), default=NEVER) for q in STATES
        ])
    return out


def path(roles: list[int], costs: list[int], end: int) -> list[tuple[int, int]]:
    """The states before and after each turn of the repair that ends in `end`."""
    table, out = forward(roles, costs), []
    for i in range(len(roles) - 1, -1, -1):
        moves = MOVES[roles[i]]
        before = next(
            p for p in STATES if moves[p][end] is not None and table[i][p] + moves[p][end].cost == table[i + 1][end]
        )
        out.append((before, end))
        end = before
    return out[::-1]


def summary(roles: list[int]) -> list[list[list[int]]]:
    """Of a piece, by state at its start and its end: cost, precedence among the starts, turns written, and how many
    turns were merged into the last one written (into the one before the piece if none is written)."""
    size = len(ROLES)
    cost = [[0 if p == q else NEVER for q in STATES] for p in STATES]
    rank, turns, parts = ([[0] * size for _ in STATES] for _ in range(3))
    for r in roles:
        old = cost, rank, turns, parts
        cost, rank, turns, parts = [[NEVER] * size for _ in STATES], *([[0] * size for _ in STATES] for _ in range(3))
        for q in STATES:
            order = []
            for p in STATES:
                options = [(old[0][p][m] + MOVES[r][m][q].cost, m) for m in STATES if MOVES[r][m][q] is not None]
                best, via = min(options, default=(NEVER, 0))
                if best < NEVER:
                    move = MOVES[r][via][q]
                    cost[p][q] = best
                    turns[p][q] = old[2][p][via] + move.turns
                    parts[p][q] = old[3][p][via] + 1 if move.merged else 0
                    order.append((via, old[1][p][via], p))
            for place, (_, _, p) in enumerate(sorted(order)):
                rank[p][q] = place
    return [cost, rank, turns, parts]


def _ends_best(costs: list[int]) -> int:
    return min((costs[q] + ENDING[q].cost, q) for q in STATES if ENDING[q] is not None)[1]


def join_pieces(pieces: list[list]) -> list[tuple[list[int], int, int, int]]:
    """From summaries in order: of each piece the costs at its start and the state at its end, how many turns were
    written before it, and how many were merged into the last of these."""
    costs = [[0] + [NEVER] * (len(ROLES) - 1)]
    for cost, *_ in pieces:
        costs.append([min(min(costs[-1][p] + cost[p][q], NEVER) for p in STATES) for q in STATES])
    end, steps = _ends_best(costs[-1]), []
    for i in range(len(pieces) - 1, -1, -1):
        cost, rank, turns, parts = pieces[i]
        starts = [p for p in STATES if costs[i][p] + cost[p][end] == costs[i + 1][end] and cost[p][end] < NEVER]
        start = min(starts, key=lambda p: rank[p][end])
        steps.append((costs[i], end, turns[start][end], parts[start][end]))
        end = start
    out, before, merged = [], 0, 0
    for at_start, end, n, m in steps[::-1]:
        out.append((at_start, end, before, merged))
        before, merged = before + n, m if n else merged + m
    return out


def _rendered(role: int, text: str, merged: bool, first: bool) -> str:
    if merged:
        return "\n\n" + text
    return ("" if first else "<|end|>\n") + f"<|{ROLES[role]}|>\n{text}"


_ROW = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("part", T.LongType()),
    T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("cost", T.LongType()), T.StructField("rendered", T.StringType()),
])


def written(conv_id, turns: list[tuple], costs: list[int], end: int, before: int, merged: int, closes: bool) -> Iterator[tuple]:
    """Rows of a repaired piece; turns: number, role code, text. `closes`: the conversation ends with this piece."""
    position, part = before - 1, merged
    states = path([t[1] for t in turns], costs, end)
    for i, ((number, role, text), (since, to)) in enumerate(zip(turns, states, strict=True)):
        move = MOVES[role][since][to]
        for x in move.inserted:
            position, part = position + 1, 0
            yield conv_id, position, 0, None, ROLES[x], "insert", INSERT, _rendered(x, "", False, position == 0)
        if move.merged:
            part += 1
        else:
            position, part = position + 1, 0
        kind = "+".join(k for k, on in (("relabel", role != to), ("merge", move.merged)) if on) or "keep"
        text = _rendered(to, text, move.merged, position == 0)
        last = closes and i == len(turns) - 1
        ending = ENDING[to].inserted if last else ()
        done = "<|end|>\n" if last and not ending else ""
        yield conv_id, position, part, number, ROLES[to], kind, move.cost - INSERT * len(move.inserted), text + done
        for k, x in enumerate(ending):
            position += 1
            done = "<|end|>\n" if k == len(ending) - 1 else ""
            yield conv_id, position, 0, None, ROLES[x], "insert", INSERT, _rendered(x, "", False, False) + done


def _sum_up(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq")
    flat = [x for table in summary(rows["code"].tolist()) for line in table for x in line]
    return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "piece": rows["piece"].iloc[:1], "tables": [flat]})


def _put_together(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("piece")
    n = len(ROLES)
    cubes = [[[list(f[k + i * n : k + (i + 1) * n]) for i in range(n)] for k in range(0, len(f), n * n)] for f in rows["tables"]]
    starts, ends, before, merged = zip(*join_pieces(cubes), strict=True)
    closes = [False] * (len(rows) - 1) + [True]
    return rows[["conv_id", "piece"]].assign(costs=list(starts), end_state=ends, before=before, merged=merged, closes=closes)


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired and rendered turns: `conv_id, position, part, turn, role, action, cost, rendered`.

    One row per turn read and per empty turn put in. position numbers the written turns of a conversation from 0; part
    numbers what is merged into one of them. action is keep, merge, relabel, relabel+merge or insert. `rendered` put
    together by position and part is the text of a conversation.

    Turns are taken in order of turn (null first), role, and a hash of the text. Rows equal in conv_id, turn, role and
    text are one turn if they have a number, or neither number nor text; without a number, each with a text is a turn. A null conv_id is a conversation of its own; a null text is empty; a null or unknown role is
    given the cheapest one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text.alias("text"),
        F.col("text").isNotNull().alias("told"),
    )
    alike = F.col("turn").isNotNull() | ~F.col("told")
    once = rows.where(alike).drop("told").dropDuplicates().withColumn("copy", F.lit(0).cast("long"))
    each = rows.where(~alike).drop("told").withColumn("copy", F.monotonically_increasing_id())  # so that many copies are split
    rows = once.union(each).withColumn("mark", F.xxhash64("text"))
    keys = ["conv_id", "turn", "role", "mark", "copy"]
    number = F.monotonically_increasing_id()
    ordered = cut(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
        .select("conv_id", "turn", "role", "text", number.alias("seq")),
        "turns",
    ).withColumn("piece", F.shiftright("seq", 33))

    code = F.lit(0)
    known = F.lower(F.trim("role"))
    for name in [*ROLES[1:], *SAME_ROLE]:
        code = F.when(known == name, F.lit(role_code(name))).otherwise(code)
    ordered = ordered.withColumn("code", code)

    spans = ordered.groupBy("conv_id").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a < b")
    spans = spans.select(F.col("conv_id").alias("spanning"))
    pieces = (
        ordered.select("conv_id", "piece", "seq", "code")
        .join(spans, F.col("conv_id").eqNullSafe(F.col("spanning")), "left_semi")
        .groupBy("conv_id", "piece").applyInPandas(_sum_up, "conv_id long, piece long, tables array<long>")
        .groupBy("conv_id").applyInPandas(
            _put_together, "conv_id long, piece long, costs array<long>, end_state int, before long, merged long, closes boolean"
        )
    )
    pieces = pieces.select(
        F.col("conv_id").alias("c"), F.col("piece").alias("p"), "costs", "end_state", "before", "merged", "closes"
    )
    whole = ordered.join(
        pieces, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")), "left"
    ).select("conv_id", "piece", "seq", "turn", "code", "text", "costs", "end_state", "before", "merged", "closes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, facts, out, held = None, [], None, [], 0

        def close() -> Iterator[tuple]:
            if facts[0] is None:
                costs = [0] + [NEVER] * (len(ROLES) - 1)
                yield from written(key[1], turns, costs, _ends_best(forward([t[1] for t in turns], costs)[-1]), 0, 0, True)
            else:
                yield from written(key[1], turns, *facts)

        for batch in small_batches(batches):
            for conv_id, piece, _, turn, role, content, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (piece, conv_id) != key:
                    if turns:
                        out.extend(close())
                    key, turns, facts = (piece, conv_id), [], more
                turns.append((turn, role, content))
                held += 1
            if held > 5_000:
                yield _as_batch(out)
                out, held = [], 0
        if turns:
            out.extend(close())
        yield _as_batch(out)

    return whole.repartition("piece").sortWithinPartitions("piece", "seq").mapInArrow(run, _ROW)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    cols = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=_ROW.names)
