"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, first user, last assistant.  The automaton's state is the role
of the last turn written.  Each input turn is kept (0), merged into the open
turn of its role (1), relabelled (2), or both (3), and empty turns may be
inserted before it or at the end (3 each); dynamic programming finds the
cheapest way.

A step is a min-plus matrix over the states, so segments of a conversation are
solved apart and their matrices composed, group by group and level by level;
the path is then read off downwards, inside each group and at last inside each
segment.  A conversation of any length is spread over many tasks.  Only roles
go through the solver; texts meet what is written around them by their row.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.common import saved

#: Automaton: the roles that may follow a state.
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
STATES = tuple(NEXT)
ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
SEGMENT, GROUP = 512, 256
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


@functools.cache
def inserts(state: str, goal: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    """For each role in ``goal`` that can be written next, the fewest empty turns to write first."""
    found: dict[str, tuple[str, ...]] = {}
    for n in range(3):
        for path in itertools.product(ROLES, repeat=n):
            at = [state, *path]
            if all(b in NEXT[a] for a, b in itertools.pairwise(at)):
                for role in NEXT[at[-1]]:
                    if role in goal:
                        found.setdefault(role, path)
    return found


@functools.cache
def moves(state: str, role: str | None) -> tuple[tuple[int, str, str, tuple[str, ...]], ...]:
    """(cost, state after, action, roles inserted before) for a turn of ``role``, the preferred first."""
    out = []
    if state != "start":
        out.append((MERGE + (RELABEL if role != state else 0), state, "merge" if role == state else "relabel+merge", ()))
    for to, before in inserts(state, ROLES).items():
        out.append((INSERT * len(before) + (RELABEL if to != role else 0), to, "keep" if to == role else "relabel", before))
    rank = {"keep": 0, "merge": 1, "relabel": 2, "relabel+merge": 3}
    return tuple(sorted(out, key=lambda x: (x[0], len(x[3]), rank[x[2]], x[1])))


def ending(state: str) -> tuple[int, tuple[str, ...]]:
    """Cost and roles of the empty turns that a conversation in ``state`` still needs."""
    if state == "assistant":
        return 0, ()
    before = inserts(state, ("assistant",))["assistant"]
    return INSERT * (len(before) + 1), (*before, "assistant")


@functools.lru_cache(4096)
def solve(roles: tuple[str | None, ...], start: str) -> dict[str, tuple[int, list]]:
    """For each state in which the turns can end: the least cost from ``start`` and the moves taken."""
    best: dict[str, tuple[int, tuple | None]] = {start: (0, None)}
    for role in roles:
        new: dict[str, tuple[int, tuple | None]] = {}
        for state, (cost, path) in best.items():
            for extra, to, action, before in moves(state, role):
                if to not in new or cost + extra < new[to][0]:
                    new[to] = (cost + extra, (path, (action, to, before)))
        best = {s: new[s] for s in STATES if s in new}
    out = {}
    for state, (cost, path) in best.items():
        steps = []
        while path:
            path, step = path[0], path[1]
            steps.append(step)
        out[state] = (cost, steps[::-1])
    return out


def _runs(pdf: pd.DataFrame, keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each key, ordered by the first of ``columns``."""
    ordered = pdf.sort_values([*keys, columns[0]], kind="stable")
    rows = zip(*(ordered[c].tolist() for c in [*keys, *columns]), strict=True)
    for key, own in itertools.groupby(rows, key=lambda x: x[: len(keys)]):
        yield key, [x[len(keys) :] for x in own]


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows``, written once, with ``row`` (a number of its own) and ``position`` (from 0) in its group by ``order``.

    The table is range-sorted by group and order, so neither a group nor rows
    that are equal in all but their texts are gathered in one task; what is
    counted is how many rows of a group each partition has.  ``order`` is of
    short columns, as the sort's bounds are sampled through the driver.
    """
    ends = [F.col(group), *order]
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism * 4)
    placed = saved(rows.repartitionByRange(parts, *ends).sortWithinPartitions(*ends).withColumn("row", F.monotonically_increasing_id()))
    slices = placed.groupBy(group, F.shiftright("row", 33).alias("_slice")).agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = placed.withColumn("_slice", F.shiftright("row", 33)).join(slices, [group, "_slice"])
    return out.withColumn("position", F.col("_before") + F.col("row") - F.col("_first")).drop("_slice", "_first", "_before")


def _through(own: list[tuple], start: str | None, end: str | None) -> tuple[int, list[tuple]]:
    """The cheapest way through ``(number, a, b, cost)`` in order of number, from ``start`` to ``end`` (None: wherever a conversation ends best): cost, and (number, a, b) of each."""
    best: dict[str, tuple[int, tuple | None]] = {start: (0, None)}
    for number, steps in itertools.groupby(own, key=lambda x: x[0]):
        new: dict[str, tuple[int, tuple | None]] = {}
        for _, a, b, cost in sorted(steps, key=lambda x: (STATES.index(x[1]), STATES.index(x[2]))):
            if a in best and (b not in new or best[a][0] + cost < new[b][0]):
                new[b] = (best[a][0] + int(cost), (best[a][1], number, a, b))
        best = new
    if end is None:
        end = min(best, key=lambda s: (best[s][0] + ending(s)[0], STATES.index(s)))
        total = best[end][0] + ending(end)[0]
    elif end not in best:
        return -1, []
    else:
        total = best[end][0]
    path, steps = best[end][1], []
    while path:
        path, step = path[0], path[1:]
        steps.append(step)
    return total, steps[::-1]


def repair(turns: DataFrame, segment: int = SEGMENT, group: int = GROUP) -> DataFrame:
    """``(conv_id, position, turn, role, new_role, action, inserted, cost, piece)``, one row for each row of ``turns(conv_id, turn, role, text)``.

    Turns are in the order of ``turn`` (null first; ties by role and the hash of the text).
    ``inserted`` are the empty turns written before this one and, on the last
    row, after it.  ``cost`` is the conversation's.  The pieces of a
    conversation, in order of ``position``, are its rendered form.  A role that
    is null or unknown is relabelled; a null text is empty; a null ``conv_id``
    is a conversation of its own.  Repeated rows are turns each; other columns
    are ignored; an empty table gives no rows.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("conv", F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.col("conv_id").cast("string")))
    rows = positions(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.md5(F.col("text").cast("binary"))])
    roles = saved(rows.select("row", "conv", "position", "role", F.floor(F.col("position") / segment).cast("long").alias("segment")))

    # Many segments share a call: a call has some 20,000 roles, whatever their conversations.
    calls = F.lit(max(8, roles.count() // 20_000))
    dealt = lambda *names: F.pmod(F.xxhash64(*names), calls)
    step = "conv string, segment long, a string, b string, cost long"

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (conv, number), own in _runs(pdf, ["conv", "segment"], ["position", "role"]):
            pattern = tuple(r if isinstance(r, str) else None for _, r in own)
            out += [(conv, number, s, to, cost) for s in STATES for to, (cost, _) in solve(pattern, s).items()]
        return pd.DataFrame(out, columns=["conv", "segment", "a", "b", "cost"])

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        """The matrices of groups of segments."""
        out = []
        for (conv, number), own in _runs(pdf, ["conv", "up"], ["segment", "a", "b", "cost"]):
            for a, b in itertools.product(STATES, STATES):
                cost, _ = _through(own, a, b)
                if cost >= 0:
                    out.append((conv, number, a, b, cost))
        return pd.DataFrame(out, columns=["conv", "segment", "a", "b", "cost"])

    # Upwards until every conversation is one group.
    levels = [saved(roles.withColumn("part", dealt("conv", "segment")).groupBy("part").applyInPandas(matrix, step))]
    most = (roles.agg(F.max("segment")).first()[0] or 0) + 1
    while most > group:
        up = levels[-1].withColumn("up", F.floor(F.col("segment") / group).cast("long"))
        levels.append(saved(up.withColumn("part", dealt("conv", "up")).groupBy("part").applyInPandas(product, step)))
        most = -(-most // group)

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        """Through which states the cheapest path enters and leaves each piece of a conversation."""
        out = []
        for (conv,), own in _runs(pdf, ["conv"], ["segment", "a", "b", "cost"]):
            total, steps = _through(own, "start", None)
            out += [(conv, number, a, b, total, k == len(steps) - 1) for k, (number, a, b) in enumerate(steps)]
        return pd.DataFrame(out, columns=["conv", "segment", "a", "b", "cost", "ends"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        """The same inside a group that the path enters and leaves as told."""
        out = []
        for (conv, _), own in _runs(pdf, ["conv", "up"], ["segment", "a", "b", "cost", "ua", "ub", "total", "uends"]):
            _, steps = _through([x[:4] for x in own], own[0][4], own[0][5])
            out += [(conv, number, a, b, own[0][6], bool(own[0][7]) and k == len(steps) - 1) for k, (number, a, b) in enumerate(steps)]
        return pd.DataFrame(out, columns=["conv", "segment", "a", "b", "cost", "ends"])

    told = step + ", ends boolean"
    chosen = levels[-1].withColumn("part", dealt("conv")).groupBy("part").applyInPandas(top, told)
    for lower in levels[-2::-1]:
        above = saved(chosen).select("conv", F.col("segment").alias("up"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("cost").alias("total"), F.col("ends").alias("uends"))
        both = lower.withColumn("up", F.floor(F.col("segment") / group).cast("long")).join(above, ["conv", "up"])
        chosen = both.withColumn("part", dealt("conv", "up")).groupBy("part").applyInPandas(inside, told)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        """What is written before and after each turn's text."""
        out = []
        for _, own in _runs(pdf, ["conv", "segment"], ["position", "row", "role", "a", "b", "cost", "ends"]):
            pattern = tuple(x[2] if isinstance(x[2], str) else None for x in own)
            state = own[0][3]
            steps = solve(pattern, state)[own[0][4]][1]
            for k, ((action, to, before), x) in enumerate(zip(steps, own, strict=True)):
                head, tail = "", ""
                for new in before:
                    head += (CLOSE if state != "start" else "") + OPEN.format(new)
                    state = new
                head += "\n" if action.endswith("merge") else (CLOSE if state != "start" else "") + OPEN.format(to)
                state, after = to, ()
                if k == len(steps) - 1 and x[6]:
                    after = ending(state)[1]
                    tail = CLOSE + "".join(OPEN.format(new) + CLOSE for new in after)
                out.append((x[1], to, action, [*before, *after], x[5], head, tail))
        return pd.DataFrame(out, columns=["row", "new_role", "action", "inserted", "cost", "head", "tail"])

    solved = roles.join(chosen, ["conv", "segment"]).withColumn("part", dealt("conv", "segment"))
    written = solved.groupBy("part").applyInPandas(write, "row long, new_role string, action string, inserted array<string>, cost long, head string, tail string")
    return rows.join(written, "row").select("conv_id", "position", "turn", "role", "new_role", "action", "inserted", "cost", F.concat("head", "text", "tail").alias("piece"))
