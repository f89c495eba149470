"""Incremental upkeep of built patches, and replayable sequences, as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spheregrid.operators.quadtree import NODE, select_leaves


#: Bits of a node's place within its level, and of its level, in the number it is kept as.
_PLACE, _LEVEL = 26, 6


def maintain_patches(cameras: DataFrame, radius: float, max_level: int, budget: int, factor: float = 2.5, idle: int | None = None) -> DataFrame:
    """A stream of ``cameras(camera, frame, cx, cy, cz)`` as a stream of actions ``(camera, frame, face, level, x, y, action)``.

    Each camera's built patches are its keyed state.  A batch takes the newest
    frame of a camera (the nearest place, if several share it), drops what that
    doesn't want any more and builds the ``budget`` nearest missing patches.  A
    camera that isn't seen for ``idle`` milliseconds drops all and its state is
    removed.  A query goes on from its checkpoint with the states it had.
    """
    leaves = select_leaves(cameras, radius, factor, max_level, keys=("camera", "frame"))

    def frame(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        built = set(state.get[1]) if state.exists else set()
        number = state.get[0] if state.exists else -1
        if state.hasTimedOut:
            state.remove()
            yield _actions(key[0], number, [(n, "drop") for n in sorted(built)])
            return
        newest: dict[int, float] = {}
        for rows in parts:
            for at, face, level, x, y, dist in zip(*(rows[c].tolist() for c in ("frame", *NODE, "dist")), strict=True):
                if at >= number:
                    if at > number:
                        number, newest = at, {}
                    node = ((face << _LEVEL | level) << _PLACE | x) << _PLACE | y
                    newest[node] = min(dist, newest.get(node, dist))
        if newest:
            drops = sorted(built - newest.keys())
            builds = [n for _, n in sorted((d, n) for n, d in newest.items() if n not in built)[:budget]]
            state.update((number, sorted(built - set(drops) | set(builds))))
            yield _actions(key[0], number, [(n, "drop") for n in drops] + [(n, "build") for n in builds])
        if idle is not None:
            state.setTimeoutDuration(idle)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    made = "camera long, frame long, face int, level int, x long, y long, action string"
    typed = leaves.select(F.col("camera").cast("long").alias("camera"), F.col("frame").cast("long").alias("frame"), *NODE, "dist")
    return typed.groupBy("camera").applyInPandasWithState(frame, made, "frame long, nodes array<long>", "append", timeout)


def _actions(camera: int, frame: int, found: list[tuple[int, str]]) -> pd.DataFrame:
    low, level = (1 << _PLACE) - 1, (1 << _LEVEL) - 1
    rows = [(camera, frame, n >> (2 * _PLACE + _LEVEL), n >> (2 * _PLACE) & level, n >> _PLACE & low, n & low, action) for n, action in found]
    return pd.DataFrame(rows, columns=["camera", "frame", *NODE, "action"]).astype({"face": "int32", "level": "int32"})


def resumed(steps: DataFrame, done: int) -> DataFrame:
    """A deterministic sequence from the step after ``done`` on."""
    return steps.where(F.col("step") > done)


def tumbling_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and value sums by event-time window: an extra over event streams, for batch and stream alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum(F.rint(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("window.start").alias("start"), "event_type", "n", "cents")
