"""Positions and running sums over hash-ordered groups of any size.

A group's rows are cut into blocks of consecutive keys (about the square root
of the table's rows, so neither the blocks nor their number outgrow a task);
a small table holds each block's sum, and a row's running sum is its block's
offset plus the sum inside the block.  No group is gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of a key's leading 32 bits.
_SPAN = 1 << 32


def hash_key(seed: int, *columns: Column) -> Column:
    """A random-looking hex key of 128 bits, the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary"))


def block_count(rows: int) -> int:
    return max(1, math.isqrt(max(0, rows)))


def key_block(key: Column, blocks: int) -> Column:
    """The block of a hex key: blocks hold consecutive keys, about equally many."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * blocks / _SPAN).cast("int")


def running(rows: DataFrame, group: list[str], block: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the group's earlier rows; ``group`` columns aren't null.

    ``block`` must not fall along ``order``.
    """
    blocks = rows.groupBy(*group, block).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(block) if group else Window.orderBy(block)
    earlier = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = rows.withColumn("_inside", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return inside.join(offsets, [*group, block]).withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_offset", "_inside")
