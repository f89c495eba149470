"""The prefix trie of conversations, and sums over its subtrees by heavy-path decomposition.

A prefix of turns is named by a running sum of 128-bit hashes of its turns and
their places, so all prefixes of all conversations are named by prefix sums,
whatever their length.  Nodes are distinct names.

Sums over subtrees: a node's largest child (by members) continues its path,
every other child begins one of its own.  A light child has at most half of
its parent's members, so a conversation meets no more than log2(conversations)
of them: these few depths tell for each node which path it is on.  Paths are
summed from their ends, blocks of an array at a time, those with the most
light nodes above them first; each path then adds its whole sum to the parent
of its top, so there are as many rounds as light nodes on a way, not as turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.common import saved, small_batches
from spheregrid.llm.ordering import running

#: Turns of a block: of a conversation's prefix sums, and of a path's suffix sums.
BLOCK = 4096
#: Ids of a piece of the text that the hash of ends is taken of.
PIECE_IDS = 1024
#: The 32-bit parts of a turn's hash.
_PARTS = ["p0", "p1", "p2", "p3"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _parts(key: Column) -> list[Column]:
    """The four 32-bit numbers of a hex key."""
    return [F.conv(F.substring(key, 1 + 8 * k, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(_PARTS)]


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, content, length)``: each turn's place from 0, the hash of its role and text, the text's code points.

    Turns are ordered by ``turn``, null first; turns that share it, by the hash
    of their content.  The order is a range sort, so a conversation of any
    length is dealt over tasks.  Rows without ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), content.alias("content"), F.length(text).cast("long").alias("length"))
    order = [F.asc_nulls_first("turn"), F.col("content")]
    ranged = saved(rows.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id()))
    return running(ranged, ["conv_id"], "block", order, F.lit(1), "place").select("conv_id", "place", "content", "length")


def shared_heads(turns: DataFrame, stride: int = 100, most: int = 6) -> DataFrame:
    """``(conv_id, depth, content, length)``: conversations rebuilt on the head of the one that their ``stride`` begins with.

    A conversation's first ``crc32(conv_id) % most`` turns are those of
    conversation ``conv_id - conv_id % stride`` (all if it has fewer, none if
    it isn't there); its own later turns follow.  Depths run from 1.
    """
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    heads = turns.where((F.col("conv_id") % stride == 0) & (F.col("place") < most - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "content", "length"))).alias("head"))
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % stride).alias("base"), shared.alias("shared"))
    cut = ids.join(heads, "base", "left").select("conv_id", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("shared").cast("int")).alias("head"))
    first = cut.select("conv_id", F.inline("head")).select("conv_id", (F.col("place") + 1).alias("depth"), "content", "length")
    taken = cut.where(F.size("head") < F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).select("conv_id", F.size("head").cast("long").alias("had"))
    own = turns.where(F.col("place") >= shared).join(taken, "conv_id", "left")
    own = own.select("conv_id", (F.coalesce("had", shared) + F.col("place") - shared + 1).alias("depth"), "content", "length")
    return first.unionByName(own)


def _named(parts: list[Column]) -> Column:
    """A prefix's name: its summed parts modulo 2^32, as two numbers."""
    a, b, c, d = (p % F.lit(1 << 32) for p in parts)
    return F.struct((F.shiftleft(a, 31) + F.shiftright(b, 1)).alias("a"), (F.shiftleft(c, 31) + F.shiftright(d, 1)).alias("b"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, length, key, parent)`` of ``turns(conv_id, depth, content, length)``: names of the prefixes that end with each turn and before it."""
    hashed = turns.select("conv_id", "depth", "length", *_parts(F.md5(F.concat_ws("|", F.col("depth").cast("string"), F.col("content")).cast("binary"))))
    hashed = hashed.withColumn("block", F.floor(F.col("depth") / BLOCK))
    earlier = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    inside = hashed.select("*", *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"before_{p}") for p in _PARTS])
    # Only conversations beyond the first block have sums to carry on.
    carried = hashed.groupBy("conv_id", "block").agg(*[F.sum(p).alias(p) for p in _PARTS])
    to_here = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("conv_id", "block", *[F.sum(p).over(to_here).alias(f"carried_{p}") for p in _PARTS]).where("block > 0")
    whole = inside.join(carried, ["conv_id", "block"], "left")
    before = [F.col(f"before_{p}") + F.coalesce(f"carried_{p}", F.lit(0)) for p in _PARTS]
    return whole.select("conv_id", "depth", "length", _named([b + F.col(p) for b, p in zip(before, _PARTS, strict=True)]).alias("key"), _named(before).alias("parent"))


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, conv_id)``: the ids of a key joined by commas, so many at a time."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        a, b = (batch.column("key").field(k).to_pylist() for k in (0, 1))
        found, start = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or (a[i], b[i]) != (a[start], b[start]) or i - start == most:
                found.append(({"a": a[start], "b": b[start]}, ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        keys, first, text = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("key").type), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["key", "first", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces: one hash of each key's joined text, taken as its pieces stream by."""
    last, state = None, None
    for batch in batches:
        found = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key == last:
                state.update(b"," + text.encode())
                continue
            if last is not None:
                found.append((last, state.hexdigest()))
            last, state = key, hashlib.sha256(text.encode())
        if found:
            yield _digests(found, batch.column("key").type)
    if last is not None:
        yield _digests([(last, state.hexdigest())], batch.column("key").type)


def _digests(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], kind), pa.array([h for _, h in found], pa.string())], ["key", "ends_sha256"])


def hashes_of_ends(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of ``ends(key, conv_id)``: the SHA-256 of the ascending ids, joined by commas.

    Ids are sorted by range and joined in pieces, so a key that very many end
    at is read by one task only as a stream of pieces, which is all that the
    hash can't do side by side.
    """
    key, most = "key struct<a: long, b: long>", PIECE_IDS
    pieces = small_batches(ends).select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lambda batches: _pieces(batches, most), f"{key}, first long, text string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, f"{key}, ends_sha256 string")


def _paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``top`` (the depth at which its path begins), ``path`` (the top's key), ``level`` (light nodes above it)."""
    largest = nodes.where("depth > 0").groupBy("parent").agg(F.min_by("key", F.struct(-F.col("n_convs"), F.col("conv_id"))).alias("heavy"), F.count("*").alias("n_children"))
    nodes = nodes.join(largest.withColumnRenamed("parent", "key"), "key", "left")
    # Written first, so the rows of a light node with very many members can be dealt over several tasks of the next join.
    light = saved(nodes.where("depth > 0").select("key").join(largest.select("heavy"), F.col("key") == F.col("heavy"), "left_anti"))
    # A conversation's light nodes are at most log2(conversations) many.
    tops = rows.select("conv_id", "depth", "key").join(light, "key").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("tops"))
    nodes = nodes.join(tops, "conv_id", "left")
    above = F.filter(F.coalesce("tops", F.array().cast(tops.schema["tops"].dataType)), lambda x: x["depth"] <= F.col("depth"))
    last = F.try_element_at(above, F.lit(-1))
    return nodes.withColumn("level", F.size(above)).withColumn("top", F.coalesce(last["depth"], F.lit(0).cast("long"))).withColumn("path", last["key"]).drop("tops", "heavy")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations ``turns(conv_id, depth, content, length)``; ``ids(conv_id)`` has them all, the turnless too.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``:
    smallest member, depth (0: the root, if there is any conversation), the
    parent's smallest member, members, children, childless nodes of the
    subtree, what sharing saves in it (``(n_convs - 1)`` times the code points
    of each node's last text), and the hash of the ids that end here.
    """
    rows = saved(prefixes(turns))
    root = _named([F.lit(0).cast("long")] * 4)
    zero = F.lit(0).cast("long")
    whole = saved(ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0"))
    nodes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("length").alias("length"))
    nodes = saved(nodes.unionByName(whole.select(root.alias("key"), "conv_id", "n_convs", zero.alias("depth"), F.lit(None).cast(nodes.schema["key"].dataType).alias("parent"), zero.alias("length"))))
    placed = saved(_paths(rows, nodes).withColumn("path", F.coalesce("path", root)).withColumn("block", -F.floor((F.col("depth") - F.col("top")) / BLOCK)))

    # From the paths with the most light nodes above them to the root's.
    levels, longest = placed.agg(F.max("level"), F.max(F.col("depth") - F.col("top"))).first()
    sums, added = [], None
    suffix = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    values = ["n_leaves", "saved_tokens"]
    for level in range(-1 if levels is None else levels, -1, -1):
        here = placed.where(F.col("level") == level)
        leaf, saves = F.col("n_children").isNull().cast("long"), (F.col("n_convs") - 1) * F.col("length")
        if added is None:
            own = here.select("key", "parent", "path", "block", "depth", "top", leaf.alias("n_leaves"), saves.alias("saved_tokens"))
        else:
            own = here.join(added, "key", "left").select("key", "parent", "path", "block", "depth", "top", (leaf + F.coalesce("add_n_leaves", zero)).alias("n_leaves"), (saves + F.coalesce("add_saved_tokens", zero)).alias("saved_tokens"))
        summed = own.select("key", "parent", "path", "block", "depth", "top", *[F.sum(v).over(suffix).alias(v) for v in values])
        if longest >= BLOCK:
            # Paths of several blocks: what the deeper blocks sum to is added to the others.
            deeper = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            carried = own.groupBy("path", "block").agg(*[F.sum(v).alias(v) for v in values]).select("path", "block", *[F.sum(v).over(deeper).alias(f"deeper_{v}") for v in values])
            summed = summed.join(carried, ["path", "block"]).select("key", "parent", "depth", "top", *[(F.col(v) + F.coalesce(f"deeper_{v}", zero)).alias(v) for v in values])
        summed = saved(summed.select("key", "parent", "depth", "top", *values))
        sums.append(summed)
        if level:
            # Sums of tops go to their parents, which are on paths with one light node less above them.
            added = summed.where("depth = top").groupBy(F.col("parent").alias("key")).agg(*[F.sum(v).alias(f"add_{v}") for v in values])
    total = sums[0] if sums else placed.select("key", "parent", "depth", "top", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    for more in sums[1:]:
        total = total.unionByName(more)

    last = rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    ends = ids.join(last, "conv_id", "left").select(F.coalesce("key", root).alias("key"), "conv_id")
    out = placed.select("key", "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"))
    out = out.join(total.select("key", *values), "key").join(hashes_of_ends(ends), "key", "left")
    out = out.join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *values, F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of ``conversations(conv_id, turn, role, text)``, rebuilt on shared heads; see ``prefix_trie`` for its columns.

    Null roles and texts are empty; turns that share a number are ordered by
    the hash of their content, so repeated rows are interchangeable; rows with
    a null ``conv_id`` are left out.  Conversations of any length and any
    number of copies are dealt over tasks.  Other columns are ignored; an empty
    table gives no rows.
    """
    turns = saved(turns_in_order(conversations))
    return prefix_trie(saved(shared_heads(turns)), turns.select("conv_id").distinct())
