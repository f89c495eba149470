"""N-gram Jaccard join in the metric space of shingle sets.

``d(x, y) = 1 - |x & y| / |x | y|`` is a metric on sets; two documents link
when ``d <= radius`` (0.2 for a similarity of 0.8).  The join:

1. Equal sets collapse to one node before anything is shuffled by content.
2. First cells: the pivots are the single shingles.  ``d(x, {s})`` is
   ``1 - 1/|x|`` for each own shingle and 1 for any other, so a set's nearest
   pivots are its own shingles; ties go to the rarer one, by its count or its words'.  A set within the
   radius can lack at most ``floor(radius * |x|)`` of them, so the window
   replicates a set to its first ``|x| - ceil(0.8 |x|) + 1`` pivots and no
   link is lost.  Counting shingles by hash parts maps sets to vectors without
   enlarging distances; pairs of a cell that are too far apart even there can't
   link.  Cells merge to regions along the pairs that can.
3. Regions of up to ``leaf`` sets (and ``LEAF_SHINGLES`` shingles) join exactly in
   one task.
4. Larger regions split at document pivots: every set goes to its nearest
   pivot's region and, by the triangle inequality, to each region whose pivot
   is within ``min(d_nearest + 2 radius, reach + radius)``; sets that no pivot
   reaches form a region of their own; the parts join recursively.  A set
   within the radius of a pivot leaves as soon as everything within its
   distance plus the radius of that pivot is in the pivot's component: its
   links are then all represented.  A region that doesn't shrink is
   joined by pairs of blocks.

The result is each document's component; links inside a component need not be
listed to prove it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.common import connected_components, saved, small_batches
from spheregrid.llm.tokens import Words, mix, shingle_sets, weighed_sets

#: At most so many of the commonest shingles are told to the tasks (12 bytes each); they order pivots, nothing is left out.
COMMON = 1 << 16
#: Parts of a sketch, and the least of the wide one that looks again at what the first lets through; there a part counts DENSE shingles at most on average.
SKETCH, WIDE, DENSE = 64, 1024, 4
#: The same for the sketches that large cells are looked at with: unrelated sets differ there by more than a third of their size.
SPARSE = 12
#: Words that are a smaller part than this of a task's batch of words aren't told to the tasks: they are all as rare.
RARE = 1 << 15
#: Sets of a cell up to which all pairs are looked at at once, and up to which the sketches are looked at at all.
FEW, MANY = 32, 4096
#: Shingles of all sets of a region that one task joins (8 bytes each, some ten times that at work).
LEAF_SHINGLES = 2_000_000
#: Texts with more than this part of all rows are labelled apart.
HOT = 1024
#: Document pivots of one region and round.
PIVOTS = 32
#: Bytes of the texts that are cut to shingles at once (some fifty times that at work); a longer text is alone.
TEXT_BYTES = 4_000_000
#: Rounding slack of the windows; links themselves are decided in integers.
SLACK = 1e-9


def _signature(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, the same for equal sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values.view(np.uint64)))])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text").cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(at + 200, max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def _batches(batches: Iterator[pa.RecordBatch], width: int):
    for part in _parts(batches):
        values, offsets = shingle_sets(part.column("text"), width)
        yield part, values, offsets, _signature(values, offsets)


def _wide(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Counts of each set's shingles by hash parts, up to 255 each: ``WIDE`` parts, twice as many as often as one would count more than ``DENSE`` on average."""
    key, out = mix(values.view(np.uint64)), []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        bits = max(WIDE, (stop - start - 1) // DENSE + 1) - 1
        bits = bits.bit_length()
        out.append(np.minimum(np.bincount((key[start:stop] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8))
    return out


def _folded(counts: np.ndarray, parts: int) -> np.ndarray:
    return np.minimum(counts.reshape(*counts.shape[:-1], parts, counts.shape[-1] // parts).sum(axis=-1, dtype=np.int32), 255).astype(np.uint8)


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n_shingles, text_hash, node, sketch, mid, wide)``; a sketch counts a set's shingles by hash parts, up to 255 each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets, node in _batches(batches, width):
            wide = _wide(values, offsets)
            cut = lambda rows: pa.array([row.tobytes() for row in rows], pa.binary())
            sizes = np.diff(offsets)
            sketch = [_folded(row, SKETCH) for row in wide]
            mid = [_folded(row, 1 << (max(SKETCH, (size - 1) // SPARSE + 1) - 1).bit_length()) for row, size in zip(wide, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), part.column("text_hash"), pa.array(node), cut(sketch), cut(mid), cut(wide)], ["doc_id", "n_shingles", "text_hash", "node", "sketch", "mid", "wide"])

    named = docs.withColumn("text_hash", F.xxhash64("text"))
    return named.mapInArrow(run, "doc_id long, n_shingles long, text_hash long, node long, sketch binary, mid binary, wide binary")


def _told(docs: DataFrame, at_least: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the commonest words in ascending order, of each how many eighths of an octave it is commoner than one word in ``RARE``, and the octaves of the number of all words.

    Counts of less than a ``RARE``-th of one task's batch of words are not
    sent, so there are few words however large the corpus is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts * RARE >= size
            return pa.RecordBatch.from_arrays([pa.array([None, *values[often].tolist()], pa.int64()), pa.array([size, *counts[often].tolist()], pa.int64())], ["s", "n"])

        held: list[np.ndarray] = []
        size = 0
        for part in _parts(batches):
            held.append(Words(part.column("text")).hashes().view(np.int64))
            size += len(held[-1])
            if size > 1_500_000:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    counts = saved(docs.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")))
    total = max(1, counts.where("s is null").agg(F.sum("n")).first()[0] or 1)
    rows = counts.where(F.col("s").isNotNull() & (F.col("n") >= at_least)).orderBy(F.desc("n"), "s").limit(COMMON).collect()
    values, often = np.array([r["s"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
    order = np.argsort(values)
    return values[order], np.rint(8 * np.log2(np.maximum(often[order] * RARE / total, 1))).astype(np.int64), float(np.log2(total))


def _level(values: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, level[at], 0)


def _weighed(batches: Iterator[pa.RecordBatch], width: int, told: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts of a part: shingles, offsets, the sums of their words' levels, signatures, and which sets this task hasn't had yet."""
    seen: set[int] = set()
    for part in _parts(batches):
        words = Words(part.column("text"))
        h = words.hashes()
        values, offsets, weight = weighed_sets(words, h, _level(h.view(np.int64), *told[:2]), width)
        node = _signature(values, offsets)
        new = np.array([n > 0 and x not in seen and not seen.add(x) for x, n in zip(node.tolist(), np.diff(offsets).tolist(), strict=True)], bool)
        yield values, offsets, weight, node, new


def _common(docs: DataFrame, width: int, at_least: int, told: tuple) -> list:
    """The commonest shingles with a count, of those that are four times as common as their words make likely.

    Counts of 1 within one task's batch of sets are not sent.
    """
    words = docs.sparkSession.sparkContext.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            values, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            values, at, counts = np.unique(values, return_index=True, return_counts=True)
            often = counts >= 2
            return pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(weight[at][often]), pa.array(counts[often])], ["s", "weight", "n"])

        size = 0
        for values, offsets, weight, _, new in _weighed(batches, width, words.value):
            own = np.repeat(new, np.diff(offsets))
            held.append((values[own], weight[own]))
            size += int(own.sum())
            if size > 1_500_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    counts = docs.mapInArrow(run, "s long, weight long, n long").groupBy("s").agg(F.sum("n").alias("n"), F.max("weight").alias("weight")).where(F.col("n") >= at_least)
    likely = F.col("weight") / 8 + told[2] - width * float(np.log2(RARE))
    return counts.where(F.log2("n") >= likely + 2).orderBy(F.desc("n"), "s").limit(COMMON).select("s", "n").collect()


def _cells(docs: DataFrame, width: int, percent: int, common: list, told: tuple) -> DataFrame:
    """``(s, node)``: each set with the pivots of its window.

    Pivots are ordered by how common they must be: those that were counted
    last, by their counts; the others by their words' counts.  So sets hardly
    share a pivot by chance, however large the corpus is.
    """
    values, counts = np.array([r["s"] for r in common], np.int64), np.array([r["n"] for r in common], np.float64)
    order = np.argsort(values)
    # Words' levels add up to less than 2^12.
    shared = docs.sparkSession.sparkContext.broadcast((told, (values[order], np.rint(8 * np.log2(counts[order])).astype(np.int64) + (1 << 12))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shingles = shared.value
        for values, offsets, weight, node, new in _weighed(batches, width, words):
            sizes = np.diff(offsets)
            place = np.maximum(_level(values, *shingles), weight).astype(np.uint64)
            order, out = (place << np.uint64(50)) | (mix(values.view(np.uint64)) >> np.uint64(14)), []
            for i in np.flatnonzero(new):
                own = order[offsets[i] : offsets[i + 1]]
                window = sizes[i] + sizes[i] * -percent // 100 + 1
                # All that are in the last place, so that none of equal ones is chosen by chance.
                out.append(values[offsets[i] : offsets[i + 1]][own <= np.partition(own, window - 1)[window - 1]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.repeat(node[new], [len(x) for x in out]))], ["s", "node"])

    return docs.mapInArrow(run, "s long, node long")


def _near(a: np.ndarray, b: np.ndarray, m: np.ndarray | int, n: np.ndarray | int, percent: int) -> np.ndarray:
    """Whether two sets of sizes ``m`` and ``n`` can link.

    Counting by parts is a contraction: the sketches' L1 distance is at most
    the symmetric difference, which is at most ``(1-t)/(1+t)`` of ``m + n`` for
    sets of similarity ``t``.
    """
    far = np.abs(a.astype(np.int32) - b.astype(np.int32)).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * far <= (100 - percent) * (m + n)


def _near_sized(x: list[bytes], y: list[bytes], m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """``_near`` of sketches of any numbers of parts: of two, the parts of the larger are added up to as many."""
    out = np.zeros(len(x), bool)
    parts = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    for pair in np.unique(parts, axis=0):
        at = np.flatnonzero((parts == pair).all(axis=1))
        a, b = (_folded(np.frombuffer(b"".join([z[i] for i in at]), np.uint8).reshape(len(at), -1), int(pair.min())) for z in (x, y))
        out[at] = _near(a, b, m[at], n[at], percent)
    return out


def _spanning(sketch: list[bytes], size: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the sets of a large cell that can link: breadth-first, each set's row of distances once."""
    parts = np.array([len(x) for x in sketch])
    # The sets by their sketches' numbers of parts, and where each set is.
    of = {k: np.flatnonzero(parts == k) for k in np.unique(parts).tolist()}
    tables = {k: np.frombuffer(b"".join([sketch[i] for i in at]), np.uint8).reshape(-1, k) for k, at in of.items()}
    place = np.zeros(len(parts), np.int64)
    for at in of.values():
        place[at] = np.arange(len(at))
    rest, out = np.arange(len(size)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            own, hit = tables[int(parts[one])][place[one]], np.zeros(len(rest), bool)
            for k, table in tables.items():
                at = np.flatnonzero(parts[rest] == k)
                least = min(k, len(own))
                others = table[place[rest[at]]]
                hit[at] = _near(_folded(own, least), others if least == k else _folded(others, least), size[one], size[rest[at]], percent)
            out += [(one, int(x)) for x in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return out


def _shared(cells: DataFrame, members: DataFrame, percent: int, few: int = FEW, many: int = MANY) -> DataFrame:
    """``(a, b)``: edges that join, in each cell, all sets that can link by their sketches; cells of more than ``many`` sets are joined as they are."""
    # Tasks that read equal texts have sent the same row each, so copies alone share no cell.
    whole = Window.partitionBy("s")
    shared = cells.withColumn("low", F.min("node").over(whole)).withColumn("high", F.max("node").over(whole)).where("low < high").select("s", "node").dropDuplicates(["s", "node"])
    shared = shared.withColumn("few", F.count("*").over(whole) <= few)
    sketches = members.where("n_shingles > 0").groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("mid").alias("mid"), F.first("n_shingles").alias("size"))
    rows = shared.join(sketches, "node").select("s", "node", F.when(F.col("few"), F.col("sketch")).otherwise(F.col("mid")).alias("sketch"), "size").repartition("s").sortWithinPartitions("s", "node")

    def edges(s: np.ndarray, node: np.ndarray, size: np.ndarray, sketch: np.ndarray, begun: bool) -> pa.RecordBatch:
        """The edges of whole cells; if ``begun``, the first one is the rest of a cell whose earlier rows hang together by its first row."""
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        lengths = np.diff(np.append(starts, len(s)))
        run = np.repeat(lengths, lengths)
        none = np.zeros(0, np.int64)
        a, b, firm = [none], [none], [none.astype(bool)]
        chain = lengths > many
        chain[0] |= begun
        little = np.flatnonzero((run <= few) & ~np.repeat(chain, lengths))
        cell, one, sizes, counts = s[little], node[little], size[little], np.frombuffer(b"".join(sketch[little]), np.uint8).reshape(-1, SKETCH)
        for lag in range(1, min(few, len(little))):
            at = np.flatnonzero(cell[lag:] == cell[:-lag])
            at = at[_near(counts[at], counts[at + lag], sizes[at], sizes[at + lag], percent)]
            a.append(one[at])
            b.append(one[at + lag])
            firm.append(np.zeros(len(at), bool))
        large = chain | (lengths > few)
        for start, length, whole in zip(starts[large].tolist(), lengths[large].tolist(), chain[large].tolist(), strict=True):
            own = slice(start, start + length)
            pairs = [(k, k + 1) for k in range(length - 1)] if whole else _spanning(sketch[own].tolist(), size[own], percent)
            if pairs:
                i, j = np.array(pairs).T
                a.append(node[own][i])
                b.append(node[own][j])
                firm.append(np.ones(len(i), bool))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, firm)], ["a", "b", "firm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        begun = False  # whether the first row held stands for rows of its cell that have gone
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "node", "size")]
            sketch = np.empty(batch.num_rows, object)
            sketch[:] = batch.column("sketch").to_pylist()
            held.append((*columns, sketch))
            s, node, size, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            # All cells but the last are complete; of one that is larger than memory should hold, the last row goes on.
            if s[-1] != s[0]:
                cut = int(np.searchsorted(s, s[-1]))
                yield edges(s[:cut], node[:cut], size[:cut], sketch[:cut], begun)
                begun = False
            else:
                cut = len(s) - 1 if len(s) > 4 * many else 0
                if cut:
                    yield edges(s, node, size, sketch, begun)
                    begun = True
            held = [(s[cut:], node[cut:], size[cut:], sketch[cut:])]
        if held:
            yield edges(*held[0], begun)

    found = rows.mapInArrow(run, "a long, b long, firm boolean").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("firm").alias("firm"))
    # The edges of a spanning forest stay; those of a cell of which all pairs were looked at can go one by one (a set has few of these in a cell, so none is a hot key).
    found = saved(found)
    loose = found.where("not firm").select("a", "b")
    wide = members.where("n_shingles > 0").join(loose.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").groupBy("node").agg(F.first("wide").alias("wide"), F.first("n_shingles").alias("size"))
    loose = loose.join(wide.withColumnsRenamed({"node": "a", "wide": "wide_a", "size": "size_a"}), "a").join(wide.withColumnsRenamed({"node": "b", "wide": "wide_b", "size": "size_b"}), "b")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("wide_a", "wide_b"))
            m, n = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            keep = pa.array(_near_sized(x, y, m, n, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return found.where("firm").select("a", "b").unionByName(loose.mapInArrow(again, "a long, b long"))


def _linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


class _Sets:
    """A few thousand sets in memory with an inverted index."""

    def __init__(self, lists: pa.ListArray | pa.LargeListArray):
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        self.offsets, self.sizes = offsets - offsets[0], np.diff(offsets)
        # One sort gives the distinct shingles, each set's codes of them, and the sets that have each.
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        self.words = values[first]
        self.codes = np.empty(len(values), np.int32)
        self.codes[order] = np.cumsum(first, dtype=np.int32) - 1
        self.posted = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[order]
        self.post = np.append(np.flatnonzero(first), len(values))

    def overlap(self, codes: np.ndarray) -> np.ndarray:
        """Size of the intersection of each set with the set of ``codes``."""
        if not len(codes):
            return np.zeros(len(self.sizes), np.int64)
        return np.bincount(np.concatenate([self.posted[self.post[c] : self.post[c + 1]] for c in codes.tolist()]), minlength=len(self.sizes))

    def overlap_with(self, values: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(self.sizes), np.int64)
        at = np.minimum(np.searchsorted(self.words, values), len(self.words) - 1)
        return self.overlap(at[self.words[at] == values])


def local_components(lists: pa.ListArray, percent: int) -> np.ndarray:
    """The exact component (smallest position) of each of a few thousand sets.

    Sets serve as pivots one after the other; one that is certified by the
    triangle inequality (see above) need not.
    """
    sets = _Sets(lists)
    n, radius = len(sets.sizes), 1 - percent / 100
    label, done = np.arange(n), sets.sizes == 0
    for p in range(n):
        if done[p]:
            continue
        inter = sets.overlap(sets.codes[sets.offsets[p] : sets.offsets[p + 1]])
        link = _linked(inter, sets.sizes, sets.sizes[p], percent) & (sets.sizes > 0)
        joined = np.unique(label[link])
        label[np.isin(label, joined)] = joined[0]
        distance = 1 - inter / np.maximum(sets.sizes + sets.sizes[p] - inter, 1)
        other = label != label[p]
        reach = distance[other].min() if other.any() else np.inf
        done |= link & (distance + radius + SLACK < reach)
        done[p] = True
    return label


def _joined(table: pa.Table, percent: int) -> pa.Table:
    node = table.column("node").to_numpy()
    order = np.argsort(node)
    lists = table.column("shingles").combine_chunks().take(pa.array(order))
    label = node[order][local_components(lists, percent)]
    return pa.table({"a": node[order], "b": label})


def _leaves(sets: DataFrame, percent: int) -> DataFrame:
    return sets.groupBy("region").applyInArrow(lambda table: _joined(table, percent), "a long, b long").where("a <> b")


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part, values, offsets, _ in _batches(batches, width):
        yield pa.RecordBatch.from_arrays([part.column("region"), part.column("node"), pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(pa.list_(pa.int64()))], ["region", "node", "shingles"])


def _sets(texts: DataFrame, width: int) -> DataFrame:
    return texts.mapInArrow(lambda batches: _cut(batches, width), "region long, node long, shingles array<long>")


def _text_leaves(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``_leaves`` of the sets of ``texts``: a text is a fraction of its set's size."""

    def run(table: pa.Table) -> pa.Table:
        return _joined(pa.Table.from_batches(_cut(iter(table.to_batches()), width)), percent)

    return texts.groupBy("region").applyInArrow(run, "a long, b long").where("a <> b")


def _share(times: int, leaf: int, leaf_shingles: int) -> Column:
    """In how many parts a region of ``n`` sets with ``total`` shingles goes, ``times`` of which are a leaf by both measures; no more than sets."""
    return F.least(F.greatest(F.ceil(F.col("n") * times / leaf), F.ceil(F.col("total") * times / leaf_shingles)), F.col("n")).cast("int")


def _blocks(sets: DataFrame, sizes: DataFrame, leaf: int, leaf_shingles: int) -> DataFrame:
    """Each region as all pairs of its blocks of half a leaf: exact, without a task over the whole region."""
    blocks = sets.join(sizes, "region").withColumn("k", _share(2, leaf, leaf_shingles))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return blocks.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "node", "shingles")


def _distances(sets: DataFrame, sizes: DataFrame, leaf: int, leaf_shingles: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The pivots of each region (fewer where they would have more shingles than a leaf), and each set with its intersection with every pivot."""
    sized = sets.join(sizes, "region")
    few = sized.where(F.pmod(F.xxhash64("node", F.lit(depth)), F.col("n")) < 4 * PIVOTS).withColumn("at", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(depth)), "node")) - 1)
    most = F.greatest(F.least(F.lit(PIVOTS), F.floor(F.lit(leaf_shingles) * F.col("n") / F.col("total"))), F.lit(2))
    pivots = saved(few.where(F.col("at") < most).select("region", "at", "node", "shingles", "n", "total"))
    salt = _share(1, leaf, leaf_shingles)
    left = sized.withColumn("salt", F.pmod(F.xxhash64("node"), salt).cast("int")).select("region", "salt", "node", "shingles")
    right = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salt - 1))).select("region", "salt", "at", F.col("shingles").alias("pivot"))

    def run(key: tuple, docs: pa.Table, own: pa.Table) -> pa.Table:
        inter = np.full((docs.num_rows, PIVOTS), -1, np.int64)
        union = np.ones((docs.num_rows, PIVOTS), np.int64)
        if docs.num_rows:
            sets = _Sets(docs.column("shingles").combine_chunks())
            for at, pivot in zip(own.column("at").to_pylist(), own.column("pivot"), strict=True):
                values = np.sort(pivot.values.to_numpy())
                inter[:, at] = sets.overlap_with(values)
                union[:, at] = sets.sizes + len(values) - inter[:, at]
        pack = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, PIVOTS, dtype=np.int32)), pa.array(x.ravel()))
        size = docs.column("shingles").combine_chunks().value_lengths().cast(pa.int64())
        return pa.table({"region": pa.array(np.full(docs.num_rows, key[0].as_py())), "node": docs.column("node"), "size": size, "inter": pack(inter), "union": pack(union)})

    return pivots, saved(left.groupBy("region", "salt").cogroup(right.groupBy("region", "salt")).applyInArrow(run, "region long, node long, size long, inter array<long>, union array<long>"))


def _split(sets: DataFrame, sizes: DataFrame, percent: int, leaf: int, leaf_shingles: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Links to the pivots of large regions, and the parts that still have to be joined."""
    radius, home = 1 - percent / 100, 0.5
    pivots, measured = _distances(sets, sizes, leaf, leaf_shingles, depth)
    near = measured.select("region", "node", F.posexplode(F.arrays_zip("inter", "union")).alias("at", "x")).where("x.inter >= 0").select("region", "node", "at", (F.col("x.inter") * 100 >= F.col("x.union") * percent).alias("link"), (1 - F.col("x.inter") / F.col("x.union")).alias("d"))
    links = near.where("link").join(pivots.select("region", "at", F.col("node").alias("b")), ["region", "at"]).select(F.col("node").alias("a"), "b", "region", "at")
    # Pivots that link to a common set: at most PIVOTS^2 pairs a region.
    first = links.groupBy("region", F.col("a").alias("node")).agg(F.min("at").alias("low"))
    pairs = links.select("region", F.col("a").alias("node"), "at").join(first, ["region", "node"]).select("region", "at", "low").distinct()

    def joined(table: pa.Table) -> pa.Table:
        label = np.arange(PIVOTS)
        for a, b in zip(table.column("at").to_pylist(), table.column("low").to_pylist(), strict=True):
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        return pa.table({"region": pa.array(np.full(PIVOTS, table.column("region")[0].as_py())), "at": pa.array(np.arange(PIVOTS, dtype=np.int32)), "label": pa.array(label.astype(np.int32))})

    labels = saved(pairs.groupBy("region").applyInArrow(joined, "region long, at int, label int"))
    own = saved(first.join(labels.withColumnRenamed("at", "low"), ["region", "low"]).select("region", "node", F.col("label").alias("own")))
    near = near.join(own, ["region", "node"], "left").join(labels, ["region", "at"], "left")
    reach = near.where("own is null or own <> label").groupBy("region", "at").agg(F.min("d").alias("reach"))
    state = near.join(reach, ["region", "at"], "left")
    done = F.bool_or(F.col("link") & (F.col("d") + radius + SLACK < F.coalesce("reach", F.lit(1e9))))
    nearest = state.groupBy("region", "node").agg(done.alias("done"), F.min(F.struct("d", "at")).alias("best"))
    active = saved(nearest.where("not done").select("region", "node", "best"))
    left = active.join(measured.select("region", "node", "size"), ["region", "node"]).groupBy("region").agg(((F.count("*") > leaf) | (F.sum("size") > leaf_shingles)).alias("large"))
    near = near.join(active, ["region", "node"]).join(left, ["region"])
    # Within a home radius of 0.5 the window reaches 0.7; beyond it a set stays in the far region.
    inside = near.where(F.col("large") & (F.col("d") <= F.least(F.col("best.d") + 2 * radius, F.lit(home + radius)) + SLACK)).select(F.xxhash64("region", "at", F.lit(depth)).alias("part"), "region", "node")
    far = active.join(left, "region").where(~F.col("large") | (F.col("best.d") >= home)).select(F.xxhash64("region", F.lit(-1), F.lit(depth)).alias("part"), "region", "node")
    parts = inside.union(far).join(sets, ["region", "node"]).select(F.col("part").alias("region"), "node", "shingles")
    return links.select("a", "b"), saved(parts)


def components(docs: DataFrame, width: int = 5, percent: int = 80, leaf: int = 4000, at_least: int = 12, max_depth: int = 4, few: int = FEW, many: int = MANY, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """``(doc_id, n_shingles, text_hash, class, component_id)`` of each row; ``class`` names its component (null without words)."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = saved(_nodes(docs, width))
    told = _told(docs, at_least)
    cells = _cells(docs, width, percent, _common(docs, width, at_least, told), told)
    regions = saved(connected_components(_shared(cells, members, percent, few, many)).select("node", F.col("component").alias("region")))

    # The texts of the sets that share a cell, one for each node.
    # A row is known by its id and its text: ids may be null or repeat.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    wanted = members.join(regions, "node").groupBy("node", "region").agg(F.min(row).alias("row"), F.first("n_shingles").alias("size")).select("node", "region", "size", F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"))
    texts = docs.withColumn("_text", F.xxhash64("text")).join(wanted, (F.col("_text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = saved(texts.select("region", "node", "size", "text").dropDuplicates(["node"]))

    # Regions of a leaf's size are cut to shingles where they are joined; sets are written only for larger ones.
    sizes = texts.groupBy("region").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.sum(F.octet_length("text")).alias("bytes")).where("n > 1")
    sizes = saved(sizes.select("region", ((F.col("n") <= leaf) & (F.col("total") <= leaf_shingles) & (F.col("bytes") <= 8 * leaf_shingles)).alias("small")))
    links = [saved(_text_leaves(texts.join(sizes.where("small").select("region"), "region", "left_semi"), width, percent))]
    large = sizes.where("not small").select("region")
    sets = None if large.isEmpty() else saved(_sets(texts.join(large, "region", "left_semi"), width))
    for depth in range(max_depth + 1 if sets is not None else 0):
        sizes = sets.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("total"))
        sizes = saved(sizes.where("n > 1"))
        large = sizes.where((F.col("n") > leaf) | (F.col("total") > leaf_shingles)).where("n > 1")
        small = sizes.join(large.select("region"), "region", "left_anti")
        links.append(saved(_leaves(sets.join(small.select("region"), "region", "left_semi"), percent)))
        if large.isEmpty():
            break
        rest = sets.join(large.select("region"), "region", "left_semi")
        if depth == max_depth:
            links.append(saved(_leaves(_blocks(rest, large.select("region", "n", "total"), leaf, leaf_shingles), percent)))
            break
        found, parts = _split(rest, large.select("region", "n", "total"), percent, leaf, leaf_shingles, depth)
        links.append(saved(found.where("a <> b").distinct()))
        # Parts that together are no smaller than what they came from would never end.
        if parts.count() > 2 * rest.count():
            links.append(saved(_leaves(_blocks(rest, large.select("region", "n", "total"), leaf, leaf_shingles), percent)))
            break
        sets = parts
    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    joined = connected_components(edges)
    # The smallest id of each text, then of each class: copies count once before they meet, and a class's label goes to its texts before it goes to their rows.
    least = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    texts = saved(least.join(joined, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"))
    classes = texts.groupBy("class").agg(F.min("least").alias("component_id"))
    labels = saved(texts.join(classes, "class").select("node", "n", "class", "component_id"))
    # At most HOT texts have more than that part of all rows: their labels are told to every task, so no task gets all copies of one.
    rows = members.select("doc_id", "n_shingles", "text_hash", "node")
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = labels.where(F.col("n") * HOT > total).drop("n")
    known = rows.join(F.broadcast(hot.select("node", F.col("class").alias("_class"), F.col("component_id").alias("_id"))), "node", "left")
    many = known.where("_class is not null").select("doc_id", "n_shingles", "text_hash", F.col("_class").alias("class"), F.col("_id").alias("component_id"))
    few_ = known.where("_class is null").drop("_class", "_id").join(labels.where(F.col("n") * HOT <= total).drop("n"), "node", "left")
    found = many.unionByName(few_.drop("node"))
    own = F.when(F.col("class").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.withColumn("component_id", own)


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, **sizes: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    * Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a set is the distinct
      ``width``-word shingles, the whole sequence if there are fewer words.
    * A null or wordless text has an empty set and its own ``doc_id`` as component.
    * A row with a null ``doc_id`` gets a null component; it bridges no others.
    * Repeated rows are returned each; equal texts are one class.
    * Other columns are ignored; an empty table gives no rows.

    ``sizes`` are those of ``components``; they decide the work, not the result.
    """
    return components(docs, width, percent, **sizes).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the smallest ``doc_id`` (null last), of several such rows the one with the least text hash.

    Rows without words stay, each of them.  An empty table gives no rows;
    columns of any name pass through.
    """
    # A row is known by its id and its text, so rows that share an id are judged apart.
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    found = saved(components(docs, width, percent).select("doc_id", "text_hash", "class"))
    best = found.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("doc_id"), F.col("b.text_hash").alias("text_hash"))
    plain = found.where("class is null").select("doc_id", "text_hash").distinct()
    same = (F.col("_text") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    chosen = named.join(best, same, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_text", "_id").orderBy("_id"))).where("_n = 1").select("_row.*")
    return chosen.unionByName(named.join(plain, same, "left_semi").select("_row.*"))
