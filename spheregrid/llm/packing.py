"""Best-fit packing of tokenized documents into sequences of a fixed length, by sums of squares.

``encoded_pieces`` encodes whole texts and cuts only documents that are longer
than a sequence.  ``pack`` then places each piece, the longer ones first, in
the open sequence (or a new one) that makes the sum over gaps of the squared
number of open sequences with that gap smallest: counts stay level, so there
is a sequence of about every gap when a piece that fits it comes.

Pieces are dealt into groups at random, each packed in a task.  Sequences that
a group leaves short by more than a slack are opened again and their pieces
dealt anew into fewer groups, until one group is left or opening gains nothing.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheregrid.llm.common import gathered, saved, small_batches

#: Text of a chunk that is encoded at once, pieces of a batch that leaves it, words of one call of the tokenizer.
CHUNK_BYTES, BATCH_PIECES, CALL_WORDS = 10_000_000, 250, 1000
#: Pieces that a task packs, and the share of a sequence that it may be short by and still be done.
GROUP, SLACK = 8192, 1 / 128
#: A round whose short sequences hold more than this share of its pieces isn't followed by another: their lengths don't fit together.
WORTH = 0.75
#: Marks between words: a piece ends where a letter meets one of these, whatever stands around.
_MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_SPACES = b" \t\n\r"
_KIND = np.array([1 if b in _SPACES else 2 if b in _MARKS else 3 if 97 <= b <= 122 or 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
#: Words that the tokenizer never cuts further before it merges.
_WHOLE = r"^([a-zß-öø-ÿ]+|[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)$"


def tokenizer_path() -> str:
    """The public vocabulary of 49,408 entries with word ends, where it is installed."""
    from public_tokenizers import path

    return path("word_bpe_49k.json")


@functools.lru_cache(1)
def _opened(path: str):
    """The tokenizer of a file, and which of its ids end a word."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    names = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(1 + max(names.values()), bool)
    ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
    return tokenizer, ends


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words in each text, and the words: what encodes to the same ids alone as in its place.

    White space ends words, and so does every place where an ASCII letter (or
    a small Latin-1 one) stands beside a mark.  Capitals become small, but for
    those before a character beyond ASCII, with which they might compose, and in
    texts that may hold a special token.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy() if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    after = np.append(raw[1:], 0)[: len(raw)]
    capital = (raw >= 65) & (raw <= 90) & (after < 128)
    for k in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)):
        capital[ends[k] : ends[k + 1]] = False
    raw[capital] += 32
    kind = _KIND[raw]
    word = kind != 1
    first = word.copy()
    # The end of a small Latin-1 letter other than the division sign counts as a letter before a mark.
    letter = kind == 3
    latin = np.zeros(len(raw), bool)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x9F) & (raw[1:] != 0xB7)
    mark = kind == 2
    first[1:] &= ~word[:-1] | (mark[1:] & (letter | latin)[:-1]) | (letter[1:] & mark[:-1])
    edges = ends[:-1][ends[:-1] < len(raw)]
    first[edges] = word[edges]
    begins = np.flatnonzero(first)
    kept = np.cumsum(word, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
    offsets = np.append(kept[begins].astype(np.int64) - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw[word])])
    return np.diff(np.searchsorted(begins, ends)), words


def encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct words, one after the other, and how many each has.

    Words that stay whole are encoded many at a time, as one text: the ids that
    end a word tell where each one's are.
    """
    tokenizer, ends = _opened(path)
    whole = pc.match_substring_regex(words, _WHOLE).to_numpy(zero_copy_only=False)
    simple, others = np.flatnonzero(whole), np.flatnonzero(~whole)
    listed = words.take(pa.array(simple)).to_pylist()
    calls = [" ".join(listed[a : a + CALL_WORDS]) for a in range(0, len(listed), CALL_WORDS)]
    parts = [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(calls, add_special_tokens=False)]
    size = np.zeros(len(words), np.int64)
    flat = np.concatenate([*parts, np.zeros(0, np.uint32)])
    size[simple] = np.diff(np.flatnonzero(ends[flat]), prepend=-1)
    single = [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(words.take(pa.array(others)).to_pylist(), add_special_tokens=False)]
    size[others] = [len(x) for x in single]
    order = np.concatenate([simple, others])
    start = np.empty(len(words), np.int64)
    start[order] = np.cumsum(size[order]) - size[order]
    flat = np.concatenate([flat, *single])
    return flat[_ranges(start, size)], size


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ..., start+size-1 of each pair, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def encoded_pieces(docs: DataFrame, capacity: int = 4096, end: int = 1, path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids)`` of ``docs(doc_id, text)``: each document's ids, cut where they are more than ``capacity``.

    A document's ids are those of the tokenizers library without special
    tokens, then ``end``; a null or empty text has the end alone.  ``ids`` are
    little-endian unsigned 32-bit numbers; ``start`` counts the document's ids
    before the piece.  Rows with a null or repeated ``doc_id`` are rows like any
    other; other columns are ignored; an empty table gives no rows.  The
    tokenizer must drop white space and lower-case, as public ones of this kind do.
    """
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, CHUNK_BYTES):
            counts, words = words_of(batch.column("text"))
            coded = words.dictionary_encode()
            flat, size = encode_words(coded.dictionary, path)
            # The end follows the words of each document as one more word.
            flat, size = np.append(flat, np.uint32(end)), np.append(size, 1)
            start = np.cumsum(size) - size
            code = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts), len(size) - 1)
            ends = np.concatenate([[0], np.cumsum(size[code])])[np.cumsum(counts + 1)]
            begins = np.concatenate([[0], ends[:-1]])
            pieces = -(-(ends - begins) // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            number = _ranges(np.zeros(len(counts), np.int64), pieces)
            before = number * capacity
            length = np.minimum(capacity, (ends - begins)[doc] - before)
            ids = flat[_ranges(start[code], size[code])].astype("<u4", copy=False)
            del code
            at = begins[doc] + before
            for a in range(0, len(doc), BATCH_PIECES):
                b = min(len(doc), a + BATCH_PIECES)
                bounds = (4 * (np.append(at[a:b], at[b - 1] + length[b - 1]) - at[a])).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(ids[at[a] : at[b - 1] + length[b - 1]].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[a:b])), pa.array(number[a:b], pa.int32()), pa.array(before[a:b]), pa.array(length[a:b]), blob], ["doc_id", "piece", "start", "length", "ids"])

    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in the order of their placement: each one's bin, its place there, and each bin's gap at the end.

    A new bin counts as one of gap ``capacity``, of which there are always
    enough; full bins aren't counted.  Of equal changes the smallest gap is taken.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    never = np.int64(1) << 60
    bins, places, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        here = count[s:capacity]
        # What moving a bin from gap g to g - s adds to the sum of squares.
        change = 2 * (count[: capacity - s] - here) + 2
        new = 2 * count[capacity - s] + 1
        if s < capacity:
            change[0] = 1 - 2 * here[0]
            change[here == 0] = never
            k = int(change.argmin())
        else:
            new = 0
        if s < capacity and change[k] <= new:
            bin_ = open_bins[s + k].pop()
            count[s + k] -= 1
        else:
            bin_ = len(gaps)
            gaps.append(capacity)
        bins[i], places[i] = bin_, capacity - gaps[bin_]
        gaps[bin_] -= s
        if gaps[bin_]:
            open_bins[gaps[bin_]].append(bin_)
            count[gaps[bin_]] += 1
    return bins, places, np.array(gaps, np.int64)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces(length, ...)``, lengths from 1 to ``capacity``, with ``sequence_id`` and ``offset``, both long; all other columns stay.

    Offsets are gapless from 0 in each sequence.  Rows that repeat are pieces
    like any other; ties of length are placed in the order of the written
    table, so reruns of a lost task agree.  A length that is null or out of
    range raises; an empty table gives an empty one.
    """
    uid = next(f"uid{k}" if k else "uid" for k in range(len(pieces.columns) + 1) if (f"uid{k}" if k else "uid") not in pieces.columns)
    valid = F.coalesce(F.col("length").between(1, capacity), F.lit(False))
    length = F.when(valid, F.col("length")).otherwise(F.raise_error(F.lit("a length isn't between 1 and the capacity")).cast("long")).cast("long")
    pieces = saved(pieces.withColumn("length", length).withColumn(uid, F.monotonically_increasing_id()))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        size, own = rows.column("length").to_numpy(), rows.column("uid").to_numpy()
        order = np.lexsort((own, -size))
        bins, offset, gap = sum_of_squares(size[order], capacity)
        return pa.table({"uid": own[order], "group": np.full(len(own), key[0].as_py()), "bin": bins, "offset": offset, "gap": gap[bins], "length": size[order]})

    here = pieces.select(F.col(uid).alias("uid"), "length").where(F.col("length") < capacity)
    done = pieces.where(F.col("length") == capacity).select(F.col(uid).alias("uid"), (-1 - F.col(uid)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = here.count()
    for number in range(256):
        if not left:
            break
        groups = -(-left // GROUP)
        dealt = here.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(groups)).alias("group"))
        placed = saved(dealt.groupBy("group").applyInArrow(place, "uid long, group long, bin long, offset long, gap long, length long"))
        short = placed.where(F.col("gap") > capacity * SLACK)
        again = short.count() if groups > 1 else 0
        repeat = again <= WORTH * left
        kept = placed.where(F.col("gap") <= capacity * SLACK) if groups > 1 and repeat else placed
        name = F.lit(number << 55) + F.shiftleft("group", 20) + F.col("bin")
        done = done.unionByName(kept.select("uid", name.alias("sequence_id"), "offset"))
        if groups == 1 or not repeat:
            break
        here, left = short.select("uid", "length"), again
    return pieces.join(done.withColumnRenamed("uid", uid), uid).drop(uid)
