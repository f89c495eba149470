"""BPE encoding and decoding by a distinct-word table.

Texts are split at single spaces into words (` word`), where the tokenizer's
own splitting can't cross; a text with other runs of white space is split by
the tokenizer itself.  Words travel in the packed form of a chunk of documents
(some 8 MB of text):

* ``words(bucket, chunk, words)``: a chunk's distinct words, by hash bucket;
* ``positions(chunk, ...)``: for each document the numbers of its words.

All occurrences of a word meet in its bucket, where it is encoded once; the
ids go back to the chunks and are joined to the positions.  Decoding joins the
ids to the table of pieces, which is as large as the tokenizer's vocabulary
and told to every task.  No table of words is gathered or broadcast.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheregrid.llm.common import gathered, small_batches

#: Text of a chunk, and of the part of a chunk that is put together at once.
CHUNK_BYTES, PART_BYTES = 8_000_000, 1_000_000
#: Buckets of distinct words for so much text; they grow with its power 0.6, about as vocabularies do.
BUCKETS, BUCKET_TEXT = 16, 64_000_000
#: White space beside white space or at an end, or a character that marks splits.
_IRREGULAR = re.compile(r"\s\s|^\s|\s$|[\x00\x1c-\x1f\x85\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")


def tokenizer_path() -> str:
    """The public byte-level vocabulary of 50,257 entries, where it is installed."""
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


@functools.lru_cache(1)
def opened(path: str) -> Tokenizer:
    """The tokenizer of a file, opened once in a process."""
    return Tokenizer(path)


class Tokenizer:
    """The tokenizer of a file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Base

        self.base = Base.from_file(path)
        self.base.no_truncation()
        self.base.no_padding()
        self.special = {t.content: i for i, t in self.base.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The tokenizer's own split of a text; special tokens are words of their own."""
        out: list[str] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.base.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.base.encode_batch(words, add_special_tokens=False)]

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after the other, and where each starts: the join table for decoding."""
        table = byte_of_char()
        out = []
        for i in range(1 + max(self.base.get_vocab(with_added_tokens=True).values())):
            piece = self.base.id_to_token(i) or ""
            out.append(piece.encode() if piece in self.special or any(c not in table for c in piece) else bytes(table[c] for c in piece))
        return np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)])


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _split(texts: pa.Array, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words in each text, the number of each word, and the distinct words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = np.array([not t or _IRREGULAR.search(t) is not None for t in texts.to_pylist()], bool)
    plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    fast = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), " ", "\x00 "), "\x00")
    slow = pa.array([tokenizer.words(t) for t in texts.take(pa.array(rest)).to_pylist()], pa.list_(pa.large_string()))
    both = pa.concat_arrays([fast.cast(pa.large_list(pa.large_string())), slow.cast(pa.large_list(pa.large_string()))])
    both = both.take(pa.array(np.argsort(np.concatenate([plain, rest]), kind="stable")))
    coded = both.flatten().dictionary_encode()
    counts = pc.list_value_length(both).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_string())


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _bucketed(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words' order by bucket, the buckets in that order, and the words as bytes."""
    raw = words.cast(pa.large_binary()).to_pylist()
    bucket = np.array([zlib.crc32(w) % buckets for w in raw], np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order], raw


def _name(batch: pa.RecordBatch) -> int:
    """A chunk's number: a hash of its rows in order, the same whenever they are read."""
    ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    value = zlib.crc32(ids.tobytes())
    text = "\x00".join(t or "" for t in batch.column("text").to_pylist()).encode()
    return (value << 31) | (zlib.crc32(text) >> 1)


def encode_documents(docs: DataFrame, path: str | None = None, decode: bool = True) -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row of ``docs(doc_id, text)``.

    ``ids`` are those of the tokenizers library with ``add_special_tokens``
    off; ``decoded`` is its ``decode(ids, skip_special_tokens=False)`` (null if
    ``decode`` is off).  A null or empty text has no ids and decodes to an empty text.  Rows
    with a null or repeated ``doc_id`` are rows like any other; other columns
    are ignored; an empty table gives no rows.  The tokenizer must be of
    byte level and split before a single space, as public ones of this kind do.
    """
    path = path or tokenizer_path()
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS, int(BUCKETS * (total / BUCKET_TEXT) ** 0.6))
    table_of_pieces = docs.sparkSession.sparkContext.broadcast(opened(path).pieces() if decode else None)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = opened(path)
        for batch in gathered(batches, CHUNK_BYTES):
            _, _, distinct = _split(batch.column("text"), tokenizer)
            order, bucket, raw = _bucketed(distinct, buckets)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                own = [raw[k] for k in order[a:b].tolist()]
                blobs.append(zstandard.ZstdCompressor(level=3).compress(np.array([len(own), *map(len, own)], np.uint32).tobytes() + b"".join(own)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array(np.full(len(edges), _name(batch))), pa.array(blobs, pa.binary())], ["bucket", "chunk", "words"])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = opened(path)
        for batch in gathered(batches, CHUNK_BYTES):
            counts, numbers, distinct = _split(batch.column("text"), tokenizer)
            order, _, _ = _bucketed(distinct, buckets)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            data = pack(place[numbers].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([_name(batch)]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["chunk", "doc_ids", "counts", "numbers"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known, last = opened(path), {}, None
        for batch in batches:
            for bucket, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "words")), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                data = _unpack(blob)
                n = int(np.frombuffer(data, np.uint32, 1)[0])
                ends = 4 * (n + 1) + np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)
                own = [data[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]
                new = [w for w in dict.fromkeys(own) if w not in known]
                for w, ids in zip(new, tokenizer.encode([w.decode() for w in new]), strict=True):
                    known[w] = np.array(ids, np.uint32).tobytes()
                found = [known[w] for w in own]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([bucket]), pa.array([pack(np.array([n, *(len(x) // 4 for x in found)], np.uint32), np.frombuffer(b"".join(found), np.uint32))], pa.binary())], ["chunk", "bucket", "ids"])

    def joined(key: tuple, rows: pa.Table, encoded: pa.Table) -> pa.Table:
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        told: set[int] = set()
        encoded = encoded.sort_by("bucket")
        for bucket, blob in zip(encoded.column("bucket").to_pylist(), encoded.column("ids").to_pylist(), strict=True):
            if bucket in told:  # a chunk that is there twice
                continue
            told.add(bucket)
            data = np.frombuffer(_unpack(blob), np.uint32)
            sizes.append(data[1 : 1 + data[0]].astype(np.int64))
            ids.append(data[1 + data[0] :])
        size, flat = np.concatenate(sizes), np.concatenate(ids).astype(np.int64)
        start = np.cumsum(size) - size
        del sizes, ids
        if decode:
            # The id-to-piece join, once for each distinct word of the chunk: its bytes, and where they start.
            letters, at = table_of_pieces.value
            length = np.diff(at)[flat]
            spoken = letters[_ranges(at[flat], length)]
            word_at = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(size)])]
            word_bytes = np.diff(word_at)
        out_ids, out_docs, out_text = [], [], []
        for doc_ids, counts, blob in zip(*(rows.column(c).to_pylist() for c in ("doc_ids", "counts", "numbers")), strict=True):
            number = np.frombuffer(_unpack(blob), np.uint32)
            if len(number) and number.max() >= len(size):
                raise RuntimeError("the documents came in another order when they were read again")
            # Some documents at a time, so that what grows with their tokens and bytes stays small.
            ends = np.cumsum(counts, dtype=np.int64)
            first = done = 0
            while first < len(doc_ids):
                last = min(len(doc_ids), max(first + 1, int(np.searchsorted(ends, done + PART_BYTES // 6, side="right"))))
                own = number[done : ends[last - 1]].astype(np.int64)
                bounds = np.concatenate([[0], ends[first:last] - done])
                of_word = size[own]
                token = flat[_ranges(start[own], of_word)].astype(np.int32)
                out_docs.append(pa.array(doc_ids[first:last], pa.int64()))
                out_ids.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(of_word)])[bounds].astype(np.int32)), pa.array(token)))
                if decode:
                    out_text.append(_strings(spoken[_ranges(word_at[own], word_bytes[own])], np.concatenate([[0], np.cumsum(word_bytes[own])])[bounds]))
                else:
                    out_text.append(pa.nulls(last - first, pa.string()))
                first, done = last, int(ends[last - 1])
        if not out_docs:
            return pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]).empty_table()
        return pa.table({"doc_id": pa.concat_arrays(out_docs), "ids": pa.concat_arrays(out_ids), "decoded": pa.concat_arrays(out_text)})

    table = docs.mapInArrow(words, "bucket long, chunk long, words binary").repartition("bucket").sortWithinPartitions("bucket")
    encoded = table.mapInArrow(encode, "chunk long, bucket long, ids binary")
    places = docs.mapInArrow(positions, "chunk long, doc_ids array<long>, counts array<long>, numbers binary")
    return places.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(joined, "doc_id long, ids array<int>, decoded string")


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of UTF-8 bytes; what isn't UTF-8 is replaced as a lenient decoder does."""
    texts = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
    return texts


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start+1, ..., start+size-1 of each pair, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
