"""Language-model scoring with a hidden Markov model.

Words fall into classes: the commonest words have one each (as many as the
training corpus can support, so the model grows with it), the others share
classes by their last bytes.  A document's probability is the product of the
HMM's probability of its class sequence and of each word's probability within
its class (from the exact counts of the whole training corpus).  Baum-Welch
counts are summed over all partitions, round after round over the whole
training corpus until a round gains next to nothing; the scaled forward
recursion gives the exact likelihood of the classes.

Word counts go from chunks of documents to hash buckets and back in packed
form, so the vocabulary may outgrow any machine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheregrid.llm.common import gathered, saved, small_batches
from spheregrid.llm.langid import held_out
from spheregrid.llm.sequences import Packed
from spheregrid.llm.tokens import Words

STATES = 6
#: Classes of the words that have none of their own; one more class ends a text.
SHARED = 512
#: Rounds of Baum-Welch, each over the whole training corpus: until one gains less than so many nats a token, and no more than so many.
ROUNDS, GAIN = 22, 1e-3
#: Tokens whose recursions run side by side: the steps of the longest text are shared by many others.
STEP_TOKENS = 600_000
CHUNK_BYTES, BUCKET_WORDS = 8_000_000, 400_000
SMOOTHING = 0.1


def own_classes(tokens: int) -> int:
    """How many of the commonest words have a class of their own: four times the cube root of the training tokens (1,024 for 16 million, 40,000 for a trillion)."""
    return max(1024, round(4 * tokens ** (1 / 3)))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Chunks with the word count of each text, the distinct words' hashes and classes, and the number of each word."""
    for chunk in gathered(batches, CHUNK_BYTES):
        hashes, groups, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], []
        for at in range(0, chunk.num_rows, 200):
            words = Words(chunk.column("text").slice(at, 200))
            hashes.append(words.hashes().view(np.int64))
            # Classes of words that are not common: by the hash of their last two bytes.
            groups.append((words.hash_of(np.maximum(words.start, words.end - 2), words.end) % np.uint64(SHARED)).astype(np.uint16))
            counts.append(words.counts)
        distinct, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        yield chunk, np.concatenate(counts), distinct, number, np.concatenate(groups)[first]


def _name(part: pa.RecordBatch) -> int:
    ids = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "\x00".join(t or "" for t in part.column("text").to_pylist()).encode()
    return (zlib.crc32(ids.tobytes()) << 31) | (zlib.crc32(text) >> 1)


def _bucket(distinct: np.ndarray, buckets: int) -> np.ndarray:
    return (distinct.view(np.uint64) >> np.uint64(33)).astype(np.int64) % buckets


@dataclass
class Hmm:
    """Probabilities: of the first state, of the next state, and of each class in a state."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(classes: int, states: int, seed: int, frequency: np.ndarray) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = (frequency + 1e-9) * rng.uniform(0.2, 1.8, (states, classes))
        step = np.full((states, states), 0.02 / max(1, states - 1)) + np.eye(states) * 0.98
        return Hmm(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def of_counts(start: np.ndarray, step: np.ndarray, emit: np.ndarray, frequency: np.ndarray) -> Hmm:
        """Maximum likelihood with pseudo-counts: a few of each class by its frequency keep every text possible."""
        start, step, emit = start + SMOOTHING, step + SMOOTHING, emit + 20 * (frequency + 1e-7) + 1e-6
        return Hmm(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each sequence by the scaled forward recursion."""
        packed = Packed(counts)
        _, scale = packed.forward(self.emit[:, classes[packed.order]], self.start, self.step)
        return packed.sums(np.log10(scale))

    def counts(self, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, steps and emissions: the E-step; and the log likelihood."""
        packed = Packed(counts)
        own = classes[packed.order]
        marginal, first, pairs, scale = packed.backward(self.emit[:, own], self.start, self.step)
        emit = np.stack([np.bincount(own, weights=each, minlength=self.emit.shape[1]) for each in marginal])
        return first, pairs, emit, np.log(scale).sum(keepdims=True)


def _decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(_unpack(x), np.uint32) for x in batch.column("classes").to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)).astype(np.int64), np.array([len(p) for p in parts], np.int64)


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The decoded texts of all batches, some ``STEP_TOKENS`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            held.append(_decoded(batch.slice(at, 200)))
            size += len(held[-1][0])
            if size >= STEP_TOKENS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _baum_welch(encoded: DataFrame, model: Hmm, frequency: np.ndarray) -> tuple[Hmm, float]:
    """One round over the whole training corpus, every task sending one sum for each parameter; and the log likelihood before it."""
    told = encoded.sparkSession.sparkContext.broadcast(model)
    states, classes = model.emit.shape
    size = states + states * states + states * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        total = np.zeros(size)
        for classes_, counts in _side_by_side(batches):
            total += np.concatenate([x.ravel() for x in own.counts(classes_, counts)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "v"])

    rows = encoded.where("not held_out").select("classes").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    told.unpersist()
    total = np.zeros(size)
    total[[r["k"] for r in rows]] = [r["v"] for r in rows]
    start, step, emit, likelihood = np.split(total, [states, states + states * states, size - 1])
    return Hmm.of_counts(start, step.reshape(states, states), emit.reshape(states, classes), frequency), float(likelihood[0])


def learn(encoded: DataFrame, model: Hmm, frequency: np.ndarray, tokens: int, rounds: int = ROUNDS, gain: float = GAIN) -> Hmm:
    """Baum-Welch from ``model`` on, until a round gains less than ``gain`` nats a token."""
    before = -np.inf
    for _ in range(rounds):
        model, now = _baum_welch(encoded, model, frequency)
        if now - before < gain * tokens:
            break
        before = now
    return model


def score_documents(docs: DataFrame, parts: int = 10, part: int = 0, states: int = STATES, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs(doc_id, text)``.

    The model learns from the rows whose crc32 of ``doc_id`` modulo ``parts``
    isn't ``part`` (a null ``doc_id`` counts among them).  Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end; a null text is
    empty.  ``base_score`` is the additively smoothed unigram log10
    probability, ``score`` the HMM's; a word never seen in training has in its
    class the probability of a tenth of an occurrence.  Repeated rows count
    each; other columns are ignored; an empty table gives no rows.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), parts, part).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.sum((~F.col("held_out")).cast("long"))).first()
    train_docs = size[2] or 0
    common_words = own_classes((size[0] or 0) // 6)
    buckets = max(16, (size[0] or 0) // 10 // BUCKET_WORDS)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's words by bucket; its positions are in the row of bucket -1."""
        for chunk, counts, distinct, number, group in _chunks(batches):
            train = ~chunk.column("held_out").to_numpy(zero_copy_only=False)
            seen = np.bincount(number[np.repeat(train, counts)], minlength=len(distinct)).astype(np.uint32)
            bucket = _bucket(distinct, buckets)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            ends = np.append(edges[1:], len(order))
            name = _name(chunk)
            blobs = [_pack(np.array([b - a], np.uint32), seen[order[a:b]], distinct[order[a:b]], group[order[a:b]]) for a, b in zip(edges, ends, strict=True)]
            ids = chunk.column("doc_id")
            head = _pack(np.array([len(ids)], np.uint32), train.astype(np.uint8), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), counts.astype(np.uint32), place[number].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(bucket[order[edges]] if len(order) else [], -1).astype(np.int64)), pa.array(np.full(len(edges) + 1, name)), pa.array([*blobs, head], pa.binary())], ["bucket", "chunk", "data"])

    table = saved(docs.mapInArrow(words, "bucket long, chunk long, data binary"))

    def parse(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = _unpack(blob)
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        return np.frombuffer(data, np.uint32, n, 4), np.frombuffer(data, np.int64, n, 4 + 4 * n), np.frombuffer(data, np.uint16, n, 4 + 12 * n)

    def count(rows: pa.Table) -> pa.Table:
        """The exact training counts of one bucket, packed back for each chunk, and what the whole vocabulary needs of them."""
        own = [parse(b) for b in rows.column("data").to_pylist()]
        h, first, number = np.unique(np.concatenate([x[1] for x in own]), return_index=True, return_inverse=True)
        total = np.bincount(number, weights=np.concatenate([x[0] for x in own])).astype(np.int64)
        group = np.concatenate([x[2] for x in own])[first].astype(np.int64)
        often = np.argsort(-total, kind="stable")[:common_words]
        often = often[total[often] > 0]
        known = total > 0
        bounds = np.cumsum([0, *(len(x[0]) for x in own)])
        blobs = [_pack(np.array([len(x[0])], np.uint32), total[number[a:b]].astype(np.uint64), x[1], x[2]) for x, a, b in zip(own, bounds[:-1], bounds[1:], strict=True)]
        tokens, types = np.bincount(group, weights=total, minlength=SHARED).astype(np.int64), np.bincount(group[known], minlength=SHARED)
        n = len(own)
        return pa.table(
            {
                "bucket": pa.concat_arrays([rows.column("bucket").combine_chunks(), pa.array(np.full(1, rows.column("bucket")[0].as_py()))]),
                "chunk": pa.concat_arrays([rows.column("chunk").combine_chunks(), pa.nulls(1, pa.int64())]),
                "data": pa.array([*blobs, None], pa.binary()),
                "often": pa.array([None] * n + [[{"h": int(h[k]), "n": int(total[k]), "group": int(group[k])} for k in often]], pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64()), ("group", pa.int64())]))),
                "tokens": pa.array([None] * n + [tokens.tolist()], pa.list_(pa.int64())),
                "types": pa.array([None] * n + [types.tolist()], pa.list_(pa.int64())),
            }
        )

    counted = saved(table.where("bucket >= 0").groupBy("bucket").applyInArrow(count, "bucket long, chunk long, data binary, often array<struct<h:long,n:long,group:long>>, tokens array<long>, types array<long>"))
    sums = counted.where("chunk is null").select(F.posexplode(F.arrays_zip("tokens", "types")).alias("g", "x")).groupBy("g").agg(F.sum("x.tokens").alias("t"), F.sum("x.types").alias("v")).collect()
    tokens, types = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in sums:
        tokens[r["g"]], types[r["g"]] = r["t"], r["v"]
    common = counted.where("chunk is null").select(F.explode("often").alias("x")).select("x.*").orderBy(F.desc("n"), "h").limit(common_words).collect()
    n, v = int(tokens.sum()) + train_docs, int(types.sum()) + (train_docs > 0)
    for r in common:
        tokens[r["group"]] -= r["n"]
        types[r["group"]] -= 1
    frequency = np.concatenate([[r["n"] for r in common], tokens, [train_docs]]).astype(float)
    frequency /= max(1.0, frequency.sum())
    vocabulary = (np.array([r["h"] for r in common], np.int64), tokens, types)
    end_class, denominator = len(common) + SHARED, n + SMOOTHING * (v + 1)
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(key: tuple, heads: pa.Table, lists: pa.Table) -> pa.Table:
        """Each document's classes, and the parts of its score that don't depend on states."""
        top, rest, kinds = told.value
        order = np.argsort(top)
        log_c, log_in, classes, known = [], [], [], []
        lists = lists.sort_by("bucket")
        done: set[int] = set()
        for bucket, blob in zip(lists.column("bucket").to_pylist(), lists.column("data").to_pylist(), strict=True):
            if bucket in done:
                continue
            done.add(bucket)
            data = _unpack(blob)
            m = int(np.frombuffer(data, np.uint32, 1)[0])
            c, h, group = np.frombuffer(data, np.uint64, m, 4).astype(float), np.frombuffer(data, np.int64, m, 4 + 8 * m), np.frombuffer(data, np.uint16, m, 4 + 16 * m).astype(np.int64)
            at = np.minimum(np.searchsorted(top[order], h), max(0, len(top) - 1))
            is_top = top[order][at] == h if len(top) else np.zeros(m, bool)
            log_c.append(np.log10((c + SMOOTHING) / denominator))
            inside = np.log10((c + SMOOTHING) / (rest[group] + SMOOTHING * (kinds[group] + 1)))
            log_in.append(np.where(is_top, 0.0, inside))
            classes.append(np.where(is_top, order[at] if len(top) else 0, len(top) + group))
            known.append(c > 0)
        empty = np.zeros(0)
        log_c, log_in, classes, known = (np.concatenate([empty, *x]) for x in (log_c, log_in, classes, known))
        out = []
        for blob in heads.column("data").to_pylist():
            data = _unpack(blob)
            m = int(np.frombuffer(data, np.uint32, 1)[0])
            train, valid = np.frombuffer(data, np.uint8, m, 4).astype(bool), np.frombuffer(data, np.uint8, m, 4 + m).astype(bool)
            ids, counts = np.frombuffer(data[4 + 2 * m : 4 + 10 * m], np.int64), np.frombuffer(data[4 + 10 * m : 4 + 14 * m], np.uint32).astype(np.int64)
            number = np.frombuffer(data[4 + 14 * m :], np.uint32).astype(np.int64)
            if len(number) and number.max() >= len(log_c):
                raise RuntimeError("a chunk's words are missing")
            doc = np.repeat(np.arange(m), counts)
            base = np.bincount(doc, weights=log_c[number], minlength=m) + np.log10((train_docs + SMOOTHING) / denominator)
            inner = np.bincount(doc, weights=log_in[number], minlength=m)
            hits = np.bincount(doc, weights=known[number], minlength=m).astype(np.int64) + (train_docs > 0)
            own, bounds = classes[number].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])
            packed = [_pack(np.append(own[a:b], np.uint32(end_class))) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            out.append(pa.table({"doc_id": pa.array(ids, mask=~valid), "held_out": pa.array(~train), "n_tokens": pa.array(counts + 1), "n_known": pa.array(hits), "base_score": pa.array(base), "inner": pa.array(inner), "classes": pa.array(packed, pa.binary())}))
        return pa.concat_tables(out)

    pairs = table.where("bucket < 0").groupBy("chunk").cogroup(counted.where("chunk is not null").select("bucket", "chunk", "data").groupBy("chunk"))
    encoded = saved(pairs.applyInArrow(encode, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary"))

    model = learn(encoded, Hmm.first(len(frequency), states, seed, frequency), frequency, n, rounds)
    final = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 800):
                one = batch.slice(at, 800)
                value = final.value.log10(*_decoded(one)) + one.column("inner").to_numpy()
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("held_out"), one.column("n_tokens"), one.column("n_known"), pa.array(np.full(one.num_rows, n)), one.column("base_score"), pa.array(value)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
