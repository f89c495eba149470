"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits; their features are hashes of the
lower-cased token and of its first bytes, and the tokens before and after.
The labels say only which documents are toxic, so tokens are labelled first: a
token of a toxic document is toxic if one of its features occurs in enough
toxic and in next to no other documents.  The CRF (states clean and toxic)
learns from those tokens by gradient ascent on their likelihood, all weights
from zero: of the features that mark tokens, of the commonest tokens of any
kind, of the same ones as neighbours, and of the four steps between states.
Forward-backward marginals give each token's probability, offending offsets,
and a document score calibrated on the same training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.common import small_batches

from spheregrid.llm.langid import held_out
from spheregrid.llm.sequences import Packed
from spheregrid.llm.tokens import Words, mix, shingle_sets

#: Bounds of the fitting sample: documents of each label, whole, and bytes of their texts; the document that reaches the bound is the last.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 12_000_000
#: Texts of the sample that are cut to tokens at once.
PART_BYTES = 1_000_000
#: Tokens whose recursions run side by side.
STEP_TOKENS = 400_000
#: First bytes of a token that are features of it, beside the whole token.
PREFIXES = (4, 5, 6, 7, 8)
#: Share of a feature's documents that must be toxic for it to mark a token.
MIN_SHARE = 0.97
#: So many of the commonest tokens are features too, whatever their documents' labels.
COMMON = 4096
THRESHOLD = 0.7
#: Marginals below this don't add up to a document's score.
NOISE = 0.01
#: Added to the expected number of toxic tokens.
FLOOR = 1e-3
_BUCKETS = 1 << 22


def token_features(words: Words) -> list[np.ndarray]:
    whole = mix(words.hashes() + np.uint64(99)).view(np.int64)
    # A prefix as long as the token or longer repeats the token: 0 stands for none.
    length = words.end - words.start
    return [whole] + [np.where(length > n, words.prefixes(n).view(np.int64), 0) for n in PREFIXES]


def _placed(feature: np.ndarray, columns: list[np.ndarray], first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tokens, weights) pairs: each token's own features, then its neighbours' (weights one and two tables further).

    ``first`` marks the first tokens of texts, which have nothing before them.
    """
    out, size = [], len(feature)
    if not size:
        return out
    seen = np.zeros(_BUCKETS, bool)
    seen[feature & (_BUCKETS - 1)] = True
    for hashes in columns:
        at = np.flatnonzero(seen[hashes & (_BUCKETS - 1)])
        k = np.minimum(np.searchsorted(feature, hashes[at]), size - 1)
        own = feature[k] == hashes[at]
        out.append((at[own].astype(np.int32), k[own].astype(np.int32)))
    at, k = out[0]
    n = len(first)
    ahead = (at + 1 < n) & ~first[np.minimum(at + 1, n - 1)]
    out.append((at[ahead] + 1, k[ahead] + np.int32(size)))
    behind = ~first[at]
    out.append((at[behind] - 1, k[behind] + np.int32(2 * size)))
    return out


def _firsts(counts: np.ndarray) -> np.ndarray:
    first = np.zeros(int(counts.sum()), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    return first


@dataclass
class Crf:
    """Two states; ``weight`` is what a feature (of a token, of the one before, of the one after) adds to the toxic state's log potential."""

    feature: np.ndarray  # ascending hashes
    weight: np.ndarray
    bias: float
    edge: np.ndarray  # log potentials (from, to)
    calibration: tuple[float, float]  # document logit = a * log(expected toxic tokens) + b
    empty: float  # score of a text without tokens

    def emission(self, words: Words) -> np.ndarray:
        """Log potential of the toxic state over the clean one, for each token."""
        out = np.full(len(words.start), self.bias)
        for at, k in _placed(self.feature, token_features(words), _firsts(words.counts)):
            out[at] += self.weight[k]
        return out


def forward_backward(counts: np.ndarray, toxic: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state and expected edge counts of all sequences; ``toxic`` is its log potential over the clean one.

    Sequences go through some ``STEP_TOKENS`` at a time, which bounds the memory.
    """
    out, pairs = np.empty(len(toxic)), np.zeros((2, 2))
    ends = np.concatenate([[0], np.cumsum(counts)])
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP_TOKENS, side="right")) - 1)
        own = slice(ends[first], ends[last])
        packed = Packed(counts[first:last])
        log = toxic[own][packed.order]
        shift = np.maximum(log, 0)
        marginal, _, more, _ = packed.backward(np.stack([np.exp(-shift), np.exp(log - shift)]), np.ones(2), np.exp(edge))
        out[own][packed.order] = marginal[1]
        pairs += more
        first = last
    return out, pairs


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in turn, some ``PART_BYTES`` characters at a time."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PART_BYTES or i == len(texts) - 1:
            yield texts[start : i + 1]
            start, size = i + 1, 0


def families(texts: list[str], hashes: int = 6, percent: int = 80) -> np.ndarray:
    """Which of the sample's texts to learn from: those that aren't near copies of an earlier one, which would count as evidence twice.

    Texts that share one of ``hashes`` min-hashes of their sets of three-word
    shingles are looked at, and an earlier one that is kept is a near copy's if
    the intersection is at least ``percent`` of the union.
    """
    seen: dict[tuple[int, int], list[int]] = {}
    sets: list[np.ndarray] = []
    keep: list[bool] = []
    for part in _parts(texts):
        values, offsets = shingle_sets(pa.array(part, pa.string()), 3)
        for i in range(len(part)):
            own = np.unique(values[offsets[i] : offsets[i + 1]].view(np.uint64))
            signature = [(k, int(mix(own + np.uint64(k)).min())) for k in range(hashes)] if len(own) else []
            near = False
            for other in {j for s in signature for j in seen.get(s, ())}:
                small, large = sorted((len(own), len(sets[other])))
                if 100 * small >= percent * large:
                    shared = len(np.intersect1d(own, sets[other], assume_unique=True))
                    if 100 * shared >= percent * (small + large - shared):
                        near = True
                        break
            keep.append(not near)
            if not near:
                for s in signature:
                    seen.setdefault(s, []).append(len(sets))
                sets.append(own)
    return np.array(keep, bool)


def fit(texts: list[str], toxic: list[int], rounds: int = 30) -> Crf:
    """A CRF from a bounded number of labelled documents, in memory."""
    keep = families(texts)
    texts, y = [t for t, k in zip(texts, keep, strict=True) if k], np.array(toxic, int)[keep]
    # A part at a time, as the work on bytes takes many times their size.  What stays is each token's kind, and each kind's features.
    tokens, counts, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((1 + len(PREFIXES), 0), np.int64)]
    for part in _parts(texts):
        words = Words(pa.array(part, pa.string()), alnum=True)
        columns = token_features(words)
        counts.append(words.counts)
        tokens.append(columns[0])
        kinds.append(np.stack(columns)[:, np.unique(columns[0], return_index=True)[1]])
        del words, columns
    kinds, counts = np.concatenate(kinds, axis=1), np.concatenate(counts)
    kinds = kinds[:, np.unique(kinds[0], return_index=True)[1]]
    code = np.searchsorted(kinds[0], np.concatenate(tokens)).astype(np.int32)
    del tokens
    document = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    size = kinds.shape[1]
    # Each kind with each document that has it.
    pair = np.unique(document.astype(np.int64) * max(size, 1) + code)
    of, where = (pair % max(size, 1)).astype(np.int32), (pair // max(size, 1)).astype(np.int32)
    del pair
    # Features that mark toxic tokens: whole tokens first, then ever shorter beginnings of the tokens that are still unexplained.
    rate = min(max(y.mean() if len(y) else 0.5, 1e-3), 0.99)
    open_, chosen = np.ones(size, bool), [np.zeros(0, np.int64)]
    for hashes in [kinds[0], *kinds[:0:-1]]:
        names, name = np.unique(hashes, return_inverse=True)
        own = (open_ & (hashes != 0))[of]
        met = np.unique(where[own].astype(np.int64) * max(len(names), 1) + name[of[own]])
        k, d = met % max(len(names), 1), met // max(len(names), 1)
        bad = np.bincount(k, weights=y[d], minlength=len(names))
        good = (np.bincount(k, minlength=len(names)) - bad) * rate / (1 - rate)  # as if both labels were equally common
        # So many toxic documents that no feature of clean origin is likely to reach them by chance; with few labels, a seventh of them.
        enough = np.log(max(int((bad + good > 0).sum()), 1) / 0.01) / -np.log(rate)
        marks = names[(bad >= min(enough, max(3.0, 0.15 * y.sum()))) & (bad / np.maximum(bad + good, 1e-9) >= MIN_SHARE)]
        chosen.append(marks)
        open_ &= ~np.isin(hashes, marks)
    marks = np.unique(np.concatenate(chosen))
    tag = np.isin(kinds, marks).any(axis=0)[code]
    tag &= y[document] == 1 if len(y) else False
    # The commonest tokens of all documents, ties by hash.
    often = np.bincount(of, minlength=size)
    common = kinds[0][np.lexsort((kinds[0], -often))[:COMMON]]
    feature = np.unique(np.concatenate([marks, common])) if len(marks) else marks
    # For each kind its features' places in the table, the last place standing for none.
    place = np.minimum(np.searchsorted(feature, kinds), max(0, len(feature) - 1))
    place = np.where(feature[place] == kinds, place, len(feature)) if len(feature) else np.zeros(kinds.shape, int)
    del kinds, of, where
    first = _firsts(counts)
    width = len(feature) + 1
    # Where nothing marks a token, none is toxic.
    weight, bias, edge = np.zeros((3, width)), 0.0 if len(feature) else -30.0, np.zeros((2, 2))
    # Damped Newton steps with the diagonal of the curvature, on the conditional log-likelihood with an L2 prior; some six weights share a token.
    prior, damping = 0.01, 6.0
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[inner - 1].astype(int), tag[inner].astype(int)), 1)

    def emission() -> np.ndarray:
        own, ahead, behind = weight[0][place].sum(axis=0), weight[1][place[0]], weight[2][place[0]]
        log = own[code] + bias
        log[inner] += ahead[code[inner - 1]]
        log[inner - 1] += behind[code[inner]]
        return log

    def gathered(values: np.ndarray) -> np.ndarray:
        """The sums of a value of each token over the weights it has: its own, the one before's and the one after's."""
        own = np.bincount(code, weights=values, minlength=size)
        ahead = np.bincount(code[inner - 1], weights=values[inner], minlength=size)
        behind = np.bincount(code[inner], weights=values[inner - 1], minlength=size)
        out = np.stack([sum(np.bincount(p, weights=own, minlength=width) for p in place), *(np.bincount(place[0], weights=x, minlength=width) for x in (ahead, behind))])
        out[:, -1] = 0  # what is no feature keeps its weight of 0
        return out

    for _ in range(rounds if len(feature) else 0):
        marginal, expected = forward_backward(counts, emission(), edge)
        error, spread = tag - marginal, marginal * (1 - marginal)
        # No weight moves by more than 1 a round: where classes separate the curvature vanishes.
        weight = weight + np.clip((gathered(error) - prior * weight) / (damping * gathered(spread) + prior), -1.0, 1.0)
        bias += float(np.clip(error.sum() / (damping * spread.sum() + prior), -1.0, 1.0))
        share = expected / max(expected.sum(), 1e-9)
        edge = edge + np.clip((seen - expected - prior * edge) / (damping * expected * (1 - share) + prior), -0.5, 0.5)
    log = emission()
    weight = weight[:, :-1].ravel()
    model = Crf(feature, weight, bias, edge, (1.0, 0.0), 0.0)
    # Calibration: logistic regression of the label, both labels weighing the same, on the log of the expected number of toxic tokens.
    x = np.stack([np.log(_expected(document, len(counts), forward_backward(counts, log, edge)[0]) + FLOOR), np.ones(len(y))], axis=1)
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    theta, prior = np.array([1.0, 2.0]), np.array([1.0, 2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (balance * (y - p)) - 1e-3 * (theta - prior)
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        theta = theta + move / max(1.0, 2 * float(np.abs(move).max()))
    a, b = map(float, theta)
    model.calibration = (max(a, 1e-3), b)
    model.empty = float(1 / (1 + np.exp(-(model.calibration[0] * np.log(FLOOR) + b))))
    return model


def _marginals(words: Words, model: Crf) -> np.ndarray:
    return forward_backward(words.counts, model.emission(words), model.edge)[0]


def _expected(document: np.ndarray, n: int, marginal: np.ndarray) -> np.ndarray:
    """Expected toxic tokens of each text, without the noise of the many tokens that are hardly possible."""
    return np.bincount(document, weights=np.where(marginal >= NOISE, marginal, 0.0), minlength=n)


def fit_sample(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Crf:
    """The CRF of a bounded hash sample of ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``; at most ``SAMPLE_DOCS`` of each label.

    The documents of the sample are whole.  Where their texts have more than
    ``SAMPLE_BYTES`` of a label, the sample has fewer of them; a text that alone
    has more teaches nothing.  Of an id with several texts the one with the
    least hash is learned from.

    Rows with a null ``doc_id``, text or label teach nothing; of a document
    with several labels any toxic one counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 1.3 * SAMPLE_DOCS / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, 1.3 * SAMPLE_DOCS / max(1, counts.get(0, 0)))))
    few = known.where(F.pmod(key, F.lit(1 << 30)) < share * (1 << 30)).withColumn("key", key)
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("toxic").orderBy("key", "doc_id"))).where(F.col("at") <= SAMPLE_DOCS).select("doc_id", "toxic", "at")
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(few), "doc_id").withColumn("hash", F.xxhash64("text"))
    chosen = rows.groupBy("doc_id", "toxic", "at").agg(F.min(F.struct("hash", F.octet_length("text").alias("bytes"))).alias("x")).select("toxic", "at", "x.*")
    last, size = {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in chosen.orderBy("at").collect():
        size[r["toxic"]] += r["bytes"]
        if size[r["toxic"]] <= SAMPLE_BYTES:
            last[r["toxic"]] = r["at"]
    wanted = chosen.where(F.col("at") <= F.when(F.col("toxic") == 1, F.lit(last[1])).otherwise(F.lit(last[0]))).select("toxic", "at", "hash")
    rows = rows.join(F.broadcast(wanted), ["toxic", "at", "hash"]).select("doc_id", "toxic", "text").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def tag(docs: DataFrame, model: Crf, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` in ``row``, with ``score``, ``predicted`` and ``spans``.

    ``spans`` lists ``(start, end, probability)`` of the tokens whose marginal
    is one half at least; offsets are bytes of the UTF-8 text.  Whole texts are
    tagged.  A text without tokens, or a null one, has the score of no toxic
    token expected and no spans.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<start:long,end:long,probability:double>>"
    schema = docs.select(F.struct("*").alias("row"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast(span).alias("spans")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        a, b = own.calibration
        for batch in batches:
            # A part of a batch at a time bounds the memory of long texts.
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                words = Words(part.column("text"), alnum=True)
                marginal = _marginals(words, own)
                expected = _expected(words.doc, len(words.counts), marginal)
                score = 1 / (1 + np.exp(-np.clip(a * np.log(expected + FLOOR) + b, -30, 30)))
                hit = np.flatnonzero(marginal >= 0.5)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(words.doc[hit], minlength=part.num_rows))]).astype(np.int32)
                origin = words.offsets[words.doc[hit]]
                items = pa.StructArray.from_arrays([pa.array(words.start[hit] - origin), pa.array(words.end[hit] - origin), pa.array(marginal[hit])], ["start", "end", "probability"])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), items)], ["row", "score", "predicted", "spans"])

    return small_batches(docs).select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_spans)`` for every row of ``docs(doc_id, text)``.

    Labels are learned only from rows whose crc32 of ``doc_id`` modulo
    ``parts`` isn't ``part``.  Other columns are ignored; an empty table gives
    no rows; without labels every score is the prior's.
    """
    learned = labels.where(~held_out(F.col("doc_id"), parts, part))
    model = fit_sample(docs.select("doc_id", "text"), learned)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return tag(texts, model, threshold).select("row.doc_id", held_out(F.col("row.doc_id"), parts, part).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def keep_civil(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    model = fit_sample(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"), parts, part)))
    return tag(docs, model, threshold).where("predicted = 0").select("row.*")
