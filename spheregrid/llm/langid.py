"""Language identification by compression.

Each language has a zstandard raw-content dictionary of labelled text.  A text
is encoded with every dictionary, piece by piece so that a long text can't
learn from itself, and belongs to the language whose encoding is smallest.
Where the runner-up is nearly as small the decision is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.common import small_batches

#: Bounds of the fitting sample: documents of a language, and pieces of each, cut at hashed places of the whole text, in characters.
SAMPLE_DOCS, PLACES, PLACE = 400, 4, 600
#: Bytes of a dictionary, and of all together: with more than 71 languages each one's gets smaller, down to the least.
DICTIONARY_BYTES, ALL_BYTES, LEAST_BYTES = 112_640, 8_000_000, 1024
#: So many languages, the commonest, can be learned.
MAX_LANGUAGES = ALL_BYTES // LEAST_BYTES
PIECE = 2048
#: Bytes of the parts of the sample that are judged apart.
PART = 300
#: A decision is accepted if the best encoding is smaller than the next by this share.
MIN_MARGIN = 0.01

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def normal(text: str) -> bytes:
    """Lower case, letters only, words parted by single spaces."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def parameters(size: int) -> zstandard.ZstdCompressionParameters:
    """For dictionaries of ``size`` bytes: short matches against them count, repetitions at any distance do too."""
    bits = max(10, min(17, size.bit_length()))
    return zstandard.ZstdCompressionParameters(window_log=17, hash_log=bits, chain_log=bits - 1, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)


def fit_dictionaries(labelled: DataFrame, seed: int = 5) -> dict[str, bytes]:
    """A dictionary for each language of ``labelled(doc_id, text, lang)``, from a bounded hash sample of its documents.

    The sample is at most ``SAMPLE_DOCS`` documents of a language; of each, up
    to ``PLACES`` pieces of ``PLACE`` characters come from hashed places, one
    in each equal stretch of the whole text.  The parts that agree with the
    rest fill the dictionary in turn, the first of every document before the
    second of any.  Rows with a null in any of the three columns teach nothing.
    """
    rows = labelled.where("doc_id is not null and text is not null and lang is not null").withColumn("text", F.col("text").cast("string"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    few = rows.join(F.broadcast(counts), "lang").where(F.pmod(key, F.lit(1 << 30)) < F.least(F.lit(1.0), 2.0 * SAMPLE_DOCS / F.col("n")) * (1 << 30)).withColumn("key", key)
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).where(F.col("at") <= SAMPLE_DOCS)
    # The stretches of a text, and a place in each.
    size = F.length("text")
    places = F.greatest(F.lit(1), F.least(F.lit(PLACES), F.ceil(size / PLACE)))
    cut = few.withColumn("stretch", F.floor(size / places)).withColumn("place", F.explode(F.sequence(F.lit(0), places.cast("int") - 1)))
    first = F.col("place") * F.col("stretch") + F.pmod(F.xxhash64("key", "place"), F.greatest(F.lit(1), F.col("stretch") - PLACE + 1))
    cut = cut.select("lang", "at", "place", F.substr("text", (first + 1).cast("int"), F.lit(PLACE)).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in cut.orderBy("lang", "place", "at").collect():
        texts.setdefault(r["lang"], []).append(normal(r["text"]))
    size = max(LEAST_BYTES, min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(texts))))
    return {lang: _joined(parts, size) for lang, parts in _agreeing(texts, size).items()}


def _joined(parts: list[bytes], size: int) -> bytes:
    """The parts up to ``size`` bytes, the first of them last, where matches are cheapest."""
    return b" ".join(reversed(parts))[-size:]


def _agreeing(texts: dict[str, list[bytes]], size: int) -> dict[str, list[bytes]]:
    """The parts of each language's sample that the other half of the sample takes for that language.

    Passages in another language would make its texts fit the wrong
    dictionary.  A language of which nothing agrees keeps all its parts.
    """
    parts: dict[str, list[bytes]] = {}
    for lang, each in sorted(texts.items()):
        cut = [[t[k : k + PART] for k in range(0, len(t), PART) if k == 0 or len(t) - k >= PART // 5] for t in each]
        # The first part of every piece, then the second ones.
        parts[lang] = [own[n] for n in range(max(map(len, cut), default=0)) for own in cut if n < len(own)]
    judges = [Encoders({lang: _joined(own[half::2], size) for lang, own in parts.items()}) for half in (1, 0)]
    kept = {lang: [x for n, x in enumerate(own) if judges[n % 2].smallest(x) == lang] for lang, own in parts.items()}
    return {lang: kept[lang] or parts[lang] for lang in parts}


class Encoders:
    """One compressor for each language, made once in a task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.each = []
        chosen = parameters(max(map(len, dictionaries.values()), default=0))
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=chosen)
            one = zstandard.ZstdCompressor(dict_data=content, compression_params=chosen)
            self.each.append((one, len(one.compress(b" "))))

    def sizes(self, data: bytes) -> list[int]:
        pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
        return [sum(len(one.compress(p)) - empty for p in pieces) for one, empty in self.each]

    def smallest(self, data: bytes) -> str:
        sizes = self.sizes(data)
        return self.langs[min(range(len(sizes)), key=sizes.__getitem__)]

    def decide(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        """(language or und, margin from 0 to 1, accepted)."""
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0, False
        sizes = self.sizes(normal(text))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = min(1.0, max(0.0, 1 - max(sizes[best], 0) / second)) if second > 0 else 0.0
        return self.langs[best], margin, margin >= min_margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """All columns of ``docs`` in ``row``, with ``lang_pred``, ``score`` and ``accepted``.

    Whole texts are encoded.  A null text, or one without a letter, is ``und``
    with score 0 and not accepted; so is any text if nothing was learned.  Equal
    sizes go to the first language by code point, with score 0.
    """
    told = docs.sparkSession.sparkContext.broadcast(dictionaries)
    schema = docs.select(F.struct("*").alias("row")).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(told.value)
        for batch in batches:
            rows = batch.column("row")
            found = [encoders.decide(t, min_margin) for t in batch.column("text").to_pylist()]
            lang, score, accepted = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([rows, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["row", "lang_pred", "score", "accepted"])

    return small_batches(docs).select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame, parts: int = 4, part: int = 2, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` for every row of ``docs(doc_id, text, lang)``.

    Dictionaries come from the rows whose crc32 of ``doc_id`` modulo ``parts``
    isn't ``part``; a null ``doc_id`` isn't held out and teaches nothing.  An
    empty table gives no rows; other columns are ignored.
    """
    out = held_out(F.col("doc_id"), parts, part)
    dictionaries = fit_dictionaries(docs.where(~out).select("doc_id", "text", "lang"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(texts, dictionaries, min_margin).select("row.doc_id", held_out(F.col("row.doc_id"), parts, part).alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(docs: DataFrame, parts: int = 4, part: int = 2, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` without the rows whose language is undecided; ``lang`` itself stays as it is."""
    dictionaries = fit_dictionaries(docs.where(~held_out(F.col("doc_id"), parts, part)).select("doc_id", "text", "lang"))
    return predict(docs, dictionaries, min_margin).where("accepted").select("row.*")
