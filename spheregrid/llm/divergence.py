"""Source divergence audit: how the words of each source of a language differ from each other source's and from the language's.

A chi-square-like value sums over the whole vocabulary of a language, but most
of a source's counts are zero.  So it is put together by inclusion and
exclusion over supports:

* a term that only one of two sources has costs what depends on its count
  alone: each source's histogram of counts is priced once for each of the
  smoothed zeros of the others;
* terms that neither has cost a constant each;
* terms that both have were so priced twice: postings that meet at a term
  correct that, in tasks that hold a share of the terms and two blocks of
  sources, and give sums, never pairs of postings.

Terms are counted in Python by chunks of whole texts, so what is shuffled are
counts of distinct terms; all arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.common import gathered, saved, small_batches

#: Text of a chunk whose terms are counted at once.
CHUNK_BYTES = 14_000_000
#: Sources of a block, and postings that a task corrects the overlaps of.
BLOCK, SHARD_ROWS = 32, 100_000
#: Copies of a source's totals and of a language's smoothed zeros, among which postings and histograms are dealt.
SALTS = 16
#: Bytes of terms: letters, lower-cased, and all beyond ASCII; the others stand between terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each term of the texts in turn, the text's number and the term."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().translate(_LETTERS) if data is not None else b"", np.uint8)
    ends = ends - ends[0]
    letter = raw != 32
    # A term begins at a letter after none, or where a text begins.
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    first[edges] = letter[edges]
    begins = np.flatnonzero(first)
    kept = np.cumsum(letter, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)
    offsets = np.append(kept[begins].astype(np.int64) - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letter])])
    return np.searchsorted(ends, begins, side="right") - 1, words


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts of each chunk's terms by language and source, and a row without a term for each of these."""
    names = ["lang", "source", "term", "count", "docs"]
    for batch in gathered(batches, size):
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group, of_text = np.unique(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        langs, sources = (x.dictionary.take(pa.array(k)) for x, k in ((lang, group // len(source.dictionary)), (source, group % len(source.dictionary))))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(group), pa.string()), pa.array(np.zeros(len(group), np.int64)), pa.array(np.bincount(of_text))], names)
        text, words = terms_of(batch.column("text"))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        many = len(coded.dictionary)
        each, times = np.unique(text * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        key = of_text[each // many] * many + each % many
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        counts, docs = np.add.reduceat(times[order], starts), np.diff(np.append(starts, len(key)))
        key = key[starts]
        for a in range(0, len(key), 50_000):
            some = key[a : a + 50_000]
            of_group = pa.array(some // many)
            yield pa.RecordBatch.from_arrays([langs.take(of_group), sources.take(of_group), coded.dictionary.take(pa.array(some % many)).cast(pa.string()), pa.array(counts[a : a + 50_000]), pa.array(docs[a : a + 50_000])], names)


def share(count: str, total: str, terms: str) -> Column:
    """``1 + floor(1000000000 * (count + 1) / (total + terms))``; a vocabulary without terms counts as one of one."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * (cast({count} as decimal(19,0)) + 1)) div greatest({total} + {terms}, 1L)")


def cost(p: str, q: str) -> Column:
    """``floor((p - q)^2 / q)``; shares stay under 2^31, so the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _overlaps(key: tuple, rows: pa.Table, size: int) -> pa.Table:
    """What the terms that two sources of these blocks share add to the priced supports, for each ordered pair of the blocks' sources."""
    block_a, block_b = key[1].as_py(), key[2].as_py()
    term = rows.column("term").combine_chunks().dictionary_encode()
    code = (term.chunk(0) if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy(zero_copy_only=False)
    many = np.bincount(code) > 1
    shared = many[code]
    code = (np.cumsum(many) - 1)[code[shared]]
    source, p, zero = (rows.column(c).to_numpy()[shared].astype(np.int64) for c in ("number", "p", "zero"))
    here, column = np.unique(source, return_inverse=True)
    zeros = np.zeros(len(here), np.int64)
    zeros[column] = zero
    table = np.zeros((len(here), int(many.sum())), np.int64)
    table[column, code] = p
    found = []
    for x in range(len(here)):
        for y in range(x + 1, len(here)):
            # Pairs inside a block are left to the task of that block with itself.
            if block_a != block_b and here[x] // size == here[y] // size:
                continue
            both = np.flatnonzero((table[x] > 0) & (table[y] > 0))
            if not len(both):
                continue
            for a, b, p, q in ((x, y, table[x, both], table[y, both]), (y, x, table[y, both], table[x, both])):
                p0, q0 = zeros[a], zeros[b]
                extra = (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q
                found.append((int(here[a]), int(here[b]), int(extra.sum(dtype=np.int64)) + len(both) * int((p0 - q0) ** 2 // q0)))
    a, b, extra = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "number": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "extra": pa.array(extra, pa.int64())})


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(text, lang, source)``.

    A null text, language or source is an empty one.  Terms are runs of letters
    and of characters beyond ASCII, A-Z lower-cased; a language keeps those of
    at least ``least_docs`` of its rows (repeated rows count each).  Smoothed
    shares and values are integers, rounded down.  Part ``pair`` has every
    other source of the language with the divergence from it over the whole
    vocabulary (0 where there is none), part ``term`` the ``top`` terms that a
    source has more of than its language; ranks run from the largest value,
    ties by the item's bytes.  Other columns are ignored; an empty table gives
    no rows; a language's only source has no pairs.
    """
    texts = small_batches(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    chunk = CHUNK_BYTES
    counts = texts.mapInArrow(lambda batches: _counted(batches, chunk), "lang string, source string, term string, count long, docs long")
    # Dealt by term once: sums by source and totals of the language need no other shuffle.
    counts = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    totals = counts.select("lang", "source", "term", "count", F.sum("docs").over(of_term).alias("docs"), F.sum("count").over(of_term).alias("lang_count"), (F.min("source").over(of_term) == F.col("source")).cast("long").alias("first"))
    postings = saved(totals.where((F.col("docs") >= least_docs) | F.col("term").isNull()).drop("docs"))

    sizes = postings.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("term").alias("own"), F.sum(F.when(F.col("term").isNotNull(), F.col("first")).otherwise(0)).alias("firsts"))
    of_lang = Window.partitionBy("lang")
    groups = sizes.select("lang", "source", "total", "own", F.sum("firsts").over(of_lang).alias("terms"), F.sum("total").over(of_lang).alias("lang_total"), (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("number"))
    groups = groups.withColumn("last", F.floor((F.count("*").over(of_lang) - 1) / BLOCK))
    groups = saved(groups.withColumn("zero", share("0L", "total", "terms")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    shards, block_size = max(1, -(-postings.count() // SHARD_ROWS)), BLOCK

    priced = postings.where("term is not null").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    priced = priced.join(groups.withColumn("salt", salts), ["lang", "source", "salt"]).withColumn("p", share("count", "total", "terms"))
    ranked = priced.withColumn("q", share("lang_count", "lang_total", "terms")).where("p > q").withColumn("value", cost("p", "q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    terms = ranked.withColumn("item", F.col("term")).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*columns)

    # One-sided terms: each source's histogram, priced against every smoothed zero of the language.
    histograms = saved(priced.groupBy("lang", "source", "p").agg(F.count("*").alias("n")))
    zeros = groups.select("lang", "zero").distinct().withColumn("salt", salts)
    against = histograms.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(zeros, ["lang", "salt"])
    prices = saved(against.groupBy("lang", "source", "zero").agg(F.sum(_exact(cost("p", "zero")) * F.col("n")).alias("gone"), F.sum(_exact(cost("zero", "p")) * F.col("n")).alias("come")))

    # Terms of both: a posting goes to every pair of blocks that its source's is one of.
    block = F.floor(F.col("number") / block_size)
    dealt = priced.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    dealt = dealt.select("lang", F.least(block, "other").alias("a"), F.greatest(block, "other").alias("b"), F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "term", "number", "p", "zero")
    extra = dealt.groupBy("lang", "a", "b", "shard").applyInArrow(lambda key, rows: _overlaps(key, rows, block_size), "lang string, number long, other long, extra long").groupBy("lang", "number", "other").agg(F.sum(_exact(F.col("extra"))).alias("extra"))

    mine = groups.select("lang", "source", "number", "terms", "own", "zero")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("own").alias("own_other"), F.col("zero").alias("zero_other"))
    pairs = mine.join(theirs, "lang").where("number <> other")
    pairs = pairs.join(prices.select("lang", "source", F.col("zero").alias("zero_other"), "gone"), ["lang", "source", "zero_other"], "left")
    pairs = pairs.join(prices.select("lang", F.col("source").alias("item"), "zero", "come"), ["lang", "item", "zero"], "left")
    pairs = pairs.join(extra, ["lang", "number", "other"], "left")
    neither = _exact(cost("zero", "zero_other")) * (F.col("terms") - F.col("own") - F.col("own_other"))
    value = sum((F.coalesce(F.col(c), _exact(F.lit(0))) for c in ("gone", "come", "extra")), neither)
    pairs = pairs.withColumn("value", value.cast("long")).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by_value)).select(*columns)
    return pairs.unionByName(terms)
