"""Proportional stratified interleaving: shards of equal row counts that all have the corpus's mixture.

Each source's rows are ranked in a seeded-shuffled order; a row's fractional
rank is ``(rank + 1/2) / rows of its source``.  Sorted by it, every stretch of
the corpus has each source in proportion, so equal cuts are equal mixtures.
Only ids, sizes and keys are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.common import saved
from spheregrid.llm.ordering import block_count, hash_key, key_block, running


def stratified_shards(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """``(doc_id, source, size, text_crc32, shard, slot)`` for every row of ``docs(doc_id, text, source)``.

    Row counts of shards differ by one at most (empty shards only if there are
    fewer rows than shards), and so do a source's counts, but for the rounding
    of its neighbours in the order.  ``slot`` is gapless from 0 in each shard.
    A null text counts as empty (size 1), a null source as one more source, a
    null ``doc_id`` as an empty one; equal rows are interchangeable.  Other
    columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = saved(rows.withColumn("key", hash_key(seed, F.col("doc_id"), F.col("text_crc32"))))
    sources = rows.groupBy("source").agg(F.count("*").alias("n"))
    sources = saved(sources.withColumn("stratum", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))))
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = block_count(total)

    ranked = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("block", key_block(F.col("key"), blocks))
    ranked = running(ranked, ["stratum"], "block", [F.col("key"), F.col("doc_id")], F.lit(1), "rank").drop("block")
    ranked = ranked.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("n")))
    # Blocks are ranges of a sample's quantiles: fractions may be the same in very many small sources, which their strata then part.
    ranged = saved(ranked.repartitionByRange("fraction", "stratum").withColumn("block", F.spark_partition_id()))
    placed = running(ranged, [], "block", [F.col("fraction"), F.col("stratum")], F.lit(1), "position")
    shard = F.floor(F.col("position") * F.lit(shards) / F.lit(max(1, total))).cast("int")
    # A shard's first position is the least p with floor(p * shards / total) = shard.
    start = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards))
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "shard", (F.col("position") - start).cast("long").alias("slot"))
