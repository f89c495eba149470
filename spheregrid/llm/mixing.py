"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key of its id and text (rows that share both
are interchangeable, so reruns agree whatever the partitions); each source is range-sorted by it and
distributed prefix sums of token counts cut it at its exact budget.  A budget
above the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spheregrid.llm.common import saved
from spheregrid.llm.ordering import block_count, hash_key, key_block, running

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it.
SPACED = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def document_key(seed: int) -> Column:
    """The random order of documents: a null text counts as empty."""
    return hash_key(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``(source, stratum, source_size, target)`` from ``(source, source_size)``.

    Sources in code point order, null last, have the weights in turn; together
    they take ``share`` of all sizes.  A target stops at ``epochs`` times its
    source's size and the excess goes to the others by weight, until none is
    above: the level at which that settles comes from prefix sums over the
    sources, sorted by the level at which each one stops.
    """
    ranked = sizes.withColumn("stratum", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("stratum") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", F.col("source_size") * epochs)
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "stratum")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", (F.col("total") * F.lit(share) - stopped) / open_weight)
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stop") / F.col("weight"), F.col("stratum"), F.col("level")))).over(everything)["level"]
    level = level.withColumn("settled", settled)
    return level.select("source", "stratum", "source_size", F.coalesce(F.least(F.col("stop").cast("double"), F.col("settled") * F.col("weight")), F.col("stop").cast("double")).alias("target"))


def _mixed(rows: DataFrame) -> DataFrame:
    """``rows(source, size, key, ...)`` with ``source_size``, ``target`` and ``taken``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sizes = saved(sizes)
    count = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    goal = saved(targets(sizes.drop("_n"))).withColumnRenamed("source", "_source")
    ranged = rows.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_block", key_block(F.col("key"), block_count(count)))
    ranged = running(ranged, ["stratum"], "_block", [F.col("key"), F.col("doc_id")], F.col("size"), "_before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ranged = ranged.withColumn("epochs", whole.cast("long"))
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    ranged = ranged.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))).cast("long"))
    return ranged.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("last")).cast("long")).drop("_block", "_before", "stratum")


def mixture(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source)``.

    A null or wordless text has size 0 and nothing is taken of it; null
    sources are one source; null ids sort as the empty key; repeated rows count
    each.  The words taken of a source are its target rounded down.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), document_key(seed).alias("key"))
    return _mixed(saved(rows)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each time a document is taken.

    The document at which a source's budget ends is cut to the words that are
    left (its ``n_chars``, if there is such a column, follows); a document of
    which nothing is taken is left out.
    """
    wrapped = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), document_key(seed).alias("key"))
    taken = _mixed(wrapped)
    times = F.when(F.col("epochs") > 0, F.array_repeat(F.col("size"), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.filter(F.concat(times, F.array(F.col("last"))), lambda x: x > 0)
    each = taken.withColumn("_words", F.explode(copies))
    text = F.col("_row")["text"]
    cut = F.when(F.col("_words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")).otherwise(text)
    columns = []
    for field in docs.schema:
        if field.name == "text":
            columns.append(cut.alias("text"))
        elif field.name == "n_chars":
            columns.append(F.when(F.col("_words") < F.col("size"), F.length(cut)).otherwise(F.col("_row")["n_chars"]).cast(field.dataType).alias("n_chars"))
        else:
            columns.append(F.col("_row")[field.name].alias(field.name))
    return each.select(*columns)
