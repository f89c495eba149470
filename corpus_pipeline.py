"""A training corpus from raw documents: civil, of a known language, without near copies, mixed to weights, encoded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.  An empty table gives
an empty one at every stage, and columns of any name pass through all but the
last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spheregrid.llm.bpe import encode_documents
from spheregrid.llm.common import documents, saved
from spheregrid.llm.jaccard import keep_one_of_each
from spheregrid.llm.langid import keep_identified
from spheregrid.llm.mixing import mixed_documents
from spheregrid.llm.toxicity import keep_civil


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic.

    A null or empty text has no toxic token and stays; rows that repeat are
    judged alike.  Labels of documents that are held out teach nothing.
    """
    return keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided.

    A null text, one without letters, and one whose two smallest encodings are
    (nearly) equal go; rows that repeat are judged alike.
    """
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id (null last), of rows with that id the one with the least text hash.

    Texts without words are copies of nothing.
    """
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mixture takes a document; the one at which a source's budget ends is cut to what is left.

    Null sources are one source; ties of the random order are equal rows, of
    which any may be cut.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the hash of the text that decoding gives back; a null text has no ids."""
    encoded = encode_documents(docs)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("language", language), ("near copies", near_copies), ("mixing", mixing), ("encoding", encoding)]

#: The toxicity model, the compression classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each one's result written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
