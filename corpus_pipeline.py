"""The corpus pipeline: language identification, line and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessloom.llm import langid, lines, mixture, packing, simhash
from accessloom.llm.common import ship, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in none of the languages learned: without letters, or at a cost a letter like that of random ones. A null lang becomes the one found.

    Null and empty texts go. A text of few letters can't be told from its cost and stays. Repeated rows go or stay alike,
    an empty table gives none, and ties go to the commoner language. Texts of any length are parsed whole.
    """
    ship(spark)
    learned = langid.training_texts(docs.where(~langid.held_out()))
    found = langid.identify(docs, learned).where(langid.accepted())
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select([F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; documents of which none is left go.

    Of equal or nearly equal lines the earliest by doc_id (null last) stays, so of repeated rows one. Null texts and texts
    without words stay as they are; lines of any length are compared whole; an empty table gives none. n_chars follows the text.
    """
    ship(spark)
    found = lines.dedup_lines(docs).where((F.col("n_dropped") < F.col("n_lines")) | (F.col("n_lines") == 0))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a five-word Jaccard similarity of 0.8: that of the smallest doc_id (null last).

    SimHash links of five-word fingerprints are verified on the whole shingle sets; an index of prefixes is the exact way for the rest.
    Null and empty texts are one group, so are repeated rows; ties in doc_id go by the text's hash. Texts of any
    length are read whole, and an empty table gives none.
    """
    ship(spark)
    return simhash.keep_one(docs, width=5, similarity=(4, 5))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    They stay whole: of the one that a source's target cuts, an occurrence counts if more than half of it is taken. Documents
    without words, null texts among them, are never taken. Null sources are one source, the last; null or equal doc_ids
    are ordered by size and text; repeated rows are taken one by one; an empty table gives none.
    """
    each = mixture.occurrences(mixture.mix(docs))
    return each.where(F.col("words_taken") * 2 > F.col("size")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids.

    A null text is empty and has the end id alone; null doc_ids stay null; repeated rows are packed one by one; texts
    of any length are cut freely; an empty table gives none.
    """
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("language id", language),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packed),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
