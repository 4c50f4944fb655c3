"""The corpus pipeline: language, exact and near copies, mixture and packing, stage by stage.

Each stage takes all rows that the one before it kept and returns the columns of its input, but the last.
Defined results, besides those of the operators: null, empty and very long texts, null ids, shared ids,
repeated rows and other columns pass through every stage as stated there; an empty table gives an empty
result; ties are told by each operator's rule, so a rerun over the same table keeps the same rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgate.llm import digests, language, minhash, mixing, packing
from cohortgate.llm.tables import holdout, kept


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or without a letter go.

    All rows of one text stay or go together, whatever their ids; if no document has a language to learn
    from, all go.
    """
    samples = language.learned_samples(docs, ~holdout(F.col("doc_id"), 4, 2))
    judged = language.predicted(docs, samples)
    return judged.filter(F.col("lang_pred") != language.UNDETERMINED).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text but for A-Z as a-z: the one of the largest id (any id before none)."""
    return digests.survivors(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more: the one of the
    smallest id, of rows without an id or with one id the least by text hash. Texts without a word stay."""
    return minhash.survivors(docs, k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document may stand several times, or not at all where its
    source is shrunk. Texts of no words are taken as often as their source's others."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence; a null or empty text is one end token."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.packed(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language", identified),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("mixture", mixed),
    ("packing", packed),
]
#: Learned, sketched and tokenised stages cannot be written in SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
