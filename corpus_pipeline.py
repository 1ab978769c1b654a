"""A corpus pipeline of five operators; each stage's output is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import decontaminate, langid, near_copies, packing, secrets
from candlewick.llm.common import Scratch, read_table
from candlewick.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is of a learned language; texts that are null or without a letter go."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link as copies or near copies, directly or through others, the one with the smallest id.

    Texts link if their sets of five-word shingles have a Dice similarity of 0.8 or more: a changed word costs five
    shingles of either text, which a Jaccard similarity would count twice.
    """
    return near_copies.drop_near_copies(docs, Scratch(spark, "near-dedup"), threshold=near_copies.of_dice(0.8))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 0.8 of its five-word shingles."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids."""
    return packing.harmonic_pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("packing", pack),
]

#: Language prediction, simhash bits and token ids have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
