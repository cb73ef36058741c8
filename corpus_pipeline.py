"""From raw documents to a rated training corpus, in five stages over whole tables.

Each stage takes all that the one before kept.  Its result is written and read again, so a lost
executor costs at most one stage.

Defined cases, in every stage: an empty table stays empty; null ids are rows like any others; null, empty and blank texts
fail the rules and go in the first stage; a text of any length is read whole; repeated rows are judged each, and
one of them stays after the second stage; ties go to the smallest id; columns of any name are kept, except by the
last stage, which returns rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harvestlake.llm import decontam, jaccard, ledger, mixing, repeats
from harvestlake.llm.common import bound_batches, stored, table

#: Shares of all tokens that the mixture is to have; junk has none, the rules of the first stage reject it.
TARGETS = {"good": 0.98, "toxic": 0.02}
#: What repeats as a passage: whole words of a run, and bytes of the strings by which it is found.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy rejects go."""
    bound_batches(spark)
    return ledger.reject(docs, "v1")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 connect, one stays."""
    bound_batches(spark)
    return jaccard.keep_one(docs, width=5, percent=80)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand anywhere else go; documents with nothing left go.

    A passage is found by any of its strings of 200 bytes.  In the given documents passages of over 50 words are
    shared in lengths from about 230 bytes on; a third or more are shorter than the 400 bytes that the operator's query asks for.
    """
    bound_batches(spark)
    return repeats.remove_repeats(docs, length=PASSAGE_BYTES, n_chars="n_chars", min_words=PASSAGE_WORDS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bound_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left gets its rate in the target mixture."""
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_bytes", repeated_bytes),
    ("benchmark_leaks", benchmark_leaks),
    ("mix_sources", mix_sources),
]

#: SQL cannot express the byte repeats, the retrieval and the rates; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
