"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever they are called;
an empty table gives an empty result, and no text is too long or cut before it is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwell.llm import crf, mixing, packing, quality_rules, simhash
from tarnwell.llm.common import read, store


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go. Null and empty texts have no words and go; repeated rows share
    their fate; null ids have no label. Without labels the base rule alone decides."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def apply_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score below one half go. Null texts count as empty, which are scored like any other; repeated
    rows get equal scores. Without labels of both kinds all stay."""
    return crf.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by SimHash fingerprints within two bits and, for what they leave apart, by
    verified similarity of the sets of shingles: the one of the least id, of repeated rows one. Null and empty texts are
    copies of each other; null ids stay only where their group has no other."""
    return simhash.keep_one(docs, by_prints=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target weights. Null sources and languages are a value of their own; texts without
    words weigh nothing and are drawn like their cell; repeated rows share their fate."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens get their places in sequences: null and empty texts one piece, repeated rows their own."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_classifier),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned rules, models and tokenizers can't be said in SQL; tests/llm/test_pipeline.py holds the stages against
#: brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: one row per packed piece."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
