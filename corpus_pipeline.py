"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination,
mixing to target weights, sharding. Each stage reads what its predecessor kept;
all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chorus.llm.common import cut, read
from chorus.llm.decontamination import keep_clean
from chorus.llm.language_id import keep_identified, train, training_rows
from chorus.llm.mixing import mix_to_weights, take_copies
from chorus.llm.sharding import interleave_shards
from chorus.llm.simhash import keep_one_of_each

SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has an identified language; ``und`` rows (null text, no letter) go.
    The model learns from the labelled rows outside the held-out fold."""
    return keep_identified(docs, train(training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (3-word shingles, at most 3 bits) one row; see
    :func:`chorus.llm.simhash.keep_one_of_each` for nulls, repeated rows and names."""
    return keep_one_of_each(docs, shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item: null and empty texts stay, repeated rows and null ids
    are judged each by its text; other columns pass unchanged, whatever their names."""
    return keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's budget takes it; the document on
    a source's cut is shortened to the words taken, untaken ones go. Documents without a
    word (null, empty, blank) are never taken; a null source is a source of its own; equal rows
    are interchangeable; an empty table gives an empty mix."""
    return take_copies(mix_to_weights(docs), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with shard and slot, every row once: nulls, empty texts and repeated
    rows are dealt like others; columns of these names are replaced."""
    return interleave_shards(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mix_to_weights", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # language ID and SimHash have no SQL form; tests/llm holds the brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
