"""Whole texts are searched once, and the shorter patterns find what the plain ones do."""

import random

from pyspark.sql import functions as F

from chorus import vocab
from chorus.functions import text as X
from chorus.operators import mentions as M
from chorus.sources import tables as T

PIECES = ["sonnet", "Opus", "haiku", "Claude", "claude", " ", "  ", "\t", "\n", "\r\n", "\x0b", "3.5", "3-5", "3", "4.5", "4-0", "4", "2",
          "code", "ai", ".", "!", "?", "…", "\u0085", " ", " ", " ", "é", "İ", "word", "mini", "o3-mini", "7", "😀"] + 2 * [". ", "!\n", "?\t ", "\r\n"]


def _texts(spark):
    rng = random.Random(11)
    rows = [("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))),) for _ in range(4000)] + [(None,)]
    return spark.createDataFrame(rows, "text string").repartition(4)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_version_of_the_plain_alternation(spark):
    plain = F.regexp_extract(F.lower("text"), "|".join(f"(?:{p})" for p in vocab.PRODUCT_VERSION_PATTERNS), 0)
    df = _texts(spark).select("text", plain.alias("a"), F.regexp_extract(F.lower("text"), M.PRODUCT_VERSION, 0).alias("b"))
    assert df.where("not (a <=> b)").isEmpty() and df.where("a <> ''").count() > 1000


def test_sentences_of_the_plain_patterns(spark):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    plain = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?<=[.!?])\s+"))
    df = _texts(spark).select("text", plain.alias("a"), X.sentences("text").alias("b"))
    assert df.where("not (a <=> b)").isEmpty() and df.where("size(b) > 2").count() > 100


def test_candidate_sentences_of_the_plain_search(spark):
    plain = F.col("text").rlike("[0-9]")
    for w, _ in vocab.FAMILIES + vocab.TIERS:
        plain = plain | (F.instr(F.lower("text"), w) > 0)
    df = _texts(spark).select(plain.alias("a"), M._maybe(F.col("text")).alias("b"))
    assert df.where("not (a <=> b)").isEmpty()


def test_titles_of_the_plain_pattern(spark):
    line = F.regexp_replace(F.concat_ws("", *[F.col("text")] * 6), "\n", " ")
    short = F.regexp_extract(F.concat(line, F.lit(" ")), T.TITLE_PATTERN, 1)
    plain = F.when(short != "", short).otherwise(F.regexp_extract(line, T.FIRST_WORD, 0))
    df = _texts(spark).select(plain.alias("a"), T.title_head(line).alias("b"))
    assert df.where("not (a <=> b)").isEmpty()


def test_a_text_is_searched_once(spark):
    df = _texts(spark)
    version = _plan(df.select(M.product_version(F.col("text")).alias("v")))
    assert version.count("regexp_extract(") == 1 and version.count("lower(") == 1
    assert _plan(df.select(M._maybe(F.col("text")).alias("v"))).count("lower(") == 1
    assert "(?<=[.!?])" not in _plan(df.select(X.sentences("text").alias("v")))
    assert "regexp_replace(text" not in _plan(df.select(X.sentences("text").alias("v")))
