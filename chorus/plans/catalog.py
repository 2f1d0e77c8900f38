"""Registry of named queries: a Spark plan over the test tables plus the
DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, tuple[QueryFn, str | None]] = {}


# Result columns that Spark types as int (row numbers, positions, lengths)
# where the SQL side gives BIGINT: widened so both schemas agree.
LONG_COLUMNS = {
    "adjacent_sentence_pairs": ["s_ix"], "emoji_count": ["n_emoji"], "flat_comments": ["ix"],
    "item_threads": ["thread_ix"], "join_content": ["content_length"], "label_format": ["s_ix", "pos", "mi"],
    "listing_threads": ["thread_ix"], "model_mentions": ["s_ix", "pos", "mi"],
    "nearest_anchor": ["s_ix", "pos", "mi", "fam_pos", "ver_pos"], "per_source_quota": ["rn"],
    "per_term_quota": ["term_rank"], "top_edges": ["rank"], "top_nodes": ["rank"], "top_posts": ["rank"],
    "valid_combo": ["s_ix", "pos"], "version_tokens": ["s_ix", "pos", "mi"],
}


def _widen(name: str, fn: QueryFn) -> QueryFn:
    cols = LONG_COLUMNS.get(name)
    if not cols:
        return fn

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.withColumns({c: df[c].cast("long") for c in cols})
    run.__doc__ = fn.__doc__
    return run


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL (or
    None when the operator has no SQL equivalent; a brute-force test covers it)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in CATALOG:
            raise KeyError(f"duplicate query {name}")
        CATALOG[name] = (_widen(name, fn), sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    # importing the plan modules fills CATALOG
    from chorus.plans import (  # noqa: F401
        content, graph, landed, mentions, ranking, scalars, sentiment, store, streaming, trends, words)
    return CATALOG
