"""Helpers shared by operators: bounded broadcasts and SQL snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus import vocab

# A broadcast side must have a size bound that does not grow with the data.
MAX_BROADCAST_ROWS = 100_000


def small(spark, name: str) -> DataFrame:
    """A fixed vocabulary table, marked for broadcast. Its row count is set
    by :mod:`chorus.vocab`, so the broadcast cannot grow with the data."""
    n = vocab.row_count(name)
    if n > MAX_BROADCAST_ROWS:
        raise ValueError(f"{name}: {n} rows is too many to broadcast")
    return F.broadcast(vocab.table(spark, name))


# SQL fragment: X1 tokens of a text expression (DuckDB).
def sql_tokens(expr: str) -> str:
    return (f"list_filter(string_split_regex(lower(coalesce({expr}, '')), '[^\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: regexp_full_match(w, '[a-z]{{3,}}'))")


def sql_in_list(items) -> str:
    return "(" + ", ".join(vocab.sql_literal(i) for i in items) + ")"
