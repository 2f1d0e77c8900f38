"""The same bindings as :mod:`chorus.sources.tables`, written in SQL for the
DuckDB oracle. ``with_views(sql, 'posts', ...)`` prepends the CTEs."""

from __future__ import annotations

from chorus import vocab
from chorus.sources.tables import EPOCH_2024, FIRST_WORD, N_GOLDEN, TITLE_PATTERN

_GOLDEN = "[" + ", ".join(vocab.sql_literal(t) for t in vocab.TOPIC_TITLES) + "]"


def _posts(golden: bool) -> str:
    g = f"{_GOLDEN}[doc_id % {N_GOLDEN} + 1]" if golden else "''"
    return f"""
  SELECT
    CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'hn_' || CAST(doc_id AS VARCHAR) END AS id,
    CASE WHEN doc_id % 2 = 0 THEN 'Reddit' ELSE 'HackerNews' END AS source,
    CASE WHEN doc_id % 2 = 0 THEN d_source ELSE 'HackerNews' END AS subreddit,
    CASE WHEN g = '' THEN head ELSE g || ' ' || head END AS title,
    substr(txt, length(head) + 1) AS selftext,
    n_chars AS score,
    doc_id % 37 AS num_comments,
    {EPOCH_2024} + (doc_id * 7919) % 2592000 AS created_epoch,
    CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 THEN '/r/' || d_source || '/comments/' || CAST(doc_id AS VARCHAR) || '/'
         WHEN doc_id % 2 = 0 THEN '' END AS permalink,
    'user' || CAST(doc_id % 101 AS VARCHAR) AS author,
    doc_id AS pos,
    CASE WHEN doc_id % 7 = 0 THEN ''
         WHEN doc_id % 7 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'https://i.redd.it/' || CAST(doc_id AS VARCHAR) || '.jpg'
                                       ELSE 'https://news.ycombinator.com/item?id=' || CAST(doc_id AS VARCHAR) END
         ELSE coalesce(page_url, '') END AS url
  FROM (
    SELECT *, coalesce(nullif(regexp_extract(fl || ' ', '{TITLE_PATTERN}', 1), ''), regexp_extract(fl, '{FIRST_WORD}', 0)) AS head
    FROM (
      SELECT d.doc_id, d.source AS d_source, d.n_chars, coalesce(d.text, '') AS txt,
             split_part(coalesce(d.text, ''), chr(10), 1) AS fl, {g} AS g, p.url AS page_url
      FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
    )
  )"""


_THREADS = """
  SELECT conv_id AS post_id,
         CASE WHEN role = 'user' THEN turn ELSE turn - 1 END AS thread_ix,
         CASE WHEN role = 'user' THEN 0 ELSE 1 END AS reply_ix,
         CASE WHEN (conv_id + turn) % 11 = 3 THEN '[deleted]'
              WHEN (conv_id + turn) % 11 = 5 THEN '[removed]'
              WHEN (conv_id + turn) % 11 = 7 THEN '  '
              ELSE text END AS text
  FROM conversations WHERE role <> 'system'"""

_PLAIN_THREADS = """
  SELECT conv_id AS post_id, CASE WHEN role <> 'assistant' THEN turn ELSE turn - 1 END AS thread_ix,
         CASE WHEN role <> 'assistant' THEN 0 ELSE 1 END AS reply_ix, text
  FROM conversations"""

VIEWS = {
    "posts": _posts(True),
    "plain_posts": _posts(False),
    "threads": _THREADS,
    "plain_threads": _PLAIN_THREADS,
}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    # a plain view takes the name of the binding it stands for
    parts = [f"{n.removeprefix('plain_')} AS ({VIEWS[n]}\n)" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + sql if parts else sql
