"""Page text, content records and the content join."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chorus import vocab
from chorus.operators import content as C
from chorus.operators.ranking import eligible_urls
from chorus.operators.sentiment import sentiment_scores
from chorus.plans.catalog import query
from chorus.plans.sentiment_sql import sentiment_ctes
from chorus.plans.sqlviews import with_views
from chorus.sources.tables import posts, read


def _re2(p: str) -> str:
    """Java character escapes -> RE2 ones (\\uXXXX / \\xHH -> \\x{...})."""
    p = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", p)
    return re.sub(r"\\x([0-9A-Fa-f]{2})(?![0-9A-Fa-f}])", r"\\x{\1}", p)


_SP = _re2(C.PY_SPACE)
_LN = _re2(C.PY_LINES)


def sql_decode_entities(text: str) -> str:
    lit = vocab.sql_literal
    named = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in C.NAMED.items()) + "}"
    cp1252 = "MAP {" + ", ".join(f"{k}: {lit(v)}" for k, v in C.CP1252.items()) + "}"
    name, whole = (f"regexp_extract(p, '{C.ENTITY}', {g})" for g in (1, 0))
    code = (f"(CASE WHEN lower({name}[1:2]) = '#x' THEN TRY_CAST('0x' || {name}[3:] AS BIGINT) "
            f"ELSE TRY_CAST({name}[2:] AS BIGINT) END)")
    numeric = (f"CASE WHEN {code} BETWEEN 128 AND 159 THEN coalesce(({cp1252})[CAST({code} AS INTEGER)], chr(CAST({code} AS INTEGER))) "
               f"WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INTEGER)) "
               f"ELSE chr(65533) END")
    char = f"CASE WHEN starts_with({name}, '#') THEN {numeric} ELSE ({named})[{name}] END"
    part = f"coalesce(({char}) || substr(p, length({whole}) + 1), '&' || p)"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {part} END), '')"


def sql_html_text(col: str, cap: int | None = None) -> str:
    h = f"coalesce({col}, '')"
    h = f"regexp_replace({h}, {vocab.sql_literal(C.markup('+'))}, '', 'g')"
    h = sql_decode_entities(h)
    strip = f"regexp_replace(@X@, '^{_SP}+|{_SP}+$', '', 'g')"
    chunks = (f"flatten(list_transform(string_split_regex({h}, '{_LN}'), "
              f"lambda l: string_split({strip.replace('@X@', 'l')}, '  ')))")
    kept = f"list_filter(list_transform({chunks}, lambda c: {strip.replace('@X@', 'c')}), lambda c: c <> '')"
    text = f"array_to_string({kept}, ' ')"
    return text if cap is None else f"substr({text}, 1, {cap})"


_ELIGIBLE = f"""
  SELECT p.id, p.source, p.url FROM posts p
  WHERE p.url IS NOT NULL AND p.url <> ''
    AND NOT EXISTS (SELECT 1 FROM {vocab.sql_values('internal_url_prefixes')} r
                    WHERE r.source = p.source AND starts_with(p.url, r.prefix))"""
_CONTENT = {
    "eligible": _ELIGIBLE,
    "page_text": f"SELECT page_id, url, {sql_html_text('html')} AS content_text FROM pages",
    "last_text": "SELECT url, arg_max(content_text, page_id) AS content_text FROM page_text WHERE content_text <> '' GROUP BY url",
    "content": "SELECT e.id AS post_id, e.url, t.content_text FROM eligible e JOIN last_text t ON t.url = e.url",
}


def content_records(spark, sf):
    p = posts(spark, sf, urls=True)
    return C.content_records(eligible_urls(p), read(spark, sf, "pages"))


@query("page_text", with_views("SELECT page_id, url, content_text FROM page_text", extra=_CONTENT))
def page_text(spark, sf):
    return C.page_texts(read(spark, sf, "pages"))


@query("page_text_capped", f"SELECT page_id, url, {sql_html_text('html', C.PAGE_TEXT_CAP)} AS content_text FROM pages")
def page_text_capped(spark, sf):
    """S7 with its length cap."""
    return C.page_texts(read(spark, sf, "pages"), C.PAGE_TEXT_CAP)


@query("content_records", with_views("SELECT post_id, url, content_text FROM content", "posts", extra=_CONTENT))
def q_content_records(spark, sf):
    return content_records(spark, sf)


_CS = dict(_CONTENT)
_CS["sent_in"] = "SELECT post_id AS sid, content_text AS text FROM content"
_CS.update(sentiment_ctes())


@query("content_sentiment", with_views("""
SELECT sid AS post_id, compound, positive, neutral, negative FROM sent_out""", "posts", extra=_CS))
def content_sentiment(spark, sf):
    """T1 on extracted page text (one score per content record)."""
    return sentiment_scores(content_records(spark, sf), "post_id", "content_text")


_CJ = dict(_CS)
_CJ["t_in"] = "SELECT id AS sid, title AS text FROM posts"


@query("join_content", with_views("""
SELECT p.id, length(c.content_text) AS content_length, s.compound AS content_compound
FROM posts p LEFT JOIN content c ON c.post_id = p.id LEFT JOIN sent_out s ON s.sid = p.id""", "posts", extra=_CS))
def join_content(spark, sf):
    """Results left-joined to content by post id; posts without content keep NULLs. The length
    goes through T1 with the key, so that the content is read once."""
    c = content_records(spark, sf).select(F.col("post_id").alias("id"), F.length("content_text").alias("content_length"),
                                          "content_text")
    s = sentiment_scores(c, ["id", "content_length"], "content_text")
    return posts(spark, sf).select("id").join(
        s.select("id", "content_length", F.col("compound").alias("content_compound")), "id", "left")
