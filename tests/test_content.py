"""Page text and content records with hand-worked results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chorus.operators.content import content_records, html_text
from chorus.plans.content import sql_html_text

PAGES = [
    ('<p title="a>b">it&#8217;s &eacute;t&eacute; &#x27;q&#x27;</p>', "it\u2019s \u00e9t\u00e9 'q'"),
    ("<a title='x > y' href=z>link</a>", "link"),
    ("a<script>if (x < 3) { y = '<!--' }</script>b<!-- c <p> --> d", "ab d"),
    ("a<script src='>'>never closed <p>gone</p>", "a"),
    ("<STYLE>p{}</STYLE >a<!DOCTYPE html><?xml version='1'?>b", "ab"),
    ("&amp;lt; &amp;amp;", "&lt; &amp;"),                       # decoded once
    ("&copy 2020 &copy; AT&T &bogus; & x &", "\u00a9 2020 \u00a9 AT&T &bogus; & x &"),
    ("&#150;&#x96;&#x80;&#129;", "\u2013\u2013\u20ac\u0081"),    # windows-1252
    ("&#128512;&#x1F600;&#0;&#xD800;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFFFFF;", "\U0001f600" * 2 + "\ufffd" * 4),
    ("x&nbsp;", "x"),                                           # stripped like white space
    ("3 < 5 <b>and</b> 7 > 6 <unclosed attr='1'", "3 < 5 and 7 > 6 <unclosed attr='1'"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_page_text(spark, i):
    html, want = PAGES[i]
    got = spark.createDataFrame([(html,)], "html string").select(html_text(F.col("html")).alias("t")).first().t
    assert got == want
    con = duckdb.connect()
    assert con.execute(f"SELECT {sql_html_text('html')} FROM (SELECT CAST(? AS VARCHAR) AS html)", [html]).fetchone()[0] == want


def test_endless_tag_takes_linear_time(spark):
    df = spark.range(1).select(F.concat(F.lit("a <p "), F.repeat(F.lit("x=1 y=\"2\" "), 200_000)).alias("html"))
    assert df.select(F.length(html_text(F.col("html")))).first()[0] > 1_000_000


def test_last_page_with_text_wins(spark):
    pages = spark.createDataFrame([
        (1, "u", "<p>old</p>"), (2, "u", "<p>new</p>"), (3, "u", "<p> </p>"), (4, "v", "<b>only</b>"), (5, "w", None),
    ], "page_id long, url string, html string")
    posts = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "v"), ("d", "w"), ("e", "x")], "id string, url string")
    got = {r.post_id: r.content_text for r in content_records(posts, pages).collect()}
    assert got == {"a": "new", "b": "new", "c": "only"}
