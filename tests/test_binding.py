"""The bindings keep every character, and nothing that a caller passes is capped."""

from pyspark.sql import functions as F

from chorus.operators.content import html_text
from chorus.operators.graph import betweenness
from chorus.operators.ranking import term_quota
from chorus.sources import landed as L
from chorus.sources.tables import posts, read, threads
from tests.conftest import SF_SMALL


def test_posts_hold_all_characters(spark):
    docs = read(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("t"))
    p = posts(spark, SF_SMALL, golden=False).join(docs, "pos")
    assert p.where(F.concat("title", "selftext") != F.col("t")).count() == 0
    g = posts(spark, SF_SMALL).join(docs, "pos")
    assert g.where(~F.concat("title", "selftext").endswith(F.col("t"))).count() == 0


def test_plain_threads_hold_all_texts(spark):
    c = read(spark, SF_SMALL, "conversations")
    t = threads(spark, SF_SMALL, tombstones=False)
    assert t.count() == c.count() and t.select("text").exceptAll(c.select("text")).isEmpty()


def test_long_path_graph(spark):
    n = 70
    nodes = spark.createDataFrame([(f"w{i:02d}",) for i in range(n)], "word string")
    edges = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}", 1) for i in range(n - 1)],
                                  "w1 string, w2 string, weight long")
    got = {r.word: r.betweenness for r in betweenness(nodes, edges).collect()}
    for i in range(n):  # on a path, i nodes lie left of node i and n - 1 - i right of it
        assert abs(got[f"w{i:02d}"] - 2 * i * (n - 1 - i) / ((n - 1) * (n - 2))) < 1e-9


def test_listing_of_many_children_and_many_terms(spark):
    kids = ",".join('{"kind":"t3","data":{"id":"%d","title":"x"}}' % i for i in range(130))
    lines = spark.createDataFrame([('{"kind":"Listing","data":{"children":[%s]}}' % kids,)], "value string")
    listing = lines.select(F.from_json("value", L.LISTING_SCHEMA).alias("d")).select("d.*")
    assert L.ingest_listing_posts(listing).count() == 130
    p = spark.createDataFrame([(f"t{i:02d}", i, f"t{i:02d}", "") for i in range(12)],
                              "id string, pos long, title string, selftext string")
    assert term_quota(p, [f"t{i:02d}" for i in range(12)], 24).count() == 12


def test_page_text_is_capped_only_on_request(spark):
    df = spark.createDataFrame([("<p>" + "a" * 7000 + "</p>",)], "h string")
    r = df.select(F.length(html_text(F.col("h"))).alias("a"), F.length(html_text(F.col("h"), 5000)).alias("b")).first()
    assert (r.a, r.b) == (7000, 5000)
