"""Store sinks: what is written is the whole record."""

import glob
import json

from chorus.plans.catalog import load_all
from chorus.plans.store import posts_json, scored_posts
from tests.conftest import SF_SMALL


def test_posts_json_holds_whole_records(spark, tmp_path):
    """Every column of the post record comes back unchanged, and the query's own file holds them."""
    want = scored_posts(spark, SF_SMALL).cache()
    got = posts_json(spark, SF_SMALL)
    assert {"selftext", "url", "author", "subreddit", "permalink", "num_comments", "created_epoch"} <= set(got.columns)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    spark.conf.set("spark.chorus.output.dir", str(tmp_path))
    try:
        load_all()["write_posts_json"][0](spark, SF_SMALL).count()
    finally:
        spark.conf.unset("spark.chorus.output.dir")
    lines = [json.loads(x) for f in glob.glob(f"{tmp_path}/posts-json-*/part-*") for x in open(f)]
    assert len(lines) == want.count() and all("selftext" in r and "author" in r for r in lines)


def test_store_replaces_only_the_runs_that_are_saved(spark, tmp_path):
    """A rerun of run 2 replaces its partitions and leaves the files of the others as they are."""
    from pyspark.sql import functions as F

    from chorus.plans.store import derive_content, store_tables
    from chorus.sources import store as SS
    path = str(tmp_path)
    scored, content = scored_posts(spark, SF_SMALL), derive_content(spark, SF_SMALL)
    tables = store_tables(scored, content)
    SS.save(tables, path)
    files = lambda run: sorted(glob.glob(f"{path}/*/{SS.RUN}={run}/*.parquet"))
    before, n = {r: files(r) for r in (1, 2, 3)}, {t: df.count() for t, df in SS.load(spark, path, tables).items()}
    assert all(before.values())
    rerun = store_tables(scored.where("search_query_id = 2").withColumn("title", F.lit("rerun")),
                         content.where("pos % 3 + 1 = 2"))
    SS.save(rerun, path)
    assert files(1) == before[1] and files(3) == before[3] and not set(files(2)) & set(before[2])
    back = SS.load(spark, path, tables)
    assert {t: df.count() for t, df in back.items()} == n
    assert back["posts"].where("title = 'rerun'").count() == back["posts"].where(f"{SS.RUN} = 2").count() > 0


def test_stored_documents_are_variants(spark, tmp_path):
    """A document comes back field by field: numbers, text with quotes and line ends, arrays, nested
    paths; a missing path is NULL, a JSON null is a value."""
    from pyspark.sql import functions as F

    from chorus.sources import store as SS
    docs = ['{"a": 1, "t": "x\\"y\\nz é", "l": [1, [2, 3]], "o": {"k": null}}', '{}', '[]', None]
    df = spark.createDataFrame([(i, d, 1) for i, d in enumerate(docs)], "id int, raw_data string, run_id int")
    SS.save({"posts": df}, str(tmp_path))
    back = SS.load(spark, str(tmp_path), ["posts"])["posts"]
    assert dict(back.dtypes)["raw_data"] == "variant"
    got = {r.id: tuple(r)[1:] for r in back.select(
        "id", F.variant_get("raw_data", "$.a", "int"), F.variant_get("raw_data", "$.t", "string"),
        F.variant_get("raw_data", "$.l[1][0]", "int"), F.variant_get("raw_data", "$.o.k", "variant").isNotNull(),
        F.variant_get("raw_data", "$.o.none", "variant").isNotNull()).collect()}
    assert got[0] == (1, 'x"y\nz é', 2, True, False)
    assert got[1] == got[2] == got[3] == (None, None, None, False, False)


def test_queries_share_one_store(spark):
    """Once built, the store is read: no query over it scans the documents again."""
    from chorus.plans.store import stored
    stored(spark, SF_SMALL)
    cat = load_all()
    for name in ("table_status", "json_contains_key", "join_posts_sentiment", "fk_navigation", "fk_orphans",
                 "unique_violations", "check_violations", "store_filter", "variant_paths", "run_stats"):
        df = cat[name][0](spark, SF_SMALL)
        assert not [f for f in df.inputFiles() if f.endswith(("documents.parquet", "pages.parquet"))], name
    assert cat["join_posts_sentiment"][0](spark, SF_SMALL).count() > 0
