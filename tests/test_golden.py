"""Golden rows: the reference's own extractor test cases plus hand-derived edge rows."""

import pytest
from pyspark.sql import functions as F

from chorus.functions import text as X
from chorus.operators import mentions as M
from chorus.operators.sentiment import sentiment_scores

VERSIONS = [
    ("Holy SH*T they cooked. Claude 3.7 coded this game", "", "Claude 3.7"),
    ("Demo of Claude 4 autonomously coding", "", "Claude 4"),
    ("Sonnet 4.5 is finally here!", "", "Sonnet 4.5"),
    ("Claude 4.5 released with new features", "", "Claude 4.5"),
    ("I've been using Claude Code for months", "", "Claude"),
    ("Sonnet is better than Opus for coding", "", "Sonnet"),
    ("Claude 3.5 vs Claude 4 comparison", "", "Claude 3.5"),
    ("Opus 4 vs Sonnet 3.5", "", "Opus 4"),
    ("Using Haiku for simple tasks", "", "Haiku"),
    ("No AI mentioned here", "", None),
    ("corpus of text", "", None),
    ("octopus ink", "", "Opus"),
    ("Opus 4.5 rocks", "", "Opus 4"),
    ("claude3 test", "", "Claude3"),
]


def test_product_version(spark):
    df = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(VERSIONS)], "i int, title string, text string")
    got = {r.i: r.v for r in df.select("i", M.product_version(F.concat_ws(" ", "title", "text")).alias("v")).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(VERSIONS)}


MENTIONS = [
    ("I use GPT-4.5 sometimes, but Sonnet feels faster.", "", {"GPT-4.5", "Claude Sonnet"}),
    ("Claude 3.5 just dropped.", "Sonnet is fantastic.", {"Claude 3.5 Sonnet"}),
    ("4.5 and Sonnet are both fast.", "", {"GPT-4.5", "Claude Sonnet"}),
]


def _labels(spark, rows):
    df = spark.createDataFrame([(str(i), t, x) for i, (t, x, *_ ) in enumerate(rows)], "id string, title string, text string")
    m = M.model_mentions(df, "id", "title", "text")
    lab = m.select("post", M.mention_label(F.col("vendor"), F.col("version"), F.col("tier")).alias("l"))
    out = {}
    for r in lab.collect():
        out.setdefault(int(r.post), set()).add(r.l)
    best = {int(r.id): r.l for r in df.select("id", M.best_model_label(F.col("title"), F.col("text")).alias("l")).collect()}
    return out, best


def test_model_mentions_subset(spark):
    got, _ = _labels(spark, MENTIONS)
    for i, (_, _, expect) in enumerate(MENTIONS):
        assert expect <= got.get(i, set()), (i, got.get(i))


def test_model_mentions_negative(spark):
    got, _ = _labels(spark, [("OpenAI announces GPT-8!", "Big leap ahead.")])
    labels = got.get(0, set())
    assert "GPT-8" not in labels
    assert all(l.startswith("OpenAI") or l.startswith("GPT-") for l in labels)


@pytest.mark.parametrize("title,text,best", [
    ("I have 3 cats", "", "Claude 3"),
    ("a mini fridge", "", "OpenAI"),
    ("Gemini is good", "", "Google"),
    ("Claude 3.5 just dropped.", "Sonnet is fantastic.", "Claude 3.5"),
])
def test_best_label_edges(spark, title, text, best):
    _, got = _labels(spark, [(title, text)])
    assert got[0] == best


def test_label_cuts(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,)], "c double")
    assert [r.l for r in df.select(X.sentiment_label("c").alias("l")).collect()] == ["positive", "negative", "neutral"]


def test_five_blocks(spark):
    df = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (0, 0, 0), (2, 2, 1)], "p long, u long, n long")
    got = [r.b for r in df.select(X.five_blocks(F.col("p"), F.col("u"), F.col("n")).alias("b")).collect()]
    assert tuple(got[0]) == (1, 2, 2)
    assert tuple(got[1]) == (5, 0, 0)
    assert got[2] is None
    assert sum(got[3]) == 5


def test_tokens_az3(spark):
    df = spark.createDataFrame([("café foo_bar abc1 Good day, the cat!",)], "t string")
    assert df.select(X.tokens_az3("t").alias("w")).first().w == ["good", "day", "the", "cat"]


def test_compact_score(spark):
    df = spark.createDataFrame([(999,), (1250,), (1350,), (10999,)], "s long")
    assert [r.c for r in df.select(X.compact_score("s").alias("c")).collect()] == ["999", "1.2k", "1.4k", "10k"]


# Hand-worked sentiment rows with the test lexicon (good 1.9, bad -2.5, great 3.1).
@pytest.mark.parametrize("text,compound", [
    ("", 0.0),
    ("good", 0.4404),                       # 1.9 / sqrt(1.9^2 + 15)
    ("not good", -0.3412),                  # 1.9 * -0.74
    ("very good", 0.4927),                  # 1.9 + 0.293
    ("good!", 0.4926),                      # sum 1.9 + 0.292
    ("GOOD day", 0.5622),                   # caps: 1.9 + 0.733
    ("good but bad", -0.5859),              # 1.9 * 0.5 - 2.5 * 1.5
    ("not very good", -0.3865),             # (1.9 + 0.293) * -0.74: negation two tokens back
    ("never so good", 0.5777),              # (1.9 + 0.293) * 1.25
    ("no good", -0.3412),                   # "no" before a lexicon word scores 0; good * -0.74
    ("the least good", -0.3412),            # least, not after at/very: * -0.74
    ("at least good", 0.4404),              # at least: unchanged
    ("good??", 0.504),                      # 2-3 question marks: 0.18 each
    ("good!!!!!!", 0.6209),                 # at most 4 exclamation marks count
    ("very bad", -0.5849),                  # booster sign follows the valence
])
def test_sentiment_rules(spark, text, compound):
    df = spark.createDataFrame([("a", text)], "id string, t string")
    got = sentiment_scores(df, "id", "t").first()
    assert got.compound == pytest.approx(compound, abs=1e-4)


# Hand-worked idioms and boosters of two words (lexicon: bomb -1, heart 1, die -2.9, good 1.9, right 0.5).
@pytest.mark.parametrize("text,total", [
    ("I say this is the bomb", 3.0),               # word before and the word itself
    ("the bomb", -1.0),                            # fewer than three tokens before: no idiom
    ("it was my broken heart", -2.9),
    ("a cake here to die for", -2.9),              # no sequence has its word in the middle
    ("well I said yeah right", -2.0),
    ("oh kind of very good", 1.9 + 0.293 - 0.293), # "very" one before, "kind of" two and three before
    ("it is kind of good", 1.9 - 0.293),
    ("it is just enough good", 1.9 - 0.293),
    ("good is the bomb", -1.0 + 1.9),              # third token before is in the lexicon: no idiom
])
def test_idioms(spark, monkeypatch, text, total):
    import math

    from chorus.plans import common
    lex = spark.createDataFrame([("bomb", -1.0), ("heart", 1.0), ("die", -2.9), ("good", 1.9), ("right", 0.5)],
                                "token string, valence double")
    df = spark.createDataFrame([("a", text)], "id string, t string")
    want = pytest.approx(total / math.sqrt(total * total + 15), abs=1e-4)
    assert sentiment_scores(df, "id", "t", lex).first().compound == want
    if text.startswith("good"):  # beyond the broadcast bound the joins shuffle, with the same result
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", 0)
        assert sentiment_scores(df, "id", "t", lex).first().compound == want


def plain_nearest(tokens, pos, present):
    """The reference's rule: the first of the smallest distance, at most 12 away."""
    at = [i for i, t in enumerate(tokens) if present(t)]
    best = min(at, key=lambda i: abs(i - pos), default=None)
    return best if best is not None and abs(best - pos) <= 12 else None


def test_long_sentence_without_a_full_stop(spark):
    """20,000 words, a third of them candidates: every anchor is the nearest one, in linear time."""
    import random
    import time
    rng = random.Random(5)
    words = [rng.choice(["claude", "gpt", "sonnet", "mini", "3.5", "o3", "plain", "words", "go", "here", "and", "on"])
             if (i // 500) % 2 else rng.choice(["plain", "words", "sonnet", "claude"] + ["x"] * 30) for i in range(20_000)]
    text = " ".join(words)
    df = spark.createDataFrame([("a", text)], "id string, title string").withColumn("text", F.lit(""))
    t0 = time.time()
    row = M.sentence_anchors(df, "id", "title", "text").select(F.inline("cands")).collect()
    got = {r.pos: (r.fp, r.vp) for r in row}
    fam, ver = (lambda t: t in ("claude", "gpt")), (lambda t: t in ("3.5", "o3"))
    for i, w in enumerate(words):
        if w in ("sonnet", "mini"):
            lo = max(0, i - 13)
            near = words[lo:i + 14]
            f, v = plain_nearest(near, i - lo, fam), plain_nearest(near, i - lo, ver)
            assert got[i] == (None if f is None else f + lo, None if v is None else v + lo)
    n = M.model_mentions(df, "id", "title", "text").count()
    assert n >= sum(w in ("sonnet", "mini") for w in words)
    assert time.time() - t0 < 120


def test_mentions_are_one_map(spark):
    """T4, T5 and J7 to J9 need no shuffle: a post's mentions come from its own row."""
    from chorus.plans.catalog import load_all
    from tests.conftest import SF_SMALL
    for name in ("model_mentions", "best_model_label", "adjacent_sentence_pairs", "nearest_anchor", "valid_combo"):
        plan = load_all()[name][0](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan, name
