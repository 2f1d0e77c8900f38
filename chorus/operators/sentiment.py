"""Rule-and-lexicon sentiment scores as one Spark plan.

Per text: whitespace tokens, punctuation stripped unless <= 2 chars would
remain; each token looks at up to three tokens before it and two after it.
The neighbour context is built inside the row (``transform``), so a single
explode feeds broadcast joins against a caller's (bounded) lexicon; the built-in one is
looked up in the row, before the explode. Only lexicon hits plus one statistics row per text reach the shuffle, where a
partial aggregate folds them per text id. No window, no Python UDF. A lexicon beyond the
broadcast bound is joined once, with the distinct tokens of each text.

Rules (published method): lexicon valence; booster words before a word
(+-0.293, damped x0.95 / x0.9 at distance 2 / 3); negation (x-0.74);
"never so/this" (x1.25); "without doubt"; "least"; ALL-CAPS emphasis
(+-0.733) when some but not all tokens are capitals; "no" before a lexicon
word; "kind of"; the first "but" (x0.5 before, x1.5 after); "!" and "?"
emphasis; compound = s / sqrt(s^2 + 15). Where three tokens stand before a word
and the third is not in the lexicon, an idiom around the word replaces its valence
and a booster of two words before it is added. Emoji descriptions of the published
package are not applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus import vocab
from chorus.plans import common
from chorus.plans.common import small
from chorus.session import cut_lineage

WS = r"[ \t\n\r\f\x0B]+"
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # exactly ASCII punctuation


def _strip_word(t: Column) -> Column:
    s = F.btrim(t, F.lit(PUNCT))
    return F.when(F.length(s) <= 2, t).otherwise(s)


def _is_upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def _booster(p: Column) -> Column:
    return (F.when(p.isin(vocab.BOOSTERS_UP), F.lit(vocab.BOOST_INCR))
            .when(p.isin(vocab.BOOSTERS_DOWN), F.lit(vocab.BOOST_DECR)).otherwise(F.lit(0.0)))


def _negated(p: Column) -> Column:
    return F.coalesce(p.isin(vocab.NEGATIONS) | p.contains("n't"), F.lit(False))


def _values(pairs: list[tuple[str, float]]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def _words(*ws: Column) -> Column:
    return F.concat(*[x for w in ws for x in (F.lit(" "), w)][1:])


def lexicon_for_join(spark, lexicon: DataFrame | None) -> tuple[DataFrame, bool]:
    """(token, valence) with lower-case unique tokens, and whether it is marked for broadcast.
    The built-in lexicon has a fixed size; a caller's lexicon is counted once
    and broadcast only if it is within the bound."""
    if lexicon is None:
        return small(spark, "lexicon"), True
    lex = lexicon.select(F.lower("token").alias("token"), F.col("valence").cast("double").alias("valence")) \
        .where(F.col("token").isNotNull()).groupBy("token").agg(F.max("valence").alias("valence"))
    lex = cut_lineage(lex)
    fits = lex.count() <= common.MAX_BROADCAST_ROWS
    return (F.broadcast(lex) if fits else lex), fits


def _texts(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """Per text: its words as they are (w) and lower-cased (lw), and what the rules need of the whole."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.struct(*[F.col(c) for c in id_cols]).alias("sid"), raw.alias("raw"))
    base = base.select(
        "sid", "raw",
        F.transform(F.filter(F.split("raw", WS), lambda t: t != ""), _strip_word).alias("w"))
    base = base.select("sid", "raw", "w", F.transform("w", lambda x: F.lower(x)).alias("lw"))
    return base.select(
        "sid", "w", "lw",
        F.size("w").alias("n"),
        (F.exists("w", _is_upper) & F.exists("w", lambda x: ~_is_upper(x))).alias("cap_diff"),
        (F.array_position("lw", "but") - 1).alias("bi"),
        F.col("raw").rlike(r"^\s*$").alias("blank"),
        (F.least(F.length("raw") - F.length(F.regexp_replace("raw", "!", "")), F.lit(4)) * 0.292
         + F.expr("""CASE WHEN length(raw) - length(replace(raw, '?', '')) > 3 THEN 0.96
                          WHEN length(raw) - length(replace(raw, '?', '')) > 1
                            THEN (length(raw) - length(replace(raw, '?', ''))) * 0.18
                          ELSE 0.0 END""")).alias("amp"),
    )


_TEXT_COLUMNS = ["sid", "n", "cap_diff", "bi", "blank", "amp"]


def _item(i: Column, *more: Column) -> Column:
    """The token at place ``i`` with its neighbours (NULL when out of range)."""
    tok = lambda a, i: F.get(F.col(a), i)
    return F.struct(
        i.alias("i"), tok("lw", i).alias("tok"), _is_upper(tok("w", i)).alias("up"),
        tok("lw", i - 1).alias("p1"), tok("lw", i - 2).alias("p2"), tok("lw", i - 3).alias("p3"),
        tok("lw", i + 1).alias("n1"), tok("lw", i + 2).alias("n2"),
        F.coalesce(_is_upper(tok("w", i - 1)), F.lit(False)).alias("p1up"),
        F.coalesce(_is_upper(tok("w", i - 2)), F.lit(False)).alias("p2up"),
        F.coalesce(_is_upper(tok("w", i - 3)), F.lit(False)).alias("p3up"), *more)


def _text_item(*more: Column) -> Column:
    """The entry (i = -1) that stands for the text."""
    null_s = F.lit(None).cast("string")
    return F.struct(F.lit(-1).alias("i"), null_s.alias("tok"), F.lit(False).alias("up"),
                    null_s.alias("p1"), null_s.alias("p2"), null_s.alias("p3"), null_s.alias("n1"), null_s.alias("n2"),
                    F.lit(False).alias("p1up"), F.lit(False).alias("p2up"), F.lit(False).alias("p3up"), *more)


def _items() -> Column:
    """The entry of the text and all its tokens."""
    return F.concat(F.array(_text_item()), F.transform("w", lambda x, i: _item(i)))


def token_rows(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """One row per token with its neighbours, plus one statistics row (i = -1) per text."""
    return _texts(df, id_cols, text_col).select(*_TEXT_COLUMNS, F.explode(_items()).alias("t")).select(*_TEXT_COLUMNS, "t.*")


def _hits_in_row(df: DataFrame, id_cols: list[str], text_col: str, lexicon: list[tuple[str, float]]) -> DataFrame:
    """The same rows with a lexicon of a few words, looked up in the text's own row: only hits get
    their neighbours, and only they and the text's entry become rows."""
    keys = [t for t, _ in lexicon]

    def there(x):
        return F.coalesce(x.isin(keys), F.lit(False))

    def hit(i):
        near = [F.get(F.col("lw"), i + k) for k in (-1, -2, -3, 1)]
        return _item(i, F.try_element_at(_values(lexicon), F.get(F.col("lw"), i)).alias("valence"),
                     *(there(x).alias(c) for x, c in zip(near, ("in1", "in2", "in3", "inn"))))
    no = F.lit(False)
    text = _text_item(F.lit(None).cast("double").alias("valence"), no.alias("in1"), no.alias("in2"), no.alias("in3"), no.alias("inn"))
    places = F.filter(F.transform("lw", lambda x, i: F.when(x.isin(keys), i)), lambda i: i.isNotNull())
    rows = _texts(df, id_cols, text_col).withColumn("places", places)
    return rows.select(*_TEXT_COLUMNS, F.explode(F.concat(F.array(text), F.transform("places", hit))).alias("t")) \
        .select(*_TEXT_COLUMNS, "t.*")


def _hits_by_broadcast(df: DataFrame, id_cols: list[str], text_col: str, lex: DataFrame) -> DataFrame:
    """Lexicon hits and statistics rows; the lexicon is small enough for every task to hold it."""
    rows = token_rows(df, id_cols, text_col)
    hits = rows.join(lex, rows.tok == lex.token, "left").drop("token") \
        .where((F.col("i") == -1) | F.col("valence").isNotNull())
    for name, col in (("in1", "p1"), ("in2", "p2"), ("in3", "p3"), ("inn", "n1")):
        side = lex.select(F.col("token").alias(f"{name}_t"), F.lit(True).alias(name))
        hits = hits.join(side, hits[col] == side[f"{name}_t"], "left").drop(f"{name}_t")
    return hits.fillna(False, subset=["in1", "in2", "in3", "inn"])


def _hits_by_dictionary(df: DataFrame, id_cols: list[str], text_col: str, lex: DataFrame) -> DataFrame:
    """The same rows with a lexicon of any size: the distinct tokens of each text meet it in one
    join, the found ones come back to the text as its dictionary, and valences and the
    neighbours' flags are looked up there. A token that every text holds is one row a text."""
    texts = cut_lineage(_texts(df, id_cols, text_col))
    distinct = texts.select("sid", F.explode(F.array_distinct("lw")).alias("tok"))
    known = distinct.join(lex, distinct.tok == lex.token).groupBy("sid").agg(
        F.map_from_entries(F.collect_list(F.struct("tok", "valence"))).alias("known"))
    both = texts.join(known, "sid", "left")

    def there(key):
        return F.coalesce(F.try_element_at(F.col("known"), key).isNotNull(), F.lit(False))
    rated = F.transform(_items(), lambda t: F.struct(
        *(t[c].alias(c) for c in ("i", "tok", "up", "p1", "p2", "p3", "n1", "n2", "p1up", "p2up", "p3up")),
        F.try_element_at(F.col("known"), t["tok"]).alias("valence"), there(t["p1"]).alias("in1"), there(t["p2"]).alias("in2"),
        there(t["p3"]).alias("in3"), there(t["n1"]).alias("inn")))
    hits = F.filter(rated, lambda t: (t["i"] == -1) | t["valence"].isNotNull())
    return both.select(*_TEXT_COLUMNS, F.explode(hits).alias("t")).select(*_TEXT_COLUMNS, "t.*")


def _apply_valence(df: DataFrame) -> DataFrame:
    """Valence of each lexicon hit from its neighbours. Each rule is one
    projection over the previous one (column ``v``), so the plan stays linear
    in the number of rules instead of nesting the previous value in every CASE."""
    c = F.col
    p1, p2, p3 = c("p1"), c("p2"), c("p3")
    v = c("v")
    df = df.withColumn("v", F.when(F.coalesce((p1 == "no") | (p2 == "no") | ((p3 == "no") & p1.isin("or", "nor")),
                                              F.lit(False)), c("valence") * vocab.NEGATION_SCALAR)
                       .when((c("tok") == "no") & c("inn"), F.lit(0.0)).otherwise(c("valence")))
    df = df.withColumn("v", F.when(c("up") & c("cap_diff"),
                                   F.when(v > 0, v + vocab.CAPS_INCR).otherwise(v - vocab.CAPS_INCR)).otherwise(v))
    df = df.withColumns({"b1": _booster(p1), "b2": _booster(p2), "b3": _booster(p3)})
    for k, (p, inp, pup) in enumerate([(p1, c("in1"), c("p1up")), (p2, c("in2"), c("p2up")),
                                       (p3, c("in3"), c("p3up"))]):
        b = c(f"b{k + 1}")
        s = F.when(v < 0, -b).otherwise(b)
        s = F.when((b != 0) & pup & c("cap_diff"),
                   F.when(v > 0, s + vocab.CAPS_INCR).otherwise(s - vocab.CAPS_INCR)).otherwise(s)
        nv = v + s * {0: 1.0, 1: 0.95, 2: 0.9}[k]
        if k == 0:
            nv = F.when(_negated(p1), nv * vocab.NEGATION_SCALAR).otherwise(nv)
        elif k == 1:
            nv = (F.when((p2 == "never") & p1.isin("so", "this"), nv * 1.25)
                  .when((p2 == "without") & (p1 == "doubt"), nv)
                  .when(_negated(p2), nv * vocab.NEGATION_SCALAR).otherwise(nv))
        else:
            nv = (F.when(((p3 == "never") & p2.isin("so", "this")) | p1.isin("so", "this"), nv * 1.25)
                  .when((p3 == "without") & ((p2 == "doubt") | (p1 == "doubt")), nv)
                  .when(_negated(p3), nv * vocab.NEGATION_SCALAR).otherwise(nv))
        df = df.withColumn("v", F.when(p.isNotNull() & ~inp, nv).otherwise(v))
    tok, n1, n2 = c("tok"), c("n1"), c("n2")
    # the words after the token come last, so they win; a missing neighbour makes a NULL key
    idiom = F.coalesce(*[F.try_element_at(_values(vocab.IDIOMS), _words(*ws)) for ws in (
        (tok, n1, n2), (tok, n1), (p1, tok), (p2, p1, tok), (p2, p1), (p3, p2, p1), (p3, p2))], v)
    two = sum((F.coalesce(F.try_element_at(_values(vocab.BOOSTERS_TWO_WORDS), _words(*ws)), F.lit(0.0))
               for ws in ((p3, p2), (p2, p1))), F.lit(0.0))
    df = df.withColumn("v", F.when(p3.isNotNull() & ~c("in3"), idiom + two).otherwise(v))
    least = (p1 == "least") & ~c("in1")
    i = c("i")
    df = df.withColumn("v", F.when((i > 1) & least, F.when((p2 != "at") & (p2 != "very"), v * vocab.NEGATION_SCALAR)
                                   .otherwise(v))
                       .when((i > 0) & least, v * vocab.NEGATION_SCALAR).otherwise(v))
    bi = c("bi")
    return df.withColumn("v", F.when(c("tok").isin(vocab.BOOSTERS_UP + vocab.BOOSTERS_DOWN), F.lit(0.0))
                         .when((c("tok") == "kind") & (c("n1") == "of"), F.lit(0.0))
                         .when((bi >= 0) & (i < bi), v * 0.5).when((bi >= 0) & (i > bi), v * 1.5)
                         .otherwise(v)).drop("b1", "b2", "b3")


def sentiment_scores(df: DataFrame, id_cols, text_col: str, lexicon: DataFrame | None = None) -> DataFrame:
    """(*id_cols, compound, positive, neutral, negative) for every row of ``df``.
    Blank or NULL text scores (0, 0, 1, 0). ``id_cols`` must be a unique key."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    spark = df.sparkSession
    if lexicon is None:
        hits = _hits_in_row(df, id_cols, text_col, vocab.TEST_LEXICON)
    else:
        lex, fits = lexicon_for_join(spark, lexicon)
        hits = (_hits_by_broadcast if fits else _hits_by_dictionary)(df, id_cols, text_col, lex)
    hits = _apply_valence(hits).withColumn("v", F.when(F.col("i") >= 0, F.col("v")))
    agg = hits.groupBy("sid").agg(
        F.max(F.when(F.col("i") == -1, F.col("n"))).alias("n"),
        F.max(F.when(F.col("i") == -1, F.col("amp"))).alias("amp"),
        F.max(F.when(F.col("i") == -1, F.col("blank"))).alias("blank"),
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum_v"),
        F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("v") + 1)), F.lit(0.0)).alias("pos_sum"),
        F.coalesce(F.sum(F.when(F.col("v") < 0, F.col("v") - 1)), F.lit(0.0)).alias("neg_sum"),
        F.count(F.when(F.col("v") != 0, 1)).alias("nz"),
    )
    agg = agg.select(
        "sid", "blank",
        F.when(F.col("sum_v") > 0, F.col("sum_v") + F.col("amp"))
        .when(F.col("sum_v") < 0, F.col("sum_v") - F.col("amp")).otherwise(F.col("sum_v")).alias("s"),
        F.when(F.col("pos_sum") > F.abs(F.col("neg_sum")), F.col("pos_sum") + F.col("amp"))
        .otherwise(F.col("pos_sum")).alias("ps"),
        F.when(F.col("pos_sum") < F.abs(F.col("neg_sum")), F.col("neg_sum") - F.col("amp"))
        .otherwise(F.col("neg_sum")).alias("ns"),
        (F.col("n") - F.col("nz")).cast("double").alias("neu"))
    s, ps, ns, neu = F.col("s"), F.col("ps"), F.col("ns"), F.col("neu")
    comp = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s / F.sqrt(s * s + vocab.NORMALIZE_ALPHA)))
    total = ps + F.abs(ns) + neu
    blank = F.col("blank")
    return agg.select(
        *[F.col("sid")[c].alias(c) for c in id_cols],
        F.when(blank, 0.0).otherwise(F.round(comp, 4)).alias("compound"),
        F.when(blank, 0.0).otherwise(F.round(F.abs(ps / total), 3)).alias("positive"),
        F.when(blank, 1.0).otherwise(F.round(F.abs(neu / total), 3)).alias("neutral"),
        F.when(blank, 0.0).otherwise(F.round(F.abs(ns / total), 3)).alias("negative"),
    )
