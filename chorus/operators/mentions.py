"""Product-version extraction (T3) and model mentions.

T3 is one ordered-alternation regex: the leftmost match, and at equal
positions the first pattern, is exactly "earliest match, ties by priority".

T4 is one expression over a post's row: its sentences, their tokens and the mentions stay
arrays of the row, so nothing is shuffled, joined or windowed. A tier or version looks for
its nearest family (a tier also for its nearest version) among the tokens at most
``WINDOW`` places away, left before right at equal distance (J7): 25 looks however long
the sentence is. What is kept once per sentence or post (a vendor's first family, versions
taken by tiers, pairs across sentences) is kept per distinct value, of which the
vocabulary has few. Sentence text is attached to the finished mentions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus import vocab
from chorus.functions.text import let, sentences, strip_punct_lower, strip_space, version_tokens

WINDOW = 12
WS = r"[ \t\n\r\f\x0B]+"
_NAMES = [w for w, _ in vocab.FAMILIES] + [w for w, _ in vocab.TIERS]
CANDIDATE = f"[0-9]|(?=[{''.join(sorted({w[0] for w in _NAMES}))}])(?:{'|'.join(map(re.escape, _NAMES))})"


def _by_head(patterns: list[str]) -> str:
    """One pattern for the alternation of ``patterns``, each of which starts with a word of plain letters: the
    word is looked for once, what may follow it stays in order. At one place only one word can start (none
    starts another), so the order among the words does not matter."""
    rests: dict[str, list[str]] = {}
    for p in patterns:
        head = re.match(r"[a-z]+(?![*+?{])", p)[0]
        rests.setdefault(head, []).append(p[len(head):])
    assert not any(a != b and a.startswith(b) for a in rests for b in rests)
    return "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in rests.items())


PRODUCT_VERSION = _by_head(vocab.PRODUCT_VERSION_PATTERNS)


def product_version(text: Column) -> Column:
    """Normalised product version of lower(text), NULL if nothing matches. The text is searched once,
    the labels are chosen on the match alone."""
    def label(m):
        out = None
        for pat, name in vocab.PRODUCT_VERSION_LABELS:
            out = (F.when(m.rlike(pat), F.lit(name)) if out is None else out.when(m.rlike(pat), F.lit(name)))
        # fall-through: title case of a single lower-case word such as "claude3"
        return F.when(m.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.initcap(m)))
    return let(F.regexp_extract(F.lower(text), PRODUCT_VERSION, 0), lambda m: let(F.when(m != "", F.trim(m)), label))


def _strip(x: Column) -> Column:
    return strip_space(F.coalesce(x, F.lit("")))


def _content(title: Column, text: Column) -> Column:
    return let(_strip(title), lambda t: let(_strip(text), lambda x: F.when(x == "", t).when(t == "", x).otherwise(
        F.concat(t, F.lit(" "), x))))


def _lookup(pairs, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in pairs if v is not None for x in (k, v)]), key)


def _valid(vendor: Column, version: Column, tier: Column) -> Column:
    """The (vendor, version, tier) combination is in the valid matrix; NULL is a value."""
    none = F.lit("-")
    key = F.concat_ws("|", F.coalesce(vendor, none), F.coalesce(version, none), F.coalesce(tier, none))
    return key.isin(["|".join("-" if x is None else x for x in row) for row in vocab.VALID_COMBOS])


def _maybe(sent: Column) -> Column:
    """A sentence can only hold a candidate if its lower-case text contains a family or tier
    word or a digit (every version token has one)."""
    return F.lower(sent).rlike(CANDIDATE)


def tokens(sent: Column) -> Column:
    """Tokens of a sentence: lt (X3), vers (X4), fv (vendor of a family), tier (or NULL)."""
    tiers = [w for w, _ in vocab.TIERS]

    def one(tok):
        return let(strip_punct_lower(tok), lambda lt: F.struct(
            lt.alias("lt"), version_tokens(tok).alias("vers"), _lookup(vocab.FAMILIES, lt).alias("fv"),
            F.when(lt.isin(tiers), lt).alias("tier")))
    return F.transform(F.filter(F.split(sent, WS), lambda x: x != ""), one)


_OFFSETS = [0, *(o for d in range(1, WINDOW + 1) for o in (-d, d))]


def _nearest(toks: Column, pos: Column, present) -> Column:
    """Place of the nearest token that is ``present``, at most WINDOW away, ties to the left."""
    offsets = F.array(*[F.lit(o) for o in _OFFSETS])
    return pos + F.get(F.filter(offsets, lambda o: F.coalesce(present(F.get(toks, pos + o)), F.lit(False))), F.lit(0))


def _is_family(t: Column) -> Column:
    return t["fv"].isNotNull()


def _has_version(t: Column) -> Column:
    return F.size(t["vers"]) > 0


def anchors(toks: Column) -> Column:
    """Candidate tokens with their anchors: (pos, t, fp, vp): the token, the places of its nearest
    family and, for tiers, of its nearest version."""
    numbered = F.transform(toks, lambda t, i: F.struct(i.alias("pos"), t.alias("t")))
    cands = F.filter(numbered, lambda c: _is_family(c["t"]) | c["t"]["tier"].isNotNull() | _has_version(c["t"]))
    return F.transform(cands, lambda c: F.struct(
        c["pos"].alias("pos"), c["t"].alias("t"),
        F.when(c["t"]["tier"].isNotNull() | _has_version(c["t"]), _nearest(toks, c["pos"], _is_family)).alias("fp"),
        F.when(c["t"]["tier"].isNotNull(), _nearest(toks, c["pos"], _has_version)).alias("vp")))


def _mention(step, pos, mi, vendor, family, version, tier, confidence) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(step).alias("step"), pos.alias("pos"), mi.alias("mi"), vendor.alias("vendor"),
                    family.alias("family"), (none if version is None else version).alias("version"),
                    (none if tier is None else tier).alias("tier"), confidence.alias("confidence"))


def _tier_mention(toks: Column, c: Column) -> Column:
    fam = F.get(toks, c["fp"])
    vendor = F.coalesce(fam["fv"], _lookup(vocab.TIERS, c["t"]["tier"]))
    raw = F.get(F.get(toks, c["vp"])["vers"], F.lit(0))
    version = F.when(vendor.isNotNull() & raw.isNotNull() & ~_valid(vendor, raw, c["t"]["tier"]),
                     F.lit(None).cast("string")).otherwise(raw)
    confidence = (F.when(c["fp"].isNotNull() & version.isNotNull(), F.lit("high"))
                  .when(c["fp"].isNotNull() | vendor.isNotNull(), F.lit("medium")).otherwise(F.lit("low")))
    return _mention(1, c["pos"], F.lit(0), vendor, F.coalesce(fam["lt"], _lookup(vocab.VENDOR_FAMILY, vendor)), version,
                    c["t"]["tier"], confidence)


def _version_mentions(toks: Column, c: Column) -> Column:
    fam = F.get(toks, c["fp"])

    def one(v, mi):
        prior = (F.when(v.startswith("4") | v.startswith("o"), F.lit("openai"))
                 .when(v.startswith("3"), F.lit("anthropic")))
        vendor = F.coalesce(fam["fv"], prior)
        confidence = (F.when(c["fp"].isNotNull(), F.lit("high")).when(vendor.isNotNull(), F.lit("medium"))
                      .otherwise(F.lit("low")))
        return _mention(2, c["pos"], mi, vendor, F.coalesce(fam["lt"], _lookup(vocab.VENDOR_FAMILY, vendor)), v, None,
                        confidence)
    return F.transform(c["t"]["vers"], one)


def _distinct(arr: Column, value) -> Column:
    """Distinct non-null values over an array; as few as the vocabulary has."""
    return F.array_distinct(F.filter(F.transform(arr, value), lambda v: v.isNotNull()))


def _family_mentions(cands: Column, used: Column) -> Column:
    """Step 3: the first family of every vendor without a mention so far."""
    fams = F.filter(cands, lambda c: _is_family(c["t"]))
    def one(v):
        first = F.get(F.filter(fams, lambda c: c["t"]["fv"] == v), F.lit(0))
        return _mention(3, first["pos"], F.lit(0), v, first["t"]["lt"], None, None, F.lit("medium"))
    return F.transform(F.array_except(_distinct(fams, lambda c: c["t"]["fv"]), used), one)


def sentence_mentions(sent: Column) -> Column:
    """Steps 1-3 of T4 for one sentence: an array of (step, pos, mi, vendor, family, version,
    tier, confidence)."""
    def of(toks, cands):
        tiers = F.transform(F.filter(cands, lambda c: c["t"]["tier"].isNotNull()), lambda c: _tier_mention(toks, c))
        versions = F.flatten(F.transform(F.filter(cands, lambda c: _has_version(c["t"])), lambda c: _version_mentions(toks, c)))

        def rest(tm):
            return let(_distinct(tm, lambda m: m["version"]), lambda taken: let(
                F.concat(tm, F.filter(versions, lambda m: ~F.array_contains(taken, m["version"]))),
                lambda found: F.concat(found, _family_mentions(cands, _distinct(found, lambda m: m["vendor"])))))
        return let(tiers, rest)
    return let(tokens(sent), lambda toks: let(anchors(toks), lambda cands: of(toks, cands)))


_MENTIONS = ("array<struct<step:int,pos:int,mi:int,vendor:string,family:string,version:string,tier:string,"
                      "confidence:string>>")


def _pairs(sents_mentions: Column) -> Column:
    """J8 candidates in order: a version-only mention of sentence i with a tier-only one of the
    same vendor in i + 1 (pass 0), then tier-only in i with version-only in i + 1 (pass 1).
    Equal mentions of a sentence count once, at their first place."""
    def firsts(ms, keep, what):
        kept = F.filter(ms, lambda m: m["vendor"].isNotNull() & keep(m))
        keys = F.array_distinct(F.transform(kept, lambda m: F.struct(m["vendor"].alias("vendor"), what(m).alias("what"))))
        return F.transform(keys, lambda k: let(
            F.get(F.filter(kept, lambda m: (m["vendor"] == k["vendor"]) & (what(m) == k["what"])), F.lit(0)),
            lambda m: F.struct(k["vendor"].alias("vendor"), k["what"].alias("what"),
                               F.struct(m["step"].alias("step"), m["pos"].alias("pos"), m["mi"].alias("mi")).alias("o"))))
    sides = F.transform(sents_mentions, lambda ms: F.struct(
        firsts(ms, lambda m: m["version"].isNotNull() & m["tier"].isNull(), lambda m: m["version"]).alias("v"),
        firsts(ms, lambda m: m["tier"].isNotNull() & m["version"].isNull(), lambda m: m["tier"]).alias("t")))

    def between(sides):
        def at(i, first, second, number, version, tier):
            return F.flatten(F.transform(F.get(sides, i)[first], lambda a: F.transform(
                F.filter(F.get(sides, i + 1)[second], lambda b: b["vendor"] == a["vendor"]), lambda b: F.struct(
                    i.alias("s_ix"), F.lit(number).alias("pass"), a["o"].alias("o1"), b["o"].alias("o2"),
                    a["vendor"].alias("vendor"), version(a, b).alias("version"), tier(a, b).alias("tier")))))
        both = F.transform(sides, lambda _s, i: F.when(i + 1 < F.size(sides), F.concat(
            at(i, "v", "t", 0, lambda a, b: a["what"], lambda a, b: b["what"]),
            at(i, "t", "v", 1, lambda a, b: b["what"], lambda a, b: a["what"]))))
        return F.flatten(F.filter(both, lambda x: x.isNotNull()))
    return let(sides, between)


def _combined(sents_mentions: Column) -> Column:
    """The first pair of every valid combination that no mention has already."""
    def key(m):
        return F.struct(m["vendor"].alias("vendor"), m["version"].alias("version"), m["tier"].alias("tier"))
    there = F.array_distinct(F.transform(F.flatten(sents_mentions), key))
    pairs = F.filter(_pairs(sents_mentions), lambda p: _valid(p["vendor"], p["version"], p["tier"]))

    def of(pairs):
        new = F.array_except(F.array_distinct(F.transform(pairs, key)), there)
        return F.transform(new, lambda k: F.get(F.filter(pairs, lambda p: key(p) == k), F.lit(0)))
    return let(pairs, of)


def post_mentions(title: Column, text: Column) -> Column:
    """T4 of one post: an array of (s_ix, step, pos, mi, vendor, family, version, tier, confidence,
    is_combined, o1, o2, text). Combined mentions (J8) come last; ``o1`` and ``o2`` are
    the places of their two halves."""
    order = "struct<step:int,pos:int,mi:int>"

    def rows(sents):
        def of(per):
            own = F.flatten(F.transform(per, lambda ms, i: F.transform(ms, lambda m: F.struct(
                i.alias("s_ix"), *(m[c].alias(c) for c in ("step", "pos", "mi", "vendor", "family", "version", "tier",
                                                           "confidence")),
                F.lit(False).alias("is_combined"), F.lit(None).cast(order).alias("o1"), F.lit(None).cast(order).alias("o2"),
                F.get(sents, i).alias("text")))))
            comb = F.transform(_combined(per), lambda p: F.struct(
                p["s_ix"].alias("s_ix"), F.lit(4).alias("step"), p["pass"].alias("pos"), F.lit(0).alias("mi"),
                p["vendor"].alias("vendor"),
                F.coalesce(_lookup(vocab.VENDOR_FAMILY, p["vendor"]), p["vendor"]).alias("family"),
                p["version"].alias("version"), p["tier"].alias("tier"), F.lit("high").alias("confidence"),
                F.lit(True).alias("is_combined"), p["o1"].alias("o1"), p["o2"].alias("o2"),
                F.concat(F.get(sents, p["s_ix"]), F.lit(" "), F.get(sents, p["s_ix"] + 1)).alias("text")))
            return F.concat(own, comb)
        return let(F.transform(sents, lambda s: F.when(_maybe(s), sentence_mentions(s)).otherwise(
            F.expr(f"cast(array() as {_MENTIONS})"))), of)
    return let(sentences(_content(title, text)), rows)


def model_mentions(df: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """T4: all mentions of each post, one row each."""
    return df.select(F.col(id_col).alias("post"), F.inline(post_mentions(F.col(title_col), F.col(text_col))))


def sentence_anchors(df: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """(post, s_ix, toks, cands): the tokens and candidates (with J7 anchors) of every sentence that
    can hold one."""
    s = df.select(F.col(id_col).alias("post"),
                  F.posexplode(sentences(_content(F.col(title_col), F.col(text_col)))).alias("s_ix", "sent")).where(_maybe(F.col("sent")))
    both = let(tokens(F.col("sent")), lambda toks: F.struct(toks.alias("toks"), anchors(toks).alias("cands")))
    return s.select("post", "s_ix", both.alias("b")).select("post", "s_ix", "b.*")


def _cap(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))


def mention_label(vendor: Column, version: Column, tier: Column) -> Column:
    """Display label of a mention."""
    digits = F.regexp_replace(version, r"\.", "").rlike("^[0-9]+$")
    anth = (F.when(version.isNotNull() & tier.isNotNull(),
                   F.when(digits, F.concat(F.lit("Claude "), _cap(version), F.lit(" "), _cap(tier)))
                   .otherwise(F.concat(F.lit("Claude "), F.upper(version), F.lit(" "), _cap(tier))))
            .when(tier.isNotNull(), F.concat(F.lit("Claude "), _cap(tier)))
            .when(version.isNotNull(), F.when(version.startswith("o"), F.concat(F.lit("Claude "), F.upper(version)))
                  .otherwise(F.concat(F.lit("Claude "), version)))
            .otherwise(F.lit("Claude")))
    oai = F.when(version.isNotNull(), F.when(version.startswith("o"), F.upper(version))
                 .otherwise(F.concat(F.lit("GPT-"), version))).otherwise(F.lit("OpenAI"))
    other = F.when(tier.isNotNull(), _cap(tier)).when(vendor.isNotNull(), _cap(vendor)).otherwise(F.lit("Unknown"))
    return F.when(vendor == "anthropic", anth).when(vendor == "openai", oai).otherwise(other)


def best_model_label(title: Column, text: Column) -> Column:
    """T5: the first non-Unknown label of a post's mentions by (confidence, order); NULL without one."""
    rank = lambda m: F.when(m["confidence"] == "high", 0).when(m["confidence"] == "medium", 1).otherwise(2)
    ranked = F.transform(post_mentions(title, text), lambda m: F.struct(
        rank(m).alias("r"), m["is_combined"].alias("c"), m["s_ix"].alias("s"), m["step"].alias("st"), m["pos"].alias("p"),
        m["mi"].alias("mi"), m["o1"].alias("o1"), m["o2"].alias("o2"),
        mention_label(m["vendor"], m["version"], m["tier"]).alias("label")))
    return F.array_min(F.filter(ranked, lambda m: m["label"] != "Unknown"))["label"]
