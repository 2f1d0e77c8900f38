"""Scalar column functions (JVM built-ins only; they stay in whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorus import vocab

WORD_RUN = r"([a-z]{3,}+)(?![\p{L}\p{N}_])|[\p{L}\p{N}_]++"  # every run of word characters, group 1 if it is a word
PUNCT_CHARS = ".,:;()[]{}\"'"
SPACE = " \t\n\x0B\f\r"
LATE_ENDS = "\u0085\u2028\u2029"  # line ends that are no white space to a pattern; its $ stands before them too
SENTENCE_END = r"\s(?<=[.!?]\s)\s*+"  # white space after . ! or ?; only white space is looked at twice


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_space(text) -> Column:
    """``^\\s+|\\s+$`` removed; the pattern itself runs only on texts that end with one of ``LATE_ENDS``."""
    x = _c(text)
    late = F.right(x, F.lit(1)).isin(*LATE_ENDS)
    return F.when(late, F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.btrim(x, F.lit(SPACE)))


def tokens_az3(text) -> Column:
    """Lower-cased maximal word-character runs that are entirely [a-z]{3,}."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD_RUN), 1)
    return F.filter(runs, lambda w: w != "")


def sentences(text) -> Column:
    """Trim, split on whitespace that follows . ! or ?; blank text -> []."""
    return let(F.coalesce(_c(text), F.lit("")), lambda x: let(strip_space(x), lambda t: F.when(
        t == "", F.array().cast("array<string>")).otherwise(F.split(t, SENTENCE_END))))


def strip_punct_lower(tok) -> Column:
    """Lower-case and strip . , : ; ( ) [ ] { } " ' at both ends."""
    return F.btrim(F.lower(_c(tok)), F.lit(PUNCT_CHARS))


def version_tokens(tok) -> Column:
    """Version matches inside one whitespace token, lower-cased."""
    return F.regexp_extract_all(F.lower(_c(tok)), F.lit(vocab.VERSION_PATTERN), 0)


def sentiment_label(compound) -> Column:
    """>= 0.05 positive, <= -0.05 negative, else neutral."""
    c = _c(compound)
    return F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").otherwise("neutral")


def strip_class(compound) -> Column:
    """Strict > 0.05 / < -0.05."""
    c = _c(compound)
    return F.when(c > 0.05, "positive").when(c < -0.05, "negative").otherwise("neutral")


def sign_class(x) -> Column:
    """> 0 / < 0 / 0."""
    c = _c(x)
    return F.when(c > 0, "positive").when(c < 0, "negative").otherwise("neutral")


def length_bucket(text) -> Column:
    """0 chars -> 0; <50 -> 1; <100 -> 2; <200 -> 3; <400 -> 4; <600 -> 5; <800 -> 6; else 7."""
    n = F.length(F.coalesce(_c(text), F.lit("")))
    return (F.when(n == 0, 0).when(n < 50, 1).when(n < 100, 2).when(n < 200, 3)
            .when(n < 400, 4).when(n < 600, 5).when(n < 800, 6).otherwise(7))


def five_blocks(pos, neu, neg) -> Column:
    """Five blocks split by share, round-half-even; the surplus or deficit
    goes to the largest group (ties: positive, then neutral); total 0 -> NULL.
    Returns struct(pos_blocks, neu_blocks, neg_blocks)."""
    p, u, n = _c(pos), _c(neu), _c(neg)
    total = p + u + n
    pb = F.bround(p / total * 5).cast("int")
    ub = F.bround(u / total * 5).cast("int")
    nb = F.bround(n / total * 5).cast("int")
    diff = F.lit(5) - (pb + ub + nb)
    p_big = (pb >= ub) & (pb >= nb)
    u_big = (ub >= pb) & (ub >= nb)
    s = F.struct(
        F.when(p_big, pb + diff).otherwise(pb).alias("pos_blocks"),
        F.when(~p_big & u_big, ub + diff).otherwise(ub).alias("neu_blocks"),
        F.when(~p_big & ~u_big, nb + diff).otherwise(nb).alias("neg_blocks"),
    )
    return F.when(F.coalesce(total, F.lit(0)) > 0, s)


def compact_score(score) -> Column:
    """X11: >= 10000 -> floor(x/1000)k; >= 1000 -> x/1000 with one decimal and
    a k; else the integer. The one-decimal rounding is exact decimal
    half-even done in integers (the reference rounds the binary double, which
    can differ at exact .x5 ties)."""
    x = _c(score).cast("long")
    q = F.floor(x / 100).cast("long")
    r = x - q * 100
    tenths = F.when((r > 50) | ((r == 50) & (q % 2 == 1)), q + 1).otherwise(q)
    one_dec = F.concat((F.floor(tenths / 10)).cast("long").cast("string"), F.lit("."),
                       (tenths % 10).cast("string"), F.lit("k"))
    return (F.when(x >= 10000, F.concat(F.floor(x / 1000).cast("long").cast("string"), F.lit("k")))
            .when(x >= 1000, one_dec)
            .otherwise(x.cast("string")))


def age_bucket(created_epoch, as_of_epoch: int) -> Column:
    """Relative age label from whole days between ``as_of`` and the post."""
    days = F.floor((F.lit(as_of_epoch) - _c(created_epoch)) / 86400).cast("long")
    years = F.floor(days / 365).cast("long")
    return (F.when(_c(created_epoch).isNull(), "N/A")
            .when(days == 0, "today").when(days == 1, "yesterday")
            .when(days <= 7, "last week").when(days <= 30, "last month")
            .when(days <= 90, "3 months").when(days <= 365, "this year")
            .when(years == 1, "1 year")
            .otherwise(F.concat(years.cast("string"), F.lit(" years"))))


def utc_date(created_epoch) -> Column:
    """Epoch seconds -> UTC date text, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(_c(created_epoch) / 86400).cast("int")).cast("string")


def truncate_title(title, max_length: int) -> Column:
    """Drop U+FE0F, then keep at most max_length - 1 characters."""
    return F.substring(F.regexp_replace(_c(title), "️", ""), 1, max_length - 1)


def emoji_count(text) -> Column:
    """Characters whose UTF-8 form has 4 bytes (code point >= U+10000)."""
    return F.length(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[^\x{10000}-\x{10FFFF}]", ""))


def text_preview(title, selftext) -> Column:
    """First 100 chars of title + ' ' + selftext, newlines -> space, stripped, '...' if longer."""
    full = F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(selftext), F.lit("")))
    cut = F.trim(F.regexp_replace(F.substring(full, 1, 100), "\n", " "))
    return F.when(F.length(full) > 100, F.concat(cut, F.lit("..."))).otherwise(cut)


def safe_query(q) -> Column:
    """Space and '/' -> '_'."""
    return F.translate(_c(q), " /", "__")


def query_terms(query: str) -> list[str]:
    """Comma-separated OR query: trimmed, blanks dropped, lower-cased."""
    return [t.strip().lower() for t in query.split(",") if t.strip()]


def keyword_matches(title, selftext, terms: list[str]) -> Column:
    """Number of query terms contained in lower(title + ' ' + selftext)."""
    txt = F.lower(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(selftext), F.lit(""))))
    arr = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return F.size(F.filter(arr, lambda t: F.instr(txt, t) > 0))


def topic_match(title, selftext, terms: list[str]) -> Column:
    """at least one term is a substring of lower(title + ' ' + selftext)."""
    return keyword_matches(title, selftext, terms) > 0


def version_or_label(version, label) -> Column:
    """First non-empty of version, label, 'N/A'."""
    return F.coalesce(F.nullif(_c(version), F.lit("")), F.nullif(_c(label), F.lit("")), F.lit("N/A"))
