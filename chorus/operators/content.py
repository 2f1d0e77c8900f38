"""Page text extraction (S7) and content records (S8), all JVM expressions.

Text extraction follows an HTML parser's text view: comments, doctype,
processing instructions and the contents of script/style elements (to the end
of the page if unclosed) are dropped, every other text node is kept (title, nav
and footer included) and nodes are concatenated with no separator. One pattern
removes all markup in one pass from left to right, so a comment sign inside a
script, or a ``>`` inside a quoted attribute, ends nothing. Entities are decoded
once: numeric ones (128 to 159 read as windows-1252, impossible code points as
U+FFFD) and the named ones of HTML 4 plus ``&apos;``, with or without semicolon;
unknown names stay. The text is then split into lines, each line stripped and
split on double spaces, the non-empty chunks joined with one space; a length cap
is a parameter, off by default.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_TEXT_CAP = 5000  # the cap of the capped form

NAMED = {**{n: chr(c) for n, c in name2codepoint.items()}, "apos": "'"}
CP1252 = {c: ch for c in range(128, 160) if (ch := bytes([c]).decode("cp1252", "ignore"))}


def markup(plus: str) -> str:
    """The pattern of all markup. ``plus`` repeats without backtracking where the
    dialect has it (``++`` in Java), so that a tag without end costs linear time."""
    loop = "*+" if plus == "++" else "*"
    attrs = rf"""(?:=\s*"[^"]*"|=\s*'[^']*'|=|[^>=]{plus}){loop}>"""
    element = "|".join(rf"<{e}\b{attrs}.*?(?:</{e}\s*>|\z)" for e in ("script", "style"))
    return rf"(?is)<!--.*?-->|{element}|<[!?][^>]*>|</?[a-z]{attrs}"


ENTITY = "^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;?)"

# Python's notion of whitespace for str.strip(), and of line breaks for splitlines().
PY_SPACE = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
PY_LINES = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def _pystrip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def decode_entities(text: Column) -> Column:
    """Each ``&`` starts at most one entity; what it decodes to is not read again."""
    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, ENTITY, 1)
        rest = F.substr(part, F.length(F.regexp_extract(part, ENTITY, 0)) + 1)
        hexes = F.ltrim(F.substr(name, F.lit(3)), F.lit("0"))
        is_hex = F.lower(F.substr(name, F.lit(1), F.lit(2))) == "#x"
        code = (F.when(is_hex & (F.length(hexes) > 8), F.lit("0"))  # beyond every code point
                .when(is_hex, F.conv(hexes, 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2)))).try_cast("bigint")
        legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        numeric = (F.when(code.between(128, 159), F.coalesce(F.try_element_at(_literal_map(CP1252), code.cast("int")),
                                                             _char(code)))
                   .when(legal, _char(code)).otherwise(F.lit("\ufffd")))
        char = F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(_literal_map(NAMED), name))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part))
    parts = F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(decoded(p)))
    return F.array_join(parts, "")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def html_text(html: Column, cap: int | None = None) -> Column:
    """Visible text of an HTML document; its first ``cap`` characters if given."""
    h = F.coalesce(html, F.lit(""))
    h = decode_entities(F.regexp_replace(h, markup("++"), ""))
    lines = F.split(h, PY_LINES)
    chunks = F.flatten(F.transform(lines, lambda l: F.split(_pystrip(l), "  ")))
    kept = F.filter(F.transform(chunks, _pystrip), lambda c: c != "")
    text = F.array_join(kept, " ")
    return text if cap is None else F.substring(text, 1, cap)


def page_texts(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """(page_id, url, content_text) for every page."""
    return pages.select("page_id", "url", html_text(F.col("html"), cap).alias("content_text"))


def content_records(eligible_posts: DataFrame, pages: DataFrame) -> DataFrame:
    """One record per eligible post whose page yields non-empty text:
    (post_id, url, content_text); of several such pages with one url the last (largest page_id) wins. The join on url is a plain equi-join
    (AQE broadcasts the smaller side when its runtime size allows)."""
    texts = F.filter(F.array(html_text(F.col("html"))), lambda c: c != "")  # a text is made once and tested as it is
    t = pages.select("page_id", "url", F.explode(texts).alias("content_text")) \
        .groupBy("url").agg(F.max_by("content_text", "page_id").alias("content_text"))
    p = eligible_posts.select(F.col("id").alias("post_id"), "url")
    return p.join(t, "url").select("post_id", "url", "content_text")
