"""Product-version and model-mention queries over the posts binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus import vocab
from chorus.functions import text as X
from chorus.operators import mentions as M
from chorus.plans.catalog import query
from chorus.plans.sqlviews import with_views
from chorus.sources.tables import posts

# ----------------------------------------------------------------- SQL side
_ALT = "|".join(f"(?:{p})" for p in vocab.PRODUCT_VERSION_PATTERNS)
_SQL_VERSION = ("CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN '{lab}'" for p, lab in vocab.PRODUCT_VERSION_LABELS)
                + " ELSE upper(substr(m, 1, 1)) || substr(m, 2) END")
_SQL_PV = f"""
  SELECT id, CASE WHEN m IS NULL THEN NULL ELSE {_SQL_VERSION} END AS claude_version FROM (
    SELECT id, trim(nullif(regexp_extract(lower(title || ' ' || selftext), '{_ALT}', 0), '')) AS m FROM posts)"""

_TRIM = r"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"
_CONTENT = ("CASE WHEN {b} = '' THEN {a} WHEN {a} = '' THEN {b} ELSE {a} || ' ' || {b} END"
            .format(a=_TRIM.format(x="title"), b=_TRIM.format(x="selftext")))
_STRIPP = r"""regexp_replace(lower(tok), '^[.,:;()\[\]{}"'']+|[.,:;()\[\]{}"'']+$', '', 'g')"""

_MCTE: dict[str, str] = {
    "m_content": f"SELECT id AS post, {_CONTENT} AS content FROM posts",
    "m_sl": r"""SELECT post, CASE WHEN content = '' THEN []::VARCHAR[]
                 ELSE string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS sl
                 FROM m_content""",
    "m_sents": "SELECT post, s_ix - 1 AS s_ix, sl[s_ix] AS sent FROM (SELECT post, sl, generate_subscripts(sl, 1) AS s_ix FROM m_sl)",
    "m_tl": r"""SELECT post, s_ix, sent, list_filter(string_split_regex(sent, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS tl
                FROM m_sents""",
    "m_toks": f"""SELECT post, s_ix, sent, pos - 1 AS pos, {_STRIPP} AS lt,
                   regexp_extract_all(lower(tok), '{vocab.VERSION_PATTERN}') AS vers
                 FROM (SELECT post, s_ix, sent, tl[pos] AS tok, pos FROM
                       (SELECT *, generate_subscripts(tl, 1) AS pos FROM m_tl))""",
    "m_cand": f"""
      SELECT t.post, t.s_ix, t.sent, t.pos, 'F' AS kind, 0 AS mi, t.lt AS name, f.vendor AS vendor0
      FROM m_toks t JOIN {vocab.sql_values('families')} f ON t.lt = f.token
      UNION ALL
      SELECT t.post, t.s_ix, t.sent, t.pos, 'T', 0, t.lt, r.vendor
      FROM m_toks t JOIN {vocab.sql_values('tiers')} r ON t.lt = r.token
      UNION ALL
      SELECT post, s_ix, sent, pos, 'V', mi - 1, vers[mi], NULL FROM
        (SELECT *, generate_subscripts(vers, 1) AS mi FROM m_toks WHERE len(vers) > 0)""",
    "m_win": """
      SELECT *,
        last_value(CASE WHEN kind = 'F' THEN {'pos': pos, 'name': name, 'vendor': vendor0} END IGNORE NULLS)
          OVER (PARTITION BY post, s_ix ORDER BY pos, mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pf,
        first_value(CASE WHEN kind = 'F' THEN {'pos': pos, 'name': name, 'vendor': vendor0} END IGNORE NULLS)
          OVER (PARTITION BY post, s_ix ORDER BY pos, mi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf,
        last_value(CASE WHEN kind = 'V' AND mi = 0 THEN {'pos': pos, 'name': name} END IGNORE NULLS)
          OVER (PARTITION BY post, s_ix ORDER BY pos, mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
        first_value(CASE WHEN kind = 'V' AND mi = 0 THEN {'pos': pos, 'name': name} END IGNORE NULLS)
          OVER (PARTITION BY post, s_ix ORDER BY pos, mi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
      FROM m_cand""",
    "m_near": f"""
      SELECT post, s_ix, sent, pos, kind, mi, name, vendor0,
        CASE WHEN abs(f.pos - pos) <= {M.WINDOW} THEN f END AS fam,
        CASE WHEN abs(v.pos - pos) <= {M.WINDOW} THEN v END AS ver
      FROM (SELECT *, CASE WHEN pf IS NOT NULL AND (nf IS NULL OR pos - pf.pos <= nf.pos - pos) THEN pf ELSE nf END AS f,
                      CASE WHEN pv IS NOT NULL AND (nv IS NULL OR pos - pv.pos <= nv.pos - pos) THEN pv ELSE nv END AS v
            FROM m_win)""",
    "m_vend": """
      SELECT *, CASE WHEN kind = 'T' THEN coalesce(fam.vendor, vendor0)
                     WHEN kind = 'V' THEN coalesce(fam.vendor, CASE WHEN starts_with(name, '4') OR starts_with(name, 'o')
                                                              THEN 'openai' WHEN starts_with(name, '3') THEN 'anthropic' END)
                     ELSE vendor0 END AS vendor,
                CASE WHEN kind = 'T' THEN ver.name WHEN kind = 'V' THEN name END AS version_raw,
                CASE WHEN kind = 'T' THEN name END AS tier
      FROM m_near""",
    "m_valid": f"""
      SELECT m.*, CASE WHEN m.kind = 'T' AND m.vendor IS NOT NULL AND m.version_raw IS NOT NULL AND v.vendor IS NULL
                       THEN NULL ELSE m.version_raw END AS version
      FROM m_vend m LEFT JOIN {vocab.sql_values('valid_combos')} v
        ON v.vendor IS NOT DISTINCT FROM m.vendor AND v.version IS NOT DISTINCT FROM m.version_raw
       AND v.tier IS NOT DISTINCT FROM m.tier""",
    "m_keep_v": """
      SELECT m.* FROM m_valid m WHERE NOT (m.kind = 'V' AND EXISTS (
        SELECT 1 FROM m_valid t WHERE t.post = m.post AND t.s_ix = m.s_ix AND t.kind = 'T' AND t.version = m.name))""",
    "m_keep": """
      SELECT m.* FROM m_keep_v m WHERE m.kind <> 'F' OR (
        m.pos = (SELECT min(f.pos) FROM m_keep_v f WHERE f.post = m.post AND f.s_ix = m.s_ix AND f.kind = 'F'
                 AND f.vendor = m.vendor)
        AND NOT EXISTS (SELECT 1 FROM m_keep_v u WHERE u.post = m.post AND u.s_ix = m.s_ix AND u.kind <> 'F'
                        AND u.vendor = m.vendor))""",
    "m_sent": f"""
      SELECT m.post, m.s_ix, CASE WHEN kind = 'T' THEN 1 WHEN kind = 'V' THEN 2 ELSE 3 END AS step, m.pos, m.mi,
             m.vendor, CASE WHEN kind = 'F' THEN m.name ELSE coalesce(m.fam.name, vf.family) END AS family,
             m.version, m.tier,
             CASE WHEN kind = 'F' THEN 'medium' WHEN m.fam IS NOT NULL AND m.version IS NOT NULL THEN 'high'
                  WHEN kind = 'V' AND m.fam IS NOT NULL THEN 'high'
                  WHEN m.fam IS NOT NULL OR m.vendor IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
             m.sent AS text
      FROM m_keep m LEFT JOIN {vocab.sql_values('vendor_family')} vf ON vf.vendor = m.vendor""",
    "m_vo": """SELECT post, s_ix, vendor, version, min({'step': step, 'pos': pos, 'mi': mi}) AS o, min(text) AS text
               FROM m_sent WHERE vendor IS NOT NULL AND version IS NOT NULL AND tier IS NULL GROUP BY ALL""",
    "m_to": """SELECT post, s_ix, vendor, tier, min({'step': step, 'pos': pos, 'mi': mi}) AS o, min(text) AS text
               FROM m_sent WHERE vendor IS NOT NULL AND tier IS NOT NULL AND version IS NULL GROUP BY ALL""",
    "m_pairs": f"""
      SELECT * FROM (
        SELECT a.post, a.s_ix, 0 AS pass, a.o AS o1, b.o AS o2, a.vendor, a.version, b.tier, a.text || ' ' || b.text AS text
        FROM m_vo a JOIN m_to b ON a.post = b.post AND a.vendor = b.vendor AND b.s_ix = a.s_ix + 1
        UNION ALL
        SELECT b.post, b.s_ix, 1, b.o, a.o, b.vendor, a.version, b.tier, b.text || ' ' || a.text
        FROM m_to b JOIN m_vo a ON a.post = b.post AND a.vendor = b.vendor AND a.s_ix = b.s_ix + 1) p
      WHERE EXISTS (SELECT 1 FROM {vocab.sql_values('valid_combos')} v
                    WHERE v.vendor = p.vendor AND v.version = p.version AND v.tier = p.tier)
        AND NOT EXISTS (SELECT 1 FROM m_sent e WHERE e.post = p.post AND e.vendor = p.vendor
                        AND e.version = p.version AND e.tier = p.tier)""",
    "m_comb": f"""
      SELECT post, k.s_ix AS s_ix, 4 AS step, k.pass AS pos, 0 AS mi, vendor, coalesce(vf.family, vendor) AS family,
             version, tier, 'high' AS confidence, k.text AS text, TRUE AS is_combined, k.o1 AS o1, k.o2 AS o2
      FROM (SELECT post, vendor, version, tier,
                   min({{'s_ix': s_ix, 'pass': pass, 'o1': o1, 'o2': o2, 'text': text}}) AS k
            FROM m_pairs GROUP BY ALL) c
      LEFT JOIN {vocab.sql_values('vendor_family')} vf USING (vendor)""",
    "m_all": """
      SELECT post, s_ix, step, pos, mi, vendor, family, version, tier, confidence, text, FALSE AS is_combined,
             NULL AS o1, NULL AS o2 FROM m_sent
      UNION ALL SELECT * FROM m_comb""",
}

_CAP = "(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"
_SQL_LABEL = f"""CASE
  WHEN vendor = 'anthropic' THEN CASE
    WHEN version IS NOT NULL AND tier IS NOT NULL THEN CASE
      WHEN regexp_full_match(replace(version, '.', ''), '[0-9]+') THEN 'Claude ' || {_CAP.format(x='version')} || ' ' || {_CAP.format(x='tier')}
      ELSE 'Claude ' || upper(version) || ' ' || {_CAP.format(x='tier')} END
    WHEN tier IS NOT NULL THEN 'Claude ' || {_CAP.format(x='tier')}
    WHEN version IS NOT NULL THEN CASE WHEN starts_with(version, 'o') THEN 'Claude ' || upper(version) ELSE 'Claude ' || version END
    ELSE 'Claude' END
  WHEN vendor = 'openai' THEN CASE WHEN version IS NOT NULL THEN
      CASE WHEN starts_with(version, 'o') THEN upper(version) ELSE 'GPT-' || version END ELSE 'OpenAI' END
  ELSE CASE WHEN tier IS NOT NULL THEN {_CAP.format(x='tier')} WHEN vendor IS NOT NULL THEN {_CAP.format(x='vendor')}
            ELSE 'Unknown' END END"""
_MCTE["m_best"] = f"""
  SELECT post, arg_min(label, {{'r': r, 'c': is_combined, 's': s_ix, 'st': step, 'p': pos, 'mi': mi, 'o1': o1, 'o2': o2}})
         AS model_label
  FROM (SELECT *, {_SQL_LABEL} AS label,
               CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS r FROM m_all)
  WHERE label <> 'Unknown' GROUP BY post"""


def _sql(body: str) -> str:
    return with_views(body, "posts", extra=_MCTE)


# ----------------------------------------------------------------- queries
def _posts(spark, sf):
    return posts(spark, sf).select("id", "title", "selftext")


@query("product_version", with_views(_SQL_PV.strip(), "posts"))
def product_version(spark, sf):
    p = _posts(spark, sf)
    return p.select("id", M.product_version(F.concat_ws(" ", "title", "selftext")).alias("claude_version"))


@query("sentences", _sql("""
SELECT post AS id, CAST(len(sl) AS BIGINT) AS n_sentences, md5(array_to_string(sl, chr(1))) AS sentences_md5 FROM m_sl"""))
def sentences_q(spark, sf):
    """X2 over the whole post content: how many sentences, and the digest of their texts."""
    p = _posts(spark, sf)
    s = p.select("id", X.sentences(M._content(F.col("title"), F.col("selftext"))).alias("s"))
    return s.select("id", F.size("s").cast("long").alias("n_sentences"),
                    F.md5(F.array_join("s", "\x01").cast("binary")).alias("sentences_md5"))


@query("strip_punct_tokens", _sql("""
SELECT post AS id, count(*) AS n_tokens, count(*) FILTER (WHERE lt = '') AS n_punct_only,
       md5(string_agg(lt, ' ' ORDER BY s_ix, pos)) AS tokens_md5 FROM m_toks GROUP BY post"""))
def strip_punct_tokens(spark, sf):
    """Whitespace tokens per post, how many are punctuation only, and the digest of all."""
    sents = X.sentences(M._content(F.col("title"), F.col("selftext")))
    toks = F.flatten(F.transform(sents, lambda s: F.filter(F.split(s, M.WS), lambda x: x != "")))
    t = _posts(spark, sf).select("id", F.transform(toks, X.strip_punct_lower).alias("t")).where(F.size("t") > 0)
    return t.select("id", F.size("t").cast("long").alias("n_tokens"),
                    F.size(F.filter("t", lambda x: x == "")).cast("long").alias("n_punct_only"),
                    F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def _anchors(spark, sf):
    return M.sentence_anchors(_posts(spark, sf), "id", "title", "selftext")


@query("version_tokens", _sql("SELECT post, s_ix, pos, mi, name AS version FROM m_cand WHERE kind = 'V'"))
def version_tokens_q(spark, sf):
    """Version matches inside whitespace tokens, with token index."""
    c = _anchors(spark, sf).select("post", "s_ix", F.inline("cands"))
    return c.select("post", "s_ix", "pos", F.posexplode("t.vers").alias("mi", "version"))


@query("nearest_anchor", _sql("""
SELECT post, s_ix, pos, mi, kind, fam.pos AS fam_pos, fam.name AS fam_token, ver.pos AS ver_pos, ver.name AS ver_name
FROM m_near WHERE kind IN ('T', 'V')"""))
def nearest_anchor(spark, sf):
    """Nearest family (and nearest version) within 12 tokens, ties to the left."""
    a = _anchors(spark, sf)
    toks = F.col("toks")
    c = F.transform("cands", lambda c: F.struct(c["pos"].alias("pos"), c["t"].alias("t"), c["fp"].alias("fam_pos"),
                                                M._nearest(toks, c["pos"], M._has_version).alias("ver_pos")))
    named = F.transform(c, lambda c: F.struct(
        c["pos"].alias("pos"), c["t"].alias("t"), c["fam_pos"].alias("fam_pos"),
        F.get(toks, c["fam_pos"])["lt"].alias("fam_token"), c["ver_pos"].alias("ver_pos"),
        F.get(F.get(toks, c["ver_pos"])["vers"], F.lit(0)).alias("ver_name")))
    kinds = F.concat(F.when(F.col("t.tier").isNotNull(), F.array(F.struct(F.lit("T").alias("kind"), F.lit(0).alias("mi"))))
                     .otherwise(F.expr("cast(array() as array<struct<kind:string,mi:int>>)")),
                     F.transform("t.vers", lambda v, i: F.struct(F.lit("V").alias("kind"), i.alias("mi"))))
    rows = a.select("post", "s_ix", F.inline(named))
    return rows.select("post", "s_ix", "pos", "fam_pos", "fam_token", "ver_pos", "ver_name", F.inline(kinds))


_MCOLS = ["post", "s_ix", "step", "pos", "mi", "vendor", "family", "version", "tier", "confidence", "text"]


@query("valid_combo", _sql("SELECT post, s_ix, pos, vendor, version_raw, tier, version FROM m_valid WHERE kind = 'T'"))
def valid_combo(spark, sf):
    """Tier mentions; a version outside the valid matrix is dropped."""
    a = _anchors(spark, sf)
    toks = F.col("toks")
    t = F.transform(F.filter("cands", lambda c: c["t"]["tier"].isNotNull()), lambda c: M.let(
        M._tier_mention(toks, c), lambda m: F.struct(
            m["pos"].alias("pos"), m["vendor"].alias("vendor"),
            F.get(F.get(toks, c["vp"])["vers"], F.lit(0)).alias("version_raw"), m["tier"].alias("tier"),
            m["version"].alias("version"))))
    return a.select("post", "s_ix", F.inline(t))


@query("adjacent_sentence_pairs", _sql("""
SELECT post, s_ix, pos AS pass, vendor, family, version, tier, text FROM m_comb"""))
def adjacent_sentence_pairs(spark, sf):
    m = M.model_mentions(_posts(spark, sf), "id", "title", "selftext")
    return m.where("is_combined").select("post", "s_ix", F.col("pos").alias("pass"), "vendor", "family", "version", "tier",
                                         "text")


@query("model_mentions", _sql(f"SELECT {', '.join(_MCOLS)}, is_combined FROM m_all"))
def model_mentions(spark, sf):
    return M.model_mentions(_posts(spark, sf), "id", "title", "selftext").select(*_MCOLS, "is_combined")


@query("label_format", _sql(f"SELECT post, s_ix, step, pos, mi, {_SQL_LABEL} AS label FROM m_all"))
def label_format(spark, sf):
    m = M.model_mentions(_posts(spark, sf), "id", "title", "selftext")
    return m.select("post", "s_ix", "step", "pos", "mi",
                    M.mention_label(F.col("vendor"), F.col("version"), F.col("tier")).alias("label"))


@query("best_model_label", _sql("SELECT post, model_label FROM m_best"))
def best_model_label(spark, sf):
    label = M.best_model_label(F.col("title"), F.col("selftext"))
    return _posts(spark, sf).select(F.col("id").alias("post"), label.alias("model_label")).where("model_label is not null")


def labelled_posts(spark, sf):
    """Posts with claude_version (T3) and model_label (T5) columns."""
    return posts(spark, sf).withColumns({
        "claude_version": M.product_version(F.concat_ws(" ", "title", "selftext")),
        "model_label": M.best_model_label(F.col("title"), F.col("selftext"))})


_SQL_LABELLED = f"""
  SELECT p.*, v.claude_version, b.model_label FROM posts p
  JOIN ({_SQL_PV}) v ON v.id = p.id LEFT JOIN m_best b ON b.post = p.id"""


@query("version_or_label", _sql(f"""
SELECT id, coalesce(nullif(claude_version, ''), nullif(model_label, ''), 'N/A') AS version_display
FROM ({_SQL_LABELLED})"""))
def version_or_label(spark, sf):
    lp = labelled_posts(spark, sf)
    return lp.select("id", X.version_or_label("claude_version", "model_label").alias("version_display"))


COLLECTED_AT = "2024-02-01T00:00:00Z"


@query("normalize_posts", _sql(f"""
SELECT id, title, source, coalesce(subreddit, source) AS subreddit, score, author, created_epoch, claude_version,
       model_label, '{COLLECTED_AT}' AS collected_at FROM ({_SQL_LABELLED})"""))
def normalize_posts(spark, sf):
    """S3: the common post record: subreddit falls back to the source name;
    version, best label and a collection time passed in as a parameter."""
    lp = labelled_posts(spark, sf)
    return lp.select("id", "title", "source", F.coalesce("subreddit", "source").alias("subreddit"), "score", "author",
                     "created_epoch", "claude_version", "model_label", F.lit(COLLECTED_AT).alias("collected_at"))
