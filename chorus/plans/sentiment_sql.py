"""DuckDB SQL for T1 (oracle side), the same rules as
:mod:`chorus.operators.sentiment`. Input CTE ``sent_in(sid, text)``; output
CTE ``sent_out(sid, compound, positive, neutral, negative)``."""

from __future__ import annotations

from chorus import vocab
from chorus.plans.common import sql_in_list
from chorus.vocab import sql_literal

P = r"[!-/:-@\[-`{-~]"
UPPER = "(upper({x}) = {x} AND lower({x}) <> {x})"


def _up(x: str) -> str:
    return UPPER.format(x=x)


def _booster(p: str) -> str:
    return (f"(CASE WHEN {p} IN {sql_in_list(vocab.BOOSTERS_UP)} THEN {vocab.BOOST_INCR} "
            f"WHEN {p} IN {sql_in_list(vocab.BOOSTERS_DOWN)} THEN {vocab.BOOST_DECR} ELSE 0.0 END)")


def _neg(p: str) -> str:
    return f"coalesce({p} IN {sql_in_list(vocab.NEGATIONS)} OR contains({p}, 'n''t'), FALSE)"


def sentiment_ctes(lexicon_sql: str | None = None) -> dict[str, str]:
    lex = lexicon_sql or vocab.sql_values("lexicon")
    n_s = vocab.NEGATION_SCALAR
    c_i = vocab.CAPS_INCR
    ctes: dict[str, str] = {}
    ctes["lex"] = f"SELECT lower(token) AS token, max(valence) AS valence FROM {lex} GROUP BY 1"
    ctes["s_words"] = f"""
  SELECT sid, coalesce(text, '') AS raw,
         list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda t: t <> ''),
           lambda t: CASE WHEN length(regexp_replace(t, '^{P}+|{P}+$', '', 'g')) <= 2 THEN t
                          ELSE regexp_replace(t, '^{P}+|{P}+$', '', 'g') END) AS w
  FROM sent_in"""
    qm = "(length(raw) - length(replace(raw, '?', '')))"
    ctes["s_prep"] = f"""
  SELECT sid, w, list_transform(w, lambda x: lower(x)) AS lw, len(w) AS n,
         (len(list_filter(w, lambda x: {_up('x')})) > 0 AND len(list_filter(w, lambda x: NOT {_up('x')})) > 0) AS cap_diff,
         coalesce(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) - 1 AS bi,
         regexp_full_match(raw, '\\s*') AS blank,
         least(length(raw) - length(replace(raw, '!', '')), 4) * 0.292
           + CASE WHEN {qm} > 3 THEN 0.96 WHEN {qm} > 1 THEN {qm} * 0.18 ELSE 0.0 END AS amp
  FROM s_words"""

    def at(a: str, off: str) -> str:
        # 0-based position i + off of list a, NULL when out of range
        return f"CASE WHEN i + {off} >= 0 AND i + {off} < n THEN {a}[i + {off} + 1] END"

    ctes["s_tok"] = f"""
  SELECT sid, n, cap_diff, bi, i, lw[i + 1] AS tok, {_up('w[i + 1]')} AS up,
         {at('lw', '-1')} AS p1, {at('lw', '-2')} AS p2, {at('lw', '-3')} AS p3, {at('lw', '1')} AS n1, {at('lw', '2')} AS n2,
         coalesce({_up(at('w', '-1'))}, FALSE) AS p1up, coalesce({_up(at('w', '-2'))}, FALSE) AS p2up,
         coalesce({_up(at('w', '-3'))}, FALSE) AS p3up
  FROM (SELECT *, unnest(range(0, n)) AS i FROM s_prep)"""
    ctes["s_hit"] = """
  SELECT t.*, x.valence AS v0,
         l1.token IS NOT NULL AS in1, l2.token IS NOT NULL AS in2, l3.token IS NOT NULL AS in3,
         ln.token IS NOT NULL AS inn
  FROM s_tok t JOIN lex x ON t.tok = x.token
  LEFT JOIN lex l1 ON t.p1 = l1.token LEFT JOIN lex l2 ON t.p2 = l2.token
  LEFT JOIN lex l3 ON t.p3 = l3.token LEFT JOIN lex ln ON t.n1 = ln.token"""
    ctes["s_v1"] = f"""
  SELECT *, CASE WHEN coalesce(p1 = 'no' OR p2 = 'no' OR (p3 = 'no' AND p1 IN ('or', 'nor')), FALSE) THEN v0 * {n_s}
                 WHEN tok = 'no' AND inn THEN 0.0 ELSE v0 END AS va FROM s_hit"""
    ctes["s_v2"] = f"""
  SELECT *, CASE WHEN up AND cap_diff THEN (CASE WHEN va > 0 THEN va + {c_i} ELSE va - {c_i} END) ELSE va END AS vb
  FROM s_v1"""
    prev, cur = "vb", None
    steps = [("p1", "in1", "p1up", 1.0), ("p2", "in2", "p2up", 0.95), ("p3", "in3", "p3up", 0.9)]
    for k, (p, inp, pup, damp) in enumerate(steps):
        cur = f"vk{k}"
        b = _booster(p)
        s = f"(CASE WHEN {prev} < 0 THEN -{b} ELSE {b} END)"
        s = (f"(CASE WHEN {b} <> 0 AND {pup} AND cap_diff THEN "
             f"(CASE WHEN {prev} > 0 THEN {s} + {c_i} ELSE {s} - {c_i} END) ELSE {s} END)")
        if damp != 1.0:
            s = f"({s} * {damp})"
        nv = f"({prev} + {s})"
        if k == 0:
            nv = f"(CASE WHEN {_neg('p1')} THEN {nv} * {n_s} ELSE {nv} END)"
        elif k == 1:
            nv = (f"(CASE WHEN p2 = 'never' AND p1 IN ('so', 'this') THEN {nv} * 1.25 "
                  f"WHEN p2 = 'without' AND p1 = 'doubt' THEN {nv} "
                  f"WHEN {_neg('p2')} THEN {nv} * {n_s} ELSE {nv} END)")
        else:
            nv = (f"(CASE WHEN (p3 = 'never' AND p2 IN ('so', 'this')) OR p1 IN ('so', 'this') THEN {nv} * 1.25 "
                  f"WHEN p3 = 'without' AND (p2 = 'doubt' OR p1 = 'doubt') THEN {nv} "
                  f"WHEN {_neg('p3')} THEN {nv} * {n_s} ELSE {nv} END)")
        src = "s_v2" if k == 0 else f"s_k{k - 1}"
        ctes[f"s_k{k}"] = f"""
  SELECT *, CASE WHEN {p} IS NOT NULL AND NOT {inp} THEN {nv} ELSE {prev} END AS {cur} FROM {src}"""
        prev = cur
    idioms, boosts = ("MAP {" + ", ".join(f"{sql_literal(k)}: CAST({x} AS DOUBLE)" for k, x in t) + "}"
                      for t in (vocab.IDIOMS, vocab.BOOSTERS_TWO_WORDS))
    around = ", ".join(f"({idioms})[{' || chr(32) || '.join(ws)}]" for ws in (
        ("tok", "n1", "n2"), ("tok", "n1"), ("p1", "tok"), ("p2", "p1", "tok"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2")))
    two = " + ".join(f"coalesce(({boosts})[{a} || chr(32) || {b}], 0.0)" for a, b in (("p3", "p2"), ("p2", "p1")))
    ctes["s_idiom"] = f"""
  SELECT *, CASE WHEN p3 IS NOT NULL AND NOT in3 THEN coalesce({around}, {prev}) + {two} ELSE {prev} END AS vi FROM s_k2"""
    prev = "vi"
    ctes["s_v3"] = f"""
  SELECT sid, i, tok, n1, bi, CASE
      WHEN i > 1 AND p1 = 'least' AND NOT in1 THEN (CASE WHEN p2 <> 'at' AND p2 <> 'very' THEN {prev} * {n_s} ELSE {prev} END)
      WHEN i > 0 AND p1 = 'least' AND NOT in1 THEN {prev} * {n_s}
      ELSE {prev} END AS vl FROM s_idiom"""
    ctes["s_v4"] = f"""
  SELECT sid, CASE WHEN tok IN {sql_in_list(vocab.BOOSTERS_UP + vocab.BOOSTERS_DOWN)} THEN 0.0
                   WHEN tok = 'kind' AND n1 = 'of' THEN 0.0
                   WHEN bi >= 0 AND i < bi THEN vl * 0.5 WHEN bi >= 0 AND i > bi THEN vl * 1.5
                   ELSE vl END AS v FROM s_v3"""
    ctes["s_agg"] = """
  SELECT sid, sum(v) AS sum_v, sum(CASE WHEN v > 0 THEN v + 1 END) AS pos_sum,
         sum(CASE WHEN v < 0 THEN v - 1 END) AS neg_sum, count(CASE WHEN v <> 0 THEN 1 END) AS nz
  FROM s_v4 GROUP BY sid"""
    ctes["s_fin"] = """
  SELECT p.sid, p.n, p.amp, p.blank, coalesce(a.sum_v, 0.0) AS sum_v, coalesce(a.pos_sum, 0.0) AS pos_sum,
         coalesce(a.neg_sum, 0.0) AS neg_sum, coalesce(a.nz, 0) AS nz
  FROM s_prep p LEFT JOIN s_agg a ON p.sid = a.sid"""
    ctes["s_fin2"] = f"""
  SELECT sid, blank, n, nz,
         CASE WHEN sum_v > 0 THEN sum_v + amp WHEN sum_v < 0 THEN sum_v - amp ELSE sum_v END AS s,
         CASE WHEN pos_sum > abs(neg_sum) THEN pos_sum + amp ELSE pos_sum END AS ps,
         CASE WHEN pos_sum < abs(neg_sum) THEN neg_sum - amp ELSE neg_sum END AS ns
  FROM s_fin"""
    ctes["sent_out"] = f"""
  SELECT sid,
    CASE WHEN blank THEN 0.0 ELSE round(greatest(-1.0, least(1.0, s / sqrt(s * s + {vocab.NORMALIZE_ALPHA}))), 4) END AS compound,
    CASE WHEN blank THEN 0.0 ELSE round(abs(ps / (ps + abs(ns) + (n - nz))), 3) END AS positive,
    CASE WHEN blank THEN 1.0 ELSE round(abs((n - nz) / (ps + abs(ns) + (n - nz))), 3) END AS neutral,
    CASE WHEN blank THEN 0.0 ELSE round(abs(ns / (ps + abs(ns) + (n - nz))), 3) END AS negative
  FROM s_fin2"""
    return ctes
