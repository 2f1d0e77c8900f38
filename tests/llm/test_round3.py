"""Personal data, ranked lexical search and the Merkle manifest against plain versions on
a fixture with nulls, empty and very long texts, ties, repeated rows, repeated and null ids
and extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import lexical_search, merkle, pii
from tests.oracle import compare, duck

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, spans string, leaf string, pos long, n long, "
          "tree string, path string, score long, query int, item_id long, rank int, kind string, base boolean, root string")
EXTRA = ("s", "l", 1, 2, "t", "p", 3, 4, 5, 6, "k", True, "r")


def _rows():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    def line(n):
        return " ".join(rng.choice(words) for _ in range(n))
    out = [(i * 11 % 400, line(rng.randint(1, 40)).title() if i % 3 else line(30), ["en", None, "fr"][i % 3],
            "hot" if i % 2 else [None, "", "a", "ü", "z"][i // 2 % 5], i) for i in range(380)]
    t = out[5][1]
    out += [(None, t, "en", "hot", 1), (None, t, "en", "hot", 1), (None, "Other", None, None, None), (9, t, "en", "hot", 1),
            (9, t, "en", "hot", 1), (9, "A different Text", "en", "hot", 2), (1000, None, None, "a", None),
            (1001, "", "en", "a", 0), (1002, "  \n\t ", "en", "a", 4), (1003, line(30_000), "en", "a", 1),
            (1004, "tel +1 (222) 333-4444, mail Jo.e@ex-a.mple.com; ip 10.0.0.255 card 4111 1111 1111 1111 é", "en", "lone", 1),
            (-5, "é" * 500 + " x@y.z +49 151 12345678 DE89 3704 0044 0532 0130 00", "de", "lone2", 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------------ 11
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if c.isdigit()]
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0,
                  "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_against_plain_patterns(spark, docs, rows, empty):
    rng = random.Random(3)
    made = [(10_000 + i, "".join(rng.choice(a) for _ in range(rng.randint(0, 80))))
            for i, a in enumerate(["ab@.-+ 12é", "0123456789 -", "0123456789.", "+0123456789 ().-", "a1@.b%_é@", "1.2.9"] * 300)]
    df = docs.select("doc_id", "text", "spans", "kind").union(
        spark.createDataFrame([(i, t, "s", "k") for i, t in made], "doc_id long, text string, spans string, kind string"))
    want = []
    for i, t in [(r[0], r[1]) for r in rows] + made:
        s = plain_spans(t)
        n = Counter(x[3] for x in s)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want.append((str(i), n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest()))
    got = pii.op11(df).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert sum(r.n_card for r in got) > 20 and sum(r.n_ip for r in got) > 20
    full = {r.doc_id: r.spans for r in pii.find_pii(df.where("doc_id in (1004, -5)")).collect()}
    for r in got:
        if r.doc_id in (1004, -5):
            assert r.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in full[r.doc_id])
    assert "iban:523:550" in {r.doc_id: r.spans for r in got}[-5]
    assert pii.op11(empty).count() == 0 and pii.find_pii(empty).count() == 0


@pytest.mark.parametrize("text, want", [
    ("iban GB82 WEST 1234 5698 7654 32.", ["iban"]),
    ("GB82WEST12345698765433", []),                                   # wrong check digits
    ("xGB82WEST12345698765432", []),                                  # inside a longer word
    ("visa 4111111111111111 4111111111111112", ["card"]),             # 32 digits: one group passes
    ("4111111111111111 4111111111111112", []),                        # no word near
    ("order visa 4111111111111111 4111111111111112", []),             # a word against it
    ("discard 4111111111111111 4111111111111112", []),                # part of a word does not count
    ("Téléphone: (415) 555-1234", ["phone"]),
    ("(415) 555-1234", []),
    ("ssn 123-45-6789, ssn 000-45-6789, ssn 912-45-6789", ["ssn"]),
    ("version 1.2.3.4", ["ip"]),                                      # base spans stay
])
def test_pii_checksums_and_context(text, want):
    assert [s.kind for s in pii.spans_of(text.encode())] == want


def test_pii_scores_and_redaction(spark):
    ip = [pii.spans_of(t)[0].score for t in (b"host 1.2.3.4", b"1.2.3.4", b"version 1.2.3.4")]
    assert ip[0] > ip[1] > ip[2] and ip[1] >= pii.MIN_SCORE > ip[2]
    df = spark.createDataFrame([(1, "é a@b.c, +1 222 333 4444; version 1.2.3.4", "k"), (2, None, "k"), (None, "", None)],
                               "doc_id long, text string, kind string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "é [email], [phone]; version 1.2.3.4", 2: None, None: ""}


def test_pii_is_linear_in_the_text():
    for t in ["1" * 400_000, "a." * 200_000 + "@", "1." * 200_000, "+1" * 200_000, "AA11" * 100_000, "1 " * 200_000]:
        assert len(pii.spans_of(t.encode())) <= 200_000  # would not end in quadratic time


# ------------------------------------------------------------------------ 12
def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranking(rows, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_all, l_all = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(str(item), r + 1, str(None if z else i), -s) for r, (s, z, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("segment, query_bytes, block", [(8 << 20, 2 << 20, 256), (3000, 700, 4)])
def test_lexical_search_against_plain_ranking(spark, docs, rows, empty, monkeypatch, segment, query_bytes, block):
    monkeypatch.setattr(lexical_search, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(lexical_search, "DOC_BLOCK", block)
    monkeypatch.setattr(lexical_search, "PIECE", 2000)
    texts = [(i, r[1]) for i, r in enumerate(rows) if i % 25 == 0]
    items = [*texts, (3, rows[5][1]), (3, rows[5][1]), (None, "Different OTHER"), (70, None), (71, ""), (72, " ,. "),
             (73, "nowhere-to-be-found"), (74, rows[389][1])]
    df = spark.createDataFrame([(i, t, 0, "d") for i, t in items], "item_id long, text string, score long, doc_id string")
    got = lexical_search.search(docs, df, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in got.collect())
    assert got == plain_ranking([(r[0], r[1]) for r in rows], items)
    assert lexical_search.search(empty, df).count() == 0 and lexical_search.search(docs, df.limit(0)).count() == 0
    assert lexical_search.search(docs.where("text is null"), df).count() == 0


def test_lexical_search_skips_blocks():
    """Pruning leaves blocks out, and the result stays exact (see above)."""
    rng = np.random.default_rng(1)
    n = 4096
    tf = np.ones(n, np.int64)
    tf[100:110] = 50
    rare = np.sort(rng.choice(n, 20, replace=False))
    packed = lexical_search._pack([np.arange(n), np.zeros(n), np.full(n, 60), np.array([0, 1]), np.array([n, 20]),
                                   np.concatenate((np.diff(np.arange(n), prepend=0), np.diff(rare, prepend=0))),
                                   np.concatenate((tf, np.ones(20, np.int64)))])
    seg = lexical_search.Segment(packed, np.array([10, 9000]), n, 60 * n)
    seen, block = [], seg._block
    seg._block = lambda b, *a: (seen.append(b), block(b, *a))
    top = lexical_search.Top(10)
    seg.search(np.array([0, 1]), top)
    assert len(seen) < seg.n_blocks and set(top.rows[2].tolist()) <= set(rare.tolist())


# ------------------------------------------------------------------------ 13
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, arity):
    """(root, proof level by level of each node)."""
    proofs = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // arity * arity
            proofs[i].append((level[run:a], level[a + 1:run + arity]))
        level = [H(*level[i:i + arity]) for i in range(0, len(level), arity)]
        at = [a // arity for a in at]
    return level[0], proofs


def plain_manifest(rows, arity=16):
    def leaf(r, text):
        return H(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(text))
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        trees[s].sort(key=lambda x: x[:3])
        subs.append(plain_tree([x[2] for x in trees[s]], arity))
    root, top = plain_tree([x[0] for x in subs], arity)
    out = []
    for s, (sub, proofs), up in zip(order, subs, top):
        for (_, _, own, r), proof in zip(trees[s], proofs):
            proof = proof + up
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for a, b in proof:
                node = H(*a, node, *b)
            out.append((str(r[0]), own, sub, root, H(*(x for a, b in proof for x in [*a, *b])), node, node == root))
    return sorted(out)


def collected(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_merkle_against_plain_tree(docs, rows, empty):
    got = collected(merkle.op13(docs))
    assert got == plain_manifest(rows)
    assert {x[-1] for x in got} == {True, False}
    assert merkle.op13(empty).count() == 0


def test_merkle_single_leaf_and_many_levels(spark, rows):
    """One leaf in all; and a binary tree of nine levels, stored every third."""
    def frame(rs):
        return spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long")
    assert collected(merkle.op13(frame(rows[:1]))) == plain_manifest(rows[:1])
    tampered = merkle.manifest(frame(rows), F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                               F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text")),
                               stride=3, arity=2)
    assert collected(tampered) == plain_manifest(rows, 2)
    assert all(r.verified for r in merkle.manifest(frame(rows[:40])).collect())


def test_merkle_sql_on_nulls_and_repeated_rows(spark, rows, tmp_path):
    """The registered SQL gives the same rows on the fixture."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(cols)}), tmp_path / "documents.parquet")
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert compare(spark, merkle.op13(df), duck(str(tmp_path)), merkle.OP13_SQL) == len(rows)
