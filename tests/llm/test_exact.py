"""Exact brute force of the operators without SQL, repeated and null ids, texts above one piece,
and the pipeline's stages on empty tables, nulls, repeated rows and clashing names."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chorus.llm import decontamination, fingerprints, language_id, line_dedup, substring_dedup
from tests.llm.test_llm import ws


# ------------------------------------------------------------------ 1 and 4: ids that do not tell rows apart
def words(tag, n=25):
    return " ".join(f"{tag}{i}" for i in range(n))


def in_order(rows):
    """(id, text) documents in the order in which they are judged: id, null last, text digest."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    return docs


ROWS = [
    [(1, words("a")), (None, words("a")), (None, words("b")), (7, words("a")), (7, words("c"))],
    [(None, words("a") + " " + words("x", 5)), (None, words("a") + " " + words("y", 5)), (None, words("a")), (None, words("a"))],
    [(3, words("a")), (3, words("a")), (3, words("b", 30)), (2**63 - 1, words("a")), (None, words("b", 30)), (None, None), (3, "")],
    [(5, words("a")), (5, words("b")), (4, words("b")), (6, "short"), (6, "short")],
]


@pytest.mark.parametrize("rows", ROWS)
def test_substring_dedup_repeated_and_null_ids(spark, rows):
    first, want = {}, {}
    for i, t in in_order(rows):
        w = t.split()
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s:s + 20]), (i, t, s))
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] != (i, t, s) for k in range(s, s + 20)}
        want[i, t] = " ".join(x for k, x in enumerate(w) if k not in gone)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.substring_dedup(df, 20).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.kept_text) for r in got), key=key) == sorted(((i, want[i, t or ""]) for i, t in rows), key=key)


@pytest.mark.parametrize("rows", ROWS)
def test_line_dedup_repeated_and_null_ids(spark, rows):
    sets, want = [], {}
    for i, t in in_order(rows):
        s = set(t.split())
        want[i, t] = "" if s and any(5 * len(s & y) >= 4 * len(s | y) for y in sets) else t
        sets += [s] if s else []
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.kept_text) for r in line_dedup.line_dedup(df).collect()), key=key)
    assert got == sorted(((i, want[i, t or ""]) for i, t in rows), key=key)


def test_substring_dedup_above_one_piece(spark, monkeypatch):
    """A text longer than a piece, and windows on both sides of a full chunk."""
    rng = random.Random(8)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(9000)) for _ in range(800_000))
    assert len(long) > 4 << 20
    w = long.split()
    copy = " ".join(w[300_000:300_400])
    monkeypatch.setattr(substring_dedup, "CHUNK_WINDOWS", 1000)
    rows = [(1, long), (2, "start " + copy + " end"), (3, words("q", 30)), (4, words("q", 30))]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert (got[1].n_words, got[1].n_removed) == (800_000, 0)
    assert got[2].kept_text == "start end" and got[2].n_removed == 400 and got[4].n_removed == 30


# ------------------------------------------------------------------ 2
def plain_signature(text, k, seed):
    """Every sample by its definition, a term at a time."""
    n = Counter((text or "").encode().split())
    if not n:
        return "0" * 4 * k
    mask, f = (1 << 64) - 1, np.float32

    def uniform(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        x ^= x >> 31
        return ((x >> 11) + 0.5) / (1 << 53)
    out = []
    for j in range(k):
        best = None
        for term in sorted(n):
            code = xxhash.xxh64_intdigest(term, seed)
            u = [uniform((code + (p * k + j) * 0x9E3779B97F4A7C15) & mask) for p in range(5)]
            r, b, ln_c = -np.log(u[0] * u[1]), u[4], np.log(-np.log(u[2] * u[3]))
            if n[term] == 1:
                t, ln_a = 0, f(ln_c + r * b - r)
            else:
                r, b, ln_c = f(r), f(b), f(ln_c)
                q = np.floor(f(np.log(float(n[term]))) / r + b)
                t, ln_a = int(q), ln_c - r * (q - b) - r
            if best is None or ln_a < best[0]:
                best = (ln_a, code, t)
        x = (best[1] + best[2] * 0xA24BAED4963EE407 + j) & mask
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & mask
        out.append(f"{((x ^ (x >> 33)) >> 20) & 0xFFFF:04x}")
    return "".join(out)


@pytest.mark.parametrize("block_bytes", [fingerprints.BLOCK_BYTES, 300])  # one run of neighbours, many
def test_weighted_fingerprints_by_definition(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", block_bytes)
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(["ab", "cé", "d", "ee", "f"]) + str(rng.randrange(6)) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 60))) for i in range(24)] + [(100, None), (101, ""), (102, "one"), (103, "é" * 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ends = fingerprints.run_ends(df.withColumn("id", F.col("doc_id")))
    assert (len(ends) > 3) == (block_bytes == 300)
    got = {r.doc_id: r for r in fingerprints.op2(df).collect()}
    order = sorted(rows, reverse=True)
    alike = lambda a, b: sum(a[p:p + 4] == b[p:p + 4] for p in range(0, 256, 4)) / 64
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + u[:half]
        a, b, c = (plain_signature(x, 64, fingerprints.SEED) for x in (t, edited, u))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (a, b)
        assert got[i].near_edited == (alike(a, b) if bool(t.split()) == bool(edited.split()) else 0.0)
        assert got[i].near_next == (alike(a, c) if bool(t.split()) == bool(u.split()) else 0.0)


# ------------------------------------------------------------------ 5
def plain_language(references, text):
    """Phrases per language by search in the reference itself, block by block."""
    out = {}
    for lang, ref in references.items():
        fold = lambda s: "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0" for c in s)
        r, t, phrases = fold(ref), fold(text), 0
        for b in range(0, len(t), language_id.BLOCK):
            block, i = t[b:b + language_id.BLOCK], 0
            while i < len(block):
                n = 1
                while i + n <= len(block) and block[i:i + n] in r:
                    n += 1
                i += max(1, n - 1)
                phrases += 1
        out[lang] = phrases * math.log2(max(2, len(ref)))
    return out


def made_language(rng, letters, n):
    vocab = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(60)]
    return lambda k=n: " ".join(rng.choice(vocab) for _ in range(k))


@pytest.mark.parametrize("table_bytes", [1 << 30, 0])  # dense tables, sorted edges
def test_language_of_many_scripts(table_bytes):
    """Languages without a common letter, one with far more letters than a dense table holds, and
    four with one alphabet: costs equal those of a plain search, and texts are told apart."""
    rng = random.Random(6)
    latin = "abcdefghijklmnopqrstuvwxyzäöü"
    makers = {"aa": made_language(rng, latin, 40), "bb": made_language(rng, latin, 40),
              "cyr": made_language(rng, [chr(0x430 + i) for i in range(32)], 40),
              "x1": made_language(rng, [chr(0x4E00 + i) for i in range(20)], 40),
              "x2": made_language(rng, [chr(0x5000 + i) for i in range(20)], 40),   # 512 code points apart
              "wide": made_language(rng, [chr(0xAC00 + 7 * i) for i in range(400)], 40)}
    references = {k: "\n".join(m(60) for _ in range(10)) for k, m in makers.items()}
    model = language_id.Model(references, table_bytes)
    names = list(model.references)
    texts = [(k, m()) for k, m in makers.items() for _ in range(20)]
    texts += [("", "Ab ABÄ, я 一 " + makers["aa"](3).upper()), ("", "123 !"), ("", ""), ("", makers["wide"](200))]
    raw = [t.encode() for _, t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    best, score = model.predict(np.frombuffer(b"".join(raw), np.uint8), offs)
    right = 0
    for (lang, t), b, s in zip(texts, best, score):
        if not any(c.isalpha() for c in t):
            assert b == -1 and s == 0
            continue
        cost = plain_language(references, t)
        low = sorted(cost.values())
        assert names[b] == min(sorted(cost), key=cost.get) and s == pytest.approx(1 - low[0] / low[1])
        right += lang == names[b]
    assert right == 120
    letter_tables = model._build()[1]
    assert [x.dense for x in letter_tables] == [table_bytes > 0 and k != "wide" for k in names]


# ------------------------------------------------------------------ 8
def plain_contaminated(rows, items, threshold, overlap):
    """Every item in every passage of twice its own length, half overlapping, the whole rule."""
    fold = str.maketrans(decontamination.PUNCT, " " * len(decontamination.PUNCT))
    norm = lambda t: (t or "").lower().translate(fold).encode().split()
    real = [(k, norm(t)) for k, t in items if norm(t)]
    df = Counter(w for _, t in real for w in set(t))
    mean, n = sum(len(t) for _, t in real) / len(real), len(real)
    out = {}
    for i, text in rows:
        w = norm(text)
        for k, item in real:
            gain = {t: math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * f * 2.2 / (f + 1.2 * (.25 + .75 * len(item) / mean))
                    for t, f in Counter(item).items()}
            total, size = sum(gain.values()), len(item)
            half = (len(item) + 1) // 2
            question, answer = set(item[:half]), set(item[half:])
            for s in range(0, max(1, len(w)), size):
                held = set(w[s:s + 2 * size])
                found = (sum(g for t, g in gain.items() if t in held) / total, len(question & held) / len(question),
                         len(answer & held) / len(answer) if answer else 1.0)
                if found[0] >= threshold and min(found[1:]) >= overlap and found > out.get((i, k), (0,)):
                    out[i, k] = found
    return out


def test_decontamination_exact(spark):
    """Whole copies, scattered ones, partial ones, one side of the item missing, an item in another's
    window: exactly the pairs of the plain version, with its scores and overlaps."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(150)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(n))) for k, n in enumerate([4, 7, 12, 20, 33, 60, 15, 15, 1, 2])]
    items += [(50, items[3][1] + " " + items[4][1]), (51, None), (52, " . ")]
    rows = []
    for d in range(120):
        w = text(rng.randint(0, 300))
        for k in rng.sample(range(10), 2):
            own = items[k][1].split()
            kept = [x for x in own if rng.random() > (d % 4) * 0.12]           # parts missing
            for x in range(len(kept) - 1, 0, -1):
                if rng.random() < (d % 3) * 0.2:
                    kept[x:x] = text(rng.randint(1, 3))                          # scattered
            if d % 5 == 0:
                rng.shuffle(kept)
            at = rng.randint(0, len(w))
            w[at:at] = kept
        rows.append((d, " ".join(w).title() if d % 2 else ", ".join(w)))
    it = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontamination.contaminated(df, it).collect()}
    want = plain_contaminated(rows, items, decontamination.THRESHOLD, decontamination.OVERLAP)
    assert set(got) == set(want) and len(got) > 150
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


# ------------------------------------------------------------------ pipeline
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, uid long, r int, component_id string, shard string"


def test_pipeline_stages_on_nulls_repeats_and_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(["haus", "baum", "tree", "house", "arbre"]) + str(rng.randrange(50)) for _ in range(n))
    texts = [line(40) for _ in range(30)]
    extra = ("keep-me", 5, 6, "c", "sh")
    rows = [(i, t, ["de", None][i % 2], [None, "a", "b"][i % 3], 1, *extra) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, *extra), (None, None, None, None, None, *extra), (3, texts[3], "de", "a", 1, *extra),
             (3, line(40), "de", "a", 1, *extra), (90, "", "de", "a", 0, *extra), (91, "12 !", "de", "a", 4, *extra)]
    item = " ".join(texts[7].split()[5:25])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = corpus_pipeline.cut(spark.createDataFrame(rows, SCHEMA).repartition(3))
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.cut(stage(spark, kept, str(tmp_path)))
        out = kept.collect()
        sizes.append(len(out))
        assert all((r._row, r.uid, r.r, r.component_id) == ("keep-me", 5, 6, "c") for r in out), name
        if name != "sharding":
            assert kept.columns == docs.columns, name
        if name == "simhash_near_dedup":
            assert len({r.text for r in out}) == len(out) == 31  # one of each text, whatever its id
        if name == "benchmark_decontamination":
            assert texts[7] not in {r.text for r in out} and len(out) == 30
        if name == "mix_to_weights":
            assert all(r.text for r in out)
    assert sizes[0] == 33  # null, empty and letterless texts went
    assert sorted(r.slot for r in out if r.shard == 0) == list(range(sum(r.shard == 0 for r in out)))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.cut(spark.createDataFrame([], SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.cut(stage(spark, kept, str(tmp_path)))
        assert kept.count() == 0, name
