"""Every operator against a plain brute-force version on a small fixture with nulls,
empty and long texts, ties, repeated rows and extra columns with clashing names; the
registered queries against their SQL; the pipeline stage by stage."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chorus.llm import (components, decontamination, fingerprints, language_id, line_dedup, mixing, sharding, simhash,
                        substring_dedup, token_counts, warc)
from chorus.llm.common import read
from chorus.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, "
          "part long, data string, fp long, component_id long, target double, lang_pred string, value string, kind int")


def _texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    def line(n):
        return " ".join(rng.choice(words) for _ in range(n))
    base = [line(30) + "\n" + line(25) + "\n" + line(8) for _ in range(25)]
    out = list(base) + [base[0], base[0], base[1] + "\n" + base[2]]
    for t in base[3:9]:  # near copies: one word changed
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [None, "", "   \n\t ", "word", "12 34 !", "A\x0bB\x0cC D", base[4].upper(), "x " * 500,
            "\n".join(line(12) for _ in range(300)), "é" * 3000]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i * 7 % 97, t, ["en", "fr", None][i % 3], [None, "a", "b", "ü"][min(3, i % 7)], 1)
           for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = [r + (5, 5, 5, 5, "d", 5, 5, 0.5, "zz", "v", 9) for r in rows]
    return spark.createDataFrame(more, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def ws(t):
    return (t or "").encode().split()


# ------------------------------------------------------------------------- 1
def test_substring_dedup(docs, rows, empty):
    got = by_id(substring_dedup.substring_dedup(docs, 20))
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = ws(t)
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s:s + 20]), (i, s))
    for i, t, *_ in rows:
        w = ws(t)
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] != (i, s) for k in range(s, s + 20)}
        assert got[i].kept_text == b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert gone == {k for s in got[i].spans for k in range(s.start, s.end)}
    assert sum(r.n_removed for r in got.values()) > 100
    assert substring_dedup.op1(empty).count() == 0


def test_substring_dedup_null_and_repeated_ids(spark):
    t = " ".join(map(str, range(25)))
    df = spark.createDataFrame([(None, t), (3, t), (3, t)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(False, 0), (False, 0), (True, 25)]  # equal rows are one document, a null id sorts last


# ------------------------------------------------------------------------- 2
def test_weighted_fingerprints(docs, rows, empty):
    got = by_id(fingerprints.op2(docs))
    order = sorted(rows, key=lambda r: -r[0])
    seen = defaultdict(set)
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    for (i, t, *_), (j, u, *_) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        h = len(t) // 2
        e = t[:len(t) - h] + u[:h]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].fingerprint == plain[i]
        seen[t].add(got[i].fingerprint)
        same = sum(got[i].fingerprint[k:k + 4] == got[j].fingerprint[k:k + 4] for k in range(0, 256, 4)) / 64
        assert got[i].near_next == same or not (ws(t) and ws(u))
    assert all(len(x) == 1 for x in seen.values())
    assert fingerprints.op2(empty).count() == 0


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(9)
    s = fingerprints.Sampler(k=4096, cache_terms=300)
    for _ in range(4):
        a = Counter({b"w%d" % i: rng.randint(1, 9) for i in range(40)})
        b = Counter({b"w%d" % i: rng.randint(1, 9) for i in range(15, 55)})
        want = sum((a & b).values()) / sum((a | b).values())
        assert abs(fingerprints.alike(s.signature(a), s.signature(b)) - want) < 0.035
    assert fingerprints.alike(s.of(""), s.of(None)) == 1 and fingerprints.alike(s.of(""), s.of("a")) == 0


# ------------------------------------------------------------------------- 3
def test_sharding(docs, rows, empty):
    got = sharding.interleave_shards(docs, 5)
    assert set(got.columns) == set(docs.columns)
    out = got.collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == sorted((r[0], r[1] or "") for r in rows)
    n = Counter(r.shard for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 5
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    for src, total in Counter(r[3] for r in rows).items():
        for s in n:
            assert abs(sum(r.shard == s and r.source == src for r in out) - total / 5) <= 2
    q = by_id(sharding.op3(docs))
    for i, t, *_ in rows:
        b = (t or "").encode()
        assert (q[i].size, q[i].text_crc32, q[i].law, q[i].grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)
    assert sharding.op3(empty).count() == 0


# ------------------------------------------------------------------------- 4
def _line_brute(rows):
    sets, out = [], {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            s = set(line.encode().split())
            if not s or not any(5 * len(s & y) >= 4 * len(s | y) for y in sets):
                kept.append(line)
            if s:
                sets.append(s)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(docs, rows, empty):
    got, want = by_id(line_dedup.line_dedup(docs)), _line_brute(rows)
    assert {i: r.kept_text for i, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) > 20
    assert line_dedup.op4(empty).count() == 0


@pytest.mark.parametrize("small,steps,fold", [(12, 4096, 72), (2, 16, 10)])
def test_line_dedup_hot_groups(spark, monkeypatch, small, steps, fold):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(120):  # one line in near copies, far more than a listed group
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(40)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    for i in range(120, 160):  # lines on both sides of the fold, with partners on the other one
        w = [f"y{i % 7}_{k}" for k in range(rng.randint(8, 12))] + ["z"] * rng.randint(0, 1)
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(line_dedup, "HOT", 30)
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "STEPS", steps)
    monkeypatch.setattr(line_dedup, "FOLD", fold)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.kept_text for r in line_dedup.line_dedup(df).collect()} == _line_brute(rows)


# ------------------------------------------------------------------------- 5
def test_cross_parsing_matches_longest_match():
    rng = random.Random(1)
    ref = [rng.randint(1, 4) for _ in range(120)]
    table = language_id.automaton(ref)
    text = [rng.randint(1, 5) for _ in range(400)]
    state = phrases = 0
    for c in text:
        v = int(table[state + c])
        phrases += v >> 30
        state = v & 0x3FFFFFFF
    phrases += state != 0
    want, i = 0, 0
    s = bytes(ref)
    while i < len(text):
        n = 1
        while i + n < len(text) + 1 and bytes(text[i:i + n]) in s:
            n += 1
        i += max(1, n - 1)
        want += 1
    assert phrases == want


def test_language_id(spark, docs, rows, empty):
    d = read(spark, SF_SMALL, "documents")
    out = language_id.op5(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 30 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    got = by_id(language_id.op5(docs))
    for i, t, *_ in rows:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
    assert language_id.op5(empty).count() == 0
    assert set(r.lang_pred for r in language_id.op5(d.withColumn("lang", F.lit(None).cast("string"))).collect()) == {"und"}


# ------------------------------------------------------------------------- 6
def test_mixing(docs, rows, empty):
    got = by_id(mixing.op6(docs))
    size = {r[0]: len(ws(r[1])) for r in rows}
    per = Counter()
    for r in rows:
        per[r[3]] += size[r[0]]
    order = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(per.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * per[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * per[s]
        open_ -= over
    taken = Counter()
    for r in rows:
        g = got[r[0]]
        assert (g.size, g.source_size) == (size[r[0]], per[r[3]]) and abs(g.target - target[r[3]]) < 1e-6
        assert 0 <= g.taken <= 3 * g.size
        taken[r[3]] += g.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    copies = mixing.take_copies(mixing.mix_to_weights(docs.drop("size", "target")), ["doc_id", "text", "source", "n_chars"])
    assert copies.agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))).first()[0] == sum(taken.values())
    assert mixing.op6(empty).count() == 0


# ------------------------------------------------------------------------- 7
def test_token_counts(docs, rows, empty):
    got = by_id(token_counts.token_counts(docs))
    score = token_counts.load_pieces()
    def best(word):
        b = [(0.0, 0)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            b[e] = max(((b[s][0] + score[word[s:e]], b[s][1] - 1) for s in range(e) if word[s:e] in score))
        return -b[-1][1]
    memo = {w: best(b" " + w) for _, t, *_ in rows for w in ws(t) if len(w) < 100}
    for i, t, *_ in rows:
        w = ws(t)
        assert got[i].n_words == len(w)
        if all(x in memo for x in w):
            assert got[i].n_tokens == sum(memo[x] for x in w)
    assert token_counts.op7(empty).count() == 0


# ------------------------------------------------------------------------- 8
def _bm25(docs_words, item_words, longest, n_items, df, mean):
    own, held = Counter(item_words), set()
    gain = {t: math.log(1 + (n_items - df[t] + .5) / (df[t] + .5)) * f * 2.2 / (f + 1.2 * (.25 + .75 * len(item_words) / mean))
            for t, f in own.items()}
    top = 0.0
    for s in range(0, max(1, len(docs_words)), longest):
        p = set(docs_words[s:s + 2 * longest])
        top = max(top, sum(g for t, g in gain.items() if t in p) / sum(gain.values()))
    return top


def test_decontamination(spark, docs, rows, empty):
    fold = str.maketrans(decontamination.PUNCT, " " * len(decontamination.PUNCT))
    norm = lambda t: (t or "").lower().translate(fold).encode().split()
    items = [(1, rows[0][1].replace("\n", ". ").title()), (2, rows[5][1][:90]), (3, None), (4, "  "), (4, "unseen words here"),
             (None, rows[7][1])]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, it).collect()}
    real = [(k, norm(t)) for k, t in items if norm(t)]
    df = Counter(w for _, t in real for w in set(t))
    mean, longest = sum(len(t) for _, t in real) / len(real), max(len(t) for _, t in real)
    want = {}
    for i, t, *_ in rows:
        for k, item in real:
            score = _bm25(norm(t), item, longest, len(real), df, mean)
            if score >= .6:
                want[i, k] = score
    assert set(got) <= set(want) and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    whole = {(i, k) for i, t, *_ in rows for k, item in real if b" %b " % b" ".join(item) in b" %b " % b" ".join(norm(t))}
    assert whole <= set(got) and len(whole) == 4
    clean = {r.doc_id for r in decontamination.keep_clean(docs, it).collect()}
    assert clean == {r[0] for r in rows} - {i for i, _ in got}
    assert decontamination.contaminated(empty, it).count() == 0
    assert decontamination.contaminated(docs, it.limit(0)).count() == 0


def test_decontamination_window_is_the_items_own(spark, monkeypatch):
    """A short item scattered over a long one's window is no match; long items and blocks change nothing."""
    short = [f"s{i}" for i in range(15)]
    scattered = " ".join(w for i, x in enumerate(short) for w in [x, *(f"f{i}x{j}" for j in range(20))])
    near = "a b c " + " ".join(short) + " d e f"
    d = spark.createDataFrame([(1, scattered), (2, near), (3, " ".join(f"l{i}" for i in range(600)))], "doc_id long, text string")
    item = (1, " ".join(short))
    long = (2, " ".join(f"l{i}" for i in range(600)))
    for items, size, want in (([item], 2 << 20, {(2, 1)}), ([item, long], 2 << 20, {(2, 1), (3, 2)}),
                              ([item, long], 40, {(2, 1), (3, 2)})):
        monkeypatch.setattr(decontamination, "INDEX_BYTES", size)
        it = spark.createDataFrame(items, "item_id long, text string")
        assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, it).collect()} == want
        assert {r.doc_id for r in decontamination.keep_clean(d, it).collect()} == {1, 2, 3} - {i for i, _ in want}


# ------------------------------------------------------------------------- 9
def _simhash(t):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in ws(t)]
    if not w:
        return 0
    sh = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    got = by_id(simhash.op9(docs))
    fp = {r[0]: _simhash(r[1]) for r in rows}
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    root[a] = min(root[a], root[b])
    for i in fp:
        assert got[i].fingerprint == f"{fp[i]:016x}" and got[i].component_id == root[i]
    assert simhash.op9(empty).count() == 0


def test_pivot_join_loses_no_pair(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)]
    df = spark.createDataFrame(signed, "rep long, fp long").repartition(3)
    want = {i: i for i in range(len(fps))}
    def find(i):
        while want[i] != i:
            i = want[i]
        return i
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                want[max(x, y)] = min(x, y)
    for cell_rows in (simhash.CELL_ROWS, 3):  # whole cells, and cells dealt as pairs of salts
        links = simhash.near_pairs(df, cell_rows=cell_rows)
        assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 3 for r in links.collect())
        comp = {r.node: r.component for r in components.components(links).collect()}
        assert all(comp.get(i, i) == find(i) for i in want)


# ------------------------------------------------------------------------ 10
def _b32(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_warc(spark, empty):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>é</p>", None, "", inner * 3, "x" + inner + "y", "same", "same", "same", "\r\n\r\n", "é" * 40000, "WARC/1.0\r\n"]
    pages = [(i, f"http://h/{i} \r\n", h, 7) for i, h in enumerate(html)] + [(None, None, "same", 7)]
    pages += [(1000 + i, "u", f"page {i} " * 300, 7) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_bytes long")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")  # many splits per file
        out = warc.round_trip(df.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    last = {}
    for i, _, h, _ in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = sorted((i is None, i or 0, len((h or "").encode()), _b32(h), last[h or ""] if last[h or ""] != i else -1)
                  for i, _, h, _ in pages)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest,
                  -1 if r.refers_to is None else r.refers_to) for r in out)
    assert got == want and all(r.intact for r in out)
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in out)
    small = warc.archive_records(df, min_bytes=5).where("html = 'same'").collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.op10(df.limit(0)).count() == 0


# ------------------------------------------------------------------- queries
@pytest.mark.parametrize("name", sorted(n for n, (_f, sql) in QUERIES.items() if sql))
def test_query_matches_sql(spark, name):
    fn, sql = QUERIES[name]
    assert compare(spark, fn(spark, SF_SMALL), duck(SF_SMALL), sql) > 0


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark):
    docs = read(spark, SF_SMALL, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, SF_SMALL).cache()
        after = kept.collect()
        if name != "sharding":
            assert kept.columns == docs.columns
        if name == "language_id":
            assert {r.doc_id for r in after} == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        if name == "simhash_near_dedup":
            fp = {i: _simhash(t) for i, t in before.items()}
            ids = {r.doc_id for r in after}
            assert not any((fp[a] ^ fp[b]).bit_count() <= 3 for a in ids for b in ids if a < b)
            assert all(any((fp[i] ^ fp[j]).bit_count() <= 3 for j in before if j < i) for i in set(before) - ids)
        if name == "benchmark_decontamination":
            items = [(r.text or "").lower().split() for r in read(spark, SF_SMALL, "benchmark").collect()]
            has = {i for i, t in before.items() for x in items
                   if " " + " ".join(x) + " " in " " + " ".join((t or "").lower().split()) + " "}
            assert not has & {r.doc_id for r in after} and len(has) <= len(before) - len(after) <= len(has) + 5
        if name == "mix_to_weights":
            per = Counter()
            for r in after:
                per[r.doc_id] += len(ws(r.text))
            assert all(n <= 3 * len(ws(before[i])) for i, n in per.items())
            total = sum(len(ws(t)) for t in before.values())
            assert abs(sum(per.values()) - total) <= 40
        if name == "sharding":
            n = Counter(r.shard for r in after)
            assert len(after) >= 40 and set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1


def test_pipeline_near_duplicates_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, a), (5, b), (5, b), (7, c), (9, c), (9, d)]
    fp = [_simhash(t) for t in (a, b, c, d)]
    assert all((x ^ y).bit_count() > 3 for x in fp for y in fp if x != y) and len(set(fp)) == 4
    got = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.cut(spark.createDataFrame(rows, "doc_id long, text string")), "")
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, a), (5, b), (7, c), (9, d)]
