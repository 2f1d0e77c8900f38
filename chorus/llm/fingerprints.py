"""Document fingerprints by consistent weighted sampling.

Terms are the words of a text, weighted by how often they occur. Each of ``k``
samples draws, per term, r and c from Gamma(2, 1) and b from U(0, 1) (fixed by
term, sample and seed), quantises the weight on the term's own grid,
t = floor(ln w / r + b), and keeps the term with the smallest
ln c - r (t - b) - r. Two texts keep the same (term, t) with a probability equal
to their generalised Jaccard similarity, sum(min w) / sum(max w). The signature
holds 16 bits of every kept pair, so unequal pairs agree by chance in 1 of 65,536."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import text_bytes

K = 64
SEED = 11
CACHE_TERMS = 50_000   # terms whose draws a task remembers (1 KB each at k = 64)
BLOCK_BYTES = 4 << 20  # text of one run of neighbouring documents
DRAWS = 20             # ids drawn per run to find its end
MAX_RUNS = 100_000     # bounds the numbers that reach the driver; runs of 1 GB at 100 TB
LOWEST = -(1 << 63)    # order of a null doc_id: after all others, descending


class Sampler:
    """Signatures of word multisets; state is only a bounded cache."""

    def __init__(self, k: int = K, seed: int = SEED, cache_terms: int = CACHE_TERMS):
        self.k, self.seed, self.cache_terms = k, seed, cache_terms
        self._clear(1024)

    def _clear(self, rows: int) -> None:
        self.at: dict[bytes, int] = {}
        self.code = np.zeros(rows, np.uint64)
        self.draws = np.zeros((4, rows, self.k), np.float32)  # r, b, ln c, ln a at weight 1
        self.texts = np.zeros(rows, np.int32)  # texts that had the term

    def _make_room(self) -> None:
        """Forget the terms that one text only has had, and of the others all but the commonest."""
        n = len(self.at)
        kept = np.flatnonzero(self.texts[:n] > 1)
        if len(kept) > self.cache_terms // 2:
            kept = np.sort(kept[np.argsort(-self.texts[kept], kind="stable")[:self.cache_terms // 2]])
        place = np.full(n, -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.code[:len(kept)], self.texts[:len(kept)] = self.code[kept], self.texts[kept] // 2
        for lane in self.draws:
            lane[:len(kept)] = lane[kept]
        self.texts[len(kept):] = 0
        self.at = {t: p for t, p in zip(self.at, place.tolist()) if p >= 0}

    def _uniform(self, x: np.ndarray) -> np.ndarray:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        x >>= np.uint64(11)
        u = x.astype(np.float64)
        u += 0.5
        u *= 1 / (1 << 53)
        return u

    def _learn(self, terms: list[bytes]) -> None:
        import xxhash
        n = len(self.at)
        while n + len(terms) > len(self.code):
            self.code = np.concatenate((self.code, np.zeros_like(self.code)))
            self.draws = np.concatenate((self.draws, np.zeros_like(self.draws)), axis=1)
            self.texts = np.concatenate((self.texts, np.zeros_like(self.texts)))
        code = np.array([xxhash.xxh64_intdigest(t, self.seed) for t in terms], np.uint64)
        self.code[n:n + len(terms)] = code
        lane = np.arange(5 * self.k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(0, len(terms), 64):  # the numbers stay in a core's cache
            u = self._uniform(code[i:i + 64, None] + lane[None]).reshape(-1, 5, self.k)
            r = -np.log(u[:, 0] * u[:, 1])
            ln_c = np.log(-np.log(u[:, 2] * u[:, 3]))
            rows = slice(n + i, n + i + len(r))
            self.draws[0, rows], self.draws[1, rows], self.draws[2, rows] = r, u[:, 4], ln_c
            self.draws[3, rows] = ln_c + r * u[:, 4] - r
        for i, t in enumerate(terms):
            self.at[t] = n + i

    def signature(self, counts: Counter) -> np.ndarray:
        """uint16[k] of a word multiset; zeros for the empty one."""
        if not counts:
            return np.zeros(self.k, np.uint16)
        terms = sorted(counts)
        new = [t for t in terms if t not in self.at]
        if new and len(self.at) + len(new) > self.cache_terms:
            self._make_room()
            new = [t for t in terms if t not in self.at]
            if len(self.at) + len(new) > self.cache_terms:
                self._clear(min(len(self.code), self.cache_terms))
                new = terms
        if new:
            self._learn(new)
        best = kept = grid = None
        for i in range(0, len(terms), 8192):  # bounded memory for very long texts
            part = terms[i:i + 8192]
            rows = np.fromiter((self.at[t] for t in part), np.int64, len(part))
            self.texts[rows] += 1
            w = np.fromiter((counts[t] for t in part), np.float64, len(part))
            ln_a, t = self.draws[3, rows], np.zeros((len(part), self.k), np.int32)
            many = np.flatnonzero(w > 1)
            if len(many):
                r, b, ln_c = self.draws[:3, rows[many]]
                q = np.floor(np.log(w[many])[:, None].astype(np.float32) / r + b)
                t[many] = q
                ln_a[many] = ln_c - r * (q - b) - r
            win = ln_a.argmin(axis=0)
            lane = np.arange(self.k)
            low, code, step = ln_a[win, lane], self.code[rows[win]], t[win, lane]
            if best is None:
                best, kept, grid = low, code, step
            else:
                take = low < best
                best, kept, grid = np.where(take, low, best), np.where(take, code, kept), np.where(take, step, grid)
        x = kept + grid.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.arange(self.k, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((x ^ (x >> np.uint64(33))) >> np.uint64(20)).astype(np.uint16)

    def of(self, text: str | None) -> np.ndarray:
        return self.signature(Counter((text or "").encode().split()))


def to_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; an empty text is like empty texts only."""
    if a.any() != b.any():
        return 0.0
    return float((a == b).mean())


def fingerprints(docs: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint): 4 hexadecimal digits per sample. Null and blank texts have
    all zeros. Depends on the text alone; other columns are not read."""
    def run(batches):
        import pyarrow as pa
        s = Sampler(k, seed)
        for batch in batches:
            fp = [to_hex(s.of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.string())],
                                             ["doc_id", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Estimated generalised Jaccard similarity of two fingerprints."""
    none = F.lit("0" * 4 * k)
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(k - 1)),
                           lambda i: F.substr(a, 4 * i + 1, F.lit(4)) == F.substr(b, 4 * i + 1, F.lit(4))))
    return F.when((a == none) != (b == none), F.lit(0.0)).otherwise(same / k)


def run_ends(docs: DataFrame) -> np.ndarray:
    """Ids that end runs of neighbouring documents of about ``BLOCK_BYTES`` of text, rising. They are
    read off ids drawn in proportion to their bytes, ``DRAWS`` a run."""
    total = text_bytes(docs)
    runs = min(MAX_RUNS, max(1, -(-total // BLOCK_BYTES)))
    if runs == 1:
        return np.zeros(0, np.int64)
    step = total / runs / DRAWS
    size = F.octet_length("text")
    draw = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))  # 0 to 1, fixed by the id
    drawn = docs.where(draw * step < size).select("id", size.cast("long").alias("size")).toPandas().sort_values("id")
    done = np.cumsum(np.maximum(drawn["size"].to_numpy(), step))
    last = np.flatnonzero(np.diff(done // (total / runs)) > 0)
    return np.unique(drawn["id"].to_numpy()[last].astype(np.int64))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (dest, guest, id, doc_id, text) sorted within partitions by (dest, guest, id
    descending, text): every dest holds a run of neighbouring documents in descending
    id order, and as guest the document that follows its last one (the overall first
    follows the overall last). The text is shuffled once; a document finds its run by
    binary search. Of the ids, the drawn ones, the runs' ends and each run's largest
    (together at most about (DRAWS + 2) * MAX_RUNS numbers) reach the driver."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ends = run_ends(docs)

    def largest(batches):
        import pyarrow as pa
        top: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy()
            own = np.searchsorted(ends, ids)
            order = np.lexsort((ids, own))
            last = order[np.flatnonzero(np.concatenate((own[order][1:] != own[order][:-1], [True])))] if len(ids) else order
            for o, i in zip(own[last].tolist(), ids[last].tolist()):
                top[o] = max(i, top.get(o, i))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array(list(top.values()), pa.int64())],
                                         ["own", "head"])
    rows = docs.select("id").mapInArrow(largest, "own long, head long").groupBy("own").agg(F.max("head").alias("head")).collect()
    heads = {r["own"]: r["head"] for r in rows}
    order = sorted(heads)
    known = np.array(order, np.int64)
    head, up = np.array([heads[b] for b in order], np.int64), np.roll(known, -1)

    def deal(batches):
        import pyarrow as pa
        names = ["dest", "guest", "id", "doc_id", "text"]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            own = np.searchsorted(ends, ids)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), bool)), *batch.columns], names)
            at = np.searchsorted(known, own)
            guests = np.flatnonzero(head[at] == ids)
            if len(guests):
                sent = batch.take(pa.array(guests))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(up[at[guests]]), pa.array(np.ones(len(guests), bool)), *sent.columns], names)
    return (docs.mapInArrow(deal, "dest long, guest boolean, id long, doc_id long, text string").repartition("dest")
            .sortWithinPartitions("dest", "guest", F.desc("id"), "text"))


def _edited(k: int, seed: int):
    def run(batches):
        import hashlib

        import pyarrow as pa
        s = Sampler(k, seed)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        dest = last = None
        for batch in batches:
            rows = []
            for at, guest, i, text in zip(batch.column("dest").to_pylist(), batch.column("guest").to_pylist(),
                                          batch.column("doc_id").to_pylist(), batch.column("text")):
                if at != dest:
                    dest, last = at, None
                elif guest and last is None:
                    continue  # a second guest of equal id
                text = text.as_py() or ""
                sig = s.of(text)
                if last is not None:
                    j, old, old_sig = last
                    half = len(old) // 2
                    new = old[:len(old) - half] + text[:half]
                    new_sig = s.of(new)
                    rows.append((j, len(old), hashlib.sha256(new.encode()).hexdigest(), to_hex(old_sig),
                                 to_hex(new_sig), alike(old_sig, new_sig), alike(old_sig, sig)))
                last = None if guest else (i, text, sig)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    return run


def edited_fingerprints(docs: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n_chars / 2) code
    points replaced by the first as many of the next document's, descending doc_id.

    Defined cases: a null text is empty; a null doc_id comes after all others; rows
    that repeat a doc_id follow one another by text; a single document follows
    itself; an empty table gives no rows; other columns are not read."""
    return with_next(docs).mapInArrow(_edited(k, seed), (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))


def op2(docs: DataFrame) -> DataFrame:
    return edited_fingerprints(docs)
