"""Benchmark decontamination: BM25 over an inverted index of the test items.

A test item's score for a passage is the BM25 sum over the item's terms that the
passage holds, divided by the item's own full score, so one threshold serves
items of any length. An item's passages are windows of twice its own length, half
overlapping, so a copied item lies whole in at least one; no other item and no
block changes them. Words are compared in lower case and without punctuation.

Items are indexed by length class (powers of two), and a class searches windows in
which every passage of its items lies whole. Pruning is that of block-max WAND:

1. the sum of its terms' list maxima must reach the threshold;
2. for each block of items, so must the sum of its terms' maxima in the block;
3. postings are read only in the blocks left; items at or above the threshold
   are retrieved.

A retrieved item is scored again in each of its own passages of the document. It
counts as contamination when one reaches the threshold and holds at least
``overlap`` of the distinct terms of its question and of its answer (columns
``question`` and ``answer`` where the items have them, else the first and
second half of the text). Pruning never loses an item: the bounds are sums of
maxima. All steps are numpy over a piece of documents; nothing is shuffled.

The index of a set of items travels with the tasks. Its size is checked: items
above ``INDEX_BYTES`` of text are indexed in blocks, each with its own pass
over the documents, whose result is written before the next block is built: the driver
holds one block. Document frequencies are always those of all items."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import arrow_bytes, cut, drop_worker_cache, pieces, word_bounds, word_codes

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
INDEX_BYTES = 2 << 20
ITEM_BLOCK = 16
LIVE_CELLS = 1 << 19     # passages x item blocks bounded at once
PIECE = 1 << 20          # bytes of text scanned at once
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[ord(c) for c in PUNCT]] = 32


def _lower(text: str | None) -> str:
    return (text or "").lower()


def _codes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        data = _FOLD[np.frombuffer(t.encode(), np.uint8)]
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
        out.append(word_codes(data, starts, ends))
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+count."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)


def length_class(n_words: int) -> int:
    """The smallest power of two that is at least ``n_words``."""
    return 1 << max(0, n_words - 1).bit_length()


class Index:
    """Inverted index of a block of items with list and block maxima (CSR arrays)."""

    def __init__(self, ids, texts, parts, df: dict[int, int], n_items: int, mean_len: float):
        """``parts``: (question, answer) texts per item; ``df``: items per term code."""
        words = _codes(texts)
        self.ids = list(ids)
        self.lengths = list(map(len, words))
        self.half = 2 * length_class(max([1, *self.lengths]))  # holds any passage of twice an item's length
        self.vocab = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        v = len(self.vocab)
        idf = np.array([np.log(1 + (n_items - df[c] + 0.5) / (df[c] + 0.5)) for c in self.vocab.tolist()])
        terms, items, gain = [], [], []
        for i, w in enumerate(words):
            t, tf = np.unique(np.searchsorted(self.vocab, w), return_counts=True)
            g = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_len)) if len(t) else np.zeros(0)
            terms.append(t)
            items.append(np.full(len(t), i))
            gain.append(g / g.sum() if len(t) else g)
        self.own = list(zip(terms, gain))
        terms, items, gain = (np.concatenate([*x, np.zeros(0, d)]) for x, d in
                              ((terms, np.int64), (items, np.int64), (gain, float)))
        order = np.lexsort((items, terms))
        self.item, self.gain = items[order], gain[order]
        self.at = np.searchsorted(terms[order], np.arange(v + 1))
        self.n_blocks = -(-len(words) // ITEM_BLOCK)
        key = terms[order] * max(1, self.n_blocks) + self.item // ITEM_BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.block = (key[first] % max(1, self.n_blocks)).astype(np.int64)
        self.block_max = np.maximum.reduceat(self.gain, first) if len(first) else np.zeros(0)
        self.block_at = np.searchsorted(key[first] // max(1, self.n_blocks), np.arange(v + 1))
        self.list_max = np.maximum.reduceat(self.gain, self.at[:-1]) if v else np.zeros(0)
        self.parts = [[np.unique(np.searchsorted(self.vocab, c)) for c in pair]
                      for pair in zip(_codes([p[0] for p in parts]), _codes([p[1] for p in parts]))]
        low = (self.vocab & np.uint64(0xFFFFF)).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[low] = True

    def terms_of(self, codes: np.ndarray) -> np.ndarray:
        """Term number of each word code, -1 if no item holds it."""
        out = np.full(len(codes), -1)
        hit = np.flatnonzero(self.maybe[(codes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, codes[hit]), len(self.vocab) - 1)
        ok = self.vocab[at] == codes[hit]
        out[hit[ok]] = at[ok]
        return out

    def best_passage(self, item: int, at: np.ndarray, term: np.ndarray, threshold: float, overlap: float):
        """Best (score, question overlap, answer overlap) among the item's own passages of
        one document, None if none counts. ``at``: word positions of known terms."""
        own, gain = self.own[item]
        k = np.minimum(np.searchsorted(own, term), len(own) - 1)
        hit = own[k] == term
        half, k = at[hit] // self.lengths[item], k[hit]
        key = np.unique(np.concatenate((half * len(own) + k, (half[half > 0] - 1) * len(own) + k[half > 0])))
        start, k = key // len(own), key % len(own)       # distinct terms of each passage
        first = np.flatnonzero(np.concatenate(([True], start[1:] != start[:-1])))
        score, best = np.add.reduceat(gain[k], first), None
        for j in np.flatnonzero(score >= threshold).tolist():
            held = own[k[first[j]:first[j + 1] if j + 1 < len(first) else len(k)]]
            share = [float(np.isin(x, held).mean()) if len(x) else 1.0 for x in self.parts[item]]
            if min(share) >= overlap:
                found = (float(score[j]), *share)
                best = max(best or found, found)
        return best

    def search(self, codes: np.ndarray, first: np.ndarray, threshold: float, overlap: float):
        """(document, item, score, question overlap, answer overlap) of contaminated
        documents, the best passage per pair."""
        if not len(self.vocab) or not len(codes):
            return []
        half, v = self.half, len(self.vocab)
        n = np.diff(first)
        halves = -(-n // half)
        base = np.cumsum(halves) - halves
        doc = np.repeat(np.arange(len(n)), n)
        term = self.terms_of(codes)
        on = np.flatnonzero(term >= 0)
        where, known, of = on - first[doc[on]], term[on], np.searchsorted(doc[on], np.arange(len(n) + 1))
        part = base[doc[on]] + where // half
        key = np.unique(part * v + term[on])         # distinct terms of each half passage
        part, term = key // v, key % v
        n_parts = int(halves.sum())
        bound = np.bincount(part, self.list_max[term], n_parts)
        last = np.zeros(n_parts, bool)
        last[(base + halves - 1)[halves > 0]] = True
        after = np.where(last, 0.0, np.concatenate((bound[1:], [0.0])))
        passages = np.flatnonzero(bound + after >= threshold)   # 1. list maxima
        if not len(passages):
            return []
        at = np.searchsorted(part, np.arange(n_parts + 1))
        out = {}
        nb = max(1, self.n_blocks)
        group = max(1, min(4096, LIVE_CELLS // nb))
        for i in range(0, len(passages), group):
            p = passages[i:i + group]
            end = np.where(last[p], p + 1, p + 2)
            count = at[end] - at[p]
            k = np.unique(np.repeat(np.arange(len(p)), count) * v + term[_ranges(at[p], count)])
            q, t = k // v, k % v                     # distinct terms of each passage
            ok = np.bincount(q, self.list_max[t], len(p)) >= threshold
            keep = ok[q]
            q, t = q[keep], t[keep]
            c = self.block_at[t + 1] - self.block_at[t]
            r = _ranges(self.block_at[t], c)
            live = np.bincount(np.repeat(q, c) * nb + self.block[r], self.block_max[r], len(p) * nb) >= threshold  # 2.
            c = self.at[t + 1] - self.at[t]
            r = _ranges(self.at[t], c)
            qq = np.repeat(q, c)
            keep = live[qq * nb + self.item[r] // ITEM_BLOCK]
            r, qq = r[keep], qq[keep]
            pair, inverse = np.unique(qq * len(self.ids) + self.item[r], return_inverse=True)  # 3. postings
            score = np.bincount(inverse, self.gain[r], len(pair))
            for j in np.flatnonzero(score >= threshold).tolist():
                passage, item = divmod(int(pair[j]), len(self.ids))
                d = int(np.searchsorted(base + halves, p[passage], "right"))
                if (d, item) not in out:
                    a, b = of[d], of[d + 1]
                    out[d, item] = self.best_passage(item, where[a:b], known[a:b], threshold, overlap)
        return [(d, self.ids[i], *x) for (d, i), x in sorted(out.items(), key=lambda kv: kv[0]) if x]


def index_blocks(items: DataFrame):
    """Per ``INDEX_BYTES`` of item text the indexes of its length classes, one block after the
    other, so that the driver need not hold two; items without a word are left out. Yields
    (indexes, whether it is the only block)."""
    cols = set(items.columns)
    qa = {"question", "answer"} <= cols
    src = items.select("item_id", *(["question", "answer"] if qa else []),
                       (F.concat_ws(" ", "question", "answer") if qa else F.coalesce("text", F.lit(""))).alias("text"))
    bare = F.translate(F.lower("text"), PUNCT, " " * len(PUNCT))
    src = src.withColumn("_words", F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    src = src.where("size(_words) > 0")
    n, size, mean = src.agg(F.count("*"), F.sum(F.octet_length("text")), F.avg(F.size("_words"))).first()
    if not n:
        return
    blocks = -(-size // INDEX_BYTES)
    src = src.withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    df = src.select("_b", F.explode(F.array_distinct("_words")).alias("_w"))
    freq = df.groupBy("_w").agg(F.count("*").alias("_df"))
    for b in range(blocks):
        rows = src.where(F.col("_b") == b).orderBy("item_id", "text").collect()
        if not rows:
            continue
        terms = (freq if blocks == 1 else freq.join(df.where(F.col("_b") == b).select("_w").distinct(), "_w")).collect()
        codes = _codes([r["_w"] for r in terms])
        known = {int(c[0]): r["_df"] for c, r in zip(codes, terms)}
        parts = [((_lower(r["question"]), _lower(r["answer"])) if qa else
                  (" ".join(r["_words"][:(len(r["_words"]) + 1) // 2]), " ".join(r["_words"][(len(r["_words"]) + 1) // 2:])))
                 for r in rows]
        classes: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            classes.setdefault(length_class(len(r["_words"])), []).append(i)
        yield [Index([rows[i]["item_id"] for i in at], [" ".join(rows[i]["_words"]) for i in at],
                     [parts[i] for i in at], known, n, mean) for _, at in sorted(classes.items())], blocks == 1


def _scan(batches, indexes: list[Index], threshold: float, overlap: float):
    import pyarrow as pa
    import pyarrow.compute as pc
    drop_worker_cache()
    for batch, a, b, data, offs in pieces(batches, limit=PIECE):
        low = pc.utf8_lower(batch.column("text").slice(a, b - a))
        data, offs = arrow_bytes(low if isinstance(low, pa.Array) else low.combine_chunks())
        data, offs = _FOLD[data[offs[0]:offs[-1]]], offs - offs[0]
        starts, ends, first = word_bounds(data, offs)
        codes = word_codes(data, starts, ends)
        yield batch, a, b, [f for index in indexes for f in index.search(codes, first, threshold, overlap)]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
                 overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every document that
    holds a test item, with its best passage.

    Defined cases: null and blank texts hold nothing; items without a word match
    nothing; a part without a word counts as held; repeated rows of documents or
    items each give their rows; null ids are returned as null; empty tables give no
    rows; other columns are not read."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def scanner(indexes):
        def run(batches):
            import pyarrow as pa
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            for batch, a, b, found in _scan(batches, indexes, threshold, overlap):
                if found:
                    ids = batch.column("doc_id").slice(a, b - a).take(pa.array([f[0] for f in found])).cast(pa.int64())
                    cols = [ids, *(pa.array(c, t) for c, t in zip(list(zip(*found))[1:], types[1:]))]
                    yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])
        return run
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = []
    for indexes, only in index_blocks(items.withColumn("item_id", F.col("item_id").cast("long"))):
        pairs = docs.mapInArrow(scanner(indexes), schema)
        found.append(pairs if only else cut(pairs))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
               overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no test item (a map, no join).

    Defined cases: null and blank texts hold nothing and stay; repeated rows and null ids are
    judged each by its text; a text of any length is searched whole; without items all rows stay;
    an empty table gives no rows; only ``text`` is read, other columns pass whatever their names."""
    def keeper(indexes):
        def run(batches):
            import pyarrow as pa
            for batch, a, b, found in _scan(batches, indexes, threshold, overlap):
                mask = np.ones(b - a, bool)
                mask[[f[0] for f in found]] = False
                yield batch.slice(a, b - a).filter(pa.array(mask))
        return run
    for indexes, only in index_blocks(items):
        docs = docs.mapInArrow(keeper(indexes), docs.schema)
        docs = docs if only else cut(docs)
    return docs


def op8(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items)
