"""Ranked lexical search by hybrid term-at-a-time / document-at-a-time evaluation.

Every document is indexed: a segment of documents (about ``SEGMENT_BYTES`` of text, or
one longer document) becomes one row with the documents' lengths and a posting
list (document, occurrences) for every term that some query holds. The rows are written
once to the checkpoint folder; document frequencies, the number of documents and of
terms are aggregates over them. The second pass ranks:

1. term at a time: the postings of a query's shortest lists, together at most a
   ``SHORT``-th of the segment's documents, are summed into accumulators;
2. document at a time: the accumulators, sorted by document, are from then on one more
   iterator with a bound, beside the long lists. All iterators know their largest score
   in each block of ``DOC_BLOCK`` documents. Blocks are visited by descending sum of
   bounds, and skipped once that sum is below the query's k-th best score so
   far; inside a block the long lists are added by descending bound and the rest is
   skipped as soon as no document can still reach that score.

A bound equal to the k-th best score is not skipped (the document may have the smaller
id), so the result is exact. The k-th best carries over between the segments of a task.
A task hands on k documents per query; the last step keeps k of all tasks.

Terms are compared by 64-bit codes: two different terms meet with a probability of about
(query terms x distinct corpus terms) / 2**64. All scores are 64-bit integers.

Queries travel with the tasks. Their size is checked: more than ``QUERY_BYTES`` of text are
searched in blocks, each with its own pass, and a block's result is written before the
next one starts, so the driver holds one block at a time."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import cut, doc_ids, pieces, word_bounds, word_codes

SEGMENT_BYTES = 8 << 20
PIECE = 2 << 20          # bytes of text taken apart at once
QUERY_BYTES = 2 << 20
SHORT = 4
DOC_BLOCK = 256
K = 10
MAYBE = 1 << 20          # slots of the filter in front of the term lookup

# term characters: 0-9, A-Z, a-z and everything beyond ASCII
_TERM = np.ones(256, bool)
_TERM[:128] = [chr(i).isalnum() for i in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all terms of a piece and each document's first term."""
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, offs, _TERM)
    return word_codes(data, starts, ends), first


class Queries:
    """Distinct terms of a block of queries and the terms of each query."""

    def __init__(self, texts: list[str]):
        found = []
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            found.append(np.unique(term_codes(data, np.array([0, len(data)]))[0]))
        self.vocab = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
        self.terms = [np.searchsorted(self.vocab, t) for t in found]
        self.maybe = np.zeros(MAYBE, bool)
        self.maybe[(self.vocab & np.uint64(MAYBE - 1)).astype(np.int64)] = True

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, term number) of the codes that are query terms."""
        place = np.flatnonzero(self.maybe[(codes & np.uint64(MAYBE - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, codes[place]), max(0, len(self.vocab) - 1))
        ok = self.vocab[at] == codes[place] if len(self.vocab) else np.zeros(0, bool)
        return place[ok], at[ok]


# ------------------------------------------------------------------ segments

def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 64-bit integers as one compressed block."""
    import pyarrow as pa
    head = np.array([len(arrays), *map(len, arrays)], np.int64)
    raw = b"".join([head.tobytes(), *(a.astype(np.int64).tobytes() for a in arrays)])
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(data) -> list[np.ndarray]:
    import pyarrow as pa
    size = int(np.frombuffer(data[:8], np.int64)[0])
    x = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size), np.int64)
    edges = np.cumsum([1 + int(x[0]), *x[1:1 + int(x[0])].tolist()])
    return [x[a:b] for a, b in zip(edges, edges[1:])]


def segments(docs: DataFrame, queries: Queries) -> DataFrame:
    """(data, n_docs, n_terms, terms, counts): a packed segment, its documents with a term, all
    their terms, and the document frequencies of the query terms in it."""
    def run(batches):
        import pyarrow as pa
        held, size = [], 0

        def out():
            ids, null, n, doc, term, tf = (np.concatenate(x) for x in zip(*(
                (i, z, c, d + base, t, f) for (i, z, c, d, t, f), base in
                zip(held, np.cumsum([0, *(len(h[0]) for h in held)])))))
            order = np.lexsort((doc, term))
            doc, term, tf = doc[order], term[order], tf[order]
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            gap = np.diff(doc, prepend=0)
            gap[first] = doc[first]
            counts = np.diff(np.append(first, len(term)))
            packed = _pack([ids, null, n, term[first], counts, gap, tf])
            return pa.RecordBatch.from_arrays(
                [pa.array([packed], pa.binary()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
                 pa.array([term[first].astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))],
                ["data", "n_docs", "n_terms", "terms", "counts"])
        for batch in batches:
            for part, a, b, data, offs in pieces([batch], limit=PIECE):
                codes, first = term_codes(data, offs)
                place, term = queries.lookup(codes)
                n_docs = b - a
                doc = np.searchsorted(first, place, "right") - 1
                key, tf = np.unique(term * n_docs + doc, return_counts=True)
                null = np.asarray(part.column("doc_id").slice(a, n_docs).is_null())
                held.append((doc_ids(part, a, b), null.astype(np.int64), np.diff(first), key % n_docs, key // n_docs, tf))
                size += len(data)
                if size >= SEGMENT_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "data binary, n_docs long, n_terms long, terms array<int>, counts array<int>")


class Segment:
    """A segment with the scores of its postings, ready to be searched."""

    def __init__(self, data, weights: np.ndarray, n_all: int, l_all: int):
        self.ids, self.null, n, self.terms, counts, gap, tf = _unpack(data)
        self.at = np.concatenate(([0], np.cumsum(counts)))
        first = self.at[:-1]
        total = np.cumsum(gap)
        self.doc = total - np.repeat(total[first] - gap[first], counts)
        m = 10 + (90 * n * n_all) // max(1, l_all)
        self.score = np.repeat(weights[self.terms], counts) * ((10**9 * tf) // (1000 * tf + 8 * m[self.doc]))
        # blocks of every list: place of the first posting, largest score
        block = self.doc // DOC_BLOCK
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[first] = True
        self.skip = np.append(np.flatnonzero(new), len(block))
        self.block = block[self.skip[:-1]]
        self.block_max = np.maximum.reduceat(self.score, self.skip[:-1]) if len(block) else np.zeros(0, np.int64)
        self.block_at = np.searchsorted(self.skip[:-1], self.at)
        self.n_blocks = -(-len(self.ids) // DOC_BLOCK)

    def accumulate(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: documents and summed scores of whole lists."""
        if not len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.concatenate([self.doc[self.at[i]:self.at[i + 1]] for i in lists])
        score = np.concatenate([self.score[self.at[i]:self.at[i + 1]] for i in lists])
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        return doc[first], np.add.reduceat(score[order], first)

    def search(self, lists: np.ndarray, top: Top) -> None:
        """Offer ``top`` every document that can still be among its best."""
        size = self.at[lists + 1] - self.at[lists]
        order = np.argsort(size, kind="stable")
        n_short = int(np.searchsorted(np.cumsum(size[order]), len(self.ids) // SHORT, "right"))
        acc, acc_score = self.accumulate(lists[order[:n_short]])
        long = lists[order[n_short:]]
        bound = np.zeros(self.n_blocks, np.int64)
        if len(acc):
            of = acc // DOC_BLOCK
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            bound[of[first]] = np.maximum.reduceat(acc_score, first)
        for i in long:
            a, b = self.block_at[i], self.block_at[i + 1]
            bound[self.block[a:b]] += self.block_max[a:b]
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] < top.least:
                break
            self._block(b, acc, acc_score, long, top)

    def _block(self, b: int, acc, acc_score, long, top: Top) -> None:
        """Document at a time within one block: accumulators first, long lists by bound."""
        base = b * DOC_BLOCK
        score = np.zeros(min(DOC_BLOCK, len(self.ids) - base), np.int64)
        x, y = np.searchsorted(acc, (base, base + DOC_BLOCK))
        score[acc[x:y] - base] = acc_score[x:y]
        here = []
        for i in long:
            p = self.block_at[i] + int(np.searchsorted(self.block[self.block_at[i]:self.block_at[i + 1]], b))
            if p < self.block_at[i + 1] and self.block[p] == b:
                here.append((int(self.block_max[p]), p))
        here.sort(reverse=True)
        rest = sum(h[0] for h in here)
        for most, p in here:
            if score.max() + rest < top.least:
                return
            s = slice(self.skip[p], self.skip[p + 1])
            score[self.doc[s] - base] += self.score[s]
            rest -= most
        good = np.flatnonzero(score >= top.least)
        if len(good):
            top.offer(score[good], self.null[base + good], self.ids[base + good])


class Top:
    """The k best (score, null, doc_id) of a query, equal scores by ascending doc_id."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # scores of 0 do not count
        self.rows = np.zeros((3, 0), np.int64)

    def offer(self, score, null, ids) -> None:
        rows = np.concatenate((self.rows, np.stack((score, null, ids))), axis=1)
        order = np.lexsort((rows[2], rows[1], -rows[0]))[:self.k]
        self.rows = rows[:, order]
        if len(order) == self.k:
            self.least = max(1, int(self.rows[0, -1]))


def _rank(batches, queries: Queries, weights: np.ndarray, n_all: int, l_all: int, k: int):
    """(query number, doc_id, score) of the k best documents of a task per query."""
    import pyarrow as pa
    tops = [Top(k) for _ in queries.terms]
    of_term = np.full(len(queries.vocab), -1)
    for batch in batches:
        for x in batch.column("data"):
            seg = Segment(x.as_buffer(), weights, n_all, l_all)
            of_term[:] = -1
            of_term[seg.terms] = np.arange(len(seg.terms))
            for terms, top in zip(queries.terms, tops):
                lists = of_term[terms]
                lists = lists[lists >= 0]
                if len(lists):
                    seg.search(lists, top)
    query = np.repeat(np.arange(len(tops)), [t.rows.shape[1] for t in tops])
    rows = np.concatenate([np.zeros((3, 0), np.int64), *(t.rows for t in tops)], axis=1)
    if len(query):
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(rows[2], mask=rows[1] > 0), pa.array(rows[0])],
            ["query", "doc_id", "score"])


# ------------------------------------------------------------------ interface

def _search_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries([r["text"] for r in rows])
    seg = cut(segments(docs, queries))
    n_all, l_all = seg.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    pairs = seg.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    df = np.zeros(len(queries.vocab), np.int64)
    # at most the distinct terms of one block of queries reach the driver
    for r in pairs.groupBy("p.terms").agg(F.sum("p.counts").alias("df")).collect():
        df[r["terms"]] = r["df"]
    weights = np.floor(1000 * np.log((2 * n_all + 2) / (2 * df + 1))).astype(np.int64)
    found = seg.select("data").mapInArrow(lambda b: _rank(b, queries, weights, n_all, l_all, k),
                                          "query int, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "query int, item_id long")
    return cut(ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the ``k`` documents with the
    highest score above 0, equal scores by ascending doc_id.

    Defined cases: null and empty texts have no term: such documents are in no result and
    in no statistic, such items have no row; a null doc_id comes after all others of its score;
    repeated document rows are documents of their own, repeated item rows give their rows each;
    texts are taken whole at any length; empty tables give no rows; other columns are not read."""
    src = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("length(text) > 0")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // query_bytes)
    src = src.withColumn("_b", F.pmod(F.xxhash64("text"), F.lit(max(1, blocks))))
    out = []
    for b in range(blocks):
        rows = src.where(F.col("_b") == b).orderBy("item_id", "text").collect()
        if rows:
            out.append(_search_block(docs, rows, k))
    return reduce(DataFrame.union, out) if out else docs.sparkSession.createDataFrame(
        [], "item_id long, rank int, doc_id long, score long")


def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


OP12_SQL = r"""
WITH dt AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
d AS (SELECT * FROM dt WHERE len(terms) > 0),
it AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
nl AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d),
m AS (SELECT r, doc_id, 10 + (90 * len(terms) * n) // l AS m FROM d, nl),
tok AS (SELECT r, unnest(terms) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM it) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, nl GROUP BY term, n),
s AS (SELECT q, item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM it JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
    doc_id, score FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
