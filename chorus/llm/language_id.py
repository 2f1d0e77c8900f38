"""Language identification by cross-parsing.

Labelled text of each language goes into a suffix automaton. A text is parsed
against every language: from each phrase start the automaton follows the longest
match, the next phrase starts after it. The phrases a language needs, times
log2 of its reference length (the price of naming a place in it) and per code
point, estimate the cross entropy; the language with the least wins.

Texts are parsed whole, in blocks of ``BLOCK`` code points (a phrase ends at a
block's end), so that numpy advances many blocks by one code point at a time.
The references are a bounded sample: ``DOCS`` labelled documents per language,
chosen by hash over all labelled documents, a run of ``RUN`` code points of
each.

Every language has codes for exactly the letters of its own reference; a letter it does
not know is a phrase of its own. Languages with up to ``LETTERS`` letters get a dense
table of steps, as long as all tables together stay within ``TABLE_BYTES``; the others,
and all beyond that size, step by search in the automaton's sorted edges, with equal
results, a few times slower and under a megabyte each."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import hash_key, pieces, worker_cache

DOCS, RUN = 40, 500      # bounds of the labelled sample, per language
BLOCK = 256              # code points parsed by one lane
LETTERS = 61             # most letters of a dense table
GAP, UNKNOWN, PAD = 0, 62, 63  # codes of non-letters, of foreign letters and of the end of a short block
WIDTH = 64
PIECE = 2 << 20
LANES = 4096             # blocks advanced together
TABLE_BYTES = 96 << 20   # all dense tables of a model


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Edges of every state; state 0 is the start."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def automaton(codes: list[int]) -> np.ndarray:
    """Parse table of a reference: [state * WIDTH + code] -> next state * WIDTH, with the
    number of phrases that end at this step in the two highest bits."""
    nxt = suffix_automaton(codes)
    root = np.full(WIDTH, 1 << 30, np.uint32)  # unknown character: a phrase of its own
    for c, s in nxt[0].items():
        root[c] = s * WIDTH
    table = np.empty((len(nxt), WIDTH), np.uint32)
    table[:] = root + np.uint32(1 << 30)       # no match: the phrase ends, another starts
    table[0] = root
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            table[s, c] = t * WIDTH
    table[:, PAD] = np.arange(len(nxt), dtype=np.uint32) * WIDTH
    return table.ravel()


class Language:
    """A reference, its letters and its automaton, dense or as sorted edges."""

    def __init__(self, text: str, letter: np.ndarray, lower: dict[int, int], dense: bool):
        ref = [lower.get(c, c) if letter[c] else -1 for c in map(ord, text)]
        own = sorted({c for c in ref if c >= 0})
        self.dense = dense and len(own) <= LETTERS
        self.price = math.log2(max(2, len(ref)))
        # codes of all code points: 0 for a gap, the letter's own number, else unknown
        number = {c: i + 1 for i, c in enumerate(own)}
        unknown = UNKNOWN if self.dense else len(own) + 1
        self.pad = PAD if self.dense else len(own) + 2
        self.codes = np.full(len(letter), GAP, np.uint8 if self.dense else np.int32)
        self.codes[letter] = unknown
        for c, i in number.items():
            self.codes[c] = i
        for c, low in lower.items():
            if low in number:
                self.codes[c] = number[low]
        coded = [number.get(c, GAP) for c in ref]
        if self.dense:
            self.table = automaton(coded)
            return
        nxt = suffix_automaton(coded)
        self.width = len(own) + 3
        edges = sorted((s * self.width + c, t) for s, e in enumerate(nxt) for c, t in e.items())
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
        self.root = np.zeros(self.width, np.int64)
        for c, t in nxt[0].items():
            self.root[c] = t

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each column of codes."""
        if self.dense:
            state, done = np.zeros(lanes.shape[1], np.uint32), np.zeros(lanes.shape[1], np.uint32)
            for row in lanes:
                step = self.table[state + row]
                done += step >> 30
                state = step & 0x3FFFFFFF
            return done.astype(np.int64) + (state != 0)
        state, done = np.zeros(lanes.shape[1], np.int64), np.zeros(lanes.shape[1], np.int64)
        for row in lanes:
            key = state * self.width + row
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            start = self.root[row]
            new = np.where(hit, self.to[at] if len(self.keys) else 0, start)
            ended = np.where(hit, 0, (state != 0).astype(np.int64) + (start == 0))
            held = row == self.pad
            done += np.where(held, 0, ended)
            state = np.where(held, state, new)
        return done + (state != 0)


class Model:
    """References by language; tables are built once per Python worker."""

    def __init__(self, references: dict[str, str], table_bytes: int = TABLE_BYTES):
        self.references = {k: references[k] for k in sorted(references)}
        self.table_bytes = table_bytes
        self.key = "lang-" + hashlib.sha256(repr((self.references, table_bytes)).encode()).hexdigest()

    def _build(self):
        n = 0x110000
        letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        lower = {i: ord(s) for i in np.flatnonzero(letter).tolist() if len(s := chr(i).lower()) == 1}
        lower = {i: c for i, c in lower.items() if i != c and letter[c]}
        # an automaton has at most two states per character
        dense = 2 * 4 * WIDTH * sum(map(len, self.references.values())) <= self.table_bytes
        return letter, [Language(text, letter, lower, dense) for text in self.references.values()]

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index or -1, score) of the documents of a piece."""
        letter, languages = worker_cache(self.key, self._build)
        n_docs = len(offs) - 1
        text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
        n = np.diff(ends)
        has = np.concatenate(([0], np.cumsum(letter[text])))
        known = has[ends[1:]] > has[ends[:-1]]
        best, score = np.full(n_docs, -1), np.zeros(n_docs)
        if not languages or not known.any():
            return best, score
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(n_docs), blocks)
        begin = ends[doc] + (np.arange(len(doc)) - (np.cumsum(blocks) - blocks)[doc]) * BLOCK
        cost = np.zeros((len(languages), n_docs))
        for i in range(0, len(doc), LANES):
            d = doc[i:i + LANES]
            at = begin[i:i + LANES][None] + np.arange(BLOCK)[:, None]
            outside = at >= ends[d + 1][None]
            chars = text[np.minimum(at, len(text) - 1)]
            for k, lang in enumerate(languages):
                lanes = lang.codes[chars]
                lanes[outside] = lang.pad
                cost[k] += np.bincount(d, lang.phrases(lanes), n_docs) * lang.price
        order = np.sort(cost, axis=0)
        best[known] = cost.argmin(axis=0)[known]
        score[known] = (1 - order[0] / np.maximum(order[1], 1e-9))[known] if len(languages) > 1 else 1.0
        return best, np.clip(score, 0, 1)


def train(labelled: DataFrame, docs: int = DOCS, run: int = RUN, seed: int = 3) -> Model:
    """Model of (doc_id, text, lang) rows with a non-null lang and a non-empty text. Only the
    sample reaches the driver: at most ``docs`` * ``run`` code points per language."""
    size = F.length("text")
    key = hash_key(seed, F.col("doc_id"), F.md5(F.col("text").cast("binary")))
    start = F.col("_key") % F.greatest(F.lit(1), size - run + 1) + 1
    rows = (labelled.where("lang is not null and length(text) > 0").select("lang", "text", key.alias("_key"))
            .select("lang", "_key", F.substring("text", start, F.lit(run)).alias("part"))
            .withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_key", "part")))
            .where(F.col("_n") <= docs).collect())
    parts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["_n"]):
        parts.setdefault(r["lang"], []).append(r["part"])
    return Model({k: "\n".join(v) for k, v in parts.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) per document of (doc_id, text).

    Defined cases: a null text, or one without a letter, is ``und`` with score 0, and
    so is every text if no language was learned; equal costs go to the language
    that sorts first; equal texts get equal results; an empty table gives no rows;
    a text of any length is parsed whole; other columns are not read. Score is
    1 - least / second least cost."""
    names = list(model.references)

    def run(batches):
        import pyarrow as pa
        for batch, a, b, data, offs in pieces(batches, limit=PIECE):
            best, score = model.predict(data, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array([names[i] if i >= 0 else "und" for i in best]),
                 pa.array(score)], ["doc_id", "lang_pred", "score"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has an identified language.

    Defined cases: null texts and texts without a letter go, and all rows go if no language
    was learned; repeated rows and null ids are kept like others; a text of any length is read
    whole; an empty table gives no rows; only ``text`` is read, other columns pass whatever
    their names."""
    def run(batches):
        import pyarrow as pa
        for batch, a, b, data, offs in pieces(batches, limit=PIECE):
            best, _ = model.predict(data, offs)
            yield batch.slice(a, b - a).filter(pa.array(best >= 0))
    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return docs.where(_fold("doc_id") != 1)


def _fold(col: str):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3


def op5(docs: DataFrame) -> DataFrame:
    out = identify(docs, train(training_rows(docs)))
    return out.select("doc_id", F.coalesce(_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
