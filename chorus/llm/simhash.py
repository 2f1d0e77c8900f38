"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where over half of a document's shingle hashes have
it. Documents with equal fingerprints are one class from the start (one row per
distinct fingerprint goes on), so a group of copies costs one row.

The pivots are reference fingerprints in sets, one set per block of bits: each
reference r has a twin r' that differs from r in the whole block, so the two
Hamming distances d(x, r) and d(x, r') give the distance inside the block,
(d(x, r) - d(x, r') + block bits) / 2. The distance table of x holds that
coordinate for every reference. By the triangle inequality no coordinate of two
fingerprints differs by more than their distance. So for fingerprints at most k
bits apart

- the coordinates of at least (blocks - k) blocks do not differ at all: the
  table's cells over every choice of that many blocks are the join keys;
- the maximum coordinate difference over the whole table is at most k: pairs in
  a cell that exceed it are discarded;
- survivors are verified by the distance itself.

Cells with one fingerprint are dropped before any pairing. A cell is compared in
numpy blocks and hands on a spanning forest of its links, never all pairs; a
cell above ``CELL_ROWS`` is dealt over several tasks as pairs of salts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import cut, drop_worker_cache, pieces, word_bounds
from chorus.llm.components import components

BITS = 64
CELL_ROWS = 4096
N_REFS = 8
PIECE = 1 << 20  # bytes of text fingerprinted at once


# ------------------------------------------------------------- fingerprints

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fingerprints(data: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """SimHash of each document of a piece (uint64)."""
    import xxhash
    data = _LOWER[data]
    starts, ends, first = word_bounds(data, offs)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(starts):
        return out
    # words joined by one space: every word and the byte after it (set to a space)
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens + 1)))
    buf = np.full(at[-1], 32, np.uint8)
    src = np.repeat(starts - at[:-1], lens)
    pos = np.arange(len(src)) + np.repeat(np.arange(len(lens)), lens)
    buf[pos] = data[pos + src]
    del src, pos
    raw = buf.tobytes()
    n = np.diff(first)
    digest = xxhash.xxh64_intdigest
    for d in np.flatnonzero(n):
        a, b = int(first[d]), int(first[d + 1])
        m = max(1, b - a - k + 1)
        lo, hi = at[a:a + m].tolist(), (at[min(a + k, b):b + 1] - 1).tolist()
        votes = np.zeros(BITS, np.int64)
        for i in range(0, m, 65536):
            h = np.array([digest(raw[x:y], 42) for x, y in zip(lo[i:i + 65536], hi[i:i + 65536])], "<u8")
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = np.packbits((2 * votes > m).astype(np.uint8), bitorder="little")
        out[d] = bits.view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of
    ``shingle`` words with repeats (fewer words: the whole sequence; no word: 0)."""
    def run(batches):
        import pyarrow as pa
        drop_worker_cache()
        for batch, a, b, data, offs in pieces(batches, limit=PIECE):
            fp = _fingerprints(data, offs, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(fp)], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------- pivot tables

def reference_sets(n_blocks: int, seed: int = 5, refs: int = N_REFS):
    """Per block: (first bit, bits, references, twins); fixed by the seed."""
    rng = np.random.default_rng(seed)
    edges = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        r = rng.integers(0, 1 << 63, refs, np.uint64) * np.uint64(2) + rng.integers(0, 2, refs, np.uint64)
        mask = np.uint64(((1 << (hi - lo)) - 1) << lo)
        out.append((lo, hi - lo, r, r ^ mask))
    return out


def distance_table(fp: np.ndarray, sets) -> np.ndarray:
    """int8 coordinates [fingerprint, block, reference] from Hamming distances."""
    table = np.empty((len(fp), len(sets), len(sets[0][2])), np.int8)
    for g, (_lo, bits, refs, twins) in enumerate(sets):
        d = np.bitwise_count(fp[:, None] ^ refs[None]).astype(np.int16)
        t = np.bitwise_count(fp[:, None] ^ twins[None]).astype(np.int16)
        table[:, g] = (d - t + bits) // 2
    return table


def _cells(max_bits: int, keep: int):
    """mapInArrow: one row per fingerprint and choice of ``keep`` blocks."""
    sets = reference_sets(max_bits + keep)
    choices = list(combinations(range(len(sets)), keep))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            table = distance_table(fp.view(np.uint64), sets).astype(np.uint64)
            block = np.zeros((len(fp), len(sets)), np.uint64)
            for j in range(table.shape[2]):
                block = block * np.uint64(BITS) + table[:, :, j]
            rows = []
            for c, choice in enumerate(choices):
                cell = np.full(len(fp), c, np.uint64)
                for g in choice:  # 64-bit digest of the coordinates; a clash only adds candidates
                    cell = (cell ^ block[:, g]) * np.uint64(0x9E3779B97F4A7C15)
                    cell ^= cell >> np.uint64(29)
                rows.append(cell.view(np.int64))
            rep = pa.array(np.tile(batch.column("rep").to_numpy(zero_copy_only=False), len(choices)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), rep, pa.array(np.tile(fp, len(choices)))],
                                             ["cell", "rep", "fp"])
    return run


def _forest(rep, fp, left, table, max_bits):
    """Links of a spanning forest of one cell part. ``left``: rows of the first salt
    (compared with all rows of the second), or None (all against all)."""
    n = len(fp)
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    out = []
    flat = table.reshape(n, -1)
    step = max(1, (1 << 22) // max(1, n * flat.shape[1] // 8))
    for i in range(0, n, step):
        far = np.zeros((min(step, n - i), n), bool)
        for j in range(flat.shape[1]):  # maximum coordinate difference
            c = flat[:, j]
            np.logical_or(far, np.abs(c[i:i + step, None] - c[None]) > max_bits, out=far)
        x, y = np.nonzero(~far)
        x += i
        ok = x < y
        if left is not None:
            ok &= left[x] != left[y]
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(fp[x] ^ fp[y]) <= max_bits  # verification
        for a, b in zip(x[ok].tolist(), y[ok].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def _pairs(max_bits: int, keep: int):
    """mapInArrow over rows sorted by (cell, p, q): groups may span batches; a group
    holds two salts of a cell, so at most about 2 * CELL_ROWS fingerprints."""
    sets = reference_sets(max_bits + keep)

    def links(cell):
        rep, fp, salt, p, q = (np.concatenate(x) for x in zip(*cell))
        if len(fp) == 2:
            ok = int(np.bitwise_count(fp[0] ^ fp[1])) <= max_bits
            return [(int(rep[0]), int(rep[1]))] if ok else []
        left = None if p[0] == q[0] else (salt == p[0])
        return [(int(rep[a]), int(rep[b])) for a, b in
                _forest(rep, fp, left, distance_table(fp, sets), max_bits)]

    def run(batches):
        import pyarrow as pa
        held, key = [], None

        def out(pairs):
            a, b = [min(x) for x in pairs], [max(x) for x in pairs]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "p", "q", "rep", "salt")}
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            n = batch.num_rows
            if not n:
                continue
            new = np.flatnonzero((c["cell"][1:] != c["cell"][:-1]) | (c["p"][1:] != c["p"][:-1])
                                 | (c["q"][1:] != c["q"][:-1])) + 1
            edges = [0, *new.tolist(), n]
            found = []
            for a, b in zip(edges, edges[1:]):
                k = (c["cell"][a], c["p"][a], c["q"][a])
                if k != key:
                    if held:
                        found += links(held)
                    held, key = [], k
                held.append((c["rep"][a:b], fp[a:b], c["salt"][a:b], c["p"][a:b], c["q"][a:b]))
            if found:
                yield out(found)
        if held and (found := links(held)):
            yield out(found)
    return run


def near_pairs(distinct: DataFrame, max_bits: int = 3, keep: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints (rep, fp) at most
    ``max_bits`` apart: a spanning forest of every cell's links, so components
    over them are those over all links."""
    cells = distinct.select("rep", "fp").mapInArrow(_cells(max_bits, keep), "cell long, rep long, fp long")
    count = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    salts = F.ceil(F.col("n") / cell_rows).cast("int")
    rows = (cells.join(count, "cell").withColumn("s", salts)
            .withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
            .select("cell", "rep", "fp", "salt", F.least("salt", "other").alias("p"),
                    F.greatest("salt", "other").alias("q")))
    dealt = rows.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    return dealt.mapInArrow(_pairs(max_bits, keep), "a long, b long").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): the smallest doc_id reachable over links of
    at most ``max_bits`` differing bits.

    Defined cases: null, empty and blank texts have fingerprint 0 and link like any
    other; rows that repeat a doc_id each keep their fingerprint, and the id joins
    their groups; a null doc_id links nothing and has a null component; a document
    without links is its own component; an empty table gives no rows. Columns other
    than doc_id and text are not read."""
    fps = cut(fingerprints(docs, shingle))
    known = fps.where("doc_id is not null")
    distinct = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = near_pairs(distinct, max_bits)
    twice = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = (known.join(twice, "doc_id").join(distinct, "fp").where("doc_id <> rep")
            .select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")))
    comp = components(links.union(same).distinct())
    reps = distinct.join(comp, distinct.rep == comp.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(reps, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Of each component of :func:`simhash_components` one row of ``docs``: the smallest by doc_id,
    null ids last, then by place in ``docs``, which must be written (a checkpoint or table), so
    that places stay the same.

    Rows are told apart by their place, not by doc_id: rows with a null id are linked like others,
    exact copies under one id leave one row, and rows of one id with different texts are
    judged each on its own. All columns pass unchanged, whatever their names; null, empty and
    blank texts are one component; an empty table gives no rows."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    comp = simhash_components(keyed.select(F.col(key).alias("doc_id"), "text"), shingle, max_bits) \
        .select(F.col("doc_id").alias("r"), "component_id")
    own = keyed.select(F.col(key).alias("r"), F.struct(F.col("doc_id").isNull(), "doc_id", key).alias("rank"))
    ranked = comp.join(own, "r")
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("least"), F.count("*").alias("n")).where("n > 1")
    drop = ranked.join(first, "component_id").where(F.col("r") != F.col(f"least.{key}")).select(F.col("r").alias(key))
    return keyed.join(drop, key, "left_anti").select(*docs.columns)


def op9(docs: DataFrame) -> DataFrame:
    out = simhash_components(docs, 3, 3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
