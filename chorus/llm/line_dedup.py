"""Line de-duplication by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, and two lines with
Jaccard similarity of at least 4/5 share a word in their prefixes of
n - ceil(4n/5) + 1 rarest words. Prefix entries meet by word; pairs there pass

- the length filter: 5 min(n) >= 4 max(n);
- the positional filter: the words still to come must allow the overlap
  ceil(4 (n1 + n2) / 9);
- a bitmap filter: 128 parity bits of the word sets (folded to 64 in lines of up to
  ``FOLD`` words) differ in no more places than the sets may differ in words. It never
  drops a true pair.

Lines that survive are fetched and the Jaccard similarity of their full word sets is
verified, in two rounds. First each later line meets its likeliest partner of each
bucket (fewest different parity bits). The lines that none of these matched then meet
all their other partners: listed ones, or, for a line with over ``SMALL`` partners in
a group, all paired lines of the group. A line goes if an earlier line, by (doc_id,
line number), matches it. Equal sets are collapsed first, in the task and then by hash, so a
line that a third of all documents share is one entry per task chunk.

Rarity comes from one pass over all documents: word counts in ``SLOTS`` hashed
slots (any fixed order gives the same result; a better one fewer candidates).
Words counted more than ``HOT`` times are dealt over several groups as pairs of
salts, so no word's lines meet in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import (
    cut, doc_ids, mix64, packed_parts, part_of, pieces, text_bytes, told_apart, unpack_part, word_bounds, word_codes)

SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
RANGES = 64
HOT = 200_000
CHUNK_LINES = 60_000
SMALL = 12    # most partners of a line in a group that are listed
FOLD = 72     # most words of a line described by 64 parity bits
STEPS = 4096  # largest group compared a distance at a time
BUCKET_BYTES = 16 << 20
PART_BYTES = 16 << 20
U = np.uint64


# ------------------------------------------------------------------ packing

def pack(*columns: np.ndarray) -> bytes:
    """Equal-length integer columns as byte planes; the first column as gaps."""
    n = len(columns[0])
    out = [np.array([n, len(columns)], "<u4").tobytes()]
    for i, c in enumerate(columns):
        c = c.astype(np.int64).view(U) if c.dtype != U else c
        if i == 0 and n:
            c = np.concatenate((c[:1], np.diff(c)))
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if n else 1
        p = np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        out += [bytes([width]), np.ascontiguousarray(p.T).tobytes()]
    return squeeze(b"".join(out))


def squeeze(raw: bytes) -> bytes:
    """zstd behind the length: parity bits and small gaps take a fraction of their bytes."""
    import pyarrow as pa
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(raw: bytes) -> list[np.ndarray]:
    import pyarrow as pa
    raw = pa.Codec("zstd").decompress(raw[4:], int.from_bytes(raw[:4], "little"), asbytes=True)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    at, out = 8, []
    for i in range(m):
        width = raw[at]
        p = np.zeros((n, 8), np.uint8)
        p[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        c = p.view("<u8")[:, 0]
        out.append(np.cumsum(c, dtype=U) if i == 0 else c)
        at += 1 + n * width
    return out


def _grouped(key: np.ndarray, *columns: np.ndarray):
    """(key, packed columns) per distinct key; rows sorted by the first two columns."""
    order = np.lexsort((*columns[1::-1], key))
    key, columns = key[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(key[a]), pack(*[c[a:b] for c in columns])


def parity(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits, in two halves, of the word sets that start at ``first``."""
    bit, half = U(1) << (code >> U(38) & U(63)), code >> U(37) & U(1)
    return tuple(np.bitwise_xor.reduceat(bit * (half == U(h)), first) for h in (0, 1))


def _rows(kinds, keys, raws):
    import pyarrow as pa
    for i in range(0, len(raws), 128):
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds[i:i + 128], pa.int32()), pa.array(keys[i:i + 128], pa.int64()),
             pa.array(raws[i:i + 128], pa.binary())], ["kind", "key", "data"])


ROW = "kind int, key long, data binary"
ENTRIES, REPORT, REQUEST, REST, LINK, MEMBER, WANT = range(7)


# ------------------------------------------------------------- lines of a piece

def _lines(data, offs):
    """(byte start, document, line number) of the lines of a piece."""
    nl = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((offs[:-1], nl + 1)))
    begin = begin[begin < max(len(data), 1)]
    # a line starting where a document starts belongs to the last document that starts there
    doc = np.searchsorted(offs[:-1], begin, "right") - 1
    first = np.searchsorted(begin, offs[:-1])
    return begin, doc, np.arange(len(begin)) - first[doc] if len(begin) else doc


def _line_sets(data, offs, begin, rarity=None, only=None):
    """Distinct words of the lines of a piece (those of the mask ``only``), by line and
    then rarity: (line of word, code, count)."""
    starts, ends, _ = word_bounds(data, offs)
    line = np.searchsorted(begin, starts, "right") - 1
    if only is not None:
        mine = only[line]
        line, starts, ends = line[mine], starts[mine], ends[mine]
    codes = word_codes(data, starts, ends)
    seen = rarity[(codes >> U(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64) if rarity is not None else np.zeros(len(codes), np.int64)
    order = np.lexsort((codes, (line << 31) + seen))  # counts stay below 2^31
    line, codes, seen = line[order], codes[order], seen[order]
    if len(line):
        new = np.concatenate(([True], (line[1:] != line[:-1]) | (codes[1:] != codes[:-1])))
        line, codes, seen = line[new], codes[new], seen[new]
    return line, codes, seen


def _count(batches):
    """Word counts of a task by slot, as RANGES rows."""
    counts = np.zeros(SLOTS, np.int32)
    for _batch, _a, _b, data, offs in pieces(batches):
        starts, ends, _ = word_bounds(data, offs)
        at, n = np.unique((word_codes(data, starts, ends) >> U(64 - SLOT_BITS)).astype(np.int64), return_counts=True)
        counts[at] += n.astype(np.int32)
    parts = counts.reshape(RANGES, -1)
    used = [np.flatnonzero(p) for p in parts]
    yield from _rows([0] * RANGES, list(range(RANGES)), [pack(u, p[u]) for u, p in zip(used, parts)])


def _add(key, table):
    import pyarrow as pa
    total = np.zeros(SLOTS // RANGES, np.int64)
    for x in table.column("data"):
        at, n = unpack(x.as_py())
        total[at.astype(np.int64)] += n.astype(np.int64)
    total = np.minimum(total, 0x7FFFFFFF)
    return pa.table({"kind": pa.array([0], pa.int32()), "key": pa.array([key[0].as_py()], pa.int64()),
                     "data": pa.array([total.astype("<i4").tobytes()], pa.binary())})


def word_rarity(docs: DataFrame) -> np.ndarray:
    """Counts of the SLOTS hashed slots over all documents (16 MB at any input size)."""
    rows = docs.mapInArrow(_count, ROW).groupBy("key").applyInArrow(_add, ROW).collect()
    out = np.zeros((RANGES, SLOTS // RANGES), np.int32)
    for r in rows:
        out[r["key"]] = np.frombuffer(r["data"], "<i4")
    return out.ravel()


# ------------------------------------------------------------------ 1. entries

def _entries(rarity, n_buckets, n_parts):
    """Prefix entries by bucket; repeats within the chunk are reported at once."""
    def flush(held):
        ids, number, n, bits, more, digest, words, codes, seen, place = held
        ids, number, n, bits, more, digest = (np.concatenate(x) for x in (ids, number, n, bits, more, digest))
        codes, seen, place = (np.concatenate(x) for x in (codes, seen, place))
        kinds, keys, raws = [], [], []
        order = np.lexsort((number, ids, n, bits, digest))
        same = np.concatenate(([False], (digest[order][1:] == digest[order][:-1]) & (bits[order][1:] == bits[order][:-1])
                               & (n[order][1:] == n[order][:-1])))
        first = order[np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))]
        later = order[same & ((ids[order] != ids[first]) | (number[order] != number[first]))]
        for part, raw in _grouped(part_of(ids[later], n_parts), ids[later], number[later]):
            kinds.append(REPORT)
            keys.append(part)
            raws.append(raw)
        own = np.zeros(len(ids), bool)
        own[order[~same]] = True
        line = np.repeat(np.arange(len(ids)), np.concatenate(words))
        keep = own[line] & (seen > 1)  # a word that occurs once has no partner
        line, codes, seen, place = line[keep], codes[keep], seen[keep], place[keep]
        # words counted over HOT times: every pair of salts is a group of its own
        salts = np.maximum(1, -(-seen // HOT))
        salt = (mix64(digest[line]) % salts.astype(U)).astype(np.int64)
        at = np.repeat(np.arange(len(line)), salts)
        other = np.arange(len(at)) - np.repeat(np.cumsum(salts) - salts, salts)
        p, q = np.minimum(salt[at], other), np.maximum(salt[at], other)
        group = mix64(codes[at] + p.astype(U) * U(0xD6E8FEB86659FD93) + q.astype(U) * U(0xA0761D6478BD642F))
        line = line[at]
        for b, raw in _grouped((group >> U(40)).astype(np.int64) % n_buckets, ids[line], number[line],
                               group & U(0xFFFFFFFF), n[line], place[at], bits[line], more[line], digest[line] & U(0xFFFFFFFFFF)):
            kinds.append(ENTRIES)
            keys.append(b)
            raws.append(raw)
        yield from _rows(kinds, keys, raws)

    def run(batches):
        held = [[] for _ in range(10)]
        total = 0
        for batch, a, b, data, offs in pieces(batches):
            begin, doc, number = _lines(data, offs)
            line, codes, seen = _line_sets(data, offs, begin, rarity)
            if not len(line):
                continue
            first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            n = np.diff(np.concatenate((first, [len(line)])))
            bits, more = parity(codes, first)
            short = n <= FOLD
            bits, more = np.where(short, bits ^ more, bits), np.where(short, U(0), more)
            place = np.arange(len(line)) - np.repeat(first, n)
            prefix = place < np.repeat(n - (4 * n + 4) // 5 + 1, n)
            which = line[first]
            for h, x in zip(held, (doc_ids(batch, a, b, "uid")[doc[which]], number[which], n,
                                   bits, more,
                                   np.add.reduceat(mix64(codes), first),
                                   np.add.reduceat(prefix.astype(np.int64), first),
                                   codes[prefix], seen[prefix], place[prefix])):
                h.append(x)
            total += len(which)
            if total >= CHUNK_LINES:
                yield from flush(held)
                held, total = [[] for _ in range(10)], 0
        if total:
            yield from flush(held)
    return run


# ---------------------------------------------------------------- 2. candidates

def _passing(n, place, bits, more, i, j):
    """Length, positional and bitmap filters of pairs (i, j), and their different parity bits."""
    a, b = n[i], n[j]
    need = (4 * (a + b) + 8) // 9
    ok = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
    ok &= np.minimum(place[i], place[j]) + 1 + np.minimum(a - place[i], b - place[j]) - 1 >= need
    x, y = bits[i] ^ bits[j], more[i] ^ more[j]
    far = np.where(np.minimum(a, b) <= FOLD, np.bitwise_count(x ^ y), np.bitwise_count(x) + np.bitwise_count(y))
    ok &= far <= a + b - 2 * need
    return ok, far


def _own(ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Name of the group in which a later line meets its partners; names of whole groups lack the top bit."""
    return mix64(ids.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + number.astype(U)) | U(1 << 63)


def _unique(n_parts, ids, number, group):
    """Distinct requests by document part."""
    order = np.lexsort((group, number, ids))
    ids, number, group = ids[order], number[order], group[order]
    if len(ids):
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (number[1:] != number[:-1]) | (group[1:] != group[:-1])))
        ids, number, group = ids[new], number[new], group[new]
    return _grouped(part_of(ids, n_parts), ids, number, group)


def _requests(n_parts, ids, number, y, x):
    """Distinct requests of lines x and their partners y under the names of x."""
    both = np.concatenate((y, x))
    own = _own(ids[x], number[x])
    return _unique(n_parts, ids[both], number[both], np.concatenate((own, own)))


def _candidates(n_parts):
    """One bucket of entries: repeated sets are reported, every later line is requested with its
    likeliest partner, and its other partners are noted under the part of its document."""
    def run(key, table):
        import pyarrow as pa
        kinds, keys, raws, held = [], [], [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data")):
            if kind == ENTRIES:
                held.append(unpack(data.as_py()))
        if held:
            ids, number, group, n, place, bits, more, digest = (np.concatenate(x) for x in zip(*held))
            del held
            order = np.argsort(group, kind="stable")
            same = group[order][1:] == group[order][:-1]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            ids, number, n, place = (x[order].astype(np.int64) for x in (ids, number, n, place))
            group, bits, more, digest = group[order], bits[order], more[order], digest[order]
            order = np.lexsort((number, ids, place, digest, group))
            ids, number, group, n, place, bits, more, digest = (
                x[order] for x in (ids, number, group, n, place, bits, more, digest))
            again = np.zeros(len(ids), bool)
            # one place: a line whose own words share a group's name keeps an entry for each
            again[1:] = (group[1:] == group[:-1]) & (place[1:] == place[:-1]) & (digest[1:] == digest[:-1]) & (bits[1:] == bits[:-1]) & (n[1:] == n[:-1])
            first = np.maximum.accumulate(np.where(~again, np.arange(len(ids)), 0)) if len(ids) else ids
            later = again & (place == 0) & ((ids != ids[first]) | (number != number[first]))
            for part, raw in _grouped(part_of(ids[later], n_parts), ids[later], number[later]):
                kinds.append(REPORT)
                keys.append(part)
                raws.append(raw)
            order = np.flatnonzero(~again)
            order = order[np.lexsort((number[order], ids[order], group[order]))]  # partners before later lines
            ids, number, group, n, place, bits, more = (x[order] for x in (ids, number, group, n, place, bits, more))
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(ids) else np.zeros(1, int)
            size = np.diff(edges)
            times, near = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            least, paired = np.full(len(ids), 255, np.uint8), np.zeros(len(ids), bool)
            listed = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

            def note(y, x):
                """Pairs of a line y and a later line x that pass; no x occurs twice in a call."""
                ok, far = _passing(n, place, bits, more, y, x)
                ok &= (ids[y] != ids[x]) | (number[y] != number[x])
                y, x, far = y[ok], x[ok], far[ok]
                paired[y] = True
                times[x] += 1
                closer = far < least[x]
                least[x[closer]], near[x[closer]] = far[closer], y[closer]
                few = times[x] <= SMALL
                listed.append((y[few], x[few]))
            # each line against the following ones of its group, a distance at a time
            left = np.repeat(edges[1:], size) - np.arange(len(ids)) - 1
            i, d = np.flatnonzero(np.repeat(size <= STEPS, size) & (left > 0)), 1
            while len(i):
                note(i, i + d)
                d += 1
                i = i[left[i] >= d]
            for g in np.flatnonzero(size > STEPS):
                for y in range(edges[g], edges[g + 1] - 1):
                    x = np.arange(y + 1, edges[g + 1])
                    note(np.full(len(x), y), x)
            x = np.flatnonzero(times)
            for part, raw in _requests(n_parts, ids, number, near[x], x):
                kinds.append(REQUEST)
                keys.append(part)
                raws.append(raw)
            y, x = (np.concatenate(c) for c in zip(*listed))
            other = (times[x] <= SMALL) & (near[x] != y)
            y, x = y[other], x[other]
            for part, raw in _grouped(part_of(ids[x], n_parts), ids[x], number[x], ids[y], number[y]):
                kinds.append(REST)
                keys.append(part)
                raws.append(raw)
            # lines with many partners: the paired lines of their groups; equal groups get one name
            of = np.repeat(np.arange(len(size)), size)
            many = np.zeros(len(size), bool)
            many[of[times > SMALL]] = True
            w = np.flatnonzero(many[of] & (paired | (times > 0)))
            if len(w):
                cuts = np.flatnonzero(np.concatenate(([True], of[w][1:] != of[w][:-1])))
                name = np.zeros(len(size), U)
                name[of[w[cuts]]] = mix64(np.add.reduceat(_own(ids[w], number[w]), cuts)) >> U(1)
                for part, raw in _grouped((name[of[w]] % U(n_parts)).astype(np.int64), ids[w], number[w], name[of[w]]):
                    kinds.append(MEMBER)
                    keys.append(part)
                    raws.append(raw)
                x = np.flatnonzero(times > SMALL)
                for part, raw in _grouped(part_of(ids[x], n_parts), ids[x], number[x], name[of[x]]):
                    kinds.append(LINK)
                    keys.append(part)
                    raws.append(raw)
        for kind, k, data in zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("data")):
            if kind == REPORT:
                kinds.append(kind)
                keys.append(k)
                raws.append(data.as_py())
        return pa.table({"kind": pa.array(kinds, pa.int32()), "key": pa.array(keys, pa.int64()),
                         "data": pa.array(raws, pa.binary())})
    return run


# --------------------------------------------------------------- 3. verification

def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices start[j], ..., start[j] + n[j] - 1 of all j, in order."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _pack_sets(g, i, k, n, codes) -> list[bytes]:
    """Lines (group, document, line number, words) and their sorted codes: the distinct
    codes once, then every line's places among them, as gaps of one rising sequence."""
    known, at = np.unique(codes, return_inverse=True)
    at = at + np.repeat(np.arange(len(n)) * len(known), n)
    return [pack(g, i, k, n), pack(known), pack(at)]


def _unpack_sets(lines, known, at):
    g, i, k, n = unpack(lines)
    known, at = unpack(known)[0], unpack(at)[0].astype(np.int64)
    n = n.astype(np.int64)
    return g, i.astype(np.int64), k.astype(np.int64), n, known[at - np.repeat(np.arange(len(n)) * len(known), n)]


SETS = "key long, lines binary, known binary, places binary"


def _fetch(n_buckets):
    """Word sets (codes of 40 bits) of the requested lines of a part of the documents, by bucket."""
    def run(key, docs, requests):
        import pyarrow as pa
        out = []
        held = [unpack(x.as_py()) for x in requests.column("data")]
        if held and docs.num_rows:
            ids, number, group = (np.concatenate(x) for x in zip(*held))
            ids, number, group = unpack(next(_unique(1, ids.astype(np.int64), number.astype(np.int64), group))[1])
            ids, number = ids.astype(np.int64), number.astype(np.int64)
            known = np.unique(ids)
            asked = (np.searchsorted(known, ids) << 40) + number  # rises: requests are sorted
            got = []
            for rb, a, b, data, offs in pieces(unpack_part(docs)):
                begin, doc, num = _lines(data, offs)
                own = doc_ids(rb, a, b, "uid")[doc]
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                mine = (place << 40) + num
                low, high = np.searchsorted(asked, mine, "left"), np.searchsorted(asked, mine, "right")
                wanted = (known[place] == own) & (high > low)
                line, codes, _ = _line_sets(data, offs, begin, only=wanted)
                at = np.searchsorted(line, np.arange(len(doc) + 1))
                times = np.where(wanted & (at[1:] > at[:-1]), high - low, 0)
                x, req = np.repeat(np.arange(len(doc)), times), _ragged(low, times)
                n = (at[1:] - at[:-1])[x]
                got.append((group[req], ids[req], number[req], n, codes[_ragged(at[:-1][x], n)] >> U(24)))
            g, i, k, n, code = (np.concatenate(x) for x in zip(*got))
            start, bucket = np.cumsum(n) - n, (g % U(n_buckets)).astype(np.int64)
            order = np.lexsort((k, i, g, bucket))
            edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0, [True]))) if len(g) else []
            for p, q in zip(edges[:-1], edges[1:]):
                w = order[p:q]
                out.append([int(bucket[w[0]]), *_pack_sets(g[w], i[w], k[w], n[w], code[_ragged(start[w], n[w])])])
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                        ["key", "lines", "known", "places"])
    return run


def _verify(n_parts):
    """Lines of a bucket with an earlier line of Jaccard similarity >= 4/5 in their group."""
    def run(key, table):
        import pyarrow as pa
        held = [_unpack_sets(*(x.as_py() for x in row)) for row in zip(*(table.column(c) for c in ("lines", "known", "places")))]
        g, i, k, n, code = (np.concatenate(x) for x in zip(*held))
        del held
        start = np.cumsum(n) - n
        order = np.lexsort((np.add.reduceat(mix64(code), start), n, k, i, g))
        g, i, k, n, start = (x[order] for x in (g, i, k, n, start))
        # equal rows have one uid: one line per number
        one = np.concatenate(([True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1])))
        g, i, k, n, start = (x[one] for x in (g, i, k, n, start))
        code = code[_ragged(start, n)]
        end = np.cumsum(n)
        first = end - n
        bits, more = parity(code << U(24), first)
        edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        gone = np.zeros(len(first), bool)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            sets: dict[int, frozenset] = {}

            def words(x):
                if x not in sets:
                    sets[x] = frozenset(code[first[x]:end[x]].tolist())
                return sets[x]
            for x in range(a + 1, b):
                need = (4 * (n[a:x] + n[x]) + 8) // 9
                far = np.bitwise_count(bits[a:x] ^ bits[x]).astype(np.int64) + np.bitwise_count(more[a:x] ^ more[x])
                y = np.flatnonzero((far <= n[a:x] + n[x] - 2 * need) & (5 * np.minimum(n[a:x], n[x]) >= 4 * np.maximum(n[a:x], n[x])))
                for z in y[np.argsort(far[y], kind="stable")].tolist():  # likeliest first
                    if len(words(x) & words(a + z)) >= need[z]:
                        gone[x] = True
                        break
        ids, number = i[gone], k[gone]
        kinds, keys, raws = [], [], []
        for part, raw in _grouped(part_of(ids, n_parts), ids, number):
            kinds.append(REPORT)
            keys.append(part)
            raws.append(raw)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "key": pa.array(keys, pa.int64()),
                         "data": pa.array(raws, pa.binary())})
    return run


def _open(n_parts):
    """A part of the documents after the first round: the reports of that round, requests of the
    lines it did not match with their other partners, and the names of the groups they want."""
    def run(key, rest, reports):
        import pyarrow as pa
        raws = reports.column("data").to_pylist()
        kinds, keys = [REPORT] * len(raws), [p.as_py() for p in reports.column("key")]
        gone = [unpack(x) for x in raws]
        gone = np.concatenate([_own(*x) for x in gone]) if gone else np.zeros(0, U)
        pairs, links = [], []
        for kind, data in zip(rest.column("kind").to_pylist(), rest.column("data")):
            c = unpack(data.as_py())
            still = ~np.isin(_own(c[0], c[1]), gone)
            if kind == REST:
                pairs.append([x[still].astype(np.int64) for x in c])
            else:
                links.append(c[2][still])
        if pairs:
            i, k, j, m = (np.concatenate(x) for x in zip(*pairs))
            at = np.arange(len(i))
            for part, raw in _requests(n_parts, np.concatenate((i, j)), np.concatenate((k, m)), at + len(i), at):
                kinds.append(REQUEST)
                keys.append(part)
                raws.append(raw)
        wanted = np.unique(np.concatenate(links)) if links else np.zeros(0, U)
        for part, raw in _grouped((wanted % U(n_parts)).astype(np.int64), wanted, wanted):
            kinds.append(WANT)
            keys.append(part)
            raws.append(raw)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "key": pa.array(keys, pa.int64()),
                         "data": pa.array(raws, pa.binary())})
    return run


def _members(n_parts):
    """Requests of the lines of the wanted groups."""
    def run(key, members, wanted):
        import pyarrow as pa
        kinds, keys, raws = [], [], []
        if members.num_rows and wanted.num_rows:
            names = np.concatenate([unpack(x.as_py())[0] for x in wanted.column("data")])
            held = [unpack(x.as_py()) for x in members.column("data")]
            ids, number, name = (np.concatenate(x) for x in zip(*held))
            mine = np.isin(name, names)
            for part, raw in _unique(n_parts, ids[mine].astype(np.int64), number[mine].astype(np.int64), name[mine]):
                kinds.append(REQUEST)
                keys.append(part)
                raws.append(raw)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "key": pa.array(keys, pa.int64()),
                         "data": pa.array(raws, pa.binary())})
    return run


# -------------------------------------------------------------------- 4. rewriting

def _rewrite(key, docs, reports):
    import pyarrow as pa
    held = [unpack(x.as_py()) for x in reports.column("data")]
    gone: dict[int, set] = {}
    for ids, number in held:
        for i, k in zip(ids.astype(np.int64).tolist(), number.tolist()):
            gone.setdefault(i, set()).add(k)
    doc, n, dropped, kept = [], [], [], []
    for i, uid, text in (row for batch in unpack_part(docs) for row in zip(
            batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), batch.column("text"))):
        doc.append(i)
        lines = (text.as_py() or "").split("\n")
        out = gone.get(uid, ())
        rest = [x for j, x in enumerate(lines) if j not in out] if out else lines
        n.append(len(lines) if text.is_valid else 0)
        dropped.append(len(lines) - len(rest))
        kept.append("\n".join(rest))
    return pa.table([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()),
                     pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) per document of (doc_id, text): lines with
    an earlier line of Jaccard similarity 0.8 or more go (judged on the input).

    Lines end at a line feed; words are [^\\x20\\x09-\\x0D]+, unchanged. Defined cases: a
    null text has no line and an empty one has one; lines without a word always stay;
    a null doc_id sorts last; rows of one doc_id (or of none) with different texts are
    documents of their own, in the order of their texts' digests, and equal ones are one
    document with one result; a text of any length is read whole; an empty table gives no
    rows; other columns are not read. Words are compared by 64-bit codes when sets are
    collapsed (128 bits of digest a set) and by 40 bits of them when Jaccard is verified."""
    docs = told_apart(docs)
    size = text_bytes(docs)
    n_buckets, n_parts = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // PART_BYTES))
    rarity = docs.sparkSession.sparkContext.broadcast(word_rarity(docs))

    def entries(batches):
        return _entries(rarity.value, n_buckets, n_parts)(batches)
    found = docs.mapInArrow(entries, ROW).select(
        "kind", "data", F.col("key").alias("part"), F.pmod("key", F.lit(n_buckets)).alias("bucket"))
    found = cut(found.groupBy("bucket").applyInArrow(_candidates(n_parts), ROW))
    homes = packed_parts(docs, n_parts, level=1).groupBy("part")

    def verified(requests):
        sets = homes.cogroup(requests.groupBy("key")).applyInArrow(_fetch(max(1, n_buckets // 2)), SETS)
        return sets.groupBy("key").applyInArrow(_verify(n_parts), ROW)

    def of(rows, *kinds):
        return rows.where(F.col("kind").isin(*kinds))
    first = verified(of(found, REQUEST))
    opened = of(found, REST, LINK).groupBy("key").cogroup(first.groupBy("key")).applyInArrow(_open(n_parts), ROW)
    members = of(found, MEMBER).groupBy("key").cogroup(of(opened, WANT).groupBy("key")).applyInArrow(_members(n_parts), ROW)
    second = verified(of(opened, REQUEST).union(members))
    reports = of(found, REPORT).union(of(opened, REPORT)).union(second)
    return homes.cogroup(reports.groupBy("key")).applyInArrow(
        _rewrite, "doc_id long, n_lines long, n_removed long, kept_text string")


def op4(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed",
                                   F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
