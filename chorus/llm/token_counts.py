"""Token counts by trie-shared dynamic programming.

A unigram tokenizer splits a pre-token (a word with the space before it) into the
pieces whose log probabilities add up highest. The forward score of a prefix
depends on the prefix alone, so the distinct pre-tokens of a batch form a trie in
which every node's score and token count are computed once, however many
pre-tokens share it; terminal nodes give the counts. The trie is walked in sorted
order, which keeps only the path from the root in memory, and terminal counts are
remembered per Python worker in a bounded table.

The pieces are those of a public vocabulary file (a parameter); nothing is
trained. The file has ranks and no probabilities: rank r gets Zipf's law,
p = 1 / (r + 2) / H. All 256 bytes are pieces, so every text has a split."""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import pieces, worker_cache

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 400_000  # pre-tokens a worker remembers (some 60 MB)
LONGEST_KEPT = 64     # longer pre-tokens are counted but not remembered


def load_pieces(path: str = VOCABULARY) -> dict[bytes, float]:
    """Piece -> log probability, from lines of base64 piece and rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    h = math.log(sum(1 / (r + 2) for r in ranks.values()))
    return {p: -math.log(r + 2) - h for p, r in ranks.items()}


def count_pretokens(pretokens, score: dict[bytes, float], longest: int) -> dict[bytes, int]:
    """Tokens of the best split of each distinct pre-token (fewest among equal scores)."""
    out: dict[bytes, int] = {}
    best, count, last = [0.0], [0], b""
    for word in sorted(pretokens):
        n = len(word)
        shared = 0
        for x, y in zip(word, last):
            if x != y:
                break
            shared += 1
        del best[shared + 1:], count[shared + 1:]
        for end in range(shared + 1, n + 1):
            top, tokens = -math.inf, 0
            for start in range(max(0, end - longest), end):
                s = score.get(word[start:end])
                if s is not None:
                    s += best[start]
                    if s > top or (s == top and count[start] + 1 < tokens):
                        top, tokens = s, count[start] + 1
            best.append(top)
            count.append(tokens)
        out[word] = count[n]
        last = word
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) per document of (doc_id, text).

    White space only separates: every word [^\\x20\\x09-\\x0D]+ is one pre-token with one
    space before it. Defined cases: a null or blank text has 0 words and 0 tokens;
    rows that repeat an id each give a row; an empty table gives no rows; other
    columns are not read. The vocabulary is read by the driver and travels with the
    tasks (its size is the file's). Documents stay where they are: no shuffle."""
    score = load_pieces(vocabulary)
    longest = max(map(len, score))
    key = "tokens-" + hashlib.sha256(repr(sorted(score.items())).encode()).hexdigest()
    score = docs.sparkSession.sparkContext.broadcast(score)

    def run(batches):
        import pyarrow as pa
        known: dict[bytes, int] = worker_cache(key, dict)
        for batch, a, b, data, offs in pieces(batches):
            raw, at = data.tobytes(), offs.tolist()
            words = [raw[x:y].split() for x, y in zip(at, at[1:])]
            new = set().union(*words).difference(known)
            extra: dict[bytes, int] = {}
            if new:
                counted = count_pretokens([b" " + w for w in new], score.value, longest)
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = set().union(*words)
                    counted = count_pretokens([b" " + w for w in new], score.value, longest)
                for w, n in counted.items():
                    (known if len(w) <= LONGEST_KEPT and len(known) < REMEMBERED else extra)[w[1:]] = n
            total = [sum([known[w] if w in known else extra[w] for w in ws]) for ws in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(list(map(len, words)), pa.int64()),
                 pa.array(total, pa.int64())], ["doc_id", "n_words", "n_tokens"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long")


def op7(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
