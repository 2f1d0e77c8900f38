"""The registered queries of this package: name -> (fn(spark, sf_dir), SQL or None)."""

from __future__ import annotations

from chorus.llm import (decontamination, fingerprints, language_id, lexical_search, line_dedup, merkle, mixing, pii, sharding,
                        simhash, substring_dedup, token_counts, warc)
from chorus.llm.common import read


def _docs(fn):
    return lambda spark, sf_dir: fn(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": (_docs(substring_dedup.op1), substring_dedup.OP1_SQL),
    "op2_weighted_fingerprints": (_docs(fingerprints.op2), None),
    "op3_sharding": (_docs(sharding.op3), None),
    "op4_line_dedup": (_docs(line_dedup.op4), None),
    "op5_language_id": (_docs(language_id.op5), None),
    "op6_mixing": (_docs(mixing.op6), mixing.OP6_SQL),
    "op7_token_counts": (_docs(token_counts.op7), None),
    "op8_decontamination": (lambda spark, sf_dir: decontamination.op8(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")), None),
    "op9_simhash": (_docs(simhash.op9), None),
    "op10_warc": (lambda spark, sf_dir: warc.op10(read(spark, sf_dir, "pages")), warc.OP10_SQL),
    "op11_pii": (_docs(pii.op11), None),
    "op12_lexical_search": (lambda spark, sf_dir: lexical_search.op12(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")), lexical_search.OP12_SQL),
    "op13_merkle": (_docs(merkle.op13), merkle.OP13_SQL),
}
