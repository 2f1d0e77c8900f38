"""Merkle manifest of a data set, by checkpoint and recompute.

Every row is a leaf; the leaves of a source, ascending by doc_id, form a tree of
``ARITY`` children a node, and the sources' subroots form one more tree, whose
root names the whole data set. A digest is the lowercase hex SHA-256 of its
inputs' hex digits.

Only every ``STRIDE``-th level is persisted, as one row per aligned subtree: the
stored nodes of that level below one node of the next stored level (at most
``ARITY ** STRIDE`` of them). The levels between are never written. A proof is extracted
from the top down: each subtree row meets the one path of its own top node,
regenerates its missing interior nodes from the stored ones, emits the siblings of
each stored node with the path appended, and drops the interior nodes again. So
a leaf's siblings exist only inside the row that uses them, and what is
shuffled per leaf is its digest, not its proof.

Positions come from a range partitioning by (source, doc_id, leaf) that is written
once: a row's place is its place in its partition plus the number of rows of its
source in the partitions before. A hot source is many partitions, and every
group is an aligned subtree of bounded size. All steps are DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import cut, source_key

ARITY = 16
STRIDE = 2
PATH = "array<struct<left:string,right:string>>"  # siblings before and after, level by level
NO_ROWS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")


def field(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a documents row; ``text`` replaces the row's text."""
    return digest(F.concat(field(F.col("doc_id").cast("long")), field(F.col("source")), field(F.col("lang")),
                           field(F.col("n_chars").cast("long")), field(F.col("text") if text is None else text)))


def positions(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... inside ``tree`` in ``order``) and ``n`` (rows of the
    tree). No tree is ordered in one task."""
    placed = cut(rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
                 .select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_at")))
    parts = placed.groupBy(tree, "_pid").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(tree).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(tree, "_pid", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"),
                         F.sum("_rows").over(Window.partitionBy(tree)).alias("n"))
    return (placed.join(parts, [tree, "_pid"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_off"))
            .drop("_pid", "_at", "_first", "_off"))


def runs(nodes: Column, arity: int = ARITY) -> Column:
    """The parents of consecutive nodes: one per run of ``arity``, the last run may be shorter."""
    last = F.floor((F.size(nodes) - 1) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), last),
                       lambda r: digest(F.array_join(F.slice(nodes, r * arity + 1, F.lit(arity)), "")))


def with_levels(groups: DataFrame, stride: int = STRIDE, arity: int = ARITY) -> DataFrame:
    """Subtree rows with ``_l0`` (stored nodes), ``_l1`` ... ``_l<stride>`` regenerated above
    them. A level that the tree does not have repeats the one below."""
    out = groups.withColumn("_l0", F.col("nodes"))
    for i in range(stride):
        out = out.withColumn(f"_l{i + 1}", F.when(F.col("n") > arity ** i, runs(F.col(f"_l{i}"), arity))
                             .otherwise(F.col(f"_l{i}")))
    return out


def subtrees(level: DataFrame, payload: list[str], stride: int = STRIDE, arity: int = ARITY) -> DataFrame:
    """One stored row per aligned subtree of (tree, pos, n, node, payload): (tree, g, n,
    nodes, payload arrays), nodes in order."""
    g = F.floor(F.col("pos") / arity ** stride).cast("long").alias("g")
    rows = level.groupBy("tree", g, "n").agg(F.sort_array(F.collect_list(F.struct("pos", "node", *payload))).alias("_r"))
    return rows.select("tree", "g", "n", *(F.col(f"_r.{c}").alias("nodes" if c == "node" else c)
                                           for c in ["node", *payload]))


def build(leaves: DataFrame, payload: list[str], stride: int = STRIDE, arity: int = ARITY):
    """(stored levels from the leaves up, subroots (tree, subroot)) of every tree in
    (tree, pos, n, node, payload). A loop per stored level, ended by one number."""
    stored, tops, level = [], [], leaves
    span = arity ** stride
    while True:
        groups = cut(subtrees(level, payload if not stored else [], stride, arity))
        stored.append(groups)
        above = with_levels(groups, stride, arity).select(
            "tree", F.col("g").alias("pos"), "n", F.col(f"_l{stride}")[0].alias("node"))
        tops.append(above.where(F.col("n") <= span).select("tree", F.col("node").alias("subroot")))
        if (groups.agg(F.max("n")).first()[0] or 0) <= span:
            break
        level = above.where(F.col("n") > span).withColumn("n", F.ceil(F.col("n") / span).cast("long"))
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.union(t)
    return stored, roots


def _siblings(i: Column, up: int, arity: int) -> Column:
    """(left, right) of the ancestor ``up`` levels above stored node ``i`` of a subtree row."""
    at = F.floor(i / arity ** up).cast("int")
    first = (F.floor(at / arity) * arity).cast("int")
    nodes = F.col(f"_l{up}")
    return F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("left"),
                    F.array_join(F.slice(nodes, at + 2, first + arity - at - 1), "").alias("right"))


def _path(i: Column, stride: int, arity: int) -> Column:
    """Siblings of stored node ``i`` inside its subtree row, then the path of the row's top."""
    own = [F.when(F.col("n") > arity ** j, F.array(_siblings(i, j, arity))).otherwise(F.expr(f"cast(array() as {PATH})"))
           for j in range(stride)]
    return F.concat(*own, F.col("path"))


def paths(stored: list[DataFrame], root_paths: DataFrame, stride: int = STRIDE, arity: int = ARITY) -> DataFrame:
    """The leaves' subtree rows with their levels and ``path``, the siblings of the row's top
    node up to the root; ``root_paths`` (tree, path) holds those of each tree's subroot."""
    span = arity ** stride
    known = None  # (tree, g, path) of the tops of the next lower level's rows
    for k in range(len(stored) - 1, -1, -1):
        rows = stored[k]
        top = rows.where(F.col("n") <= span).join(root_paths, "tree")
        if known is not None:
            top = top.unionByName(rows.where(F.col("n") > span).join(known, ["tree", "g"]))
        groups = with_levels(top, stride, arity)
        if k:
            child = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.struct(
                (F.col("g") * span + i).alias("g"), _path(i, stride, arity).alias("path")))
            known = groups.select("tree", F.inline(child))
    return groups


def fold(node: Column, path: Column) -> Column:
    """The root recomputed from a node and its siblings."""
    return F.aggregate(path, node, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, changed: Column | None = None, stride: int = STRIDE, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of documents.

    ``changed`` is the text a row presents for verification (default: its own); leaf, subroot,
    root and proof are always those of the rows as they are. proof_sha256 is the
    digest of all siblings, level by level from the leaf to the root.

    Defined cases: a null in any column is hashed as ``-``; a null doc_id comes before all
    others of its source, a null source before all sources, an empty source or text is
    hashed as ``0:``; rows of one doc_id are ordered by their leaf; repeated rows are leaves
    of their own next to each other, with one leaf and each its own proof; a single
    leaf is its source's subroot and a single subroot the root; texts of any length
    are hashed whole; an empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    shown = leaf_digest(changed) if changed is not None else F.col("leaf")
    leaves = cut(docs.withColumn("leaf", leaf_digest()).select(
        F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("tree"), "leaf",
        F.nullif(shown, F.col("leaf")).alias("shown")))  # null: the leaf itself
    placed = positions(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    stored, subroots = build(placed.withColumn("node", F.col("leaf")), ["doc_id", "shown"], stride, arity)
    subroots = cut(subroots)
    # the tree of the subroots: "n" (null) sorts before "s<source>"
    top = positions(subroots.withColumn("all", F.lit("")), "all", [F.col("tree")])
    top_stored, top_root = build(top.select(F.col("all").alias("tree"), "pos", "n", F.col("subroot").alias("node"),
                                            F.col("tree").alias("source_tree")), ["source_tree"], stride, arity)
    root = top_root.first()
    if root is None:
        return spark.createDataFrame([], NO_ROWS)
    none = spark.range(1).select(F.lit("").alias("tree"), F.expr(f"cast(array() as {PATH})").alias("path"))
    rows = paths(top_stored, none, stride, arity)
    of_source = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.struct(
        F.get("source_tree", i).alias("tree"), F.get("nodes", i).alias("subroot"), _path(i, stride, arity).alias("path")))
    root_paths = cut(rows.select(F.inline(of_source)))
    groups = paths(stored, root_paths.select("tree", "path"), stride, arity)
    out = F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.struct(
        F.get("doc_id", i).alias("doc_id"), F.get("nodes", i).alias("leaf"),
        F.coalesce(F.get("shown", i), F.get("nodes", i)).alias("shown"), _path(i, stride, arity).alias("path")))
    leaf_rows = groups.select("tree", F.inline(out)).select(
        "tree", "doc_id", "leaf",
        digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")).alias("proof_sha256"),
        fold(F.col("shown"), F.col("path")).alias("folded_root"))
    return (leaf_rows.join(root_paths.select("tree", "subroot"), "tree")
            .select("doc_id", "leaf", "subroot", F.lit(root["subroot"]).alias("root"), "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.lit(root["subroot"])).alias("verified")))


def op13(docs: DataFrame) -> DataFrame:
    """The manifest, verified with A-Z lower-cased in the texts of rows whose decimal doc_id
    has a CRC-32 that 5 divides (a null doc_id has none)."""
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate("text", upper, upper.lower())
    return manifest(docs, F.when(F.coalesce(chosen, F.lit(False)), lower).otherwise(F.col("text")))


def op13_sql(levels: int = 10) -> str:
    """DuckDB twin: every level in full, up to 16 ** ``levels`` leaves a source and sources."""
    enc = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"

    def leaf(text):
        return "sha256(" + " || ".join(enc.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc_byte = "list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), {0})"
    crc = (f"xor(list_reduce([ascii(x) for x in string_split_regex(CAST(doc_id AS VARCHAR), '')], "
           f"lambda r, b: xor(r >> 8, t[1 + (xor(r, b) & 255)]), 4294967295::BIGINT), 4294967295)")
    out = [f"""
WITH tab AS (SELECT list_transform(range(256), lambda x: {crc_byte.format('x')}) AS t),
raw AS (SELECT doc_id, source, {leaf('text')} AS leaf,
    CASE WHEN {crc} % 5 = 0
         THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
         ELSE {leaf('text')} END AS shown
  FROM documents, tab),
a0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM raw),
id0 AS (SELECT row_number() OVER () AS r, doc_id, source, leaf, shown,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM raw)"""]

    def tree(p, key):
        """Levels ``p``0.. with siblings ``p``s0.. of a forest keyed by ``key``."""
        part = f"PARTITION BY {key}, pos // 16" if key else "PARTITION BY pos // 16"
        k = f"{key}, " if key else ""
        for i in range(levels):
            out.append(f"""{p}s{i} AS (SELECT {k}pos, n > 1 AS real,
    CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({part} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
    CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({part} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
  FROM {p}{i})""")
            out.append(f"""{p}{i + 1} AS (SELECT {k}pos // 16 AS pos, (n + 15) // 16 AS n,
    CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node
  FROM {p}{i} GROUP BY {k}pos // 16, n)""")
    tree("a", "source")
    out.append(f"""sub AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM a{levels})""")
    out.append("b0 AS (SELECT pos, count(*) OVER () AS n, subroot AS node FROM sub)")
    tree("b", "")
    prev, cols = "id0", "r, doc_id, source, leaf, shown, pos"
    out.append("f0 AS (SELECT id0.*, '' AS proof, shown AS acc FROM id0)")
    for i in range(levels):
        out.append(f"""f{i + 1} AS (SELECT f.r, f.doc_id, f.source, f.leaf, f.shown, f.pos,
    f.proof || s.l || s.r AS proof, CASE WHEN s.real THEN sha256(s.l || f.acc || s.r) ELSE f.acc END AS acc
  FROM f{i} f JOIN as{i} s ON s.source IS NOT DISTINCT FROM f.source AND s.pos = f.pos // {16 ** i})""")
    out.append(f"""g0 AS (SELECT f.*, sub.subroot, sub.pos AS spos FROM f{levels} f
  JOIN sub ON sub.source IS NOT DISTINCT FROM f.source)""")
    for i in range(levels):
        out.append(f"""g{i + 1} AS (SELECT f.doc_id, f.leaf, f.subroot, f.spos,
    f.proof || s.l || s.r AS proof, CASE WHEN s.real THEN sha256(s.l || f.acc || s.r) ELSE f.acc END AS acc
  FROM g{i} f JOIN bs{i} s ON s.pos = f.spos // {16 ** i})""")
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = node AS verified
FROM g{levels}, b{levels}"""


OP13_SQL = op13_sql()
