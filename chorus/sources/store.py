"""The result store: four tables partitioned by run, JSON documents as VARIANT columns.

``save`` replaces the partitions of the runs its rows belong to and no others, so that a
rerun of one run leaves the rest of the store as it is. ``persisted`` keeps derived tables
between queries: they are written once per state of their input and read from then on."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.sources.sinks import output_root

RUN = "run_id"
DOCUMENTS = {"posts": ["raw_data"], "content": ["fetch_details"], "sentiment_analyses": ["full_results"]}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table (with its ``run_id``) partitioned by run; the JSON documents are parsed
    to VARIANT. Of what is stored already, only the runs that occur in the rows are replaced."""
    for name, df in tables.items():
        docs = {c: F.parse_json(c) for c in DOCUMENTS.get(name, ())}
        (df.withColumns(docs) if docs else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(RUN).parquet(os.path.join(path, name))


def load(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(path, n)) for n in names}


def input_state(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files' total size, number and last change: one call per path."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size = fs.getContentSummary(path)
        out.append((p, size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return hashlib.sha256(repr(out).encode()).hexdigest()[:16]


def persisted(spark: SparkSession, name: str, inputs: list[str],
              build: Callable[[str], list[str]]) -> dict[str, DataFrame]:
    """The tables of artefact ``name``, read back. ``build(path)`` writes them and returns their names;
    it runs only if no finished build of the present input is there. A build gets a
    folder of its own and counts once its entry is written, so a build that died is not
    read, and of two at a time the later entry wins."""
    root = os.path.join(output_root(spark), f"{name}-{input_state(spark, inputs)}")
    entry = os.path.join(root, "current")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(entry, "_SUCCESS"))
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        path = os.path.join(root, uuid.uuid4().hex[:12])
        names = build(path)
        spark.createDataFrame([(path, ",".join(names))], "path string, names string").coalesce(1) \
            .write.mode("overwrite").json(entry)
    row = spark.read.schema("path string, names string").json(entry).first()
    return load(spark, row["path"], row["names"].split(","))
