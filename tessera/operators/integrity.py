"""Hashes of folders and collections: order-independent ones as trees, order-sensitive ones as a fold over a sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import fnv1a64


def content_hash(rows: DataFrame, part: str, path: str, content: str, levels: tuple[int, ...] = (6, 3, 0)) -> DataFrame:
    """part, n_files, hash: a hash of a part's (path, content) pairs, whatever their order; repeated pairs count.

    A tree by prefixes of the pairs' own hashes: leaves with the same first six hex digits are hashed together, in order, then
    such nodes by three digits, then all. A node has at most 4,096 children, whatever the size of the part, but for the lowest,
    which have a 16-millionth of its rows. No part is gathered in one row or task.
    """
    leaf = F.sha2(F.concat_ws("\0", path, content), 256)
    nodes = rows.groupBy(part, leaf.alias("_name")).agg(F.count(F.lit(1)).alias("n_files"))
    nodes = nodes.withColumn("_line", F.concat("_name", F.lit(":"), F.col("n_files")))
    for level in levels:
        lines = F.array_join(F.array_sort(F.collect_list("_line")), "\n")
        nodes = nodes.groupBy(part, F.left("_name", F.lit(level)).alias("_name")).agg(F.sum("n_files").alias("n_files"), F.sha2(lines, 256).alias("hash"))
        nodes = nodes.withColumn("_line", F.concat("_name", F.lit(":"), "hash"))
    return nodes.select(part, "n_files", "hash")


def folder_hash(files: DataFrame, folder: str, path: str, content: str) -> DataFrame:
    """folder, hash (16 hex digits), n_files: FNV-1a over each folder's paths and contents, one after another in order of path.

    Paths are compared component by component. The fold takes rows in order, so a folder is one task's work, but that task holds one
    state and one row at a time: files are dealt by folder, sorted, and the state goes on from batch to batch. content may be
    text (hashed as UTF-8) or binary; null counts as empty.
    """
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = files.select(F.col(folder).cast("string").alias("folder"), F.col(path).cast("string").alias("path"), data.alias("content"))
    dealt = rows.repartition("folder").sortWithinPartitions("folder", F.split("path", "/"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n, started = None, None, 0, False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"folder": pa.array([at], pa.string()), "hash": [f"{state:016x}"], "n_files": [n]})

        for batch in batches:
            for name, where, body in zip(*(batch.column(i) for i in range(3))):
                if not started or name.as_py() != at:
                    if started:
                        yield out()
                    at, state, n, started = name.as_py(), fnv1a64(b""), 0, True
                state = fnv1a64(body.as_py(), fnv1a64((where.as_py() or "").encode(), state))
                n += 1
        if started:
            yield out()

    return dealt.mapInArrow(run, "folder string, hash string, n_files long").withColumnRenamed("folder", folder)


def first_folder(path: Column) -> Column:
    """The first component of a relative path; a file outside any folder is an error."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(F.raise_error(F.concat(F.lit("a file outside the folders: "), path)).cast("string"))
