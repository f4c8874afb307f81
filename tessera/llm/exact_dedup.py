"""Exact dedup by a log-structured merge index of text digests.

A task collects digests in a memtable; a full memtable is flushed as a run, sorted by digest, with a Bloom filter. Runs are
written to the shared folder. Compaction merges the runs: per digest the identifier that stays and the number of rows. Rows
whose digest may be a hit are told by a filter of fixed size; only their texts move, and are compared byte by byte, so
that two texts with one digest stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash, write_table

#: Digests in a memtable, bits of a run's filter (8 a digest) and of the filter of hits (1 MB, whatever the input).
MEMTABLE_ROWS, RUN_BITS, HIT_BITS, PROBES = 1 << 14, 1 << 17, 1 << 23, 3
RUN_SCHEMA = "run string, digest long, keep_id long, n long, filter binary"


def probes(digests: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit places of every digest, as an array of (digests, PROBES)."""
    x = digests.astype(np.int64).view(np.uint64)
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    return np.stack([(low + np.uint64(i) * (high | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1) for i in range(PROBES)], axis=1).astype(np.int64)


def build_filter(digests: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    at = probes(digests, bits).ravel()
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def may_hold(filter_bytes: np.ndarray, digests: np.ndarray) -> np.ndarray:
    at = probes(digests, len(filter_bytes) * 8)
    return ((filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def flush_runs(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(digest, doc_id) rows to sorted runs; the first row of a run carries its filter."""

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def run() -> pa.RecordBatch:
            frame = pd.concat(held).groupby("digest", sort=True)["doc_id"].agg(keep_id="max", n="size").reset_index()
            filters = [build_filter(frame["digest"].to_numpy(np.int64), RUN_BITS).tobytes()] + [None] * (len(frame) - 1)
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{number}"] * len(frame)), pa.array(frame["digest"], pa.int64()), pa.array(frame["keep_id"].astype("Int64"), pa.int64(), from_pandas=True), pa.array(frame["n"], pa.int64()), pa.array(filters, pa.binary())], names=["run", "digest", "keep_id", "n", "filter"])

        for batch in batches:
            for at in range(0, batch.num_rows, memtable_rows):
                part = batch.slice(at, memtable_rows)
                held.append(pd.DataFrame({"digest": part.column(0).to_numpy(zero_copy_only=False), "doc_id": pd.array(part.column(1).to_pylist(), dtype="Int64")}))
                size += part.num_rows
                if size >= memtable_rows:
                    yield run()
                    held, size, number = [], 0, number + 1
        if size:
            yield run()

    return rows.select("digest", "doc_id").mapInArrow(flush, RUN_SCHEMA)


def compact(runs: DataFrame) -> DataFrame:
    """One level of distinct digests: the largest identifier and the number of rows; ordered by digest when written."""
    return runs.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def hit_filter(hits: DataFrame, bits: int = HIT_BITS) -> np.ndarray:
    """The filter of the digests of hits: at most bits / 64 rows of (word, mask) reach the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(probes(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "mask"])

    got = hits.select("digest").mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def maybe_in(spark, filter_bytes: np.ndarray, digest: str) -> Column:
    sent = spark.sparkContext.broadcast(filter_bytes)

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(may_hold(sent.value, x.to_numpy(np.int64)))

    return test(F.col(digest))


def exact_dedup(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; one row per row of docs, its other columns included.

    Texts are compared as they are, null as the empty text. The row with the largest doc_id of equal texts stays; a null
    doc_id is below all others, and of rows that agree in doc_id and text one stays. digest: another 64-bit digest of the
    column text, for tests of collisions. Columns of docs with the names of the result are replaced. Empty in, empty out.
    """
    spark = docs.sparkSession
    docs, others = stash(docs, ["doc_id", "text"], ("keep_id", "group_size", "kept", "text_sha256"))
    rows = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumns({"digest": F.xxhash64("_t") if digest is None else digest.cast("long"), "text_sha256": F.sha2(F.col("_t"), 256)})
    runs = write_table(flush_runs(rows), "lsm-runs")
    level = write_table(compact(runs).sortWithinPartitions("digest"), "lsm-level")
    hits = level.filter("n > 1").select("digest")
    rows = rows.withColumn("hit", maybe_in(spark, hit_filter(hits), "digest"))
    # equal bytes, not equal digests, make a class; copies are pre-aggregated before the shuffle
    texts = rows.filter("hit").join(hits, "digest", "left_semi").groupBy("digest", "_t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = write_table(texts, "lsm-verified")
    classes = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    alone = F.col("hit") & F.col("texts").isNotNull()
    joined = rows.join(classes, "digest", "left")
    plain = joined.filter(F.coalesce(F.col("texts"), F.lit(1)) == 1)
    plain = plain.withColumns({"keep_id": F.when(alone, F.col("keep_id")).otherwise(F.col("doc_id")), "group_size": F.when(alone, F.col("group_size")).otherwise(F.lit(1)).cast("long")}).drop("texts")
    clash = classes.filter("texts > 1").select("digest")
    clashing = rows.filter("hit").join(clash, "digest", "left_semi").join(texts, ["digest", "_t"])
    every = plain.unionByName(clashing).withColumn("stays", F.col("keep_id").eqNullSafe(F.col("doc_id")))
    # repeated rows: the same doc_id with the same text
    once = Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1))
    again = every.filter("stays and group_size > 1").withColumn("kept", F.row_number().over(once) == 1)
    rest = every.filter("not (stays and group_size > 1)").withColumn("kept", F.col("stays"))
    return rest.unionByName(again).select("doc_id", "text", *others, "keep_id", "group_size", "kept", "text_sha256")


def op3(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
