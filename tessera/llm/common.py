"""Shared helpers: the folder all executors see, written intermediate tables, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, where a contract counts words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster has no folder that could be guessed, and raises.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again, so that a lost executor costs no upstream work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path  # type: ignore[attr-defined]
    settle(spark)
    return out


def drop_table(df: DataFrame) -> None:
    """Removes what write_table wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._tessera_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(fold: int) -> F.Column:
    """Whether crc32(doc_id as text) mod 5 is the fold; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == fold


def give_back() -> None:
    """Returns what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


#: When settle last ran, and the seconds between two runs at least.
_settled, SETTLE_S = float("-inf"), 10.0


def settle(spark: SparkSession) -> None:
    """Lets the driver go of plans, shuffles and broadcasts of jobs that have ended, at most once in SETTLE_S seconds.

    Its JVM would rather grow to its whole heap than collect them, and Python, whose frames refer to them, would keep what it has freed.
    """
    global _settled
    if time.monotonic() - _settled < SETTLE_S:
        return
    gc.collect()
    spark._jvm.java.lang.System.gc()
    give_back()
    _settled = time.monotonic()


def joined(texts: pa.Array, between: str | bytes = "\n") -> str | bytes:
    """The texts (or bytes, as between is) as one, made by Arrow: an object a text takes many times its room."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), pa.scalar(between, texts.type))[0].as_py()


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at its end the worker, which Spark keeps for later tasks, gives what it has freed back to the system."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return inner


def stash(df: DataFrame, own: list[str], replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list[F.Column]]:
    """df with the columns own and one struct of all others but replaced, whose names then clash with none, and the others again."""
    others = [c for c in df.columns if c not in (*own, *replaced)]
    packed = df.select(*own, F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("_rest"))
    return packed, [F.col("_rest").getField(c).alias(c) for c in others]
