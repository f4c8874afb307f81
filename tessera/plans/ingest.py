"""Incremental ingest: reuse vectors by key hash, embed the rest, merge, list orphans, stamp the manifest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import key_hash
from tessera.operators.integrity import content_hash
from tessera.operators.relational import merge, orphans, reuse
from tessera.schemas import IDENTITY


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed to signed buckets, L2-normalised: deterministic, and a text's vector does not depend on its batch."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                x = crc32(w.encode())
                out[i, x % self.dim] += 1 if x >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).astype(np.float32)


def same_identity(manifest: dict, identity: dict = IDENTITY) -> bool:
    """Vectors may be reused or searched only if model, width and strategy agree."""
    return all(manifest.get(k) == v for k, v in identity.items())


def embed(pending: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, key) to (id, embedding), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = embedder.embed(x["key"].tolist())
            if got.shape != (len(x), embedder.dim):
                raise ValueError(f"the embedder returned {got.shape} for {len(x)} texts of width {embedder.dim}")
            yield pd.DataFrame({"id": x["id"], "embedding": list(got)})

    return pending.select("id", "key").mapInPandas(run, "id string, embedding array<float>")


def ingest(documents: DataFrame, pack: DataFrame, embedder: Embedder, incremental: bool, cache_valid: bool = True) -> tuple[DataFrame, DataFrame]:
    """The new pack (id, embedding, document, key_hash) and the orphans. documents: id, key, document.

    Incremental collections keep records that left the tree (they are only listed); others are rebuilt without them.
    documents may bring the key_hash of their keys along.
    """
    current = documents if "key_hash" in documents.columns else documents.withColumn("key_hash", key_hash("key"))
    known = reuse(current, pack if cache_valid else pack.limit(0))
    pending = known.filter("embedding is null")
    fresh = current.join(embed(pending, embedder), "id")
    kept = known.filter("embedding is not null")
    columns = ["id", "embedding", "document", "key_hash"]
    records = kept.select(columns).unionByName(fresh.select(columns))
    gone = orphans(pack, documents, "id").select("id", "document")
    if incremental:
        records = merge(pack.select(columns), records.withColumn("_seq", F.lit(0)), gone.limit(0), "id", "_seq")
    return records, gone


def manifest(packs: DataFrame) -> DataFrame:
    """count, width and content hash of each kind; the hash is of sorted logical rows, not of files."""
    rows = packs.withColumn("line", F.concat_ws("|", "key_hash", F.to_json("embedding"), "document"))
    sizes = packs.groupBy("kind").agg(F.count(F.lit(1)).alias("count"), F.max(F.size("embedding")).alias("dim"))
    return sizes.join(content_hash(rows, "kind", "id", "line"), "kind").drop("n_files")
