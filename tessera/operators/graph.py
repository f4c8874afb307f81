"""Graph operators over edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import shared_folder


def _written(df: DataFrame) -> DataFrame:
    """df from the shared folder, where it has been computed once (an eager checkpoint computes its last stage twice)."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with an edge; the component is its smallest node.

    Contraction by hashed order: in each round a node joins the neighbour (or itself) with the smallest hash, edges are renamed to what
    their ends joined, and repeats and loops fall away, so that each round works on what the last one left. The order is a new
    one in each round, so no numbering of a chain is a bad one. A node is named by a long, and by the hash of that long in the next round:
    xxhash64 maps longs one to one. The rounds end when no edge is left; then the names are joined back, last round first.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    kind, names = links.schema["a"].dataType.simpleString(), None
    if kind in ("tinyint", "smallint", "int", "bigint") and links.schema["b"].dataType.simpleString() == kind:
        links = _written(links.select(F.col("a").cast("long"), F.col("b").cast("long")))
    else:
        links = _written(links)
        names = _written(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().withColumn("n", F.monotonically_increasing_id()))
        for end in ("a", "b"):
            links = links.join(names.select(F.col("id").alias(end), F.col("n").alias(f"n{end}")), end)
        links = _written(links.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    rounds = []
    while not rounds or not links.isEmpty():
        ends = links.select("a", F.xxhash64("b").alias("low")).unionByName(links.select(F.col("b").alias("a"), F.xxhash64("a").alias("low")))
        rounds.append(_written(ends.groupBy("a").agg(F.min("low").alias("low")).select(F.col("a").alias("id"), F.least("low", F.xxhash64("a")).alias("joined"))))
        for end in ("a", "b"):
            links = links.join(rounds[-1].select(F.col("id").alias(end), F.col("joined").alias(f"n{end}")), end)
        links = _written(links.filter("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("id").alias("joined"), F.col("joined").alias("root"))
        labels = rounds.pop().join(later, "joined", "left").select("id", F.coalesce("root", "joined").alias("joined"))
    if names is not None:
        labels = names.join(labels.withColumnRenamed("id", "n"), "n").select("id", "joined")
    else:
        labels = labels.withColumn("id", F.col("id").cast(kind))
    labels = _written(labels)
    return labels.join(labels.groupBy("joined").agg(F.min("id").alias("component")), "joined").select("id", "component")
