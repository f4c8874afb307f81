"""Inverted index over citations, co-citation graph, related documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.legal import canonical_citation
from tessera.operators.graph import connected_components
from tessera.operators.relational import number_all


def inverted_index(mentions: DataFrame) -> DataFrame:
    """canon_key, display (first seen by seq, ties to the smaller text), occurrences, variants and n_docs, of (canon_key, display, variant, doc, seq).

    The documents of a key are rows, see postings: a frequent key has too many for one.
    """
    heads = mentions.groupBy("canon_key").agg(F.min_by("display", F.struct("seq", "display")).alias("display"), F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("variant")).alias("variants"))
    return heads.join(postings(mentions).groupBy("canon_key").agg(F.count(F.lit(1)).alias("n_docs")), "canon_key")


def postings(mentions: DataFrame) -> DataFrame:
    """(canon_key, doc), each pair once."""
    return mentions.select("canon_key", "doc").distinct()


def canonicalise(rows: DataFrame, text: str) -> DataFrame:
    """rows with canon_key and display of the citation in the column text; each distinct text is canonicalised once and joined back.

    The distinct texts are checkpointed, so that no later filter makes Catalyst copy the long expression.
    """
    known = rows.select(F.col(text).alias("_text")).distinct().withColumn("_canon", canonical_citation(F.col("_text"))).checkpoint()
    return rows.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").select(*rows.columns, "_canon.canon_key", "_canon.display")


def mode_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def degree_filter(mentions: DataFrame, least: int) -> DataFrame:
    """Distinct (doc, key) of keys that least documents or more cite; applied before pairs are made."""
    rows = mentions.select("doc", "key").distinct()
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("key"), "key", "left_semi")


def cocitation_pairs(mentions: DataFrame, least_docs: int, least_weight: int) -> DataFrame:
    """(a, b, w): how many documents cite both keys, a < b."""
    rows = degree_filter(mentions, least_docs)
    pairs = rows.select("doc", F.col("key").alias("a")).join(rows.select("doc", F.col("key").alias("b")), "doc").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= least_weight)


def top_themes(themes: DataFrame, n: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """The n themes of most documents, ties by name, with their rank from 0."""
    counts = themes.filter(~F.col("theme").isin(*stop) if stop else F.lit(True)).select("doc", "theme").distinct().groupBy("theme").agg(F.count(F.lit(1)).alias("docs"))
    top = counts.orderBy(F.desc("docs"), "theme").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("docs"), "theme")) - 1)  # at most n rows


def theme_edges(themes: DataFrame, top: DataFrame, mentions: DataFrame, backbone: DataFrame, least: int) -> DataFrame:
    """(theme, key, w): documents with the theme that cite the key, for top themes and keys of the backbone."""
    t = themes.select("doc", "theme").distinct().join(F.broadcast(top.select("theme")), "theme", "left_semi")
    k = mentions.select("doc", "key").distinct().join(backbone, "key", "left_semi")
    return t.join(k, "doc").groupBy("theme", "key").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= least)


def backbone_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()


def giant_component(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The nodes of the largest component; of equal ones that with the smallest label."""
    found = connected_components(edges, a, b)
    largest = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component").limit(1)
    return found.join(largest, "component", "left_semi").select("id")


def related(mentions: DataFrame, seeds: DataFrame, least_shared: int, most: int) -> DataFrame:
    """Documents that share most distinct keys with the seeds, without the seeds; ties by document."""
    rows = mentions.select("doc", "key").distinct()
    keys = rows.join(seeds, "doc", "left_semi").select("key").distinct()
    others = rows.join(seeds, "doc", "left_anti").join(keys, "key", "left_semi")
    return others.groupBy("doc").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least_shared).orderBy(F.desc("shared"), "doc").limit(most)


def node_index(keys: DataFrame, themes: DataFrame) -> DataFrame:
    """Nodes by position: keys in order, then themes by rank."""
    both = keys.select(F.lit(0).alias("part"), F.lit(0).alias("rank"), F.col("key").cast("string").alias("id")).unionByName(themes.select(F.lit(1).alias("part"), "rank", F.col("theme").cast("string").alias("id")))
    return number_all(both, [F.col("part"), F.col("rank"), F.col("id")], "idx").withColumn("idx", (F.col("idx") - 1).cast("int")).select("idx", "part", "id")
