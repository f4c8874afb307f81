"""Lexical AND-search: every term is in some field, accents and case aside."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalise, pieces


def terms_of(query: str) -> list[str]:
    """Normalised terms without repeats; single letters a-z are dropped, digits stay."""
    flat = "".join(c for c in unicodedata.normalize("NFD", query) if not "̀" <= c <= "ͯ").lower()
    return [t for t in dict.fromkeys(flat.split()) if not re.fullmatch("[a-z]", t)]


def matches(query: str, *fields: Column) -> Column:
    hay = F.array(*[normalise(f) for f in fields])
    found = F.lit(True)
    for t in terms_of(query):
        found = found & _in_some(hay, t)
    return found


def _in_some(hay: Column, term: str) -> Column:
    return F.exists(hay, lambda h: F.contains(h, F.lit(term)))


def search(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """No terms: every row."""
    return rows.filter(matches(query, *[F.col(f) for f in fields]))


def search_groups(items: DataFrame, query: str, group: str, title: str) -> DataFrame:
    """Items of groups whose name matches, and items whose title does; groups without items fall away."""
    return items.filter(matches(query, F.col(group)) | matches(query, F.col(title)))


def highlight(query: str):
    """A UDF of text: the ranges (start, end) of the terms in the text as it is; overlapping and touching ranges are merged."""
    wanted = terms_of(query)

    @F.pandas_udf("array<struct<start int, end int>>")
    def ranges(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in pieces(texts):
            yield pd.Series([spans(t, wanted) for t in x])

    return ranges


def spans(text: str, wanted: list[str]) -> list[dict]:
    flat, origin = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFD", c):
            if not "̀" <= d <= "ͯ":
                flat.append(d.lower()[:1] or d)
                origin.append(i)
    plain, found = "".join(flat), []
    for t in wanted:
        at = plain.find(t)
        while at >= 0:
            end = origin[at + len(t) - 1] + 1
            while end < len(text) and "̀" <= text[end] <= "ͯ":
                end += 1
            found.append((origin[at], end))
            at = plain.find(t, at + len(t))
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def containing(items: DataFrame, docs: DataFrame, item: str, doc: str, size: int = 3) -> DataFrame:
    """(item, documents): how many documents hold the whole text of each item; items that none holds have no row.

    An item of size + 2 words or more is found by its inner words 2 to size + 1, which a document that holds it has as words as well:
    an equi-join of hashed word sequences, then the whole text is compared. Shorter items, few as they are, are compared with
    every document; the list of items is the smaller side.
    """
    parted = lambda c: F.split(c, r"[\x20\x09-\x0D]+")
    named = items.filter("text <> ''").select(F.col(item), F.col("text").alias("_whole"), parted(F.col("text")).alias("_w"))
    anchored = named.filter(F.size("_w") >= size + 2).select(item, "_whole", F.xxhash64(F.array_join(F.slice("_w", 2, size), " ")).alias("_anchor"))
    places = F.when(F.size("_w") >= size, F.sequence(F.lit(1), F.size("_w") - size + 1))
    spread = docs.select(F.col(doc), parted(F.col("text")).alias("_w")).select(doc, F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, size), " "))))).alias("_anchor"))
    likely = spread.join(anchored.select(item, "_anchor"), "_anchor").select(doc, item).distinct()
    long = likely.join(docs, doc).join(anchored.select(item, "_whole"), item).filter(F.contains("text", F.col("_whole"))).select(item)
    short = docs.join(named.filter(F.size("_w") < size + 2), F.contains(F.col("text"), F.col("_whole"))).select(item)
    return long.unionByName(short).groupBy(item).agg(F.count(F.lit(1)).alias("documents"))
