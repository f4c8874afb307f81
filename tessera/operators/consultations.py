"""Numbered consultations out of the text of pages: page furniture goes, blocks open at numbers that increase."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse
from tessera.operators.catalog import letters, shouted

#: How a block opens, the labels of its subject and the labels that end it.
MARK = r"(?i)^CONSULTA\s+N[º°o]\s*:?\s*(\d{1,9})"
SUBJECT = "SUMULA ASSUNTO EMENTA".split()
OTHERS = "RELATOR CONSULENTE INTERESSAD PROTOCOLO SID".split()


def longest_run(numbers: list[int]) -> list[int]:
    """The places of the longest strictly increasing run; of several the one whose places are earliest."""
    ends: list[int] = []  # negated: the run is built from the right
    length = [0] * len(numbers)
    for i in range(len(numbers) - 1, -1, -1):
        at = bisect_left(ends, -numbers[i])
        ends[at : at + 1] = [-numbers[i]]
        length[i] = at + 1
    out: list[int] = []
    left = max(length, default=0)
    for i, n in enumerate(numbers):
        if left and length[i] == left and (not out or n > numbers[out[-1]]):
            out.append(i)
            left -= 1
    return out


def page_lines(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, page, at, line, edge): lines that are not blank, trimmed, and how far each is from the nearer end of its page, from 1."""
    rows = pages.select(key, page, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter("line <> ''")
    ends = [Window.partitionBy(key, page).orderBy(o) for o in (F.asc("at"), F.desc("at"))]
    return rows.withColumn("edge", F.least(*[F.row_number().over(w) for w in ends]))


def without_furniture(lines: DataFrame, key: str, page: str, depth: int = 2, share: float = 0.5, least: int = 3) -> DataFrame:
    """lines without what repeats at the edges of pages, rules and page numbers.

    Furniture is a line that, numbers aside, lies within depth lines of an edge on at least that share of a document's pages, and on
    least pages or more. The same words in the middle of a page stay.
    """
    shaped = lines.withColumn("_shape", F.when(F.col("edge") <= depth, F.regexp_replace("line", r"\d+", "#")))
    pages = lines.select(key, page).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_pages"))
    seen = shaped.filter("_shape is not null").select(key, page, "_shape").distinct().groupBy(key, "_shape").agg(F.count(F.lit(1)).alias("_n"))
    often = seen.join(pages, key).filter((F.col("_n") >= least) & (F.col("_n") >= F.col("_pages") * share)).select(key, "_shape")
    bare = shaped.filter(~F.col("line").rlike(r"^(_+|\d+)$"))
    return bare.join(often, [key, "_shape"], "left_anti").drop("_shape", "edge")


def blocks(lines: DataFrame, key: str, page: str, mark: str = MARK) -> DataFrame:
    """(key, number, lines): the lines from each opening number to the next, in order.

    Openings are lines that mark matches whose numbers are in the document's longest increasing run, so that a number cited at the
    start of a line opens nothing. Lines before the first are left out. A document, one file of pages, is gathered in a row.
    """
    marks = lines.filter(F.col("line").rlike(mark)).withColumn("_n", F.regexp_extract("line", mark, 1).cast("long"))

    @F.pandas_udf("array<int>")
    def run(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in numbers:
            yield pd.Series([longest_run(list(n)) for n in x])

    every = marks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(page, "at", "_n"))).alias("_m"))
    kept = every.withColumn("_run", run(F.transform("_m", lambda x: x["_n"]))).select(key, "_m", F.explode("_run").alias("_i")).select(key, F.element_at("_m", F.col("_i") + 1).alias("_m")).select(key, "_m.*")
    order = Window.partitionBy(key).orderBy(page, "at")
    numbered = lines.join(kept, [key, page, "at"], "left").withColumn("number", F.last("_n", ignorenulls=True).over(order)).filter("number is not null")
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(page, "at", "line"))), lambda x: x["line"])
    return numbered.groupBy(key, "number").agg(gathered.alias("lines"))


def subject(lines: Column) -> Column:
    """What stands after the subject's label, with the lines below while they are in capitals and no other label; '' without a label."""
    starts = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: letters(x).startswith(w))
    at = F.array_position(F.transform(lines, lambda x: starts(x, SUBJECT)), True).cast("int")
    rest = F.slice(lines, at + 1, F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: starts(x, OTHERS) | ~shouted(x)), True).cast("int")
    below = F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest)
    first = F.regexp_replace(F.element_at(lines, at), r"^[^:]*:?", "")
    found = collapse(F.array_join(F.concat(F.array(first), below), " "))
    return F.when(at > 0, F.regexp_replace(found, r"( \p{Lu})+$", "")).otherwise("")


def consultations(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, number, subject, body) of the numbered consultations in each document's pages. A document without openings has no rows."""
    found = blocks(without_furniture(page_lines(pages, key, page, text), key, page), key, page)
    return found.select(key, "number", subject(F.col("lines")).alias("subject"), F.array_join("lines", "\n").alias("body"))
