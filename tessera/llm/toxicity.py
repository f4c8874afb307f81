"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios, fitted on labelled text.

Features are the distinct character n-grams of the lower-case text (lengths NGRAMS), hashed to 2**BITS buckets. The fit uses
at most PER_CLASS labelled rows of each class, those of smallest hash of doc_id; bucket counts of both classes give
the ratio r = log((n1 + 1) / (N1 + 2)) - log((n0 + 1) / (N0 + 2)), the FEATURES buckets of largest chi-square are kept, and
a logistic regression with weights of classes is fitted to the features times r. The fit is on the driver, in memory that PER_CLASS
and FEATURES bound. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal, held_out, joined, write_table

#: Bounds of the fit; they are parameters of fit() and do not depend on the input.
NGRAMS, BITS, PER_CLASS, FEATURES, RIDGE = (3, 4, 5, 6), 18, 8192, 8192, 1e-3


def buckets(text: str, scratch: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text's n-grams, ascending. scratch: 2**BITS False values, left as they were."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - BITS)
    rolled = codes.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in NGRAMS:
            scratch[((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift] = True
    found = np.flatnonzero(scratch)
    scratch[found] = False
    return found


@dataclass
class Model:
    weights: np.ndarray  # of every bucket, 0 where it is not a feature
    bias: float

    def scorer(self, spark) -> Column:
        sent, bias = spark.sparkContext.broadcast(self.weights), self.bias

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            w, scratch = sent.value, np.zeros(1 << BITS, bool)
            for x in texts:
                z = np.array([bias + w[buckets(t or "", scratch)].sum() for t in x], float)
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """Learns from labelled rows outside the held-out fold. A doc_id with several labels is toxic if one of them says so; of several texts of one doc_id the smallest counts, so the sample has at most 2 * per_class rows."""
    spark = docs.sparkSession
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.filter(~held_out(0)).withColumn("h", F.xxhash64("doc_id"))
    chosen = [marked.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic")  # at most 2 * per_class rows, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = write_table(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "tox-sample")

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, scratch = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[y, buckets(t, scratch)] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "n0", "n1"])

    counts = rows.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.zeros(1 << BITS)
    if not size.get(0) or not size.get(1):  # one class or no rows: every text has that class's score
        return Model(weights, {(): -40.0, (0,): -40.0, (1,): 40.0}[tuple(sorted(k for k, n in size.items() if n))])
    bucket, n0, n1 = (counts[c].to_numpy() for c in ("bucket", "n0", "n1"))
    del counts
    n0, n1 = n0.astype(float), n1.astype(float)
    big0, big1 = size[0], size[1]
    ratio = np.log((n1 + 1) / (big1 + 2)) - np.log((n0 + 1) / (big0 + 2))
    seen, total = n0 + n1, big0 + big1
    chi = (n1 * (big0 - n0) - n0 * (big1 - n1)) ** 2 * total / (big0 * big1 * seen * np.maximum(total - seen, 1))
    order = np.lexsort((bucket, -chi))[:features]
    at, r = bucket[order], ratio[order]
    place = np.full(1 << BITS, -1, np.int32)
    place[at] = np.arange(len(at))
    sent = spark.sparkContext.broadcast(place)

    @frugal
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << BITS, bool)
        for batch in batches:
            kept = [(p := sent.value[buckets(t, scratch)])[p >= 0].astype("<u2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["toxic", "x"])

    got = rows.mapInArrow(select, "toxic int, x binary").toArrow().sort_by([("toxic", "ascending"), ("x", "ascending")])
    y, x = got["toxic"].to_numpy().astype(float), got["x"].combine_chunks()
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(x).to_numpy().astype(np.int64) // 2)])
    flat = np.frombuffer(joined(x, b""), "<u2")  # two bytes a feature of a row are all the driver holds of the sample
    del got, x
    w, bias = logistic(flat, starts, y, r)
    weights[at] = w * r
    return Model(weights, bias - threshold(flat, starts, y, r, np.append(w, bias)))


def sums(flat: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of values over the features of each row, in chunks of rows; row i has flat[starts[i] : starts[i + 1]]."""
    out = np.zeros(len(starts) - 1)
    for a, b in chunks(starts):
        total = np.concatenate([[0.0], np.cumsum(values[flat[starts[a] : starts[b]]])])
        out[a:b] = np.diff(total[starts[a : b + 1] - starts[a]])
    return out


def chunks(starts: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows with about most features each, so that what the fit needs beside the sample does not grow with it."""
    cuts = np.unique(np.concatenate([np.searchsorted(starts, np.arange(0, int(starts[-1]), most)), [len(starts) - 1]]))
    return [(int(a), int(b)) for a, b in zip(np.concatenate([[0], cuts]), cuts) if b > a]


def threshold(flat: np.ndarray, starts: np.ndarray, y: np.ndarray, r: np.ndarray, start: np.ndarray, folds: int = 4, false_alarm: float = 8.0) -> float:
    """The log odds to decide at, from the log odds that each row gets by a model of the other folds, fitted from start on.

    It minimises the share of missed rows of class 1 plus false_alarm times the share of rows of class 0 that are taken, and
    is the middle of the values that do; 0 where a fold lacks a class.
    """
    fold, z = np.arange(len(y)) % folds, np.zeros(len(y))
    if any(len(set(y[fold == k])) < 2 for k in range(folds)):
        return 0.0
    for k in range(folds):
        w, bias = logistic(flat, starts, y, r, fold != k, start=start)
        z[fold == k] = sums(flat, starts, w * r)[fold == k] + bias
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    loss = np.append(0, np.cumsum(y)) / y.sum() + false_alarm * (1 - np.append(0, np.cumsum(1 - y)) / (1 - y).sum())
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float((edges[best[0]] + edges[best[-1]]) / 2)


def logistic(flat: np.ndarray, starts: np.ndarray, y: np.ndarray, scale: np.ndarray, used: np.ndarray | None = None, ridge: float = RIDGE, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss plus ridge / 2 times the squared weights, over the rows used (all if None).

    Features are scaled by scale; both classes weigh the same.
    """
    used = np.ones(len(y), bool) if used is None else used
    each = np.where(y == 1, 0.5 / max(1, y[used].sum()), 0.5 / max(1, (1 - y[used]).sum())) * used

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, sign = x[:-1], 2 * y - 1
        z = sums(flat, starts, w * scale) + x[-1]
        e = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.zeros(len(scale))
        for a, b in chunks(starts):
            g += np.bincount(flat[starts[a] : starts[b]], np.repeat(e[a:b], np.diff(starts[a : b + 1])), len(scale))
        return float((each * np.logaddexp(0, -sign * z)).sum() + ridge / 2 * w @ w), np.append(g * scale + ridge * w, e.sum())

    x = minimise(loss, np.zeros(len(scale) + 1) if start is None else start)
    return x[:-1], float(x[-1])


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 200, memory: int = 10, least: float = 1e-5) -> np.ndarray:
    """The minimum of a smooth convex loss (value and gradient) by limited-memory BFGS with halved steps."""
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < least:
            break
        d, kept = -g, []
        for s, v in reversed(past):
            kept.append((s @ d) / (s @ v))
            d = d - kept[-1] * v
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum()))
        for (s, v), a in zip(past, reversed(kept)):
            d = d + s * (a - (v @ d) / (s @ v))
        step = 1.0
        while (got := loss(x + step * d))[0] > value + 1e-4 * step * (g @ d) and step > 1e-9:
            step /= 2
        if got[0] >= value:
            break
        s, v = step * d, got[1] - g
        if s @ v > 1e-14:
            past = [*past[1 - memory :], (s, v)]
        x, (value, g) = x + s, got
    return x


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5); columns of docs with these names are replaced.

    Null and empty texts get the score of no n-gram but the two blanks around a text; doc_id may be null or repeat.
    """
    score = fit(docs, labels).scorer(docs.sparkSession)
    return docs.withColumn("score", score(F.coalesce(F.col("text"), F.lit("")))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs.select("doc_id", "text"), labels).select("doc_id", held_out(0).alias("held_out"), "score", "predicted")
