"""Exact similarity search: cosine distance, top-k, proximity band, several collections in one scan."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.schemas import MAX_K


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos in [0, 2], summed in double and rounded to 6 places; 2 for empty or zero vectors and unequal widths."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = add(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(add(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.round(F.when(fine, F.greatest(F.lit(0.0), 1 - dot / (norm(a) * norm(b)))).otherwise(F.lit(2.0)), 6)


@F.pandas_udf(DoubleType())
def cosine_distance_np(a: pd.Series, b: pd.Series) -> pd.Series:
    """cosine_distance over Arrow batches, for wide vectors: one pass of numpy a row."""
    out = np.full(len(a), 2.0)
    for i, (x, y) in enumerate(zip(a, b)):
        if x is not None and y is not None and len(x) == len(y) and len(x):
            x, y = np.asarray(x, float), np.asarray(y, float)
            n = np.sqrt(x @ x) * np.sqrt(y @ y)
            out[i] = max(0.0, 1 - x @ y / n) if n > 0 else 2.0
    return pd.Series(out).round(6)


def score(records: DataFrame, query: DataFrame, vector: str = "embedding", fast: bool = False) -> DataFrame:
    """records with dist to the query, a frame of one row with the column q: the only row that is broadcast."""
    measure = cosine_distance_np if fast else cosine_distance
    return records.crossJoin(F.broadcast(query.select(F.col(vector).alias("q")).limit(1))).withColumn("dist", measure(F.col(vector), F.col("q"))).drop("q")


def topk(records: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", fast: bool = False) -> DataFrame:
    """The k nearest, ties by id: a heap a partition, never a full sort."""
    return score(records, query, fast=fast).orderBy("dist", id_col).limit(min(max(k, 1), MAX_K))


def topk_per(records: DataFrame, query: DataFrame, k: int | Column, part: str, id_col: str = "vec_id") -> DataFrame:
    """The k nearest of each collection in one scan, with rank rn; the limit is pushed into the window."""
    order = Window.partitionBy(part).orderBy("dist", id_col)
    return score(records, query).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


#: Queries and records of one block of nearest_each.
BLOCK = (4096, 16384)


def nearest_each(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, ql, vec_id, label, dist, rn): the k nearest records of each query by cosine_distance, ties by vec_id, without the record of the query's own id.

    records: vec_id, label, embedding; queries: qid, ql, qv. Every pair is scored, in blocks of queries by records that are dealt over the
    tasks: a matrix product rules out what cannot be among a query's k nearest of the block, and the rest gets the distance summed in order as
    cosine_distance does. Only k rows a query and block leave a task; a task holds one block.
    """
    sound = lambda v: F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), F.transform(v, lambda x: x.cast("double")))
    asked = queries.filter("qid is not null").select("qid", "ql", sound(F.col("qv")).alias("qv"))
    held = records.filter("vec_id is not null").select("vec_id", "label", sound(F.col("embedding")).alias("embedding"))
    m, n = (max(1, -(-df.count() // size)) for df, size in zip((queries, records), BLOCK))
    every = lambda size, name: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name)
    asked = asked.withColumn("qb", (F.monotonically_increasing_id() % m).cast("int")).select("*", every(n, "rb"))
    held = held.withColumn("rb", (F.monotonically_increasing_id() % n).cast("int")).select("*", every(m, "qb"))
    schema = f"qid long, ql {dict(queries.dtypes)['ql']}, vec_id long, label {dict(records.dtypes)['label']}, dist double"
    best = asked.groupBy("qb", "rb").cogroup(held.groupBy("qb", "rb")).applyInPandas(lambda q, r: _nearest_block(q, r, k), schema)
    ranked = best.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vec_id")))
    return ranked.filter(F.col("rn") <= k)


def _nearest_block(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    ids, out = held["vec_id"].to_numpy(), []
    order = np.argsort(ids, kind="stable")
    qids = asked["qid"].to_numpy()
    low, high = (np.searchsorted(ids[order], qids, side) for side in ("left", "right"))
    width = lambda vectors: np.array([0 if v is None else len(v) for v in vectors], int)
    qw, rw = width(asked["qv"]), width(held["embedding"])
    columns = {w: (np.flatnonzero(rw == w), *_by_component(held["embedding"], rw == w)) for w in np.unique(rw[rw > 0])}
    for w in np.unique(qw):
        rows = np.flatnonzero(qw == w)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            dist = np.full((len(part), len(held)), 2.0)
            if w in columns and len(ids):
                where, r, rn = columns[w]
                q, qn = _by_component(asked["qv"].iloc[part], np.ones(len(part), bool))
                with np.errstate(all="ignore"):
                    near = np.maximum(0.0, 1 - q.T @ r / np.outer(qn, rn))
                near[(qn == 0)[:, None] | (rn == 0)[None, :]] = 2.0
                dist[:, where] = np.where(np.isnan(near), LAST, near)
            for i, p in enumerate(part):
                dist[i, order[low[p] : high[p]]] = np.inf
            edge = np.partition(dist, k - 1, axis=1)[:, k - 1] if dist.shape[1] > k else np.full(len(part), np.inf)
            qi, ri = np.nonzero((dist <= edge[:, None] + 2e-6) & np.isfinite(dist))  # what rounds to no more than the k-th does
            found = dist[qi, ri]
            if w in columns:
                place = np.zeros(len(held), int)
                place[where] = np.arange(len(where))
                exact = (rw[ri] == w) & (found != LAST)
                exact &= (qn[qi] > 0) & (rn[np.where(exact, place[ri], 0)] > 0)
                a, b = qi[exact], place[ri[exact]]
                total = np.zeros(len(a))
                for x, y in zip(q, r):
                    total += x[a] * y[b]
                found[exact] = rounded(np.maximum(0.0, 1 - total / (qn[a] * rn[b])))
            first = np.lexsort((ids[ri], found, qi))
            qi, ri, found = qi[first], ri[first], found[first]
            top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            qi, ri, found = part[qi[top]], ri[top], found[top]
            out.append(pd.DataFrame({"qid": qids[qi], "ql": asked["ql"].to_numpy()[qi], "vec_id": ids[ri], "label": held["label"].to_numpy()[ri], "dist": np.where(found == LAST, np.nan, found)}))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("qid", "ql", "vec_id", "label", "dist")})


#: Stands for a distance that is no number, which sorts after all others.
LAST = 9.0


def _by_component(vectors: pd.Series, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as an array of components by vectors, and their norms, summed in order."""
    found = np.ascontiguousarray(np.stack(vectors[which].tolist()).T, dtype=float)
    total = np.zeros(found.shape[1])
    for x in found:
        total += x * x
    return found, np.sqrt(total)


def rounded(values: np.ndarray) -> np.ndarray:
    """To 6 places, halves up, by decimal digits where a value is next to a half."""
    scaled = values * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def narrow(hits: DataFrame, part: str, floor: int = 0, band: float | None = None) -> DataFrame:
    """Keeps the first floor hits and those within band of the best; hits are ranked by rn, so no stop is needed."""
    if band is None:
        return hits
    best = F.min("dist").over(Window.partitionBy(part))
    return hits.withColumn("_best", best).filter((F.col("rn") <= floor) | (F.round(F.col("dist") - F.col("_best"), 6) <= band)).drop("_best")


def with_bodies(hits: DataFrame, bodies: DataFrame, left: str, right: str) -> DataFrame:
    """Late fetch: bodies are joined to the hits that are left, and a missing body leaves null."""
    return hits.join(bodies.withColumnRenamed(right, left), left, "left")
