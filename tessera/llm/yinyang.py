"""Centroid clustering with Yinyang bounds: k-means whose rounds compute few distances and give Lloyd's results exactly.

Centroids are put into groups once. A vector keeps an upper bound of the distance to its centroid and, a group, a lower bound
of the distances to the group's other centroids. When centroids move, bounds move by as much. A vector whose upper bound is
below all lower bounds keeps its centroid; else the upper bound is made exact and asked again; then groups whose lower bound
lies below it are scanned exactly, and the others are not. Distances are compared as exact integers, bounds have slack for rounding and
rule out only what is strictly farther, so ties go to the smaller number as in a full scan.

Vectors never move between tasks: a round maps over them, writes them with their bounds, and adds up exact sums a task, then
a cluster. Centroids and sums, k times the dimension, are all that reaches the driver or is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_table, write_table

#: Components up to this size have squared distances that a long holds, for up to 64 components.
LARGEST = 1 << 27
SLACK = 1e-12
STATE = "id long, x array<int>, cluster int, upper double, lower array<double>, exact int, distance long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x): components times scale, rounded down, of vectors with exactly dim components, none null or non-finite.

    A vector with a component beyond LARGEST after scaling, whose squared distances no long could hold, is left out as well.
    Rows may repeat and id may be null: each row counts.
    """
    doubles = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") * scale).alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return doubles.filter(F.size("x") == dim).filter(F.coalesce(sound, F.lit(False))).select("id", F.transform("x", lambda x: F.floor(x).cast("int")).alias("x"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors (all, if fewer) with the smallest lowercase-hex sha256 of salt and id; ties by the vector."""
    rows = vectors.orderBy(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def groups_of(centroids: np.ndarray, n: int) -> list[np.ndarray]:
    """The centroids' numbers in at most n groups of near ones, by a few rounds of Lloyd on the centroids themselves."""
    points = centroids.astype(float)
    means = points[np.linspace(0, len(points) - 1, n).astype(int)]
    for _ in range(5):
        of = ((points[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.stack([points[of == g].mean(axis=0) if (of == g).any() else means[g] for g in range(n)])
    return [np.flatnonzero(of == g) for g in range(n) if (of == g).any()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c; in doubles where every sum fits into 53 bits."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def assign_all(x: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, upper bound (its distance) and lower bounds a group, by a full scan."""
    d = squared(x, centroids)
    near = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(x)), near].astype(float))
    others = np.sqrt(d.astype(float))
    others[np.arange(len(x)), near] = np.inf
    return near, upper, np.stack([others[:, g].min(axis=1) for g in groups], axis=1)


def assign_again(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after the centroids moved from old: new nearest, upper and lower bounds, and how many exact distances each vector took."""
    moved = np.sqrt(squared(old, centroids).diagonal().astype(float)) * (1 + SLACK)
    near, exact = near.copy(), np.zeros(len(x), np.int32)
    upper = (upper + moved[near]) * (1 + SLACK)
    lower = np.maximum(lower - np.array([moved[g].max() for g in groups]), 0) * (1 - SLACK)
    home = np.empty(len(centroids), int)
    for g, members in enumerate(groups):
        home[members] = g
    open_ = np.flatnonzero(lower.min(axis=1) <= upper)  # the global filter
    if not len(open_):
        return near, upper, lower, exact
    mine = own_distance(x[open_], near[open_], centroids)
    exact[open_] += 1
    upper[open_] = np.sqrt(mine.astype(float))
    still = lower[open_].min(axis=1) <= upper[open_] * (1 + SLACK)
    open_, mine = open_[still], mine[still]
    if not len(open_):
        return near, upper, lower, exact
    scan = lower[open_] <= upper[open_, None] * (1 + SLACK)  # the group filter
    start = near[open_].copy()
    best, best_d = start.copy(), mine.copy()
    seen = np.full((len(open_), len(centroids)), np.inf)  # exact distances found in this round
    seen[np.arange(len(open_)), start] = np.sqrt(mine.astype(float))
    for g, members in enumerate(groups):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        d = squared(x[open_[rows]], centroids[members])
        exact[open_[rows]] += len(members)
        seen[rows[:, None], members] = np.sqrt(d.astype(float))
        at = d.argmin(axis=1)  # the smallest number of the nearest: members are in order
        found, number = d[np.arange(len(rows)), at], members[at]
        better = (found < best_d[rows]) | ((found == best_d[rows]) & (number < best[rows]))
        best[rows[better]], best_d[rows[better]] = number[better], found[better]
    near[open_], upper[open_] = best, np.sqrt(best_d.astype(float))
    others = seen.copy()
    others[np.arange(len(open_)), best] = np.inf
    for g, members in enumerate(groups):
        tight, known = others[:, members].min(axis=1), lower[open_, g]
        # a group not scanned keeps its bound, but for the centroid that a vector of its own leaves
        lower[open_, g] = np.where(scan[:, g], tight, np.where(home[start] == g, np.minimum(known, tight), known))
    return near, upper, lower, exact


def own_distance(x: np.ndarray, near: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((x - centroids[near]) ** 2).sum(axis=1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


def next_round(state: DataFrame, old: np.ndarray | None, centroids: np.ndarray, groups: list[np.ndarray], last: bool) -> DataFrame:
    """The state with every vector at its nearest centroid. old None: vectors are new, by a full scan. The last round gives distances."""
    dim, k = centroids.shape[1], len(centroids)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = matrix(batch.column(1), dim).astype(np.int64)
                if old is None:
                    near, upper, lower = assign_all(x, centroids, groups)
                    exact = np.full(len(x), k, np.int32)
                else:
                    was = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
                    near, upper, lower, exact = assign_again(x, was[0].astype(int), was[1], matrix(batch.column(4), len(groups)), old, centroids, groups)
                far = pa.array(own_distance(x, near, centroids)) if last else pa.nulls(len(x), pa.int64())
                columns = [batch.column(0), lists(x, pa.int32()), pa.array(near, pa.int32()), pa.array(upper), lists(lower, pa.float64()), pa.array(exact), far]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "cluster", "upper", "lower", "exact", "distance"])

    return state.mapInArrow(step, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the exact mean, rounded down, of its vectors; one without vectors stays. A task sends a row a cluster."""
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, near = matrix(batch.column(1), dim), batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(near).tolist():
                sums[c] += x[near == c].sum(axis=0, dtype=np.int64)
            counts += np.bincount(near, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), lists(sums[used], pa.int64())], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "x").mapInArrow(add, "cluster int, n long, sums array<long>")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect()
    out = centroids.copy()
    for r in rows:  # k times dim at most
        out[r["cluster"], r["at"]] = r["sum"] // r["n"]
    return out


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int, per_group: int = 10) -> tuple[DataFrame, np.ndarray]:
    """vectors (id, x array<int>) clustered from these centroids by so many rounds and a last assignment: rows of STATE, and the final centroids.

    The result is a written table: id, x, cluster, distance (squared) and exact, the distances that the last round computed for the vector.
    """
    groups = groups_of(centroids, max(1, len(centroids) // per_group))
    state, old = vectors, None
    for r in range(rounds + 1):
        before = state
        state = write_table(next_round(state, old, centroids, groups, r == rounds), "yinyang")
        if r:
            drop_table(before)
        if r < rounds:
            old, centroids = centroids, means(state, centroids)
    return state, centroids


def op12(vectors: DataFrame, dim: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, salt: str = "2:") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, inertias and its centroid's hash. With fewer than k vectors each is a centroid; an empty table has no rows."""
    whole = integer_vectors(vectors, "vec_id", "embedding", dim, scale)
    seeds = first_centroids(whole, k, salt)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(seeds):
        return vectors.sparkSession.createDataFrame([], names)
    state, centroids = cluster(whole, seeds, rounds)
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(facts), "cluster").select(*(x.split()[0] for x in names.split(", ")))


def sql(dim: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, salt: str = "2:") -> str:
    """The same by full scans, a round a pair of CTEs."""
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda y: floor({scale} * CAST(y AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: isfinite(y))) = {dim})",
        "n AS (SELECT row_number() OVER (ORDER BY vec_id, x) AS id, vec_id, x, list_inner_product(x, x) AS xx FROM v)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{salt}' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x FROM n QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT id, m % 1024 AS c, m // 1024 AS d FROM (SELECT id, min(CAST(xx + list_inner_product(k.x, k.x) - 2 * list_inner_product(n.x, k.x) AS BIGINT) * 1024 + k.c) AS m FROM n, c{r} k GROUP BY id))")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, list(mean ORDER BY i) AS x FROM (SELECT c, i, floor(sum(x[i]) / count(*)) AS mean FROM a{r} JOIN n USING (id), range(1, {dim + 1}) t(i) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT k.c, coalesce(s.x, k.x) AS x FROM c{r} k LEFT JOIN s{r} s USING (c))")
    hashed = f"h AS (SELECT c, sha256(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{rounds})"
    return f"WITH {', '.join([*parts, hashed])} SELECT n.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256 FROM a{rounds} a JOIN n USING (id) JOIN h ON h.c = a.c"


SQL = sql()
