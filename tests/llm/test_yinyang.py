"""Yinyang against Lloyd by full scans, and the query against its SQL."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import yinyang
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, cluster string, x int, id int"


def lloyd(x, centroids, rounds):
    """Python integers, no bounds."""
    x, c = x.astype(object), centroids.astype(object)
    for r in range(rounds + 1):
        d = np.array([[((a - b) ** 2).sum() for b in c] for a in x])
        near = d.argmin(axis=1)
        if r < rounds:
            c = np.array([x[near == i].sum(axis=0) // (near == i).sum() if (near == i).any() else c[i] for i in range(len(c))])
    return near, d[np.arange(len(x)), near], c


def brute(rows, dim, scale, k, rounds):
    kept = [(i, [int(np.floor(scale * y)) for y in v]) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    if not kept:
        return []
    x = np.array([v for _, v in kept])
    near, d, c = lloyd(x, x[:k], rounds)
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    return sorted(((i, int(n), int(e), int(d[near == n].sum()), int(d.sum()), sha[n]) for (i, _), n, e in zip(kept, near, d)), key=str)


def run(spark, rows, **kw):
    return sorted((tuple(r) for r in yinyang.op12(spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA), **kw).collect()), key=str)


@pytest.mark.parametrize("seed,spread,k", [(1, 1.0, 30), (2, 0.1, 25), (3, 300.0, 12), (4, 40000.0, 40)])
def test_as_lloyd(spark, seed, spread, k):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 6)) * spread
    rows = [(i, (centres[rng.integers(9)] + rng.normal(size=6) * spread / 5).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a third are copies
    assert run(spark, rows, dim=6, k=k) == brute(rows, 6, 256, k, 5)


def test_ties_repeats_nulls_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(a, b) for a in range(-3, 4) for b in range(-3, 4)])]
    rows += [(7, rows[7][1]), (None, [1.0, 1.0]), (None, [1.0, 2.0]), (100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [nan, 1.0]), (105, [1.0, -inf]), (106, [1.0, 2.0, 3.0])]
    for k in (1, 4, 13, 60):
        assert run(spark, rows, dim=2, scale=1, k=k) == brute(rows, 2, 1, k, 5)


def test_empty_and_too_large(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1e30, 0.0])], dim=2) == []


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8)) * 5
    rows = [(i, (centres[i % 40] + rng.normal(size=8)).tolist()) for i in range(4000)]
    whole = yinyang.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 8, 256)
    state, _ = yinyang.cluster(whole, yinyang.first_centroids(whole, 40, "2:"), 5)
    assert state.agg(F.avg("exact")).first()[0] < 20 and state.count() == 4000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_as_sql(spark, duck):
    con = duck.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = con.execute(f"SELECT {names} FROM ({yinyang.SQL})").fetchall()
    got = [tuple(r) for r in yinyang.op12(table(spark, SF, "embeddings")).select(*names.split(", ")).collect()]
    assert len(got) == len(want) > 0 and sorted(got) == sorted(want)
