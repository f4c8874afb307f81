"""Nearest neighbours: recall and scores against brute force, ties, unusable vectors."""

import math
import os

import numpy as np
import pytest

from tessera.llm import hnsw
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, shard string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, query_ids, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in good:
        if q in query_ids:
            near = sorted((math.sqrt(((x - y) ** 2).sum()), i) for i, y in good if i != q and len(y) == len(x))
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return out


def run(spark, rows, shard=64):
    df = frame(spark, rows)
    index, shards = hnsw.build_index(df, shard=shard)
    return [tuple(r) for r in hnsw.search(index, shards, df.filter("vec_id % 10 = 0")).orderBy("query_id", "rank").collect()]


def test_recall_over_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 12)).astype(np.float32))]
    got, want = run(spark, rows), brute(rows, set(range(0, 900, 10)))
    assert len(got) == len(want)
    same = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(same) >= 0.9 * len(want)
    value = dict(rows)
    for q, _, i, d in got:
        assert d == pytest.approx(np.linalg.norm(np.array(value[q], float) - np.array(value[i], float)), rel=1e-12)


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(100, None), (101, []), (102, [0.0, 0.0]), (103, [None, 1.0]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (None, [1.0, 1.0]), (110, [1.0]), (120, [2.0])]
    got = run(spark, rows, shard=10_000)
    assert [(q, r, i) for q, r, i, _ in got] == [(q, r, i) for q, r, i, _ in sorted(brute(rows, {0, 10, 20, 30, 40, 50, 110, 120}))]


def test_repeated_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.5]), (1, [1.0, 2.5])]
    assert [(q, r, i) for q, r, i, _ in run(spark, rows)] == [(0, 1, 1)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_flat_arrays(spark):
    rng = np.random.default_rng(4)
    index, _ = hnsw.build_index(frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]))
    for r in index.collect():
        flat = list(r["near"])
        assert flat.count(-1) == r["level"] + 1 and flat[-1] == -1 and r["node"] not in flat


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_table(spark):
    vectors = table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0})
    got = {(r["query_id"], r["vec_id"]) for r in hnsw.op5(vectors).collect()}
    assert len(got & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
