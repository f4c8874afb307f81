"""Exact dedup against brute force, digest collisions included."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, texts int, hit int, digest string"
ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "b" * 70_000), (7, "b" * 70_000), (8, "a "), (9, "é"), (10, "é"), (None, "a"), (None, "only"), (2, "a"), (11, "line\nline")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays, given = max(known) if known else None, False
        for i in ids:
            kept = i == stays and not given
            given = given or kept
            out.append((i, stays, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "old", 7, 1, "x") for i, t in rows], SCHEMA)
    got = exact_dedup.exact_dedup(df, **more)
    assert {"texts", "hit", "digest"} <= set(got.columns) and got.filter("texts <> 7 or hit <> 1 or digest <> 'x'").isEmpty()
    return sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_texts_that_share_a_digest_stay_apart(spark):
    assert run(spark, ROWS, digest=F.lit(5)) == brute(ROWS)
    assert run(spark, ROWS, digest=F.length(F.coalesce("text", F.lit("")))) == brute(ROWS)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_many_runs_compact_to_one_level(spark):
    rows = spark.range(5000).select((F.col("id") % 700).alias("digest"), F.col("id").alias("doc_id")).repartition(5)
    runs = exact_dedup.flush_runs(rows, 256)
    assert runs.select("run").distinct().count() > 10
    level = {r["digest"]: (r["keep_id"], r["n"]) for r in exact_dedup.compact(runs).collect()}
    assert level == {d: (max(range(d, 5000, 700)), len(range(d, 5000, 700))) for d in range(700)}
    for r in runs.groupBy("run").agg(F.collect_list("digest").alias("d"), F.first("filter", ignorenulls=True).alias("f")).collect():
        assert r["d"] == sorted(r["d"]) and exact_dedup.may_hold(np.frombuffer(r["f"], np.uint8), np.array(r["d"])).all()


@pytest.mark.parametrize("bits", [1 << 10, 1 << 17])
def test_filter_has_no_false_negatives(bits):
    x = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 900)
    assert exact_dedup.may_hold(exact_dedup.build_filter(x, bits), x).all()
