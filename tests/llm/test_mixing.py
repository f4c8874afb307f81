"""Mixing: targets by water filling, words taken near them, positions in order, no Python in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, offset int, weight int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "old", 1, 2) for i, t, s in rows], SCHEMA)


def targets(sizes):
    """sizes in source order: repeated resharing until no target is above 3 times its size."""
    weights, total = [k % 3 + 1 for k in range(len(sizes))], sum(sizes)
    stopped = set()
    while True:
        free = [k for k in range(len(sizes)) if k not in stopped]
        rest = total - sum(3 * sizes[k] for k in stopped)
        level = rest / sum(weights[k] for k in free) if free else 0
        above = {k for k in free if level * weights[k] > 3 * sizes[k]}
        if not above:
            return [3 * sizes[k] if k in stopped else level * weights[k] for k in range(len(sizes))]
        stopped |= above


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    many = [("hot", 600), ("a", 150), ("b", 40), ("tiny", 3), (None, 60), ("Ünï", 80)]
    out = [(None, " ".join("w" * rng.randint(1, 40)), s) for s, n in many for _ in range(n)]
    rng.shuffle(out)
    out = [(i, t, s) for i, (_, t, s) in enumerate(out)]
    return [*out, (5000, None, "a"), (5001, "", "empty source"), (5002, " \t\n", "a"), (5003, "x y", "a"), (5003, "x y", "a"), (None, "z z z", "b")]


def test_targets_and_taken(spark, rows):
    got = mixing.plan_mix(table(spark, rows)).toPandas()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").replace("\t", " ").split())
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    for name, total, target in zip(names, sizes, targets(sizes)):
        mine = got[got["source"].isna()] if name is None else got[got["source"] == name]
        assert (mine["source_size"] == total).all() and mine["target"].tolist() == pytest.approx([target] * len(mine))
        longest = mine["size"].astype(int).max()
        assert abs(mine["taken"].sum() - target) <= longest
    assert (got["taken"] <= 3 * got["size"].astype(int)).all()


def test_reruns_agree_and_copies_are_in_order(spark, rows):
    df = table(spark, rows)
    first = mixing.ordered_mix(df).select("doc_id", "position", "epoch").collect()
    again = mixing.ordered_mix(df.repartition(7)).select("doc_id", "position", "epoch").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert [r["position"] for r in first] == sorted(r["position"] for r in first)
    assert all(0 <= r["position"] <= 1 for r in first)
    plan = mixing.plan_mix(df).filter("taken > 0").agg(F.sum("copies")).first()[0]
    assert len(first) == plan


def test_other_columns_stay(spark, rows):
    out = mixing.ordered_mix(table(spark, rows))
    assert set(SCHEMA.replace(",", "").split()[::2]) <= set(out.columns)
    assert out.filter("size <> 'old' or offset <> 1 or weight <> 2").isEmpty()


def test_inverse_demand(spark):
    got = spark.range(0, 101).select((F.col("id") / 100).alias("x"), *[mixing.inverse_demand(F.col("id") / 100, F.lit(a)).alias(f"t{k}") for k, a in enumerate((-0.5, 0.0, 0.5))]).toPandas()
    for k, a in enumerate((-0.5, 0.0, 0.5)):
        t = got[f"t{k}"]
        assert ((1 - a) * t + a * t * t).tolist() == pytest.approx(got["x"].tolist())


def test_empty_tables(spark):
    assert mixing.plan_mix(table(spark, [])).count() == 0 == mixing.ordered_mix(table(spark, [])).count()
    got = mixing.plan_mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["taken"], r["first_position"]) for r in got] == [(0, 0, None)] * 2


def test_native(spark, rows):
    plan = mixing.op8(table(spark, rows).select("doc_id", "text", "source"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
