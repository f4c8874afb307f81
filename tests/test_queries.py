"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda x: "null" if x is None or x is pd.NA or isinstance(x, float) and x != x else str(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or str(p) == str(q) or float(p) == pytest.approx(float(q)) for p, q in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    queries.QUERIES[name](spark, SF).collect()


def test_components_of_all_edges(spark):
    """g_components and g_giant on every line item, against a union-find."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pd.read_parquet(f"{SF}/lineitem.parquet")[["l_orderkey", "l_partkey"]].itertuples(index=False):
        x, y = sorted((root(int(a)), root(int(b) + 1_000_000_000)))
        parent[y] = x
    want = {x: root(x) for x in list(parent)}
    assert {r["id"]: r["component"] for r in queries.QUERIES["g_components"](spark, SF).collect()} == want
    sizes = pd.Series(want).value_counts()
    assert {r["id"] for r in queries.QUERIES["g_giant"](spark, SF).collect()} == {x for x, c in want.items() if c == min(sizes.index[sizes == sizes.max()])}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
