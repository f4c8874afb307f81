"""Trees in rows against a recursive walk."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import tree as T

NODES = "id string, parent string, seq int, title string, url string, page_type string"
ITEMS = "node string, seq int, question string, answer string"


def grow(seed, n):
    rng = random.Random(seed)
    nodes, items, kids = [("root", None, 0, "Root", "http://r/", "menu")], [], {}
    for i in range(n):
        parent = rng.choice(nodes[-15:])[0]
        kids[parent] = kids.get(parent, -1) + 1
        nodes.append((f"n{i}", parent, kids[parent], rng.choice(["IPVA", "Ação fiscal", "taxa", "", None]), rng.choice(["", None, f"http://u/{rng.randrange(9)}/"]), rng.choice(["menu", "faq", "geral", ""])))
    for node in nodes:
        for s in range(rng.choice([0, 0, 1, 3])):
            items.append((node[0], s, rng.choice([" Como  pagar?", "como  pagar? ", f"Ação {rng.randrange(30)}"]), f"{node[0]}/{s}"))
    return nodes, items


def walk(nodes, items):
    """Everything by recursion, as a person would write it."""
    kids, hung = {}, {}
    for x in nodes:
        kids.setdefault(x[1], []).append(x)
    for x in items:
        hung.setdefault(x[0], []).append(x)
    for x in (*kids.values(), *hung.values()):
        x.sort(key=lambda r: (r[2] if len(r) == 6 else r[1]))
    flat, names, found, counts, said, types = [], [], [], {}, {}, {}

    def url_of(x, above):
        return next((u for u in [x[4], *(a[4] for a in above[::-1])] if u), None)

    def visit(x, above, root):
        if x[4] and x[5]:
            types[x[4].removesuffix("/")] = x[5]
        mine = hung.get(x[0], [])
        for q in mine:
            said[q[2].strip().lower()] = q[3]
            if x[5] == "faq" and not root:
                flat.append(q[3])
        if not root and "acao" in (x[3] or "").lower().replace("ç", "c").replace("ã", "a"):
            found.append((x[0], None, [a[3] or "" for a in above], url_of(x, above)))
        below = above if root else [*above, x]
        total = len(mine)
        for k in kids.get(x[0], []):
            total += visit(k, below, False)
        for q in mine:
            if not root:
                names.append((x[0], q[1]))
                if "ação" in q[2].lower():
                    found.append((x[0], q[1], [a[3] or "" for a in below], url_of(x, above)))
        if not root:
            names.append((x[0], None))
        counts[x[0]] = total
        return total

    visit(kids[None][0], [], True)
    return flat, names, found, counts, said, types


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 200)])
def test_as_a_recursive_walk(spark, seed, n):
    nodes, items = grow(seed, n)
    flat, names, found, counts, said, types = walk(nodes, items)
    placed = T.place(spark.createDataFrame(nodes, NODES).repartition(3)).cache()
    hung = spark.createDataFrame(items, ITEMS)
    assert [r["answer"] for r in T.flatten(placed, hung).orderBy("n").collect()] == flat
    tree = T.listed(placed, hung, text="question").cache()
    got = T.numbered(tree).collect()
    assert [(r["id"], r["item"]) for r in sorted(got, key=lambda r: int(r["name"][5:]))] == names
    hits = T.search(tree, "AÇÃO").orderBy("path").collect()
    assert [(r["id"], r["item"], r["above"], r["url"]) for r in hits] == found
    assert {r["id"]: r["items"] for r in T.subtree_counts(placed, hung).collect()} == counts
    assert {r["key"]: r["value"] for r in T.answers(placed, hung).collect()} == said
    assert {r["key"]: r["value"] for r in T.page_types(placed).collect()} == types


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    from pyspark.sql.classic.dataframe import DataFrame

    real = DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: (rounds.append(1), real(self, *a, **k))[1])
    chain = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(300)], "id int, parent int, seq int")
    got = {r["id"]: (len(r["ancestors"]), len(r["path"])) for r in T.place(chain).collect()}
    assert got == {i: (i, i + 1) for i in range(300)} and len(rounds) <= 10


def test_cycles_lost_parents_and_empty_tables(spark):
    schema = "id int, parent int, seq int"
    assert T.place(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="cycle"):
        T.place(spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0), (4, None, 0)], schema)).collect()
    with pytest.raises(Exception, match="no node"):
        T.place(spark.createDataFrame([(1, 9, 0)], schema)).collect()
    assert T.last_write(spark.createDataFrame([("a", 1, 2), ("a", 5, 1)], "k string, v int, o int"), F.col("k"), F.col("v"), F.col("o")).first()["value"] == 1
