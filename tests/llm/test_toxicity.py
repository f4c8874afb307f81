"""Toxicity: held-out accuracy on generated text, the folds, and odd inputs."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"
GOOD, BAD = "garden river bread music window letter".split(), "rotten filthy vermin stupid scum trash".split()


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        words = [rng.choice(GOOD) for _ in range(rng.randint(20, 120))]
        if toxic:
            words[rng.randrange(len(words))] = " ".join(rng.choice(BAD) for _ in range(6))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, 9.0, "p") for r in docs], "doc_id long, text string, score double, predicted string")
    return toxicity.score_toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()


def test_held_out(spark, data):
    got = run(spark, *data).set_index("doc_id")
    held = [i for i, _ in data[0] if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = {i: y for i, _, y in data[1]}
    assert np.mean([got.loc[i, "predicted"] == truth[i] for i in held]) >= 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_labels_of_the_held_out_fold_do_not_matter(spark, data):
    docs, labels = data
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    assert run(spark, docs, labels)["score"].tolist() == run(spark, docs, turned)["score"].tolist()


def test_odd_rows(spark, data):
    docs, labels = data
    odd = [(None, "rotten scum"), (1000, None), (1001, ""), (1002, "x" * 200_000), (1003, "😀 日本"), (5, docs[5][1])]
    got = run(spark, docs + odd, [*labels, (1000, None, None), (None, 1, 1), (7, 0, 0)])
    assert len(got) == len(docs) + len(odd) and got["score"].between(0, 1).all()


@pytest.mark.parametrize("kept,score", [([], 0.0), ([0], 0.0), ([1], 1.0)])
def test_one_class_or_none(spark, data, kept, score):
    got = run(spark, data[0][:20], [x for x in data[1] if x[2] in kept])
    assert got["score"].tolist() == pytest.approx([score] * 20, abs=1e-6)


def test_empty_table(spark, data):
    assert len(run(spark, [], data[1])) == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_of_the_tables(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity.op2(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() >= 0.9  # some 70 rows
    right = held["predicted"] == held["toxic"]
    assert (right[held["toxic"] == 1].mean() + right[held["toxic"] == 0].mean()) / 2 >= 0.8  # always the same answer gives 0.5


def test_repeated_documents_add_nothing_to_the_sample(spark, data):
    docs, labels = spark.createDataFrame([(r[0], r[1]) for r in data[0]], "doc_id long, text string"), data[1]
    marks = spark.createDataFrame([(r[0], r[2]) for r in labels], "doc_id long, toxic int")
    twice = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat(F.lit("\uffff"), "text")))
    one, more = toxicity.fit(docs, marks), toxicity.fit(twice, marks)
    assert one.weights == pytest.approx(more.weights) and one.bias == pytest.approx(more.bias)


def test_fit_is_the_minimum_of_the_loss():
    """Against plain gradient descent on the dense matrix, and the sums of chunks against the matrix product."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype("<u2") for _ in range(60)] + [np.zeros(0, "<u2")]
    y, r = (rng.random(61) < 0.4).astype(float), rng.normal(size=12)
    flat, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    dense = np.zeros((61, 12))
    for i, x in enumerate(rows):
        dense[i, x] = 1
    assert toxicity.sums(flat, starts, r) == pytest.approx(dense @ r)
    used = np.arange(61) % 5 != 0
    w, bias = toxicity.logistic(flat, starts, y, r, used, ridge=0.05)
    each = np.where(y == 1, 0.5 / y[used].sum(), 0.5 / (1 - y[used]).sum()) * used
    v, b = np.zeros(12), 0.0
    for _ in range(20_000):
        e = each * (1 / (1 + np.exp(-(dense * r @ v + b))) - y)
        v, b = v - 0.3 * ((dense * r).T @ e + 0.05 * v), b - 0.3 * e.sum()
    assert w == pytest.approx(v, abs=1e-3) and bias == pytest.approx(b, abs=1e-3)


def test_chunks_cover_every_row_once():
    for sizes in ([], [0, 0], [5] * 10, [0, 30, 0, 2, 2, 50, 0]):
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(int)
        got = toxicity.chunks(starts, 7)
        assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes)))


def test_weights_are_ratios_times_fit(spark):
    """Every bucket's log-count ratio by brute force: the model's weight is that ratio times the fitted weight of the bucket."""
    docs = [(i, "bad ugly" if y else "good nice", y) for i, y in ((1, 0), (2, 1), (3, 0), (4, 1), (6, 0), (7, 1), (8, 0), (9, 1)) if zlib.crc32(str(i).encode()) % 5]
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int"))
    scratch = np.zeros(1 << toxicity.BITS, bool)
    n, held = np.zeros((2, 1 << toxicity.BITS)), [0, 0]
    for _, t, y in docs:
        n[y, toxicity.buckets(t, scratch)] += 1
        held[y] += 1
    ratio = np.log((n[1] + 1) / (held[1] + 2)) - np.log((n[0] + 1) / (held[0] + 2))
    seen = np.flatnonzero(n.sum(axis=0))
    assert len(seen) and (model.weights[seen] * ratio[seen] >= 0).all()
    assert not model.weights[n.sum(axis=0) == 0].any()
