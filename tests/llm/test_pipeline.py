"""The pipeline: every stage takes effect, and the whole agrees with its stages applied by hand."""

import os
from collections import Counter

import pytest

import corpus_pipeline as cp
from tessera.llm import mixing
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [], table(spark, SF, "documents")
    for k, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(spark, steps):
    want = table(spark, SF, "documents").dtypes
    assert all(s.dtypes == want for s in steps[:-1])


def test_filters(spark, steps):
    before = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    toxic, exact, near = ({r["doc_id"] for r in s.collect()} for s in steps[:3])
    assert near <= exact <= toxic <= set(before)
    last = {}
    for i in sorted(toxic):
        last[before[i] or ""] = i
    assert exact == set(last.values())
    words = Counter(" ".join((before[i] or "").lower().split()) for i in near)
    assert max(words.values()) == 1


def test_mix_and_encoding(spark, steps):
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(steps[2]).collect() if r["taken"]}
    assert Counter(r["doc_id"] for r in steps[3].collect()) == Counter(plan)
    assert Counter(r["doc_id"] for r in steps[4].collect()) == Counter(plan)


def test_run_agrees_with_the_stages(spark, steps):
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect())
    assert key(cp.run(spark, SF)) == key(steps[-1])


CLASHES = {"score": "string", "predicted": "string", "kept": "string", "digest": "string", "text_id": "string", "position": "string", "epoch": "string", "copies": "string", "_rest": "int"}


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    """A stage keeps the rows it should with their own further columns, whatever these are called."""
    base = 10**12  # not among the labels
    prose = lambda k: " ".join(f"word{(k * 131 + j * 7) % 997}" for j in range(80))
    texts = {base + k: prose(k) for k in range(6)} | {base + 6: prose(0), base + 7: "", base + 8: None}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {t}" for c, t in CLASHES.items())
    row = lambda i, text: (i, text, None, None if (i or 0) % 2 else "a", None, *[f"{c}{i}" for c, t in CLASHES.items() if t == "string"], 1)
    rows = [row(i, t) for i, t in texts.items()] + [row(base + 1, prose(1)), row(None, prose(9))]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        seen = []
        for name, stage in cp.STAGES[:-1]:
            docs = cp.write_table(stage(spark, docs, SF), "test-pipeline")
            assert docs.dtypes == spark.createDataFrame([], schema).dtypes, name
            got = docs.collect()
            assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c, t in CLASHES.items() if t == "string"), name
            seen.append(Counter(r["doc_id"] for r in got))
        last = cp.STAGES[-1][1](spark, docs, SF).collect()
        assert Counter(r["doc_id"] for r in last) == seen[3]
        if not given:
            assert not any(seen) and not last
            continue
        assert seen[0] == Counter(r[0] for r in rows)  # no label, none rejected
        assert seen[1] == Counter([None, *(base + k for k in (1, 2, 3, 4, 5, 6, 8))]) == seen[2]
        # 560 words: source a (320 of them) weighs 1, the null source 2; each is met to within one text of 80 words
        assert set(seen[3]) <= set(seen[2]) and base + 8 not in seen[3] and max(seen[3].values()) <= 3
        own = sum(n for i, n in seen[3].items() if (i or 0) % 2 == 0)
        assert abs(80 * own - 560 / 3) < 80 and abs(80 * (seen[3].total() - own) - 1120 / 3) < 80


def test_workers_give_back_what_stages_have_freed():
    """Workers are kept for later stages, and so was the memory of all stages before."""
    import numpy as np

    from tessera.llm.common import frugal

    held, resident = [], lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    def run(batches):
        many = [np.ones(8_000) for _ in range(5_000)]
        held.append(np.ones(8_000))  # above them, so that the C library keeps what lies below
        yield len(many)

    before = resident()
    assert list(frugal(run)(iter(()))) == [5_000] and resident() - before < 100


def test_the_driver_takes_no_large_result_as_rows(spark, monkeypatch):
    """Row objects took 16 times the room of Arrow's columns, on the driver's Python side alone."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect

    def spied(self):
        rows = collect(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", spied)  # toPandas goes by it, too
    docs = table(spark, SF, "documents")
    for name, stage in cp.STAGES[:3]:
        docs = cp.write_table(stage(spark, docs, SF), "test-pipeline")
    assert seen and max(seen) < 1000


def test_the_driver_gives_back_after_a_table_at_most_once_in_a_while(spark, monkeypatch):
    from tessera.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(common, "_settled", float("-inf"), raising=False)
    monkeypatch.setattr(common, "SETTLE_S", 1000.0, raising=False)
    for _ in range(2):
        common.write_table(spark.range(3), "test-settle")
    assert len(calls) == 1
