"""Loader of all packs and idempotent append."""

import pytest
from pyspark.sql import functions as F

from tessera.schemas import IDENTITY
from tessera.sources import store as S

RECORD = "id string, embedding array<float>, document string, key_hash string"


def put(spark, root, entity, sizes, identity, n_run=1):
    run = f"run-{entity}-{n_run}"  # as in the store, no two runs share a name
    entries = []
    for kind, n in sizes.items():
        rows = spark.createDataFrame([(f"{entity}/{kind}/{i}", [1.0, float(i)], "d", "h") for i in range(n)], RECORD)
        entries.append(S.stage(rows, root, entity, run, kind, 2))
    S.publish(spark, root, {"entity": entity, "version": "1", **identity, "collections": entries})


def test_loader_reads_what_manifests_name(spark, tmp_path):
    root, now = f"file://{tmp_path}", {**IDENTITY, "dim": 2}
    put(spark, root, "rs", {"faqs": 3, "tarf": 2}, now)
    put(spark, root, "sp", {"faqs": 1, "pareceres": 0}, now)
    put(spark, root, "old", {"faqs": 4}, {**now, "strategy": 1})
    put(spark, root, "rs", {"faqs": 5, "tarf": 2}, now, 2)  # the first run of rs is stale
    for stale in ("entity=old", "entity=rs/run=run-rs-1"):
        files = list((tmp_path / "packs" / stale).rglob("*.parquet"))
        assert files
        for f in files:
            f.write_bytes(b"not read by anyone")
    records, problems = S.load_all(spark, root, now)
    assert "dynamicpruning" in records._jdf.queryExecution().toString()
    assert {(r["entity"], r["kind"]): r["n"] for r in records.groupBy("entity", "kind").agg(F.count("*").alias("n")).collect()} == {("rs", "faqs"): 5, ("rs", "tarf"): 2, ("sp", "faqs"): 1}
    assert [tuple(r) for r in problems.collect()] == [("old", None, "strategy is 1", True)]
    entries = S.manifests(spark, root)
    assert [r[0] for r in S.entities_with(entries, "faqs").collect()] == ["old", "rs", "sp"] and [r[0] for r in S.entities_with(entries, "pareceres").collect()] == []
    assert {r[0] for r in S.kinds_of(entries).collect()} == {"faqs", "tarf"}
    for f in (tmp_path / "packs" / "entity=rs/run=run-rs-2/kind=tarf").glob("*.parquet"):
        f.unlink()
    assert ("rs", "tarf", False) in {(r["entity"], r["kind"], r["fatal"]) for r in S.load_all(spark, root, now)[1].collect()}
    none, nothing = S.load_all(spark, f"file://{tmp_path}/nothing", now)
    assert none.count() == nothing.count() == 0


def test_append_is_idempotent_and_counts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    rows = spark.createDataFrame([(i % 7, "x", i) for i in range(10)] + [(50, "bad", 0), (51, "later", 0)], "id int, what string, v int")
    state = F.when(F.col("what") == "bad", "failed").when(F.col("what") == "later", "remaining")
    assert S.append_new(rows, path, "id", state) == {"total": 12, "created": 7, "skipped": 3, "failed": 1, "remaining": 1}
    assert S.append_new(rows, path, "id", state) == {"total": 12, "created": 0, "skipped": 10, "failed": 1, "remaining": 1}
    assert S.append_new(rows.withColumn("id", F.col("id") + 5), path, "id") == {"total": 12, "created": 7, "skipped": 5, "failed": 0, "remaining": 0}
    assert spark.read.parquet(f"{path}/batch-*").count() == 14
    with pytest.raises(ValueError, match="add up"):
        S.append_new(rows.withColumn("id", F.col("id") + 500), path, "id", F.when(F.col("what") == "bad", "unheard of"))
    assert spark.read.parquet(f"{path}/batch-*").count() == 14
