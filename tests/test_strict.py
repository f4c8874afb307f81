"""Strict JSON at every depth, and the three outcomes."""

import pytest

from tessera.functions import strict as S
from pyspark.sql import types as T

SCHEMA = "a string, n int, list array<struct<x: long, y: string>>, tags map<string,double>"
GOOD = '{"a": "é", "n": 1, "list": [{"x": 2, "y": "z"}], "tags": {"k": 1.5, "j": 2}}'
CASES = [
    (GOOD, []),
    (" " + GOOD + "\n", []),
    (None, ["null"]),
    ("", ["no JSON"]),
    (GOOD + "x", ["no JSON"]),
    ('{"a": NaN}', ["no JSON"]),
    ("[]", ["$: no object"]),
    ("{}", ["a: missing", "n: missing", "list: missing", "tags: missing"]),
    ('{"a": "x", "a": "y", "n": 1, "list": [], "tags": {}, "more": 1}', ["a: repeated", "more: unknown"]),
    ('{"a": 1, "n": true, "list": [{"x": 1.5, "y": null, "q": 0, "q": 1}, 7], "tags": {"k": "s", "k": 1}}', ["a: no string", "n: no int", "list[0].q: repeated", "list[0].q: unknown", "list[0].x: no bigint", "list[0].y: no string", "list[1]: no object", "tags.k: repeated", "tags.k: no double"]),
    ('{"a": "x", "n": 2147483648, "list": {}, "tags": []}', ["n: out of range", "list: no array", "tags: no object"]),
    ("[" * 100_000 + "]" * 100_000, ["too deep"]),
]


def test_problems(spark):
    kind = T.StructType.fromDDL(SCHEMA)
    assert [S.problems_of(t, kind) for t, _ in CASES] == [p for _, p in CASES]
    assert S.problems_of('{"a": null, "list": [], "tags": {}}', kind, frozenset(["a", "n"])) == []
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    assert [r[0] for r in df.orderBy("i").select(S.problems(df.text, SCHEMA)).collect()] == [p for _, p in CASES]


def test_three_outcomes(spark):
    df = spark.createDataFrame([(1, '```json\n{"dispositivos": [{"texto": "art. 1"}], "ncm": [], "temas": ["x"]}\n```'), (2, '{"dispositivos": [{"texto": " \\n"}], "ncm": [], "temas": []}'), (3, '{"dispositivos": [], "ncm": [], "temas": [], "extra": 1}')], "id int, answer string")
    assert [r["id"] for r in S.extraction(df, "answer", "skip").collect()] == [1]
    got = {r["id"]: r for r in S.extraction(df, "answer", "degrade").collect()}
    assert got[1]["extraction"]["dispositivos"][0]["texto"] == "art. 1" and got[2]["extraction"] is None
    assert got[2]["extraction_problems"] == ["a blank provision"] and got[3]["extraction_problems"] == ["extra: unknown"]
    with pytest.raises(Exception, match="extra: unknown"):
        S.extraction(df.filter("id <> 2"), "answer", "error").collect()
    with pytest.raises(ValueError):
        S.extraction(df, "answer", "ignore")
