"""Tool calls: links, topological depth, validation, canonical JSON."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_tools as ct

SCHEMA = "conv_id long, turn long, role string, kind string, call_id string, name string, arguments string, text string, depth string"
SCHEMAS = {"add": {"required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "unit": {"type": "string", "minLength": 2, "enum": ["cm", "km"]}}, "additionalProperties": False}, "free": {}}
CASES = [
    ('{"a": 1, "b": 2.5}', ""),
    ('{"a": 1}', "b: missing"),
    ('{"a": 1.5, "b": 2}', "a: not integer"),
    ('{"a": -1, "b": 2}', "a: too small"),
    ('{"a": 1, "b": "2"}', "b: not number"),
    ('{"a": 1, "b": 2, "unit": "m"}', "unit: too short; unit: not allowed"),
    ('{"a": 1, "b": 2, "c": 3}', "unknown keys"),
    ("[1, 2]", "not an object"),
    ("{broken", "not JSON"),
    (None, "not JSON"),
]


def test_validation(spark):
    rows = [(i, i, "assistant", "call", "x", "add", a, None, "old") for i, (a, _) in enumerate(CASES)] + [(98, 0, "assistant", "call", "x", "free", '{"any": [1]}', None, "old"), (99, 0, "assistant", "call", "x", "unheard", "{}", None, "old")]
    got = {r["conv_id"]: "; ".join(r["errors"]) for r in ct.link_calls(spark.createDataFrame(rows, SCHEMA), SCHEMAS).collect()}
    assert got == {**{i: e for i, (_, e) in enumerate(CASES)}, 98: "", 99: "unknown tool"}


def test_more_keywords_are_checked_and_others_raise(spark):
    df = lambda *a: spark.createDataFrame([(i, 0, "assistant", "call", "x", "t", x, None, "old") for i, x in enumerate(a)], SCHEMA)
    errors = lambda rule, *a: [list(r["errors"]) for r in ct.link_calls(df(*a), {"t": rule}).orderBy("conv_id").collect()]
    rule = {"required": ["z"], "properties": {"n": {"maximum": 3}, "s": {"type": "string", "maxLength": 2, "pattern": "^a"}}}
    assert errors(rule, '{"n": 4, "s": "bcd", "z": 1}', '{"n": 3, "s": "ab", "z": 1}', '{"n": 1}') == [["n: too large", "s: too long", "s: no match"], [], ["z: missing"]]
    for odd in ({"oneOf": []}, {"properties": {"o": {"type": "object", "properties": {"x": {"type": "integer"}}}}}, {"properties": {"l": {"type": "array", "items": {"type": "string"}}}}, {"properties": {"u": {"type": ["string", "null"]}}}):
        with pytest.raises(ValueError, match="unsupported"):
            errors(odd, "{}")


def test_query_rows_are_in_order(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(19, -1, -1) for c in (2, 1)]
    got = [(r["conv_id"], r["depth"], r["turn"]) for r in ct.op1(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert got == sorted(got) and len(got) == len(rows)


def test_links_order_and_cycles(spark):
    call = lambda c, t, i: (c, t, "assistant", "call", i, "free", "{}", None, "old")
    result = lambda c, t, i: (c, t, "tool", "result", i, None, None, "done", "old")
    rows = [call(1, 0, "a"), result(1, 1, "a"), call(1, 2, "b"), result(1, 3, "b"), call(1, 4, "c"), call(2, 0, "p"), call(2, 1, "q"), call(2, 2, "r"), result(2, 3, "none"), call(3, 0, "d"), call(3, 1, "d"), result(3, 2, "d"), (None, 0, "tool", "result", "a", None, None, "x", "old"), (1, 9, "user", "message", None, None, None, None, "old")]
    uses = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (2, "p", "q"), (2, "q", "p"), (2, "r", "q"), (1, "a", "unknown"), (1, "c", None)], "conv_id long, call_id string, needs string")
    got = {(r["conv_id"], r["turn"]): (r["linked"], r["depth"], list(r["errors"])) for r in ct.link_calls(spark.createDataFrame(rows, SCHEMA), SCHEMAS, uses).collect()}
    assert len(got) == len(rows)
    assert [got[1, t] for t in range(5)] == [(True, 0, []), (True, 1, []), (True, 2, []), (True, 3, []), (False, 4, [])]
    assert all(got[2, t] == (False, None, ["cycle"]) for t in range(3))
    assert got[2, 3] == (False, 1, ["no call"]) and got[None, 0] == (False, 1, ["no call"])
    assert got[3, 0] == got[3, 1] == (True, 0, ["repeated call_id"]) and got[3, 2][0]
    assert got[1, 9] == (None, 0, [])


def test_extra_columns_with_clashing_names_stay(spark):
    rows = [(1, 0, "assistant", "call", "x", "free", "{}", None, "c", "r", "d", 7), (1, 1, "tool", "result", "x", None, None, "done", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("depth string", "_calls string") + ", _results string, _depth string, _rest int")
    got = ct.link_calls(df, SCHEMAS)
    assert got.columns == [*df.columns, "linked", "depth", "errors", "valid"]
    assert sorted((r["turn"], r["_calls"], r["_results"], r["_depth"], r["_rest"], r["linked"], r["depth"]) for r in got.collect()) == [(0, "c", "r", "d", 7, True, 0), (1, None, None, None, None, True, 1)]


def test_canonical_json(spark):
    got = spark.createDataFrame([(1, 'q"\\\n\té😀')], "n int, s string").select(ct.canonical({"b": F.col("s"), "a": F.col("n"), "Z": F.lit(None).cast("string")}).alias("j")).first()["j"]
    assert json.loads(got) == {"a": 1, "b": 'q"\\\n\té😀'} and got.startswith('{"a":1,"b":"q')


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 0, "user", "hi"), (2, 5, None, None), (None, 1, "assistant", "x"), (3, None, "user", ""), (4, 2, "system", "s"), (5, 0, "USER", "é\n" * 9000)]])
def test_query_against_sql(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, calls int, kind string")
    got = ct.op1(df).toPandas()
    assert len(got) == len(rows)
    if rows:
        assert not got.loc[got["conv_id"] == 1, "valid"].all() and got["json"].map(lambda x: isinstance(json.loads(x), dict)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_chat_tools", "op3_exact_dedup", "op8_mixing"])
def test_queries_with_sql(spark, name):
    from tessera.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda f: sorted(str([round(x, 6) if isinstance(x, float) else "null" if x is None or x != x else str(x) for x in r]) for r in f[columns].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_query_depths_come_from_rounds(spark, monkeypatch):
    """op1 peels calls and results like any other graph: no depth is a constant, and an answer without a question still waits for it."""
    seen, real = [], ct.message_depths
    monkeypatch.setattr(ct, "message_depths", lambda *a: seen.append(real(*a)) or seen[-1])
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 5, "assistant", "no question"), (1, 6, "system", "s"), (None, 0, "user", "q")]
    got = {(r["conv_id"], r["turn"]): r["depth"] for r in ct.op1(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 5): 1, (1, 6): 0, (None, 0): 0}
    assert sorted((r["call_id"], r["kind"], r["_depth"]) for r in seen[0].collect()) == [("0", "call", 0), ("0", "result", 1), ("4", "call", 0), ("4", "result", 1)]
