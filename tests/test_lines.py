"""Readers of one large file: many splits give what one gives."""

import json

import pytest

from tessera.sources import lines as L


@pytest.fixture(params=[64, 1 << 27])
def splits(spark, request):
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k in keys:
        spark.conf.unset(k)


def test_offsets(spark, tmp_path, splits):
    rows = [f"línea {i} " + "x" * (i % 90) for i in range(200)] + ["", "last without an end"]
    data = "\n".join(rows).encode()
    (tmp_path / "a.txt").write_bytes(data)
    found = L.with_offsets(L.read_lines(spark, str(tmp_path / "a.txt")))
    assert (splits > 64) or found.select("block").distinct().count() > 50
    want, at = [], 0
    for r in rows:
        want.append((at, r))
        at += len(r.encode()) + 1
    assert sorted((r["offset"], r["value"]) for r in found.collect()) == want


def test_json_lines(spark, tmp_path, splits):
    rows = [json.dumps({"numero": f"n{i}", "k": i}) for i in range(100)]
    schema = "numero string, k long"
    (tmp_path / "ok.jsonl").write_text("\n".join(rows[:50] + [" ", ""] + rows[50:]) + '\n{"numero": "n1')
    assert sorted(r["k"] for r in L.read_json_lines(spark, str(tmp_path / "ok.jsonl"), schema).collect()) == list(range(100))
    (tmp_path / "whole.jsonl").write_text("\r\n".join(rows) + "\n\n")
    assert L.read_json_lines(spark, str(tmp_path / "whole.jsonl"), schema).count() == 100
    (tmp_path / "bad.jsonl").write_text("\n".join(rows[:60] + ["{broken"] + rows[60:]))
    with pytest.raises(ValueError, match=f"byte {sum(len(r) + 1 for r in rows[:60])} "):
        L.read_json_lines(spark, str(tmp_path / "bad.jsonl"), schema)
    (tmp_path / "none.jsonl").write_text("")
    assert L.read_json_lines(spark, str(tmp_path / "none.jsonl"), schema).count() == 0


def test_records_across_splits(spark, tmp_path, splits):
    text, want = "before the first\n", []
    for i in range(60):
        body = "\n".join(f"corpo {i} linha {j}" for j in range(i % 7))
        text += f"  //  {i}\n## pergunta:\n descricao : D{i}\nassunto: A{i}\nlink: http://x/{i}\nresumo: R{i}\n continua  \n## resposta:\n{body}\n\n"
        want.append((i + 1, f"D{i}", f"A{i}", f"http://x/{i}", f"R{i}\n continua", body, True))
    text += "// 1\n\n// 2\nassunto: only\n// x\nno mark"
    want.append((62, "", "only", "", "// x\nno mark", "", False))
    (tmp_path / "ref.txt").write_text(text)
    got = L.read_references(spark, str(tmp_path / "ref.txt")).drop("file").collect()
    assert sorted(tuple(r) for r in got) == want
