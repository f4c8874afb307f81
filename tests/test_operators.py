"""Tables of cases for expressions and operators."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, legal, text
from tessera.operators import citations, lexical, pii, relational, vector
from tessera.operators.graph import connected_components
from tessera.plans.ingest import HashingEmbedder, ingest, manifest, same_identity
from tessera.schemas import IDENTITY
from tessera.sources import files


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_distance(spark):
    cases = [([1.0, 0.0], [2.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 1.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 2.0), ([1.0], [1.0, 2.0], 2.0), ([0.0, 0.0], [1.0, 1.0], 2.0), ([], [], 2.0)]
    df = spark.createDataFrame(cases, "a array<float>, b array<float>, want double")
    for r in df.select("want", vector.cosine_distance(F.col("a"), F.col("b")).alias("x"), vector.cosine_distance_np(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.x == r.want == r.y


def test_topk_and_band(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 0, [0.0, 1.0]), (4, 0, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    q = rows.filter("vec_id = 1")
    assert [r.vec_id for r in vector.topk(rows, q, 2).collect()] == [1, 4]
    hits = vector.topk_per(rows, q, 10, "label")
    assert {r.vec_id for r in vector.narrow(hits, "label", 0, 0.1).collect()} == {1, 2, 4}
    assert {r.vec_id for r in vector.narrow(hits, "label", 4, 0.0).collect()} == {1, 2, 3, 4}
    assert vector.narrow(hits, "label").count() == 4
    assert vector.topk(rows.limit(0), q, 3).count() == 0


def test_topk_plan_is_a_heap(spark):
    rows = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    plan = vector.topk(rows, rows.filter("vec_id = 0"), 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_slugs(spark):
    assert values(spark, ["Nº 12 — Ação & Ñandú", "  æther ß ", "", "a" * 80], text.slug) == ["no-12-acao-nandu", "aether-ss", "", "a" * 80]
    assert values(spark, ["abc-def-ghi", "abcdefghij", "ab"], lambda c: text.cut_slug(c, 8)) == ["abc-def", "abcdefgh", "ab"]
    assert values(spark, ["Portal e-CAC", "Ítem nº"], text.system_slug) == ["portal-e-cac", "item-n"]


def test_keys(spark):
    assert values(spark, ["x" * 7000], lambda c: F.char_length(text.compose_key(F.lit("t"), c))) == [6000]
    assert values(spark, [" a  b "], lambda c: text.faq_key(F.lit("o"), c, F.lit(""))) == ["o\nP: a b"]
    assert values(spark, ["r"], lambda c: text.block(F.lit("q"), c, F.lit(""))) == ["## pergunta\nq\n## resposta\nr"]


def test_citations(spark):
    cases = {
        "Livro I, art. 27, inciso x, do RICMS": ("ricms-rs:lI:art27:incX", "inc. X, art. 27, Livro I do RICMS/RS"),
        "parágrafo único do art. 1º-K da Lei nº 8.820/89": ("lei:8820/89:art1-K:§unico", "§ único, art. 1-K do Lei nº 8820/89"),
        "Lei nº 11.442, de 05.01.07": ("lei:11442/07", "Lei nº 11442/07"),
        "Lei Complementar nº 87/96": ("lc:87/96", "LC nº 87/96"),
        "Convênio ICMS 142/18": ("convenio:142/18", "Convênio ICMS 142/18"),
        "IN DRP nº 45/98, Título I, Capítulo XI, Seção 2.0": ("in-drp:45/98:tI:capXI:sec2.0", "Seção 2.0, Capítulo XI, Título I do IN DRP 45/98"),
        "o referido art. 3º da Lei 1/90": None, "Art. 32 - Assegura-se o RICMS": None, "nada": None, "RICMS " + "x" * 130: None,
    }
    got = values(spark, list(cases), legal.canonical_citation)
    assert [tuple(x) if x else None for x in got] == list(cases.values())


def test_systems(spark):
    assert values(spark, ["Portal e-CAC", "Sistema qualquer (DTE)", "Receita Estadual", "e-mail", "Coisa Nova (XYZ)", "x" * 61, ""], legal.canonical_system) == ["e-cac", "dte", None, None, "coisa-nova-xyz", None, None]


def test_sort_keys(spark):
    assert [tuple(x) if x else None for x in values(spark, ["123/2019", "Parecer 45/98", "12/05", "AB19007", "sem", "1/234"], legal.chronological_key)] == [(2019, 123), (1998, 45), (2005, 12), (2019, 7), None, None]
    got = [tuple(x) for x in values(spark, ["Art. 9º", "Art. 1º-K, § 2º, IV, b.3", "Arts. 5, caput", "x", "Art. 3, parágrafo único, I"], legal.provision_key)]
    assert got == [(9, 0, 0, 0, 0, 0, 0), (1, 11, 2, 0, 4, 2, 3), (5, 0, 0, 0, 0, 0, 0), (None,) * 7, (3, 0, 1, 0, 1, 0, 0)]
    assert values(spark, ["MCMXCIV", "iv", "K"], legal.roman) == [1994, 4, None]


def test_search(spark):
    docs = spark.createDataFrame([(1, "Isenção de ICMS", "2020"), (2, "isencao", None), (3, "outra coisa 7", "x")], "id int, a string, b string")
    ask = lambda q: [r.id for r in lexical.search(docs, q, ["a", "b"]).orderBy("id").collect()]
    assert ask("ISENÇÃO") == [1, 2] and ask("isencao 2020") == [1] and ask("") == [1, 2, 3] and ask("a e 7") == [3]
    assert lexical.spans("Ação e ação", ["acao"]) == [{"start": 0, "end": 4}, {"start": 7, "end": 11}]
    assert lexical.spans("abcd", ["ab", "cd"]) == [{"start": 0, "end": 4}]


def test_merge_and_orphans(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    new = spark.createDataFrame([("b", 1, 20), ("b", 2, 21), ("d", 1, 40)], "id string, seq int, v int").select("id", "v", "seq")
    got = relational.merge(old, new, old.filter("id = 'c'"), "id", "seq")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 21), ("d", 40)]
    state = relational.approved_removals(old.filter("id in ('a', 'b')").unionByName(spark.createDataFrame([("z", 0)], "id string, v int")), old, old.filter("id = 'b'"), "id")
    assert dict(map(tuple, state.collect())) == {"a": "remove", "b": "back", "c": "wait", "z": "gone"}


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    groups = defaultdict(list)
    for x in parent:
        groups[root(x)].append(x)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def test_components_of_long_shuffled_paths(spark):
    import random

    rng, edges, want = random.Random(4), [], {}
    ids = rng.sample(range(10**6), 4500)
    for path in (ids[:3000], ids[3000:]):
        edges += zip(path, path[1:])
        want |= dict.fromkeys(path, min(path))
    assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect())) == want


def test_related(spark):
    m = spark.createDataFrame([("d1", "x"), ("d1", "y"), ("d2", "x"), ("d2", "y"), ("d3", "x"), ("d4", "x"), ("d4", "y"), ("d4", "y")], "doc string, key string")
    seeds = spark.createDataFrame([("d1",)], "doc string")
    assert [tuple(r) for r in citations.related(m, seeds, 2, 3).collect()] == [("d2", 2), ("d4", 2)]


@pytest.mark.parametrize(("sentence", "cls", "secret"), [
    ("meu CPF é 529.982.247-25.", "CPF", "529.982.247-25"), ("CNPJ 11.222.333/0001-81", "CNPJ", "11.222.333/0001-81"), ("cnpj 12.ABC.345/01DE-35", "CNPJ", "12.ABC.345/01DE-35"),
    ("escreva a fulano@exemplo.com.br", "EMAIL", "fulano@exemplo.com.br"), ("telefone (51) 99999-1234", "TELEFONE", "(51) 99999-1234"), ("moro no CEP 90010-150", "CEP", "90010-150"),
    ("nasci em nascimento 12/05/1980", "DATA_NASCIMENTO", "12/05/1980"), ("placa do veículo ABC1D23", "PLACA", "ABC1D23"), ("protocolo 2023/000123456", "PROTOCOLO", "2023/000123456"),
    ("a empresa Padaria Estrela Ltda pediu", "RAZAO_SOCIAL", "Padaria Estrela Ltda"), ("contribuinte João da Silva", "NOME", "João da Silva"), ("na Rua das Flores, 123", "ENDERECO", "Rua das Flores, 123"),
])
def test_pii(sentence, cls, secret):
    assert (cls, secret) in {(x["cls"], x["text"]) for x in pii.detect(sentence)}
    masked, known = pii.mask(sentence)
    assert secret not in masked and pii.restore(masked, known) == sentence


@pytest.mark.parametrize("sentence", ["O art. 27 do RICMS, Livro I", "Convênio ICMS 142/18", "valor de 1.234,56 em 12/05/2020", "NCM 8471.30.12", "CPF 111.111.111-11"])
def test_pii_controls(sentence):
    assert pii.detect(sentence) == []


def test_documents(spark):
    good = "﻿---\ntitulo: A: b\ntrilha: t\nementa:\nlink: http://x\n---\n\n## resumo\nS\n\n## corpo\nC\n## resumo\nnot one\n"
    bad = {"x": "no header", good.replace("link", "lin"): "unknown key", good.replace("ementa:", "titulo: z"): "repeated key", good.replace("ementa:\n", ""): "missing key", good.replace("## corpo", "## corp"): "no body", good.replace("\n## resumo\nS", "\nstray\n## resumo\nS", 1): "text before the sections", good.replace("---\n\n", "resumo_modelo: m\n---\n\n"): "partial summary data"}
    got = values(spark, [good, *bad], files.parse_document)
    assert got[0].error is None and got[0].header["titulo"] == "A: b" and got[0].resumo == "S" and got[0].corpo == "C\n## resumo\nnot one"
    assert [x.error for x in got[1:]] == list(bad.values())
    again = values(spark, ["corpo\ntwo"], lambda c: files.parse_document(files.render_document(F.lit("t  t"), F.lit(""), F.lit("e"), F.lit("l"), F.lit("s"), c)))
    assert again[0].error is None and again[0].corpo == "corpo\ntwo" and again[0].header["titulo"] == "t t"
    assert values(spark, ["a/b.md", "/a", "a/../b", "./a", ""], files.safe_path) == [True, False, False, False, False]


def test_lines(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"numero": "1"}\n{"numero": "2"}\n{"num')
    assert [r.numero for r in files.read_lines(spark, str(tmp_path / "ok.jsonl")).collect()] == ["1", "2"]
    (tmp_path / "bad.jsonl").write_text('{"numero": "1"}\n{"num\n{"numero": "2"}\n')
    with pytest.raises(Exception, match="broken line"):
        files.read_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    assert files.read_pack(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "pack.json").write_text('{"records": [{"id": "a", "embedding": [1, 2], "document": "d"}]}')
    assert files.read_pack(spark, str(tmp_path / "pack.json")).first().embedding == [1.0, 2.0]
    (tmp_path / "ref.txt").write_text("// 1\nassunto: A\nresumo: r1\nr2\n// 2\nassunto: B\n")
    assert [(r.assunto, r.resumo) for r in files.read_references(spark, str(tmp_path / "ref.txt")).orderBy("n").collect()] == [("A", "r1\nr2"), ("B", "")]
    (tmp_path / "reg.toml").write_text('[[entity]]\nid = "rs"\nname = "RS"\ncollections = ["faqs"]\n')
    assert files.read_registry(spark, str(tmp_path / "reg.toml")).first().id == "rs"


def test_hashes(spark):
    assert values(spark, ["", "a", "foobar"], hashing.key_hash) == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    texts = ["", "a", "é", "abc"]
    assert values(spark, texts, hashing.half) == [(1 + sum(b & 1 for b in t.encode())) % 2 for t in texts]


def test_incremental_equals_rebuild(spark):
    embedder = HashingEmbedder(16)
    docs = lambda rows: spark.createDataFrame([(i, k, "{}") for i, k in rows], "id string, key string, document string")
    empty = spark.createDataFrame([], "id string, embedding array<float>, document string, key_hash string")
    first, _ = ingest(docs([("a", "um dois"), ("b", "tres")]), empty, embedder, True)
    after = docs([("a", "um dois"), ("b", "mudou"), ("c", "novo")])
    step, gone = ingest(after, first, embedder, True)
    whole, _ = ingest(after, empty, embedder, False)
    show = lambda x: sorted((r.id, tuple(r.embedding), r.key_hash) for r in x.collect())
    assert show(step) == show(whole) and gone.count() == 0
    less, gone = ingest(docs([("a", "um dois")]), first, embedder, True)
    assert [r.id for r in gone.collect()] == ["b"] and less.count() == 2
    stamp = lambda x: [tuple(r) for r in manifest(x.withColumn("kind", F.lit("faqs"))).collect()]
    assert stamp(step) == stamp(whole.repartition(3))
    assert same_identity(dict(IDENTITY)) and not same_identity(IDENTITY | {"dim": 3})


def test_nearest_each_is_brute_force_in_blocks(spark, monkeypatch):
    """Copies, ties, odd and broken vectors over many blocks, against all pairs; the query makes no nested loop over pairs."""
    import random

    from pyspark.sql import Window

    from tessera import queries
    from tessera.operators import vector

    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    odd = {5: None, 6: [0.0] * 8, 7: [1.0] * 5, 8: [float("nan")] + [1.0] * 7, 9: [None] + [1.0] * 7, 10: [float("inf")] + [1.0] * 7, 11: []}
    rows = [(i, i % 5, odd[i % 37] if i % 37 in odd else [x + rng.choice([0, 0, 1e-4]) for x in rng.choice(base)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    asked = df.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"), F.col("embedding").alias("qv"))
    monkeypatch.setattr(vector, "BLOCK", (40, 64))
    pairs = df.join(asked, F.col("vec_id") != F.col("qid")).withColumn("dist", vector.cosine_distance(F.col("embedding"), F.col("qv")))
    want = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vec_id"))).filter("rn <= 5")
    told = lambda f: sorted((r["qid"], r["rn"], r["vec_id"], r["ql"], r["label"], str(r["dist"])) for r in f.collect())
    assert told(vector.nearest_each(df, asked, 5)) == told(want)
    df.write.parquet(folder := f"{spark.conf.get('spark.checkpoint.dir')}/nearest-each/embeddings.parquet", mode="overwrite")
    plan = queries.QUERIES["e_hit_at_k"](spark, folder.removesuffix("/embeddings.parquet"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_halves_round_as_the_expression_does(spark):
    from tessera.operators.vector import rounded

    values = [x / 2e6 + d for x in range(1, 400, 7) for d in (0.0, 1e-16, -1e-16, 3e-10)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()
    assert rounded(np.array(values)).tolist() == [r[0] for r in got]


def test_rounds_of_components_work_on_what_is_left(spark, monkeypatch):
    """Numbers, texts and bytes as nodes; each round's tables are smaller than the last one's, so that all rounds together stay in proportion to the edges."""
    import random

    from tessera.operators import graph

    rng, sizes, real = random.Random(8), [], graph._written
    monkeypatch.setattr(graph, "_written", lambda df: (lambda t: sizes.append(t.count()) or t)(real(df)))
    edges = [(i, i + 1) for i in range(600) if i % 100 != 99] + [(rng.randrange(1000, 1200), 2000 + rng.randrange(300)) for _ in range(1500)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert sum(sizes) <= 4 * len(edges) and all(got[i] == i // 100 * 100 for i in range(600))
    assert {got[a] for a, _ in edges if a >= 1000} == {1000} and len(got) == len({x for e in edges for x in e})
    for kind, name in (("string", lambda x: f"n{x:05d}"), ("binary", lambda x: f"n{x:05d}".encode())):
        other = graph.connected_components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")).collect()
        assert {(r["id"] if kind == "string" else bytes(r["id"])): (r["component"] if kind == "string" else bytes(r["component"])) for r in other} == {name(k): name(v) for k, v in got.items()}


def test_batches_are_taken_in_pieces():
    """What highlight and mask_pii make of a batch leaves them piece by piece, in order and whole."""
    import pandas as pd

    batch = pd.Series(["the end " * 2000, None, "", *["the " * 500] * 2000, "x" * (1 << 20), "the"])
    for f in (lexical.highlight("the en").func, pii.mask_pii.func):
        parts = list(f(iter([batch, batch[:0]])))
        assert len(parts) > 8 and sum(map(len, parts)) == len(batch)
    marks = [r for part in lexical.highlight("the en").func(iter([batch])) for r in part]
    assert marks == [lexical.spans(t or "", ["the", "en"]) for t in batch]


def test_numbers_in_parts_deal_out_no_part_whole(spark):
    """Two large parts, a null one and single rows; the last join is by task and part."""
    rows = [(("a", "b", None)[i % 3] if i < 900 else f"p{i}", (i * 37) % 1009) for i in range(950)]
    got = relational.number_in_parts(spark.createDataFrame(rows, "p string, v int"), ["p"], [F.col("v")])
    want = {(p, v): k + 1 for q in {p for p, _ in rows} for k, (p, v) in enumerate(sorted(r for r in rows if r[0] == q))}
    assert got.columns == ["p", "v", "n"] and {(r["p"], r["v"]): r["n"] for r in got.collect()} == want
    assert "_task" in next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)

