"""Update with an atomic publish: guards, reuse, partial runs, crashes before the commit, approved removals, hashes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import fnv1a64
from tessera.operators import catalog as K
from tessera.operators import integrity as I
from tessera.plans import update as U
from tessera.plans.ingest import HashingEmbedder
from tessera.sources import store as S

TREE = "kind string, titulo string, trilha string, ementa string, resumo string, corpo string, link string"


def tree(spark, rows):
    docs = spark.createDataFrame(rows, TREE)
    path = K.doc_path(F.col("kind"), F.col("titulo"), F.col("link"), F.col("trilha"))
    return docs.withColumn("path", path).withColumn("content", F.concat_ws("\n", "titulo", "trilha", "ementa", "resumo", "corpo", "link"))


RULINGS = [("pareceres", f"Parecer nº {i}/24", "", f"assunto {i}", f"resumo {i}", f"corpo {i}", f"http://x/{i}") for i in range(6)]
FAQS = [("faqs", f"Como pagar {i}?", "Menu | IPVA", "", "", f"Resposta {i}", "http://f/1") for i in range(4)]
LAWS = [("legislacao", "O que é?", "Lei 6.537-1973 — PTA | Título I", "Art. 1º", "", "É.", "http://l/1")]


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def run(spark, root, rows, **kw):
    return U.update(spark, root, "rs", tree(spark, rows), HashingEmbedder(8), **kw)


def stored(spark, root):
    return {r["id"]: r["document"] for r in S.read_store(spark, root, "rs").collect()}


def test_full_then_partial_run(spark, root):
    first = run(spark, root, RULINGS + FAQS + LAWS, version="7")
    assert [(c["kind"], c["count"], c["dim"]) for c in first["manifest"]["collections"]] == [("faqs", 4, 8), ("legislacao", 1, 8), ("pareceres", 6, 8)]
    assert "docs/legislacao/Lei 6.537-1973 — PTA/o-que-e-" in "".join(stored(spark, root)) and S.verify(spark, root, first["manifest"]) == []
    changed = [(*RULINGS[0][:4], "outro resumo", *RULINGS[0][5:]), *RULINGS[1:3], ("pareceres", "Parecer nº 9/24", "", "a", "r", "c", "http://x/9")]
    second = run(spark, root, changed + FAQS[:2], kinds=["pareceres"])
    assert second["kinds"] == {"pareceres": {"reused": 2, "embedded": 2, "orphans": 3}}
    assert second["warnings"] == [("faqs", "changed"), ("legislacao", "missing")] and second["manifest"]["version"] == "7"
    assert len(stored(spark, root)) == 4 + 1 + 7  # faqs are kept as they were, orphans of rulings stay
    old = {c["kind"]: c for c in first["manifest"]["collections"]}
    new = {c["kind"]: c for c in second["manifest"]["collections"]}
    assert new["faqs"] == old["faqs"] and new["pareceres"]["hash"] != old["pareceres"]["hash"]
    third = run(spark, root, changed + FAQS[:2])
    assert third["kinds"]["faqs"] == {"reused": 2, "embedded": 0, "orphans": 0} and [c["kind"] for c in third["manifest"]["collections"]] == ["faqs", "pareceres"]
    assert third["recovered"] == [] or all(n.startswith("run-") for n in third["recovered"])


@pytest.mark.parametrize("where", ["stage", "rename"])
def test_a_run_that_dies_leaves_the_old_packs(spark, root, monkeypatch, where):
    first = run(spark, root, RULINGS + FAQS)
    before, calls, real = stored(spark, root), [], getattr(S, where)

    def dies(*a, **kw):
        calls.append(a)
        if where == "rename" or len(calls) == 2:  # one kind is staged already
            raise KeyboardInterrupt
        return real(*a, **kw)

    monkeypatch.setattr(S, where, dies)
    with pytest.raises(KeyboardInterrupt):
        run(spark, root, RULINGS[:2] + FAQS[:1])
    monkeypatch.undo()
    assert S.read_manifest(spark, root, "rs") == first["manifest"] and stored(spark, root) == before and S.verify(spark, root, first["manifest"]) == []
    again = run(spark, root, RULINGS[:2] + FAQS[:1])
    assert any(n.startswith("run-") for n in again["recovered"]) and (where == "stage" or any(n.endswith(".tmp") for n in again["recovered"]))
    assert len(stored(spark, root)) == 6 + 1 and S.recover(spark, root, "rs") == []


def test_refusals(spark, root):
    for rows, kw, why in [
        (RULINGS, {"kinds": ["notas"]}, "no such kind"),
        (RULINGS, {"kinds": ["pareceres"]}, "no manifest"),
        ([(*RULINGS[0][:4], " \n", *RULINGS[0][5:])], {}, "no summary"),
        (RULINGS + RULINGS[:1], {}, "name collision"),
    ]:
        with pytest.raises(U.Refused, match=why):
            run(spark, root, rows, **kw)
    with pytest.raises(U.Refused, match="misplaced"):
        U.update(spark, root, "rs", tree(spark, RULINGS).withColumn("path", F.lit("docs/pareceres/x.md")), HashingEmbedder(8))
    assert S.read_manifest(spark, root, "rs") is None
    run(spark, root, RULINGS)
    with pytest.raises(U.Refused, match="identity"):
        U.update(spark, root, "rs", tree(spark, RULINGS), HashingEmbedder(16), kinds=["pareceres"])
    with pytest.raises(U.Refused, match="no documents"):
        run(spark, root, RULINGS, kinds=["tarf"])
    whole = U.update(spark, root, "rs", tree(spark, RULINGS), HashingEmbedder(16))  # a full run may
    assert whole["kinds"]["pareceres"]["reused"] == 0 and whole["manifest"]["dim"] == 16


def test_staged_files_are_checked(spark, root):
    bad = spark.createDataFrame([("a", [1.0], "d", "h"), ("a", [1.0], "d", "h")], "id string, embedding array<float>, document string, key_hash string")
    with pytest.raises(ValueError, match="repeat"):
        S.stage(bad, root, "rs", "run-1", "faqs", 1)
    with pytest.raises(ValueError, match="components"):
        S.stage(bad.limit(1), root, "rs", "run-1", "faqs", 2)


def test_removal_of_approved_orphans(spark, root):
    run(spark, root, RULINGS + FAQS)
    now = tree(spark, RULINGS[:3] + FAQS)
    with pytest.raises(U.Refused, match="pareceres changed"):
        U.remove_approved(spark, root, "rs", now, spark.createDataFrame([], "id string"))
    run(spark, root, RULINGS[:3] + FAQS)
    waiting = sorted(r["id"] for r in U.pending_removals(spark, root, "rs", now).collect())
    assert len(waiting) == 3
    approved = spark.createDataFrame([(waiting[0],), ("docs/pareceres/parecer-no-0-24.md",), ("docs/pareceres/never.md",), ("docs/faqs/x.md",)], "id string")
    got = U.remove_approved(spark, root, "rs", now, approved)
    assert got["kinds"]["pareceres"] == {"remove": 1, "wait": 2, "back": 1, "gone": 1}
    assert waiting[0] not in stored(spark, root) and len(stored(spark, root)) == 9 and S.verify(spark, root, got["manifest"]) == []
    assert U.remove_approved(spark, root, "rs", now, spark.createDataFrame([], "id string"))["manifest"] == got["manifest"]


def test_folder_hash_is_the_definition(spark):
    files = [("a", "a/x.md", b"1"), ("a", "a/b/y.md", "ç".encode()), ("a", "a/b.md", b""), ("a", "a/b-c/z.md", None), ("b", "b/q", b"\x00\xff")]
    want = {}
    for folder in "ab":
        data = b"".join(p.encode() + (c or b"") for f, p, c in sorted(files, key=lambda r: r[1].split("/")) if f == folder)
        want[folder] = f"{fnv1a64(data):016x}"
    df = spark.createDataFrame(files, "folder string, path string, content binary")
    assert {r["folder"]: r["hash"] for r in I.folder_hash(df, "folder", "path", "content").collect()} == want
    assert I.folder_hash(df.limit(0), "folder", "path", "content").count() == 0
    with pytest.raises(Exception, match="outside the folders"):
        df.select(I.first_folder(F.lit("loose.md"))).collect()


def test_content_hash_is_a_tree_of_prefixes(spark):
    rows = [("p", str(i), f"text {i % 50}") for i in range(3000)] + [("p", "7", "text 7"), ("q", None, None)]
    got = {r["part"]: (r["n_files"], r["hash"]) for r in I.content_hash(spark.createDataFrame(rows, "part string, path string, content string"), "part", "path", "content").collect()}

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    for part in "pq":
        leaves = {}
        for p, a, b in rows:
            if p == part:
                h = sha("\0".join(x for x in (a, b) if x is not None))
                leaves[h] = leaves.get(h, 0) + 1
        nodes = {h: f"{h}:{n}" for h, n in leaves.items()}
        for level in (6, 3, 0):
            groups = {}
            for name, line in nodes.items():
                groups.setdefault(name[:level], []).append(line)
            hashes = {k: sha("\n".join(sorted(v))) for k, v in groups.items()}
            nodes = {k: f"{k}:{h}" for k, h in hashes.items()}
        assert got[part] == (sum(leaves.values()), hashes[""])
    shuffled = spark.createDataFrame(rows[::-1], "part string, path string, content string").repartition(7)
    assert {r["part"]: r["hash"] for r in I.content_hash(shuffled, "part", "path", "content").collect()} == {k: v[1] for k, v in got.items()}


def test_names_of_services_and_questions(spark):
    long = "palavra " * 40
    df = spark.createDataFrame([("servicos", "Emissão de Guia", "http://a"), ("faqs", long, "http://a"), ("servicos", "!!!", "http://a"), ("tarf", "Acórdão nº 1", "x")], "kind string, titulo string, link string")
    got = [r[0] for r in df.select(K.doc_path(F.col("kind"), F.col("titulo"), F.col("link"), F.lit("L"))).collect()]
    h = lambda s: f"{fnv1a64(s.encode()) & 0xFFFFFFFF:08x}"
    assert got[0] == f"docs/servicos/emissao-de-guia-{h('http://a')}.md" and got[2] == f"docs/servicos/{h('http://a')}.md" and got[3] == "docs/tarf/acordao-no-1.md"
    cut = ("palavra-" * 40)[:60].rsplit("-", 1)[0]
    assert got[1] == f"docs/faqs/{cut}-{h('http://a' + chr(10) + long)}.md"


def test_a_tree_is_derived_once(spark, root, monkeypatch):
    """Paths, keys and hashes come from a table of the run, which is gone after it; no job of a kind derives them again."""
    seen, real = [], U.ingest
    monkeypatch.setattr(U, "ingest", lambda documents, *a: seen.append((documents.columns, documents.inputFiles())) or real(documents, *a))
    run(spark, root, RULINGS + FAQS + LAWS)
    assert [c for c, _ in seen] == [["id", "key", "document", "key_hash"]] * 3 and all(files for _, files in seen)
    target, files = S._files(spark, seen[0][1][0])
    assert not files.exists(target) and len(stored(spark, root)) == 11

