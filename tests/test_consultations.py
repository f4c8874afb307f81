"""Consultations out of pages: furniture, cited numbers, subjects."""

import itertools
import random

from tessera.operators import consultations as C


def test_longest_run_against_all_runs():
    rng = random.Random(4)
    for _ in range(300):
        numbers = [rng.randrange(6) for _ in range(rng.randrange(8))]
        runs = [p for n in range(len(numbers) + 1) for p in itertools.combinations(range(len(numbers)), n) if all(numbers[a] < numbers[b] for a, b in zip(p, p[1:]))]
        most = max(map(len, runs))
        assert C.longest_run(numbers) == list(min(p for p in runs if len(p) == most))


def test_pages_to_consultations(spark):
    head, page = "SECRETARIA DE ESTADO DA FAZENDA\n  SETOR CONSULTIVO {}\n______\n", "\n{}\n"
    texts = [
        "preface\nCONSULTA Nº: 12, de 3 de maio\nSÚMULA: ICMS. CRÉDITO\n  PRESUMIDO. A\nA consulente informa.",
        "Conforme a\nCONSULTA Nº 7/2001, citada, e a\nCONSULTA Nº: 99 do outro ano\nfim da doze.\nSETOR CONSULTIVO 9\nno meio fica.\nlast but one\nlast",
        "CONSULTA Nº: 13, de 4 de maio\nRELATOR: FULANO\nsem rótulo",
        "CONSULTA Nº 14, de 5\nASSUNTO:\nIPVA\nRELATOR: BELTRANO\nIPVA NÃO",
    ]
    rows = [("a", i, head.format(i) + t + page.format(i + 1)) for i, t in enumerate(texts)] + [("b", 0, "CONSULTA Nº: 1, x\n17\n___\nEMENTA - TAXA\ncorpo"), ("c", 0, None), ("d", 0, "nothing")]
    got = {(r["key"], r["number"]): (r["subject"], r["body"]) for r in C.consultations(spark.createDataFrame(rows, "key string, page int, text string"), "key", "page", "text").collect()}
    assert sorted(got) == [("a", 12), ("a", 13), ("a", 14), ("b", 1)]
    assert got["a", 12][0] == "ICMS. CRÉDITO PRESUMIDO." and got["a", 12][1].startswith("CONSULTA Nº: 12") and got["a", 12][1].endswith("SETOR CONSULTIVO 9\nno meio fica.\nlast but one\nlast")
    assert "CONSULTA Nº: 99" in got["a", 12][1] and "SECRETARIA" not in "".join(b for _, b in got.values())
    assert got["a", 13] == ("", "CONSULTA Nº: 13, de 4 de maio\nRELATOR: FULANO\nsem rótulo") and got["a", 14][0] == "IPVA"
    assert got["b", 1][1] == "CONSULTA Nº: 1, x\nEMENTA - TAXA\ncorpo"
