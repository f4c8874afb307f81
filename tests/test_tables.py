"""Tables on a grid: nesting, spans, broken markup; labelled headers."""

import pytest

from tessera.operators import tables as T

NESTED = """<table><tr><td>a<td rowspan=2>b &amp; c<table><tr><th>in<br>ner</th></tr></table>d</td></tr>
<tr><td colspan="2">e</td><td>f</td></tr><tr><td>g<td>h<td>i</table><p>out</p><table><td>lone</table>"""


def texts(page):
    return [(c["table"], c["parent"], c["row"], c["col"], c["rows"], c["cols"], " ".join(p for p in c["paragraphs"] if p)) for c in T.grid_of(page)]


def test_nesting_and_spans():
    assert texts(NESTED) == [
        (0, None, 0, 0, 1, 1, "a"),
        (0, None, 0, 1, 2, 1, "b & cd"),
        (1, 0, 0, 0, 1, 1, "in ner"),
        (0, None, 1, 0, 1, 2, "e"),
        (0, None, 1, 2, 1, 1, "f"),
        (0, None, 2, 0, 1, 1, "g"),
        (0, None, 2, 1, 1, 1, "h"),
        (0, None, 2, 2, 1, 1, "i"),
        (2, None, 0, 0, 1, 1, "lone"),
    ]


@pytest.mark.parametrize("page", [None, "", "<p>no table", "</table></td>", "<table>", "<table><tr>", "<table><tr></table>"])
def test_pages_without_cells(page):
    assert T.grid_of(page) == []


def test_strange_spans():
    rows = texts("<table><tr><td rowspan=0>a<td colspan=x>b<td colspan=-1>c<td colspan=99999>d<tr><td>e</table>")
    assert [(r[4], r[5]) for r in rows] == [(2, 1), (1, 1), (1, 1), (1, 1000), (1, 1)] and rows[-1][3] == 1


def run(spark, page):
    pages = spark.createDataFrame([(1, page)], "id int, html string")
    return [(r["subject"], r["reasons"]) for r in T.labelled(T.cells(pages, "id", "html"), "id", "EMENTA").collect()]


def test_labelled_headers(spark):
    stacked = "<table><tr><td width=2>&nbsp;</td><td><p>RECURSO</p><p>E M E N T A :</p></td><td><p>nº 1</p><p>ICMS. Multa.</p><p>Razão um.</p><p></p><p>ACÓRDÃO</p><p>Não entra.</p></td></tr><tr><td></td><td><p>Razão dois.</p></td><td>Razão três.</td></tr><tr><td>VOTO</td><td>fora</td></tr><tr><td></td><td>fora</td></tr></table>"
    assert run(spark, stacked) == [("ICMS. Multa.", ["Razão um.", "Razão dois.", "Razão três."])]
    assert run(spark, "<table><tr><td>x</td></tr></table><table><tr><td><p>EMEN-TA: Ementa: IPVA.</p><p>Segue.</p></td><td>Mais.</td></tr></table>") == [("IPVA.", ["Segue.", "Mais."])]
    assert run(spark, "<table><tr><td>EMENTA</td><td></td></tr></table>") == [] and run(spark, "<p>EMENTA</p>") == []
