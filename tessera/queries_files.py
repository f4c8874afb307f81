"""Queries of readers, strict JSON, idempotent append and tables of pages, over files that Spark writes from the test tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import strict
from tessera.operators import tables as B
from tessera.queries import query, read
from tessera.sources import lines
from tessera.sources import store as S


def scratch(s, name):
    return f"{S.shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey AS numero, o_orderpriority AS texto, o_custkey AS cliente FROM orders")
def r_json_lines(s, d):
    """Orders as JSON lines, read back; one more file holds a line that was cut."""
    path = scratch(s, "lines")
    rows = read(s, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("numero"), F.col("o_orderpriority").alias("texto"), F.col("o_custkey").alias("cliente"))).alias("value"))
    rows.write.text(path)
    cut_line(s, f"{path}/tail.txt")
    return lines.read_json_lines(s, path, "numero long, texto string, cliente long")


def cut_line(s, file):
    """A file whose last line was never finished, as a writer that died leaves it."""
    target = s._jvm.org.apache.hadoop.fs.Path(file)
    out = target.getFileSystem(s._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(b'{"numero": 1, "te'))
    out.close()


@query("SELECT c_custkey::BIGINT AS numero, 'Consulta ' || c_custkey AS descricao, c_mktsegment AS assunto, 'http://c/' || c_custkey AS link, 'Resumo de ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'segue' ELSE '' END AS resumo, CASE WHEN c_custkey % 4 > 0 THEN 'Corpo ' || c_custkey || chr(10) || 'fim' ELSE '' END AS corpo FROM customer")
def r_references(s, d):
    """Customers as records of a reference text, read back."""
    path, n = scratch(s, "references"), F.col("c_custkey")
    more = F.when(n % 3 == 0, "\nsegue").otherwise("")
    body = F.when(n % 4 > 0, F.concat(F.lit("Corpo "), n, F.lit("\nfim\n"))).otherwise("")
    text = F.concat(F.lit("// "), n, F.lit("\n## pergunta:\ndescricao: Consulta "), n, F.lit("\nassunto: "), "c_mktsegment", F.lit("\nlink: http://c/"), n, F.lit("\nresumo: Resumo de "), "c_name", more, F.lit("\n## resposta:\n"), body)
    read(s, d, "customer").select(text.alias("value")).write.text(path)
    rows = lines.read_references(s, path).filter("answered")
    return rows.select(F.regexp_extract("descricao", r"\d+", 0).cast("long").alias("numero"), "descricao", "assunto", "link", "resumo", "corpo")


CHANGED = """CASE event_id % 6 WHEN 1 THEN replace(props, '}', ', "x": 1}') WHEN 2 THEN replace(props, '}', ', "k": 7}') WHEN 3 THEN replace(replace(props, ': ', ': "'), '}', '"}') WHEN 4 THEN left(props, length(props) - 1) WHEN 5 THEN replace(props, '"k"', '"K"') ELSE props END"""


@query(f"""SELECT event_id, CASE WHEN NOT json_valid(t) THEN 'no JSON' ELSE array_to_string(list_filter([CASE WHEN len(json_keys(t)) > len(list_distinct(json_keys(t))) THEN 'k: repeated' END, CASE WHEN list_contains(json_keys(t), 'x') THEN 'x: unknown' END, CASE WHEN list_contains(json_keys(t), 'K') THEN 'K: unknown' END, CASE WHEN NOT list_contains(json_keys(t), 'k') THEN 'k: missing' WHEN json_type(t, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'k: no bigint' END], lambda v: v IS NOT NULL), '; ') END AS problems FROM (SELECT event_id, {CHANGED} AS t FROM events)""")
def t_strict_json(s, d):
    """What is wrong with the events' properties, some of which are damaged on the way."""
    k, p = F.col("event_id") % 6, F.col("props")
    damaged = F.when(k == 1, F.replace(p, F.lit("}"), F.lit(', "x": 1}'))).when(k == 2, F.replace(p, F.lit("}"), F.lit(', "k": 7}'))).when(k == 3, F.replace(F.replace(p, F.lit(": "), F.lit(': "')), F.lit("}"), F.lit('"}')))
    damaged = damaged.when(k == 4, F.expr("left(props, length(props) - 1)")).when(k == 5, F.replace(p, F.lit('"k"'), F.lit('"K"'))).otherwise(p)
    return read(s, d, "events").select("event_id", F.array_join(strict.problems(damaged, "k long"), "; ").alias("problems"))


@query("WITH a AS (SELECT * FROM orders WHERE o_orderkey % 4 <> 1), n AS (SELECT count(*) AS total, (SELECT count(DISTINCT o_custkey) FROM a) AS first FROM a), m AS (SELECT count(*) AS total, count(DISTINCT o_custkey) - (SELECT first FROM n) AS created, count(*) FILTER (o_orderstatus = 'X') AS failed FROM orders) SELECT 1 AS run, total::BIGINT AS total, first::BIGINT AS created, (total - first)::BIGINT AS skipped FROM n UNION ALL SELECT 2, total, created, total - created FROM m UNION ALL SELECT 3, total, 0, total FROM m")
def a_append_new(s, d):
    """Orders appended by customer, some first, then all, then all again: what each run counted."""
    path, rows = scratch(s, "appended"), read(s, d, "orders")
    runs = [S.append_new(x, path, "o_custkey") for x in (rows.filter("o_orderkey % 4 <> 1"), rows, rows)]
    return s.createDataFrame([(i + 1, r["total"], r["created"], r["skipped"]) for i, r in enumerate(runs)], "run int, total long, created long, skipped long")


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) SELECT c_nationkey, 0::INT AS \"row\", 0::INT AS col, 3::INT AS cols, 'Customers of ' || c_nationkey AS text FROM c GROUP BY c_nationkey UNION ALL SELECT c_nationkey, n::INT, i::INT, 1, [c_custkey::VARCHAR, c_name, c_mktsegment][i + 1] FROM c, range(3) r(i)")
def h_cells(s, d):
    """Cells of pages that list a nation's customers in a table under a heading as wide as it."""
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit(" </td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("c_custkey")), cell(F.col("c_name")), F.lit("<td><p>"), "c_mktsegment", F.lit("</p>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("html")))), lambda x: x["html"]), "\n")
    pages = read(s, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("<body><table><tr><th colspan=3>Customers of "), F.first("c_nationkey"), F.lit("</th></tr>"), rows, F.lit("</table></body>")).alias("html"))
    return B.cells(pages, "c_nationkey", "html").select("c_nationkey", "row", "col", "cols", "text")


@query("""WITH p AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
l AS (SELECT source, doc_id, place, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM p UNION ALL SELECT source, doc_id, 0, 'CONSULTA Nº: ' || doc_id || ', de 2020' FROM documents WHERE doc_id % 3 = 0 AND doc_id > 0 UNION ALL SELECT source, doc_id, 1000000, 'CONSULTA Nº: ' || (doc_id % 2) || ', citada' FROM documents WHERE doc_id % 9 = 3),
b AS (SELECT *, max(CASE WHEN place = 0 THEN doc_id END) OVER (PARTITION BY source ORDER BY doc_id, place ROWS UNBOUNDED PRECEDING) AS number FROM l WHERE line <> '' AND NOT regexp_matches(line, '^(_+|\\d+)$'))
SELECT source, number::BIGINT AS number, string_agg(line, chr(10) ORDER BY doc_id, place) AS body FROM b WHERE number IS NOT NULL GROUP BY source, number""")
def h_consultations(s, d):
    """Documents as the pages of their source, under a heading and above a foot that repeat; every third opens a consultation, some cite another at the start of a line."""
    from tessera.operators.consultations import consultations

    id = F.col("doc_id")
    opens = F.when((id % 3 == 0) & (id > 0), F.concat(F.lit("CONSULTA Nº: "), id, F.lit(", de 2020\n"))).otherwise("")
    cites = F.when(id % 9 == 3, F.concat(F.lit("\nCONSULTA Nº: "), id % 2, F.lit(", citada"))).otherwise("")
    text = F.concat(F.lit("SETOR CONSULTIVO, folha "), id, F.lit("\n______\n"), opens, F.coalesce("text", F.lit("")), cites, F.lit("\nthe page\n"), id)
    pages = read(s, d, "documents").select("source", "doc_id", text.alias("page_text"))
    return consultations(pages, "source", "doc_id", "page_text").select("source", "number", "body")
