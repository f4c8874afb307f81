"""Queries of the catalogue operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hashing as H
from tessera.functions import text as T
from tessera.operators import catalog as K
from tessera.operators import lexical as L
from tessera.operators import pii as P
from tessera.operators import relational as R
from tessera.queries import query, read

KIND = "CASE p_partkey % 5 WHEN 0 THEN 'servicos' WHEN 1 THEN 'faqs' WHEN 2 THEN 'legislacao' WHEN 3 THEN 'pareceres' ELSE 'tarf' END"
PLAIN_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


def parts(s, d):
    k = F.col("p_partkey") % 5
    kind = F.when(k == 0, "servicos").when(k == 1, "faqs").when(k == 2, "legislacao").when(k == 3, "pareceres").otherwise("tarf")
    return read(s, d, "part").withColumn("kind", kind)


@query("SELECT p_partkey, left(array_to_string(list_filter([p_name, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END], lambda x: x <> ''), chr(10)), 6000) AS key FROM part")
def k_ruling_key(s, d):
    return read(s, d, "part").select("p_partkey", K.ruling_key(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")).alias("key"))


@query(f"SELECT p_partkey, {KIND} AS kind, left(CASE WHEN p_partkey % 5 >= 3 THEN p_name || chr(10) || p_brand || chr(10) || p_type WHEN p_partkey % 5 = 0 THEN p_brand || ' | ' || p_size || chr(10) || p_name || chr(10) || p_type ELSE p_brand || ' | ' || p_size || chr(10) || 'P: ' || p_name || CASE p_partkey % 5 WHEN 2 THEN chr(10) || p_brand ELSE '' END || chr(10) || 'R: ' || p_type END, 6000) AS key FROM part")
def k_key_by_kind(s, d):
    trail = F.concat("p_brand", F.lit(" | "), "p_size")
    return parts(s, d).select("p_partkey", "kind", K.embedding_key(F.col("kind"), trail, F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_type")).alias("key"))


@query(f"SELECT kind, count(*)::BIGINT AS n, label, plural, title FROM (SELECT {KIND} AS kind FROM part) JOIN (VALUES ('servicos', 'Serviço', 'serviços', 'Serviços'), ('faqs', 'FAQ', 'perguntas frequentes', 'Perguntas Frequentes'), ('legislacao', 'Legislação', 'perguntas de legislação', 'Legislação'), ('pareceres', 'Parecer', 'pareceres', 'Pareceres'), ('tarf', 'Acórdão TARF', 'acórdãos', 'Acórdãos TARF')) v(kind, label, plural, title) USING (kind) GROUP BY ALL")
def j_kind_labels(s, d):
    return K.with_labels(parts(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({}, ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
LOW = "format('{{:08x}}', ({} % 4294967296)::UBIGINT)"
LINK = "'http://x/' || p_partkey"
PATH = f"'docs/' || kind || '/' || CASE WHEN kind IN ('pareceres', 'tarf') THEN {PLAIN_SLUG.format('p_name')} WHEN kind = 'servicos' THEN {PLAIN_SLUG.format('p_name')} || '-' || {LOW.format(FNV.format(LINK))} ELSE CASE kind WHEN 'legislacao' THEN p_brand || '/' ELSE '' END || {PLAIN_SLUG.format('p_name')} || '-' || {LOW.format(FNV.format(LINK + ' || chr(10) || p_name'))} END || '.md'"


def paths(s, d):
    return parts(s, d).withColumn("path", K.doc_path(F.col("kind"), F.col("p_name"), F.concat(F.lit("http://x/"), F.col("p_partkey")), F.concat_ws(" | ", "p_brand", "p_type")))


@query(f"SELECT p_partkey, {PATH} AS path FROM (SELECT *, {KIND} AS kind FROM part)")
def k_doc_path(s, d):
    return paths(s, d).select("p_partkey", "path")


@query(f"SELECT p_partkey, {PATH} AS path FROM (SELECT *, {KIND} AS kind FROM part) WHERE p_size % 7 = 0")
def d_misplaced(s, d):
    rows = paths(s, d).withColumn("read_from", F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x/"), "path")).otherwise(F.col("path")))
    return K.misplaced(rows, "path", "read_from").select("p_partkey", "path")


PAYLOAD = "'{\"titulo\":\"' || p_name || '\",\"ementa\":\"' || p_brand || '\",\"resumo\":\"' || p_type || '\",\"link\":\"n' || p_partkey || '\"}'"


def payloads(s, d):
    rows = read(s, d, "part").select("p_partkey", F.col("p_name").alias("titulo"), F.col("p_brand").alias("ementa"), F.col("p_type").alias("resumo"), F.concat(F.lit("n"), "p_partkey").alias("link"))
    return rows.select("p_partkey", "titulo", K.payload("titulo", "ementa", "resumo", "link").alias("payload"))


@query(f"SELECT p_partkey, {PAYLOAD} AS payload FROM part")
def k_payload(s, d):
    return payloads(s, d).select("p_partkey", "payload")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS numero, CASE WHEN p_partkey % 3 = 0 THEN 'no json: ' || p_name ELSE p_brand END AS assunto, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS resumo FROM part")
def k_payload_decoded(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("no json: "), "titulo")).otherwise(F.col("payload"))
    got = payloads(s, d).select("p_partkey", K.decode_payload(raw).alias("h")).select("p_partkey", "h.*")
    return got.withColumnsRenamed({"titulo": "numero", "ementa": "assunto"}).select("p_partkey", "numero", "assunto", "resumo")


@query("SELECT n_regionkey, string_agg(chr(10) || '## documento ' || n || ': ' || n_name || chr(10) || n_nationkey || chr(10), '' ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) AS n FROM nation) GROUP BY n_regionkey")
def k_context(s, d):
    rows = read(s, d, "nation").withColumn("text", F.col("n_nationkey").cast("string"))
    return K.context(rows, ["n_regionkey"], ["n_name", "n_nationkey"], "n_name", "text")


@query(f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p_partkey) AS n FROM (SELECT *, {KIND} AS kind FROM part) WHERE kind IN ('pareceres', 'tarf') AND p_size % 4 = 0) SELECT kind, count(*)::BIGINT AS refused, string_agg(p_partkey::VARCHAR, ', ' ORDER BY p_partkey) FILTER (n <= 5) AS names FROM b GROUP BY kind")
def d_missing_summary(s, d):
    return K.missing_summary(parts(s, d).withColumn("summary", F.when(F.col("p_size") % 4 == 0, " \n\t").otherwise("text")), "kind", "p_partkey", "summary")


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'no description' WHEN 1 THEN 'no keywords' WHEN 2 THEN 'order' WHEN 3 THEN 'empty' WHEN 4 THEN 'too long' WHEN 5 THEN 'few keywords' ELSE '' END AS problem FROM part")
def d_valid_summary(s, d):
    k, head, tail = F.col("p_partkey") % 7, F.lit("## desc\n"), F.lit("\n## words\n- a\n\t- b\n- c")
    text = F.when(k == 0, "text").when(k == 1, F.concat(head, "p_name")).when(k == 2, F.concat(tail, head)).when(k == 3, F.concat(head, F.lit("  "), tail)).when(k == 4, F.concat(head, F.repeat("p_name", F.lit(400)), tail)).when(k == 5, F.concat(head, "p_name", F.lit("\n## words\n- a\nb\n- c"))).otherwise(F.concat(head, "p_name", tail))
    return read(s, d, "part").select("p_partkey", K.valid_summary(text, "## desc", "## words").alias("problem"))


@query("SELECT p_partkey, '{\"a\": ' || p_partkey || '}' AS text FROM part")
def t_unfenced(s, d):
    k, body = F.col("p_partkey") % 3, F.concat(F.lit('{"a": '), "p_partkey", F.lit("}"))
    return read(s, d, "part").select("p_partkey", K.unfenced(F.when(k == 0, F.concat(F.lit(" ```json\n"), body, F.lit("\n``` "))).when(k == 1, F.concat(F.lit("```"), body, F.lit("```"))).otherwise(body)).alias("text"))


@query("SELECT p_brand, count(*)::BIGINT AS rows FROM part GROUP BY p_brand HAVING count(*) < (SELECT count(*) / 25 FROM part)")
def d_below_minimum(s, d):
    rows = read(s, d, "part")
    return K.below_minimum(rows, "p_brand", -(-rows.count() // 25))


AUDIENCE = "(VALUES ('MAIL', 1), ('SHIP', 2), ('AIR', 3)) a(audience, rank)"


def occurrences(s, d):
    li = read(s, d, "lineitem").select(F.col("l_orderkey").alias("service"), F.when(F.col("l_returnflag") == "R", "MAIL").when(F.col("l_linestatus") == "O", "SHIP").otherwise("TRUCK").alias("audience"), F.col("l_linenumber").alias("seq"))
    # an order may have a line number twice: the first by name counts
    return li.groupBy("service", "seq").agg(F.min("audience").alias("audience")), s.createDataFrame([("MAIL", 1), ("SHIP", 2), ("AIR", 3)], "audience string, rank int")


OCCURS = "WITH o AS (SELECT l_orderkey AS service, l_linenumber AS seq, min(CASE WHEN l_returnflag = 'R' THEN 'MAIL' WHEN l_linestatus = 'O' THEN 'SHIP' ELSE 'TRUCK' END) AS audience FROM lineitem GROUP BY ALL) "


@query(OCCURS + f"SELECT audience, service, seq, row_number() OVER (PARTITION BY audience ORDER BY service, seq)::BIGINT AS id FROM o JOIN {AUDIENCE} USING (audience)")
def j_fan_out(s, d):
    return K.fan_out(*occurrences(s, d), "service").select("audience", "service", "seq", F.col("id").cast("long").alias("id"))


@query(OCCURS + f"SELECT service, arg_min(audience, row(coalesce(rank, 2147483647), seq)) AS audience FROM o LEFT JOIN {AUDIENCE} USING (audience) GROUP BY service")
def a_primary_occurrence(s, d):
    return K.primary_occurrence(*occurrences(s, d), "service")


@query(OCCURS + ", c AS (SELECT service, audience, count(*) AS n FROM o GROUP BY ALL) SELECT service, arg_min(audience, row(-n, audience)) AS audience FROM c GROUP BY service")
def a_predominant(s, d):
    return K.predominant(occurrences(s, d)[0], "service", "audience")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '2026-02-01' WHEN n_nationkey % 2 = 0 THEN '2026-02-01' ELSE '2026-01-01' END AS updated FROM nation")
def j_keep_dates(s, d):
    n = read(s, d, "nation")
    current = n.select("n_nationkey", F.md5("n_name").alias("hash"), F.lit("2026-02-01").alias("updated"))
    previous = n.filter("n_nationkey % 3 <> 0").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "old").otherwise(F.md5("n_name")).alias("hash"), F.lit("2026-01-01").alias("updated"))
    return K.keep_dates(current, previous, "n_nationkey").select("n_nationkey", "updated")


@query("SELECT token, count(DISTINCT p_name)::BIGINT AS names FROM (SELECT p_name, unnest(string_split(lower(p_name), ' ')) AS token FROM part) GROUP BY token HAVING count(DISTINCT p_name) >= 5")
def a_token_dictionary(s, d):
    return K.token_dictionary(read(s, d, "part"), "p_name", 5)


@query("SELECT source, (sum(length(text)) // 4)::BIGINT AS tokens, count(*)::BIGINT AS docs FROM documents GROUP BY source")
def a_token_estimate(s, d):
    return read(s, d, "documents").groupBy("source").agg(F.floor(F.sum(F.char_length("text")) / 4).cast("long").alias("tokens"), F.count(F.lit(1)).alias("docs"))


@query("SELECT l_orderkey, l_linenumber AS start, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 99) AS stop FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def w_blocks_between(s, d):
    marks = read(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("end", F.lit(99))
    return K.blocks_between(marks, "l_orderkey", "l_linenumber", "end")


@query("SELECT o_custkey, arg_min(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def d_first_wins(s, d):
    return R.first_of(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate"]).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, coalesce(nullif(own, ''), list_filter([mid, top], lambda u: u <> '')[1]) AS url FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '' END AS own, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN '' END AS mid, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS top FROM part)")
def t_effective_url(s, d):
    size, k = F.col("p_size") % 3, F.col("p_partkey") % 4
    own = F.when(size == 0, F.col("p_name")).when(size == 1, "")
    above = F.array(F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")), F.when(k == 0, F.col("p_brand")).when(k == 1, ""))
    return read(s, d, "part").select("p_partkey", K.effective_url(own, above).alias("url"))


@query("SELECT p_partkey, p_partkey % 4 < 2 AS label FROM part")
def t_letters(s, d):
    k = F.col("p_partkey") % 4
    return read(s, d, "part").select("p_partkey", (K.letters(F.when(k == 0, "E M E N T A :").when(k == 1, "Émen-ta .").when(k == 2, "Relatório").otherwise("")) == "EMENTA").alias("label"))


@query("SELECT doc_id, coalesce(length(regexp_replace(text, '[^\\p{Ll}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0) < 0.15, false) AS shouted FROM documents")
def t_shouted(s, d):
    return read(s, d, "documents").select("doc_id", K.shouted(F.col("text")).alias("shouted"))


@query("SELECT o_orderkey, replace(format('{:,}', o_orderkey * 1000), ',', '.') AS n, strftime(o_orderdate::DATE, '%d/%m/%Y') AS day FROM orders")
def t_numbers_and_days(s, d):
    return read(s, d, "orders").select("o_orderkey", K.thousands(F.col("o_orderkey") * 1000).alias("n"), K.day(F.to_date("o_orderdate").cast("string")).alias("day"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://a.example/' || p_partkey WHEN 1 THEN 'http://b.example/x(' || p_partkey || ')' WHEN 2 THEN 'https://c.example' ELSE '' END AS links FROM part")
def t_links(s, d):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey")
    text = F.when(k == 0, F.concat(F.lit("see https://a.example/"), n, F.lit("."))).when(k == 1, F.concat(F.lit("http://b.example/x("), n, F.lit("), and"))).when(k == 2, "(at https://c.example)").otherwise("ftp://none")
    return read(s, d, "part").select("p_partkey", F.array_join(K.links(text), " ").alias("links"))


@query("SELECT p_partkey, 'ação nº ' || p_partkey AS text FROM part")
def t_decode_bytes(s, d):
    raw = F.encode(F.concat(F.lit("ação nº "), "p_partkey"), "ISO-8859-1")
    return read(s, d, "part").select("p_partkey", K.decode_bytes(raw, "ISO-8859-1").alias("text"))


NORMAL = "lower(strip_accents({}))"


@query("SELECT page_id FROM pages WHERE contains(lower(strip_accents(url)), 'http') AND (contains(lower(strip_accents(html)), 'article') OR contains(lower(strip_accents(url)), 'article')) AND (contains(lower(strip_accents(html)), '7') OR contains(lower(strip_accents(url)), '7'))")
def s_search_fields(s, d):
    """A preset of fields, each term in any of them."""
    return L.search(read(s, d, "pages"), "HTTP Árticle 7", ["url", "html"]).select("page_id")


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'CEP' WHEN 1 THEN 'DATA_NASCIMENTO' WHEN 2 THEN 'PLACA' WHEN 3 THEN 'NOME' WHEN 4 THEN 'RAZAO_SOCIAL' ELSE 'EMAIL' END AS cls, CASE c_custkey % 6 WHEN 0 THEN '90010-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN '12/05/1980' WHEN 2 THEN 'ABC1D23' WHEN 3 THEN 'JOÃO da Silva' WHEN 4 THEN 'Andrade Ltda.' ELSE 'a' || c_custkey || '@ex.com' END AS found FROM customer")
def p_recognisers(s, d):
    """The recognisers themselves, beside what they must leave alone."""
    k, n = F.col("c_custkey") % 6, F.col("c_custkey")
    text = F.when(k == 0, F.concat(F.lit("CEP 90010-"), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(" de Pessoa Física Ltda."))).when(k == 1, "nascido em 12/05/1980, e muito tempo depois, em outro lugar, emitido em 01/01/2020").when(k == 2, "placa ABC1D23 do Contribuinte Receita Estadual").when(k == 3, "Titular: JOÃO da Silva, 20").when(k == 4, "empresa Andrade Ltda. hoje; do Governo do Estado S.A. hoje").otherwise(F.concat(F.lit("para a"), n, F.lit("@ex.com hoje")))
    return read(s, d, "customer").select("c_custkey", F.explode(P.detect_pii(text)).alias("x")).select("c_custkey", "x.cls", F.col("x.text").alias("found"))


@query("SELECT p_partkey, lower(p_name) AS name, (1 + (SELECT count(*) FROM unnest(string_split(p_name, '')) t(c) WHERE ascii(c) % 2 = 1)) % 2 AS half FROM part")
def k_half(s, d):
    return read(s, d, "part").select("p_partkey", F.lower("p_name").alias("name"), H.half(F.col("p_name")).cast("long").alias("half"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)::BIGINT AS n FROM orders")
def w_number_rows(s, d):
    return R.number_in_parts(read(s, d, "orders"), ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.col("n").cast("long").alias("n"))


@query("SELECT l_partkey % 97 AS canon_key, l_orderkey AS doc FROM lineitem GROUP BY ALL")
def i_postings(s, d):
    from tessera.operators.citations import postings

    return postings(read(s, d, "lineitem").select((F.col("l_partkey") % 97).alias("canon_key"), F.col("l_orderkey").alias("doc")))
