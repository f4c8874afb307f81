"""Queries of the tree operators over a hierarchy of parts with orders hanging on it, and of update, publish and folder hashes, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import catalog as K
from tessera.operators import integrity as I
from tessera.operators import tree as T
from tessera.plans import update as U
from tessera.plans.ingest import HashingEmbedder
from tessera.plans.retrieval import contexts
from tessera.queries import query, read
from tessera.sources import store as S
from tessera.streaming import logs

TREE = """WITH RECURSIVE nodes AS (SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, p_partkey % 3 AS seq, p_name AS title, CASE WHEN p_size % 3 = 0 THEN 'http://t/' || (p_size % 10) || '/' END AS url, CASE p_partkey % 3 WHEN 0 THEN 'faq' WHEN 1 THEN 'menu' ELSE '' END AS page_type FROM part),
t AS (SELECT id, title, url, page_type, [seq::BIGINT] AS path, []::BIGINT[] AS ids, []::VARCHAR[] AS names, []::VARCHAR[] AS urls FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, n.title, n.url, n.page_type, list_append(t.path, n.seq::BIGINT), list_append(t.ids, t.id), list_append(t.names, t.title), list_append(t.urls, t.url) FROM nodes n JOIN t ON n.parent = t.id),
items AS (SELECT o_custkey AS node, o_orderkey AS seq, o_orderpriority || ' ' || (o_custkey % 50) AS question, 'a' || o_orderkey AS answer FROM orders),
listed AS (SELECT id, NULL::BIGINT AS item, title AS text, url, path, names[2:] AS above, urls[2:] AS urls FROM t WHERE len(ids) > 0 UNION ALL SELECT t.id, i.seq, i.question, t.url, list_append(t.path, i.seq + 1099511627776), list_append(t.names[2:], t.title), list_append(t.urls[2:], t.url) FROM t JOIN items i ON i.node = t.id WHERE len(t.ids) > 0) """


def hierarchy(s, d):
    """(nodes in their places, items): parts by the division of their keys by three, and the orders of the customer with a part's number."""
    id = F.col("p_partkey").cast("long")
    nodes = read(s, d, "part").select(
        id.alias("id"),
        F.when(id > 0, F.expr("p_partkey div 3")).alias("parent"),
        (id % 3).alias("seq"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("http://t/"), F.col("p_size") % 10, F.lit("/"))).alias("url"),
        F.when(id % 3 == 0, "faq").when(id % 3 == 1, "menu").otherwise("").alias("page_type"),
    )
    orders = read(s, d, "orders")
    items = orders.select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("seq"), F.concat("o_orderpriority", F.lit(" "), F.col("o_custkey") % 50).alias("question"), F.concat(F.lit("a"), "o_orderkey").alias("answer"))
    return T.place(nodes), items


@query(TREE + "SELECT row_number() OVER (ORDER BY list_append(t.path, i.seq - 1099511627776))::BIGINT AS n, i.node, i.seq, i.question, i.answer FROM t JOIN items i ON i.node = t.id WHERE t.page_type = 'faq' AND len(t.ids) > 0")
def g_tree_flatten(s, d):
    placed, items = hierarchy(s, d)
    return T.flatten(placed, items)


@query(TREE + "SELECT id, coalesce(item, -1) AS item, 'node-' || (row_number() OVER (ORDER BY list_append(path, 4611686018427387904)) - 1) AS name FROM listed")
def g_tree_names(s, d):
    return T.numbered(T.listed(*hierarchy(s, d), text="question")).select("id", F.coalesce("item", F.lit(-1)).alias("item"), "name")


@query(TREE + "SELECT id, coalesce(item, -1) AS item, text, array_to_string(above, ' > ') AS above, coalesce(url, list_filter(list_reverse(urls), lambda u: u IS NOT NULL)[1]) AS url FROM listed WHERE contains(text, 'cold') AND contains(text, 'gear') OR contains(lower(text), 'urgent') AND contains(text, '17')")
def g_tree_search(s, d):
    tree = T.listed(*hierarchy(s, d), text="question")
    hits = T.search(tree, "Cold GEAR").unionByName(T.search(tree, "urgent 17"))
    return hits.select("id", F.coalesce("item", F.lit(-1)).alias("item"), "text", F.array_join("above", " > ").alias("above"), "url")


@query(TREE + ", own AS (SELECT node, count(*) AS n FROM items GROUP BY node) SELECT a.id, coalesce(sum(o.n), 0)::BIGINT AS items FROM t a LEFT JOIN t b ON list_contains(list_append(b.ids, b.id), a.id) LEFT JOIN own o ON o.node = b.id GROUP BY a.id")
def g_tree_counts(s, d):
    return T.subtree_counts(*hierarchy(s, d))


@query(TREE + "SELECT lower(trim(question)) AS key, arg_max(answer, list_append(path, i.seq - 1099511627776)) AS value FROM t JOIN items i ON i.node = t.id GROUP BY 1")
def g_tree_answers(s, d):
    return T.answers(*hierarchy(s, d))


@query(TREE + "SELECT regexp_replace(url, '/$', '') AS key, arg_max(page_type, path) AS value FROM t WHERE url <> '' AND page_type <> '' GROUP BY 1")
def g_tree_page_types(s, d):
    return T.page_types(hierarchy(s, d)[0])


# ---- update, publish, hashes
FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({}, ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
KIND_OF = "['servicos', 'faqs', 'legislacao', 'pareceres', 'tarf'][(doc_id % 5 + 1)::INTEGER]"
LOW = "format('{{:08x}}', ({} % 4294967296)::UBIGINT)"
DOC_ID = f"'docs/' || kind || '/' || CASE WHEN kind IN ('pareceres', 'tarf') THEN 'doc-' || doc_id WHEN kind = 'servicos' THEN 'doc-' || doc_id || '-' || {LOW.format(FNV.format('link'))} ELSE CASE kind WHEN 'legislacao' THEN source || '/' ELSE '' END || 'doc-' || doc_id || '-' || {LOW.format(FNV.format('link || chr(10) || titulo'))} END || '.md'"


def tree_of(docs, altered):
    """Documents as a tree: kinds by doc_id, and a summary that says whether the document is one of the altered."""
    id = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, U.NAMES)), (id % 5 + 1).cast("int"))
    rows = docs.select(
        kind.alias("kind"),
        F.concat(F.lit("Doc "), id).alias("titulo"),
        F.concat("source", F.lit(" | "), "lang").alias("trilha"),
        F.col("lang").alias("ementa"),
        F.when(altered, F.concat(F.lit("new "), id)).otherwise(F.concat(F.lit("summary "), id)).alias("resumo"),
        F.coalesce("text", F.lit("")).alias("corpo"),
        F.concat(F.lit("http://d/"), id).alias("link"),
    )
    path = K.doc_path(F.col("kind"), F.col("titulo"), F.col("link"), F.col("trilha"))
    return rows.withColumns({"path": path, "content": F.concat_ws("\n", "titulo", "resumo", "corpo")})


@query(f"""WITH d AS (SELECT doc_id, source, lang, {KIND_OF} AS kind, 'Doc ' || doc_id AS titulo, 'http://d/' || doc_id AS link FROM documents),
v AS (SELECT *, 1 AS run, 'summary ' || doc_id AS resumo FROM d WHERE doc_id % 10 <> 3 UNION ALL SELECT *, 2, CASE WHEN doc_id % 7 = 0 THEN 'new ' ELSE 'summary ' END || doc_id FROM d WHERE doc_id % 11 <> 5),
p AS (SELECT * FROM v WHERE run = CASE WHEN kind IN ('pareceres', 'faqs') THEN 2 ELSE 1 END UNION ALL SELECT * FROM v WHERE kind = 'pareceres' AND run = 1 AND doc_id % 11 = 5)
SELECT kind, {DOC_ID} AS id, '{{"kind":"' || kind || '","trilha":"' || source || ' | ' || lang || '","titulo":"' || titulo || '","ementa":"' || lang || '","resumo":"' || resumo || '","link":"' || link || '","doc_path":"' || {DOC_ID} || '"}}' AS document FROM p""")
def u_update_publish(s, d):
    """The published store after a full run and a run of two kinds over a tree that has changed: payloads follow the tree, orphans of rulings stay, other kinds are as before."""
    root, docs = f"{S.shared_folder(s)}/store-{uuid.uuid4().hex}", read(s, d, "documents")
    U.update(s, root, "all", tree_of(docs.filter("doc_id % 10 <> 3"), F.lit(False)), HashingEmbedder(16))
    U.update(s, root, "all", tree_of(docs.filter("doc_id % 11 <> 5"), F.col("doc_id") % 7 == 0), HashingEmbedder(16), kinds=["pareceres", "faqs"])
    return S.read_store(s, root, "all").select("kind", "id", "document")


@query(f"SELECT p_brand, format('{{:016x}}', {FNV.format('text')}::UBIGINT) AS hash, n_files FROM (SELECT p_brand, string_agg(p_brand || '/' || p_partkey || '.md' || p_name || p_type, '' ORDER BY p_brand || '/' || p_partkey || '.md') AS text, count(*)::BIGINT AS n_files FROM part GROUP BY p_brand)")
def k_folder_hash(s, d):
    files = read(s, d, "part").select("p_brand", F.concat("p_brand", F.lit("/"), "p_partkey", F.lit(".md")).alias("path"), F.concat("p_name", "p_type").alias("content"))
    return I.folder_hash(files, "p_brand", "path", "content")


# ---- a stream over the log
@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n FROM events WHERE time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 2 hour GROUP BY ALL")
def x_stream_windows(s, d):
    """The event log as a stream: started, stopped with its state, and gone on with; windows that are closed by then.

    A stream's source is a folder or a pattern, hence the brackets.
    """
    events, work = read(s, d, "events"), f"{S.shared_folder(s)}/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(events.schema).parquet(f"{d}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        found = logs.run_counts(stream, "event_id", "1 hour", "2 hours", f"{work}/out", f"{work}/state")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- retrieval
BLOCK = """'## pergunta' || chr(10) || source || ' | ' || lang || chr(10) || 'Doc ' || doc_id || chr(10) || lang || chr(10) || chr(10) || '## resposta' || chr(10) || CASE WHEN doc_id % 3 > 0 THEN text WHEN kind IN ('pareceres', 'tarf') THEN '[corpo indisponível — ver link]' || chr(10) || 'summary ' || doc_id ELSE '[conteúdo indisponível — ver o link oficial]' END || chr(10) || 'Link: http://d/' || doc_id"""
LABEL = "CASE kind WHEN 'servicos' THEN 'Serviço' WHEN 'faqs' THEN 'FAQ' WHEN 'legislacao' THEN 'Legislação' WHEN 'pareceres' THEN 'Parecer' ELSE 'Acórdão TARF' END"


@query(f"""WITH r AS (SELECT v.vec_id, {KIND_OF} AS kind, round(greatest(0.0, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS dist, d.* FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.vec_id % 5 <> 4),
h AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY dist, 'v' || vec_id) AS n FROM r),
b AS (SELECT kind, string_agg(chr(10) || '## documento ' || n || ': ' || {LABEL} || chr(10) || {BLOCK} || chr(10), '' ORDER BY n) AS context FROM h WHERE n <= CASE kind WHEN 'faqs' THEN 20 ELSE 10 END GROUP BY kind)
SELECT code, 'all' AS entity, CASE WHEN code = 3 THEN 'unavailable' ELSE 'found' END AS state, CASE code WHEN 2 THEN (SELECT context FROM b WHERE kind = 'pareceres') WHEN 3 THEN 'A consulta de Acórdãos TARF ainda não está disponível para esta entidade.' WHEN 4 THEN (SELECT context FROM b WHERE kind = 'legislacao') ELSE (SELECT context FROM b WHERE kind = 'servicos') || chr(10) || (SELECT context FROM b WHERE kind = 'faqs') END AS context FROM (VALUES (1), (2), (3), (4), (9)) t(code) UNION ALL SELECT 2, 'nobody', 'unknown', 'nobody'""")
def r_contexts(s, d):
    """The context of a question of every type, of an unknown code, of a collection without records and of an entity that there is not."""
    id = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, U.NAMES)), (id % 5 + 1).cast("int"))
    docs = read(s, d, "documents").withColumns({"kind": kind, "doc_path": F.concat(F.lit("docs/"), id)})
    payload = F.to_json(F.struct("kind", F.concat("source", F.lit(" | "), "lang").alias("trilha"), F.concat(F.lit("Doc "), id).alias("titulo"), F.col("lang").alias("ementa"), F.concat(F.lit("summary "), id).alias("resumo"), F.concat(F.lit("http://d/"), id).alias("link"), "doc_path"))
    vectors, question = read(s, d, "embeddings"), read(s, d, "embeddings").filter("vec_id = 0").select("embedding")
    records = vectors.filter("vec_id % 5 <> 4").join(docs.select("doc_id", "kind", payload.alias("document")), F.col("vec_id") == id)
    records = records.select(F.lit("all").alias("entity"), "kind", F.concat(F.lit("v"), "vec_id").alias("id"), "embedding", "document")
    bodies = docs.filter(id % 3 > 0).select("doc_path", F.col("text").alias("body"))
    rows = [(code, entity, contexts(records, bodies, {"all"}, entity, code, question)) for code, entity in ((1, "all"), (2, "all"), (3, "all"), (4, "all"), (9, "all"), (2, "nobody"))]
    return reduce(lambda a, b: a.unionByName(b), [x.select(F.lit(code).alias("code"), F.lit(entity).alias("entity"), "state", "context") for code, entity, x in rows])
