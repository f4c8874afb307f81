"""Queries of the retrieval and curation operators over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import legal as G
from tessera.functions import text as T
from tessera.operators import citations as C
from tessera.operators import integrity as I
from tessera.operators import lexical as L
from tessera.operators import pii as P
from tessera.operators import relational as R
from tessera.operators import vector as V
from tessera.operators.catalog import adherence_line
from tessera.operators.graph import connected_components
from tessera.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def emb(s, d, *, q: int = 0):
    rows = read(s, d, "embeddings")
    return rows, rows.filter(F.col("vec_id") == q)


DIST = "round(greatest(0.0, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6)"
RANKED = f"WITH s AS (SELECT e.vec_id, e.label, {DIST} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rn FROM s) "


# ---- vectors
@query(f"SELECT e.vec_id, e.label, {DIST} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY dist, vec_id LIMIT 10")
def v_topk_cosine(s, d):
    return V.topk(*emb(s, d), 10).select("vec_id", "label", "dist")


@query(f"SELECT e.vec_id, {DIST} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY dist, vec_id LIMIT 20")
def v_topk_numpy(s, d):
    return V.topk(*emb(s, d), 20, fast=True).select("vec_id", "dist")


@query(RANKED + "SELECT label, rn::INT AS rn, vec_id, dist FROM r WHERE rn <= 10")
def v_topk_per_label(s, d):
    return V.topk_per(*emb(s, d), 10, "label").select("label", "rn", "vec_id", "dist")


@query(RANKED + ", t AS (SELECT * FROM r WHERE rn <= 10) SELECT label, rn::INT AS rn, vec_id, dist FROM (SELECT *, min(dist) OVER (PARTITION BY label) AS best FROM t) WHERE rn <= 0 OR round(dist - best, 6) <= 0.05")
def v_band_narrow(s, d):
    return V.narrow(V.topk_per(*emb(s, d), 10, "label"), "label", 0, 0.05).select("label", "rn", "vec_id", "dist")


@query(RANKED + ", t AS (SELECT * FROM r WHERE rn <= 10) SELECT label, rn::INT AS rn, vec_id, dist FROM (SELECT *, min(dist) OVER (PARTITION BY label) AS best FROM t) WHERE rn <= 3 OR round(dist - best, 6) <= 0.0")
def v_floor_overrides_band(s, d):
    return V.narrow(V.topk_per(*emb(s, d), 10, "label"), "label", 3, 0.0).select("label", "rn", "vec_id", "dist")


@query("SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 0.0 ELSE 2.0 END AS dist FROM embeddings")
def v_distance_guard(s, d):
    rows = read(s, d, "embeddings")
    other = F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 10)).otherwise(F.transform("embedding", lambda x: x * 0))
    return rows.select("vec_id", V.cosine_distance(F.col("embedding"), other).alias("dist"))


@query(RANKED + "SELECT label, rn::INT AS rn, vec_id, dist FROM r WHERE rn <= CASE label % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 1 END")
def v_multi_kind_retrieve(s, d):
    rows, q = emb(s, d)
    ceiling = F.when(F.col("label") % 3 == 0, 10).when(F.col("label") % 3 == 1, 20).otherwise(1)
    return V.topk_per(rows, q, ceiling, "label").select("label", "rn", "vec_id", "dist")


@query(RANKED + "SELECT label, rn::INT AS rn, 'documento ' || rn || CASE WHEN rn % 4 = 0 THEN ' · por co-citação de dispositivos (sem busca vetorial)' ELSE printf(' · aderência %.3f · distância %.3f', 1 - dist, dist) END || chr(10) AS adherence FROM r WHERE rn <= 5")
def v_adherence(s, d):
    hits = V.topk_per(*emb(s, d), 5, "label")
    return hits.select("label", "rn", adherence_line(F.lit("documento"), F.col("rn"), F.when(F.col("rn") % 4 > 0, F.col("dist"))).alias("adherence"))


@query(RANKED + ", t AS (SELECT * FROM r WHERE rn <= 3) SELECT t.label, t.rn::INT AS rn, t.vec_id, t.dist, coalesce(d.text, '') AS body, d.doc_id IS NOT NULL AS found FROM t LEFT JOIN documents d ON d.doc_id = t.vec_id")
def v_late_body_join(s, d):
    hits = V.topk_per(*emb(s, d), 3, "label").select("label", "rn", "vec_id", "dist")
    got = V.with_bodies(hits, read(s, d, "documents").select("doc_id", "text"), "vec_id", "doc_id")
    return got.select("label", "rn", "vec_id", "dist", F.coalesce("text", F.lit("")).alias("body"), F.col("text").isNotNull().alias("found"))


# ---- keys, blocks, text
@query(r"SELECT doc_id, left(array_to_string(list_filter([source, lang, '', text], lambda x: x <> ''), chr(10)), 6000) AS key FROM documents")
def k_compose_key(s, d):
    return read(s, d, "documents").select("doc_id", T.compose_key(F.col("source"), F.col("lang"), F.lit(""), F.col("text")).alias("key"))


@query(r"SELECT doc_id, trim(left(array_to_string(list_filter([source || ' | ' || lang, lang, '', trim(left(text, 300))], lambda x: x <> ''), chr(10)), 6000)) AS key FROM documents")
def k_service_key(s, d):
    return read(s, d, "documents").select("doc_id", T.service_key(F.concat("source", F.lit(" | "), "lang"), F.col("lang"), F.col("text")).alias("key"))


WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, left(array_to_string(list_filter([source, 'P: ' || {WS.format('left(text, 80)')}, '', CASE WHEN {WS.format('substr(text, 81)')} = '' THEN '' ELSE 'R: ' || {WS.format('substr(text, 81)')} END], lambda x: x <> ''), chr(10)), 6000) AS key FROM documents")
def k_faq_key(s, d):
    return read(s, d, "documents").select("doc_id", T.faq_key(F.col("source"), F.left("text", F.lit(80)), F.substring("text", 81, F.char_length("text"))).alias("key"))


@query("SELECT source, count(*) FILTER (length(text) >= 6000)::BIGINT AS capped, count(*)::BIGINT AS keys FROM documents GROUP BY source")
def k_cap_report(s, d):
    return read(s, d, "documents").groupBy("source").agg(F.count_if(F.char_length("text") >= 6000).alias("capped"), F.count(F.lit(1)).alias("keys"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN text = '' THEN '' ELSE '## pergunta' || chr(10) || text END, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '## resposta' || chr(10) || source END, 'Link: ' || lang], lambda x: x <> ''), chr(10)) AS block FROM documents")
def k_block_render(s, d):
    return read(s, d, "documents").select("doc_id", T.block(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")), F.col("lang")).alias("block"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN text END, CASE WHEN lang = 'en' AND source <> '' THEN source END, '(texto indisponível)') AS body FROM documents")
def k_degraded_block(s, d):
    body = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    return read(s, d, "documents").select("doc_id", T.degraded(body, F.col("source"), F.col("lang") == "en", "(texto indisponível)").alias("body"))


PLAINED = "translate({}, 'áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ', 'aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY')"
SLUG = "trim(regexp_replace(lower(" + PLAINED.format("replace({}, 'ß', 'ss')") + "), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"SELECT doc_id, {SLUG.format('text')} AS slug, CASE WHEN length(x) <= 60 THEN x WHEN contains(left(x, 60), '-') THEN regexp_replace(left(x, 60), '-[^-]*$', '') ELSE left(x, 60) END AS cut FROM (SELECT *, {SLUG.format('text')} AS x FROM documents)")
def t_slug(s, d):
    one = T.slug(F.col("text"))
    return read(s, d, "documents").select("doc_id", one.alias("slug"), T.cut_slug(one, 60).alias("cut"))


@query(f"SELECT doc_id, {WS.format('text')} AS text FROM documents")
def t_collapse_ws(s, d):
    return read(s, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {WS.format('lower(strip_accents(text))')} AS norm FROM documents")
def t_normalise(s, d):
    return read(s, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("norm"))


@query("SELECT doc_id, source AS head, lang || ' | ' || doc_id AS rest FROM documents")
def t_trail_split(s, d):
    head, rest = T.split_trail(F.concat_ws(" | ", "source", "lang", "doc_id"))
    return read(s, d, "documents").select("doc_id", head.alias("head"), rest.alias("rest"))


@query("SELECT doc_id, left(text, 24000) AS body, length(text) > 24000 AS cut FROM documents")
def t_truncate_flag(s, d):
    return read(s, d, "documents").select("doc_id", F.left("text", F.lit(24000)).alias("body"), (F.char_length("text") > 24000).alias("cut"))


@query("SELECT p_partkey, CASE WHEN p_retailprice * 1000 >= 1000000 THEN replace(printf('%.1f MB', p_retailprice * 1000 / 1000000.0), '.', ',') ELSE replace(printf('%.1f kB', p_retailprice), '.', ',') END AS size FROM part WHERE p_retailprice >= 1")
def t_human_size(s, d):
    return read(s, d, "part").filter("p_retailprice >= 1").select("p_partkey", T.human_size(F.col("p_retailprice") * 1000).alias("size"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS name, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || regexp_replace(regexp_replace(substr(url, length(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) + 1), '#.*$', ''), '/+$', '') AS url FROM pages")
def t_urls(s, d):
    return read(s, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"), T.canonical_url(F.col("url")).alias("url"))


# ---- lexical search
HAY = "regexp_replace(lower(strip_accents({})), '\\s+', ' ', 'g')"


@query(f"SELECT doc_id FROM documents WHERE (contains({HAY.format('text')}, 'the') OR contains({HAY.format('lang')}, 'the')) AND (contains({HAY.format('text')}, 'en') OR contains({HAY.format('lang')}, 'en'))")
def s_and_search(s, d):
    return L.search(read(s, d, "documents"), "THÉ en", ["text", "lang"]).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains({HAY.format('text')}, '7') OR contains({HAY.format('source')}, '7')")
def s_search_with_single_letters(s, d):
    return L.search(read(s, d, "documents"), "a 7 e", ["text", "source"]).select("doc_id")


@query(f"SELECT p_partkey, p_brand FROM part WHERE contains({HAY.format('p_brand')}, '#1') OR contains({HAY.format('p_name')}, '#1')")
def s_group_filter(s, d):
    return L.search_groups(read(s, d, "part"), "#1", "p_brand", "p_name").select("p_partkey", "p_brand")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id = 7")
def s_pending_filter(s, d):
    docs, done = read(s, d, "documents").select("doc_id"), read(s, d, "labels").select("doc_id").withColumn("done", F.lit(True)).distinct()
    return docs.join(done, "doc_id", "left").filter("done is null or doc_id = 7").select("doc_id")


@query()
def s_highlight(s, d):
    return read(s, d, "documents").select("doc_id", F.size(L.highlight("the en")(F.col("text"))).alias("ranges"))


# ---- dedup, merge, joins
@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def d_latest_revision(s, d):
    return R.latest(read(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])[0].select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, count(*)::BIGINT AS losers FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 1 GROUP BY o_custkey")
def d_losers(s, d):
    return R.latest(read(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])[1].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("losers"))


@query("WITH x AS (SELECT l_suppkey, l_returnflag AS flag, l_linestatus, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), f AS (SELECT l_suppkey, flag, min(seq) AS seq FROM x GROUP BY ALL) SELECT x.l_suppkey, arg_min(l_linestatus, row(seq, l_linestatus)) AS l_linestatus, (SELECT string_agg(flag, ',' ORDER BY seq, flag) FROM f WHERE f.l_suppkey = x.l_suppkey) AS flags FROM x GROUP BY x.l_suppkey")
def d_fold_by_link(s, d):
    rows = read(s, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("flag"), "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return R.fold(rows, "l_suppkey", "seq", ["l_linestatus"], "flag").select("l_suppkey", "l_linestatus", F.array_join("flag", ",").alias("flags"))


@query("SELECT p_brand, count(DISTINCT p_type)::BIGINT AS n_values FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def d_conflict_check(s, d):
    return R.conflicts(read(s, d, "part"), "p_brand", "p_type")


@query("SELECT p_brand, count(*)::BIGINT AS parts, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, count(DISTINCT p_name) > 1 AS diverging FROM part GROUP BY p_brand")
def d_merge_same_name(s, d):
    return read(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), (F.count_distinct("p_name") > 1).alias("diverging"))


@query("SELECT count(DISTINCT (l_partkey, l_suppkey))::BIGINT AS services FROM lineitem")
def d_distinct_services(s, d):
    return read(s, d, "lineitem").agg(F.count_distinct("l_partkey", "l_suppkey").alias("services"))


@query("SELECT e.vec_id AS id, e.label % 4 <> 0 AND e.vec_id % 5 <> 0 AS reused FROM embeddings e")
def j_reuse_vectors(s, d):
    rows = read(s, d, "embeddings")
    key = F.when(F.col("label") % 4 != 0, F.sha2(F.col("vec_id").cast("string"), 256))
    pack = rows.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), key.alias("key_hash"), "embedding")
    return R.reuse(rows.select(F.col("vec_id").alias("id"), key.alias("key_hash")), pack).select("id", F.col("embedding").isNotNull().alias("reused"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j_orphans(s, d):
    return R.orphans(read(s, d, "documents").select("doc_id"), read(s, d, "labels"), "doc_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 = 0")
def j_upsert_merge(s, d):
    old = read(s, d, "customer").select("c_custkey", "c_name")
    new = old.filter("c_custkey % 3 = 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("c_name", F.when(F.col("seq") == 2, "new").otherwise("old"))
    return R.merge(old, new, old.filter("c_custkey % 7 = 0"), "c_custkey", "seq")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND l IS NULL THEN 'remove' WHEN l IS NULL THEN 'wait' ELSE 'back' END AS state FROM (SELECT d.doc_id, any_value(l.doc_id) AS l FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id) WHERE l IS NULL OR doc_id % 4 = 0")
def j_approved_intersection(s, d):
    docs = read(s, d, "documents").select("doc_id")
    return R.approved_removals(docs.filter("doc_id % 4 = 0"), docs, read(s, d, "labels"), "doc_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'unrecorded' ELSE 'changed' END AS problem FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) OR (p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0)")
def j_manifest_validate(s, d):
    p = read(s, d, "part")
    was = p.filter("p_partkey % 7 <> 0").select("p_partkey", F.md5("p_name").alias("hash"))
    now = p.filter("p_partkey % 5 <> 0").select("p_partkey", F.md5(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).alias("hash"))
    return R.validate_hashes(was, now, "p_partkey")


@query("SELECT p_brand, CASE WHEN p_brand LIKE '%1' THEN count(*) * 2 ELSE count(*) END::BIGINT AS n FROM part GROUP BY p_brand")
def j_partial_manifest_merge(s, d):
    old = read(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return R.merge_manifest(old, old.filter("p_brand like '%1'").withColumn("n", F.col("n") * 2), "p_brand")


@query("SELECT c.c_custkey, n.n_name AS audience, coalesce(o.o_orderpriority, 'Geral') AS category FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) o ON o.o_custkey = c.c_custkey")
def j_audience_product(s, d):
    c, n, o = read(s, d, "customer"), read(s, d, "nation"), read(s, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(o, c.c_custkey == o.o_custkey, "left")
    return rows.select("c_custkey", F.col("n_name").alias("audience"), F.coalesce("o_orderpriority", F.lit("Geral")).alias("category"))


@query("WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS i, l_partkey % 50 AS a, l_partkey % 50 + l_quantity::INT AS b FROM lineitem) SELECT x.doc, x.i AS i, y.i AS j FROM s x JOIN s y ON x.doc = y.doc AND x.i < y.i AND x.a < y.b AND y.a < x.b")
def j_span_overlap(s, d):
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 50).alias("start"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("int")).alias("end"))
    return R.span_overlap(rows, rows, "doc").filter("a.i < b.i").select("a.doc", F.col("a.i").alias("i"), F.col("b.i").alias("j"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(trim(c_name)) = lower(trim(' CUSTOMER#000000007 ')) OR lower(trim(c_name)) = 'customer#7'")
def j_point_lookup(s, d):
    wanted = [F.lower(F.trim(F.lit(x))) for x in (" CUSTOMER#000000007 ", "customer#7")]
    hit = read(s, d, "customer").filter((F.lower(F.trim("c_name")) == wanted[0]) | (F.lower(F.trim("c_name")) == wanted[1]))
    return hit.select("c_custkey", "c_name")


# ---- index and graph: an order is a document, a part modulo 97 a provision, a supplier modulo 30 a theme
def mentions(s, d):
    li = read(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 97).alias("key"))


def themes(s, d):
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 30).alias("theme"))


M = "WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 97 AS key FROM lineitem), th AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 30 AS theme FROM lineitem), ok AS (SELECT * FROM m WHERE key IN (SELECT key FROM m GROUP BY key HAVING count(*) >= 3)), p AS (SELECT a.key AS a, b.key AS b, count(*)::BIGINT AS w FROM ok a JOIN ok b ON a.doc = b.doc AND a.key < b.key GROUP BY ALL HAVING count(*) >= {least})"


@query("SELECT l_partkey % 97 AS canon_key, arg_min(l_returnflag, row(l_orderkey * 10 + l_linenumber, l_returnflag)) AS display, count(*)::BIGINT AS occurrences, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS variants, count(DISTINCT l_orderkey)::BIGINT AS n_docs FROM lineitem GROUP BY 1")
def i_inverted_index(s, d):
    li = read(s, d, "lineitem").select((F.col("l_partkey") % 97).alias("canon_key"), F.col("l_returnflag").alias("display"), F.col("l_returnflag").alias("variant"), F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return C.inverted_index(li).select("canon_key", "display", "occurrences", F.array_join("variants", ",").alias("variants"), "n_docs")


@query("WITH c AS (SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS rn FROM c) WHERE rn = 1")
def i_mode_display(s, d):
    return C.mode_by(read(s, d, "lineitem"), "l_suppkey", "l_returnflag")


@query(M.format(least=2) + " SELECT a, b, w FROM p")
def g_cocitation_pairs(s, d):
    return C.cocitation_pairs(mentions(s, d), 3, 2)


TOP = ", top AS (SELECT theme, count(*)::BIGINT AS docs FROM th GROUP BY theme ORDER BY docs DESC, theme LIMIT 16)"


@query(M.format(least=2) + TOP + " SELECT theme, docs FROM top")
def g_top_themes(s, d):
    return C.top_themes(themes(s, d), 16).select("theme", "docs")


@query(M.format(least=2) + TOP + ", bb AS (SELECT a AS key FROM p UNION SELECT b FROM p) SELECT th.theme, m.key, count(*)::BIGINT AS w FROM th JOIN m USING (doc) WHERE th.theme IN (SELECT theme FROM top) AND m.key IN (SELECT key FROM bb) GROUP BY ALL HAVING count(*) >= 2")
def g_theme_edges(s, d):
    m, t = mentions(s, d), themes(s, d)
    return C.theme_edges(t, C.top_themes(t, 16), m, C.backbone_of(C.cocitation_pairs(m, 3, 2)), 2)


@query(M.format(least=3) + " SELECT a AS key FROM p UNION SELECT b FROM p")
def g_backbone(s, d):
    return C.backbone_of(C.cocitation_pairs(mentions(s, d), 3, 3))


def item_edges(s, d):
    return read(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b"))


@query()
def g_components(s, d):
    return connected_components(item_edges(s, d))


@query()
def g_giant(s, d):
    return C.giant_component(item_edges(s, d))


@query(M.format(least=2) + ", k AS (SELECT DISTINCT key FROM m WHERE doc IN (1, 2, 3)) SELECT doc, count(*)::BIGINT AS shared FROM m WHERE doc NOT IN (1, 2, 3) AND key IN (SELECT key FROM k) GROUP BY doc HAVING count(*) >= 2 ORDER BY shared DESC, doc LIMIT 20")
def g_related_docs(s, d):
    m = mentions(s, d)
    return C.related(m, m.filter("doc in (1, 2, 3)").select("doc").distinct(), 2, 20)


@query(M.format(least=2) + TOP + ", bb AS (SELECT a AS key FROM p UNION SELECT b FROM p), n AS (SELECT 0 AS part, 0 AS rank, key::VARCHAR AS id FROM bb UNION ALL SELECT 1, row_number() OVER (ORDER BY docs DESC, theme) - 1, theme::VARCHAR FROM top) SELECT (row_number() OVER (ORDER BY part, rank, id) - 1)::INT AS idx, part, id FROM n")
def g_node_index(s, d):
    return C.node_index(C.backbone_of(C.cocitation_pairs(mentions(s, d), 3, 2)), C.top_themes(themes(s, d), 16))


# ---- citations, keys, HTML
CITED = "CASE l_partkey % 5 WHEN 0 THEN 'Art. ' || (l_linenumber + 1) || ', inciso iv do RICMS' WHEN 1 THEN 'Lei nº 8.' || (100 + l_linenumber) || '/89, art. ' || l_linenumber || 'º' WHEN 2 THEN 'Convênio ICMS ' || l_linenumber || '/' || (10 + l_suppkey % 80) WHEN 3 THEN 'o referido decreto' ELSE 'Constituição Federal, art. 155, § ' || l_linenumber END"


def cited(s, d):
    n = F.col("l_linenumber")
    k = F.col("l_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("Art. "), n + 1, F.lit(", inciso iv do RICMS"))).when(k == 1, F.concat(F.lit("Lei nº 8."), 100 + n, F.lit("/89, art. "), n, F.lit("º"))).when(k == 2, F.concat(F.lit("Convênio ICMS "), n, F.lit("/"), 10 + F.col("l_suppkey") % 80)).when(k == 3, F.lit("o referido decreto")).otherwise(F.concat(F.lit("Constituição Federal, art. 155, § "), n))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("texto"))


@query("SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'ricms-rs:art' || (l_linenumber + 1) || ':incIV' WHEN 1 THEN 'lei:8' || (100 + l_linenumber) || '/89:art' || l_linenumber WHEN 2 THEN 'convenio:' || l_linenumber || '/' || (10 + l_suppkey % 80) WHEN 4 THEN 'cf:art155:§' || l_linenumber END AS canon_key FROM lineitem")
def c_canon_citation(s, d):
    return C.canonicalise(cited(s, d), "texto").select("l_orderkey", "l_linenumber", "canon_key")


@query("SELECT CASE l_partkey % 5 WHEN 0 THEN 'RICMS' WHEN 1 THEN 'Lei/LC' WHEN 2 THEN 'Convênio/Protocolo' ELSE 'Constituição/EC' END AS family, count(*)::BIGINT AS n FROM lineitem WHERE l_partkey % 5 <> 3 GROUP BY 1")
def c_family_rollup(s, d):
    counts = cited(s, d).groupBy("texto").agg(F.count(F.lit(1)).alias("m"))
    rows = C.canonicalise(counts, "texto").groupBy("canon_key").agg(F.sum("m").alias("m")).filter("canon_key is not null")
    return rows.groupBy(G.family(F.col("canon_key")).alias("family")).agg(F.sum("m").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'e-cac' WHEN 1 THEN 'dte' WHEN 3 THEN 'sistema-' || p_partkey WHEN 4 THEN 'nf-e' END AS canon_key FROM part")
def c_canon_system(s, d):
    k = F.col("p_partkey") % 6
    text = F.when(k == 0, " Portal  e-CAC").when(k == 1, "Domicílio Tributário Eletrônico (DTE)").when(k == 2, "Receita Estadual").when(k == 3, F.concat(F.lit("Sistema "), F.col("p_partkey"))).when(k == 4, "Nota Fiscal Eletrônica").otherwise("telefone")
    return read(s, d, "part").select("p_partkey", G.canonical_system(text).alias("canon_key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (CASE WHEN o_orderkey % 100 > 30 THEN 1900 ELSE 2000 END + o_orderkey % 100)::INT WHEN o_orderkey % 3 = 1 THEN 2019 END AS year, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey::INT END AS seq FROM orders")
def c_chrono_key(s, d):
    k, n = F.col("o_orderkey") % 3, F.col("o_orderkey")
    number = F.when(k == 0, F.concat(F.lit("Parecer "), n, F.lit("/"), F.lpad((n % 100).cast("string"), 2, "0"))).when(k == 1, F.concat(F.lit("Nº "), n, F.lit("/2019"))).otherwise("sem número")
    key = G.chronological_key(number)
    return read(s, d, "orders").select("o_orderkey", key["year"].alias("year"), key["seq"].alias("seq"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate) DESC, o_orderkey DESC)::BIGINT AS n FROM orders")
def c_chrono_sort(s, d):
    rows = read(s, d, "orders").select("o_orderkey", G.chronological_key(F.concat("o_orderkey", F.lit("/"), F.year("o_orderdate"))).alias("k"))
    return R.number_all(rows, [F.col("k").isNull(), F.desc("k.year"), F.desc("k.seq"), F.col("o_orderkey")]).select("o_orderkey", "n")


@query("SELECT l_orderkey, l_linenumber, (l_partkey % 300)::INT AS artigo, 0 AS sufixo, l_linenumber AS paragrafo, 0 AS paragrafo_sufixo, 4 AS inciso, 2 AS alinea, 0 AS item FROM lineitem")
def c_legal_key(s, d):
    text = F.concat(F.lit("Art. "), F.col("l_partkey") % 300, F.lit("º, § "), F.col("l_linenumber"), F.lit("º, IV, b"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.provision_key(text).alias("k")).select("l_orderkey", "l_linenumber", "k.*")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 1994 WHEN 1 THEN 49 WHEN 2 THEN 4 END::INT AS n FROM part")
def c_roman(s, d):
    k = F.col("p_size") % 4
    return read(s, d, "part").select("p_partkey", G.roman(F.when(k == 0, "MCMXCIV").when(k == 1, "xlix").when(k == 2, "IV").otherwise("K")).alias("n"))


ENT = "html"
for _name, _sign in T.ENTITIES.items():
    ENT = f"replace({ENT}, '{_name}', " + ("chr(39)" if _sign == "'" else f"'{_sign}'") + ")"
H1 = r"regexp_replace(html, '(?is)<(style|script)[^>]*>.*?</(style|script)>|<!--.*?-->', '', 'g')"
H2 = rf"regexp_replace(regexp_replace({H1}, '(?i)<br[^>]*>|</(p|div|li|tr|h[1-6])>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
H3 = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {H3} AS text FROM (SELECT page_id, {ENT} AS html FROM (SELECT page_id, {H2} AS html FROM pages))")
def h_html_to_text(s, d):
    return read(s, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, regexp_replace(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', '\2 (\1)', 'g') AS html FROM pages""")
def h_link_text(s, d):
    return read(s, d, "pages").select("page_id", T.link_text(F.col("html")).alias("html"))


@query(f"SELECT page_id, {WS.format(ENT.replace('html', 't'))} AS title FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)")
def h_title(s, d):
    return read(s, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


# ---- aggregates
@query("SELECT source, count(*) FILTER (lang = 'en')::BIGINT AS en, count(*) FILTER (lang = 'fr')::BIGINT AS fr, count(*) FILTER (lang = 'de')::BIGINT AS de, count(*) FILTER (lang = 'es')::BIGINT AS es FROM documents GROUP BY source")
def a_entity_kind_pivot(s, d):
    return read(s, d, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1))).na.fill(0)


MERKLE = "WITH a AS (SELECT source, sha256(concat_ws(chr(0), doc_id::VARCHAR, text)) AS name, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT source, left(name, 6) AS name, sum(n) AS n, sha256(string_agg(name || ':' || n, chr(10) ORDER BY name || ':' || n)) AS hash FROM a GROUP BY source, left(name, 6)), c AS (SELECT source, left(name, 3) AS name, sum(n) AS n, sha256(string_agg(name || ':' || hash, chr(10) ORDER BY name)) AS hash FROM b GROUP BY source, left(name, 3)) SELECT source, sum(n)::BIGINT AS n_files, sha256(string_agg(name || ':' || hash, chr(10) ORDER BY name)) AS hash FROM c GROUP BY source"


@query(MERKLE)
def a_content_hash(s, d):
    return I.content_hash(read(s, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), "source", "doc_id", "text")


@query("SELECT coalesce(year(o_orderdate)::VARCHAR, 'TOTAL') AS year, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, count(*)::BIGINT AS n, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1)::DOUBLE AS pct FROM orders GROUP BY ROLLUP (year(o_orderdate))")
def a_year_rollup(s, d):
    rows = read(s, d, "orders").withColumn("y", F.year("o_orderdate").cast("string")).rollup("y")
    rows = rows.agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.coalesce("y", F.lit("TOTAL")).alias("year"), "open", "done", "n", F.round(100.0 * F.col("done") / F.col("n"), 1).alias("pct"))


@query("SELECT source, round(quantile_cont(n_chars, 0.5), 3) AS p50, round(quantile_cont(n_chars, 0.9), 3) AS p90, round(quantile_cont(n_chars, 0.99), 3) AS p99, max(n_chars) AS most FROM documents GROUP BY source")
def a_percentiles(s, d):
    return read(s, d, "documents").groupBy("source").agg(*[F.round(F.percentile("n_chars", q), 3).alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))], F.max("n_chars").alias("most"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, max(value) AS slowest FROM events GROUP BY event_type")
def a_timings_by_type(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("slowest"))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def a_month_log_counts(s, d):
    return read(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, lang, count(*)::BIGINT AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def a_dir_manifest(s, d):
    return read(s, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


# ---- personal data
@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^0-9A-Za-z./-])\d{5}-\d{3}(?:$|[^0-9A-Za-z./-])'))::INT AS n FROM documents")
def p_cep(s, d):
    return read(s, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?:^|[^0-9A-Za-z./-])\d{5}-\d{3}(?:$|[^0-9A-Za-z./-])"), F.lit(0))).alias("n"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ',') AS emails FROM documents")
def p_email(s, d):
    return read(s, d, "documents").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0)), ",").alias("emails"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '12/05/1980' ELSE '' END AS born FROM customer")
def p_birth_date(s, d):
    text = F.when(F.col("c_custkey") % 2 == 0, "nascido em 12/05/1980, emitido em 01/01/2020").otherwise("emitido em 12/05/1980")
    return read(s, d, "customer").select("c_custkey", F.regexp_extract(text, r"(?i)nasc.{0,30}?(\d{2}/\d{2}/\d{4})", 1).alias("born"))


@query()
def p_class_report(s, d):
    rows = read(s, d, "documents").select("doc_id", F.explode(P.detect_pii("text")).alias("x")).select("doc_id", "x.*")
    return P.report(rows, "doc_id")


@query("SELECT count(*)::BIGINT AS docs, count(*)::BIGINT AS intact FROM documents")
def p_round_trip(s, d):
    rows = read(s, d, "documents").select(P.mask_pii("text").alias("m"))
    return rows.agg(F.count(F.lit(1)).alias("docs"), F.count_if("m.intact").alias("intact"))


@query("SELECT (c_custkey % 3)::INT AS cohort, count(*)::BIGINT AS expected, count(*) FILTER (c_custkey % 3 <> 2)::BIGINT AS covered, CASE WHEN c_custkey % 3 = 2 THEN 0.0 ELSE 1.0 END AS recall FROM customer GROUP BY ALL")
def p_recall_by_cohort(s, d):
    rows = read(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 3).cast("int").alias("cohort"), F.when(F.col("c_custkey") % 3 == 0, "contato: fulano@exemplo.com.br").when(F.col("c_custkey") % 3 == 1, "placa ABC1D23 do carro").otherwise("nada a declarar aqui").alias("text"))
    found = rows.select("c_custkey", F.explode(P.detect_pii("text")).alias("x")).select("c_custkey", "x.start", "x.end")
    return P.recall(rows.select("c_custkey", "cohort", F.lit(6).alias("start"), F.lit(12).alias("end")), found, ["cohort"], "c_custkey")


# ---- evaluation
@query(RANKED + ", a AS (SELECT vec_id, 1 AS sys, row_number() OVER (ORDER BY dist, vec_id) AS rn FROM s), z AS (SELECT e.vec_id, 2 AS sys, row_number() OVER (ORDER BY " + DIST + ", e.vec_id) AS rn FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q) SELECT vec_id, min(sys)::INT AS origin FROM (SELECT * FROM a WHERE rn <= 8 UNION ALL SELECT * FROM z WHERE rn <= 8) GROUP BY vec_id")
def e_pool_union(s, d):
    rows, q0 = emb(s, d)
    pool = V.topk(rows, q0, 8).select("vec_id").withColumn("sys", F.lit(1)).unionByName(V.topk(rows, emb(s, d, q=1)[1], 8).select("vec_id").withColumn("sys", F.lit(2)))
    return pool.groupBy("vec_id").agg(F.min("sys").alias("origin"))


@query("WITH q AS (SELECT vec_id AS qid, label AS ql, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, ql, e.label, row_number() OVER (PARTITION BY qid ORDER BY round(greatest(0.0, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6), e.vec_id) AS rn FROM embeddings e, q WHERE e.vec_id <> qid) SELECT count(DISTINCT qid)::BIGINT AS queries, count(*) FILTER (rn = 1 AND label = ql)::BIGINT AS hit1, count(DISTINCT qid) FILTER (rn <= 5 AND label = ql)::BIGINT AS hit5 FROM s")
def e_hit_at_k(s, d):
    rows = read(s, d, "embeddings")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"), F.col("embedding").alias("qv"))  # the labelled queries
    best = V.nearest_each(rows, asked, 5)
    first = best.groupBy("qid").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rn"))).alias("first"))
    return first.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("first") == 1).alias("hit1"), F.count_if(F.col("first") <= 5).alias("hit5"))


@query(f"SELECT e.vec_id, row_number() OVER (ORDER BY {DIST}, e.vec_id)::INT AS one, row_number() OVER (ORDER BY {DIST}, e.vec_id)::INT AS other FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY one LIMIT 20")
def e_parity(s, d):
    rows, q = emb(s, d)
    order = Window.orderBy("dist", "vec_id")  # of the 20 rows of a result
    one = V.topk(rows, q, 20).select("vec_id", F.row_number().over(order).alias("one"))
    two = V.topk(rows, q, 20, fast=True).select("vec_id", F.row_number().over(order).alias("other"))
    return one.join(two, "vec_id", "full_outer")


@query("SELECT b.item_id, count(*)::BIGINT AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '' GROUP BY b.item_id")
def e_bench_overlap(s, d):
    return L.containing(read(s, d, "benchmark").select("item_id", "text"), read(s, d, "documents").select("doc_id", "text"), "item_id", "doc_id")


# ---- native extras
@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x_rollup(s, d):
    return read(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x_cube(s, d):
    return read(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.event_id, v.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def x_asof_events(s, d):
    """As-of join without a range join: both sides in one window, the last click carried forward."""
    e = read(s, d, "events").filter("event_type in ('click', 'purchase')")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value")).select("user_id", "ts", F.lit(None).cast("long").alias("event_id"), "value", F.lit(0).alias("side"))
    both = clicks.unionByName(e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", F.lit(None).cast("double").alias("value"), F.lit(1).alias("side")))
    order = Window.partitionBy("user_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("last_click", F.last("value", ignorenulls=True).over(order)).filter("side = 1").select("event_id", "last_click")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def x_tumbling(s, d):
    return logs.tumbling(read(s, d, "events"), "1 hour")


@query("SELECT b - INTERVAL 30 minute * k AS start, event_type, count(*)::BIGINT AS n FROM (SELECT time_bucket(INTERVAL 30 minute, ts) AS b, event_type FROM events), (VALUES (0), (1)) t(k) GROUP BY ALL")
def x_sliding(s, d):
    return logs.sliding(read(s, d, "events"), "1 hour", "30 minutes")


@query("WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 hour THEN 0 ELSE 1 END AS first FROM events), g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM g GROUP BY user_id, k")
def x_session(s, d):
    return logs.sessions(read(s, d, "events"), "2 hours")


from tessera import queries_catalog, queries_files, queries_tree  # noqa: E402,F401  register their own queries here
