"""The retrieval plan: one scan of all collections, ranked and narrowed hits, late bodies, rendered blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import block, split_trail
from tessera.operators.catalog import KINDS as LABELS
from tessera.operators.catalog import adherence_line, context, with_labels
from tessera.operators.vector import narrow, topk_per, with_bodies
from tessera.plans.ingest import Embedder
from tessera.schemas import KINDS, PAYLOAD


def flagship(spark: SparkSession, sf_dir: str, k: int = 10, floor: int = 3, band: float = 0.25) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    hits = narrow(topk_per(records, records.filter("vec_id = 0"), k, "label"), "label", floor, band)
    rows = with_bodies(hits.select("label", "rn", "vec_id", "dist"), docs, "vec_id", "doc_id")
    title, _ = split_trail(F.coalesce("text", F.lit("")))
    return rows.select("label", "rn", "vec_id", "dist", block(title, F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))).alias("block"))


#: The collections of a question's type, results of each, and the texts for a body that is not there.
TYPES = {1: ("servicos", "faqs"), 2: ("pareceres",), 3: ("tarf",), 4: ("legislacao",)}
SUMMARY_FOR_BODY, NO_BODY = "[corpo indisponível — ver link]", "[conteúdo indisponível — ver o link oficial]"
NOT_THERE = "A consulta de {} ainda não está disponível para esta entidade."


class UnknownCollection(LookupError):
    """The entity is not registered, so it has no collections, not even empty ones."""


def kinds_of_type(code: int | None) -> tuple[str, ...]:
    """The collections that a question's type asks; an unknown code asks those of type 1."""
    return TYPES.get(code, TYPES[1])


def search(records: DataFrame, entities: set[str], entity: str, kinds: tuple[str, ...], query: DataFrame, floor: int = 0, band: float | None = None, ceilings: dict[str, int] | None = None) -> DataFrame:
    """(kind, rn, id, dist, document): the nearest records of each kind of an entity, in one scan, narrowed to a band around the best.

    records: entity, kind, id, embedding, document; query: one row with embedding. An entity that is not registered raises
    UnknownCollection; a collection without records has no rows. Results a kind are those of the kind unless ceilings says otherwise.
    """
    if entity not in entities:
        raise UnknownCollection(entity)
    most = {k[0]: k[6] for k in KINDS} | (ceilings or {})
    mine = records.filter((F.col("entity") == entity) & F.col("kind").isin(*kinds))
    ceiling = reduce(lambda c, k: c.when(F.col("kind") == k, most[k]), kinds, F.when(F.lit(False), 0))
    hits = topk_per(mine, query, ceiling, "kind", "id")
    return narrow(hits, "kind", floor, band).select("kind", "rn", "id", "dist", "document")


def ask(records: DataFrame, entities: set[str], entity: str, kinds: tuple[str, ...], text: str, embedder: Embedder, **how) -> DataFrame:
    """search for a text: it is embedded once, whatever the number of collections."""
    query = records.sparkSession.createDataFrame([(embedder.embed([text])[0].tolist(),)], "embedding array<float>")
    return search(records, entities, entity, kinds, query, **how)


def context_block(payload: Column, body: Column) -> Column:
    """A document as a context shows it: trail, title and subject, the body or what stands for it, the link."""
    question = F.array_join(F.filter(F.array(payload["trilha"], payload["titulo"], payload["ementa"]), lambda x: x != ""), "\n")
    summarised = payload["kind"].isin(*[k[0] for k in KINDS if k[3]]) & (F.coalesce(payload["resumo"], F.lit("")) != "")
    content = F.coalesce(body, F.when(summarised, F.concat(F.lit(SUMMARY_FOR_BODY + "\n"), payload["resumo"])).otherwise(NO_BODY))
    return F.concat(F.lit("## pergunta\n"), question, F.lit("\n\n## resposta\n"), content, F.lit("\nLink: "), F.coalesce(payload["link"], F.lit("")))


def retrieve(hits: DataFrame, bodies: DataFrame) -> DataFrame:
    """hits with block and adherence. bodies (doc_path, body) are joined late, to the hits alone; a payload that is none stands as a subject."""
    read = F.from_json("document", PAYLOAD)
    whole = F.when(read.isNotNull() & read["titulo"].isNotNull(), read)
    raw = F.struct(F.col("kind").alias("kind"), *[(F.col("document") if c == "ementa" else F.lit("")).alias(c) for c in ("trilha", "titulo", "ementa", "resumo", "link", "doc_path")])
    rows = hits.withColumn("_payload", F.coalesce(whole, raw)).withColumn("_path", F.col("_payload.doc_path"))
    found = rows.join(bodies.select(F.col("doc_path").alias("_path"), "body"), "_path", "left")
    near = adherence_line(F.col("kind"), F.col("rn"), F.col("dist"))
    return found.select("kind", "rn", "id", "dist", context_block(F.col("_payload"), F.col("body")).alias("block"), near.alias("adherence"))


def contexts(records: DataFrame, bodies: DataFrame, entities: set[str], entity: str, code: int | None, query: DataFrame, **how) -> DataFrame:
    """One row (state, context): what a model is given for a question of a type.

    state 'found': the context, a list of numbered documents a collection, lists in the type's order; 'unavailable': the notice that the
    entity has none of this type (only for types of one collection: the other type's lists may both be empty); 'unknown': the entity is not registered.
    """
    spark, kinds = records.sparkSession, kinds_of_type(code)
    if entity not in entities:
        return spark.createDataFrame([("unknown", entity)], "state string, context string")
    blocks = with_labels(retrieve(search(records, entities, entity, kinds, query, **how), bodies))
    texts = context(blocks, ["kind"], ["rn"], "label", "block")
    every = texts.groupBy().pivot("kind", list(kinds)).agg(F.first("context"))
    joined = F.concat_ws("\n", *[F.coalesce(F.col(k), F.lit("")) for k in kinds])
    if len(kinds) > 1:
        return every.select(F.lit("found").alias("state"), joined.alias("context"))
    title = next(k[3] for k in LABELS if k[0] == kinds[0])
    state = F.when(joined == "", "unavailable").otherwise("found")
    return every.select(state.alias("state"), F.when(joined == "", NOT_THERE.format(title)).otherwise(joined).alias("context"))
