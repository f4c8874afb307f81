"""Readers and writers: packs, markdown trees, JSON lines, snapshots, reference texts, the registry, query logs."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import collapse
from tessera.schemas import EXTRACTION, RECORD, SNAPSHOT_VERSION
from tessera.sources import lines


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """Records by id; a missing pack is empty, a broken one an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], RECORD)
    if path.endswith(".json"):
        rows = spark.read.schema(f"records array<struct<{_typed(RECORD)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
        return rows.select(F.explode("records").alias("r")).select("r.*")
    return spark.read.schema(RECORD).parquet(path)


def write_pack(records: DataFrame, path: str, parts: list[str]) -> None:
    """Overwrites only the partitions that records has."""
    records.sortWithinPartitions("id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


# Keys of a document's header.
REQUIRED, OPTIONAL, SUMMARY = ["titulo", "trilha", "ementa", "link"], ["orgao"], ["resumo_modelo", "resumo_prompt_versao", "resumo_gerada_em"]


def parse_document(text: Column) -> Column:
    """struct(header map, resumo, corpo, error) of a markdown document; error says what is wrong and is null if nothing is."""
    body = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n")
    head = F.regexp_extract(body, r"(?s)^---\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    opened = body.rlike(r"(?s)^---\n.*?\n---[ \t]*(\n|$)")
    rest = F.regexp_replace(body, r"(?s)^---\n.*?\n---[ \t]*(?:\n|$)", "")
    lines = F.filter(F.split(head, "\n"), lambda x: F.trim(x) != "")
    keys = F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1)))
    values = F.transform(lines, lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, F.char_length(x))))
    allowed = F.array(*[F.lit(k) for k in REQUIRED + OPTIONAL + SUMMARY])
    summary = F.array(*[F.lit(k) for k in SUMMARY])
    has = F.size(F.array_intersect(keys, summary))
    before = F.regexp_extract(F.concat(F.lit("\n"), rest), r"(?s)^(.*?)\n## corpo(?:\n|$)", 1)
    found = F.concat(F.lit("\n"), rest).rlike(r"(?s)\n## corpo(\n|$)")
    resumo = F.regexp_extract(F.concat(before, F.lit("\n")), r"(?s)\n## resumo\n(.*)$", 1)
    stray = F.regexp_replace(F.concat(before, F.lit("\n")), r"(?s)\n## resumo\n.*$", "")
    corpo = F.regexp_replace(F.concat(F.lit("\n"), rest), r"(?s)^.*?\n## corpo(\n|$)", "")
    error = (
        F.when(~opened, "no header")
        .when(F.exists(lines, lambda x: ~F.contains(x, F.lit(":"))), "line without a colon")
        .when(F.size(F.array_except(keys, allowed)) > 0, "unknown key")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated key")
        .when(F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), keys)) > 0, "missing key")
        .when((has > 0) & (has < len(SUMMARY)), "partial summary data")
        .when(~found, "no body")
        .when(F.trim(F.translate(stray, "\n", " ")) != "", "text before the sections")
    )
    header = F.when(error.isNull(), F.map_from_arrays(keys, values))
    return F.struct(header.alias("header"), F.nullif(F.trim(F.regexp_replace(resumo, r"^\s+|\s+$", "")), F.lit("")).alias("resumo"), F.regexp_replace(corpo, r"^\n+|\s+$", "").alias("corpo"), error.alias("error"))


def render_document(titulo: Column, trilha: Column, ementa: Column, link: Column, resumo: Column, corpo: Column) -> Column:
    """The text that parse_document reads back."""
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), collapse(v)) for k, v in (("titulo", titulo), ("trilha", trilha), ("ementa", ementa), ("link", link))])
    summary = F.when(F.coalesce(resumo, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("## resumo\n"), resumo, F.lit("\n\n")))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), summary, F.lit("## corpo\n"), corpo, F.lit("\n"))


def read_tree(spark: SparkSession, root: str, nested: bool = False) -> DataFrame:
    """(rel, doc struct) of the .md files one folder deep (two if nested), by relative path; deeper files are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), rf"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    rows = files.select(rel.alias("rel"), parse_document(F.decode("content", "UTF-8")).alias("doc"))
    deep = F.size(F.split("rel", "/")) > (2 if nested else 1)
    return rows.withColumn("rel", F.when(deep, F.raise_error(F.concat(F.lit("too deep: "), F.col("rel")))).otherwise(F.col("rel")))


def safe_path(path: Column) -> Column:
    """Whether a path has normal components only."""
    return ~(path.startswith("/") | (path == "") | path.rlike(r"(^|/)\.{0,2}(/|$)"))


def read_lines(spark: SparkSession, path: str, schema: str = EXTRACTION) -> DataFrame:
    """JSON lines; a broken last line is dropped (an append that was cut), any other one is an error."""
    return lines.read_json_lines(spark, path, schema)


def _typed(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def read_snapshot(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """A snapshot whose header has the version and the entity asked for; anything else is an error."""
    rows = spark.read.option("multiLine", True).json(path)
    head = rows.select("schema_version", "entity").first()
    if head is None or head["schema_version"] != SNAPSHOT_VERSION or head["entity"] != entity:
        raise ValueError(f"{path}: expected version {SNAPSHOT_VERSION} of {entity}, found {head}")
    return rows


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """The records of a reference text, see lines.read_references."""
    return lines.read_references(spark, path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Tenants of a TOML registry: one row each."""
    with open(path, "rb") as f:
        rows = tomllib.load(f).get("entity", [])
    return spark.createDataFrame([(r["id"], r.get("name"), r.get("uf"), r.get("state"), list(r.get("collections", []))) for r in rows], "id string, name string, uf string, state string, collections array<string>")


def uuid_time(uuid: Column) -> Column:
    """The timestamp that the first 48 bits of a version 7 UUID hold."""
    return F.timestamp_millis(F.conv(F.substring(F.replace(uuid, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends query-log rows (uuid, …) under the UTC month of their UUID."""
    rows.withColumn("month", F.date_format(uuid_time(F.col("uuid")), "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def find_log(spark: SparkSession, path: str, uuid: str) -> DataFrame:
    """One row of the log; only its month is read."""
    month = spark.range(1).select(F.date_format(uuid_time(F.lit(uuid)), "yyyy-MM")).first()[0]
    return spark.read.parquet(path).filter((F.col("month") == month) & (F.col("uuid") == uuid))


def cached_pages(requests: DataFrame, cache: DataFrame, offline: bool) -> DataFrame:
    """url and html from the cache; offline, a page that is not there is an error."""
    rows = requests.join(cache.select("url", "html"), "url", "left")
    return rows.withColumn("html", F.when(F.col("html").isNull() & F.lit(offline), F.raise_error(F.concat(F.lit("not cached: "), F.col("url")))).otherwise(F.col("html")))
