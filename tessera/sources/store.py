"""A store of packs that is published by one rename.

    <root>/packs/entity=<entity>/run=<run>/kind=<kind>/…   records that a run wrote, never changed afterwards
    <root>/manifests/<entity>/manifest.json                for each kind: its run, count, width and content hash

A run writes beside what is there, reads its files back and holds them against what it measured while it wrote. Then it puts the
new manifest beside the old one and renames it into place: that is the commit, of all kinds at once. A run that dies before leaves
the old manifest and all files that it names; the next one removes what no manifest names. One writer a store is assumed;
readers need no lock, since the run before the last is kept.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.integrity import content_hash
from tessera.schemas import RECORD


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor share: spark.checkpoint.dir; a local session may leave it unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
    return path.rstrip("/")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(root: str, entity: str) -> str:
    return f"{root}/packs/entity={entity}"


def manifest_path(root: str, entity: str) -> str:
    return f"{root}/manifests/{entity}/manifest.json"


def place(root: str, entity: str, run: str, kind: str) -> str:
    return f"{folder(root, entity)}/run={run}/kind={kind}"


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """A file that is either the old one or the new one, whenever the process dies."""
    temporary, files = _files(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(temporary, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    rename(spark, temporary, path)


def rename(spark: SparkSession, temporary, path: str) -> None:
    """The commit: one rename that replaces what is there."""
    jvm = spark._jvm
    target, _ = _files(spark, path)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, target, how)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    target, files = _files(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if files.exists(target) else None


def remove(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.delete(target, True)


def read_manifest(spark: SparkSession, root: str, entity: str) -> dict | None:
    text = read_text(spark, manifest_path(root, entity))
    return None if text is None else json.loads(text)


def publish(spark: SparkSession, root: str, manifest: dict) -> None:
    write_atomic(spark, manifest_path(root, manifest["entity"]), json.dumps(manifest, ensure_ascii=False, indent=1))


def _measures() -> list[Column]:
    row = F.xxhash64("id", "key_hash", "document", "embedding")
    width = F.size("embedding")
    return [F.count(F.lit(1)).alias("count"), F.coalesce(F.min(width), F.lit(0)).alias("least"), F.coalesce(F.max(width), F.lit(0)).alias("dim"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("check")]


def stage(records: DataFrame, root: str, entity: str, run: str, kind: str, dim: int) -> dict:
    """Writes a kind's records beside the store, checks what was written, and gives its entry of the manifest.

    Count, widths and a checksum are measured while rows are written, and again on the files. Raises where they differ, where a vector has
    another width than dim, or where an id repeats; nothing has been published then.
    """
    spark, path, seen = records.sparkSession, place(root, entity, run, kind), Observation()
    records.select("id", "embedding", "document", "key_hash").observe(seen, *_measures()).write.mode("overwrite").parquet(path)
    files = spark.read.schema(RECORD).parquet(path)
    found = files.agg(*_measures(), F.count_distinct("id").alias("ids")).first().asDict()
    written = {k: seen.get[k] for k in ("count", "least", "dim", "check")}
    if written != {k: found[k] for k in written}:
        raise ValueError(f"{kind}: wrote {written}, files hold {found}")
    if found["count"] and not found["least"] == found["dim"] == dim:
        raise ValueError(f"{kind}: vectors of {found['least']} to {found['dim']} components where {dim} are expected")
    if found["ids"] != found["count"]:
        raise ValueError(f"{kind}: {found['count'] - found['ids']} ids repeat")
    return {"kind": kind, "count": found["count"], "dim": found["dim"], "run": run, "hash": pack_hash(files)}


def pack_hash(records: DataFrame) -> str:
    """The content hash of records: of sorted logical rows, not of files."""
    rows = records.select(F.lit("pack").alias("part"), "id", F.concat_ws("|", "key_hash", F.to_json("embedding"), "document").alias("line"))
    found = content_hash(rows, "part", "id", "line").first()
    return found["hash"] if found else ""


def entry_of(manifest: dict | None, kind: str) -> dict | None:
    return next((c for c in (manifest or {}).get("collections", []) if c["kind"] == kind), None)


def read_kind(spark: SparkSession, root: str, manifest: dict | None, kind: str) -> DataFrame:
    """The published records of a kind; none where it was never published."""
    entry = entry_of(manifest, kind)
    if entry is None:
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(place(root, manifest["entity"], entry["run"], kind))


def read_store(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """(kind, id, embedding, document, key_hash) of all kinds that the manifest names."""
    manifest = read_manifest(spark, root, entity)
    found = spark.createDataFrame([], f"kind string, {RECORD}")
    for entry in (manifest or {}).get("collections", []):
        found = found.unionByName(read_kind(spark, root, manifest, entry["kind"]).withColumn("kind", F.lit(entry["kind"])))
    return found


def verify(spark: SparkSession, root: str, manifest: dict) -> list[str]:
    """The kinds whose files are not what the manifest says."""
    bad = []
    for entry in manifest["collections"]:
        records = read_kind(spark, root, manifest, entry["kind"])
        if records.count() != entry["count"] or pack_hash(records) != entry["hash"]:
            bad.append(entry["kind"])
    return bad


def recover(spark: SparkSession, root: str, entity: str) -> list[str]:
    """Removes what runs that died left: folders that neither the manifest nor the one before it names, and manifests never renamed. Returns their names."""
    manifest = read_manifest(spark, root, entity) or {}
    kept = {c["run"] for c in manifest.get("collections", [])} | set(manifest.get("before", []))
    gone = []
    for where in (folder(root, entity), f"{root}/manifests/{entity}"):
        at, files = _files(spark, where)
        for status in files.listStatus(at) if files.exists(at) else []:
            name = status.getPath().getName().removeprefix("run=")
            if (status.isDirectory() and name.startswith("run-") and name not in kept) or name.endswith(".tmp"):
                files.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(entity, kind, run, count, dim, hash, model_id, strategy, version): a row a kind that any entity has published."""
    entry = "struct<kind string, count long, dim int, run string, hash string>"
    rows = spark.read.schema(f"entity string, version string, model_id string, strategy int, dim int, collections array<{entry}>").option("multiLine", True).option("pathGlobFilter", "manifest.json")
    found = rows.json(f"{root}/manifests/*/manifest.json") if _any(spark, f"{root}/manifests/*/manifest.json") else spark.createDataFrame([], f"entity string, version string, model_id string, strategy int, dim int, collections array<{entry}>")
    return found.select("entity", "version", "model_id", "strategy", F.col("dim").alias("width"), F.explode("collections").alias("c")).select("entity", "c.kind", "c.run", "c.count", "c.dim", "c.hash", "version", "model_id", "strategy", "width")


def _any(spark: SparkSession, glob: str) -> bool:
    target, files = _files(spark, glob)
    return len(files.globStatus(target) or []) > 0


def identity_errors(entries: DataFrame, identity: dict) -> DataFrame:
    """(entity, problem): entities whose vectors are not those that are searched with; they are not loaded."""
    parts = [(name, F.col(column), identity[key]) for name, column, key in (("model", "model_id", "model_id"), ("width", "width", "dim"), ("strategy", "strategy", "strategy"))]
    wrong = F.concat_ws(", ", *[F.when(~c.eqNullSafe(F.lit(v)), F.concat(F.lit(f"{name} is "), F.coalesce(c.cast("string"), F.lit("unknown")))) for name, c, v in parts])
    return entries.select("entity", wrong.alias("problem")).filter("problem <> ''").distinct()


def load_all(spark: SparkSession, root: str, identity: dict) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of all entities: entity, kind, id, embedding, document, key_hash; and entity, kind, problem, fatal.

    The manifests, a row an entity and kind, are broadcast and joined with the partitions of the store, so that files of runs that no
    manifest names and of entities with another identity are not read (no two runs share a name, so the run alone tells). A kind whose count is not the manifest's is a
    warning (not fatal): its records are loaded.
    """
    entries = manifests(spark, root)
    errors = identity_errors(entries, identity)
    sound = entries.join(errors.select("entity"), "entity", "left_anti")
    wanted = sound.filter("count > 0").select("entity", "run", "kind")
    records = spark.createDataFrame([], f"entity string, kind string, {RECORD}")
    if not wanted.isEmpty():
        every = spark.read.schema(f"{RECORD}, entity string, run string, kind string").option("basePath", f"{root}/packs").parquet(f"{root}/packs")
        records = every.join(F.broadcast(wanted), ["entity", "run", "kind"]).select("entity", "kind", "id", "embedding", "document", "key_hash")
    sizes = records.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"))
    drift = sound.join(sizes, ["entity", "kind"], "left").filter(F.coalesce("n", F.lit(0)) != F.col("count"))
    told = F.concat(F.lit("the manifest has "), "count", F.lit(" records, the files "), F.coalesce("n", F.lit(0)))
    problems = errors.select("entity", F.lit(None).cast("string").alias("kind"), "problem", F.lit(True).alias("fatal")).unionByName(drift.select("entity", "kind", told.alias("problem"), F.lit(False).alias("fatal")))
    return records, problems


def entities_with(entries: DataFrame, kind: str) -> DataFrame:
    """Entities that have records of a kind, in order."""
    return entries.filter((F.col("kind") == kind) & (F.col("count") > 0)).select("entity").distinct().orderBy("entity")


def kinds_of(entries: DataFrame) -> DataFrame:
    """The kinds that any entity has."""
    return entries.filter("count > 0").select("kind").distinct()


def append_new(rows: DataFrame, path: str, key: str, state: Column | None = None) -> dict[str, int]:
    """Appends the rows whose key the table at path does not have: {total, created, skipped, failed, remaining}.

    state may say 'failed' or 'remaining' of a row; such rows are not written. Of several new rows of a key one is
    written, the others are skipped. Counts are measured by the job that writes, and must add up to the total before the one rename that
    makes the batch part of the table (folders batch-…); otherwise this raises and nothing has changed. A second run creates 0.
    """
    spark, batch = rows.sparkSession, f"batch-{uuid.uuid4().hex}"
    held = spark.read.parquet(f"{path}/batch-*").select(key).distinct().withColumn("_held", F.lit(True)) if _any(spark, f"{path}/batch-*") else rows.select(key).limit(0).withColumn("_held", F.lit(True))
    told = rows.withColumn("_state", F.lit(None).cast("string") if state is None else state)
    fresh = told.filter("_state is null").groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*rows.columns), F.struct(*[c for c in rows.columns])).alias("_row"))
    placed = fresh.join(held, key, "left")
    seen, others = Observation(), Observation()
    new = F.col("_held").isNull()
    counted = placed.observe(seen, F.coalesce(F.sum(F.when(new, 1)), F.lit(0)).alias("created"), F.coalesce(F.sum("_n"), F.lit(0)).alias("known"))
    counted.filter(new).select("_row.*").write.parquet(f"{path}/_staged/{batch}")
    told.select("_state").observe(others, F.count(F.lit(1)).alias("total"), F.count_if(F.col("_state") == "failed").alias("failed"), F.count_if(F.col("_state") == "remaining").alias("remaining")).write.format("noop").mode("overwrite").save()
    found, rest = seen.get, others.get
    counts = {"total": rest["total"], "created": found["created"], "skipped": found["known"] - found["created"], "failed": rest["failed"], "remaining": rest["remaining"]}
    written = spark.read.schema(rows.schema).parquet(f"{path}/_staged/{batch}").count()
    if sum(counts.values()) != 2 * counts["total"] or written != counts["created"]:
        remove(spark, f"{path}/_staged/{batch}")
        raise ValueError(f"counts do not add up: {counts}, {written} rows written")
    if written:
        staged, files = _files(spark, f"{path}/_staged/{batch}")
        if not files.rename(staged, _files(spark, f"{path}/{batch}")[0]):
            raise OSError(f"{path}/{batch} could not be put in its place")
    return counts
