"""Update and removal of an entity's packs: from a tree of documents to published packs, in full or for some kinds.

A tree is a table: path (docs/<kind>/…), kind, titulo, trilha, ementa, resumo, corpo, link, content (the file's text). Both runs check
first, stage what changes, and publish by one rename; a refusal leaves the store as it was.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import key_hash
from tessera.operators import catalog as K
from tessera.operators.integrity import folder_hash
from tessera.operators.relational import approved_removals, orphans
from tessera.plans.ingest import Embedder, ingest, same_identity
from tessera.schemas import IDENTITY, KINDS, PACK_FORMAT
from tessera.sources import store as S

NAMES = [k[0] for k in KINDS]
INCREMENTAL = {k[0] for k in KINDS if k[4]}


class Refused(ValueError):
    """The run was refused before anything was written."""


def prepare(tree: DataFrame) -> DataFrame:
    """tree with id (the derived path), key (what is embedded) and document (the payload)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = [text(c).alias(c) for c in ("trilha", "titulo", "ementa", "resumo", "link")]
    path = K.doc_path(F.col("kind"), text("titulo"), text("link"), text("trilha"))
    key = K.embedding_key(F.col("kind"), text("trilha"), text("titulo"), text("ementa"), text("resumo"), text("corpo"))
    document = F.to_json(F.struct("kind", *fields, path.alias("doc_path")))
    return tree.withColumns({"id": path, "key": key, "document": document})


def refusals(documents: DataFrame) -> DataFrame:
    """(kind, problem, detail): rulings without a summary, files that are not where their fields say, and ids with several documents."""
    missing = K.missing_summary(documents, "kind", "titulo", "resumo").select("kind", F.lit("no summary").alias("problem"), F.concat(F.col("refused"), F.lit(": "), "names").alias("detail"))
    moved = K.misplaced(documents, "id", "path").select("kind", F.lit("misplaced").alias("problem"), F.concat("path", F.lit(" should be "), "id").alias("detail"))
    twice = documents.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind", F.lit("name collision").alias("problem"), F.col("id").alias("detail"))
    return missing.unionByName(moved).unionByName(twice)


def docs_hashes(tree: DataFrame) -> dict[str, str]:
    """The hash of each kind's folder: a row a kind."""
    files = tree.select("kind", F.regexp_replace("path", "^docs/", "").alias("path"), "content")
    return {r["kind"]: r["hash"] for r in folder_hash(files, "kind", "path", "content").collect()}


def drifts(recorded: dict[str, str], found: dict[str, str], besides: set[str]) -> list[tuple[str, str]]:
    """(kind, problem) of folders outside besides that are not what was recorded."""
    problem = lambda k: "unrecorded" if k not in recorded else "missing" if k not in found else "changed"
    return [(k, problem(k)) for k in sorted({*recorded, *found} - besides) if recorded.get(k) != found.get(k)]


def _stamp(manifest: dict | None, entity: str, entries: list[dict], hashes: dict[str, str], version: str | None, identity: dict, built_at: str | None) -> dict:
    """The manifest with new entries in place of those of their kinds, and the runs that the old one named."""
    old = manifest or {}
    new = {c["kind"]: c for c in [*old.get("collections", []), *entries]}
    return {
        "entity": entity,
        "version": version or old.get("version", "1"),
        "built_at": built_at or datetime.now(timezone.utc).isoformat(),
        **identity,
        "pack_format": PACK_FORMAT,
        "collections": [new[k] for k in NAMES if k in new],
        "docs_hashes": hashes,
        "before": sorted({c["run"] for c in old.get("collections", [])}),
    }


def update(spark: SparkSession, root: str, entity: str, tree: DataFrame, embedder: Embedder, kinds: list[str] | None = None, version: str | None = None, identity: dict | None = None, built_at: str | None = None) -> dict:
    """Brings an entity's packs up to its tree and publishes them: {manifest, reused, embedded, orphans, warnings, recovered}.

    kinds None is a full run: every kind with documents is rebuilt. A partial run keeps all other kinds as they are, and needs a
    manifest with folder hashes and the same identity of vectors; a kind asked for must have documents. Refused (raised) before
    anything is written: kinds that there are not, rulings without summary, files at other paths than derived, ids that collide.
    Vectors are reused by id and key hash where the identity agrees; payloads never are. Records of incremental kinds that left the tree
    stay and are listed as orphans; other kinds lose them.
    """
    identity = identity or {**IDENTITY, "dim": embedder.dim}
    chosen = list(dict.fromkeys(k.strip() for k in kinds or []))
    if unknown := [k for k in chosen if k not in NAMES]:
        raise Refused(f"no such kind: {', '.join(unknown)}; there are {', '.join(NAMES)}")
    manifest = S.read_manifest(spark, root, entity)
    valid = manifest is not None and same_identity(manifest, identity)
    if chosen and manifest is None:
        raise Refused(f"a partial run keeps what it does not run, and {entity} has no manifest")
    if chosen and manifest.get("docs_hashes") is None:
        raise Refused(f"the manifest of {entity} has no folder hashes")
    if chosen and not valid:
        raise Refused(f"vectors of {entity} have another identity; only a full run may change it")
    documents = prepare(tree)
    present = {r["kind"] for r in tree.select("kind").distinct().collect()}  # a row a kind
    if absent := [k for k in chosen if k not in present]:
        raise Refused(f"no documents of {', '.join(absent)}")
    running = [k for k in NAMES if k in (chosen or present)]
    documents = documents.filter(F.col("kind").isin(running))
    if bad := refusals(documents).limit(20).collect():
        raise Refused("; ".join(f"{r['kind']}: {r['problem']} ({r['detail']})" for r in bad))
    recovered = S.recover(spark, root, entity)
    # paths, keys and hashes of the tree are derived once, not by each job of each kind
    scratch = f"{S.shared_folder(spark)}/update-{uuid.uuid4().hex}"
    prepared = documents.select("kind", "id", "key", "document").withColumn("key_hash", key_hash("key"))
    prepared.write.option("compression", "zstd").partitionBy("kind").parquet(scratch)
    documents = spark.read.schema(prepared.schema).parquet(scratch)
    run, entries, counts = f"run-{uuid.uuid4().hex}", [], {}
    for kind in running:
        mine = documents.filter(F.col("kind") == kind).select("id", "key", "document", "key_hash")
        pack = S.read_kind(spark, root, manifest, kind)
        incremental = kind in INCREMENTAL and valid
        records, gone = ingest(mine, pack, embedder, incremental, valid)
        known = mine.join(pack.select("id", "key_hash"), ["id", "key_hash"], "left_semi").count() if valid else 0
        entries.append(S.stage(records, root, entity, run, kind, embedder.dim))
        left = gone.count() if incremental else 0
        counts[kind] = {"reused": known, "embedded": entries[-1]["count"] - known - left, "orphans": left}
    found = docs_hashes(tree)
    old_hashes = (manifest or {}).get("docs_hashes") or {}
    hashes = found if not chosen else {**{k: h for k, h in old_hashes.items() if k not in running}, **{k: found[k] for k in running}}
    base = manifest if chosen else manifest and {**manifest, "collections": [c for c in manifest["collections"] if c["kind"] in running]}
    stamped = _stamp(base, entity, entries, hashes, version if version or chosen else "1", identity, built_at)
    if manifest:
        stamped["before"] = sorted({c["run"] for c in manifest["collections"]})
    S.publish(spark, root, stamped)
    S.remove(spark, scratch)
    return {"manifest": stamped, "kinds": counts, "warnings": drifts(old_hashes, found, set(running)) if chosen else [], "recovered": recovered}


def pending_removals(spark: SparkSession, root: str, entity: str, tree: DataFrame) -> DataFrame:
    """(kind, id, document): published records of incremental kinds that are not in the tree. What a person may approve."""
    packs = S.read_store(spark, root, entity).filter(F.col("kind").isin(sorted(INCREMENTAL)))
    return orphans(packs, prepare(tree).select("id"), "id").select("kind", "id", "document")


def remove_approved(spark: SparkSession, root: str, entity: str, tree: DataFrame, approved: DataFrame, built_at: str | None = None) -> dict:
    """Removes approved orphans (approved: id) of incremental kinds and stamps those kinds anew: {manifest, kinds}.

    Refused where there is no manifest or the tree is not the one that the packs were made of. Approved ids that are in the tree again
    stay; orphans not approved stay. Without anything to remove nothing is written.
    """
    manifest = S.read_manifest(spark, root, entity)
    if manifest is None:
        raise Refused(f"{entity} has no manifest: update first")
    if manifest.get("docs_hashes") is None:
        raise Refused(f"the manifest of {entity} has no folder hashes: update first")
    if wrong := drifts(manifest["docs_hashes"], docs_hashes(tree), set()):
        raise Refused("the tree is not that of the packs: " + ", ".join(f"{k} {p}" for k, p in wrong))
    current, run, entries, report = prepare(tree), f"run-{uuid.uuid4().hex}", [], {}
    for kind in (c["kind"] for c in manifest["collections"] if c["kind"] in INCREMENTAL):
        pack = S.read_kind(spark, root, manifest, kind)
        mine = approved.filter(F.col("id").startswith(f"docs/{kind}/"))
        states = approved_removals(mine, pack, current.filter(F.col("kind") == kind), "id")
        report[kind] = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        if report[kind].get("remove"):
            left = pack.join(states.filter("state = 'remove'").select("id"), "id", "left_anti")
            entries.append(S.stage(left, root, entity, run, kind, manifest["dim"]))
    if not entries:
        return {"manifest": manifest, "kinds": report}
    identity = {k: manifest[k] for k in IDENTITY}
    stamped = _stamp(manifest, entity, entries, manifest["docs_hashes"], None, identity, built_at)
    S.publish(spark, root, stamped)
    return {"manifest": stamped, "kinds": report}
