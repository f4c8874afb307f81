"""Dedup, merge, reuse, set differences and integrity checks over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in the given total order, and the others."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn"), ranked.filter("_rn > 1").drop("_rn")


def fold(rows: DataFrame, key: str, seq: str, first: list[str], gather: str) -> DataFrame:
    """One row a key: first values by seq, and what is gathered in order of seq without repeats; ties of seq go to the smaller value.

    Repeats of a value are reduced to their first seq before a key's values are gathered, so a row holds distinct values only.
    """
    heads = rows.groupBy(key).agg(*[F.min_by(c, F.struct(seq, c)).alias(c) for c in first])
    values = rows.filter(F.col(gather).isNotNull()).groupBy(key, gather).agg(F.min(seq).alias("_at"))
    lists = values.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", gather))), lambda x: x[gather]).alias(gather))
    return heads.join(lists, key, "left")


def first_of(rows: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """Ordered dedup: of each key the row that comes first by seq; the other columns break ties."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*seq, *[c for c in rest if c not in seq])).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(rows.columns)


def number_all(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows numbered from 1 in the given total order, without a task that sees them all.

    Rows are range-sorted and checkpointed; a task's rows are numbered from the count of rows in the tasks before it. Only a
    row a task is gathered for those counts.
    """
    placed = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_task")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_task", F.coalesce(F.sum("_size").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_task"))
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_task", "_before")


def number_in_parts(rows: DataFrame, part: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """rows numbered from 1 in each part in the given total order, as number_all does: a part may be larger than a task.

    A row's number comes from its part's rows in the tasks before and its place among those of its own task, so the last join is by
    task and part and deals out no part as a whole.
    """
    placed = rows.orderBy(*[F.col(c).asc_nulls_first() for c in part], *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)).checkpoint()
    sizes = placed.groupBy("_task", *part).agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*part).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).select(F.col("_task").alias("_t"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], "_first", "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(part)], F.col("_task") == F.col("_t"))
    return placed.join(before, same).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_task", "_t", "_first", "_before", *[f"_p{i}" for i in range(len(part))])


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def reuse(current: DataFrame, pack: DataFrame) -> DataFrame:
    """current (id, key_hash) with the pack's vector where both agree; a null hash is never reused."""
    return current.join(pack.select("id", "key_hash", "embedding"), ["id", "key_hash"], "left")


def merge(old: DataFrame, upserts: DataFrame, removes: DataFrame, key: str, seq: str) -> DataFrame:
    """Deletes, then upserts by key; of several new rows of a key the last by seq counts."""
    new = upserts.groupBy(key).agg(*[F.max_by(c, seq).alias(c) for c in upserts.columns if c not in (key, seq)])
    return old.join(removes.select(key), key, "left_anti").join(new, key, "left_anti").unionByName(new.select(old.columns))


def orphans(pack: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    return pack.join(tree.select(key), key, "left_anti")


def approved_removals(approved: DataFrame, pack: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """key and state: 'remove' (approved orphan), 'wait' (orphan not approved), 'back' (approved, but in the tree again), 'gone'."""
    a, p, t = (x.select(key).distinct().withColumn(f, F.lit(True)) for x, f in ((approved, "a"), (pack, "p"), (tree, "t")))
    rows = a.join(p, key, "full_outer").join(t, key, "full_outer")
    orphan = F.col("p").isNotNull() & F.col("t").isNull()
    state = F.when(orphan & F.col("a").isNotNull(), "remove").when(orphan, "wait").when(F.col("a").isNotNull() & F.col("t").isNotNull(), "back").when(F.col("a").isNotNull(), "gone")
    return rows.select(key, state.alias("state")).filter("state is not null")


def validate_hashes(recorded: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Mismatches of (key, hash): missing, unrecorded or changed."""
    both = recorded.select(key, F.col("hash").alias("was")).join(found.select(key, F.col("hash").alias("now")), key, "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unrecorded").when(F.col("was") != F.col("now"), "changed")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def merge_manifest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries replace those of their kind; other entries stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def span_overlap(found: DataFrame, expected: DataFrame, doc: str) -> DataFrame:
    """Pairs of a document whose spans overlap."""
    a, b = found.alias("a"), expected.alias("b")
    return a.join(b, (F.col(f"a.{doc}") == F.col(f"b.{doc}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))


def number_rows(rows: DataFrame, part: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Numbers from 1 that restart in each part."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
