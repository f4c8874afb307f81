"""Mixing sources to target weights: a time-varying curriculum, in DataFrame operations only.

Every source has a share of all words (its target) and a weight schedule over training time t in [0, 1]. The schedule's
integral is the source's cumulative token demand; inverting it turns a document's offset in its source's stream into a
training position, and a range sort by position gives the order of training.

Running sums over a source never need one task: documents are ordered by md5 of doc_id, whose first three hex digits name
one of 4,096 buckets; sums of buckets are accumulated first, then rows inside one (source, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stash, write_table

#: Slope of the linear schedule of a source by its weight: light sources come early, heavy ones late.
SLOPES = {1: -0.5, 2: 0.0, 3: 0.5}
CAP = 3.0
#: What a plan adds to the columns of its documents; start is a document's offset in the stream of its source.
ADDED = ("size", "source_size", "weight", "target", "start", "copies", "taken", "first_position")


def source_targets(sized: DataFrame, cap: float = CAP) -> DataFrame:
    """Columns skey, source_size, weight, target: shares of all words by weight, stopped at cap times the source's size.

    The excess of a stopped source is shared among the others by weight, again and again; that fixed point is a water
    level L with sum(min(cap_i, L * w_i)) = total, found from running sums over the sources in the order of cap_i / w_i.
    The windows below run over one row per source, never over documents.
    """
    sizes = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", "skey").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("level", "skey").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    water = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(order), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("water", water)
    # the first source in that order which the level does not fill sets the level; if all are filled, none is needed
    found = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "skey", "water"))).over(whole)["water"]
    ranked = ranked.withColumn("found", found)
    return ranked.select("skey", "source_size", "weight", F.when(F.col("found").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("found") * F.col("weight"))).alias("target"))


def inverse_demand(share: Column, slope: Column) -> Column:
    """The time t at which (1 - a) t + a t^2 = share: the demand of the schedule 1 + a (2 t - 1), inverted."""
    b = F.lit(1.0) - slope
    root = (F.sqrt(b * b + F.lit(4.0) * slope * share) - b) / (F.lit(2.0) * F.when(slope == 0, F.lit(1.0)).otherwise(slope))
    return F.when(slope == 0, share).otherwise(root)


def plan_mix(docs: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds the columns ADDED to every row; all columns of docs stay.

    Whole epochs come first (floor of target / source_size copies of every document); the rest of the target goes to the
    documents first in md5 order, up to the one whose middle passes it. A null text has size 0, a null source is a source
    of its own, rows with the same doc_id are mixed as separate documents. Empty tables give empty results.
    Names it adds replace columns of docs with the same names.
    """
    rows, others = stash(docs, ["doc_id", "text", "source"], ADDED)
    rows = rows.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumns({"skey": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")), "mkey": key, "bucket": F.substring(key, 1, 3)})
    sums = write_table(rows.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("size")), "mix-sums")
    before = F.sum("size").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("skey", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    offsets = write_table(offsets.join(source_targets(sums, cap), "skey"), "mix-offsets")
    inside = F.sum("size").over(Window.partitionBy("skey", "bucket").orderBy("mkey", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(offsets, ["skey", "bucket"]).withColumn("start", F.col("offset") + inside - F.col("size"))
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("start") + F.col("size") / 2.0 < left).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("copies", F.col("epochs") + F.when(F.col("size") > 0, extra).otherwise(0))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    rows = rows.withColumn("first_position", F.when(F.col("taken") > 0, position(F.lit(0))))
    return rows.select("doc_id", "text", "source", *others, *ADDED)


def position(epoch: Column) -> Column:
    slope = F.element_at(F.create_map(*[F.lit(float(x)) for kv in SLOPES.items() for x in kv]), F.col("weight"))
    share = (epoch * F.col("source_size") + F.col("start") + F.col("size") / 2.0) / F.col("target")
    return inverse_demand(F.least(F.lit(1.0), share), slope)


def ordered_mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: one row per copy taken, with the columns of docs and position, range-sorted by position."""
    packed, others = stash(docs, ["doc_id", "text", "source"], ("position", "epoch"))
    plan = plan_mix(packed).filter("taken > 0")
    copies = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    copies = copies.select("doc_id", "text", "source", "_rest", position(F.col("epoch")).alias("position"), "epoch")
    ordered = copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "epoch")
    return ordered.select("doc_id", "text", "source", *others, "position", "epoch")


def op8(docs: DataFrame) -> DataFrame:
    """The plan of the mix, one row per document, range-sorted by first training position."""
    plan = plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")
    plan = write_table(plan, "mix-plan")
    return plan.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


#: The same plan for DuckDB; first_position is rounded in neither.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mkey FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sized GROUP BY source),
levels AS (SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / weight AS level FROM sources),
water AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY level, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM levels),
targets AS (
  SELECT source, source_size, weight, CASE WHEN found IS NULL THEN most ELSE least(most, found * weight) END AS target
  FROM water, (SELECT (SELECT water FROM water WHERE water <= level ORDER BY level, source LIMIT 1) AS found)),
placed AS (
  SELECT doc_id, size, source_size, target, weight, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS epochs,
    (sum(size) OVER (PARTITION BY s.source ORDER BY mkey, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, epochs + CASE WHEN size > 0 AND start + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies,
  CASE WHEN copies * size > 0 THEN
    CASE WHEN weight = 2 THEN least(1.0::DOUBLE, (start + size / 2.0::DOUBLE) / target)
    ELSE (sqrt((1.0::DOUBLE - a) * (1.0::DOUBLE - a) + 4.0::DOUBLE * a * least(1.0::DOUBLE, (start + size / 2.0::DOUBLE) / target)) - (1.0::DOUBLE - a)) / (2.0::DOUBLE * a) END END AS first_position
FROM (SELECT *, CASE WHEN weight = 1 THEN -0.5::DOUBLE WHEN weight = 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS a FROM copied)
"""
