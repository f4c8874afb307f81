"""From colliding items to classes: hub pairs in each bucket, verified links, components, and what hubs left open.

All pairs of a bucket are never made. A bucket's hub is its member with the most collisions over all buckets; each other
member is verified against it, which is linear in the rows. Links give components. Only buckets whose members then
still lie in different components have open pairs, and no link between colliding items may be lost there:

1. What no other open item has cannot be shared. A shuffle of the open items' shingles finds those that occur once, and so each item's
   common part, in all and in CELLS cells of the hashes (its outline). Members whose common part is too small for any partner as
   light as the lightest of the bucket leave it, in one pass over the rows.
2. The members that stay are verified against a second hub, the one with the largest common share: the copy that is nearest
   to what the group has in common. Components are found again.
3. Pairs that are still across components, and whose common parts' outlines allow the similarity, are verified.

What two items share is at most the sum of the smaller of both in each cell, so these tests drop only pairs that cannot reach
the similarity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, write_table
from tessera.operators.graph import connected_components


def crowded(members: DataFrame) -> DataFrame:
    """The rows of members (key, id, weight; distinct in key and id) whose key has two or more, with the number of them as size.

    They are dealt by key once: both uses of the shuffle need the whole item, so Spark keeps them alike and reuses it.
    """
    dealt = members.select("key", F.struct("id", "weight").alias("item")).repartition("key")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("item").alias("low"), F.max("item").alias("high")).filter("low <> high")
    return write_table(dealt.join(sizes.select("key", "size"), "key").select("key", "item.*", "size"), "link-shared")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b) with a the hub of a bucket that holds b. shared: key, id, weight, size; a bucket is a key."""
    degree = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = shared.join(degree, "id")
    hub = ranked.groupBy("key").agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("weight").alias("wa")), F.struct("degree", F.hash("id"), "id")).alias("hub"))
    pairs = shared.join(hub.select("key", "hub.*"), "key").filter("a <> id")
    return pairs.select("a", F.col("id").alias("b"), "wa", F.col("weight").alias("wb"))


#: Cells of an outline.
CELLS = 32


def may_reach(least: float) -> Column:
    """Whether outlines oa and ob and total weights wa and wb allow the similarity. A lambda, since 32 terms in a row are too much for the JIT."""
    shared = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.least(x, y)), F.lit(0.0), lambda acc, x: acc + x)
    return shared * F.lit(1 + least) >= F.lit(least - 1e-6) * (F.col("wa") + F.col("wb"))


def plausible(pairs: DataFrame, least: float) -> DataFrame:
    """Distinct pairs whose total weights allow the similarity: it is at most the smaller over the larger one."""
    near = pairs.filter(F.least("wa", "wb") >= F.lit(least - 1e-9) * F.greatest("wa", "wb"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of buckets that hold two components or more, with their component."""
    placed = members.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return placed.join(keys, "key")


def merge_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after more links (a, b): only the components that they join take part, not the links inside them."""
    own = lambda x: classes.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    named = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    edges = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b").distinct()
    joined = write_table(connected_components(edges), "link-joined").select(F.col("id").alias("component"), F.col("component").alias("low"))
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().join(classes, "id", "left_anti")
    every = classes.unionByName(ends.withColumn("component", F.col("id")))
    return write_table(every.join(joined, "component", "left").select("id", F.coalesce("low", "component").alias("component")), "link-classes")


def common_parts(contents: DataFrame) -> DataFrame:
    """(id, outline, common) of the items: the outline and weight of what another of them has as well. contents: (id, shingle, w)."""
    cell = F.shiftrightunsigned("shingle", 59)
    cells = lambda df, name: df.groupBy("id").agg(F.array(*[F.sum(F.when(cell == k, F.col("w")).otherwise(F.lit(0.0))) for k in range(CELLS)]).alias(name))
    own = contents.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("w").alias("w")).filter("n = 1")
    rest = F.when(F.col("own").isNull(), F.col("outline")).otherwise(F.zip_with("outline", "own", lambda x, y: F.greatest(x - y, F.lit(0.0))))
    left = cells(contents, "outline").join(cells(own, "own"), "id", "left").select("id", rest.alias("outline"))
    return left.withColumn("common", F.aggregate("outline", F.lit(0.0), lambda acc, x: acc + x))


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], least: float, contents: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) and classes (id, component) of the items that have one.

    members: (key, id, weight, size) rows as crowded gives them, distinct in key and id; verify: pairs (a, b) to those of similarity
    least or more; contents: ids (id) to their distinct shingles (id, shingle, w). Without it all pairs across the components of
    a bucket are verified.
    """
    spark = members.sparkSession
    shared_dir(spark)
    tried = write_table(plausible(hub_pairs(members), least), "link-hubs")
    links = write_table(verify(tried), "link-verified")
    classes = write_table(connected_components(links), "link-classes")
    left = write_table(mixed(members, classes), "link-open")
    reach = lambda common, total: common * F.lit(1 + least) >= F.lit(least - 1e-6) * total
    if left.isEmpty():
        return links, classes
    if contents is not None:
        parts = contents(write_table(left.select("id").distinct(), "link-open-ids"))
        left = left.join(common_parts(parts), "id")
        bounds = left.groupBy("key").agg(F.min("weight").alias("lightest"), F.max("common").alias("most"))
        left = left.join(bounds, "key").filter(reach(F.least("common", "most"), F.col("weight") + F.col("lightest"))).drop("lightest", "most")
        left = write_table(left, "link-able")
        member = F.struct(F.col("id").alias("a"), F.col("weight").alias("wa"), F.col("component").alias("ca"), F.col("outline").alias("oa"))
        hub = write_table(left.groupBy("key").agg(F.max_by(member, F.struct(F.col("common") / F.col("weight"), "id")).alias("hub")).select("key", "hub.*"), "link-centres")
        pairs = left.withColumnsRenamed({"id": "b", "weight": "wb", "component": "cb", "outline": "ob"}).join(hub, "key").filter("ca <> cb").filter(may_reach(least))
        pairs = write_table(plausible(pairs, least).join(tried, ["a", "b"], "left_anti"), "link-centre-pairs")
        tried = tried.unionByName(pairs)
        found = write_table(verify(pairs), "link-verified")
        links, classes = links.unionByName(found), merge_classes(classes, found)
        left = write_table(mixed(left.drop("component"), classes), "link-open")
    else:
        left = left.withColumns({"outline": F.lit(None).cast("array<double>"), "common": F.col("weight")})
    open_pairs = write_table(plausible(across(left, least, contents is not None), least).join(tried, ["a", "b"], "left_anti"), "link-open-pairs")
    if open_pairs.isEmpty():
        return links, classes
    found = write_table(verify(open_pairs), "link-verified")
    return links.unionByName(found), merge_classes(classes, found)


def across(left: DataFrame, least: float, outlined: bool) -> DataFrame:
    """The pairs of a bucket's members in different components that may be similar enough.

    Members of the bucket's largest component are not paired with each other: only the others have a row on the left.
    """
    sizes = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    side = lambda df, x: df.select("key", F.col("id").alias(x), *[F.col(c).alias(c[0] + x) for c in ("weight", "component", "outline")], F.col("common").alias(f"m{x}"))
    told = left.join(largest, "key")
    rest, main = told.filter("component <> largest"), told.filter("component = largest")
    one = side(rest, "a")
    scalar = (F.col("ca") != F.col("cb")) & (F.least("ma", "mb") * F.lit(1 + least) >= F.lit(least - 1e-6) * (F.col("wa") + F.col("wb")))
    every = one.join(side(main, "b"), "key").filter(scalar).unionByName(one.join(side(rest, "b"), "key").filter(scalar & (F.col("a") < F.col("b"))))
    return every.filter(may_reach(least)) if outlined else every
