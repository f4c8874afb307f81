"""Trees in rows: places by pointer doubling, document order by path keys, sums over subtrees, last-write maps.

A tree is a table of nodes (id, parent, seq: place among siblings from 0) and one of items that hang on nodes (node, seq). place()
gives each node its path: the places from the root down, as an array. Arrays compare from the left, so paths sort
parents before children and siblings by place; with a number past all places at the end they sort children first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import effective_url
from tessera.operators.lexical import matches
from tessera.operators.relational import number_all

#: Places: an item among a node's children comes after all of them, or before all; LAST is after everything.
AFTER, LAST = 1 << 40, (1 << 62)


def place(nodes: DataFrame, id: str = "id", parent: str = "parent", seq: str = "seq") -> DataFrame:
    """nodes with path (places from the root down to the node) and ancestors (ids from the root down, without the node).

    A node with a null parent is a root. Every round a node jumps over as far as it has come, so a tree of depth d takes log2(d)
    joins, each by id; nodes that have arrived don't move any more. A parent that is no node and a cycle are errors. Paths take as much room as
    the tree is deep.
    """
    rows = nodes.select(F.col(id).alias("_id"), F.col(parent).alias("_jump"), F.array(F.col(seq).cast("long")).alias("_path"), F.array(id).alias("_ids"))
    while True:
        open_ = rows.filter("_jump is not null")
        if open_.isEmpty():
            break
        reached = rows.select(F.col("_id").alias("_at"), F.col("_jump").alias("_next"), F.col("_path").alias("_before"), F.col("_ids").alias("_above"))
        moved = open_.join(reached, F.col("_jump") == F.col("_at"), "left")
        ids = F.concat("_above", "_ids")
        wrong = F.when(F.col("_at").isNull(), F.raise_error(F.concat(F.lit("a parent that is no node: "), F.col("_jump").cast("string"))))
        wrong = wrong.when(F.size(F.array_distinct(ids)) < F.size(ids), F.raise_error(F.concat(F.lit("a cycle through "), F.col("_id").cast("string"))))
        moved = moved.select("_id", F.col("_next").alias("_jump"), F.concat("_before", "_path").alias("_path"), F.coalesce(wrong.cast(rows.schema["_ids"].dataType), ids).alias("_ids"))
        rows = moved.unionByName(rows.filter("_jump is null")).checkpoint()
    found = rows.select("_id", F.col("_path").alias("path"), F.slice("_ids", F.lit(1), F.size("_ids") - 1).alias("ancestors"))
    return nodes.join(found, F.col(id) == F.col("_id")).drop("_id")


def on_nodes(placed: DataFrame, items: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """items with path, ancestors and the given columns of their node."""
    return items.join(placed.select(F.col("id").alias("_id"), "path", "ancestors", *columns), F.col(node) == F.col("_id")).drop("_id")


def flatten(placed: DataFrame, items: DataFrame, node: str = "node", seq: str = "seq", page_type: str = "page_type", wanted: str = "faq") -> DataFrame:
    """Items of pages of the wanted type, numbered n from 1 in document order: a page's items, then those of its children. The root's own items are left out."""
    rows = on_nodes(placed, items, node, [page_type]).filter((F.col(page_type) == wanted) & (F.size("ancestors") > 0))
    keyed = rows.withColumn("_key", F.concat("path", F.array(F.col(seq).cast("long") - AFTER)))
    return number_all(keyed, [F.col("_key")]).drop("_key", "path", "ancestors", page_type)


def listed(placed: DataFrame, items: DataFrame, node: str = "node", seq: str = "seq", title: str = "title", url: str = "url", text: str = "text") -> DataFrame:
    """Nodes and items as one tree below the root: id, item (its place, null for a node), text, url (an item has its node's), path, ancestors (ids below the root)."""
    below = F.slice("ancestors", F.lit(2), F.greatest(F.size("ancestors") - 1, F.lit(0)))
    nodes = placed.filter(F.size("ancestors") > 0).select("id", F.lit(None).cast("long").alias("item"), F.coalesce(title, F.lit("")).alias("text"), F.nullif(url, F.lit("")).alias("url"), "path", below.alias("ancestors"))
    hung = on_nodes(placed, items, node, [url]).filter(F.size("ancestors") > 0)
    own = F.concat(below, F.array(F.col(node)))
    leaves = hung.select(F.col(node).alias("id"), F.col(seq).cast("long").alias("item"), F.col(text).alias("text"), F.nullif(url, F.lit("")).alias("url"), F.concat("path", F.array(F.col(seq).cast("long") + AFTER)).alias("path"), own.alias("ancestors"))
    return nodes.unionByName(leaves)


def numbered(tree: DataFrame) -> DataFrame:
    """A listed tree with name: node-0, node-1, … in the order in which a walk finishes: children, then items, then the node."""
    keyed = tree.withColumn("_key", F.concat("path", F.array(F.lit(LAST))))
    return number_all(keyed, [F.col("_key")], "_n").withColumn("name", F.concat(F.lit("node-"), F.col("_n") - 1)).drop("_key", "_n")


def search(tree: DataFrame, query: str) -> DataFrame:
    """Rows of a listed tree whose text has every term, with above (texts of the ancestors from the top) and the URL that is in force there.

    Only hits look up their ancestors: a row an ancestor, joined by id.
    """
    hits = tree.filter(matches(query, F.col("text")))
    names = tree.filter("item is null").select(F.col("id").alias("_a"), F.col("text").alias("_text"), F.col("url").alias("_url"))
    spread = hits.select("path", F.posexplode("ancestors").alias("_at", "_a")).join(names, "_a")
    chain = spread.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_at", "_text", "_url"))).alias("_chain"))
    rows = hits.join(chain, "path", "left").withColumn("_chain", F.coalesce("_chain", F.array().cast(chain.schema["_chain"].dataType)))
    above, urls = F.transform("_chain", lambda x: x["_text"]), F.transform("_chain", lambda x: x["_url"])
    return rows.select("id", "item", "text", "path", above.alias("above"), effective_url(F.col("url"), urls).alias("url"))


def subtree_counts(placed: DataFrame, items: DataFrame, node: str = "node") -> DataFrame:
    """(id, items): how many items hang on each node or below it. A node's own are counted first, so a row a node and ancestor moves."""
    own = items.groupBy(F.col(node).alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    spread = placed.join(own, F.col("id") == F.col("_own")).select(F.explode(F.concat("ancestors", F.array("id"))).alias("_id"), "_n")
    sums = spread.groupBy("_id").agg(F.sum("_n").alias("items"))
    return placed.select("id").join(sums, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("items", F.lit(0)).alias("items"))


def last_write(rows: DataFrame, key: Column, value: Column, order: Column) -> DataFrame:
    """(key, value): what a walk in the given order leaves in a map, where later entries replace earlier ones."""
    return rows.groupBy(key.alias("key")).agg(F.max_by(value, order).alias("value"))


def answers(placed: DataFrame, items: DataFrame, node: str = "node", seq: str = "seq", question: str = "question", answer: str = "answer") -> DataFrame:
    """(key, value): the answer to each question (trimmed, lower case) that a walk from the root finds last; the root's own items count."""
    rows = on_nodes(placed, items, node, [])
    return last_write(rows, F.lower(F.regexp_replace(question, r"(?U)^\s+|\s+$", "")), F.col(answer), F.concat("path", F.array(F.col(seq).cast("long") - AFTER)))


def page_types(placed: DataFrame, url: str = "url", page_type: str = "page_type") -> DataFrame:
    """(key, value): the type of each URL, without a last slash, of pages that have both; the last one of a walk counts."""
    rows = placed.filter((F.coalesce(url, F.lit("")) != "") & (F.coalesce(page_type, F.lit("")) != ""))
    return last_write(rows, F.regexp_replace(url, "/$", ""), F.col(page_type), F.col("path"))
