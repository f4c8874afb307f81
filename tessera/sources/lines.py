"""Readers of large text files, in splits: the place of every line, broken last lines, records over several lines.

Spark reads a file's blocks in different tasks and keeps each line whole. A line's place is its block's start and its number in the
block, so lines have an order without a task that sees them all; what comes before a block (bytes, records) is summed from one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLACE = ["file", "block", "at"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of a file or folder; file, block and at give their order. A carriage return before the line end goes."""
    rows = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    return rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def before_blocks(rows: DataFrame, size: Column, name: str) -> DataFrame:
    """rows with the sum of size over all earlier lines of the file. A window holds one block, or one row a block of a file."""
    sized = rows.withColumn("_size", size)
    blocks = sized.groupBy("file", "block").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_own", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(before, ["file", "block"])
    return placed.withColumn(name, F.col("_before") + F.col("_own")).drop("_size", "_own", "_before")


def with_offsets(rows: DataFrame) -> DataFrame:
    """rows with offset: the byte at which each line starts in its file. Lines end with one line feed, but for the last perhaps."""
    return before_blocks(rows, F.octet_length("value").cast("long") + 1, "offset")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON lines. A broken last line of a file is dropped (an append that was cut); any other broken line is an error that names its byte.

    Blank lines don't count. One row a file is gathered to tell last lines.
    """
    every = read_lines(spark, path).filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    fields = StructType.fromDDL(schema)
    parsed = every.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    broken = with_offsets(parsed.select(*PLACE, "value", F.col("row._bad").isNotNull().alias("bad"))).filter("bad")
    last = every.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    wrong = broken.join(last, "file").filter(F.struct("block", "at") < F.col("last")).orderBy("file", "offset").select("file", "offset").first()
    if wrong is not None:
        raise ValueError(f"broken line at byte {wrong['offset']} of {wrong['file']}")
    return parsed.filter("row._bad is null").select(*[F.col("row")[f.name].alias(f.name) for f in fields])


def read_records(spark: SparkSession, path: str, mark: str = r"^\s*//\s*\d{1,10}\s*$") -> DataFrame:
    """(file, n, lines): records that open with a line that mark matches, numbered in their file from 1; lines before the first are left out.

    A record may lie in several blocks: lines are numbered by the marks before them, over all blocks, and gathered by that number.
    """
    rows = read_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    opens = F.col("value").rlike(mark)
    counted = before_blocks(rows, opens.cast("long"), "_marks").withColumn("n", F.col("_marks") + opens.cast("long")).filter(F.col("n") > 0)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    return counted.groupBy("file", "n").agg(F.slice(lines, F.lit(2), F.greatest(F.count(F.lit(1)) - 1, F.lit(0))).alias("lines"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, descricao, assunto, link, resumo, corpo, answered) of records set apart by lines `// number`.

    Before a line `## resposta` lines carry labels (the last of each counts) or go on the summary; after it comes the body. answered
    says whether there is such a line; a reader of rulings wants only those. Records without subject, summary and body are left out.
    """
    lines = F.col("lines")
    marks = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+", "").startswith("## resposta"))
    at = F.array_position(marks, True)
    head = F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0)))).otherwise(lines)
    head = F.filter(head, lambda x: ~F.regexp_replace(x, r"^\s+", "").startswith("## pergunta"))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    label = lambda k: rf"^\s*{k}\s*:"
    get = lambda k: F.coalesce(F.try_element_at(F.transform(F.filter(head, lambda x: x.rlike(label(k))), lambda x: strip(F.regexp_replace(x, label(k), ""))), F.lit(-1)), F.lit(""))
    rest = F.filter(head, lambda x: ~x.rlike(label("(descricao|assunto|link)")))
    summary = strip(F.array_join(F.transform(rest, lambda x: F.when(x.rlike(label("resumo")), strip(F.regexp_replace(x, label("resumo"), ""))).otherwise(F.regexp_replace(x, r"\s+$", ""))), "\n"))
    body = F.when(at > 0, strip(F.array_join(F.slice(lines, at.cast("int") + 1, F.size(lines)), "\n"))).otherwise("")
    rows = read_records(spark, path).select("file", "n", *[get(k).alias(k) for k in ("descricao", "assunto", "link")], summary.alias("resumo"), body.alias("corpo"), (at > 0).alias("answered"))
    return rows.filter(F.concat("assunto", "resumo", "corpo") != "")
