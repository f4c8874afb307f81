"""Tables of pages as cells on a grid, and labelled headers read off the grid."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.catalog import letters

CELL = "array<struct<table: int, parent: int, row: int, col: int, rows: int, cols: int, head: boolean, paragraphs: array<string>>>"
#: Largest spans that count, as browsers have them.
MOST_COLS, MOST_ROWS = 1000, 65534
BREAKS, HIDDEN = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6"}, {"script", "style"}


class _Grid:
    """A table that is open: where its next cell goes, and how far down each column is taken by a span."""

    def __init__(self, number: int, parent: int | None) -> None:
        self.number, self.parent, self.row, self.taken, self.cell = number, parent, -1, {}, None


class _Tables(HTMLParser):
    """Cells in the order in which they open. A nested table's text is its own cells' alone."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self.open: list[_Grid] = []
        self.tables = self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(_Grid(self.tables, self.open[-1].number if self.open else None))
            self.tables += 1
        elif tag in HIDDEN:
            self.hidden += 1
        elif self.open and tag == "tr":
            self.end_cell()
            self.open[-1].row += 1
        elif self.open and tag in ("td", "th"):
            self.end_cell()
            self.start_cell(tag == "th", dict(attrs))
        elif tag == "br":
            self.text(" ")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.end_cell()
            self.close_table()
        elif tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th", "tr") and self.open:
            self.end_cell()
        elif tag == "p" and self.open and self.open[-1].cell:
            self.open[-1].cell["parts"].append("")
        elif tag in BREAKS:
            self.text(" ")

    def handle_data(self, data):
        self.text(data)

    def text(self, data: str) -> None:
        if self.open and self.open[-1].cell and not self.hidden:
            self.open[-1].cell["parts"][-1] += data

    def start_cell(self, head: bool, attrs: dict) -> None:
        grid = self.open[-1]
        grid.row = max(grid.row, 0)

        def span(name: str, most: int) -> int:
            digits = (attrs.get(name) or "").strip()
            return min(int(digits), most) if digits.isascii() and digits.isdigit() and len(digits) < 10 else 1

        cols, rows, col = max(1, span("colspan", MOST_COLS)), span("rowspan", MOST_ROWS), 0
        while grid.taken.get(col, -1) >= grid.row:
            col += 1
        rows = rows or MOST_ROWS  # 0: down to the end
        for c in range(col, col + cols):
            grid.taken[c] = max(grid.taken.get(c, -1), grid.row + rows - 1)
        grid.cell = {"table": grid.number, "parent": grid.parent, "row": grid.row, "col": col, "rows": rows, "cols": cols, "head": head, "parts": [""]}
        self.cells.append(grid.cell)

    def end_cell(self) -> None:
        self.open[-1].cell = None

    def close_table(self) -> None:
        grid = self.open.pop()
        for cell in self.cells:
            if cell["table"] == grid.number:
                cell["rows"] = min(cell["rows"], grid.row + 1 - cell["row"])

    def finish(self) -> list[dict]:
        self.close()
        while self.open:
            self.close_table()
        return [{**{k: v for k, v in c.items() if k != "parts"}, "paragraphs": [" ".join(p.split()) for p in c["parts"]]} for c in self.cells]


def grid_of(page: str | None) -> list[dict]:
    parser = _Tables()
    parser.feed(page or "")
    return parser.finish()


def cells(pages: DataFrame, key: str, source: str) -> DataFrame:
    """A row a cell: key, table (in the order of opening), parent (the table that it lies in), row, col, rows, cols (its spans), head, paragraphs, text.

    Spans push later cells aside as in a browser. A cell without </p> has one paragraph; a paragraph may be empty, so that those of
    neighbouring cells can be matched by place. text joins the others by a blank. A page without tables has no rows.
    """

    @F.pandas_udf(CELL)
    def page_cells(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series([grid_of(p) for p in x])

    found = pages.select(key, F.explode(page_cells(F.col(source))).alias("c")).select(key, "c.*")
    return found.withColumn("text", F.array_join(F.filter("paragraphs", lambda x: x != ""), " "))


def is_section(paragraph: Column) -> Column:
    """Whether a paragraph is a section's heading, however it is written."""
    return letters(paragraph).isin("ACORDAO", "RELATORIO", "VOTO", "EOVOTO", "EORELATORIO")


def labelled(found: DataFrame, key: str, label: str) -> DataFrame:
    """(key, subject, reasons): what stands beside the first cell labelled so on each page, and what follows.

    The label's paragraph k goes with the k-th paragraph of the cells to its right; the label may also open the value's own paragraph
    ("LABEL: value"). Reasons are the paragraphs after the value up to a section's heading, and those of the rows below while their first cell is
    empty. Pages without such a label have no row.
    """
    marked = F.transform("paragraphs", lambda x: letters(x) == label)
    inline = rf"(?is)^\s*({r'\W{0,3}'.join(label.lower())})\s*[:.]\s*(.+)$"
    inside = F.transform("paragraphs", lambda x: x.rlike(inline))
    to_right = Window.partitionBy(key, "table", "row").orderBy("col").rowsBetween(1, Window.unboundedFollowing)
    beside = F.flatten(F.collect_list("paragraphs").over(to_right))
    rows = found.withColumn("_right", beside).withColumn("_k", F.array_position(marked, True).cast("int")).withColumn("_in", F.array_position(inside, True).cast("int"))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, inline, "$2"), r"^\s+|\s+$", "")
    right = F.when(F.col("_k") > 0, F.try_element_at("_right", F.col("_k")))
    aligned = F.coalesce(right, F.lit("")) != ""
    mine = F.when(F.col("_in") > 0, F.element_at("paragraphs", F.col("_in")))
    after = F.when(aligned, F.slice("_right", F.col("_k") + 1, F.size("_right"))).otherwise(F.concat(F.slice("paragraphs", F.greatest(F.col("_in"), F.lit(0)) + 1, F.size("paragraphs")), "_right"))
    hits = rows.filter(aligned | (F.col("_in") > 0)).select(key, "table", "row", "col", F.when(aligned, bare(right)).otherwise(bare(bare(mine))).alias("subject"), after.alias("_after"), aligned.alias("_aligned"))
    first = hits.groupBy(key).agg(F.min_by(F.struct("table", "row", "subject", "_after", "_aligned"), F.struct("table", "row", "col")).alias("h")).select(key, "h.*")
    # rows below with an empty first cell, up to the first that has a label
    lines = found.groupBy(key, "table", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text", "paragraphs"))).alias("_cells"))
    below = lines.join(first.filter("_aligned").select(key, "table", F.col("row").alias("_from")), [key, "table"]).filter(F.col("row") > F.col("_from"))
    order = Window.partitionBy(key).orderBy("row")
    going = below.withColumn("_stop", F.max(F.when(F.col("_cells")[0]["text"] != "", 1).otherwise(0)).over(order)).filter("_stop = 0")
    more = F.flatten(F.transform(F.slice("_cells", F.lit(2), F.size("_cells")), lambda c: F.filter(c["paragraphs"], lambda x: x != "")))
    later = going.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", more.alias("more")))), lambda x: x["more"])).alias("_later"))
    stop = F.array_position(F.transform("_after", is_section), True).cast("int")
    own = F.filter(F.when(stop > 0, F.slice("_after", F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(F.col("_after")), lambda x: x != "")
    done = first.join(later, key, "left")
    return done.select(key, "subject", F.concat(own, F.coalesce("_later", F.array().cast("array<string>"))).alias("reasons"))
