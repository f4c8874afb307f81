"""HTML extraction by a site style tree.

Pages of a host are merged into one tree: a node is a path of block elements (tag, and class or id where there is one). A node's
presentation is the sequence of its block children, its content the text of its own blocks; over the pages of a host both are
distributions, and the entropy of a distribution, divided by its largest value log m, is the node's importance (the larger of both).
A branch is as important as the most important of its nodes, so a branch goes where all its nodes are low, and a low node keeps what is
important below it. Menus and notices repeat on a site, articles don't. The same tree over all hosts gives a second importance; the
smaller one counts. A tree says something from LEAST_SEEN occurrences of a node on; below, it has importance 1.

Names go before entropy, because menus and adverts that differ from page to page have a high entropy: elements for menus, footers, forms
and the like, and elements with a class, id or role that says so as a whole, have importance 0 with all they hold, but never html, body,
main or article. In an article or main element only what has a class, id or role of its own enters the tree; plain text stays. From each
page, branches below KEEP go.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import write_table

KEEP, LEAST_SEEN = 0.4, 5
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|[^<]+|<""", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Elements by what they are.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg object select".split())
ENDS = set("script style textarea title noscript iframe".split())  # without an end tag the rest of the page is inside; other raw elements are then left out alone
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = set("aside button dialog fieldset footer form head header menu nav".split())
NOISE_NAMES = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that say nothing beside a name of noise ("site-footer"); any other word ("no-comments", "post-header") takes the vote away.
PLAIN_NAMES = set("area bar block bottom box container content global left links list main page primary right secondary section site top wrapper".split())
CONTAINERS = set("html body main article".split())
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = set("ul ol dl menu table".split())


@dataclass
class Node:
    tag: str
    path: int  # hash of the way from the root
    state: str  # what names say: noise, article (plain text of one) or nothing
    inside: bool = False  # of an article
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Block elements in the order of their starts, and blocks of text with the element that holds them."""

    nodes: list[Node]
    blocks: list[tuple[Node, str]]


def says_noise(names: str) -> bool:
    """Whether a class, id or role has a token that names noise: one name of noise at least, beside plain words only."""
    for token in names.lower().split():
        words = {w for w in re.split("[_-]+", token) if w}
        if words & NOISE_NAMES and words <= NOISE_NAMES | PLAIN_NAMES:
            return True
    return False


def read_page(text: str) -> Page:
    root = Node("", 0, "")
    nodes, blocks, stack, buffer = [root], [], [root], []
    holders, opened = [root], Counter()  # open block elements, and how many elements of a tag are open
    at, size = 0, len(text)

    def flush() -> None:
        if buffer:
            if words := " ".join(entities.unescape("".join(buffer)).split()):
                blocks.append((holders[-1], words))
            buffer.clear()

    def close(upto: int) -> None:
        for n in stack[upto:]:
            opened[n.tag] -= 1
            if n.tag in BLOCK:
                holders.pop()
        del stack[upto:]

    def last(tag: str) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if opened[tag] else 0

    while at < size:
        m = TOKEN.match(text, at)
        at = m.end()
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                buffer.append(m[0])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                buffer.append(" ")
            elif (k := last(tag)) and (tag in BLOCK or all(n.tag not in BLOCK for n in stack[k + 1 :])):
                if tag in BLOCK:
                    flush()
                close(k)
            continue
        if tag in RAW:
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else size if tag in ENDS else at
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                buffer.append(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P and (k := last("p")):
            flush()
            close(k)
        if tag in SAME_LEVEL and any(opened[t] for t in SAME_LEVEL[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in LISTS:
                    break
                if stack[i].tag in SAME_LEVEL[tag]:
                    flush()
                    close(i)
                    break
        opened[tag] += 1
        if tag not in BLOCK:
            stack.append(Node(tag, 0, ""))
            continue
        flush()
        over = holders[-1]
        names = " ".join("".join(g) for g in NAMED.findall(m[3]))
        key = tag + "".join(f".{w}" for w in sorted(set(names.lower().split())))
        state, inside = over.state, over.inside
        if state != "noise":
            if tag not in CONTAINERS and ((tag in NOISE and not (inside and tag == "header")) or says_noise(names)):
                state = "noise"
            elif tag in ("article", "main"):
                state, inside = "article", True
            elif inside and names:
                state = ""
        node = Node(tag, h(f"{over.path}/{key}"), state, inside)
        over.children.append(key)
        stack.append(node)
        holders.append(node)
        nodes.append(node)
    flush()
    return Page(nodes, blocks)


def h(text: str) -> int:
    x = xxhash.xxh3_64_intdigest(text)
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def tree_rows(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, n) of (host, html): what the nodes that no name decides look like and hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    page = read_page(text)
                    rows += [(host, n.path, 0, h(" ".join(n.children))) for n in page.nodes if not n.state]
                    rows += [(host, n.path, 1, h(words)) for n, words in page.blocks if not n.state]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64()))], names=["host", "path", "kind", "feature"])

    return pages.mapInArrow(run, "host string, path long, kind int, feature long").groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))


def importance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy over log m of each kind, the larger one; sums of n and n ln n, so hot nodes are added up before they move."""
    each = rows.groupBy(*keys, "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    entropy = F.when(F.col("m") < LEAST_SEEN, F.lit(1.0)).otherwise((F.ln("m") - F.col("s") / F.col("m")) / F.ln("m"))
    return each.groupBy(*keys).agg(F.max(entropy).alias("importance"))


def low_branches(pages: DataFrame, keep: float = KEEP) -> DataFrame:
    """(host, low): the paths of each host whose importance is below keep."""
    rows = write_table(tree_rows(pages), "sst-rows")
    every = rows.groupBy("path", "kind", "feature").agg(F.sum("n").alias("n"))
    both = importance(rows, ["host", "path"]).join(importance(every, ["path"]).withColumnRenamed("importance", "general"), "path")
    return both.filter(F.least("importance", "general") < keep).groupBy("host").agg(F.collect_set("path").alias("low"))


def extract(pages: DataFrame, keep: float = KEEP) -> DataFrame:
    """pages with text and n_chars; columns of pages with these names are replaced, all others stay, one row a row.

    A null html is the empty page, with the empty text; a null or odd url belongs to the host ''. The rules of hosts are
    written first, so that Spark sees their size and broadcasts them only while they are small; else it joins by host and
    splits a host with very many pages.
    """
    page = F.coalesce(F.col("html"), F.lit(""))
    low = write_table(low_branches(pages.select(host_of(F.col("url")).alias("host"), page.alias("html")), keep), "sst-low")

    @F.pandas_udf("string")
    def main_text(html: pd.Series, low: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(html, low):
            found = read_page(text)
            bad = set(gone) if gone is not None else set()
            out.append("\n".join(words for n, words in found.blocks if n.state == "article" or (not n.state and n.path not in bad)))
        return pd.Series(out, dtype=object)

    rows = pages.withColumn("_host", host_of(F.col("url"))).join(low.withColumnsRenamed({"host": "_host", "low": "_low"}), "_host", "left")
    return rows.withColumn("text", main_text(page, F.col("_low"))).withColumn("n_chars", F.char_length("text").cast("long")).drop("_host", "_low")


def op6(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
