"""Substring dedup: what repeats across documents, by MinHash banding of paragraphs and by runs of words inside them.

A paragraph is a line; paragraphs with the same lower-case words are one node. Bands and rows are tuned for recall: the cheapest
(b, r) that finds a pair at the threshold with probability RECALL; every paragraph with a word is banded. Colliding nodes are
linked as in linking, verified by the exact Jaccard similarity of their shingles, and clustered by components. A class
with paragraphs in two documents or more is a repeat.

A passage may also sit inside longer paragraphs, or run over several. Of each document's windows of RUN words, the one of smallest
hash among NEAR neighbours is a mark, so every run of RUN + NEAR - 1 words that two documents share has a mark in common. A marked
window in two documents or more is a repeat.

The first occurrence of a class or mark (by document, position) stays and the others are removed. Repeats of a document that touch or
overlap are one passage. Passages under least_words words are left alone: stock lines such as "Read more." repeat
everywhere and do not make a document a copy.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import frugal, stash, write_table
from tessera.llm.linking import crowded, link
from tessera.llm.near_dedup import GOLD, hashes, shingles, spelled
from tessera.llm.segments import PAD, Numbers

LEAST, RECALL, RUN, NEAR, LEAST_WORDS, SHINGLE = 0.8, 0.98, 20, 16, 20, 5
WORD = re.compile(r"\w+")
#: Odd bases of the two polynomials over word hashes; together they are a hash of 128 bits.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def tune(least: float = LEAST, recall: float = RECALL, low: float = 0.3, chance: float = 0.35) -> tuple[int, int]:
    """The (bands, rows) of fewest bands with recall at the threshold and at most chance of colliding at low similarity."""
    fit = [(b, -r) for r in range(1, 9) for b in range(1, 65) if 1 - (1 - least**r) ** b >= recall and 1 - (1 - low**r) ** b <= chance]
    b, r = min(fit)
    return b, -r


@functools.lru_cache(maxsize=1)
def word_marks() -> np.ndarray:
    """Whether a code point belongs to a word, as in WORD."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


@functools.lru_cache(maxsize=64)
def powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of an odd base and of its inverse, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * GOLD
    return (x ^ (x >> np.uint64(29))) * GOLD


def word_hashes(buffer: bytes) -> np.ndarray:
    """64-bit hashes of the words of a buffer, which blanks part; it begins with one and ends with PAD of them.

    Of words of up to 16 bytes, each distinct one is hashed once; equal ones are found all together, by their bytes and length.
    """
    inside = np.frombuffer(buffer, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    low, high = Numbers.keys(buffer, start, size)
    key = mix(mix(low + size.astype(np.uint64) * np.uint64(BASES[1])) + high * np.uint64(BASES[0]))
    _, lead, back = np.unique(key, return_index=True, return_inverse=True)
    of = lambda at: hashes([buffer[a : a + n] for a, n in zip(start[at].tolist(), size[at].tolist())])
    out, first = of(lead)[back], lead[back]
    other = np.flatnonzero((size > 16) | (size != size[first]) | (low != low[first]) | (high != high[first]))
    if len(other):
        out[other] = of(other)
    return out


class Hasher:
    """64-bit hashes of the words of texts (with fold: of each word's lower case)."""

    def __init__(self, fold: bool = False) -> None:
        self.fold = fold

    def spelled(self, text: str) -> bytes:
        """The lower case of a whole text is that of its words, but for two letters; with fold a word counts by itself."""
        if self.fold and ("İ" in text or "Σ" in text):
            return " ".join(w.lower() for w in WORD.findall(text)).encode("utf-8", "surrogatepass")
        return spelled(text)

    def words(self, text: str) -> list[bytes]:
        return self.spelled(text).split()

    def texts(self, texts: list[str]) -> np.ndarray:
        return word_hashes(b" ".join([b"", *map(self.spelled, texts), b" " * PAD]))


@dataclass
class Words:
    """The words of texts one after another.

    Spans in code points of their text, polynomials of the lower-case hashes, the text and line of each word, and the words (from, to) of
    each line that has some.
    """

    start: np.ndarray
    end: np.ndarray
    sums: tuple[np.ndarray, np.ndarray]
    text: np.ndarray
    origin: np.ndarray  # the first word of each word's text
    line: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def spans(self, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
        """64-bit hashes of the words a to b (exclusive)."""
        size = max(10, int(len(self.start)).bit_length())
        back = powers(BASES[which], size)[1]
        return mix((self.sums[which][b] - self.sums[which][a]) * back[a] + (b - a).astype(np.uint64))


def read(texts: list[str], hasher: Hasher) -> Words:
    """hasher: one with fold, so that a word counts by its lower case. Texts are read together, each ended by a line end."""
    whole = "\n".join([*texts, ""])
    if whole.isascii():
        codes = np.frombuffer(whole.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_marks().take(codes)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the last code is a line end
    edges = np.append(0, edges) if len(inside) and inside[0] else edges
    start, end = edges[::2], edges[1::2]
    h = hasher.texts(texts)
    size = max(10, int(len(h)).bit_length())
    sums = tuple(np.concatenate([np.zeros(1, np.uint64), np.cumsum((h if k == 0 else mix(h)) * powers(BASES[k], size)[0][: len(h)], dtype=np.uint64)]) for k in (0, 1))
    ends = np.searchsorted(start, np.flatnonzero(codes == 10))  # words before each line end
    line = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    first = np.flatnonzero(np.diff(line, prepend=-1))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    origin = np.searchsorted(start, begin[:-1])
    text = np.repeat(np.arange(len(texts)), np.diff(origin, append=len(start)))
    return Words(start - begin[text], end - begin[text], sums, text, origin[text], line, first, np.append(first[1:], len(start)) if len(start) else first)


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in lists of about most characters: the row of the first text, and the texts."""
    at, held, size = 0, [], 0
    for k, t in enumerate(batch.column(column)):
        held.append(t.as_py())
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def line_shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, shingle), distinct and ascending by line, of the lines with words; a short line is one shingle."""
    at = np.arange(max(0, len(w.start) - SHINGLE + 1))
    at = at[w.line[at] == w.line[at + SHINGLE - 1]]
    short = np.flatnonzero(w.last - w.first < SHINGLE)
    index = np.repeat(np.arange(len(w.first)), w.last - w.first)
    line = np.concatenate([index[at], short])
    shingle = np.concatenate([w.spans(at, at + SHINGLE, 0), w.spans(w.first[short], w.last[short], 0)])
    order = np.argsort(line, kind="stable")  # two ascending runs
    line, shingle = line[order], shingle[order]
    mixed = mix(shingle + line.astype(np.uint64) * GOLD)
    ranked = np.sort(mixed)
    again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(again):  # few lines have a shingle twice
        some = np.flatnonzero(np.isin(mixed, again))
        some = some[np.lexsort((shingle[some], line[some]))]
        keep = np.ones(len(line), bool)
        keep[some[1:][(line[some[1:]] == line[some[:-1]]) & (shingle[some[1:]] == shingle[some[:-1]])]] = False
        line, shingle = line[keep], shingle[keep]
    return line, shingle


def marks(w: Words, run: int = RUN, near: int = NEAR) -> np.ndarray:
    """The first words of the marked windows; a window lies in one text, and near a text's ends neighbours are fewer."""
    n = len(w.start) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    inside = w.text[at] == w.text[at + run - 1]
    none = np.iinfo(np.uint64).max
    pad = np.full(near - 1, none, np.uint64)
    h = np.concatenate([pad, np.where(inside, np.minimum(w.spans(at, at + run, 0), none - np.uint64(1)), none), pad])
    found, block = [], 1 << 16  # bounded memory for long texts
    for k in range(0, len(h) - near + 1, block):
        view = np.lib.stride_tricks.sliding_window_view(h[k : min(len(h), k + block + near - 1)], near)
        found.append(np.unique(k + np.arange(len(view)) + view.argmin(axis=1)))
    out = np.unique(np.concatenate(found)) - (near - 1)
    out = out[(out >= 0) & (out < n)]
    return out[inside[out]]


def binary(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """16 bytes a row."""
    both = np.stack([high, low], axis=1).astype("<u8")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def paragraphs(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, version, w0, w1, start, end, node, weight, keys) of every line with words.

    node: 128-bit hash of its lower-case words; weight: its distinct shingles; keys: a MinHash key a band; version: a hash of the
    text, since a doc_id may have several.
    """
    names = ["doc_id", "version", "w0", "w1", "start", "end", "node", "weight", "keys"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        odd = np.random.default_rng(7).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for row, texts in parts(batch, 2):
                w = read(texts, hasher)
                n = len(w.first)
                if not n:
                    continue
                line, shingle = line_shingles(w)
                cuts = np.searchsorted(line, np.arange(n))
                low = np.stack([np.minimum.reduceat(shingle * o, cuts) for o in odd], axis=1).reshape(n, bands, rows)
                key = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
                for r in range(rows):
                    key = (key ^ (key >> np.uint64(29))) * GOLD + low[:, :, r]
                node = binary(w.spans(w.first, w.last, 0), w.spans(w.first, w.last, 1))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.ravel().view(np.int64)))
                owner = pa.array(row + w.text[w.first])
                place = [w.first - w.origin[w.first], w.last - w.origin[w.first], w.start[w.first], w.end[w.last - 1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *(pa.array(x.astype(np.int32)) for x in place), node, pa.array(np.bincount(line, minlength=n).astype(float)), keys], names=names)

    return docs.mapInArrow(run, "doc_id long, version int, w0 int, w1 int, start int, end int, node binary, weight double, keys array<long>")


def windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, version, w0, start, end) of the marked windows."""
    names = ["h1", "h2", "doc_id", "version", "w0", "start", "end"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        for batch in batches:
            for row, texts in parts(batch, 2):
                w = read(texts, hasher)
                at = marks(w)
                owner = pa.array(row + w.text[at])
                place = [at - w.origin[at], w.start[at], w.end[at + RUN - 1]]
                yield pa.RecordBatch.from_arrays([*(pa.array(w.spans(at, at + RUN, k).view(np.int64)) for k in (0, 1)), batch.column(0).take(owner), batch.column(1).take(owner), *(pa.array(x.astype(np.int32)) for x in place)], names=names)

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, version int, w0 int, start int, end int")


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of nodes (doc_id, version, start, end, id), each cut from its own document; no other text is looked at."""
    spans = nodes.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end", "id")).alias("spans"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, spans in zip(batch.column(0), batch.column(1)):
                t, found = text.as_py(), spans.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([x["id"] for x in found], pa.binary()), pa.array([t[x["start"] : x["end"]] for x in found], pa.string())], names=["id", "text"])

    # a row that is there twice gives the same text
    return docs.join(spans, ["doc_id", "version"]).select("text", "spans").mapInArrow(run, "id binary, text string").groupBy("id").agg(F.min("text").alias("text"))


def verify_jaccard(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                sx, sy = (shingles(hasher.words(t.as_py()), SHINGLE)[0] for t in (x, y))
                both = len(np.intersect1d(sx, sy, assume_unique=True))
                keep.append(both >= least * (len(sx) + len(sy) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def shingled(texts: DataFrame) -> DataFrame:
    """(id, shingle, w): the distinct shingles of texts (id, text), of weight 1."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        for batch in batches:
            found = [shingles(hasher.words(t.as_py()), SHINGLE)[0] for t in batch.column(1)]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.ones(len(owner)))], names=["id", "shingle", "w"])

    return texts.select("id", "text").mapInArrow(run, "id binary, shingle long, w double")


def repeated_lines(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, version, w0, w1, start, end, class_id, first) of the lines whose class has two documents; first: its first (doc_id, w0)."""
    units = write_table(paragraphs(docs, *tune(least)), "sub-lines")
    place = F.struct("doc_id", "w0", "version", "start", "end")
    nodes = units.groupBy("node").agg(F.max("doc_id").alias("high"), F.min(place).alias("at"), F.first("weight").alias("weight"), F.first("keys").alias("keys"))
    nodes = write_table(nodes.select("node", F.col("at.doc_id").alias("low"), "high", F.struct("at.doc_id", "at.w0").alias("first"), "at", "weight", "keys"), "sub-nodes")
    members = crowded(nodes.select(F.col("node").alias("id"), "weight", F.explode(F.array_distinct("keys")).alias("key")))
    wanted = nodes.select(F.col("node").alias("id"), "at").join(members.select("id").distinct(), "id", "left_semi")
    texts = write_table(node_texts(docs, wanted.select("at.doc_id", "at.version", "at.start", "at.end", "id")), "sub-texts")
    _, classes = link(members, lambda pairs: verify_jaccard(pairs, texts, least), least, lambda ids: shingled(texts.join(ids, "id", "left_semi")))
    named = nodes.select("node", "low", "high", "first").join(classes.withColumnsRenamed({"id": "node", "component": "class_id"}), "node", "left")
    linked = named.filter(F.col("class_id").isNotNull())
    shared = linked.groupBy("class_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")).filter("low <> high")
    same = named.filter(F.col("class_id").isNull() & (F.col("low") != F.col("high"))).select("node", F.col("node").alias("class_id"), "first")
    found = same.unionByName(linked.select("node", "class_id").join(shared.select("class_id", "first"), "class_id"))
    return units.select("doc_id", "version", "w0", "w1", "start", "end", "node").join(write_table(found, "sub-classes"), "node").drop("node")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """The same columns for the marked windows that two documents have.

    The windows are dealt by their hash once: both uses of the shuffle need the whole place, so Spark keeps them alike and reuses it.
    """
    dealt = windows(docs).select("h1", "h2", F.struct("doc_id", "w0", "version", "start", "end").alias("place")).repartition("h1", "h2")
    shared = dealt.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("most")).filter("first.doc_id <> most.doc_id")
    hits = dealt.join(shared.select("h1", "h2", F.struct("first.doc_id", "first.w0").alias("first")), ["h1", "h2"])
    mark = F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))).alias("class_id")
    return hits.select("place.doc_id", "place.version", "place.w0", (F.col("place.w0") + RUN).alias("w1"), "place.start", "place.end", mark, "first")


def repeated_passages(docs: DataFrame, least: float = LEAST, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row a repeated passage: doc_id, start, end (code points), words, removed_words, classes, class_id, source_doc_id and spans.

    class_id and source_doc_id are the class (or mark) of the passage's first repeat and the document of its first occurrence; passages with a
    class_id in common are linked. removed_words counts the words that occur before elsewhere; spans has the starts and ends of what is
    removed. A null text is empty and has none; rows with a null doc_id take no part; a document that is there twice repeats nothing (a
    repeat needs two values of doc_id), and texts that share a doc_id have passages of their own. An empty table gives
    none; other columns of docs are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("doc_id is not null")
    docs = docs.select("doc_id", F.hash("text").alias("version"), "text")
    hits = repeated_lines(docs, least).unionByName(repeated_runs(docs))
    hits = hits.withColumn("again", F.struct("doc_id", "w0") != F.col("first"))
    hits = write_table(hits.select("doc_id", "version", "w0", "w1", "start", "end", "again", "class_id", F.col("first.doc_id").alias("source_doc_id")), "sub-hits")
    order = Window.partitionBy("doc_id", "version").orderBy("w0", F.desc("w1"), "class_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    again = lambda c: F.when(F.col("again"), F.col(c))
    rows = hits.withColumns({"seen": F.max("w1").over(before), "gone": F.max(again("w1")).over(before), "gone_end": F.max(again("end")).over(before)})
    rows = rows.withColumn("run", F.sum(F.when(F.col("w0") > F.coalesce("seen", F.lit(-1)), 1).otherwise(0)).over(order))
    more = lambda to: F.greatest(F.lit(0), F.col("w1") - F.greatest("w0", F.coalesce(to, F.lit(0))))
    cut = F.when(F.col("again") & (more("gone") > 0), F.struct(F.when(F.col("w0") < F.col("gone"), F.col("gone_end")).otherwise(F.col("start")).alias("start"), "end"))
    rows = rows.withColumns({"new": more("seen"), "lost": F.when(F.col("again"), more("gone")).otherwise(0), "cut": cut})
    ahead = F.struct("w0", -F.col("w1"), "class_id", "source_doc_id")
    found = rows.groupBy("doc_id", "version", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("new").alias("words"), F.sum("lost").alias("removed_words"), F.count_distinct("class_id").alias("classes"), F.min(ahead).alias("ahead"), F.array_sort(F.collect_list("cut")).alias("spans"))
    return found.filter(F.col("words") >= least_words).select("doc_id", "start", "end", "words", "removed_words", "classes", F.lower(F.hex("ahead.class_id")).alias("class_id"), "ahead.source_doc_id", "spans", "version")


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs without the later occurrences in passages; every column and row stays, only texts change."""
    own, others = stash(docs, ["doc_id", "text"])
    own = own.withColumn("version", F.hash(F.coalesce("text", F.lit(""))))
    spans = passages.distinct().select("doc_id", "version", F.explode("spans").alias("s")).groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    cuts = F.aggregate("spans", F.struct(F.lit("").alias("s"), F.lit(0).alias("p")), lambda acc, x: F.struct(F.concat(acc.s, F.substring(F.col("text"), acc.p + 1, x.start - acc.p)).alias("s"), x.end.alias("p")))
    rest = F.concat(cuts.s, F.substring(F.col("text"), cuts.p + 1, F.char_length("text")))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest)
    return own.join(spans, ["doc_id", "version"], "left").select("doc_id", text.alias("text"), *others).select(docs.columns)


def op7(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs).drop("spans", "version")
