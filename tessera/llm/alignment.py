"""Alignment of two tokenizers' tokens by segments: each distinct segment is encoded and aligned once, and joined back.

Texts are cut before blanks and line ends where neither vocabulary can merge across (both are verified when they are
loaded). Distinct segments are counted over the corpus, encoded by both tokenizers and cut into groups where tokens of both
end. How often the corpus links two ids follows from the segments' counts, and how a segment scores by that from a join over distinct
segments. Documents become lists of segment numbers: the most frequent segments (at most HEAD and HEAD_BYTES, by a histogram of
counts) are broadcast, the others are joined by a shuffle, once a document, and return to it by row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import segments
from tessera.llm.common import drop_table, frugal, give_back, joined, write_table

#: Bounds of the broadcast segments (number, bytes, longest), of the broadcast id pairs, the distinct segments that a task counts before it flushes, and the bytes of text cut at once.
HEAD, HEAD_BYTES, HEAD_LONGEST, HEAD_PAIRS, FLUSH, SLICE = 1 << 19, 1 << 26, 1024, 1 << 16, 1 << 20, 1 << 20
#: What is known of a segment, in the order of Composer's columns.
FACTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Vocabularies:
    """A: a byte-level BPE of the tokenizers library, given a blank and the text. B: a BPE of sentencepiece, which adds the blank."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        alphabet = set("".join(level.alphabet()))
        pieces = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        # a character of the byte-level alphabet is a byte; names of added tokens are no pieces
        self.a_bytes = np.array([len(p) for p in pieces])
        spelled = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = np.array([1 if self.b.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(spelled)])
        self.blank = self.b.piece_to_id("▁")
        self.verify(len(alphabet) == 256 and alphabet <= set(pieces), spelled)

    def verify(self, all_bytes: bool, spelled: list[str]) -> None:
        """That segments are encoded as in their texts: A splits before white space, no piece of B goes on from anything else to a blank or holds a line end, and both keep all bytes."""
        splitter = self.a.pre_tokenizer.__getstate__()
        if not all_bytes or self.a.normalizer is not None or b'"ByteLevel"' not in splitter or b'"use_regex":true' not in splitter or b'"add_prefix_space":false' not in splitter:
            raise ValueError("A is no plain byte-level BPE")
        plain = [p for i, p in enumerate(spelled) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in plain) or sum(map(self.b.is_byte, range(len(spelled)))) != 256 or spelled[self.blank] != "▁":
            raise ValueError("a piece of B merges across white space")

    def text(self, text: str | None) -> bytes:
        """What both encode to the same bytes, as UTF-8; else nothing. B's bytes are those of its normalised text."""
        if not text or "▁" in text or self.b.normalize(text) != "▁" + text.replace(" ", "▁"):
            return b""
        return text.encode()

    def encode(self, words: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of segments by A and B. B puts a blank before everything: it stands for a segment's own first blank, or goes again."""
        texts = [w.decode() for w in words]
        after = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for text, a, b in zip(texts, self.a.encode_batch(texts, add_special_tokens=False), after):
            yield a.ids, (b or [self.blank]) if text[0] == " " else b[1:]

    def align(self, a: list[int], b: list[int]) -> tuple[str, list[int], list[int]]:
        """The groups (a1,a2|b1;a3|b2), and the tokens of A and of B that end each."""
        out, last_a, last_b = [], [], []
        i = j = from_i = from_j = at_a = at_b = 0
        sizes_a, sizes_b = self.a_bytes[a].tolist(), self.b_bytes[b].tolist()
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += sizes_a[i]
                i += 1
            else:
                at_b += sizes_b[j]
                j += 1
            if at_a == at_b:
                out.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
                last_a.append(a[i - 1])
                last_b.append(b[j - 1])
                from_i, from_j = i, j
        return ";".join(out), last_a, last_b


@functools.lru_cache(maxsize=2)
def vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    return Vocabularies(byte_path, piece_path)


def pieces(both: Vocabularies, batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """The batch a slice at a time: row of its first text, buffer, where texts and where segments start, and where segments end."""
    for first, raw in segments.slices(batch, column, SLICE):
        texts = [b" " + t if (t := both.text(x.decode())) else b"" for x in raw]
        buffer, bounds = segments.join(texts)
        starts = segments.cut(buffer, bounds)
        yield first, buffer, bounds, starts, np.append(starts[1:], bounds[-1])


def count_segments(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(segment, n): the distinct segments of all texts that have tokens. A task counts before it sends."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, table, found = vocabularies(byte_path, piece_path), segments.Numbers(), []
        counts = np.zeros(1 << 16, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found), 20_000):
                part = found[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(counts[at : at + len(part)])], names=["segment", "n"])

        for batch in batches:
            for _, buffer, _, starts, ends in pieces(both, batch, 0):
                numbers, fresh = table.number(buffer, starts, ends)
                found += fresh
                while len(counts) < len(found):
                    counts = np.concatenate([counts, np.zeros_like(counts)])
                counts[: len(found)] += np.bincount(numbers, minlength=len(found))
                if len(found) > FLUSH:
                    yield from out()
                    table, found, counts = segments.Numbers(), [], np.zeros(1 << 16, np.int64)
        yield from out()

    return texts.mapInArrow(count, "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def align_segments(counted: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """counted with n_a, n_b, n_groups, groups, and the ids a and b that each link joins."""

    @frugal
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(byte_path, piece_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rows = []
                for a, b in both.encode(batch.column(0).to_pylist()):
                    groups, left, right = both.align(a, b)
                    rows.append((len(a), len(b), len(left), groups, left, right))
                made = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 3 + [pa.string()] + [pa.list_(pa.int32())] * 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["segment", "n", "n_a", "n_b", "n_groups", "groups", "a", "b"])

    return counted.mapInArrow(align, "segment binary, n long, n_a int, n_b int, n_groups int, groups string, a array<int>, b array<int>")


def links_of(aligned: DataFrame) -> DataFrame:
    return aligned.select("seg", "n", F.explode(F.arrays_zip("a", "b")).alias("l")).select("seg", "n", F.col("l.a").alias("a"), F.col("l.b").alias("b"))


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(a, b, pair_count, best, uses): how many links of the corpus join two ids, whether that is the most for the id of B, and in how many distinct links of segments."""
    counts = links_of(aligned).groupBy("a", "b").agg(F.sum("n").alias("pair_count"), F.count(F.lit(1)).alias("uses"))
    most = counts.groupBy("b").agg(F.max("pair_count").alias("most"))  # a row an id of B: the size of a vocabulary
    return counts.join(F.broadcast(most), "b").select("a", "b", "pair_count", (F.col("pair_count") == F.col("most")).cast("long").alias("best"), "uses")


def score_segments(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seg, n_best, count_sum). Pairs with a HEAD_PAIRS-th of all uses or more, of which there can't be more than HEAD_PAIRS, are broadcast; no other is frequent."""
    cut = (pairs.agg(F.sum("uses")).first()[0] or 0) / HEAD_PAIRS
    facts, often = pairs.drop("uses"), F.col("uses") >= cut
    near = links_of(aligned).drop("n").join(F.broadcast(pairs.filter(often).select(facts.columns)), ["a", "b"], "left")
    far = near.filter("pair_count is null").select("seg", "a", "b").join(pairs.filter(~often).select(facts.columns), ["a", "b"])
    both = near.filter("pair_count is not null").select("seg", "pair_count", "best").unionByName(far.select("seg", "pair_count", "best"))
    return both.groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("pair_count").alias("count_sum"))


def head_level(n: Column) -> Column:
    return F.floor(F.log2(n) * 4)


def head_cut(scored: DataFrame, bound: int) -> float:
    """The level of counts from which segments are broadcast. The histogram has at most 260 rows."""
    size = F.octet_length("segment") + F.octet_length("groups") + 64
    rows = scored.filter(F.octet_length("segment") <= HEAD_LONGEST).groupBy(head_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).collect()
    cut, total, held = float("inf"), 0, 0
    for r in sorted(rows, key=lambda r: -r["level"]):
        total, held = total + r["rows"], held + r["bytes"]
        if total > bound or held > HEAD_BYTES:
            break
        cut = float(r["level"])
    return cut


class Finder:
    """Numbers of the broadcast segments, most frequent first. They travel as one buffer; the table to find them is built in the worker."""

    def __init__(self, words: pa.Array) -> None:
        self.size, self.sizes = len(words), pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
        self.whole = joined(words, b"") + bytes(segments.PAD)
        self.table: segments.Numbers | None = None

    def build(self, chunk: int = 1 << 16) -> None:
        """A chunk at a time, so that little beside the table is held; the buffer goes."""
        self.table, self.rank = segments.Numbers(), np.empty(self.size, np.int32)
        bounds = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        for at in range(0, self.size, chunk):
            to = min(self.size, at + chunk)
            numbers, _ = self.table.number(self.whole, bounds[at:to], bounds[at + 1 : to + 1])
            self.rank[numbers] = np.arange(at, to, dtype=np.int32)
        self.whole, self.sizes = b"", self.sizes[:0]

    def number(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Each segment's number, and the segments beyond the broadcast ones, which are numbered from size on."""
        if self.table is None:
            self.build()
        numbers, fresh = self.table.number(buffer, starts, ends, grow=False)
        known = numbers < self.size
        numbers = numbers.astype(np.int64)
        numbers[known] = self.rank[numbers[known]]
        return numbers, fresh


class Composer:
    """Facts and groups of the broadcast segments, in the order of their numbers. The groups travel as one text."""

    def __init__(self, groups: pa.Array, facts: np.ndarray) -> None:
        self.size, self.text, self.facts = len(groups), joined(groups), facts

    @functools.cached_property
    def groups(self) -> np.ndarray:
        found = np.array([*(self.text.split("\n") if self.size else []), None], object)[:-1]
        self.text = ""
        return found


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, low bytes first, compressed: frequent segments have small ones."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) if blob else np.zeros(0, np.int64)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, head: int = HEAD) -> DataFrame:
    """A row a row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (0 without tokens) and groups ('' then).

    Texts that are null, empty, or that B changes have no tokens. Rows may repeat and doc_id may be null; repeated rows count each.
    Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    counted = align_segments(count_segments(docs.select("text"), byte_path, piece_path), byte_path, piece_path)
    aligned = write_table(counted.withColumn("seg", F.monotonically_increasing_id()), "segments")
    pairs = write_table(count_pairs(aligned), "pairs")
    scores = score_segments(aligned, pairs)
    known = aligned.select("seg", "segment", "n", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups").join(scores, "seg").drop("seg")
    scored = write_table(known.select("segment", "n", *FACTS, "groups"), "scored-segments")
    drop_table(aligned)
    drop_table(pairs)
    cut = head_cut(scored, head)
    frequent = (head_level(F.col("n")) >= F.lit(cut)) & (F.octet_length("segment") <= HEAD_LONGEST)
    columns = ["n", "segment", "groups", *FACTS]
    if cut < float("inf"):
        found = scored.filter(frequent).select(columns).toArrow().sort_by([("n", "descending"), ("segment", "ascending")])
    else:
        found = pa.table({c: pa.array([], {"segment": pa.binary(), "groups": pa.string()}.get(c, pa.int64())) for c in columns})
    # two parts, of which a stage loads one; the columns stay Arrow's until then
    finder = spark.sparkContext.broadcast(Finder(found["segment"].combine_chunks()))
    facts = np.stack([found[f].to_numpy().astype(np.int64) for f in FACTS], axis=1)
    composer = spark.sparkContext.broadcast(Composer(found["groups"].combine_chunks(), facts))
    del found, facts
    give_back()

    @frugal
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, near = vocabularies(byte_path, piece_path), finder.value
        for batch in batches:
            for first, buffer, bounds, starts, ends in pieces(both, batch, 1):
                numbers, fresh = near.number(buffer, starts, ends)
                at = np.searchsorted(starts, bounds)
                size, blobs, rare = near.size, [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    mine = numbers[a:b].copy()
                    far = np.flatnonzero(mine >= size)
                    names, where = np.unique(mine[far], return_inverse=True)
                    mine[far] = size + where
                    blobs.append(packed(mine) if len(mine) else b"")
                    rare.append([fresh[i - size] for i in names.tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(blobs)), pa.array(blobs, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=["doc_id", "packed", "rare"])

    split_docs = write_table(docs.mapInArrow(split, "doc_id long, packed binary, rare array<binary>").withColumn("row", F.monotonically_increasing_id()), "segmented")
    rare = split_docs.select("row", F.posexplode("rare").alias("at", "segment")).join(scored.filter(~frequent).drop("n"), "segment")
    filled = rare.groupBy("row").agg(F.collect_list(F.struct("at", "groups", *FACTS)).alias("fill"))
    whole = split_docs.select("row", "doc_id", "packed").join(filled, "row", "left").select("doc_id", "packed", "fill")
    names = [*FACTS, "groups"]

    @frugal
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = composer.value
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                sums, texts = np.zeros((batch.num_rows, len(FACTS)), np.int64), []
                for i, (blob, fill) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    numbers = unpacked(blob)
                    mine, groups = near.facts, near.groups
                    far = numbers >= near.size
                    text = np.empty(len(numbers), object)
                    text[~far] = groups[numbers[~far]]
                    sums[i] = mine[numbers[~far]].sum(axis=0)
                    if fill:
                        fill = sorted(fill, key=lambda x: x["at"])
                        which = numbers[far] - near.size
                        text[far] = np.array([*(x["groups"] for x in fill), None], object)[which]
                        sums[i] += np.array([[x[f] for f in FACTS] for x in fill], np.int64)[which].sum(axis=0)
                    texts.append(";".join(text.tolist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums.T.copy()), pa.array(texts, pa.string())], names=["doc_id", *names])

    return whole.mapInArrow(compose, "doc_id long, " + ", ".join(f"{f} long" for f in FACTS) + ", groups string")


def op13(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    groups = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return align_documents(docs, byte_path, piece_path).select("doc_id", *FACTS, groups.alias("groups_sha256"))
