"""Token ids in binary files: Simple-8b words in blocks, escapes beside them, offsets for vectorised decoding.

A word of 64 bits holds a selector in its top four bits and as many ids as fit into the other 60 at one width. An id that is
too wide leaves the marker of its place (all ones) and stands in the block's list of escapes. A file is

    magic
    of each block: its words, its escapes (unsigned 64-bit, little-endian)
    of each block: where it starts, its ids, words and escapes (4 x int64)
    of each document: doc_id, 1 if doc_id is null, ids (3 x int64)
    blocks, documents, where the block table starts (3 x int64), magic

so that any run of ids is decoded from its own blocks, and a file is written and read a block at a time.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import segments
from tessera.llm.common import shared_dir, write_table

MAGIC = b"TSIMPLE8"
#: Ids in a block; ids after which a file ends with the document; distinct segments that a worker remembers; the widest id in a word; tasks of a reading job.
BLOCK, FILE_IDS, REMEMBERED, WIDEST, TASKS = 1 << 16, 1 << 25, 1 << 20, 60, 1 << 14

# Fixed values of the coding: the ids in a word and their bits, by selector; the first two stand for runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


#: Bits of a small value, and so the bits under which it is no marker: zero alone fits into none.
_SMALL = np.array([0, *((v + 1).bit_length() for v in range(1, 1 << 16))], np.uint8)


def needs(values: np.ndarray) -> np.ndarray:
    """The bits of each value's narrowest place; all ones is the marker there, so a value has to lie below it."""
    if not len(values) or values.max() < len(_SMALL):
        return _SMALL[values]
    out, v = np.zeros(len(values), np.uint8), np.minimum(values.astype("<u8"), np.uint64((1 << 63) - 1)) + np.uint64(1)
    for step in (32, 16, 8, 4, 2, 1):
        wide = v >= np.uint64(1 << step)
        out += wide.astype(np.uint8) * np.uint8(step)
        v = np.where(wide, v >> np.uint64(step), v)
    return np.where(values == 0, 0, out + 1).astype(np.uint8)


def narrow(need: np.ndarray) -> int:
    """The widest id that stays in the words of a block: that of all ids, or of all but one in 64 where the estimate says that this is smaller."""
    sizes = np.bincount(need, minlength=65)
    usual, top = int(np.searchsorted(np.cumsum(sizes), len(need) * 63 / 64)), int(need.max(initial=1))
    if not 0 < usual < top <= WIDEST:
        return WIDEST
    # an id of the top width leaves room for 60 // top in its word, and not for 60 // usual; as an escape it costs a word of its own
    return usual if 60 // usual >= 2 * (60 // top) + 2 else WIDEST


def pack(values: np.ndarray, widest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned values; those that need more than `widest` bits (unless given, as narrow says) are escapes. The last word is filled with zeros."""
    n = len(values)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u8")
    need = needs(values)
    escaped = need > (narrow(need) if widest is None else widest)
    marks = np.flatnonzero(escaped)
    escapes = values[marks].astype("<u8")
    need[marks] = 1
    # the widest of the next 1, 2, 4, ... values, and of any other count as the widest of two such runs; beyond the end are zeros
    runs = {1: np.concatenate([need, np.zeros(256, np.uint8)])}
    for power in (2, 4, 8, 16, 32, 64, 128):
        half = runs[power // 2]
        runs[power] = np.maximum(half[: len(half) - power // 2], half[power // 2 :])
    chosen, least = np.full(n, len(COUNTS) - 1, np.uint8), int(need.min())
    for s in range(len(COUNTS) - 2, -1, -1):
        count, power = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        if BITS[s] >= least or count > n:
            np.copyto(chosen, s, where=np.maximum(runs[power][:n], runs[power][count - power : count - power + n]) <= BITS[s])
    # each place leads to the next word's; 1, 2, 4, ... words at a time
    leads, starts = np.append(np.minimum(np.arange(n) + COUNTS[chosen], n), n).astype(np.int32), np.zeros(1, np.int32)
    while starts[-1] < n:
        starts = np.concatenate([starts, leads[starts]])
        leads = leads[leads]
    starts = starts[starts < n]
    selectors = chosen[starts]
    words = selectors.astype("<u8") << np.uint64(60)
    held = np.concatenate([values.astype("<u8"), np.zeros(256, "<u8")])
    for s in range(2, len(COUNTS)):
        of = np.flatnonzero(selectors == s)
        if len(of):
            held[marks] = np.uint64((1 << int(BITS[s])) - 1)
            first, word = starts[of], np.zeros(len(of), "<u8")
            for i in range(int(COUNTS[s])):
                word |= held[first + i] << np.uint64(i * int(BITS[s]))
            words[of] |= word
    return words, escapes


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack; whole selectors at once."""
    selectors = (words >> np.uint64(60)).astype(np.intp)
    counts = COUNTS[selectors]
    begins = np.cumsum(counts) - counts
    out, marked = np.zeros(int(counts.sum()), "<u8"), np.zeros(int(counts.sum()), bool)
    for s in range(2, len(COUNTS)):
        of = np.flatnonzero(selectors == s)
        if len(of):
            full = np.uint64((1 << int(BITS[s])) - 1)
            mine, first = words[of], begins[of]
            for i in range(int(COUNTS[s])):
                ids = mine >> np.uint64(i * int(BITS[s])) & full
                out[first + i] = ids
                if len(escapes):
                    marked[first + i] = ids == full
    if len(escapes):
        out[marked] = escapes
    return out[:n]


class Writer:
    """One file, written a block at a time under a name of its own and moved to its place when it is whole."""

    def __init__(self, path: str, attempt: str) -> None:
        self.store, self.path = fs.FileSystem.from_uri(path)
        self.temporary = f"{self.path}.{attempt}"
        self.store.create_dir(self.path.rsplit("/", 1)[0])
        self.out = self.store.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at, self.blocks, self.documents = len(MAGIC), [], []
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = 0

    def add(self, ids: np.ndarray, documents: np.ndarray) -> None:
        """Ids of whole documents, whose rows are (doc_id, null, ids)."""
        self.documents.append(documents)
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            every = np.concatenate(self.held)
            whole = len(every) // BLOCK * BLOCK
            for start in range(0, whole, BLOCK):
                self.block(every[start : start + BLOCK])
            self.held, self.waiting = [every[whole:]], len(every) - whole

    def block(self, ids: np.ndarray) -> None:
        words, escapes = pack(ids)
        self.blocks.append((self.at, len(ids), len(words), len(escapes)))
        data = words.tobytes() + escapes.tobytes()
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.waiting:
            self.block(np.concatenate(self.held))
        documents = np.concatenate(self.documents) if self.documents else np.zeros((0, 3))
        self.out.write(np.array(self.blocks, "<i8").tobytes() + documents.astype("<i8").tobytes() + np.array([len(self.blocks), len(documents), self.at], "<i8").tobytes() + MAGIC)
        self.out.close()
        self.store.move(self.temporary, self.path)


class Reader:
    """A file's block and document tables, and its ids by place."""

    def __init__(self, path: str) -> None:
        store, self.path = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(self.path)
        size = self.file.size()
        tail = self.file.read_at(24 + len(MAGIC), size - 24 - len(MAGIC))
        if tail[24:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no whole file of token ids")
        blocks, documents, at = np.frombuffer(tail, "<i8", 3).tolist()
        table = self.file.read_at(32 * blocks + 24 * documents, at)
        self.blocks = np.frombuffer(table, "<i8", 4 * blocks).reshape(-1, 4)
        self.documents = np.frombuffer(table, "<i8", 3 * documents, 32 * blocks).reshape(-1, 3)
        self.before = np.concatenate([[0], np.cumsum(self.blocks[:, 1])])  # ids before each block
        self.starts = np.concatenate([[0], np.cumsum(self.documents[:, 2])])  # ids before each document

    def block(self, i: int) -> np.ndarray:
        at, n, words, escapes = self.blocks[i].tolist()
        data = np.frombuffer(self.file.read_at(8 * (words + escapes), at), "<u8")
        return unpack(data[:words], data[words:], n)

    def ids(self, first: int, count: int) -> np.ndarray:
        """count ids from place first on; only the blocks that hold them are read."""
        a, b = np.searchsorted(self.before, [first, first + count - 1], "right") - 1
        every = np.concatenate([self.block(i) for i in range(a, b + 1)]) if count else np.zeros(0, "<u8")
        return every[first - int(self.before[a]) :][:count]

    def texts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """First document, one past the last and their ids, document after document and a block or more at a time."""
        held, first, got = np.zeros(0, "<u8"), 0, 0
        parts: list[np.ndarray] = []
        for i in range(len(self.blocks)):
            parts.append(self.block(i))
            got += len(parts[-1])
            last = int(np.searchsorted(self.starts, got, "right")) - 1  # documents that are whole by now
            if last > first:
                held = np.concatenate(parts)
                size = int(self.starts[last] - self.starts[first])
                yield first, last, held[:size]
                parts, first = [held[size:]], last


class Encoder:
    """Ids of texts by the tokenizers library; each distinct segment is encoded once in a worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(128))}
        # a byte of a longer character: its own place in the alphabet, found through characters that hold it
        for c in map(chr, range(128, 0x7FF)):
            self.alphabet |= dict(zip(c.encode(), level.pre_tokenize_str(c)[0][0]))
        self.clear()

    def clear(self) -> None:
        self.table, self.used = segments.Numbers(), 0
        self.ids, self.begins, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def lists(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each; a word of plain letters is one match of the splitting pattern, and goes to the model at once."""
        for word in words:
            text = word.decode()
            letters = text[1:] if text[:1] == " " else text
            if letters.isalpha() and max(letters) < "\u0250":
                yield [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.alphabet))]
            else:
                yield self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, fresh: list[bytes]) -> None:
        lists = list(self.lists(fresh))
        n, sizes = len(self.table) - len(fresh), np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), "<u4", int(sizes.sum()))
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.begins) < len(self.table):
            self.begins, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.sizes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begins[n : n + len(sizes)], self.sizes[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)

    def uncut(self, buffer: bytes, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """starts without those inside the name of an added token, which the library finds before it splits."""
        keep = np.ones(len(starts), bool)
        for name in self.added:
            at = buffer.find(name)
            while at >= 0:
                a, b = np.searchsorted(starts, [at + 1, at + len(name)])
                keep[a:b] = np.isin(starts[a:b], bounds)
                at = buffer.find(name, at + 1)
        return starts[keep]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and how many each has."""
        if len(self.table) > REMEMBERED:
            self.clear()
        buffer, bounds = segments.join(texts)
        starts = self.uncut(buffer, segments.cut(buffer, bounds, words=True), bounds)
        numbers, fresh = self.table.number(buffer, starts, np.append(starts[1:], bounds[-1]))
        if fresh:
            self.learn(fresh)
        at, before = segments.spread(numbers, self.begins, self.sizes)
        return self.ids[at], np.diff(before[np.searchsorted(starts, bounds)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of texts of these sizes, each text followed by end_id."""
    out = np.full(len(ids) + len(sizes), end_id, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of docs (doc_id, text) to files in folder, in ascending order of doc_id, and returns the files: part, seq, path, ids, documents, first.

    ids are those of the tokenizers library without special tokens at the ends, and end_id after each document. A null text is
    empty: end_id alone. A null doc_id comes first; rows that share a doc_id follow one another in the order of a hash of
    their texts. Other columns are left out. first is the number of ids in all files before. An empty table has no file.

    Texts are dealt by ranges of doc_id (rows of one doc_id by their texts' hash, equal rows at random), so no key is a task of
    its own. A task writes its documents a block at a time; after file_ids ids the file ends with the document. A task that
    runs again writes the same files again.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = keyed.repartitionByRange("doc_id", F.xxhash64("text"), F.rand(11)).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer).encode, TaskContext.get()
        part, seq, out = task.partitionId(), 0, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "ids": [out.ids], "documents": [sum(map(len, out.documents))]})

        for batch in batches:
            for first, texts in segments.slices(batch, 1):
                ids, sizes = encode(texts)
                keys = batch.column(0).slice(first, len(texts))
                rows = np.stack([keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), sizes + 1], axis=1).astype(np.int64)
                every, at = with_end(ids, sizes, end_id), 0
                ends = np.cumsum(rows[:, 2])
                while at < len(rows):
                    if out is None:
                        path = f"{folder}/part-{part:06d}-{seq:06d}.s8b"
                        out = Writer(path, f"{task.taskAttemptId()}-{uuid.uuid4().hex}")
                    base = int(ends[at] - rows[at, 2])
                    stop = min(len(rows), int(np.searchsorted(ends, base + file_ids - out.ids)) + 1)
                    out.add(every[base : int(ends[stop - 1])], rows[at:stop])
                    at = stop
                    if out.ids >= file_ids:
                        yield done()
                        seq, out = seq + 1, None
        if out is not None:
            yield done()

    files = write_table(dealt.mapInArrow(write, "part int, seq int, path string, ids long, documents long"), "token-files")
    # ids before a part: a row a range partition, whose number is a setting; ids before a file in its part: a window of one part
    rows = files.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r["ids"] for r in rows])]).tolist()
    parts = files.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(rows, before)], "part int, before long")
    own = F.expr("coalesce(sum(ids) OVER (PARTITION BY part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return files.withColumn("own", own).join(F.broadcast(parts), "part").select("part", "seq", "path", "ids", "documents", (F.col("before") + F.col("own")).alias("first"))


def read_tokens(files: DataFrame) -> DataFrame:
    """The documents of files (path, first): doc_id, start (ids of all documents before), n_tokens, ids (32-bit little-endian). A file is read by one task, blocks in turn."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(path)
                for a, b, ids in file.texts():
                    rows, starts = file.documents[a:b], file.starts[a : b + 1]
                    offsets = ((starts - starts[0]) * 4).astype(np.int64)
                    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                    keys = pa.array(rows[:, 0], pa.int64(), mask=rows[:, 1] > 0)
                    out = pa.RecordBatch.from_arrays([keys, pa.array(first + starts[:-1]), pa.array(rows[:, 2]), blobs.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    yield from (out.slice(i, 1024) for i in range(0, len(out), 1024))

    # a task a file, or several where there are more files than a job should have tasks
    dealt = files.select("path", "first").repartitionByRange(max(1, min(files.count(), TASKS)), "first")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def read_ids(files: DataFrame, start: int, count: int) -> np.ndarray:
    """count ids from place start of the whole corpus on, from the blocks that hold them alone; what a loader of training windows asks for."""
    rows = files.filter((F.col("first") < start + count) & (F.col("first") + F.col("ids") > start)).orderBy("first").collect()
    found = []
    for r in rows:
        a, b = max(start, r["first"]), min(start + count, r["first"] + r["ids"])
        found.append(Reader(r["path"]).ids(a - r["first"], b - a))
    return np.concatenate(found) if found else np.zeros(0, "<u8")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"


def op11(docs: DataFrame, tokenizer: str) -> DataFrame:
    files = write_tokens(docs, new_folder(docs.sparkSession), tokenizer)
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
