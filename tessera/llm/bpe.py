"""BPE encoding and decoding through a table of distinct words.

Texts are split into words as the tokenizer file's own normaliser and splitter do; each distinct word is encoded and, by a join of its
ids to the vocabulary's table of pieces, decoded; both are joined back by position. The most frequent words (at most HEAD and
HEAD_BYTES, exact bounds kept by a histogram of counts) are broadcast and joined where the text lies. The others are dealt out by word,
so that all places of a word meet, and what it is spelled as returns to its documents by position. In between a document is one compressed
list of word numbers, followed by the words that are not broadcast; it is made once and moves once.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import frugal, give_back, joined, write_table

#: Bounds of the broadcast words (number, bytes, longest in characters), the distinct words a task counts before it flushes, buckets of words a partition, and places of a word in a row.
HEAD, HEAD_BYTES, HEAD_CHARS, FLUSH, BUCKETS, PLACES = 1 << 19, 1 << 26, 4096, 250_000, 8, 256


class Codec:
    """What a worker needs of a tokenizer file: splitting of a text, ids of a word, pieces of ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.split_any = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # for characters whose classes every Unicode version agrees on, the same pattern with those classes written out
        safe = [c for c in (*range(0x530), *range(0x2000, 0x2070)) if not 0x1C <= c <= 0x1F]  # those four are white space to Python alone
        letters, numbers = (_ranges(c for c in safe if unicodedata.category(chr(c))[0] == k) for k in "LN")
        self.unsafe = re.compile("[^" + _ranges(c for c in safe if unicodedata.category(chr(c)) != "Cn") + "]")
        self.split_safe = re.compile(self.pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"\p{L}", letters).replace(r"\p{N}", numbers))
        self.split_ascii = re.compile(self.pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = np.array([self.tokenizer.id_to_token(i) or "" for i in range(size)], object)

    def words(self, text: str) -> list[str]:
        if self.at_special is None or "<" not in text:
            return self.plain(text)
        out: list[str] = []
        for i, part in enumerate(self.at_special.split(text)):
            out += [part] if i % 2 else self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            # \x1c-\x1f are white space to Python alone
            return self.split_ascii.findall(text.lower()) if not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.library(text)
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.library(text) if self.unsafe.search(plain) else self.split_safe.findall(plain)

    def library(self, text: str) -> list[str]:
        return [x for x, _ in self.split_any.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for x, _ in self.bytes.pre_tokenize_str(word) for t in self.tokenizer.model.tokenize(x)]


def _ranges(codes) -> str:
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def word_counts(texts: DataFrame, path: str) -> DataFrame:
    """Each distinct word once: word, n (its occurrences).

    A task counts its words before they move, and sends them as one compressed list a bucket of the words' hashes. The receiving
    task has its lists in order of buckets, and holds the words of one bucket at a time.
    """
    buckets = BUCKETS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = codec(path), Counter()

        def out() -> pa.RecordBatch:
            parts: list[list[str]] = [[] for _ in range(buckets)]
            for w in seen:
                parts[zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets].append(w)
            full = [(i, sorted(ws)) for i, ws in enumerate(parts) if ws]
            lists = [zlib.compress("\n".join(ws).encode("utf-8", "surrogatepass"), 6) for _, ws in full]
            sizes = [zlib.compress(np.array([seen[w] for w in ws], "<u4").tobytes(), 6) for _, ws in full]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in full], pa.int32()), pa.array(lists, pa.binary()), pa.array(sizes, pa.binary())], names=["bucket", "words", "sizes"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(c.words(text.as_py() or ""))
                if len(seen) >= FLUSH:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    @frugal
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, Counter()

        def out() -> Iterator[pa.RecordBatch]:
            every = list(seen)
            for start in range(0, len(every), 10_000):
                part = every[start : start + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[w] for w in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            for bucket, words, sizes in zip(*(batch.column(i) for i in range(3))):
                if bucket.as_py() != at:
                    yield from out()
                    at, seen = bucket.as_py(), Counter()
                found = zlib.decompress(words.as_py()).decode("utf-8", "surrogatepass").split("\n")
                for w, n in zip(found, np.frombuffer(zlib.decompress(sizes.as_py()), "<u4").tolist()):
                    seen[w] += n
        yield from out()

    lists = texts.mapInArrow(count, "bucket int, words binary, sizes binary").repartition(buckets // BUCKETS, "bucket").sortWithinPartitions("bucket")
    return lists.mapInArrow(total, "word string, n long")


def spelled(rows: DataFrame, path: str) -> DataFrame:
    """rows (word and others; equal words one after another) as (ids, places): a word's ids once, and the others of at most PLACES of its rows."""
    others = [c for c in rows.columns if c != "word"]
    kinds = dict(rows.dtypes)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, words = batch.num_rows, batch.column(0)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            cuts = np.flatnonzero((np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))) % PLACES == 0)
            places = pa.StructArray.from_arrays(batch.columns[1:], names=others)
            ids = [c.ids(w) for w in words.take(pa.array(cuts)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(np.append(cuts, n).astype(np.int32)), places)], names=["ids", "places"])

    return rows.select("word", *others).mapInArrow(run, f"ids array<int>, places array<struct<{', '.join(f'{c}: {kinds[c]}' for c in others)}>>")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the tokenizer's vocabulary: a table of fixed size, whatever the input."""
    rows = codec(path).pieces
    return spark.createDataFrame(pa.table({"id": np.arange(len(rows), dtype=np.int32), "piece": pa.array(rows, pa.string())}))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with decoded, the pieces of the array column ids in order, joined by a blank; no ids, an empty text.

    ids become rows and are joined to the table of pieces, which is broadcast because a vocabulary has a fixed size. So the rows of
    an array stay in their task, one after another, and are gathered there without a shuffle.
    """
    others = [c for c in rows.columns if c != "ids"]
    table = F.broadcast(pieces(rows.sparkSession, path).withColumnsRenamed({"id": "_id", "piece": "_piece"}))
    spread = rows.select(*others, F.posexplode_outer("ids").alias("_at", "_id")).join(table, "_id", "left").select(*others, "_at", "_id", "_piece")

    @frugal
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(part: pa.Table) -> pa.RecordBatch:
            at = part.column("_at").to_numpy()
            starts = np.flatnonzero(~(at > 0))  # the first place, or none at all
            ends = np.append(starts[1:], len(at)).tolist()
            ids, found = part.column("_id").to_pylist(), part.column("_piece").to_pylist()
            spans = [(a, b if ids[a] is not None else a) for a, b in zip(starts.tolist(), ends)]
            first = part.select(others).take(pa.array(starts)).combine_chunks()
            columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in first.columns]
            columns += [pa.array([ids[a:b] for a, b in spans], pa.list_(pa.int32())), pa.array([" ".join(found[a:b]) for a, b in spans], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*others, "ids", "decoded"])

        for batch in batches:
            starts = np.flatnonzero(~(batch.column(len(others)).to_numpy(zero_copy_only=False) > 0))
            if len(starts):
                held.append(batch.slice(0, int(starts[-1])))
                if sum(x.num_rows for x in held):
                    yield out(pa.Table.from_batches(held))
                held = [batch.slice(int(starts[-1]))]
            else:
                held.append(batch)
        if sum(x.num_rows for x in held):
            yield out(pa.Table.from_batches(held))

    kinds = dict(rows.dtypes)
    return spread.mapInArrow(gather, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "ids array<int>", "decoded string"]))


def head_cut(words: DataFrame, bound: int = HEAD) -> float:
    """The count from which words are broadcast: at most bound words, of HEAD_BYTES with their spelling, have it. The histogram has at most 260 rows."""
    level = F.floor(F.log2("n") * 4)
    size = F.octet_length("word") * 8 + 8  # an id has a byte of the word at least, and a piece is its bytes as one or two each
    rows = words.filter(F.char_length("word") <= HEAD_CHARS).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum(size).alias("bytes")).collect()
    cut, total, held = float("inf"), 0, 0
    for r in sorted(rows, key=lambda r: -r["level"]):
        total, held = total + r["words"], held + r["bytes"]
        if total > bound or held > HEAD_BYTES:
            break
        cut = r["level"]
    return float(cut)


class Numbers:
    """Numbers of the broadcast words, most frequent first. They travel as one text."""

    def __init__(self, words: pa.Array) -> None:
        self.size, self.text = len(words), joined(words)

    def __getstate__(self) -> tuple[int, str]:
        return self.size, self.text

    def __setstate__(self, state: tuple[int, str]) -> None:
        self.size, self.text = state

    @functools.cached_property
    def number(self) -> dict[str, int]:
        found = dict(zip(self.text.split("\n"), range(self.size)))
        self.text = ""
        return found

    def of(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each word's number, and the words beyond the broadcast ones, which are numbered from size on."""
        far: dict[str, int] = {}
        size, get = self.size, self.number.get
        got = [n if (n := get(w, -1)) >= 0 else size + far.setdefault(w, len(far)) for w in words]
        return np.array(got, "<u4"), list(far)


class Spelling:
    """Ids of the broadcast words one after another, and their decoded texts. The texts travel as one."""

    def __init__(self, ids: pa.Array, texts: pa.Array, kind: np.dtype) -> None:
        self.kind = kind  # of ids, in words' bytes
        self.ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False) // kind.itemsize, dtype=np.int64)])
        self.flat = np.frombuffer(joined(ids, b""), kind).astype("<u4")
        self.size, self.joined = len(texts), joined(texts)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "texts"}

    @functools.cached_property
    def texts(self) -> np.ndarray:
        return np.array([*(self.joined.split("\n") if self.size else []), None], object)[:-1]

    def spell(self, numbers: np.ndarray, far: list[tuple[bytes, str]]) -> tuple[np.ndarray, str]:
        """The ids and the decoded text of a document."""
        size = self.size
        near = numbers < size
        mine, rest = numbers[near], numbers[~near].astype(np.int64) - size
        begin, length = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        begin[near], length[near] = self.ends[mine], self.ends[mine + 1] - self.ends[mine]
        texts = np.empty(len(numbers), object)
        texts[near] = self.texts[mine]
        source = self.flat
        if far:
            ends = np.concatenate([[0], np.cumsum([len(ids) // self.kind.itemsize for ids, _ in far], dtype=np.int64)])
            begin[~near], length[~near] = ends[rest], ends[rest + 1] - ends[rest]
            texts[~near] = np.array([t for _, t in far], object)[rest]
            source = np.frombuffer(b"".join(ids for ids, _ in far), self.kind).astype("<u4")
        total = np.cumsum(length)
        at = np.repeat(begin - total + length, length) + np.arange(int(total[-1]) if len(total) else 0)
        if far:
            among = np.repeat(near, length)
            out = np.empty(len(at), "<u4")
            out[among], out[~among] = self.flat[at[among]], source[at[~among]]
        else:
            out = source[at]
        return out, " ".join(filter(None, texts.tolist()))


def packed(numbers: np.ndarray, far: list[str] | tuple[str, ...] = ()) -> bytes:
    """Numbers byte by byte, low bytes first: frequent words have small numbers, so the high bytes compress to nothing. The words far follow."""
    words = "\n".join(far).encode("utf-8", "surrogatepass")
    return zstandard.compress(len(numbers).to_bytes(4, "little") + np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes() + words, 3)


def unpacked(blob: bytes) -> np.ndarray:
    whole = zstandard.decompress(blob) if blob else bytes(4)
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8, 4 * int.from_bytes(whole[:4], "little"), 4).reshape(4, -1).T).view("<u4").ravel()


def far_words(blob: bytes) -> list[str]:
    """The words behind the numbers."""
    whole = zstandard.decompress(blob) if blob else bytes(4)
    words = whole[4 + 4 * int.from_bytes(whole[:4], "little") :].decode("utf-8", "surrogatepass")
    return words.split("\n") if words else []


def encode_documents(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """docs (doc_id, text) with n_tokens, ids (32-bit little-endian) and decoded.

    Equal to the tokenizers library's encode(text, add_special_tokens=False) without truncation or padding, and its
    decode(ids, skip_special_tokens=False). A null text is the empty text: no ids, an empty decoded text. Rows may repeat
    and doc_id may be null: rows are matched by doc_id and a hash of the text. Other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    width = 4 if len(codec(path).pieces) < 1 << 16 else 8  # hex digits of an id
    kind = np.dtype(f">u{width // 2}")
    code = F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x), width, "0")), ""))
    words = write_table(word_counts(docs.select("text"), path), "bpe-words")
    cut = head_cut(words, head)
    found = pa.table({"n": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.string())})
    if cut < float("inf"):
        frequent = words.filter((F.floor(F.log2("n") * 4) >= F.lit(cut)) & (F.char_length("word") <= HEAD_CHARS))
        known = decode(spelled(frequent.select("word", "n", F.col("word").alias("name")), path), path)
        got = known.select(F.explode("places").alias("p"), code.alias("ids"), "decoded").select("p.n", "p.name", "ids", "decoded").toArrow()
        found = got.sort_by([("n", "descending"), ("name", "ascending")])
        del got
    # the columns stay Arrow's: a Python object for each word and spelling would be most of what the driver holds
    name, ids, decoded = (found[c].combine_chunks() for c in ("name", "ids", "decoded"))
    numbers = spark.sparkContext.broadcast(Numbers(name))
    spelling = spark.sparkContext.broadcast(Spelling(ids, decoded, kind))
    del found, name, ids, decoded
    give_back()

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, near = codec(path), numbers.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                blobs = [packed(*got) if len((got := near.of(c.words(t.as_py())))[0]) else b"" for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(blobs, pa.binary())], names=["key", "tkey", "doc_id", "packed"])

    @frugal
    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [far_words(x.as_py()) for x in batch.column(3)]
            sizes = [len(x) for x in far]
            owner = pa.array(np.repeat(np.arange(len(far)), sizes))
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(at), pa.array([w for x in far for w in x], pa.string())], names=["key", "tkey", "at", "word"])

    # documents are split once and dealt out once: both uses of the shuffle need the whole packed list, so Spark keeps them alike and reuses it.
    # A null doc_id may meet doc_id 0, as equal texts have equal gaps
    keyed = docs.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text").alias("tkey"), "doc_id", "text")
    dealt = keyed.mapInArrow(pack, "key long, tkey long, doc_id long, packed binary").repartition("key", "tkey")
    rare = dealt.mapInArrow(gaps, "key long, tkey long, at int, word string")
    # few places have a rare word, but a word that is too long to be broadcast may be anywhere: it is dealt out by its place as well
    spread = F.when(F.char_length("word") > HEAD_CHARS, F.hash("key", "tkey")).otherwise(0)
    rare = rare.withColumn("part", spread).repartition("word", "part").sortWithinPartitions("word").drop("part")
    filled = decode(spelled(rare, path), path).select(F.explode("places").alias("p"), code.alias("ids"), "decoded")
    filled = filled.groupBy("p.key", "p.tkey").agg(F.collect_set(F.struct("p.at", "ids", "decoded")).alias("fill"))
    rows = dealt.join(filled, ["key", "tkey"], "left").select("doc_id", "packed", "fill.at", "fill.ids", "fill.decoded")

    @frugal
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = spelling.value
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                counts, ids, texts = [], [], []
                for blob, at, more, spelled in zip(*(part.column(k).to_pylist() for k in range(1, 5))):
                    got, text = near.spell(unpacked(blob), [x[1:] for x in sorted(zip(at or [], more or [], spelled or []))])
                    counts.append(len(got))
                    ids.append(got.tobytes())
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(finish, "doc_id long, n_tokens long, ids binary, decoded string")


def op10(docs: DataFrame, path: str) -> DataFrame:
    done = encode_documents(docs, path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
