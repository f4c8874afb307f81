"""Language-model scoring by a subword lattice.

The pieces are those of an existing vocabulary file. A word is the mark of a word's start and its characters; every way to cut
it into pieces counts, weighted by the product of the pieces' probabilities, and a forward recursion in log space sums them.
Pieces never cross words, so a text's probability is the product of its words' and of one end piece: the lattice is
run once for each distinct word, and words are joined back to documents (frequent ones by a broadcast of bounded size, the
others by a shuffle). Characters that are no piece are spelled by the vocabulary's 256 byte pieces, so no text has
probability 0.

The file at hand was made for BPE: its scores are ranks of merges. They give the first weights (1 / rank); expectation
maximisation over the distinct words of the training documents then re-estimates all pieces.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, write_table

START, END = "▁", "\n"
#: Bound of broadcast words and of their characters; distinct words held by a task; iterations; cells of one lattice batch.
HEAD, HEAD_CHARS, FLUSH, ROUNDS, CELLS = 1 << 17, 40, 200_000, 2, 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Pieces in a hash table, so that all substrings of a batch of words are looked up at once. Piece 0 is the end."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, ranks, self.byte = [END], [1.0], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = len(self.pieces)
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or START in piece[1:]:
                continue
            self.pieces.append(piece)
            ranks.append(1.0 if sp.is_byte(i) else 1.0 / (2.0 - sp.get_score(i)))
        ranks[0] = max(ranks)
        self.first = np.log(np.array(ranks) / sum(ranks))
        plain = [(i, p) for i, p in enumerate(self.pieces) if i and i not in set(self.byte.values())]
        self.longest = max(len(p) for _, p in plain)
        self.size = 1 << 20
        self.keys, self.ids, self.tries = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int32), 1
        for i, p in plain:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for ch in p:
                    h = h * MULT + np.uint64(ord(ch) + 1)
            at, tries = int(_slot(np.array([h]))[0]), 1
            while self.ids[at] >= 0:
                at, tries = (at + 1) % self.size, tries + 1
            self.keys[at], self.ids[at], self.tries = h, i, max(self.tries, tries)

    def look(self, h: np.ndarray) -> np.ndarray:
        at = _slot(h)
        found = np.where(self.keys[at] == h, self.ids[at], -1)
        for k in range(1, self.tries):
            miss = np.flatnonzero(found < 0)
            more = (at[miss] + k) % self.size
            found[miss] = np.where(self.keys[more] == h[miss], self.ids[more], -1)
        return found

    def run(self, words: list[str], log_p: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of words; with counts, adds the expected number of each piece to expected."""
        out, groups = np.zeros(len(words)), defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w) + 1 if w != END else 0].append(i)
        for m, every in groups.items():
            step = max(1, CELLS // ((m + 1) * self.longest))
            for at in range(0, len(every), step):
                take = np.array(every[at : at + step])
                if m == 0:
                    out[take] = log_p[0]
                    if expected is not None:
                        expected[0] += counts[take].sum()
                else:
                    self._same_length([words[i] for i in take], m, log_p, out, take, counts, expected)
        return out

    def _same_length(self, words, m, log_p, out, take, counts, expected) -> None:
        n, longest = len(words), min(m, self.longest)
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, m).T.astype(np.uint64) + np.uint64(1)
        found = np.full((longest, m, n), -1, np.int32)  # [l - 1, j - 1]: the piece of length l that ends at j
        h = codes
        found[0] = self.look(h.ravel()).reshape(h.shape)
        for l in range(2, longest + 1):
            h = h[:-1] * MULT + codes[l - 1 :]
            found[l - 1, l - 1 :] = self.look(h.ravel()).reshape(h.shape)
        cost = np.where(found >= 0, log_p[found], -np.inf)
        spell = np.argwhere(found[0] < 0)  # characters that are no piece are spelled in bytes
        for j, k in spell:
            cost[0, j, k] = sum(log_p[self.byte[b]] for b in chr(int(codes[j, k]) - 1).encode("utf-8", "surrogatepass"))
        forward = np.zeros((m + 1, n))
        for j in range(1, m + 1):
            forward[j] = _log_sum([cost[l - 1, j - 1] + forward[j - l] for l in range(1, min(j, longest) + 1)])
        out[take] = forward[m]
        if expected is None:
            return
        backward = np.full((m + 1, n), 0.0)
        for i in range(m - 1, -1, -1):
            backward[i] = _log_sum([cost[l - 1, i + l - 1] + backward[i + l] for l in range(1, min(m - i, longest) + 1)])
        weight = counts[take]
        for l in range(1, longest + 1):
            post = np.exp(forward[: m - l + 1] + cost[l - 1, l - 1 :] + backward[l:] - forward[m]) * weight
            ids, has = found[l - 1, l - 1 :], found[l - 1, l - 1 :] >= 0
            expected += np.bincount(ids[has], post[has], len(expected))
            if l == 1:
                for j, k in spell:
                    for b in chr(int(codes[j, k]) - 1).encode("utf-8", "surrogatepass"):
                        expected[self.byte[b]] += post[j, k]


def _slot(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * MULT) >> np.uint64(44)).astype(np.int64)


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    x = np.stack(terms)
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def tokens(text: str | None) -> list[bytes]:
    """Words without ASCII white space, A-Z lowered, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b"\n"]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (in all documents), c (in training documents) of (held_out, text); the end is the word \\n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, train = Counter(), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in every], pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([train[w] for w in every], pa.int64())], names=["word", "n", "c"])

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = tokens(text.as_py())
                every.update(found)
                if not held:
                    train.update(found)
                if len(every) >= FLUSH:
                    yield out()
                    every, train = Counter(), Counter()
        if every:
            yield out()

    return docs.mapInArrow(count, "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def train_pieces(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, by expectation maximisation over the words' training counts."""
    spark, log_p = words.sparkSession, lattice(path).first
    learn = words.filter("c > 0").select("word", "c")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = lattice(path)
            expected = np.zeros(len(net.pieces))
            for batch in batches:
                net.run(batch.column(0).to_pylist(), sent.value, batch.column(1).to_numpy(zero_copy_only=False).astype(float), expected)
            at = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(expected[at])], names=["piece", "e"])

        got = learn.mapInArrow(expect, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()  # a row a piece at most
        expected = np.full(len(log_p), 0.5)
        expected[got["piece"].to_numpy(np.int64)] += got["e"].to_numpy(float)
        log_p = np.log(expected / expected.sum())
    return log_p


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, held_out, text) with n_tokens, n_known, train_tokens, base_score and score, both log10.

    Learns from rows that are not held out. A null text is the empty text (the end alone); rows may repeat; other columns
    are left out. Without training documents every token is unknown and the pieces keep the file's weights.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "held_out", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = write_table(word_counts(docs.select("held_out", "text")), "lm-counts")
    log_p = train_pieces(counted, path)
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    known, floor = int(total["c"]), known_floor(int(total["c"]), int(total["v"]))
    sent = spark.sparkContext.broadcast(log_p)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = lattice(path)
        for batch in batches:
            lp = net.run(batch.column(0).to_pylist(), sent.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp)], names=["word", "n", "c", "lp"])

    words = write_table(counted.mapInArrow(price, "word string, n long, c long, lp double"), "lm-words")
    cut = head_cut(words)
    frequent = (F.floor(F.log2("n") * 4) >= F.lit(cut)) & (F.char_length("word") <= HEAD_CHARS)
    rows = words.filter(frequent).select("word", "c", "lp").collect() if cut < math.inf else []
    near = {r["word"].encode("utf-8", "surrogatepass"): i for i, r in enumerate(rows)}
    shared = spark.sparkContext.broadcast((near, np.array([r["c"] for r in rows], float), np.array([r["lp"] for r in rows], float)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, c, lp = shared.value
        base = np.log10(c + 0.5) + floor if len(c) else c
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, k, b, s, far = [], [], [], [], []
                for text in part.column(3).to_pylist():
                    ws = tokens(text)
                    found = [near.get(w, -1) for w in ws]
                    i = np.array(found)
                    far.append([w.decode("utf-8", "surrogatepass") for w, f in zip(ws, found) if f < 0])
                    i = i[i >= 0]
                    n.append(len(ws)), k.append(int((c[i] > 0).sum())), b.append(float(base[i].sum())), s.append(float(lp[i].sum()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64()), pa.array(far, pa.list_(pa.string()))], names=["doc_id", "held_out", "tkey", "n_tokens", "k", "b", "s", "far"])

    keyed = docs.select("doc_id", "held_out", F.xxhash64("text").alias("tkey"), "text")
    part = write_table(keyed.mapInArrow(local, "doc_id long, held_out boolean, tkey long, n_tokens long, k long, b double, s double, far array<string>"), "lm-part")
    rare = part.select("doc_id", "tkey", F.posexplode("far").alias("at", "word")).join(words.filter(~frequent).select("word", "c", "lp"), "word")
    base = F.log10(F.col("c") + 0.5) + F.lit(floor)
    # rows that repeat (the same doc_id and text) add up together, so sums are divided by their number
    rare = rare.groupBy("doc_id", "tkey").agg(F.sum((F.col("at") == 0).cast("long")).alias("copies"), F.sum((F.col("c") > 0).cast("long")).alias("fk"), F.sum(base).alias("fb"), F.sum("lp").alias("fs"))
    far = [(F.coalesce(F.col(x), F.lit(0)) / F.coalesce(F.col("copies"), F.lit(1))).alias(x) for x in ("fk", "fb", "fs")]
    rows = part.drop("far").alias("p").join(rare.alias("r"), F.col("p.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("p.tkey") == F.col("r.tkey")), "left")
    rows = rows.select("p.doc_id", "held_out", "n_tokens", "k", "b", "s", *far)
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("k") + F.round("fk")).cast("long").alias("n_known"), F.lit(known).cast("long").alias("train_tokens"), (F.col("b") + F.col("fb")).alias("base_score"), (F.col("s") + F.col("fs")).alias("score"))


def known_floor(total: int, distinct: int) -> float:
    """log10 of what a count plus 0.5 is divided by."""
    return -math.log10(total + 0.5 * (distinct + 1))


def head_cut(words: DataFrame, bound: int = HEAD) -> float:
    """The level (4 log2 n) from which words are broadcast: at most bound words reach it."""
    rows = words.filter(F.char_length("word") <= HEAD_CHARS).groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    cut, total = math.inf, 0
    for r in sorted(rows, key=lambda r: -r["level"]):
        total += r["words"]
        if total > bound:
            break
        cut = r["level"]
    return float(cut)


def op4(docs: DataFrame, path: str) -> DataFrame:
    return score_documents(docs.select("doc_id", held_out(1).alias("held_out"), "text"), path)
