"""Encoding and decoding against the tokenizers library itself."""

import os
import random
import tracemalloc

import numpy as np
import pytest

from tessera.llm import bpe
from tessera.llm.common import table
from tessera.llm.queries import word_bpe

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "Hello, world! it's 3 o'clock", "naïve café ÉCOLE ΣΊΣΥΦΟΣ İstanbul", "é ẛ̣", "<|endoftext|>a<|startoftext|> b<|end", "日本語 текст עברית", "😀👩‍👩‍👧 x y z", "a\x1cb\x1fc\x85d e", "1234 ½ ² ⅷ", "don't won'T we'LL", "x" * 3000, "the cat " * 4000, "͸￾"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    t.no_truncation(), t.no_padding()
    return t


def check(rows, texts, library):
    for i, n, ids, decoded in rows:
        want = library.encode(texts[i] or "", add_special_tokens=False).ids
        assert (n, np.frombuffer(ids, "<u4").tolist()) == (len(want), want), texts[i]
        assert decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("head", [1 << 19, 8, 0])
def test_as_the_library(spark, library, head):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, word string"), word_bpe(), head)
    got = [tuple(r) for r in got.collect()]
    assert sorted(r[0] for r in got) == list(range(len(TEXTS)))
    check(got, TEXTS, library)


def test_repeated_rows_and_null_ids(spark, library):
    rows = [(1, "rare zyxwv words"), (1, "rare zyxwv words"), (None, "rare zyxwv words"), (1, "another qqxz text"), (None, None)]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), word_bpe(), 2)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded"]) for r in got.collect()) == sorted((str(i), len(e.ids), library.decode(e.ids, skip_special_tokens=False)) for i, t in rows for e in [library.encode(t or "", add_special_tokens=False)])


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), word_bpe()).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_table(spark, library):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = [tuple(r) for r in bpe.encode_documents(docs, word_bpe()).collect()]
    assert len(got) == len(texts)
    check(got, texts, library)


def test_decode_joins_ids_to_pieces(spark, library):
    rows = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)] + [(99, None)]
    got = {r["k"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), word_bpe()).collect()}
    assert got == {k: library.decode(ids or [], skip_special_tokens=False) for k, ids in rows}


def test_numbers_survive_packing():
    for x in ([], [0], [1, 255, 256, 70_000, 1 << 31], list(range(5000))):
        n = np.array(x, "<u4")
        assert bpe.unpacked(bpe.packed(n) if len(n) else b"").tolist() == x


def test_words_follow_packed_numbers():
    for far in ([], ["é"], ["a", "bc", "日本"]):
        assert bpe.far_words(bpe.packed(np.arange(3, dtype="<u4"), far)) == far
        assert bpe.unpacked(bpe.packed(np.arange(3, dtype="<u4"), far)).tolist() == [0, 1, 2]


def test_documents_are_split_once_after_counting(spark, library, tmp_path):
    """The packed lists move once, and the words beyond the broadcast ones are taken from them, not from the texts again."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "y" * 5000 + " rare") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = bpe.encode_documents(spark.read.parquet(str(tmp_path / "docs")), word_bpe(), 8)
    got = [tuple(r) for r in df.collect()]
    check(got, dict(rows), library)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(got) == len(rows) and plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_driver_holds_no_object_for_each_word(spark, library):
    """The broadcast words, ids and spellings stay Arrow columns on the driver, some ten bytes each, until they are one text."""
    some, size = random.Random(3), 40_000
    words = ["".join(some.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(size)]
    texts = [" ".join(words[i::100]) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bpe.codec(word_bpe())
    tracemalloc.start()
    try:
        df = bpe.encode_documents(docs, word_bpe())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 160 * size
    check([tuple(r) for r in df.collect()], texts, library)
