"""Coding by exact round trips; files against the tokenizers library."""

import os
import zlib

import numpy as np
import pytest

from tessera.llm import segments, token_output
from tessera.llm.common import table
from tessera.llm.queries import byte_bpe

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "Hello, world! it's 3 o'clock", "naïve café  ÉCOLE　 x", "<|endoftext|>a <|endoftext|> b  <|end", "a\n\n b \n c\t d  ", "日本語 текст עברית", "😀👩‍👩‍👧 x y z", "a\x1c b\x1f\nc\x85 d᠎ e\x00 f", "we'LL don't X'ssY a1b2 !?", "x" * 3000, "the cat " * 4000, "é áb \U0001e030\U0001e031 ab", "\x00 \x00\x00 \x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe())


@pytest.mark.parametrize("widest", [None, 60, 12, 5, 1])
def test_pack_and_unpack(widest):
    rng = np.random.default_rng(3)
    some = [rng.integers(0, 1 << k, n).astype("<u8") for k in (1, 3, 9, 16, 33, 60, 62) for n in (1, 5, 1000)]
    some += [np.zeros(1000, "<u8"), np.zeros(0, "<u8"), np.array([(1 << 64) - 1, 0, 1, (1 << 60) - 1, (1 << 60) - 2, 1 << 59, 0], "<u8"), np.where(rng.random(3000) < 0.01, 60000, 3).astype("<u4")]
    for values in some:
        words, escapes = token_output.pack(values, widest)
        assert token_output.unpack(words, escapes, len(values)).tolist() == values.tolist()


def test_rare_wide_ids_become_escapes():
    values = np.where(np.arange(6000) % 100 == 0, 50_000, 2).astype("<u4")
    words, escapes = token_output.pack(values)
    assert len(escapes) == 60 and len(words) + len(escapes) < len(token_output.pack(values, 60)[0])


def test_numbers_of_segments():
    texts = [t.encode() for t in TEXTS if t] + [b"a", b"a\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghijklmnop", b"abcdefghijklmnopq"]
    buffer, bounds = segments.join(texts)
    starts = segments.cut(buffer, bounds)
    ends = np.append(starts[1:], bounds[-1])
    words = [buffer[a:b] for a, b in zip(starts, ends)]
    assert b"".join(words) == b"".join(texts)
    some = segments.Numbers(4)
    first, fresh = some.number(buffer, starts, ends)
    assert [fresh[i] for i in first] == words and len(set(fresh)) == len(fresh) == len(some)
    again, none = some.number(buffer, starts, ends)
    assert again.tolist() == first.tolist() and none == []
    far, other = segments.Numbers(4).number(buffer, starts, ends, grow=False)
    assert [other[i] for i in far] == words


@pytest.mark.parametrize("size", [1, 50, 1 << 25])
def test_files_as_the_library(spark, library, tmp_path, size):
    rows = [(i if i else None, t, i, "x") for i, t in enumerate(TEXTS)] + [(5, "five again", 0, ""), (5, "five again", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string")
    files = token_output.write_tokens(docs, f"file://{tmp_path}/tokens", byte_bpe(), end_id=0, file_ids=size).cache()
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids"]) for r in token_output.read_tokens(files).collect()), key=lambda r: r[0])
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    at, order = 0, []
    for start, doc, n, ids in got:
        assert start == at and n == len(ids) // 4
        want[doc].remove(np.frombuffer(ids, "<u4").tolist())
        at, order = at + n, [*order, -1 if doc is None else doc]
    assert order == sorted(order) and not any(want.values())
    every = np.concatenate([np.frombuffer(r[3], "<u4") for r in got])
    for a, n in ((0, 5), (7, 100), (at - 3, 3), (at - 1, 9)):
        assert token_output.read_ids(files, a, n).tolist() == every[a : a + n].tolist()
    assert not [f for f in os.listdir(tmp_path / "tokens") if not f.endswith(".s8b")]


def test_blocks_and_long_texts(spark, library, tmp_path):
    rng = np.random.default_rng(5)
    text = " ".join(np.array(["alpha", "Beta,", "γάμμα", "delta\n", "7", "1999"])[rng.integers(0, 6, 120_000)])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["first", text, "last"])], "doc_id long, text string")
    files = token_output.write_tokens(docs, f"file://{tmp_path}/long", byte_bpe())
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_output.read_tokens(files).collect()}
    assert got[1] == library.encode(text, add_special_tokens=False).ids + [0]


def test_a_cut_file_is_no_file(tmp_path):
    out = token_output.Writer(f"file://{tmp_path}/a.s8b", "1")
    out.add(np.arange(10, dtype="<u4"), np.array([[1, 0, 10]]))
    out.close()
    whole = (tmp_path / "a.s8b").read_bytes()
    (tmp_path / "b.s8b").write_bytes(whole[:-5])
    with pytest.raises(ValueError):
        token_output.Reader(f"file://{tmp_path}/b.s8b")


def test_empty_table(spark):
    assert token_output.op11(spark.createDataFrame([], "doc_id long, text string"), byte_bpe()).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_on_documents(spark, library):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in token_output.op11(docs, byte_bpe()).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        mine = got.pop(r["doc_id"])
        assert (mine["start"], mine["n_tokens"], mine["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got
