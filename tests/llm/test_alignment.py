"""Alignment by segments against both tokenizers on whole texts."""

import hashlib
import os
import random
import tracemalloc
from collections import Counter
from itertools import accumulate

import pytest

from tessera.llm import alignment
from tessera.llm.common import table
from tessera.llm.queries import byte_bpe, piece_bpe

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  ", "\n", "Hello, world! it's 3 o'clock", "naïve café  ÉCOLE　 x", "<|endoftext|>a <s> b </s> <0x41> <unk>", "a\n\n b \n c\t d  ", "end \n", "\nstart", "日本語 текст עברית", "😀👩‍👩‍👧 x y z", "a\x1c b\x1f\nc\x85 d᠎ e\x00 f", "we'LL don't 1999 !?", "x" * 3000, "the cat " * 4000, "has ▁ in it", "ﬁ é ½ Å", "{\r\n  if (x);\r\n}", "tail   "]


def byte_alphabet():
    from tokenizers import pre_tokenizers

    level, byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
    for c in map(chr, [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x8000)]):
        byte |= dict(zip(level.pre_tokenize_str(c)[0][0], c.encode()))
    return byte


def brute(rows):
    """Per row what the contract says, from both libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(byte_bpe()), sentencepiece.SentencePieceProcessor(model_file=piece_bpe())
    a.encode_special_tokens = True
    found, counts, byte = [], Counter(), byte_alphabet()
    for doc, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        q = [bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode() for i in y for t in [b.id_to_piece(i)]]
        if not text or b"".join(p) != (" " + text).encode() or b"".join(q) != (" " + text).encode():
            found.append((doc, [], [], [], []))
            continue
        at_a, at_b = ({e: i for i, e in enumerate(accumulate(map(len, parts)))} for parts in (p, q))
        both = sorted(set(at_a) & set(at_b))
        links = [(x[at_a[e]], y[at_b[e]]) for e in both]
        groups, i, j = [], 0, 0
        for e in both:
            groups.append(",".join(map(str, x[i : at_a[e] + 1])) + "|" + ",".join(map(str, y[j : at_b[e] + 1])))
            i, j = at_a[e] + 1, at_b[e] + 1
        counts.update(links)
        found.append((doc, x, y, groups, links))
    most = {}
    for (_, t), n in counts.items():
        most[t] = max(most.get(t, 0), n)
    out = []
    for doc, x, y, groups, links in found:
        out.append((doc, len(x), len(y), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    return sorted(out, key=str)


def run(spark, docs, **kw):
    rows = alignment.op13(docs, byte_bpe(), piece_bpe()) if not kw else alignment.align_documents(docs, byte_bpe(), piece_bpe(), **kw)
    return [tuple(r) for r in rows.collect()]


def test_as_both_libraries_on_whole_texts(spark):
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (5, "another text of five")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, segment string, row int, n int")
    assert sorted(run(spark, docs), key=str) == brute(rows)


@pytest.mark.parametrize("head", [0, 3, 20])
def test_rare_segments_by_the_join(spark, head):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in run(spark, docs, head=head)], key=str)
    assert got == brute(rows)


def test_pairs_beyond_the_broadcast_ones(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HEAD_PAIRS", 4)
    rows = list(enumerate(TEXTS))
    assert sorted(run(spark, spark.createDataFrame(rows, "doc_id long, text string")), key=str) == brute(rows)


def test_empty_table(spark):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_on_documents(spark):
    docs = table(spark, SF, "documents")
    assert sorted(run(spark, docs), key=str) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_broadcast_segments_are_no_objects_and_travel_in_parts(spark, monkeypatch):
    """The driver holds Arrow columns, and neither stage's workers load what only the other one needs."""
    some, size, sent = random.Random(5), 30_000, []
    words = ["".join(some.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(size)]
    docs = spark.createDataFrame([(i, " ".join(words[i::50])) for i in range(50)], "doc_id long, text string").repartition(4)
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: sent.append(vars(value).copy()) or broadcast(sc, value))
    tracemalloc.start()
    try:
        alignment.align_documents(docs, byte_bpe(), piece_bpe())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 280 * size
    assert len(sent) == 2 and not any(isinstance(x, (list, dict)) for parts in sent for x in parts.values())
    assert not {"groups", "text", "facts"} & sent[0].keys() and not {"whole", "table"} & sent[1].keys()


def test_number_of_broadcast_segments_by_chunks():
    import numpy as np
    import pyarrow as pa

    words = [b" w%d" % i + b"x" * (i % 23) for i in range(500)]
    finder = alignment.Finder(pa.array(words))
    finder.build(64)
    whole, bounds = alignment.segments.join([*words[::-1], b" new", b" newer and longer than that", b" new"])
    numbers, fresh = finder.number(whole, bounds[:-1], bounds[1:])
    assert numbers.tolist()[:500] == list(range(500))[::-1] and fresh == [b" new", b" newer and longer than that"]
    assert numbers.tolist()[500:] == [500, 501, 500] and np.array_equal(np.sort(finder.rank), np.arange(500))
