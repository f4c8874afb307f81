"""The lattice against all segmentations, counts and base score against a plain loop."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lattice_lm as lm
from tessera.llm.common import held_out
from tessera.llm.queries import piece_bpe

DOCS = [(i, t) for i, t in enumerate(["The cat sat on the mat.", "the CAT", None, "", "  \t\n", "naïve café Ünïcode ÀB", "日本語 ☃ x y", "zq" * 40, "a b c a b c", "the end\x0bof\x0call\x1ethings"] * 4)]


def brute_word(net, log_p, word):
    """Sum over all segmentations, by recursion over the rest of the word."""
    pieces = {p: i for i, p in enumerate(net.pieces) if i and i not in set(net.byte.values())}
    text = lm.START + word

    def rest(at):
        if at == len(text):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces:
                total += math.exp(log_p[pieces[text[at:end]]]) * rest(end)
            elif end == at + 1:
                total += math.exp(sum(log_p[net.byte[b]] for b in text[at].encode())) * rest(end)
        return total

    return math.log(rest(0))


@pytest.fixture(scope="module")
def net():
    return lm.lattice(piece_bpe())


def test_forward_recursion(net):
    words = ["a", "the", "cat", "mat.", "ünï", "日本", "☃x", "zqzq", "reading", "ing"]
    assert net.run(words, net.first).tolist() == pytest.approx([brute_word(net, net.first, w) for w in words])
    assert net.run([lm.END], net.first)[0] == net.first[0]


def test_expected_pieces_spell_each_word(net):
    """Expected counts times lengths give the characters of the words, each as often as the word."""
    words, counts, expected = ["reading", "the", "mat."], np.array([3.0, 1.0, 2.0]), np.zeros(len(net.pieces))
    net.run(words, net.first, counts, expected)
    assert float((expected * np.array([len(p) for p in net.pieces])).sum()) == pytest.approx(sum(c * (len(w) + 1) for w, c in zip(words, counts)))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1.0, "w") for i, t in rows], "doc_id long, text string, score double, word string")
    return lm.score_documents(df.withColumn("held_out", held_out(1)), piece_bpe()).toPandas()


@pytest.mark.parametrize("head", [1 << 17, 2, 0])
def test_counts_and_base_score(spark, monkeypatch, head):
    cut = lm.head_cut
    monkeypatch.setattr(lm, "head_cut", lambda words: cut(words, head))
    got = run(spark, DOCS).set_index("doc_id")
    split = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in DOCS}
    c = Counter(w for i, t in DOCS if not held[i] for w in split(t))
    n, v = sum(c.values()), len(c)
    for i, t in DOCS:
        ws, r = split(t), got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert -10_000 < r.score < 0


def test_score_is_the_sum_over_words(spark):
    got = run(spark, [(0, "alpha beta"), (2, "alpha"), (3, "beta"), (4, "")]).set_index("doc_id")["score"]
    assert got[0] == pytest.approx(got[2] + got[3] - got[4])


def test_repeated_rows_and_nulls(spark):
    got = run(spark, [(2, "rare words here"), (2, "rare words here"), (None, "rare words here"), (2, None)])
    assert len(got) == 4 and got["score"].nunique() == 2


def test_empty_table_and_no_training(spark):
    assert len(run(spark, [])) == 0
    only = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = run(spark, [(only, "alone")])
    assert (got["n_known"][0], got["train_tokens"][0]) == (0, 0) and got["base_score"][0] == pytest.approx(0.0)
