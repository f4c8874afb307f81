"""Paragraph MinHash banding against all pairs of paragraphs; removal of later occurrences."""

import random
import re

import numpy as np
import pytest

from tessera.llm import substring_dedup as sd


def words(t):
    return re.findall(r"\w+", t.lower())


def grams(ws):
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def texts_of(rows):
    return {i: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", t or "")] for i, t in rows if i is not None}


def brute_lines(rows):
    """(doc_id, word) of all words in lines whose class has two documents, by comparing all lines with a word."""
    units = []
    for i, t in rows:
        at = 0
        for line in (t or "").split("\n") if i is not None else []:
            if ws := words(line):
                units.append((i, at, ws, grams(ws)))
                at += len(ws)
    cls = list(range(len(units)))
    for x in range(len(units)):
        for y in range(x):
            gx, gy = units[x][3], units[y][3]
            if units[x][2] == units[y][2] or len(gx & gy) >= sd.LEAST * len(gx | gy):
                old, new = max(cls[x], cls[y]), min(cls[x], cls[y])
                cls = [new if c == old else c for c in cls]
    hot = {c for c in cls if len({units[k][0] for k in range(len(units)) if cls[k] == c}) > 1}
    return {(u[0], u[1] + k) for u, c in zip(units, cls) if c in hot for k in range(len(u[2]))}


def brute_runs(rows, run):
    """(doc_id, word) of all words in windows of run words that two documents have, by all windows."""
    split, seen = texts_of(rows), {}
    for i, ws in split.items():
        for k in range(len(ws) - run + 1):
            seen.setdefault(tuple(w for _, _, w in ws[k : k + run]), set()).add((i, k))
    return {(i, k + j) for at in seen.values() if len({i for i, _ in at}) > 1 for i, k in at for j in range(run)}


def islands(found, split, least):
    """(doc_id, start, end, words) of runs of neighbouring words."""
    out, last = [], None
    for i, k in sorted(found):
        if last == (i, k - 1):
            out[-1][2], out[-1][3] = split[i][k][1], out[-1][3] + 1
        else:
            out.append([i, split[i][k][0], split[i][k][1], 1])
        last = (i, k)
    return [tuple(x) for x in out if x[3] >= least]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(80)) for _ in range(n))
    passage, stock = text(70), "Read more about this here."
    near = passage.split()
    near[10] = "changed"
    out = [f"{text(30)}\n{passage}\n{text(25)}", f"{passage}\n{stock}", f"{stock}\n{text(40)}\n{' '.join(near)}", f"{text(20)}\n\n {passage.upper()} \n{stock}", text(3000), None, "", "\n\n", text(15), stock]
    out += [f"{text(15)}\n{stock}\n{passage}" for _ in range(12)]
    out.append(f"{text(40)}\n{out[4][:800]}\n")
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id long, text string, node string, words int")


@pytest.mark.parametrize("least_words", [sd.LEAST_WORDS, 1])
def test_brute_force(spark, rows, least_words):
    got = sd.repeated_passages(frame(spark, rows), least_words=least_words).collect()
    split, lines = texts_of(rows), brute_lines(rows)
    found = {(r["doc_id"], k) for r in got for k, (a, b, _) in enumerate(split[r["doc_id"]]) if r["start"] <= a and b <= r["end"]}
    assert sum(r["words"] for r in got) == len(found)
    runs, long = brute_runs(rows, sd.RUN), brute_runs(rows, sd.RUN + sd.NEAR - 1)
    assert found <= lines | runs
    # every line that repeats, and something of every run that is long enough for a common mark
    want = islands(lines | found, split, least_words)
    assert sorted((r["doc_id"], r["start"], r["end"], r["words"]) for r in got) == want and want
    assert all(any(a <= x["start"] < b or x["start"] <= a < x["end"] for x in got if x["doc_id"] == i) for i, a, b, _ in islands(long, split, 1))


def test_pieces_of_the_hashing():
    hasher = sd.Hasher(fold=True)
    w = sd.read(["The cat İ sat\n\n on_the MAT 9½ x\nthe CAT"], hasher)
    assert [("The cat İ sat\n\n on_the MAT 9½ x\nthe CAT"[a:b]) for a, b in zip(w.start, w.end)] == ["The", "cat", "İ", "sat", "on_the", "MAT", "9½", "x", "the", "CAT"]
    assert (w.first.tolist(), w.last.tolist()) == ([0, 4, 8], [4, 8, 10])
    h = [w.spans(sd.np.array([0, 8, 1]), sd.np.array([2, 10, 3]), k) for k in (0, 1)]
    assert all(x[0] == x[1] != x[2] for x in h)
    line, shingle = sd.line_shingles(w)
    assert line.tolist() == [0, 1, 2] and len(set(shingle.tolist())) == 3
    for n in (0, 5, 19, 20, 30, 43, 44, 300):
        v = sd.read([" ".join(f"w{k * 7919 % 1000}" for k in range(n))], hasher)
        got = sd.marks(v)
        assert len(got) == 0 if n < sd.RUN else len(got) and (sd.np.diff(got) <= sd.NEAR).all() and got[0] < sd.NEAR and got[-1] > n - sd.RUN - sd.NEAR
    one, two = "a b c", " ".join(f"v{k}" for k in range(70))
    both, alone = sd.read(["", one, two, "", two], hasher), sd.read([two], hasher)
    at = sd.marks(both)
    assert set(both.text[at].tolist()) == {2, 4} and [(at[both.text[at] == k] - both.origin[at[both.text[at] == k]]).tolist() for k in (2, 4)] == [sd.marks(alone).tolist()] * 2


def test_first_occurrence_stays(spark, rows):
    df = frame(spark, rows)
    out = {r["doc_id"]: r for r in sd.remove_passages(df, sd.repeated_passages(df)).collect()}
    assert len(out) == len(rows) and out[0]["text"] == rows[0][1] and (out[5]["text"], out[6]["text"]) == (None, "")
    kept = rows[0][1].split("\n")[1]
    assert all(kept not in (r["text"] or "") for i, r in out.items() if i) and all(r["node"] == "n" for r in out.values())
    assert rows[13][1].split("\n")[0] in out[13]["text"]


def test_repeated_rows_are_no_repeat(spark, rows):
    one = [rows[0], rows[0], (None, rows[0][1])]
    assert sd.repeated_passages(frame(spark, one)).count() == 0


def test_empty_table(spark):
    assert sd.repeated_passages(frame(spark, [])).count() == 0


def test_tuning():
    bands, rows = sd.tune()
    assert 1 - (1 - sd.LEAST**rows) ** bands >= sd.RECALL and 1 - (1 - 0.3**rows) ** bands <= 0.35


@pytest.mark.parametrize("marks", [True, False])
def test_passages_of_51_words_inside_lines_against_all_windows(spark, marks):
    rng = random.Random(5)
    text = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(80)) + ("." if marks and k % 13 == 12 else "") for k in range(n)]
    planted = [text(51) for _ in range(150)]
    docs = [" ".join([*text(rng.randint(15, 90)), *p, *text(rng.randint(15, 90))]) for p in planted for _ in range(2)]
    got = sd.repeated_passages(frame(spark, list(enumerate(docs)))).collect()
    # independent of the cutting: the words in a window of LEAST_WORDS words that another document has
    seen, split = {}, [[m for m in re.finditer(r"\w+", d)] for d in docs]
    for i, ws in enumerate(split):
        for k in range(len(ws) - sd.LEAST_WORDS + 1):
            seen.setdefault(tuple(m[0] for m in ws[k : k + sd.LEAST_WORDS]), []).append((i, k))
    want = {(i, k + j) for at in seen.values() if len({i for i, _ in at}) > 1 for i, k in at for j in range(sd.LEAST_WORDS)}
    found = {(r["doc_id"], k) for r in got for k, m in enumerate(split[r["doc_id"]]) if r["start"] <= m.start() < r["end"]}
    assert len(want) >= 300 * 51 and found <= want and len(found) >= 0.7 * len(want)
    assert {i for i, _ in found} == set(range(300))
    assert all(r["removed_words"] == (r["words"] if r["doc_id"] % 2 else 0) and r["words"] >= sd.LEAST_WORDS for r in got)


def test_class_and_source_link_passages(spark, rows):
    got = sd.repeated_passages(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["class_id"], set()).add((r["doc_id"], r["source_doc_id"]))
    assert all(len({s for _, s in x}) == 1 for x in by.values())
    assert all(s <= i for x in by.values() for i, s in x) and any(len(x) > 1 for x in by.values())


def test_texts_that_share_a_doc_id_have_their_own_passages(spark):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"aa bb\n{p}"), (1, f"cc\n{p}"), (2, f"{p}\ndd")]
    df = frame(spark, rows)
    got = sorted((r["doc_id"], r["start"], r["words"], r["removed_words"]) for r in sd.repeated_passages(df).collect())
    assert [(i, a, w) for i, a, w, _ in got] == [(1, 3, 60), (1, 6, 60), (2, 0, 60)]
    assert sorted(len(r["text"]) for r in sd.remove_passages(df, sd.repeated_passages(df)).collect())[-1] >= len(p)


def test_columns_named_like_the_operators_own(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "v", "s") for i, t in rows], "doc_id long, text string, spans int, version string, _spans string")
    out = sd.remove_passages(df, sd.repeated_passages(df))
    assert out.columns == df.columns and {(r["spans"], r["version"], r["_spans"]) for r in out.collect()} == {(1, "v", "s")}


def test_a_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    got = sd.repeated_passages(frame(spark, [(1, long), (2, "x " + long[100_000:101_000])])).collect()
    assert {r["doc_id"] for r in got} == {1, 2}


def test_words_as_the_pattern_finds_them():
    """Also that the lower case of a text has the words of the text: no other letter than these two changes what is a word."""
    hasher = sd.Hasher(fold=True)
    assert all(len(x) == 1 and x.isalnum() == c.isalnum() for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c != "İ" for x in [c.lower()])
    for t in ["", "ὈΔΥΣΣΕΎΣ İx Straße_ÉCOLE", "naïve “café” — ÉCOLE 9½", "a\x1cb\x85c\u2028d", "日本語 текст עברית 😀", " ".join(f"a{chr(c)}b" for c in range(0x2000, 0x2100))]:
        assert hasher.words(t) == [w.lower().encode() for w in sd.WORD.findall(t)], t


def test_only_documents_of_wanted_lines_are_cut(spark):
    """A node's text is the span of its own document, so that nothing else is split into words again."""
    docs = spark.createDataFrame([(1, 5, "ab cd\nEF É gh"), (1, 6, "other text"), (2, 5, "never"), (1, 5, "ab cd\nEF É gh")], "doc_id long, version int, text string")
    nodes = spark.createDataFrame([(1, 5, 6, 13, b"x"), (1, 6, 0, 5, b"y")], "doc_id long, version int, start int, end int, id binary")
    assert sorted((bytes(r["id"]), r["text"]) for r in sd.node_texts(docs, nodes).collect()) == [(b"x", "EF É gh"[:7]), (b"y", "other")]


def test_each_distinct_word_is_hashed_once(monkeypatch):
    """Equal short words are hashed once, wherever they are, and every word has the hash it has alone."""
    texts = ["The cat, the CAT_7 x\u00e9\u00c9 \u65e5\u672c a\u2014b", "", "\u03a3\u0399\u03a3 \u0130x the", "a b ab ba " + "".join(map(chr, range(0x2010, 0x2040))) + " cat", "w" * 16 + " " + "v" * 15, "a\x1cb\x00c"]
    real, asked = sd.hashes, []
    monkeypatch.setattr(sd, "hashes", lambda words: asked.extend(words) or real(words))
    hasher = sd.Hasher(fold=True)
    words = [w.lower().encode() for t in texts for w in sd.WORD.findall(t)]
    assert hasher.texts(texts).tolist() == real(words).tolist()
    assert sorted(asked) == sorted(set(words)) and len(words) > len(set(words))
    far = ["q" * 17, "q" * 16, "q" * 18, "q" * 17, "q" * 16 + "r"]
    assert hasher.texts([" ".join(far), ""]).tolist() == real([w.encode() for w in far]).tolist()
    assert len(hasher.texts([])) == len(hasher.texts(["", " ,"])) == 0


def test_shingles_of_a_line_are_distinct():
    texts = ["a b c d e a b c d e a b c d e f\nshort line\na b c d e f g", "short line\na b c d e f"]
    w = sd.read(texts, sd.Hasher(fold=True))
    line, shingle = sd.line_shingles(w)
    lines = [x.split() for t in texts for x in t.split("\n")]
    want = [len({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))}) for x in lines]
    assert np.bincount(line).tolist() == want and np.all(np.diff(line) >= 0)
    assert len(set(zip(line.tolist(), shingle.tolist()))) == len(line)
