import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from binfold.llm import recompression
from binfold.llm.words import BLANKS, among, words_of


def brute(docs, window=20):
    """``docs``: (id, text) in any order; ids are distinct, None comes last."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        w = (t or "").encode("utf-8", "surrogatepass").split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))
    return out


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: tuple(r)[1:] for r in recompression.remove_repeats(df, **kw).collect()}


def made(seed, vocabulary, n=60, longest=200):
    """Texts with copied passages, periods and runs of one word."""
    rnd = random.Random(seed)
    word = lambda: f"w{int(vocabulary ** rnd.random())}"
    texts = []
    for _ in range(n):
        t = []
        while len(t) < rnd.randint(0, longest):
            kind = rnd.random()
            if kind < 0.3 and texts:
                source = rnd.choice(texts)
                a = rnd.randint(0, max(0, len(source) - 1))
                t += source[a : a + rnd.randint(10, 60)]
            elif kind < 0.4:
                t += [word()] * rnd.randint(1, 70)
            elif kind < 0.5:
                t += [word() for _ in range(rnd.randint(1, 4))] * rnd.randint(1, 30)
            else:
                t += [word() for _ in range(rnd.randint(1, 30))]
        texts.append(t)
    ids = rnd.sample(range(-50, 1000), n)
    return [(i, rnd.choice(["", " ", "\n"]) + "".join(x + rnd.choice([" ", "  ", "\t", "\n \r"]) for x in t)) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("seed, vocabulary", [(1, 5), (2, 40), (3, 3000)])
def test_equals_brute_force(spark, seed, vocabulary, monkeypatch):
    monkeypatch.setattr(recompression, "PART_BYTES", 4000)  # workers fork from this process only where nothing is cached
    docs = made(seed, vocabulary)
    assert run(spark, docs) == brute(docs)


def test_other_windows(spark):
    docs = made(4, 30, n=30)
    for window in (2, 7, 45):
        assert run(spark, docs, window=window) == brute(docs, window)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in recompression.remove_repeats(docs).collect()} == brute(rows)


def test_odd_rows(spark, odd_docs):
    got = sorted(map(tuple, recompression.remove_repeats(odd_docs).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert len(got) == len(rows)
    # Rows that share an id never repeat 20 words here, so each is judged alone.
    assert got == sorted(((i, *brute([(0, t)])[0]) for i, t in rows), key=str)
    assert recompression.remove_repeats(odd_docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id(spark):
    text = " ".join(f"x{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (None, text), (7, text), (7, text), (7, text)], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["n_removed"]) for r in recompression.remove_repeats(df).collect()]
    assert sorted(got, key=str) == [(7, 0), (7, 30), (7, 30), (None, 30), (None, 30)]


def test_long_texts_and_long_words(spark):
    long = " ".join(f"k{i % 7919}" for i in range(60000))
    docs = [(1, long), (2, "z" * 100_000 + " " + "é" * 400 + " b"), (3, long[5:]), (4, "a " * 50000), (5, ("z" * 100_000 + " ") * 21)]
    assert run(spark, docs) == brute(docs)


def test_equal_stretches_get_equal_symbols():
    rnd = random.Random(9)
    core = [f"c{rnd.randint(0, 400)}" for _ in range(400)]
    texts = [" ".join([f"a{k}{i}" for i in range(k)] + core + [f"b{k}{i}" for i in range(k + 3)]) for k in range(4)]
    w = words_of(pa.array(texts), among(BLANKS))
    (name, start, size), _ = recompression.parse(w.hash, w.doc)
    held = {}
    for n, s in zip(name[0], start):
        held.setdefault(int(n), set()).add(int(w.doc[s]))
    shared = sum(size[i] for i, n in enumerate(name[0]) if len(held[int(n)]) == 4 and w.doc[start[i]] == 0)
    assert shared > 200  # most of the common 400 words lies in symbols that all four texts hold


def test_anchors_depend_on_the_window_alone():
    rnd = random.Random(3)
    core = [f"c{rnd.randint(0, 3)}" for _ in range(20)]
    found = set()
    for k in range(60):
        w = words_of(pa.array([" ".join([f"a{rnd.randint(0, 3)}" for _ in range(k)] + core + [f"b{rnd.randint(0, 3)}" for _ in range(k % 7)])]), among(BLANKS))
        _, (low, high) = recompression.parse(w.hash, w.doc)
        found.add((int(low[k]) - k, int(high[k]) - k))
    assert len(found) == 1 and 0 <= min(found)[0] < max(found)[1] <= 20


def test_words_of():
    texts = ["a b  c", "", None, "dd", "ee ff", " x", "y ", "A b", "w" * 5000]
    for lower in (False, True):
        w = words_of(pa.array(texts).slice(1), among(BLANKS), lower)
        want = [(i, x) for i, t in enumerate(texts[1:]) for x in ((t or "").lower() if lower else t or "").encode().split()]
        assert [(int(d), bytes(w.raw[s:e])) for d, s, e in zip(w.doc, w.start, w.end)] == want
        assert len(set(w.hash.tolist())) == len({x for _, x in want})
    assert len(np.unique(words_of(pa.array(["q" * k for k in range(1, 600)]), among(BLANKS)).hash)) == 599
