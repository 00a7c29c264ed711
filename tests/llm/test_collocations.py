import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from binfold.llm import collocations


def brute(docs, least=30, top=2000, share=80):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        n[lang] += 0
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for lang in n:
        rows = []
        for (own, p), a in found.items():
            if own != lang:
                continue
            around = [b for (o, q), b in found.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= share * a for b in around):
                continue
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (p.decode(), -a, l, r, n[lang], -score)
    return out


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "lang string, text string")
    return {(r["lang"], r["rank"]): tuple(r)[2:] for r in collocations.collocations(df, **kw).collect()}


def made(seed, n=900):
    rnd = random.Random(seed)
    words = ["New", "york", "CITY", "é", "à", "x\x00y", "of", "the", "a", "zz" * 200, "b\x1fc"] + [f"w{i}" for i in range(40)]
    docs = []
    for _ in range(n):
        t = "".join(rnd.choice(words[: rnd.choice([4, 8, 12, 50])]) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", ": "]) for _ in range(rnd.randint(0, 60)))
        docs.append((rnd.choice(["en", "en", "en", "de", None, "und"]), rnd.choice([t, t, t, t, None, ""])))
    return docs + [("en", "the new york city hall. " * 40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = made(seed)
    want = brute(docs)
    assert len(want) > 25
    assert run(spark, docs) == want


def test_thresholds(spark):
    docs = made(3)
    assert run(spark, docs, least=5, top=7, inside_share=101) == brute(docs, 5, 7, 101)
    many = [("en", "one two three four five " * 200)] * 2
    assert run(spark, many, least=300) == brute(many, 300)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None), ("en", ""), ("en", " .,")]) == {}


def test_a_full_bitmap_never_loses_a_phrase():
    """Whatever lies in one bucket, counts of frequent phrases reach the threshold."""
    texts = pa.array(["a b c d e. " * 10, "a b. c d", None, "", "a\x0bb"])
    p = collocations.Phrases(["en"] * 5, texts)
    pairs = p.at(2)
    raw = p.words.raw.tobytes()
    got = Counter(p.phrase(2, int(i), raw) for i in pairs)
    assert got == {"a b": 11, "b c": 10, "c d": 11, "d e": 10}
    h = p.hashes(2, pairs)
    assert len(np.unique(h)) == 4
    for size in (16, 20, 28):
        bits = np.zeros((1 << size) // 8, np.uint8)
        bucket = (h >> np.uint64(64 - size)).astype(np.int64)
        np.bitwise_or.at(bits, bucket >> 3, (1 << (bucket & 7)).astype(np.uint8))
        assert collocations._has(bits, h).all() and not collocations._has(bits, ~h).any()
    other = collocations.Phrases(["de"] * 5, texts)
    assert not np.intersect1d(other.hashes(2, pairs), h).size


def test_bucket_counts_are_sums(spark, monkeypatch):
    """Merged or not, a task's buckets hold what was added, up to 255; blocks of several tasks add up."""
    monkeypatch.setattr(collocations, "MERGE", 50)
    rng = np.random.default_rng(4)
    h = (rng.integers(0, 300, 4000, dtype=np.uint64) << np.uint64(44)) + rng.integers(0, 999, 4000, dtype=np.uint64)
    one = collocations._Buckets(2, 20)
    for part in np.array_split(h, 13):
        one.add(part)
    bucket, n = one.merged()
    want = np.bincount((h >> np.uint64(44)).astype(np.int64))
    assert (bucket == np.flatnonzero(want)).all() and (n == want[want > 0]).all()
    rows = [r for b in one.rows() for r in b.to_pylist()]
    blocks = spark.createDataFrame([(r["block"], bytearray(r["counts"])) for r in rows * 3], "block int, counts binary")
    least = int(3 * np.median(want[want > 0]))
    got = np.unpackbits(collocations._bitmap(blocks, 20, least), bitorder="little")
    assert (np.flatnonzero(got) == np.flatnonzero(3 * want >= least)).all()
