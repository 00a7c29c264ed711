import hashlib
import random
import zlib

import pytest

from binfold.llm import prefix_trie


def rebuilt(rows, base=100, most=6):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = tuple(own.get(c - (c % base if c >= 0 else -(-c % base)), [])[:h] + t[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    prefixes = {t[:d] for t in convs.values() for d in range(len(t) + 1)}
    out = {}
    for p in prefixes:
        d = len(p)
        members = sorted(c for c, t in convs.items() if t[:d] == p)
        below = [q for q in prefixes if q[:d] == p]
        children = [q for q in below if len(q) == d + 1]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)
        saved = sum((sum(t[: len(q)] == q for t in convs.values()) - 1) * len(q[-1][1]) for q in below if q)
        parent = min(c for c, t in convs.items() if t[: d - 1] == p[:-1]) if d else None
        ends = ",".join(str(c) for c in members if len(convs[c]) == d)
        out[members[0], d] = (parent, len(members), len(children), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(prefix_trie.rebuild(df)).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}
    assert len(out) == len(got)
    return out


def made(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-150, 400), n):
        for _ in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([None, 0, 1, 2, 3, 4, 5]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "é", None, "b" * 5, ""])))
    rows += [(None, 1, "user", "lost"), *rows[:7]]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 90)])
def test_equals_brute_force(spark, seed, n):
    rows = made(seed, n)
    assert run(spark, rows) == brute(rows)


def test_copies_and_long_chains(spark):
    long = [("user", f"t{k}") for k in range(60)]
    rows = [(c, k, *t) for c in (1, 2, 3, 205) for k, t in enumerate(long)] + [(c, k, "user", "same") for c in range(10, 40) for k in range(8)]
    rows += [(300, 0, "user", "only")]  # its first turns are its own, so it may be left without any
    assert run(spark, rows) == brute(rows)


def test_table_and_other_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    wide = df.selectExpr("*", "1 as conv", "2 as depth", "3 as key", "4 as nth")
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in prefix_trie.prefix_trie(prefix_trie.rebuild(wide)).collect()}
    assert got == brute(rows)


def test_empty_and_alone(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 0, "user", "x")]) == {}
    for c in (0, 5, 7):
        rows = [(c, 0, "user", "x"), (c, 1, "assistant", "yy")]
        assert run(spark, rows) == brute(rows)


def test_ends_in_many_blocks(spark):
    ids = list(range(-3, 30000, 7))
    df = spark.createDataFrame([(5, 2, c) for c in ids] + [(5, 3, 9)], "conv_id long, depth long, conv long")
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie._ends_digest(df).collect()}
    assert got == {2: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 3: hashlib.sha256(b"9").hexdigest()}
