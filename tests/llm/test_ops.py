import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from binfold.llm import ball_tree, chat, common, exact_dedup, html_text, jaccard_join, language_id, mixing, packing, token_counts, token_store
from binfold.llm.units import UnitEncoder, encoder, split_units

DIR = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- exact dedup -----------------------------------------------------------------------------------------------------


def test_exact_dedup_odd_rows(odd_docs):
    got = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in odd_docs.collect():
        by.setdefault(lower(r["text"]), []).append(r["doc_id"])
    for text, ids in by.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r["text_sha256"] == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r["doc_id"]) for r in mine) == sorted(map(str, ids))
        assert {r["keep_id"] for r in mine} == {best} and {r["group_size"] for r in mine} == {len(ids)}
        assert sum(r["kept"] for r in mine) == 1


def test_exact_dedup_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a"), (2, "B")], "doc_id long, text string")
    second = spark.createDataFrame([(5, "b"), (6, "c"), (7, "C")], "doc_id long, text string")
    exact_dedup.exact_dedup(first, index=exact_dedup.DigestIndex(spark, path, 4)).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(second, index=again).collect()}
    assert got == {5: (2, False), 6: (7, False), 7: (7, True)}
    assert again.read().count() == 3
    plan = again.read().join(first.select(exact_dedup.text_digest(F.col("text")).alias("digest")).hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_exact_dedup_empty(odd_docs):
    assert exact_dedup.exact_dedup(odd_docs.limit(0)).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------


def brute_padding(lengths, counts, k):
    m, best = len(lengths), None
    for size in range(1, min(k, m) + 1):
        for inner in itertools.combinations(range(m - 1), size - 1):
            cut = [*inner, m - 1]
            pad, at = 0, 0
            for c in cut:
                while at <= c:
                    pad += counts[at] * (lengths[c] - lengths[at])
                    at += 1
            best = pad if best is None else min(best, pad)
    return best


def test_boundaries_are_optimal():
    rnd = random.Random(5)
    for _ in range(150):
        m = rnd.randint(1, 8)
        lengths = sorted(rnd.sample(range(1, 60), m))
        counts = [rnd.randint(1, 9) for _ in range(m)]
        k = rnd.randint(1, 5)
        bounds = packing.optimal_boundaries(lengths, counts, k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        pad = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
        assert pad == brute_padding(lengths, counts, k)


def test_pack_places_every_row_once(spark, odd_docs):
    rows = packing.pack(odd_docs, n_buckets=3, token_budget=40, rows_per_salt=2).collect()
    assert len(rows) == odd_docs.count()
    places = [(r["bucket"], r["batch"], r["slot"]) for r in rows]
    assert len(set(places)) == len(places)
    for r in rows:
        assert r["n_tokens"] <= r["bucket_len"]
        assert (r["slot"] + 1) * r["bucket_len"] <= max(40, r["bucket_len"])
    for bucket in {r["bucket"] for r in rows}:  # batches are filled in order, without gaps
        own = sorted((r["batch"], r["slot"]) for r in rows if r["bucket"] == bucket)
        each = max(1, 40 // next(r["bucket_len"] for r in rows if r["bucket"] == bucket))
        assert own == [(i // each, i % each) for i in range(len(own))]
    assert packing.pack(odd_docs.limit(0)).count() == 0


def test_rows_without_ids_lie_in_many_parts(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('word ', id) AS text")
    rows = packing.pack(df, n_buckets=2, token_budget=30, rows_per_salt=500)
    places = rows.select("bucket", "batch", "slot")
    assert rows.count() == places.distinct().count() == 4000
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(bucket" in plan and "salt" in plan
    h = df.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(9)).alias("s")).groupBy("s").count().collect()
    assert len(h) == 9 and max(r["count"] for r in h) < 600


def test_long_documents_have_exact_boundaries(spark):
    """Lengths far beyond any usual size are candidates one by one, like short ones."""
    rnd = random.Random(6)
    lengths = [rnd.choice([rnd.randint(1, 9), 40_000 + rnd.randint(0, 5), 3_000_000 + rnd.randint(0, 5)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    known, counts = packing.length_histogram(df)
    assert dict(zip(known, counts)) == {x: lengths.count(x) for x in set(lengths)} and known == sorted(known)
    rows = packing.pack(df.withColumn("text", F.lit("")), n_buckets=4, length=F.col("n")).collect()
    assert sum(r["bucket_len"] - r["n_tokens"] for r in rows) == brute_padding(known, counts, 4)


# --- Jaccard join ----------------------------------------------------------------------------------------------------


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = frozenset() if not w else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    ids, root, links = sorted(sets), {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def near_copies(seed, groups=6, size=9, length=60):
    rnd, out, i = random.Random(seed), [], 0
    vocab = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(length)]
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                t = t[: rnd.randint(40, len(t))]
            if rnd.random() < 0.2:
                t += passage
            out.append((i, " ".join(t)))
            i += 1
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(block)
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a b c d e"), (1005, "A B C D E f"), (1006, rows[0][1].upper()), (1007, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("rep", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute_join(rows)


def test_join_odd_rows(odd_docs):
    got = jaccard_join.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[6]["component_id"] == 5 and by[8]["component_id"] == 7 and by[3]["n_shingles"] == 0
    assert jaccard_join.near_duplicates(odd_docs.limit(0)).count() == 0


def test_join_links_through_null_ids(spark):
    w = [f"w{i}" for i in range(70)]
    chain = [" ".join(w[i : i + 50]) for i in (0, 6, 12)]  # neighbours share 40 of 52 shingles, the ends 34 of 58
    df = spark.createDataFrame([(7, chain[0]), (None, chain[1]), (9, chain[2]), (None, "five other words stand here alone")], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(7, 7, 1), (None, 7, 2), (9, 7, 1), (None, None, 0)], key=str)


def test_long_words_hash_alike_in_pieces(monkeypatch):
    text = " ".join("x" * k for k in range(1, 60))
    whole = jaccard_join.word_hashes(text)
    monkeypatch.setattr(jaccard_join, "PIECE", 64)
    assert (jaccard_join.word_hashes(text) == whole).all()


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["comp"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {i: find(i) for i in touched}


@pytest.mark.parametrize("hot", [2, 64])
def test_join_with_a_shingle_in_every_document(spark, monkeypatch, hot):
    """One passage in all rows, hashes that are hot in a batch or not, string ids and ids that two texts share."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BATCH", 16)
    rows = [(f"d{i:03}", "this passage is in every single document here " + t) for i, t in near_copies(hot, groups=8)]
    rows += [(f"e{i:03}", f"this passage is in every single document here and {i}") for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()}
    assert got == brute_join(rows)


def test_join_keeps_texts_of_one_id_apart(spark):
    w = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    texts = [" ".join(x) for x in w]
    near = [" ".join(x[:-1]) for x in w]
    df = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (6, near[0]), (7, near[1]), (8, texts[2])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(5, 5, 1), (5, 5, 1), (6, 5, 1), (7, 5, 1), (8, 8, 0)]


def test_index_keeps_its_bucket_count(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    exact_dedup.exact_dedup(first, index=exact_dedup.DigestIndex(spark, path, 8)).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert again.buckets == 8 and all(r["kept"] for r in exact_dedup.exact_dedup(first, index=again).collect())  # a batch run again gives what it gave
    assert again.read().count() == 50
    with pytest.raises(ValueError, match="type"):
        exact_dedup.DigestIndex(spark, path, key_type="string")
    first.write.parquet(f"file://{tmp_path}/other")
    with pytest.raises(ValueError, match="not an index"):
        exact_dedup.DigestIndex(spark, f"file://{tmp_path}/other")


def test_hot_keys_join_like_others(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    got = common.join_groups(rows, groups, ["k"], "n", 3000)
    want = rows.join(groups, "k")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 3000


# --- token store and counts ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_texts():
    rnd, alphabet = random.Random(1), [*" \n\t ab's1.é漢", " ", "\x1c", "  ", "<|endoftext|>", "don't"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["", " ", "  ", " a", "a ", "a \n \n b"]


def whole(enc, text):
    return enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_units_equal_whole_texts(odd_texts):
    enc = UnitEncoder(max_cached=200)  # the cache is emptied again and again
    for lo in range(0, len(odd_texts), 50):
        part = odd_texts[lo : lo + 50]
        for text, ids in zip(part, enc.encode(part)):
            assert ids.tolist() == whole(enc, text), repr(text)
            assert "".join(split_units(text)) == text


def test_store_round_trip(spark, odd_docs):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", F.lit(1).alias("n")).unionByName(odd_docs.select(F.col("doc_id") + 10_000, "text", F.lit(1).alias("n")).toDF("doc_id", "text", "n"))
    rows = docs.collect()
    ids = {}
    enc = encoder()
    want = sorted(((r["doc_id"], whole(enc, r["text"] or "") + [0]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    path = token_store.write_store(docs)
    got = token_store.digests(spark, path).collect()
    start, expect = 0, []
    for i, x in want:
        expect.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(expect, key=key)
    full = token_store.read_documents(spark, path).collect()
    assert sorted(r["ids"] for r in full) == sorted(np.array(x, "<u4").tobytes() for _, x in want)
    # the digests that checksums of chunks give are those of the rebuilt ids
    assert sorted(((r["id"], r["start"], r["n"], zlib.crc32(r["ids"])) for r in full), key=key) == sorted(map(tuple, got), key=key)
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("key").distinct().count()
    del ids


def test_store_notices_damage(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "others")], "doc_id long, text string")
    path = token_store.write_store(docs)
    spark.read.parquet(f"{path}/manifest").withColumn("root", F.lit(b"x")).write.parquet(f"{path}/m2")
    spark.read.parquet(f"{path}/m2").write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Exception, match="manifest"):
        token_store.digests(spark, path).collect()


def test_store_notices_a_part_that_is_gone(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = token_store.write_store(docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r[0] for r in spark.read.parquet(f"{path}/manifest").select("part").orderBy("part").collect()]
    assert len(parts) > 1 and token_store.digests(spark, path).count() == 5000
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").where(F.col("part") != parts[-1]).write.parquet(f"{path}/less-{name}")
        spark.read.parquet(f"{path}/less-{name}").write.mode("overwrite").parquet(f"{path}/{name}")
    with pytest.raises(ValueError, match="root of the store"):
        token_store.digests(spark, path)


def test_store_empty(odd_docs):
    assert token_store.store_digests(odd_docs.limit(0)).count() == 0


def test_chunks_follow_content():
    rnd = np.random.default_rng(4)
    ids = rnd.integers(0, 50000, 60000)
    other = np.concatenate((rnd.integers(0, 50000, 777), ids))
    cut = lambda x: {x[a:b].tobytes() for a, b in itertools.pairwise([0, *token_store.chunk_ends(x)])}
    a, b = cut(ids), cut(other)
    assert len(a & b) > 0.9 * len(a)
    assert token_store.unpack_ids(token_store.pack_ids(ids), len(ids)).tolist() == ids.tolist()
    big = np.array([70000, 3, 2**31], np.uint32)
    assert token_store.unpack_ids(token_store.pack_ids(big), 3).tolist() == big.tolist()


def test_edits_equal_full_recount(odd_texts):
    rnd, enc = random.Random(2), encoder()
    for text in odd_texts:
        edits = [{"start": (a := rnd.randint(0, 45)), "stop": a + rnd.randint(0, 6), "text": rnd.choice(odd_texts)[:4]} for _ in range(rnd.randint(0, 4))]
        units, at = split_units(text), enc.rows([text])[0]
        size = enc.size[at]
        size = size[1:] if len(size) != len(units) else size
        tree = token_counts.TokenTree(np.array([len(u) for u in units], int), size)
        assert tree.tokens == len(whole(enc, text))
        todo = token_counts.checked(edits, len(text))
        spans = []
        for first, last, lo, hi, own in token_counts.regions(tree, todo):
            piece = token_counts.apply_text(text[lo:hi], [(s - lo, e - lo, t) for s, e, t in own])
            spans.append((first, last, len(piece), int(enc.size[enc.rows([piece])[0]].sum())))
        token_counts.edit_tree(tree, spans)
        after = token_counts.apply_text(text, todo)
        assert (tree.tokens, tree.chars) == (len(whole(enc, after)), len(after)), (text, edits)


def test_edits_of_edited_trees(spark, odd_texts):
    """Three rounds of edits, each on the texts and trees the one before returned."""
    rnd, enc = random.Random(5), encoder()
    texts = [a + b for a, b in zip(odd_texts, odd_texts[7:])][:400]
    df = token_counts.build_trees(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, tree string, `a.b` string"))
    assert df.columns == ["doc_id", "text", "a.b", "tree"]
    for _ in range(3):
        edits = [(i, [((a := rnd.randint(0, 60)), a + rnd.randint(0, 20), rnd.choice(odd_texts)[:6]) for _ in range(rnd.randint(0, 3))]) for i in range(len(texts))]
        done = token_counts.apply_edits(df.join(spark.createDataFrame(edits, f"doc_id long, edits {token_counts.EDITS}"), "doc_id"), keep=True)
        rows = {r["doc_id"]: r for r in done.collect()}
        texts = [token_counts.apply_text(t, token_counts.checked([dict(zip(("start", "stop", "text"), e)) for e in own], len(t))) for t, (_, own) in zip(texts, edits)]
        for i, t in enumerate(texts):
            assert rows[i]["text"] == t and rows[i]["n_tokens_edited"] == len(whole(enc, t))
            tree = token_counts.TokenTree.from_bytes(rows[i]["tree"])
            assert (tree.chars, tree.tokens) == (len(t), len(whole(enc, t)))
        df = spark.createDataFrame([(i, rows[i]["text"], rows[i]["tree"]) for i in rows], "doc_id long, text string, tree binary")


def test_counts_query(odd_docs):
    rows = token_counts.count_after_edits(odd_docs, token_counts.sample_edits()).collect()
    enc, want = encoder(), []
    for r in odd_docs.withColumn("e", token_counts.sample_edits()).collect():
        t = r["text"] or ""
        want.append((len(whole(enc, t)), len(whole(enc, token_counts.apply_text(t, token_counts.checked([x.asDict() for x in r["e"]], len(t)))))))
    assert sorted((r["n_tokens"], r["n_tokens_edited"]) for r in rows) == sorted(want)
    long = next(r for r in rows if r["doc_id"] == 9)
    assert long["n_reencoded"] < 60 < long["n_units"]
    assert token_counts.count_after_edits(odd_docs.limit(0), token_counts.sample_edits()).count() == 0


# --- top-k -----------------------------------------------------------------------------------------------------------


def brute_top_k(ints, asked, k=5):
    want = []
    for q in asked:
        s = sorted((-sum(int(a) * int(b) for a, b in zip(ints[q], y)), i) for i, y in ints.items() if i != q and len(y) == len(ints[q]))[:k]
        want += [(q, r, i, -v) for r, (v, i) in enumerate(s, 1)]
    return sorted(want)


@pytest.mark.parametrize("pivots, size", [(1, 1 << 20), (6, 8 * 6 * 40), (1024, 8 * 6 * 40)])
def test_top_k_equals_brute_force(spark, monkeypatch, pivots, size):
    monkeypatch.setattr(ball_tree, "PIVOTS", pivots)
    rng = np.random.default_rng(8)
    vecs = [(i, (rng.normal(size=6) + 4 * np.eye(6)[i % 6]).round(1).astype(float).tolist()) for i in range(700)]
    vecs += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0, 2.0]), (950, [0.5, 1.5]), (None, [1.0] * 6)]
    vecs += [(i, vecs[0][1]) for i in range(1001, 1400)]  # one vector holds a third of all rows
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ball_tree.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_bytes=size, query_bytes=8 * 6 * 8).collect()
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vecs if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    assert sorted(map(tuple, got)) == brute_top_k(ints, [q for q in ints if q % 50 == 0])


def test_top_k_is_exact_for_large_components(spark):
    rng = np.random.default_rng(3)
    for size in (1e6, 3e13):  # products beyond 2**53 and beyond 64 bits
        vecs = [(i, (rng.normal(size=4) * size).tolist()) for i in range(60)]
        df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
        ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in vecs}
        want, top = brute_top_k(ints, [0, 50], 60), 2**63 - 1
        got = ball_tree.top_k(df, df.where("vec_id % 50 = 0"), 60).collect()
        assert {(r["query_id"], r["vec_id"], r["score"]) for r in got} == {(q, i, max(-top, min(top, v))) for q, _, i, v in want}
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert len(ball_tree.top_k(df, df).collect()) == 2
    assert ball_tree.top_k(df.limit(0), df.limit(0)).count() == 0 and ball_tree.top_k(df, df.limit(0)).count() == 0


def test_tree_prunes_and_is_stored_whole():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([rng.normal(size=(400, 8)) + 40 * c for c in np.eye(8)])).astype(np.int64)
    built = ball_tree.BallTree(np.arange(len(x)), x)
    tree = ball_tree.BallTree.from_row(built.to_row(), 8)
    assert sorted(tree.ids.tolist()) == list(range(len(x))) and (tree.x == x[tree.ids]).all()
    for c, r, cut in zip(tree.centres, tree.radii, tree.bounds):
        assert len(c) == len(r) == len(cut) - 1
        for j in range(len(c)):
            assert (np.linalg.norm(tree.x[cut[j] : cut[j + 1]] - c[j], axis=1) <= r[j] + 1e-6).all()
    q = x[:3]
    s, _ = ball_tree.search(tree, np.arange(3), q, np.full(3, ball_tree.NONE), 5)
    bound = ball_tree.reach(q.astype(float), tree.centres[-1], tree.radii[-1])
    assert (bound < s[:, 4:5]).mean() > 0.25  # leaves that the kth score closes


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_mixing_budget_and_siblings(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(50)] + [(100 + i, "w " * 10, "en", "b") for i in range(2)] + [(200 + i, "w " * 10, "de", "c") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("copies", F.lit("x"))
    got = mixing.mix(df, budget_share=0.5, max_epochs=1, domain=F.lit("d"), range_rows=2).collect()
    budget = {(r["lang"], r["source"]): r["leaf_budget"] for r in got}
    # 510 tokens: 255 a language; source b can only use 20, its sibling a takes the rest before German does.
    assert budget == {("en", "a"): 235, ("en", "b"): 20, ("de", "c"): 255}
    used = {}
    for r in got:
        used[r["source"]] = used.get(r["source"], 0) + r["copies"] * r["n_tokens"]
    assert used == {"a": 230, "b": 20, "c": 250}


def test_mixing_epochs_weights_and_odd_rows(spark, odd_docs):
    df = spark.createDataFrame([(i, "w w", "en", "a") for i in range(10)], "doc_id long, text string, lang string, source string")
    assert {r["copies"] for r in mixing.mix(df, 1.5, 3, domain=F.lit("d")).collect()} == {1, 2}
    got = mixing.mix(odd_docs, 0.5, 2).collect()
    assert len(got) == odd_docs.count() and {r["source"] for r in got} >= {"unknown", "s1"}
    none = mixing.mix(odd_docs, 0.5, 2, weights={"source": {"s1": 0}}).where("source = 's1'").collect()
    assert all(r["copies"] == 0 for r in none)
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def brute_mix(rows, share, max_epochs, weights, seed="mix"):
    """Recursive water-filling and a plain sort per leaf; rows are (id, domain, lang, source, tokens)."""
    weight = lambda level, k: weights.get(mixing.LEVELS[level], {}).get(k, 1)
    leaves = {}
    for i, *path, n in rows:
        leaves.setdefault(tuple(path), []).append((i, n))
    usable = {p: sum(n for _, n in r) * max_epochs * all(weight(k, x) for k, x in enumerate(p)) for p, r in leaves.items()}
    budget = dict.fromkeys(leaves, 0)

    def down(prefix, amount):
        depth = len(prefix)
        if depth == 3:
            budget[prefix] = amount
            return
        caps = {}
        for p, c in usable.items():
            if p[:depth] == prefix and c:
                caps[p[depth]] = caps.get(p[depth], 0) + c
        open_, rest, given = set(caps), amount, {}
        while open_:
            total = sum(weight(depth, k) for k in open_)
            full = {k for k in open_ if caps[k] * total <= weight(depth, k) * rest}
            if not full:
                given |= {k: min(caps[k], rest * weight(depth, k) // total) for k in open_}
                break
            given |= {k: caps[k] for k in full}
            rest -= sum(caps[k] for k in full)
            open_ -= full
        for k, v in given.items():
            down((*prefix, k), v)

    down((), int(sum(r[4] for r in rows) * share))
    out = {}
    for p, r in leaves.items():
        tokens = sum(n for _, n in r)
        epochs = budget[p] // tokens if tokens else 0
        rest, upto = budget[p] - epochs * tokens, 0
        for i, n in sorted(r, key=lambda x: hashlib.md5(f"{seed}:{epochs}:{x[0]}".encode()).hexdigest()):
            upto += n
            out[i] = (budget[p], epochs + (0 < rest >= upto))
    return out


@pytest.mark.parametrize("range_rows", [1, 3, 4096])
def test_mixing_equals_brute_force(spark, range_rows):
    rnd = random.Random(range_rows)
    weights = {"domain": {"d1": 3}, "lang": {"en": 4, "fr": 0}, "source": {"a": 2, "b": 5}}
    rows = [(i, f"d{rnd.randint(0, 2)}", rnd.choice(["en", "en", "de", "fr"]), rnd.choice("aabc"), rnd.randint(0, 30)) for i in range(400)]
    df = spark.createDataFrame([(i, d, lang, src, "w " * n) for i, d, lang, src, n in rows], "doc_id long, dom string, lang string, source string, text string")
    got = {r["doc_id"]: (r["leaf_budget"], r["copies"]) for r in mixing.mix(df, 0.6, 2, weights, domain=F.col("dom"), range_rows=range_rows).collect()}
    assert got == brute_mix(rows, 0.6, 2, weights)
    assert all(got[r[0]] == (0, 0) for r in rows if r[2] == "fr")


def test_mixing_weight_zero_gives_its_share_to_siblings(spark):
    df = spark.createDataFrame([(i, "w " * 10, lang, "a") for i, lang in enumerate(["en", "de", "fr"] * 50)], "doc_id long, text string, lang string, source string")
    got = {r["lang"]: r["leaf_budget"] for r in mixing.mix(df, 0.5, 1, {"lang": {"fr": 0}}, domain=F.lit("d")).collect()}
    assert got == {"en": 375, "de": 375, "fr": 0}


@pytest.mark.parametrize("name", ["op5_top_k_search", "op7_mixing", "op9_chat_formatting", "op10_exact_dedup", "op11_substring_dedup", "op13_collocations"])
def test_query_equals_sql(spark, name):
    import duckdb

    from binfold.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    cells = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).itertuples(index=False)))
    assert cells(got) == cells(want)


# --- chat ------------------------------------------------------------------------------------------------------------


def test_escape_round_trip(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice([*chat.CONTROL, "\\", "0", "1", "\n", "n", "é", "<", "|"]) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect():
        assert r["b"] == r["t"] and r["r"] == r["t"] and not any(m in r["e"] for m in chat.CONTROL)


def test_format_chats(spark):
    rows = [(1, 0, "system", "be <s>good"), (1, 1, "user", "hi\\1"), (1, 2, "assistant", "yes</s>"), (1, 3, "user", None), (1, 4, "assistant", "x<|im_end|>\n"), (2, 0, "user", "u"), (2, 0, "user", "u"), (None, None, None, ""), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "assistant", "z" * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_reply_trees(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "more", 0.0), (2, 1, 77, "user", "lost parent", None)]
    tree += [(3, i, i - 1 if i > 1 else None, "user", str(i), 0.0) for i in range(1, 40)]
    df = spark.createDataFrame(tree, "conv long, node long, parent long, role string, text string, score double")
    paths = chat.root_to_leaf(df).collect()
    assert sorted((r["leaf"], r["node"], r["up"]) for r in paths if r["conv"] == 1) == [(2, 1, 1), (2, 2, 0), (4, 1, 2), (4, 3, 1), (4, 4, 0)]
    assert sorted((r["node"], r["up"]) for r in paths if r["conv"] == 3) == [(i, 39 - i) for i in range(1, 40)]
    top = {(r["conv"], r["branch"]): r["formatted"] for r in chat.conversations(df, 2).collect()}
    assert "good" in top[1, 1] and "more" in top[1, 2] and len(top) == 4


# --- HTML ------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><div>Site</div></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies and so on</div><article><h1>Head &amp; line</h1><p>First <b>para
 graph</b>.<br>Same block<p>Second &lt;one&gt; &eacute;<div class="ad">Buy</div><form><p>Name</p></form><!-- x --><ul><li>a<li>b</ul><aside>no</aside><section class="comments"><p>Great post</p></section><p>End.</p></article><footer>&copy; x</footer>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst para graph. Same block\n\nSecond <one> é\n\na\n\nb\n\nEnd."
    assert html_text.main_text(None) == "" and html_text.main_text("<nav>x</nav>") == "" and html_text.main_text("just text") == "just text"


def test_html_ratio_without_article():
    page = "<div><a href=a>Home</a> <a href=b>News</a></div>" + "".join(f"<p>{'real sentence with many words ' * 8}{i}</p>" for i in range(4)) + "<p><a>1</a><a>2</a><a>3</a></p><div><i>x</i><b>y</b></div>"
    got = html_text.main_text(page).split("\n\n")
    assert len(got) == 4 and all(g.startswith("real sentence") for g in got)


def test_html_teaser_is_not_the_page():
    body = [f"{'real sentence with many words ' * 8}{i}" for i in range(6)]
    teaser = "<article><h3>Other</h3><p>Read this one too</p></article>"
    got = html_text.main_text("<div><a href=a>Home</a> <a href=b>News</a></div>" + "".join(f"<div>{b}</div>" for b in body) + teaser).split("\n\n")
    assert [g for g in got if g.startswith("real")] == body and "Other" not in got
    # an article that holds the selected region still gives exactly its lines
    assert html_text.main_text("<div>x</div><article><h1>T</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</article>").split("\n\n") == ["T", *body]


def test_html_hints_spare_the_body():
    body = "".join(f"<p>{'real sentence with many words ' * 8}{i}</p>" for i in range(6))
    aside = '<div class="comments"><p>Great post by me and you</p></div>'
    for name in ("no-sidebar", "has-header", "comments-open", "layout notice"):
        got = html_text.main_text(f'<div class="{name}"><h1>T</h1>{body}{aside}</div><div class="sidebar"><p>{"other words " * 9}</p></div>')
        assert got.count("real sentence") >= 4 * 8 and "other" not in got and "Great" not in got
        assert html_text.main_text(f'<article class="{name}"><h1>T</h1>{body}{aside}</article>').startswith("T\n\nreal")
    assert "long" not in html_text.main_text(f'<article><p>{"short text " * 9}</p></article><div class="comments">{"<p>" + "long talk " * 50 + "</p>"}</div>')


def test_html_names_and_headers_keep_article_text():
    body = "".join(f"<p>{'real sentence with many words ' * 8}{i}</p>" for i in range(4))
    got = html_text.main_text(f'<article><header><h1>T</h1><p>Lead of the story</p><div>By me</div></header>{body}<p class="share-price">The price rose.</p><p class="ad">Buy now</p></article>')
    assert got.startswith("T\n\nLead of the story\n\nreal") and got.endswith("The price rose.") and "By me" not in got and "Buy" not in got


def test_html_never_raises():
    assert html_text.main_text("<p>one</p><![foo[bar]]><p>two</p>") == "one\n\ntwo" and html_text.main_text("<p>one</p><![ x") == "one"
    rnd = random.Random(7)
    bits = ["<", ">", "<!", "<![", "<![CDATA[", "<!DOCTYPE", "<!--", "-->", "--!>", "]]>", "<?", "&", "&#", "&#x", ";", "&amp;", "</", "<p", "<p>", "</p>", "<div class=", '"', "'", "<article>", "</article>", "<header>", "<script>", "</script", "<a href=x>", "x", " ", "\n", "\x00", "é", "=", "/", "<li>", "<td>", "</ul>", "[", "]", "%", "<svg/>", "<title>", "<textarea>"]
    for _ in range(4000):
        html_text.main_text("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))))


def test_html_deep_pages_take_linear_time():
    import time

    start = time.time()
    n = 20_000
    for page in ("<div>x" * n, "<span>" * n + "<div>x</div>" * n, "<b>" * n + "</i>" * n, '<div class="ad">' * n + "<p>x" * n, "<span>" * n + "<li>x" * n):
        html_text.main_text(page)
    assert time.time() - start < 60


def test_html_query(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "v", ""), (None, "w", "<p>x" + "y" * 50000)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = html_text.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0
    real = spark.read.parquet(f"{DIR}/pages.parquet")
    for r in real.join(html_text.extract(real).select("page_id", "text"), "page_id").collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        import html

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


# --- language ID -----------------------------------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["rejected"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_language_id_keeps_every_ngram(spark):
    """A language of millions of four-grams, each seen twice, takes nothing from small ones, whose grams are seen once."""
    rng = np.random.default_rng(1)
    ids = iter(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3))
    noise = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 275_000))) for _ in range(8)]
    small = {"aa": "quick brown fox jumps over lazy dogs", "bb": "welche schöne Aussicht zum Garten", "zz": noise[0]}
    rows = [(next(ids), t, "zz") for t in noise * 2] + [(next(ids), small[k], k) for k in ("aa", "bb")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    grams = np.unique(np.concatenate([language_id.windows(language_id.symbols(t)) for t in (*noise, *small.values())]))
    assert len(grams) > 2_000_000 and np.array_equal(model.parts[0].keys[-1], grams)
    h, _ = model.cross_entropies(list(small.values()))
    assert [model.langs[i] for i in h.argmin(axis=1)] == list(small)


def test_language_id_rejects_other_scripts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    odd = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 20), (2, None), (3, "123 !!"), (4, "q" * 3000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert all(r["rejected"] for r in got.values()) and got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["lang_pred"] != "und"


def test_language_id_rejection_is_calibrated_per_language():
    rng = np.random.default_rng(4)
    truth, n = np.array([0] * 500 + [1] * 500 + [2] * 4), np.full(1004, 400)
    h = np.full((1004, 3), 4.0)
    h[np.arange(1004), truth] = rng.normal(1.5, 0.05, 1004)
    model = lambda: language_id.Model(["a", "b", "c"], [])
    clean, dirty = model(), model()
    language_id._calibrate(clean, truth, n, h, 2.0)
    wrong, mixed = [9.0, 9.5, 9.2], [3.2, 4.0, 4.0]  # another script labelled "b"; a text of "a" with foreign passages
    language_id._calibrate(dirty, np.append(truth, [1, 0]), np.append(n, [400, 400]), np.vstack((h, wrong, mixed)), 2.0)
    junk = np.array([[2.5, 4, 4], [4, 2.5, 4], [4, 4, 2.5]])
    for m in (clean, dirty):
        assert m.rejects(junk, np.full(3, 400)).all() and m.rejects(np.array([wrong]), np.array([400])).all()
        assert m.rejects(h, n).sum() == 0


def test_language_id_odd_rows(odd_docs):
    got = language_id.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 10)} == {"und"}
    assert language_id.identify(odd_docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def naive_kneser_ney(texts, langs, alphabet):
    """p(language, four symbols) from dictionaries, one sum at a time."""
    top = {k: {} for k in langs}
    for lang, texts_ in texts.items():
        for t in texts_:
            s = [32] * 2 + language_id.symbols(t).tolist()
            for i in range(len(s) - 3):
                g = tuple(s[i : i + 4])
                top[lang][g] = top[lang].get(g, 0) + 1
    counts = {k: [None, None, None, None, c] for k, c in top.items()}
    for c in counts.values():
        for n in (3, 2, 1):
            c[n] = {}
            for g in c[n + 1]:
                c[n][g[1:]] = c[n].get(g[1:], 0) + 1

    def p(lang, g):
        if not g:
            return 1 / (alphabet + 1)
        own = counts[lang][len(g)]
        n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [v for k, v in own.items() if k[:-1] == g[:-1]]
        if not same:
            return p(lang, g[1:])
        return max(own.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(lang, g[1:])

    return p


@pytest.mark.parametrize("group", [1, 2, 8])
def test_fit_equals_naive_kneser_ney(monkeypatch, group):
    monkeypatch.setattr(language_id, "GROUP", group)
    texts = {"a": ["the cat sat on the mat", "the hat"], "b": ["le chat est ici", "la la la"], "c": ["der hut", "die katze ist da, die katze"]}
    langs, parts = list(texts), []
    for i, v in enumerate(texts.values()):
        u, c = np.unique(np.concatenate([language_id.windows(language_id.symbols(t)) for t in v]), return_counts=True)
        parts.append((np.full(len(u), i), u, c))
    model = language_id.fit(langs, *(np.concatenate(x) for x in zip(*parts)))
    alphabet = sorted({int(x) for v in texts.values() for t in v for x in language_id.symbols(t)})
    naive, rnd = naive_kneser_ney(texts, langs, len(alphabet)), random.Random(2)
    grams = [tuple(rnd.choice([*alphabet, 0x3A9]) for _ in range(4)) for _ in range(300)]
    grams += [tuple(language_id.symbols(t)[i : i + 4].tolist()) for v in texts.values() for t in v for i in range(len(language_id.symbols(t)) - 3)]
    pack = lambda g: sum(int(x) << 16 * (3 - i) for i, x in enumerate(g))
    got = model.log_probs(np.array([pack(g) for g in grams], np.uint64))
    want = np.log([[naive(lang, g) for lang in langs] for g in grams])
    assert np.allclose(got, want, atol=2e-5)
    for ctx in ("the", "la ", "zzz", "cha"):  # all symbols and the one place for unknown ones make a whole
        row = [tuple(map(ord, ctx)) + (s,) for s in [*alphabet, 0x3A9]]
        assert np.allclose(np.exp(model.log_probs(np.array([pack(g) for g in row], np.uint64))).sum(axis=0), 1, atol=1e-4)


def test_score_uses_the_whole_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    assert model.rejected_share < 0.01
    en, fr = (docs.where(f"lang = '{x}' and n_chars between 300 and 800").orderBy("doc_id").first()["text"] for x in ("en", "fr"))
    odd = spark.createDataFrame([(1, en[:40]), (2, en[:250]), (3, en[:250] + " " + fr * 3)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert got[1]["score"] <= got[2]["score"] and (got[1]["lang_pred"], got[2]["lang_pred"], got[3]["lang_pred"]) == ("en", "en", "fr")
