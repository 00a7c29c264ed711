import random

from pyspark.sql import functions as F

import corpus_pipeline
from test_ops import brute_join, lower
from binfold.llm import mixing


def test_stages_follow_their_rules(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rnd = random.Random(3)
    extra = [(10_000, None, "en", "s"), (10_001, "", "en", "s"), (10_002, "1234 !!", "en", "s")]
    base = docs.where("lang = 'en'").orderBy("doc_id").limit(3).collect()
    for k, r in enumerate(base):
        extra.append((10_010 + k, r["text"].upper(), "en", "s"))
        w = r["text"].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        extra.append((10_020 + k, " ".join(w), "en", "s"))
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cur, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, cur, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        before, cur = cur, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert cur.columns == docs.columns
        seen.append((before, cur))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert set(ids(seen[0][0])) - set(ids(seen[0][1])) == {10_000, 10_001, 10_002}
    best = {}
    for r in seen[1][0].collect():
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert ids(seen[1][1]) == sorted(best.values())
    joined = brute_join([(r["doc_id"], r["text"]) for r in seen[2][0].collect()])
    assert ids(seen[2][1]) == sorted(i for i, (_, comp, _) in joined.items() if comp == i)
    taken = [r[0] for r in mixing.mix(seen[3][0], 0.7, 1, corpus_pipeline.TARGET).where("copies > 0").select("doc_id").collect()]
    assert ids(seen[3][1]) == sorted(taken) and 0 < len(taken) < seen[3][0].count()
    assert ids(seen[4][1]) == sorted(taken)
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == sorted(taken)


def test_empty_documents(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark):
    """Null and repeated ids, repeated rows, ids on two texts, and columns named like those the stages add."""
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    near = [" ".join(t.split()[:-1]) for t in text]
    rows = [
        (5, text[0], "en", "s"), (5, text[0], "en", "s"), (5, text[1], "en", None), (9, text[1].upper(), None, "s"), (6, near[0], "en", "s"), (7, near[1], "en", "s"),
        (None, text[2], "en", "s"), (None, text[2].upper(), "en", "s"), (8, near[2], "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (None, " ", None, None), (5, "kept words", "en", "s"),
    ]
    docs = spark.createDataFrame([(*r, "x", i, 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, row_key string, nth int, `a.b` int")
    once = corpus_pipeline.dedup_exact(spark, docs, "")
    assert once.columns == docs.columns
    low = lambda t: lower(t)
    got = once.collect()
    assert sorted((str(r["doc_id"]), low(r["text"])) for r in got) == sorted([("5", text[0]), ("9", text[1]), ("6", near[0]), ("7", near[1]), ("None", text[2]), ("8", near[2]), ("2", ""), ("None", " "), ("5", "kept words")])
    left = corpus_pipeline.dedup_near(spark, once, "")
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), low(r["text"])) for r in left.collect()) == sorted([("5", text[0]), ("7", near[1]), ("8", near[2]), ("2", ""), ("None", " "), ("5", "kept words")])
    taken = corpus_pipeline.mixing(spark, left, "")
    assert taken.columns == docs.columns and 0 < taken.count() <= 6
    assert corpus_pipeline.packing(spark, docs, "").count() == len(rows)
    assert corpus_pipeline.language_id(spark, docs, "").columns == docs.columns
