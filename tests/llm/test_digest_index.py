import pytest
from pyspark.sql import functions as F

from binfold.llm import exact_dedup
from binfold.llm.exact_dedup import DigestIndex
from binfold.sources import storage


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def run(spark, rows, path, buckets=4):
    index = DigestIndex(spark, path, buckets)
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(docs(spark, rows), index=index).collect()), key=str)
    index.close()
    return got


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def test_a_batch_run_again_gives_the_same_rows(spark, path):
    rows = [(1, "a"), (2, "A"), (3, None), (None, ""), (4, "b"), (4, "b"), (None, "c"), (None, "c")]
    first = run(spark, rows, path)
    assert sum(r[3] for r in first) == 4
    assert run(spark, rows, path) == first
    # A part of it, as after a failure in the middle; the keeper is kept where it is in the batch.
    part = {(r[0], r[4]): r[3] for r in run(spark, [(1, "a"), (4, "b"), (None, "c")], path)}
    assert sorted(part.values()) == [False, True, True]


def test_later_batches_lose_to_the_index(spark, path):
    run(spark, [(5, "x"), (6, "y")], path)
    got = {r[0]: (r[1], r[3]) for r in run(spark, [(9, "X"), (7, "z"), (8, "Z"), (5, "x")], path)}
    assert got == {9: (5, False), 5: (5, True), 7: (8, False), 8: (8, True)}


def test_a_job_that_dies_before_the_head_leaves_no_trace(spark, path, monkeypatch):
    run(spark, [(1, "a")], path)
    with monkeypatch.context() as m:
        m.setattr(DigestIndex, "_publish", lambda self, runs: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(spark, [(2, "b")], path)
    assert DigestIndex(spark, path).read().count() == 1
    assert [r[3] for r in run(spark, [(2, "b"), (1, "a")], path)] == [True, True]


def test_runs_are_one_sorted_file_a_bucket_and_joined_without_sort(spark, path):
    for k in range(3):
        run(spark, [(100 * k + i, f"t{100 * k + i}") for i in range(60)], path)
    index = DigestIndex(spark, path)
    assert len(index.state["runs"]) == 3
    for r in index.state["runs"]:
        files = [n for n in storage.list_names(spark, f"{path}/{r}") if n.startswith("part-")]
        assert len(files) == 4
    asked = docs(spark, [(1, "t5")]).select(exact_dedup.text_digest(F.col("text")).alias("digest"))
    plan = index.run(index.state["runs"][0]).join(asked.hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    side = plan[: plan.index("FileScan")].splitlines()[-6:]  # from the join down to the scan of the index
    assert sum("Sort [" in x for x in side) == 0 and not any("Exchange" in x for x in side)
    assert index.find(asked).count() == 1


def test_many_runs_are_merged(spark, path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_RUNS", 2)
    for k in range(4):
        run(spark, [(k, f"t{k}")], path)
    index = DigestIndex(spark, path)
    assert len(index.state["runs"]) <= 2 and sorted(r["keep_id"] for r in index.read().collect()) == [0, 1, 2, 3]
    kept = [n for n in storage.list_names(spark, path) if n.startswith("run-")]
    assert sorted(kept) == sorted(index.state["runs"])
    assert [r[3] for r in run(spark, [(50, "T0")], path)] == [False]


def test_two_writers(spark, path):
    one, two = DigestIndex(spark, path, 4), DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(docs(spark, [(1, "a")]), index=one).count()
    with pytest.raises(FileExistsError):
        exact_dedup.exact_dedup(docs(spark, [(2, "b")]), index=two).count()
