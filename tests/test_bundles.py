import pytest
from pyspark.sql import functions as F

from binfold.sources import bundles, storage


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/model"


def make(spark, path, n, names=("a", "b")):
    draft = bundles.Draft(spark, path)
    for k, name in enumerate(names):
        draft.save(spark.range(n).withColumn("x", F.col("id") * (k + 1)), name)
    draft.save(spark.range(3), "step")
    return draft


def test_a_version_is_current_when_it_is_whole(spark, path):
    with pytest.raises(FileNotFoundError):
        bundles.load(spark, path)
    first = make(spark, path, 5).commit(["a", "b"], {"why": "test"})
    old = bundles.load(spark, path, verify=True)
    assert {n: t.count() for n, t in old.items()} == {"a": 5, "b": 5} and bundles.manifest(spark, path)["notes"] == {"why": "test"}
    dying = make(spark, path, 9)  # tables written, no commit
    assert bundles.manifest(spark, path)["version"] == first and old["a"].count() == 5
    second = dying.commit(["a", "b"])
    assert bundles.manifest(spark, path)["version"] == second != first
    assert old["b"].count() == 5 and bundles.load(spark, path)["b"].count() == 9 and bundles.load(spark, path, first)["a"].count() == 5
    assert "step" not in storage.list_names(spark, f"{path}/versions/{second}")


def test_of_two_writers_one_is_told(spark, path):
    one, two = make(spark, path, 1), make(spark, path, 2)
    one.commit(["a", "b"])
    with pytest.raises(FileExistsError):
        two.commit(["a", "b"])
    assert bundles.load(spark, path)["a"].count() == 1


def test_changed_tables_are_noticed(spark, path):
    version = make(spark, path, 4).commit(["a", "b"])
    spark.range(4).withColumn("x", F.col("id") * 3).write.mode("overwrite").parquet(f"{path}/versions/{version}/b")
    with pytest.raises(ValueError, match="table b"):
        bundles.load(spark, path, verify=True)


def test_digest_knows_rows_not_order(spark):
    df = spark.createDataFrame([(1, "a", [1.5], None), (2, None, None, 0.1), (2, None, None, 0.1)], "i int, s string, v array<double>, d double")
    assert bundles.digest(df) == bundles.digest(df.orderBy(F.desc("i")).repartition(3))
    assert bundles.digest(df) != bundles.digest(df.dropDuplicates()) and bundles.digest(df) != bundles.digest(df.withColumn("s", F.lit("")))
    assert bundles.digest(df.where("i = 2"))[0] == 2 and bundles.digest(df.where("i = 2")) != bundles.digest(df.where("i = 1").union(df.where("i = 1")))
    assert bundles.digest(df.limit(0)) == (0, "0:0:0:0:0")


def test_vacuum(spark, path):
    versions = [make(spark, path, n).commit(["a", "b"]) for n in (1, 2, 3)]
    lost = make(spark, path, 7).version
    assert set(bundles.vacuum(spark, path, keep=2)) == {versions[0], lost}
    assert bundles.load(spark, path)["a"].count() == 3 and bundles.load(spark, path, versions[1])["a"].count() == 2
