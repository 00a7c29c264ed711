"""Vectors against their nearest vectors of other classes: rows of the queries are those of their SQL on odd tables."""

import uuid

import duckdb
import numpy as np
import pytest

from binfold.functions.kernels import nearest_rows
from binfold.operators import cnv_predict
from binfold.plans import registry
from test_oracles import rows


@pytest.mark.parametrize("name", ["k20_within_sample", "k20b_within_sample_masked"])
def test_values_without_a_reference_left_have_no_row(spark, tmp_path, name):
    """Classes far apart, so that all references of a value are masked; a component that never varies; a vector without a class."""
    rng = np.random.default_rng(3)
    label = np.repeat([0, 1, 2], [3, 4, 13])
    x = rng.uniform(0.5, 1, (20, 64)) * np.where(rng.random((20, 64)) < 0.7, 0.01, 1) + label[:, None] * (np.arange(64) % 4 > 0)
    x[:, 5] = 0.5
    vectors = [(i, v, c) for i, (v, c) in enumerate(zip(x.tolist(), label.tolist()))] + [(20, [0.25] * 64, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(registry.ORACLES[name]).fetchdf()
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert 0 < len(want) < 21 * 64 and (name == "k20_within_sample" or len(want) < 20 * 64)
    assert rows(got) == rows(want)


def test_references_are_found_once(spark, tmp_path):
    """Whatever makes the references compares all bins, so the passes must not repeat it."""

    def seen(frames):
        (tmp_path / f"run-{uuid.uuid4()}").touch()
        yield from frames

    knn = spark.createDataFrame([(i, [j + 1 for j in range(6) if j != i], [1.0] * 5) for i in range(6)], "masked_idx long, refs array<long>, distances array<double>").coalesce(1)
    knn = knn.mapInPandas(seen, knn.schema)
    values = spark.createDataFrame([(s, i, 1, i, float((i * 7 + s) % 5)) for s in range(3) for i in range(6)], "sample_id int, masked_idx long, chrom int, bin int, x double")
    assert cnv_predict.normalise_within(values, knn, float("inf"), 3, save=lambda df, name: df.localCheckpoint()).count() == 18
    assert len(list(tmp_path.glob("run-*"))) == 1


@pytest.mark.parametrize("k", [5, 60])
def test_nearest_rows_on_odd_values(k):
    """Groups of bounds and (many neighbours) single bounds: ties, far rows, large offsets, scales, equal rows, not numbers."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 6))
    odd = x.copy()
    odd[7, 2], odd[90], odd[1400, 0] = np.nan, np.inf, -np.inf
    for rows_ in (x, np.round(x), np.vstack((x, 1e7 * x[:3])), x + 1e7, np.round(x * 9) + 1e14, x * 10.0 ** rng.integers(-9, 9, (1500, 1)), x * 0 + 3, odd):
        idx, target = rng.permutation(len(rows_)) + 1, rows_[::9]
        got_i, got_d = nearest_rows(target, rows_, idx, k)
        for t, i, d in zip(target, got_i, got_d):
            with np.errstate(all="ignore"):
                full = ((rows_ - t) ** 2).sum(axis=1)
            want = np.lexsort((idx, full))[:k]
            assert np.array_equal(i, idx[want]) and np.array_equal(d, full[want], equal_nan=True)
