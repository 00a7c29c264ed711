import numpy as np
import pytest

from binfold.functions.kernels import best_denominator
from binfold.operators import scores


@pytest.mark.parametrize("sizes, samples, sets", [((1, 4), 4096, 4096), ((3, 6), 5, 50), ((2, 9), 4096, 7)])
def test_search_equals_the_kernel(spark, sizes, samples, sets, monkeypatch):
    """Whatever the ranges of sets and the blocks of samples."""
    monkeypatch.setattr(scores, "SAMPLES", samples)
    monkeypatch.setattr(scores, "SETS", sets)
    rng = np.random.default_rng(sum(sizes))
    p, rows, data = 8, [], {}
    for key in ("a", "b"):
        reads = rng.integers(50_000, 100_000, (24, p)).astype(float)
        focus = reads[:, 1] + reads[:, 4] * 0.5 + rng.normal(0, 500, 24)
        data[key] = (reads, focus)
        rows += [(key, float(f), r.tolist()) for r, f in zip(reads, focus)]
    df = spark.createDataFrame(rows, "k string, focus double, reads array<double>")
    got = {r["k"]: r for r in scores.denominator_search(df, {"k": "string"}, p, *sizes).collect()}
    for key, (reads, focus) in data.items():
        chosen, cv = best_denominator(reads, focus, *sizes)
        r = got[key]
        ratio = focus / reads[:, list(chosen)].sum(axis=1)
        assert tuple(r["chosen"]) == chosen and r["n"] == 24
        assert r["cv"] == pytest.approx(cv, rel=1e-9) and r["mean"] == pytest.approx(ratio.mean(), rel=1e-12) and r["sd"] == pytest.approx(ratio.std(ddof=1), rel=1e-9)


def test_sets_without_reads_take_no_part(spark):
    rows = [("a", 10.0 + i, [0.0, 5.0 + i * i, 7.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, focus double, reads array<double>")
    r = scores.denominator_search(df, {"k": "string"}, 3, 1, 1).collect()
    assert [x["chosen"] for x in r] == [[2]]
    assert scores.denominator_search(df, {"k": "string"}, 3, 4, 6).count() == 0
    zero = spark.createDataFrame([("z", 0.0, [0.0, 0.0]), ("z", 0.0, [0.0, 0.0])], "k string, focus double, reads array<double>")
    assert scores.denominator_search(zero, {"k": "string"}, 2, 1, 2).count() == 0
