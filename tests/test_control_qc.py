import numpy as np
import pytest

from binfold.functions import kernels as K
from binfold.operators import qc


def test_selection_from_sums_equals_selection_from_rows():
    rng = np.random.default_rng(3)
    for n in (6, 20, 60):
        x = rng.normal(size=(n, 9)) @ rng.normal(size=(9, 9))
        c = x - x.mean(axis=0)
        allowed = np.ones(9, bool)
        allowed[[2, 5]] = False
        assert K.forward_from_gram(c.T @ c, 2, 4, n, allowed) == K.forward_selection(x[:, 2], x, 4, allowed)
    assert K.forward_selection(np.ones(8), rng.normal(size=(8, 3)), 2) == []
    flat = np.zeros((3, 3))
    flat[1, 1] = 4.0
    assert K.forward_from_gram(flat, 0, 2, 9, np.array([False, True, True])) == []


@pytest.mark.parametrize("n", [9, 30])
def test_controls_left_out_equal_refitting(spark, n):
    """Each sample's ratio under models of the same predictors, fitted again without it."""
    rng = np.random.default_rng(n)
    f = rng.normal(0.045, 0.0006, (n, 22))
    f[:, 20] += 0.5 * (f[:, 3] - 0.045) - 0.4 * (f[:, 7] - 0.045)
    rows = [(f"s{i}", c + 1, float(f[i, c])) for i in range(n) for c in range(22)]
    got = qc.regression_controls(spark.createDataFrame(rows, "sample_id string, chrom int, frac double"), [18, 21], 3, 2).collect()
    assert len(got) == n * 6
    ratios = {}
    for r in got:
        i, cols, y = int(r["sample_id"][1:]), [c - 1 for c in r["predictors"]], r["focus"] - 1
        assert not set(r["predictors"]) & {13, 18, 21}
        every = np.column_stack((np.ones(n), f[:, cols]))
        assert r["ratio"] == pytest.approx(f[i, y] / (every[i] @ np.linalg.lstsq(every, f[:, y], rcond=None)[0]), rel=1e-9)
        others = np.delete(np.arange(n), i)
        coef = np.linalg.lstsq(every[others], f[others, y], rcond=None)[0]
        assert r["ratio_out"] == pytest.approx(f[i, y] / (every[i] @ coef), rel=1e-7)
        ratios.setdefault((r["focus"], r["model"]), []).append((r["ratio_out"], r["z_out"]))
    for pairs in ratios.values():
        out = np.array(pairs)
        assert np.allclose(out[:, 1], (out[:, 0] - 1) / out[:, 0].std(ddof=1))


def test_ratio_family(spark):
    rng = np.random.default_rng(5)
    f = rng.normal(0.05, 0.001, (12, 3))
    rows = [(i, c + 1, float(f[i, c])) for i in range(12) for c in range(3)]
    df = spark.createDataFrame(rows, "sample_id int, chrom int, frac double")
    for r in qc.ratio_controls(df).collect():
        rest = np.delete(f[:, r["chrom"] - 1], r["sample_id"])
        own = f[r["sample_id"], r["chrom"] - 1]
        assert r["ratio_out"] == pytest.approx(own / rest.mean()) and r["z_out"] == pytest.approx((own - rest.mean()) / rest.std(ddof=1))
    s = {r["chrom"]: r for r in qc.family_summary(qc.ratio_controls(df), ["chrom"], 1.5).collect()}
    assert s[1]["n"] == 12 and s[2]["max_abs_z"] > 0 and 0 <= s[3]["n_far"] <= 12
