"""Kernels against naive versions, known values and shapes that must come back."""

import itertools

import numpy as np
import pytest

from binfold.functions import kernels as K


def test_shapiro_known_values():
    # Royston's example weights: W 0.79, small p; a near-normal sample keeps a large p.
    w, p = K.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert abs(w - 0.7888) < 1e-3 and abs(p - 0.00670) < 5e-4
    rng = np.random.default_rng(1)
    ps = [K.shapiro(rng.normal(size=40))[1] for _ in range(200)]
    assert 0.4 < np.mean(ps) < 0.6 and 0.01 < np.mean(np.array(ps) < 0.05) < 0.11
    assert np.isnan(K.shapiro(np.array([1.0, 1.0, 2.0]))[1]) and np.isnan(K.shapiro(np.array([1.0, 2.0]))[1])


def test_loess_follows_a_quadratic():
    x = np.linspace(0, 1, 120)
    assert np.allclose(K.loess(x, 3 + 2 * x - x**2), 3 + 2 * x - x**2, atol=1e-8)
    rng = np.random.default_rng(2)
    noisy = np.sin(6 * x) + rng.normal(0, 0.05, 120)
    assert np.abs(K.loess(x, noisy, 0.3) - np.sin(6 * x)).max() < 0.12


def test_mixture_finds_two_groups():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0.001, 2e-4, 40), rng.normal(0.006, 8e-4, 30)))
    m = K.gmm(x)
    assert np.allclose(sorted(m["mean"][:, 0]), [0.001, 0.006], atol=5e-4)
    cut = K.first_density_minimum(m)
    assert 0.0016 < cut < 0.0045
    with pytest.raises(ValueError):
        K.first_density_minimum(K.gmm(rng.normal(0.01, 0.001, 50)), 0.0, 0.005)


@pytest.mark.parametrize("sd", [1e-3, 1e-4, 1e-5, 1e-6])
def test_cutoff_between_narrow_components(sd):
    """Samples with many reads scatter little: between their components the density is zero in floating point."""
    rng = np.random.default_rng(2)
    low, high = rng.normal(0.004, sd, 20), rng.normal(0.04, sd, 20)
    assert low.max() < K.first_density_minimum(K.gmm(np.concatenate((low, high))), 0.0, 0.1) < high.min()


def test_nearest_rows_equal_brute_force():
    rng = np.random.default_rng(4)
    ref = rng.integers(0, 3, (60, 4)).astype(float)  # many ties
    target, idx = ref[:20] + 0.0, np.arange(60) + 1
    got_i, got_d = K.nearest_rows(target, ref, idx, 7)
    for t, i, d in zip(target, got_i, got_d):
        want = sorted((float(((r - t) ** 2).sum()), int(k)) for r, k in zip(ref, idx))[:7]
        assert list(zip(d, i)) == want
    short_i, short_d = K.nearest_rows(target, ref[:2], idx[:2], 4)
    assert (short_i[:, 2:] == 0).all() and (short_d[:, 2:] == 1).all()


def test_forward_selection_equals_least_squares():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 9))
    y = 2 * x[:, 3] - x[:, 7] + rng.normal(0, 0.1, 40)
    chosen, want = K.forward_selection(y, x, 3), []
    for _ in range(3):
        def rss(c):
            m = np.column_stack((np.ones(40), x[:, [*want, c]]))
            return ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()

        want.append(min((c for c in range(9) if c not in want), key=rss))
    assert chosen == want and chosen[:2] == [3, 7]


def test_best_denominator_equals_brute_force():
    rng = np.random.default_rng(6)
    reads, focus = rng.uniform(100, 200, (12, 7)), rng.uniform(50, 60, 12)
    best = (None, np.inf)
    for size in range(1, 4):
        for s in itertools.combinations(range(7), size):
            r = focus / reads[:, list(s)].sum(axis=1)
            cv = r.std(ddof=1) / r.mean()
            if cv < best[1] - 1e-15:
                best = (s, cv)
    got = K.best_denominator(reads, focus, 1, 3, block=10)
    assert got[0] == best[0] and abs(got[1] - best[1]) < 1e-12
    # Ratios that differ in the 14th digit keep a CV within 1e-12 of the two-pass value.
    tiny = 0.05 + np.arange(2000) * 1e-14
    assert abs(K.best_denominator(np.full((2000, 1), 1e12), 1e12 * tiny, 1, 1)[1] - tiny.std(ddof=1) / tiny.mean()) < 1e-12


def test_forward_selection_stops_without_degrees_of_freedom():
    rng = np.random.default_rng(4)
    assert len(K.forward_selection(rng.normal(size=5), rng.normal(size=(5, 12)), 10)) == 3


def test_best_denominator_in_any_block():
    rng = np.random.default_rng(6)
    reads, focus = rng.uniform(50, 100, (9, 7)), rng.uniform(5, 9, 9)
    assert K.best_denominator(reads, focus, 1, 4) == K.best_denominator(reads, focus, 1, 4, numbers=40)


def test_cbs_finds_a_step():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.05, 200)
    x[80:120] += 0.5
    segs = K.cbs(x, alpha=0.001)
    ends = [e for s in segs for e in s]
    assert any(abs(e - 80) <= 2 for e in ends) and any(abs(e - 120) <= 2 for e in ends)
    assert segs[0][0] == 0 and segs[-1][1] == 200 and all(a[1] == b[0] for a, b in itertools.pairwise(segs))
    assert K.cbs(rng.normal(0, 0.05, 200), alpha=0.001) == [(0, 200)]
    long = rng.normal(0, 0.1, 3000)
    long[1000:1500] -= 0.6
    assert any(abs(s - 1000) <= 3 for s, _ in K.cbs(long, alpha=0.001))


@pytest.mark.parametrize("n, at, width", [(5000, 2503, 5), (5000, 2503, 40), (50000, 20011, 20), (50000, 20011, 150)])
def test_cbs_finds_short_arcs_of_long_stretches(n, at, width):
    x = np.random.default_rng(n + width).normal(0, 0.15, n)
    x[at : at + width] += np.log2(1.5)
    segs = K.cbs(x, alpha=0.01)
    assert any(abs(s - at) <= 2 and abs(e - at - width) <= 2 for s, e in segs) and len(segs) <= 5


def test_cbs_leaves_a_long_stretch_of_noise():
    assert K.cbs(np.random.default_rng(3).normal(0, 0.15, 5000), alpha=0.01) == [(0, 5000)]


def every_arc(x, w):
    """Largest statistic over all arcs, arc length by arc length."""
    d = x - np.average(x, weights=w)
    cw, cx, best = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(w * d))), 0.0
    for k in range(1, len(x)):
        own, s = cw[k:] - cw[:-k], cx[k:] - cx[:-k]
        part = own * (cw[-1] - own)
        best = max(best, float((s[part > 0] ** 2 / part[part > 0]).max(initial=0.0) * cw[-1]))
    return best


@pytest.mark.parametrize("n", [3, 10, 64, 65, 300, 601, 1500, 3000])
def test_best_arc_is_the_best_of_all(n):
    rng = np.random.default_rng(n)
    for kind in range(5):
        x, w = rng.normal(0, 0.15, n), np.ones(n)
        if kind == 1:
            x[n // 3 : n // 3 + max(1, n // 50)] += 0.3
        if kind == 2:
            w = rng.choice([1e-99, 0.2, 1.0, 7.0], n)
        if kind == 3:
            x = np.cumsum(x)
        if kind == 4:
            x[: n // 2] = 0.0
            w = rng.uniform(0.5, 2, n)
        stat, i, j = K.best_arc(x, w)
        assert stat == pytest.approx(every_arc(x, w), rel=1e-9)
        cw, cx = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(w * (x - np.average(x, weights=w)))))
        own = cw[j] - cw[i]
        assert stat == pytest.approx((cx[j] - cx[i]) ** 2 * cw[-1] / (own * (cw[-1] - own)), rel=1e-6)


def test_short_arcs_equal_brute_force():
    rng = np.random.default_rng(12)
    w = rng.uniform(0.5, 2, 40)
    e = rng.normal(size=(3, 40)) * w
    e -= w * (e.sum(axis=1, keepdims=True) / w.sum())
    for longest in (1, 5, 39):
        for row, got in zip(e, K._short_arcs(e, w, longest)):
            want = 0.0
            for i in range(40):
                for k in range(1, longest + 1):
                    arc = np.arange(i, i + k) % 40
                    own = w[arc].sum()
                    want = max(want, row[arc].sum() ** 2 * w.sum() / (own * (w.sum() - own)))
            assert got == pytest.approx(want, rel=1e-9)


def test_arc_tail_is_near_what_noise_does():
    """Long arcs of noise: the formula against 1,500 simulated series."""
    rng, n, shortest = np.random.default_rng(13), 200, 26
    top = []
    for _ in range(1500):
        d = rng.normal(size=n)
        d = (d - d.mean()) / d.std()
        s = np.concatenate(([0], np.cumsum(d)))
        k = np.arange(shortest, n - shortest + 1)
        top.append(max(float(np.abs(s[j:] - s[:-j]).max() / np.sqrt(j * (n - j) / n)) for j in k))
    for b in (2.8, 3.2):
        assert 0.6 < K.arc_tail(b, n, shortest) / np.mean(np.array(top) >= b) < 1.7


def test_cbs_keeps_its_level():
    """Of 200 series of noise about 5 in 100 are split at that level, and a borderline event is found above 300 bins."""
    rng = np.random.default_rng(14)
    assert 2 <= sum(len(K.cbs(rng.normal(size=120), alpha=0.05)) > 1 for _ in range(200)) <= 22
    x = rng.normal(0, 0.15, 3000)
    x[1001:1009] += 0.36
    assert any(abs(s - 1001) <= 2 and abs(e - 1009) <= 2 for s, e in K.cbs(x, alpha=0.01))


def test_a_strong_event_needs_few_permutations():
    import time

    x = np.random.default_rng(15).normal(0, 0.15, 250)
    x[100:120] += 0.2
    began = time.process_time()
    K.cbs(x, alpha=1e-4)
    assert time.process_time() - began < 6


def test_components_equal_svd():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 6))  # bins by samples
    c = x - x.mean(axis=1, keepdims=True)
    vectors, singular = K.gram_components(c.T @ c, 3)
    want = np.linalg.svd(c.T, full_matrices=False)[1][:3]
    assert np.allclose(singular, want) and np.allclose(vectors.T @ vectors, np.eye(3))


def test_unranked_sets_are_the_combinations_in_order():
    for p, size in ((7, 3), (5, 5), (17, 6), (4, 1)):
        want = np.array(list(itertools.combinations(range(p), size)))
        assert (K.unrank_sets(p, size, np.arange(len(want))) == want).all()
