"""Numeric kernels on small arrays, from published descriptions; no Spark here.

Local regression (Cleveland), Shapiro-Wilk (Royston, AS R94), two-component mixtures by EM, PCA through the Gram
matrix, nearest bins, forward selection, denominator search, circular binary segmentation (Olshen; Venkatraman).
"""

from __future__ import annotations

from itertools import combinations
from math import comb
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.75, vertices: int = 400) -> np.ndarray:
    """Local quadratic fit with tricube weights at every x.

    Fits are made at distinct x values, at most ``vertices`` of them (evenly spaced quantiles), with linear
    interpolation between. ``span`` is the share of points in a neighbourhood.
    """
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    at = np.unique(xs)
    if len(at) > vertices:
        at = np.unique(np.quantile(at, np.linspace(0, 1, vertices), method="nearest"))
    k = max(3, min(len(xs), int(np.ceil(span * len(xs)))))
    out = np.empty(len(at))
    lo = 0
    for i, v in enumerate(at):
        while lo + k < len(xs) and v - xs[lo] > xs[lo + k] - v:
            lo += 1
        dx, yy = xs[lo : lo + k] - v, ys[lo : lo + k]
        width = max(abs(dx[0]), abs(dx[-1])) * (1 if span <= 1 else span)
        if width == 0:
            out[i] = yy.mean()
            continue
        w = np.sqrt(np.clip(1 - np.clip(np.abs(dx) / width, 0, 1) ** 3, 0, None) ** 3)
        m = np.stack((np.ones(k), dx / width, (dx / width) ** 2), axis=1)
        out[i] = np.linalg.lstsq(m * w[:, None], yy * w, rcond=None)[0][0]
    return np.interp(x, at, out)


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """W and p for 3 to 5000 values with at least 3 distinct ones; NaN otherwise."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or n > 5000 or not np.isfinite(x).all() or len(np.unique(x)) < 3:
        return float("nan"), float("nan")
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = (m**2).sum(), 1 / np.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[2] = np.sqrt(0.5)
    else:
        c = m / np.sqrt(ss)
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / np.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / np.sqrt(phi)
        a[-1] = last
    a[0] = -a[-1]
    w = min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        return w, max(0.0, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    y, ln = np.log(1 - w), np.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 0.0
        y = -np.log(g - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = np.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = np.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - _NORMAL.cdf((y - mu) / sd)


def gmm(x: np.ndarray, equal_mixing: bool = False, rounds: int = 500, tol: float = 1e-10) -> dict:
    """Two Gaussian components, each with a covariance of its own, by EM from a fixed start.

    The start parts the points at the largest gap between neighbours in the last column that leaves at least a tenth of
    them on either side, so the result does not depend on chance. Returns weights, means, covariances, responsibilities.
    """
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    n, d = x.shape
    if n < 4:
        raise ValueError("a mixture needs at least 4 points")
    order = np.argsort(x[:, -1], kind="stable")
    v, edge = x[order, -1], max(1, n // 10)
    gaps = np.diff(v)[edge - 1 : n - edge]
    first = np.zeros(n, bool)
    first[order[: edge + int(np.argmax(gaps))]] = True
    resp = np.stack((first, ~first), axis=1).astype(float)
    ridge = 1e-6 * np.maximum(x.var(axis=0), 1e-18)
    before = -np.inf
    for _ in range(rounds):
        nk = resp.sum(axis=0) + 1e-12
        weight = np.full(2, 0.5) if equal_mixing else nk / n
        mean = (resp.T @ x) / nk[:, None]
        cov = np.stack([((resp[:, k, None] * (x - mean[k])).T @ (x - mean[k])) / nk[k] + np.diag(ridge) for k in range(2)])
        logp = np.stack([np.log(weight[k] + 1e-300) - 0.5 * (np.einsum("ni,ij,nj->n", x - mean[k], np.linalg.inv(cov[k]), x - mean[k]) + np.linalg.slogdet(cov[k])[1] + d * np.log(2 * np.pi)) for k in range(2)], axis=1)
        top = logp.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        resp = np.exp(logp - total[:, None])
        if abs(total.sum() - before) < tol * (1 + abs(before)):
            break
        before = total.sum()
    return {"weight": weight, "mean": mean, "cov": cov, "resp": resp, "loglik": float(total.sum())}


def gmm_classify(model: dict, x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    score = np.stack([np.log(model["weight"][k] + 1e-300) - 0.5 * (np.einsum("ni,ij,nj->n", x - model["mean"][k], np.linalg.inv(model["cov"][k]), x - model["mean"][k]) + np.linalg.slogdet(model["cov"][k])[1]) for k in range(2)], axis=1)
    return score.argmax(axis=1)


def first_density_minimum(model: dict, lo: float = 0.0, hi: float = 0.02, points: int = 5000) -> float:
    """First local minimum of a 1-D mixture's density on a grid; an error if there is none.

    Logarithms are compared: between two narrow components the density itself is zero in floating point.
    """
    grid = np.linspace(lo, hi, points)
    y = np.logaddexp(*[np.log(model["weight"][k] + 1e-300) - 0.5 * ((grid - model["mean"][k][0]) ** 2 / model["cov"][k][0, 0] + np.log(2 * np.pi * model["cov"][k][0, 0])) for k in range(2)])
    step = np.sign(np.diff(y))
    moves = np.flatnonzero(step)  # equal neighbours at the bottom are passed over
    turn = moves[:-1][np.diff(step[moves]) == 2]
    if not len(turn):
        raise ValueError("the density has no local minimum; give yfrac")
    return float(grid[turn[0] + 1])


def gram_components(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors (samples x k) and singular values of a centred samples-by-samples Gram matrix."""
    value, vector = np.linalg.eigh(gram)
    order = np.argsort(value)[::-1][:k]
    keep = [i for i in order if value[i] > 1e-12 * max(value.max(), 1e-300)]
    return vector[:, keep], np.sqrt(value[keep])


def nearest_rows(target: np.ndarray, ref: np.ndarray, ref_idx: np.ndarray, k: int, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """k nearest rows by squared distance, ties to the smaller index; short lists are filled with index 0, distance 1.

    Products in single precision, less the most that rounding can add, bound the distances from below; the least of each
    32 of them and what rounding can take bound the kth distance from above. What lies between is computed directly.
    """
    m, (n, width) = len(target), ref.shape
    out_i, out_d = np.zeros((m, k), np.int64), np.ones((m, k))
    if not n or not m:
        return out_i, out_d
    ok, fine = np.isfinite(ref).all(axis=1), np.isfinite(target).all(axis=1)
    mid = np.median(ref[ok][:: 1 + n // 1000], axis=0) if ok.any() else np.zeros(width)
    with np.errstate(invalid="ignore"):  # rows with other than numbers are zeros here, and always computed
        r, t = np.where(ok[:, None], ref - mid, 0.0), np.where(fine[:, None], target - mid, 0.0)
    size = max(np.abs(r).max(), np.abs(t).max()) or 1.0
    r, t = r / size, t / size
    least = 1e-9 * np.sqrt(width) * max(1.0, np.abs(mid).max() / size)  # what centring loses
    rn, tn = np.maximum(np.sqrt(np.einsum("ij,ij->i", r, r)), least), np.sqrt(np.einsum("ij,ij->i", t, t))
    eps = 4 * (width + 8) * 2.0**-24
    group = 32 if n >= 128 * k else 1
    tile, step = (tile, 256) if group > 1 else (n, max(1, min(256, (1 << 20) // n)))
    order = np.argsort(np.where(ok, rn, np.inf), kind="stable")  # rows of a group round alike
    right = np.zeros((-(-n // group) * group, width + 2), np.float32)
    right[:n, :width], right[:n, width] = r[order], np.where(ok, np.einsum("ij,ij->i", r, r) - eps * rn**2, -1e30)[order]
    right[:n, width + 1], right[n:, width] = rn[order], 1e30
    left = np.hstack((-2 * t, np.ones((m, 1)), -2 * eps * tn[:, None])).astype(np.float32)
    most = np.append(np.where(ok, rn, np.inf)[order], np.zeros(len(right) - n)).reshape(-1, group).max(axis=1)
    flat, steep = (2 * eps * most**2).astype(np.float32), (4 * eps * most).astype(np.float32)
    for lo in range(0, m, step):
        q, qn, odd = left[lo : lo + step].T, np.maximum(tn[lo : lo + step], 1e-30).astype(np.float32), ~fine[lo : lo + step]
        best, held, count = np.full((k, q.shape[1]), np.inf, np.float32), [], 0
        done = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def settle(done: tuple, held: list, bound: np.ndarray) -> tuple:
            """The k best, by exact distance, of those settled before and those held."""
            row, col, low = (np.concatenate(c) for c in zip(*held))
            near = np.flatnonzero((low <= bound[row]) & (col < n))
            row, col = row[near], order[col[near]]
            parts = [((ref[col[i : i + 2048]] - target[lo + row[i : i + 2048]]) ** 2).sum(axis=1) for i in range(0, len(row), 2048)]  # noqa: B023
            row, idx, d = np.append(done[0], row), np.append(done[1], ref_idx[col]), np.concatenate((done[2], *parts))
            by = np.lexsort((idx, d, row))
            by = by[np.arange(len(row)) - np.searchsorted(row[by], row[by]) < k]
            return row[by], idx[by], d[by]

        for at in range(0, len(right), tile):
            p = (right[at : at + tile] @ q).reshape(-1, group, q.shape[1])
            low, g = p.min(axis=1), slice(at // group, at // group + len(p))
            high = low + (flat[g, None] + steep[g, None] * qn)
            closer = np.flatnonzero((high < best[-1]).any(axis=0))
            if len(closer):
                best[:, closer] = np.partition(np.concatenate((best[:, closer], high[:, closer])), k - 1, axis=0)[:k]
            bound = np.where(odd, np.float32(np.inf), best[-1])
            gi, ti = np.nonzero(low <= bound)
            found = p[gi, :, ti]
            hit, off = np.nonzero(found <= bound[ti, None])
            held.append((ti[hit], at + gi[hit] * group + off, found[hit, off]))
            count += len(hit)
            if count > 1 << 20:
                done, held, count = settle(done, held, bound), [], 0
        if held:
            done = settle(done, held, bound)
        row, idx, d = done
        place = np.arange(len(row)) - np.searchsorted(row, row)
        out_i[lo + row, place], out_d[lo + row, place] = idx, d
    return out_i, out_d


def forward_selection(y: np.ndarray, x: np.ndarray, n_steps: int, allowed: np.ndarray | None = None, blocks: dict[int, set[int]] | None = None) -> list[int]:
    """Columns of x in the order in which they raise adjusted R2 most; ties to the smaller column.

    Residuals are kept orthogonal to what was chosen, so a step costs one pass over the candidates. ``blocks``: columns
    that a chosen column rules out. The search ends where a further column would leave no degree of freedom.
    """
    open_ = np.ones(x.shape[1], bool) if allowed is None else allowed.copy()
    r, q = y - y.mean(), x - x.mean(axis=0)
    if (r**2).sum() < 1e-15:  # a response that does not vary has nothing to be explained
        return []
    scale = (q**2).sum(axis=0)
    out: list[int] = []
    for _ in range(min(n_steps, len(y) - 2)):
        norm = (q**2).sum(axis=0)
        usable = open_ & (norm > 1e-12 * np.maximum(scale, 1e-300))
        if not usable.any():
            break
        gain = np.where(usable, (q.T @ r) ** 2 / np.where(usable, norm, 1), -np.inf)
        best = int(np.argmax(gain))
        out.append(best)
        open_[best] = False
        for other in (blocks or {}).get(best, ()):
            open_[other] = False
        unit = q[:, best] / np.sqrt(norm[best])
        r = r - unit * (unit @ r)
        q = q - unit[:, None] * (unit @ q)
    return out


def unrank_sets(p: int, size: int, ranks: np.ndarray) -> np.ndarray:
    """The sets of ``size`` of ``p`` columns at the given places of their lexicographic order, one row each."""
    left, out, least = np.asarray(ranks, np.int64).copy(), np.empty((len(ranks), size), np.int64), np.zeros(len(ranks), np.int64)
    for at in range(size):
        # Sets with this column here are as many as ways to choose the rest from the columns after it.
        ways = np.array([comb(p - 1 - c, size - 1 - at) for c in range(p)], np.int64)
        upto = np.concatenate(([0], np.cumsum(ways)))
        column = np.searchsorted(upto, left + upto[least], side="right") - 1
        left -= upto[column] - upto[least]
        out[:, at], least = column, column + 1
    return out


def best_denominator(reads: np.ndarray, focus: np.ndarray, min_size: int, max_size: int, block: int | None = None, numbers: int = 4_000_000) -> tuple[tuple[int, ...], float]:
    """Set of columns whose sum makes the ratio focus / sum vary least (sample SD over mean) across rows.

    All sets of min_size to max_size columns, smaller and lexicographically earlier sets first on ties. ``block`` sets are
    held at once, else as many as make ``numbers`` values over all rows.
    """
    best, best_cv = (), np.inf
    p = reads.shape[1]
    for size in range(min_size, min(max_size, p) + 1):
        sets, at_once = combinations(range(p), size), block or max(1, numbers // (size * max(1, len(reads))))
        for _ in range(0, comb(p, size), at_once):
            part = np.array([s for _, s in zip(range(at_once), sets)])
            if not len(part):
                break
            with np.errstate(all="ignore"):
                ratio = focus[:, None] / reads[:, part].sum(axis=2)
                cv = ratio.std(axis=0, ddof=1) / ratio.mean(axis=0)
            cv = np.where(np.isfinite(cv), cv, np.inf)
            i = int(np.argmin(cv))
            if cv[i] < best_cv:
                best, best_cv = tuple(int(c) for c in part[i]), float(cv[i])
    return best, best_cv


def _all_arcs(cw: np.ndarray, cx: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[float, int, int]:
    """Best statistic over arcs [i, j), i of ``rows`` and j of ``cols``, i < j and not the whole; and the arc."""
    total = cw[-1]
    size = cw[cols][None, :] - cw[rows][:, None]
    part = size * (total - size)
    ok = (rows[:, None] < cols[None, :]) & (part > 0)
    s = cx[cols][None, :] - cx[rows][:, None]
    stat = np.divide(s * s, part, out=np.full(s.shape, -1.0), where=ok)
    at = int(np.argmax(stat))
    return float(stat.flat[at]) * total, int(rows[at // len(cols)]), int(cols[at % len(cols)])


def best_arc(x: np.ndarray, w: np.ndarray) -> tuple[float, int, int]:
    """The arc [i, j) of any length with the largest weighted t-like statistic, exactly; also the statistic.

    With S the running sum of weighted residuals and W an arc's weight of all T, the statistic is
    (S_j - S_i)^2 T / (W (T - W)). Ends are dealt to blocks. The extremes of S in two blocks, and the least and largest
    weight between them, bound all arcs from one to the other; so does the largest residual, where arcs are short.
    Block pairs are opened from the highest bound down until none can beat the best arc found.
    """
    n = len(x)
    d = x - np.average(x, weights=w)
    cw, cx = np.concatenate(([0.0], np.cumsum(w))), np.concatenate(([0.0], np.cumsum(w * d)))
    total, points = cw[-1], np.arange(n + 1)
    step = max(16, int(np.sqrt(n)) // 2)
    if n <= 4 * step:
        stat, i, j = _all_arcs(cw, cx, points, points)
        return (stat, i, j) if stat > 0 else (0.0, 0, n)
    cut = np.arange(0, n + 1, step)
    last = np.append(cut[1:], n + 1) - 1
    low, high = np.minimum.reduceat(cx, cut), np.maximum.reduceat(cx, cut)
    # Ends where S is extreme within its block give a first arc to beat.
    ends = np.unique(np.concatenate([[c + int(np.argmin(cx[c : e + 1])), c + int(np.argmax(cx[c : e + 1]))] for c, e in zip(cut, last)]))
    best = _all_arcs(cw, cx, ends, ends)
    one, two = np.triu_indices(len(cut))
    reach = np.maximum(high[two] - low[one], high[one] - low[two])
    least, most = np.maximum(cw[cut[two]] - cw[last[one]], 0.0), np.minimum(cw[last[two]] - cw[cut[one]], total)
    steep = np.abs(d).max()
    with np.errstate(divide="ignore", invalid="ignore"):
        wide = reach**2 * total / np.minimum(least * (total - least), most * (total - most))
        short, rest = reach * steep * total / (total - most), reach * steep * total / least
    bound = np.fmin(np.fmin(np.where(wide >= 0, wide, np.inf), np.where(total > most, short, np.inf)), np.where(least > 0, rest, np.inf))
    order = np.argsort(-bound)
    for k in order.tolist():
        if bound[k] * (1 + 1e-12) < best[0]:
            break
        found = _all_arcs(cw, cx, points[cut[one[k]] : last[one[k]] + 1], points[cut[two[k]] : last[two[k]] + 1])
        best = max(best, found, key=lambda f: f[0])
    return best if best[0] > 0 else (0.0, 0, n)


def arc_tail(b: float, n: int, shortest: int) -> float:
    """Chance that pure noise of ``n`` bins has an arc of ``shortest`` bins or more (and as many left) with |Z| >= ``b``.

    Siegmund's tail of the largest circular arc, as segmentation programs use it, in place of permutations.
    """
    t0 = min(0.5, shortest / n)
    edge = np.linspace(0.5, 1 - t0, 101)
    mid = (edge[1:] + edge[:-1]) / 2
    step = b / np.sqrt(n * mid * (1 - mid))
    cdf = np.array([_NORMAL.cdf(v / 2) for v in step])
    pdf = np.exp(-(step**2) / 8) / np.sqrt(2 * np.pi)
    nu = 2 / step * (cdf - 0.5) / (step / 2 * cdf + pdf)
    area = (edge[1:] - edge[:-1]) / (mid * (1 - mid)) ** 2
    return float(b**3 * np.exp(-b * b / 2) / np.sqrt(2 * np.pi) / 2 * (nu**2 * area).sum())  # both signs


def _short_arcs(e: np.ndarray, w: np.ndarray, longest: int) -> np.ndarray:
    """Best statistic of arcs of up to ``longest`` bins, also around the end, of each row of residuals ``e`` (sums are 0)."""
    n, total = len(w), w.sum()
    longest = min(longest, n - 1)
    cw = np.concatenate(([0.0], np.cumsum(np.concatenate((w, w[:longest])))))
    around = np.concatenate((e, e[:, :longest]), axis=1)
    cx = np.concatenate((np.zeros((len(e), 1)), np.cumsum(around, axis=1)), axis=1)
    best = np.zeros(len(e))
    for k in range(1, longest + 1):
        own = cw[k : n + k] - cw[:n]
        part = own * (total - own)
        s = cx[:, k : n + k] - cx[:, :n]
        stat = np.divide(s * s, part, out=np.zeros(s.shape), where=part > 0)
        best = np.maximum(best, stat.max(axis=1) * total)
    return best


def arc_is_real(x: np.ndarray, w: np.ndarray, stat: float, alpha: float, rng: np.random.Generator, shortest_long: int = 25) -> bool:
    """Whether noise has an arc as good as ``stat`` less often than ``alpha``.

    Long arcs have a formula; for arcs of up to ``shortest_long`` bins, also around the end, seeded permutations are
    counted in blocks, and stop once the answer is fixed. In stretches of up to twice that length all arcs are short.
    """
    n = len(x)
    root = np.sqrt(w)
    e = (x - np.average(x, weights=w)) * root
    spread = float(e @ e)
    left = spread - stat
    # Far beyond what chance allows by the Bonferroni bound over all arcs: nothing has to be counted.
    strong = stat / max(left, 1e-300) * (n - 2)
    if n > 20 and (1 - _NORMAL.cdf(min(np.sqrt(strong), 37.0))) * float(n) ** 2 < alpha / 10:
        return True
    longest = n - 1 if n <= 2 * shortest_long else shortest_long
    allowed = alpha - (arc_tail(np.sqrt(stat * (n - 1) / spread), n, longest + 1) if longest < n - 1 else 0.0)
    if allowed <= 0:
        return False
    permutations = max(100, int(np.ceil(1 / alpha)))
    most, reached, done = int(allowed * permutations), 0, 0
    while done < permutations and reached <= most:
        block = min(permutations - done, max(1, 2_000_000 // n))
        mixed = rng.permuted(np.tile(e, (block, 1)), axis=1) * root
        mixed -= w * (mixed.sum(axis=1, keepdims=True) / w.sum())
        reached += int(np.count_nonzero(_short_arcs(mixed, w, longest) >= stat))
        done += block
    return reached <= most


def cbs(x: np.ndarray, w: np.ndarray | None = None, alpha: float = 1e-4, seed: int = 1, min_width: int = 2) -> list[tuple[int, int]]:
    """Circular binary segmentation: half-open segments of positions.

    A segment is split at its best arc, which is searched exactly at any length, when noise has one as good less often
    than ``alpha``. Cuts closer than ``min_width`` to an end are left out.
    """
    w = np.ones(len(x)) if w is None else np.asarray(w, float)
    x = np.asarray(x, float)
    rng = np.random.default_rng(seed)
    cuts, todo = {0, len(x)}, [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a < max(3, 2 * min_width) or np.ptp(x[a:b]) == 0:
            continue
        stat, i, j = best_arc(x[a:b], w[a:b])
        inner = [p for p in (i, j) if min_width <= p <= b - a - min_width]
        if len(inner) == 2 and inner[1] - inner[0] < min_width:
            inner = inner[:1]
        if not inner or not arc_is_real(x[a:b], w[a:b], stat, alpha, rng):
            continue
        ends = [a, *(a + p for p in inner), b]
        cuts.update(ends)
        todo += list(zip(ends, ends[1:]))
    ends = sorted(cuts)
    return [(s, e) for s, e in zip(ends, ends[1:]) if e > s]


def forward_from_gram(gram: np.ndarray, y: int, n_steps: int, n: int, allowed: np.ndarray, blocks: dict[int, set[int]] | None = None) -> list[int]:
    """``forward_selection`` from sums alone: ``gram`` holds the centred products of all columns over ``n`` rows.

    A chosen column is swept out of the matrix, which leaves the products of residuals, so a step takes no row.
    """
    g, open_, scale = gram.astype(float).copy(), allowed.copy(), np.diag(gram).astype(float).copy()
    out: list[int] = []
    if scale[y] < 1e-15:
        return out
    for _ in range(min(n_steps, n - 2)):
        norm = np.diag(g)
        usable = open_ & (norm > 1e-12 * np.maximum(scale, 1e-300))
        if not usable.any():
            break
        gain = np.where(usable, g[:, y] ** 2 / np.where(usable, norm, 1), -np.inf)
        best = int(np.argmax(gain))
        out.append(best)
        open_[[best, *(blocks or {}).get(best, ())]] = False
        g = g - np.outer(g[:, best], g[best]) / g[best, best]
    return out
