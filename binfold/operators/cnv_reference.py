"""Copy-number reference: gender, masks, PCA ratio, nearest bins and null ratios.

The cohort matrix is kept with a row per bin and the samples as one array (``masked_idx, chrom, bin, x``): arrays are
as long as the cohort (hundreds), rows as many as the genome has bins, so every step is a pass over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.kernels import first_density_minimum, gmm, gram_components, nearest_rows
from binfold.functions.safe import is_finite, safe_div
from binfold.operators.bins import masked_rank, normalised

BRANCHES = {"A": 22, "F": 23, "M": 24}


def y_fraction(bins: DataFrame, value: str = "n") -> DataFrame:
    """Y reads over all reads of the 24 chromosomes; a sample without reads is an error."""
    out = bins.groupBy("sample_id").agg(F.sum(value).alias("total"), F.sum(F.when(F.col("chrom") == 24, F.col(value))).alias("y"))
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(F.raise_error(F.lit("a sample has no reads")).cast("long"))
    return out.select("sample_id", F.coalesce(safe_div("y", total), F.lit(0.0)).alias("y_frac"))


def gender_cutoff(fractions: DataFrame, yfrac: float | None = None, grid_min: float = 0.0, grid_max: float = 0.02, points: int = 5000) -> float:
    """First density minimum of a two-component mixture over Y fractions, unless ``yfrac`` sets it. A row per sample."""
    if yfrac is not None:
        return yfrac
    return first_density_minimum(gmm(fractions.orderBy("sample_id").toPandas()["y_frac"].to_numpy(float)), grid_min, grid_max, points)


def predict_gender(fractions: DataFrame, cutoff: float) -> DataFrame:
    return fractions.withColumn("gender", F.when(F.col("y_frac") > cutoff, "M").otherwise("F"))


def gender_correct(bins: DataFrame, genders: DataFrame, value: str = "n", nipt: bool = False) -> DataFrame:
    """Double X and Y of males, unless in NIPT mode; genders have a row per sample."""
    out = bins.join(genders.select("sample_id", "gender"), "sample_id")
    if nipt:
        return out
    return out.withColumn(value, F.when((F.col("chrom") >= 23) & (F.col("gender") == "M"), F.col(value) * 2).otherwise(F.col(value)))


def coverage_mask(bins: DataFrame, share: float = 0.05, value: str = "n") -> DataFrame:
    """``chrom, bin, keep``: summed normalised coverage above a share of the median of positive sums."""
    sums = normalised(bins, value).groupBy("chrom", "bin").agg(F.sum("x").alias("s"))
    cut = sums.where("s > 0").agg((F.median("s") * share).alias("cut"))
    return sums.join(F.broadcast(cut)).select("chrom", "bin", (F.col("s") > F.col("cut")).alias("keep"))


def reference_mask(bins: DataFrame, genders: DataFrame, share: float = 0.05, min_female: int = 5, min_male: int = 5, nipt: bool = False, value: str = "n") -> DataFrame:
    """AND of the masks of cohort, females and males; a sex below its minimum is left out, males also in NIPT mode."""
    counts = {r["gender"]: r["count"] for r in genders.groupBy("gender").count().collect()}
    out = coverage_mask(bins, share, value)
    joined = bins.drop("gender").join(genders.select("sample_id", "gender"), "sample_id")
    for g, least, use in (("F", min_female, True), ("M", min_male, not nipt)):
        if use and counts.get(g, 0) >= least:
            one = coverage_mask(joined.where(F.col("gender") == g), share, value).withColumnRenamed("keep", "_k")
            out = out.join(one, ["chrom", "bin"], "left").select("chrom", "bin", (F.col("keep") & F.coalesce("_k", F.lit(False))).alias("keep"))
    return out


def branch_matrix(bins: DataFrame, mask: DataFrame, branch: str = "A", value: str = "n") -> DataFrame:
    """``masked_idx, chrom, bin, x``: normalised over the branch's chromosomes before masking; x is ordered by sample."""
    top = BRANCHES[branch]
    x = normalised(bins, value, top).groupBy("chrom", "bin").agg(F.array_sort(F.collect_list(F.struct("sample_id", "x"))).alias("s"))
    rank = masked_rank(mask.where(F.col("chrom") <= top))
    return rank.join(x, ["chrom", "bin"]).select("masked_idx", "chrom", "bin", F.transform("s", lambda e: e["x"]).alias("x"))


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, 0))


def train_pca(matrix: DataFrame, components: int = 5) -> tuple[DataFrame, np.ndarray]:
    """PCA over samples as rows and bins as columns, centred, unscaled, by the samples-by-samples Gram matrix.

    Each partition sums the outer products of its bins, the sums of partitions are added in the cluster, and one matrix
    (samples squared) comes to the driver. Returns ``masked_idx, mean, loading`` and the sample scores.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                x = _stack(f["x"])
                x = x - x.mean(axis=1, keepdims=True)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.tril_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = matrix.select("x").mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    n = int(cells["i"].max()) + 1
    gram = np.zeros((n, n))
    gram[cells["i"], cells["j"]] = gram[cells["j"], cells["i"]] = cells["v"]
    vectors, singular = gram_components(gram, components)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _stack(f["x"])
                mean = x.mean(axis=1)
                yield pd.DataFrame({"masked_idx": f["masked_idx"], "mean": mean, "loading": list((x - mean[:, None]) @ vectors / singular)})

    return matrix.select("masked_idx", "x").mapInPandas(load, "masked_idx long, mean double, loading array<double>"), vectors * singular


def pca_ratio(matrix: DataFrame, model: DataFrame, scores: np.ndarray) -> DataFrame:
    """Each value over its reconstruction from the components (the sign of a component cancels)."""
    rows = [[float(v) for v in s] for s in scores]
    sc = F.array(*[F.array(*[F.lit(v) for v in s]) for s in rows])
    rebuilt = lambda s, m, load: m + F.aggregate(F.zip_with(s, load, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    out = matrix.join(model, "masked_idx").withColumn("x", F.zip_with("x", sc, lambda v, s: F.coalesce(F.try_divide(v, rebuilt(s, F.col("mean"), F.col("loading"))), F.lit(0.0))))
    return out.select("masked_idx", "chrom", "bin", "x")


def distance_outliers(corrected: DataFrame, branch: str = "A", multiplier: dict | None = None, floor: dict | None = None, min_bins: int = 10) -> DataFrame:
    """Bins of a class (autosomes, X, Y) whose squared distance to the class's median profile is too large.

    Cutoff: the larger of the floor and median + multiplier times the scaled MAD. Medians per sample and class, then
    one distance per bin.
    """
    multiplier, floor = multiplier or {"auto": 20.0, "X": 20.0, "Y": 50.0}, floor or {"auto": 10.0, "X": 10.0, "Y": 15.0}
    cls = F.when(F.col("chrom") <= 22, "auto").when(F.col("chrom") == 23, "X").otherwise("Y")
    use = {"A": ["auto"], "F": ["X"], "M": ["X", "Y"]}[branch]
    rows = corrected.withColumn("cls", cls).where(F.col("cls").isin(use))
    long = rows.select("cls", "masked_idx", F.posexplode("x").alias("i", "v"))
    med = long.groupBy("cls", "i").agg(F.median("v").alias("m"))
    dist = long.join(med, ["cls", "i"]).groupBy("cls", "masked_idx").agg(F.sum((F.col("v") - F.col("m")) ** 2).alias("d"))
    center = dist.groupBy("cls").agg(F.median("d").alias("c"), F.count("*").alias("bins"))
    spread = dist.join(F.broadcast(center), "cls").groupBy("cls").agg((F.median(F.abs(F.col("d") - F.col("c"))) * 1.4826).alias("mad"), F.max("c").alias("c"), F.max("bins").alias("bins"))
    pick = lambda d: F.when(F.col("cls") == "auto", d["auto"]).when(F.col("cls") == "X", d["X"]).otherwise(d["Y"])
    cut = spread.where(F.col("bins") >= min_bins).withColumn("cutoff", F.greatest(F.col("c") + pick(multiplier) * F.col("mad"), pick(floor)))
    return dist.join(F.broadcast(cut.select("cls", "cutoff")), "cls").where(F.col("d") > F.col("cutoff")).select("masked_idx", "d", "cutoff")


#: Parts of the bins that meet in pairs, as long as a part fits in memory.
SIDES = 8


def _rows(col: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(col), -1)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def part_sizes(n: int, width: int, block: int | None, ref_bytes: int) -> tuple[int, int]:
    """Targets in a block and bins in a chunk."""
    fit = max(1, ref_bytes // (8 * max(1, width)))
    if block is not None:
        return block, max(block, fit)
    own = max(1024, min(-(-n // SIDES), fit))
    return own, own


def knn_bins(matrix: DataFrame, k: int = 300, branch: str = "A", block: int | None = None, ref_bytes: int = 32 << 20) -> DataFrame:
    """``masked_idx, refs, distances``: each bin's k nearest bins on other chromosomes, ties to the smaller index.

    Blocks of targets meet chunks of bins, and the best of each chunk are merged. Both are an eighth of the bins, so each
    bin is sent 16 times, until an eighth is more than ``ref_bytes``: then they are what fits. With ``block`` targets
    in a block, chunks are what fits. Short lists are filled with index 0, distance 1. In the F and M branches targets
    on chromosomes 1 to 21 are skipped and keep such lists (22 is computed). Bins without a chromosome take no part.
    """
    matrix = matrix.where(F.col("chrom").isNotNull())
    top, width = matrix.agg(F.max("masked_idx"), F.max(F.size("x"))).first()
    top, width = top or 0, width or 1
    block, per_chunk = part_sizes(top + 1, width, block, ref_bytes)
    blocks, chunks = 1 + top // block, 1 + top // per_chunk
    skip = branch != "A"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, out = ["masked_idx", "refs", "distances"], []
        ref = _rows(right["ref_x"]) if len(left) and len(right) else None
        idx, of = right["ref_idx"].to_numpy(), left["chrom"].to_numpy()
        for c in np.unique(of) if ref is not None else ():
            own = np.flatnonzero(of == c)
            if skip and c < 22:
                refs, dist = np.zeros((len(own), k), np.int64), np.ones((len(own), k))
            else:
                other = right["ref_chrom"].to_numpy() != c
                refs, dist = nearest_rows(_rows(left["x"].take(own)), ref[other], idx[other] + 1, k)
            out.append(pa.Table.from_arrays([left["masked_idx"].take(own).cast(pa.int64()), _lists(refs), _lists(dist)], names))
        return pa.concat_tables(out) if out else pa.table({"masked_idx": pa.array([], pa.int64()), "refs": pa.array([], pa.list_(pa.int64())), "distances": pa.array([], pa.list_(pa.float64()))})

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    targets = matrix.select("masked_idx", "chrom", "x", F.floor(F.col("masked_idx") / block).cast("int").alias("block"), every(chunks, "chunk"))
    copies = matrix.select(F.col("masked_idx").alias("ref_idx"), F.col("chrom").alias("ref_chrom"), F.col("x").alias("ref_x"), F.floor(F.col("masked_idx") / per_chunk).cast("int").alias("chunk"), every(blocks, "block"))
    found = targets.groupBy("block", "chunk").cogroup(copies.groupBy("block", "chunk")).applyInArrow(run, "masked_idx long, refs array<long>, distances array<double>")
    if chunks == 1:
        return found
    pairs = F.filter(F.arrays_zip("distances", "refs"), lambda p: p["refs"] > 0)
    best = F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k)
    merged = found.groupBy("masked_idx").agg(best.alias("p"))
    fill = lambda c, v: F.concat(F.transform("p", lambda p: p[c]), F.array_repeat(F.lit(v), k - F.size("p")))
    return merged.select("masked_idx", fill("refs", 0).cast("array<bigint>").alias("refs"), fill("distances", 1.0).alias("distances"))


def null_ratios(matrix: DataFrame, knn: DataFrame, max_samples: int = 100, seed: int = 1) -> DataFrame:
    """``masked_idx, null_id, ratio``: log2 of a sampled column over the median of its positive reference values; else 0.

    Columns are chosen by seeded hash. Values are gathered by a join on the reference index.
    """
    n = len(matrix.first()["x"])
    chosen = sorted(range(n), key=lambda i: hash((seed * 1_000_003 + i) * 2_654_435_761 % 2**32))[:max_samples]
    long = matrix.select("masked_idx", F.posexplode("x").alias("null_id", "v")).where(F.col("null_id").isin(chosen))
    refs = knn.select(F.col("masked_idx").alias("target"), F.explode("refs").alias("ref")).where("ref > 0")
    med = refs.join(long.withColumn("ref", F.col("masked_idx") + 1), "ref").groupBy(F.col("target").alias("masked_idx"), "null_id").agg(F.median(F.when(F.col("v") > 0, F.col("v"))).alias("m"))
    out = long.join(med, ["masked_idx", "null_id"], "left").select("masked_idx", "null_id", F.when((F.col("v") > 0) & (F.col("m") > 0), F.log2(F.col("v") / F.col("m"))).otherwise(0.0).alias("ratio"))
    return out


def rescale_to(bins: DataFrame, sizes: DataFrame, binsize: int, value: str = "n") -> DataFrame:
    """Samples binned at their own size (``sample_id, binsize``; divisors of ``binsize``) summed to one size."""
    own = bins.join(sizes.select("sample_id", F.col("binsize").alias("_own")), "sample_id")
    step = F.when(F.lit(binsize) % F.col("_own") == 0, F.lit(binsize) / F.col("_own")).otherwise(F.raise_error(F.lit("a sample's bin size does not divide the reference's")).cast("double"))
    return own.groupBy("sample_id", "chrom", F.floor(F.col("bin") / step).cast("int").alias("bin")).agg(F.sum(value).alias(value))


def newref(bins: DataFrame, nipt: bool = False, refsize: int = 300, yfrac: float | None = None, components: int = 5, max_null: int = 100, value: str = "n", branches: tuple[str, ...] | None = None, min_samples: int = 10, min_female: int = 5, min_male: int = 5, sample_binsizes: DataFrame | None = None, binsize: int | None = None, outliers: dict | None = None, save=None) -> dict[str, DataFrame]:
    """Reference tables by branch: ``bins, knn, null_ratio`` with a ``branch`` column, and ``mask, genders, meta``.

    F and M are built independently, each from the samples of its sex and from the mask that A's pruning left; what F
    prunes M keeps. A sex below its minimum has no branch; in NIPT mode there is no M, and too few female samples are
    an error. ``sample_binsizes`` brings samples to ``binsize`` first. ``outliers``: arguments of
    ``distance_outliers``. ``save(df, name)`` writes a table and reads it back.
    """
    save = save or (lambda df, name: df)
    if bins.select("sample_id").distinct().count() < min_samples:
        raise ValueError(f"a reference needs at least {min_samples} samples")
    if sample_binsizes is not None:
        bins = rescale_to(bins, sample_binsizes, binsize, value)
    frac = save(y_fraction(bins, value), "y_fraction")
    cutoff = gender_cutoff(frac, yfrac)
    genders = save(predict_gender(frac, cutoff), "genders")
    counts = {r["gender"]: r["count"] for r in genders.groupBy("gender").count().collect()}
    if nipt and counts.get("F", 0) < min_female:
        raise ValueError(f"a NIPT reference needs at least {min_female} female samples")
    bins = save(gender_correct(bins.select("sample_id", "chrom", "bin", value), genders, value, nipt).drop("gender"), "corrected")
    mask = save(reference_mask(bins, genders, min_female=min_female, min_male=min_male, nipt=nipt, value=value), "first_mask")
    least = {"F": min_female, "M": min_male}
    parts: dict[str, list[DataFrame]] = {"bins": [], "knn": [], "null_ratio": [], "mask": []}
    for branch in branches or ("A", "F", "M"):
        if branch == "M" and nipt or branch in least and counts.get(branch, 0) < least[branch]:
            continue
        own = bins if branch == "A" else bins.join(genders.where(F.col("gender") == branch).select("sample_id"), "sample_id")
        kept = mask
        matrix = save(branch_matrix(own, kept, branch, value), f"matrix_{branch}")
        model, scores = train_pca(matrix, components)
        corrected = save(pca_ratio(matrix, model, scores), f"corrected_{branch}")
        bad = save(distance_outliers(corrected, branch, **(outliers or {})), f"outliers_{branch}")
        if bad.limit(1).count():
            gone = corrected.join(bad, "masked_idx").select("chrom", "bin", F.lit(True).alias("gone"))
            kept = save(kept.join(gone, ["chrom", "bin"], "left").select("chrom", "bin", (F.col("keep") & F.col("gone").isNull()).alias("keep")), f"mask_{branch}")
            matrix = save(branch_matrix(own, kept, branch, value), f"matrix2_{branch}")
            model, scores = train_pca(matrix, components)
            corrected = save(pca_ratio(matrix, model, scores), f"corrected2_{branch}")
        if branch == "A":  # its pruning touches autosomes only, which the other branches share
            mask = kept
        knn = save(knn_bins(corrected, refsize, branch), f"knn_{branch}")
        tag = lambda df: df.select(F.lit(branch).alias("branch"), "*")  # noqa: B023, E731
        parts["bins"].append(tag(matrix.join(model, "masked_idx").select("masked_idx", "chrom", "bin", "mean", "loading")))
        parts["knn"].append(tag(knn))
        parts["null_ratio"].append(tag(null_ratios(corrected, knn, max_null)))
        parts["mask"].append(tag(kept.where(F.col("chrom") <= BRANCHES[branch])))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    meta = bins.sparkSession.createDataFrame([(float(cutoff), refsize, nipt, binsize)], "gender_cutoff double, refsize int, nipt boolean, binsize int")
    return {k: save(union(v), k) for k, v in parts.items()} | {"genders": genders, "meta": save(meta, "meta")}


def remap(a: DataFrame, other: DataFrame) -> DataFrame:
    """Index in branch A to index in another branch of the same bin; ``missing`` rows of A must not exist for aligned masks."""
    b = other.select("chrom", "bin", F.col("masked_idx").alias("other_idx"))
    return a.join(b, ["chrom", "bin"], "left").select("masked_idx", "other_idx", F.col("other_idx").isNull().alias("missing"))


def local_minima(grid: DataFrame) -> DataFrame:
    """Points ``x, y`` of one curve that lie below both neighbours."""
    w = Window.orderBy("x")
    return grid.withColumn("_a", F.lag("y").over(w)).withColumn("_b", F.lead("y").over(w)).where("y < _a and y < _b").select("x", "y")


def knn_summary(knn: DataFrame) -> DataFrame:
    """Per bin: references (index above 0, finite distance) and their mean distance."""
    pair = F.arrays_zip("refs", "distances")
    use = F.filter(pair, lambda p: (p["refs"] > 0) & is_finite(p["distances"]))
    total = F.aggregate(use, F.lit(0.0), lambda a, p: a + p["distances"])
    return knn.select("branch", "masked_idx", F.size(use).alias("n_refs"), safe_div(total, F.nullif(F.size(use), F.lit(0))).alias("mean_dist"))


def mask_compatibility(mask: DataFrame) -> DataFrame:
    """``branch, n_missing, compatible``: whether the F and M masks keep the autosomal bins that A keeps, and no other."""
    auto = mask.where("chrom <= 22")
    a = auto.where("branch = 'A'").select("chrom", "bin", F.col("keep").alias("a_keep"))
    both = auto.where("branch <> 'A'").join(a, ["chrom", "bin"], "full")
    return both.where("branch is not null").groupBy("branch").agg(F.count_if(~F.col("keep").eqNullSafe(F.col("a_keep"))).alias("n_missing")).withColumn("compatible", F.col("n_missing") == 0)


def reference_qc(knn: DataFrame, min_ref_bins: int = 150, sigma: float = 3.0, mask: DataFrame | None = None) -> DataFrame:
    """Metrics and a verdict per branch: no data fails; low reference counts warn (checked first), a wide spread of mean distances fails.

    Targets of the F and M branches that are skipped by design (lists of index 0 only) are left out. With ``mask`` (by
    branch) a branch whose autosomal mask is not A's fails too, and ``ready`` says whether the branch can be used.
    """
    per = knn_summary(knn).where("branch = 'A' or n_refs > 0")
    base = per.groupBy("branch").agg(F.count("*").alias("n_bins"), F.count("mean_dist").alias("n_valid"), F.avg("mean_dist").alias("mean_of_means"), F.coalesce(F.stddev_samp("mean_dist"), F.lit(0.0)).alias("std_of_means"), F.count_if(F.col("n_refs") < min_ref_bins).alias("n_low_refs"))
    out = per.join(base.select("branch", (F.col("mean_of_means") + sigma * F.col("std_of_means")).alias("cut")), "branch").groupBy("branch").agg(F.count_if(F.col("mean_dist") >= F.col("cut")).alias("n_mean_outlier"))
    out = base.join(out, "branch").withColumn("outlier_pct", safe_div(F.col("n_mean_outlier") * 100, F.nullif(F.col("n_valid"), F.lit(0)))).withColumn("verdict", verdict(F.col("n_valid"), F.col("n_low_refs"), F.col("std_of_means")))
    if mask is None:
        return out
    out = out.join(mask_compatibility(mask).select("branch", "compatible"), "branch", "left").withColumn("compatible", F.coalesce("compatible", F.lit(True)))
    return out.withColumn("verdict", F.when(~F.col("compatible"), "FAIL").otherwise(F.col("verdict"))).withColumn("ready", F.col("verdict") != "FAIL")


def verdict(n_valid: Column, n_low: Column, std: Column, high: float = 10.0) -> Column:
    return F.when(n_valid == 0, "FAIL").when(n_low > 0, "WARN").when(std > high, "FAIL").otherwise("PASS")
