"""GC tables and GC correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.safe import finite_or, is_finite, safe_corr, safe_div


def gc_from_bases(bases: DataFrame, binsize: int) -> DataFrame:
    """GC fraction per bin from sequence lines ``chrom, start, seq``: (C + G) / (A + C + G + T), NULL without any.

    Lines are cut at bin edges and their letters counted as a whole: a row per line and bin, not per base.
    """
    first, last = F.floor(F.col("start") / binsize), F.floor((F.col("start") + F.length("seq") - 1) / binsize)
    cut = bases.where(F.length("seq") > 0).select("chrom", "start", "seq", F.explode(F.sequence(first, last)).alias("bin"))
    begin = F.greatest(F.col("bin") * binsize - F.col("start"), F.lit(0))
    piece = F.substr("seq", (begin + 1).cast("int"), ((F.col("bin") + 1) * binsize - F.col("start") - begin).cast("int"))
    count = lambda letters: F.sum(F.length(F.regexp_replace("piece", f"[^{letters}]", "")))
    cells = cut.select("chrom", F.col("bin").cast("int").alias("bin"), F.upper(piece).alias("piece")).groupBy("chrom", "bin")
    return cells.agg(safe_div(count("CG"), F.nullif(count("ACGT"), F.lit(0))).alias("gc"))


def join_gc(bins: DataFrame, gc: DataFrame) -> DataFrame:
    """GC of each bin; the table has one row per genome bin."""
    return bins.join(gc.select("chrom", "bin", "gc"), ["chrom", "bin"], "left")


def eligibility(value: Column | str = "n", gc: Column | str = "gc") -> Column:
    """Why a bin is not used in a GC fit; NULL if it is. The first reason that holds counts."""
    v, g = (F.col(c) if isinstance(c, str) else c for c in (value, gc))
    return F.when(g.isNull() | F.isnan(g), "missing_gc").when(g <= 0, "nonpositive_gc").when(v.isNull(), "missing_count").when(~is_finite(v), "nonfinite_count").when(v <= 0, "zero_count")


def bin_weight_correct(bins: DataFrame, gc: DataFrame, value: str = "n", include_sex: bool = False) -> DataFrame:
    """Weight of a GC bucket (0.1 % wide, half to even): mean over non-empty autosomal bins over the bucket's own mean.

    Per sample one aggregate by bucket and one lookup; bins without a weight keep their count. ``corrected`` is
    never negative or non-finite.
    """
    rows = join_gc(bins, gc).withColumn("bucket", F.bround(F.col("gc") * 1000).cast("int"))
    fit = rows.where((F.col("chrom") <= 22) & (F.col(value) > 0) & (F.col("gc") > 0))
    bucket = fit.groupBy("sample_id", "bucket").agg(F.avg(value).alias("bucket_mean"), F.sum(value).alias("s"), F.count("*").alias("c"))
    whole = Window.partitionBy("sample_id")
    weights = bucket.select("sample_id", "bucket", safe_div(safe_div(F.sum("s").over(whole), F.sum("c").over(whole)), "bucket_mean").alias("weight"))
    use = F.lit(True) if include_sex else F.col("chrom") <= 22
    out = rows.join(weights, ["sample_id", "bucket"], "left")
    return out.withColumn("corrected", F.greatest(finite_or(F.col(value) * F.when(use, F.coalesce("weight", F.lit(1.0))).otherwise(1.0), 0.0), F.lit(0.0))).drop("bucket")


def loess_correct(bins: DataFrame, gc: DataFrame, value: str = "n", span: float = 0.75, include_sex: bool = False) -> DataFrame:
    """Local quadratic fit of counts on GC per sample; factor = median of the fit over the fitted value.

    A sample's bins are one group (as many rows as the genome has bins). Samples with fewer than 10 usable bins keep
    their counts. Sex bins take the factor of the fitted autosomal bin nearest in GC, ties to the lower GC.
    """
    from binfold.functions.kernels import loess

    rows = join_gc(bins, gc)
    names = [*rows.columns, "corrected"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, v = pdf["gc"].to_numpy(float), pdf[value].to_numpy(float)
        auto = pdf["chrom"].to_numpy() <= 22
        fit = auto & (g > 0) & (v > 0) & np.isfinite(v)
        factor = np.ones(len(pdf))
        if fit.sum() >= 10:
            fitted = loess(g[fit], v[fit], span)
            f = np.median(fitted) / fitted
            factor[fit] = np.where(np.isfinite(f) & (fitted > 0), f, 1.0)
            if include_sex:
                order = np.argsort(g[fit], kind="stable")
                gs, fs = g[fit][order], factor[fit][order]
                sex = ~auto & np.isfinite(g)
                right = np.clip(np.searchsorted(gs, g[sex]), 1, len(gs) - 1)
                left = right - 1
                near = np.where(np.abs(g[sex] - gs[left]) <= np.abs(gs[right] - g[sex]), left, right)
                factor[sex] = fs[near]
        out = v * factor
        pdf["corrected"] = np.where(np.isfinite(out), np.maximum(out, 0), 0.0)
        return pdf[names]

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", corrected double"
    return rows.groupBy("sample_id").applyInPandas(run, schema)


def nearest_fitted(bins: DataFrame, fitted: DataFrame) -> DataFrame:
    """As-of lookup: the fitted GC value (``sample_id, gc, factor``) nearest to each bin's, ties to the lower.

    One sorted pass over the union of both sides: the last fitted value below and the first one above are window
    values, so no row meets more than its two neighbours.
    """
    w = Window.partitionBy("sample_id").orderBy(F.col("gc"), F.col("side"))
    side = bins.select("sample_id", "chrom", "bin", "gc", F.lit(1).alias("side"), F.lit(None).cast("double").alias("fit_gc"), F.lit(None).cast("double").alias("factor"))
    known = fitted.groupBy("sample_id", "gc").agg(F.min("factor").alias("factor")).select("sample_id", F.lit(None).cast("int").alias("chrom"), F.lit(None).cast("int").alias("bin"), "gc", F.lit(0).alias("side"), F.col("gc").alias("fit_gc"), "factor")
    both = side.where("gc is not null").unionByName(known)
    pair = F.when(F.col("side") == 0, F.struct("fit_gc", "factor"))
    before, after = F.last(pair, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(pair, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("lo", before).withColumn("hi", after).where("side = 1")
    low = F.col("hi").isNull() | (F.col("gc") - F.col("lo.fit_gc") <= F.col("hi.fit_gc") - F.col("gc"))
    pick = F.when(F.col("lo").isNotNull() & low, F.col("lo")).otherwise(F.col("hi"))
    return out.select("sample_id", "chrom", "bin", "gc", pick["fit_gc"].alias("fit_gc"), pick["factor"].alias("factor"))


def preprocess_qc(corrected: DataFrame, value: str = "n") -> DataFrame:
    """Per sample: fit bins, CV before and after, mean and SD of the scaling, correlation of counts with GC before and after."""
    ok = eligibility(value).isNull() & (F.col("chrom") <= 22)
    use = corrected.where(ok).withColumn("scale", safe_div("corrected", value))
    cv = lambda c: safe_div(F.stddev_samp(c), F.avg(c))
    return use.groupBy("sample_id").agg(F.count("*").alias("fit_bins"), cv(value).alias("cv_pre"), cv("corrected").alias("cv_post"), F.avg("scale").alias("scale_mean"), F.stddev_samp("scale").alias("scale_sd"), safe_corr("gc", F.col(value).cast("double")).alias("gc_cor_pre"), safe_corr("gc", "corrected").alias("gc_cor_post"))


def gc_curve(corrected: DataFrame, value: str = "n") -> DataFrame:
    """Medians of counts before and after per GC bucket, for curve plots."""
    return corrected.where(eligibility(value).isNull()).groupBy("sample_id", F.bround(F.col("gc") * 1000).cast("int").alias("bucket")).agg(F.count("*").alias("bins"), F.median(value).alias("median_pre"), F.median("corrected").alias("median_post"))


def running_median(bins: DataFrame, value: str, k: int = 51) -> DataFrame:
    """Running median of k (odd) bins per sample and chromosome; windows shrink at the ends."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    w = Window.partitionBy("sample_id", "chrom").orderBy("bin").rowsBetween(-(k // 2), k // 2)
    return bins.withColumn("smooth", F.expr(f"percentile({value}, 0.5)").over(w))
