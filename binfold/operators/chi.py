"""Chi-square correction of overdispersed bins from a control group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.safe import is_finite, safe_div


def chi_profile(controls: DataFrame, cutoff: float = 3.5, value: str = "n") -> DataFrame:
    """``chrom, bin, expected, chi2, z, factor, valid`` over autosomal bins of the controls.

    Samples are scaled to the mean total; the expected value of a bin is its mean; chi2 sums (e - s)^2 / e; with
    n - 1 degrees of freedom z = (chi2 - df) / sqrt(2 df), and factor = chi2 / df where z exceeds the cutoff. Two
    aggregates by bin, the second over the first joined back by bin.
    """
    auto = controls.where("chrom <= 22").select("sample_id", "chrom", "bin", F.col(value).cast("double").alias("v"))
    per = auto.groupBy("sample_id").agg(F.sum("v").alias("total"))
    mean = per.agg(F.avg("total").alias("mean_total"), F.count("*").alias("n_controls"))
    scaled = auto.join(per.join(F.broadcast(mean)), "sample_id").withColumn("s", F.coalesce(safe_div(F.col("v") * F.col("mean_total"), "total"), F.lit(float("nan"))))
    w = Window.partitionBy("chrom", "bin")
    with_e = scaled.withColumn("e", F.avg("s").over(w))
    prof = with_e.groupBy("chrom", "bin").agg(F.max("e").alias("expected"), F.sum(safe_div((F.col("e") - F.col("s")) ** 2, "e")).alias("chi2"), F.max("n_controls").alias("n_controls"), F.count_if(~is_finite("s")).alias("bad"), F.stddev_samp("s").alias("sd_scaled"))
    df = (F.col("n_controls") - 1).cast("double")
    reason = F.when(F.col("bad") > 0, "nonfinite_scaled").when(~is_finite("expected"), "nonfinite_expected").when(F.col("expected") <= 0, "nonpositive_expected")
    prof = prof.withColumn("reason", reason).withColumn("z", F.when(reason.isNull(), (F.col("chi2") - df) / F.sqrt(2 * df)))
    return prof.withColumn("factor", F.when((F.col("z") > cutoff) & reason.isNull(), F.col("chi2") / df).otherwise(1.0)).withColumn("cv_scaled", safe_div("sd_scaled", "expected")).drop("bad", "sd_scaled")


def chi_correct(bins: DataFrame, profile: DataFrame, values: list[str] | None = None, include_sex: bool = False) -> DataFrame:
    """Divide counts (each strand alike) by the bin's factor; chromosomes X and Y are never touched."""
    if include_sex:
        raise ValueError("chi correction has no profile for sex chromosomes")
    values = values or ["n"]
    out = bins.join(profile.select("chrom", "bin", "factor"), ["chrom", "bin"], "left")
    for v in values:
        out = out.withColumn(v, F.col(v) / F.coalesce("factor", F.lit(1.0)))
    return out.drop("factor")


def chi_bin_summary(profile: DataFrame) -> DataFrame:
    """Per chromosome: bins, invalid and overdispersed bins, and the spread of factors."""
    return profile.groupBy("chrom").agg(F.count("*").alias("bins"), F.count("reason").alias("invalid_bins"), F.count_if(F.col("factor") > 1).alias("overdispersed_bins"), F.max("factor").alias("max_factor"), F.avg("cv_scaled").alias("mean_cv"))
