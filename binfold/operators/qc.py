"""Quality reports, fetal fraction, and data for plots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.kernels import forward_from_gram
from binfold.functions.safe import is_finite, safe_div
from binfold.operators.bins import chromosome_totals, fractions, genome_offsets
from binfold.operators.chi import chi_correct, chi_profile
from binfold.operators.cohort import EXCLUDED, chromosome_statistics, diagnose, leave_one_out, match_outliers, outlier_samples, pairwise_distances
from binfold.operators.scores import centred_products


def control_group_qc(bins: DataFrame, chi_cutoff: float = 3.5, z_cutoff: float = 3.0, rule: str = "any_aberrant_score", labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Summaries of a control group: by chromosome (before and after chi), sample, sex and bin."""
    profile = chi_profile(bins, chi_cutoff)
    before = fractions(chromosome_totals(bins)).where("chrom <= 22")
    after = fractions(chromosome_totals(chi_correct(bins, profile))).where("chrom <= 22")
    chrom = chromosome_statistics(before).withColumn("method", F.lit("raw")).unionByName(chromosome_statistics(after).withColumn("method", F.lit("chi")))
    flagged = outlier_samples(diagnose(after, z_cutoff), rule)
    names = bins.select("sample_id").distinct()
    sample = names.join(match_outliers(pairwise_distances(after)).drop("cutoff"), "sample_id", "left").join(flagged, "sample_id", "left").withColumn("aberrant", F.col("chromosomes").isNotNull())
    regression, ratio = regression_controls(after, [13, 18, 21]), ratio_controls(after)
    out = {"chromosomes": chrom, "samples": sample, "bins": profile, "regression": family_summary(regression, ["focus", "model"], z_cutoff), "ratio": family_summary(ratio, ["chrom"], z_cutoff)}
    if labels is not None:
        from binfold.operators.sex import sex_fractions

        sex = sex_fractions(chromosome_totals(bins)).join(labels.select("sample_id", "sex"), "sample_id")
        out["sex"] = sex.groupBy("sex").agg(F.count("*").alias("n"), F.avg("x_frac").alias("mean_x"), F.stddev_samp("x_frac").alias("sd_x"), F.avg("y_frac").alias("mean_y"), F.stddev_samp("y_frac").alias("sd_y"))
    return out


def regression_controls(frac: DataFrame, foci: list[int], n_models: int = 4, n_predictors: int = 4, exclude: tuple[int, ...] = EXCLUDED) -> DataFrame:
    """Every control judged by models of all others: ``sample_id, focus, model, predictors, ratio, ratio_out, z_out``.

    ``frac``: autosomal fractions. Models are stepwise as in the regression scores. ``ratio`` is observed over fitted;
    ``ratio_out`` is what the model fitted without the sample gives for it, by the leverage h of the sample: the residual
    of a left-out fit is the residual over 1 - h. ``z_out`` is ``ratio_out - 1`` over the SD of all ``ratio_out``.

    Models follow from the means and the products of 22 columns, summed over samples in the cluster, so cohorts may be
    large: 506 numbers come to the driver and some 20 models go out; samples are then judged where they are.
    """
    p = 22
    value = lambda c: F.coalesce(F.sum(F.when(F.col("chrom") == c, F.col("frac"))), F.lit(0.0))
    wide = frac.where("chrom <= 22").groupBy("sample_id").agg(F.array(*[value(c) for c in range(1, p + 1)]).alias("f"))
    n, mean, gram = centred_products(wide, "f", p)
    models = []
    for focus in foci:
        open_ = ~np.isin(np.arange(1, p + 1), [focus, *exclude])
        for m in range(1, n_models + 1):
            cols = forward_from_gram(gram, focus - 1, n_predictors, n, open_)
            if not cols:
                break
            open_[cols] = False
            inverse = np.linalg.inv(gram[np.ix_(cols, cols)])
            models.append((focus, m, cols, inverse, inverse @ gram[cols, focus - 1]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["f"].tolist(), float).reshape(-1, p)
            for focus, m, cols, inverse, coef in models:
                d, y = x[:, cols] - mean[cols], x[:, focus - 1]
                fitted = mean[focus - 1] + d @ coef
                h = 1 / n + np.einsum("ij,jk,ik->i", d, inverse, d)
                with np.errstate(all="ignore"):
                    out = y - (y - fitted) / (1 - h)
                    yield pd.DataFrame({"sample_id": pdf["sample_id"], "focus": focus, "model": m, "predictors": [[c + 1 for c in cols]] * len(y), "ratio": y / fitted, "ratio_out": y / out})

    kind = dict(wide.dtypes)["sample_id"]
    rows = wide.mapInPandas(judge, f"sample_id {kind}, focus int, model int, predictors array<int>, ratio double, ratio_out double")
    spread = rows.where(is_finite("ratio_out")).groupBy("focus", "model").agg(F.stddev_samp("ratio_out").alias("_sd"))
    return rows.join(F.broadcast(spread), ["focus", "model"], "left").withColumn("z_out", safe_div(F.col("ratio_out") - 1, F.nullif(F.col("_sd"), F.lit(0.0)))).select("sample_id", "focus", "model", "predictors", "ratio", "ratio_out", "z_out")


def ratio_controls(frac: DataFrame) -> DataFrame:
    """Every control's ratio of a chromosome to the mean of all others: ``sample_id, chrom, ratio_out, z_out``, each left out of its mean and SD."""
    out = leave_one_out(frac.where("chrom <= 22").select("sample_id", "chrom", "frac"), "frac", ["chrom"])
    return out.select("sample_id", "chrom", safe_div("frac", F.nullif(F.col("loo_mean"), F.lit(0.0))).alias("ratio_out"), F.col("loo_z").alias("z_out"))


def family_summary(rows: DataFrame, keys: list[str], z_cutoff: float = 3.0) -> DataFrame:
    """Per key: controls, CV of ``ratio_out``, largest ``|z_out|``, and how many controls pass the cutoff."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), safe_div(F.stddev_samp("ratio_out"), F.avg("ratio_out")).alias("cv_out"), F.max(F.abs("z_out")).alias("max_abs_z"), F.count_if(F.abs("z_out") > z_cutoff).alias("n_far"))


def sample_status(samples: DataFrame) -> DataFrame:
    """Status ladder of control samples: aberrant before far before ok."""
    return samples.withColumn("status", F.when(F.col("aberrant"), "aberrant").when(F.coalesce(F.col("outlier"), F.lit(False)), "distant").otherwise("ok"))


def seqff(counts: DataFrame, bin_table: DataFrame, model: DataFrame, wrsc: dict[str, float]) -> DataFrame:
    """Fetal fraction: ``sample_id, seqff, enet, wrsc``.

    ``bin_table``: ``bin_name, chrom, gc, usable``; ``model``: ``bin_name, beta, reduced`` (elastic net weights and
    the fitted rank-selection weights) with ``wrsc`` holding ``enet_intercept, p1, p2``. Counts are scaled by the
    autosomal total; a local regression of medians per GC value is subtracted, its mean added back; values are scaled
    to mean 1; scores are dot products and SeqFF is the mean of both.
    """
    from binfold.functions.kernels import loess

    rows = bin_table.join(counts.select("sample_id", "bin_name", "n"), "bin_name", "left").where("sample_id is not null")
    rows = rows.withColumn("auto", F.col("chrom").between(1, 22))
    w = Window.partitionBy("sample_id")
    rows = rows.withColumn("x", safe_div("n", F.sum(F.when(F.col("auto"), F.col("n"))).over(w))).where("usable and x is not null and gc is not null")
    median = rows.where("auto").groupBy("sample_id", "gc").agg(F.median("x").alias("m"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gc")
        g, m = pdf["gc"].to_numpy(float), pdf["m"].to_numpy(float)
        pdf["fitted"] = loess(g, m) if len(pdf) >= 4 else np.full(len(pdf), m.mean() if len(m) else np.nan)
        return pdf[["sample_id", "gc", "fitted"]]

    kind = dict(rows.dtypes)["sample_id"]
    fitted = median.groupBy("sample_id").applyInPandas(fit, f"sample_id {kind}, gc double, fitted double")
    rows = rows.join(fitted, ["sample_id", "gc"], "left").withColumn("c", F.col("x") - F.coalesce("fitted", "x") + F.avg(F.when(F.col("auto"), F.col("x"))).over(w))
    rows = rows.withColumn("y", safe_div("c", F.avg("c").over(w))).join(model, "bin_name", "left")
    out = rows.groupBy("sample_id").agg((F.sum(F.col("y") * F.coalesce("beta", F.lit(0.0))) + wrsc["enet_intercept"]).alias("enet"), ((safe_div(F.sum(F.col("y") * F.coalesce("reduced", F.lit(0.0))), F.sum("y")) + wrsc["p1"]) * wrsc["p2"]).alias("wrsc"))
    return out.select("sample_id", ((F.col("enet") + F.col("wrsc")) / 2).alias("seqff"), "enet", "wrsc")


#: Layers of a sample's quality row and their columns: name, type, and whether success requires it.
SAMPLE_QC = {
    "counts": [("pre_sum", "long", True), ("post_sum", "long", True), ("nonzero_bins", "long", True), ("retained_fraction", "double", False), ("gc_perc_pre", "double", False), ("gc_perc_post", "double", False), ("mean_mapq", "double", False)],
    "alignment": [("sequences", "long", True), ("reads_mapped", "long", True), ("reads_duplicated", "long", False), ("error_rate", "double", False)],
    "fractions": [(f"frac_{c}", "double", True) for c in [*map(str, range(1, 23)), "X", "Y"]],
    "sex": [("y_frac", "double", False), ("predicted_sex", "string", False)],
    "fetal_fraction": [("seqff", "double", False), ("enet", "double", False), ("wrsc", "double", False)],
}


def sample_qc_rows(samples: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """One row per sample with all dictionary columns, and ``status``, ``missing``.

    A sample succeeds when every required column of the layers that ran is there and finite; a layer that did not run
    gives NULL columns and asks for nothing.
    """
    out, required = samples.select("sample_id").distinct(), []
    for layer, cols in SAMPLE_QC.items():
        own = layers.get(layer)
        if own is None:
            for name, kind, _ in cols:
                out = out.withColumn(name, F.lit(None).cast(kind))
            continue
        out = out.join(own.select("sample_id", *[F.col(n).cast(k).alias(n) if n in own.columns else F.lit(None).cast(k).alias(n) for n, k, _ in cols]), "sample_id", "left")
        required += [(n, k) for n, k, need in cols if need]
    lacking = [F.when(F.col(n).isNull() if k != "double" else ~is_finite(n), F.lit(n)) for n, k in required]
    out = out.withColumn("missing", F.array_join(F.array_compact(F.array(*lacking)), ";") if lacking else F.lit(""))
    return out.withColumn("status", F.when(F.col("missing") == "", "success").otherwise("failed"))


def compare_results(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float = 1e-6) -> DataFrame:
    """Rows of two results side by side: counts of matches, differences beyond the tolerance, and rows of one side only."""
    both = a.select(*keys, F.col(value).alias("va"), F.lit(1).alias("ia")).join(b.select(*keys, F.col(value).alias("vb"), F.lit(1).alias("ib")), keys, "full_outer")
    same = (F.abs(F.col("va") - F.col("vb")) <= tol) | (F.col("va").isNull() & F.col("vb").isNull())
    in_both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    return both.agg(F.count_if(in_both & F.coalesce(same, F.lit(False))).alias("equal"), F.count_if(in_both & ~F.coalesce(same, F.lit(False))).alias("different"), F.count_if(F.col("ib").isNull()).alias("only_a"), F.count_if(F.col("ia").isNull()).alias("only_b"))


def plot_chromosomes(qc_chromosomes: DataFrame) -> DataFrame:
    """Chromosome CVs per method with a normality flag."""
    return qc_chromosomes.select("chrom", "method", (F.col("cv") * 100).alias("cv_percent"), F.when(F.col("shapiro_p").isNull() | F.isnan("shapiro_p"), "unknown").when(F.col("shapiro_p") < 0.05, "not_normal").otherwise("normal").alias("shape"))


def plot_bins(profile: DataFrame, metric: str = "z") -> DataFrame:
    """A bin metric on a genome-wide axis."""
    off = genome_offsets(profile.select("chrom", "bin"))
    return profile.join(F.broadcast(off), "chrom").select("chrom", "bin", (F.col("offset") + F.col("bin")).alias("x"), F.col(metric).alias("y"))


def plot_sex(fractions_by_sex: DataFrame, space: str = "fraction") -> DataFrame:
    """Points of X and Y; in ratio space on a negative log scale with a floor of 1e-12."""
    show = (lambda c: F.col(c)) if space == "fraction" else (lambda c: -F.log10(F.greatest(F.col(c), F.lit(1e-12))))
    return fractions_by_sex.select("sample_id", "sex", show("x_frac").alias("x"), show("y_frac").alias("y"))
