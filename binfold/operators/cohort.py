"""Control groups: membership, diagnosis, pruning, matching and quality filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.safe import is_finite, safe_div
from binfold.operators.bins import fractions


def first_by_name(samples: DataFrame, order: str = "input_order") -> DataFrame:
    """One row per ``sample_id``, the first in input order."""
    w = Window.partitionBy("sample_id").orderBy(order)
    return samples.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def as_control_group(samples: DataFrame) -> DataFrame:
    """Distinct samples of one strand type; at least two. ``samples``: ``sample_id, strand_type, input_order``."""
    out = first_by_name(samples)
    kinds, n = samples.select("strand_type").distinct().count(), out.count()
    if kinds > 1:
        raise ValueError("a control group has one strand type")
    if n < 2:
        raise ValueError("a control group needs at least 2 samples")
    return out


def drop_samples(group: DataFrame, names: DataFrame) -> DataFrame:
    """Members that are not named; at least two must remain."""
    out = group.join(names.select("sample_id"), "sample_id", "left_anti")
    if out.limit(2).count() < 2:
        raise ValueError("fewer than 2 controls would remain")
    return out


def missing_members(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Names asked for that the other side lacks; of its rows, however many, only the distinct names are joined."""
    return wanted.select("sample_id").join(present.select("sample_id").distinct(), "sample_id", "left_anti")


def chromosome_scores(frac: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each sample's fraction standardised over the group, per chromosome (and strand where given)."""
    w = Window.partitionBy(*(keys or ["chrom"]))
    return frac.withColumn("mean", F.avg("frac").over(w)).withColumn("sd", F.stddev_samp("frac").over(w)).withColumn("z", safe_div(F.col("frac") - F.col("mean"), "sd"))


def diagnose(frac: DataFrame, z_cutoff: float = 3.0) -> DataFrame:
    """Scores with a flag for aberrant ones; a NULL score is not aberrant."""
    return chromosome_scores(frac).withColumn("aberrant", F.coalesce(F.abs("z") > z_cutoff, F.lit(False)))


def chromosome_statistics(frac: DataFrame) -> DataFrame:
    """Mean, SD, CV and the Shapiro-Wilk p of each chromosome over the group."""
    from binfold.functions.kernels import shapiro

    @F.pandas_udf("double")
    def p_value(v: pd.Series) -> float:
        return shapiro(v.to_numpy(float))[1]

    return frac.groupBy("chrom").agg(F.avg("frac").alias("mean"), F.stddev_samp("frac").alias("sd")).withColumn("cv", safe_div("sd", "mean")).join(frac.groupBy("chrom").agg(p_value("frac").alias("shapiro_p")), "chrom")


def outlier_samples(diagnosed: DataFrame, rule: str = "any_aberrant_score", max_aberrant_chromosomes: int = 2) -> DataFrame:
    """Samples flagged by the rule; strands are rows of their own where a column ``strand`` exists."""
    bad = diagnosed.where("aberrant")
    per = bad.groupBy("sample_id", "chrom").agg(F.count("*").alias("hits")) .groupBy("sample_id").agg(F.count("*").alias("chromosomes"), F.max("hits").alias("strands"))
    if rule == "any_aberrant_score":
        return per
    if rule == "bidirectional_or_multichromosome":
        return per.where((F.col("chromosomes") > max_aberrant_chromosomes) | (F.col("strands") > 1))
    raise ValueError("unknown outlier rule")


def prune(bins: DataFrame, chi_cutoff: float = 3.5, z_cutoff: float = 3.0, rule: str = "any_aberrant_score", max_aberrant_chromosomes: int = 2, min_controls: int = 10, max_iterations: int = 100, save=None) -> tuple[DataFrame, list[dict]]:
    """Correct, diagnose, drop flagged controls, repeat. Returns the kept bins and a log of rounds.

    The bins are read once. What chi correction needs of a bin are sums over the controls: how many there are, and the
    sums of their shares (counts over the sample's total) and of the squares, taken about the bin's first mean so that
    no digits are lost. A dropped sample's shares are subtracted from these. A round then reads the sums, the rows of the
    samples it dropped, and the counts of overdispersed bins, by which the chromosome totals change. Only names and
    counts come to the driver. ``save`` (table, name) cuts lineage; by default it is a reliable checkpoint.
    """
    save = save or (lambda df, name: df.checkpoint())
    auto = bins.where("chrom <= 22").select("sample_id", "chrom", "bin", F.col("n").cast("double").alias("v"))
    total = auto.groupBy("sample_id").agg(F.sum("v").alias("total"))
    rows = save(auto.join(total, "sample_id").select("sample_id", "chrom", "bin", "v", safe_div("v", F.nullif(F.col("total"), F.lit(0.0))).alias("x")), "shares")
    totals = save(total, "totals")
    raw = save(rows.groupBy("sample_id", "chrom").agg(F.sum("v").alias("reads")), "raw")
    first = rows.groupBy("chrom", "bin").agg(F.avg("x").alias("x0"))
    squares = rows.join(first, ["chrom", "bin"]).withColumn("d", F.col("x") - F.col("x0"))
    sums = save(squares.groupBy("chrom", "bin").agg(F.first("x0").alias("x0"), F.count("*").alias("c"), F.sum("d").alias("d1"), F.sum(F.col("d") ** 2).alias("d2")), "sums")
    # Samples without any autosomal bin are in no sum, but they are members.
    names = save(bins.select("sample_id").distinct(), "names")
    n = names.count()
    dropped: list = []
    log: list[dict] = []
    left = lambda df: df.where(~F.col("sample_id").isin(dropped)) if dropped else df
    kept = lambda: left(bins)
    for i in range(1, max_iterations + 1):
        mean_total, members, empty = left(totals).agg(F.avg("total"), F.count("*"), F.count_if(F.coalesce("total", F.lit(0.0)) == 0)).first()
        fixed = left(raw)
        if members > 1 and not empty:
            mean, spread = F.col("x0") + F.col("d1") / F.col("c"), F.greatest(F.col("d2") - F.col("d1") ** 2 / F.col("c"), F.lit(0.0))
            chi2, df = F.lit(mean_total) * spread / mean, float(members - 1)
            wide = sums.where("c > 0").where(mean > 0).select("chrom", "bin", chi2.alias("chi2")).where((F.col("chi2") - df) / (2 * df) ** 0.5 > chi_cutoff)
            change = left(rows).join(wide.select("chrom", "bin", (df / F.col("chi2") - 1).alias("less")), ["chrom", "bin"]).groupBy("sample_id", "chrom").agg(F.sum(F.col("v") * F.col("less")).alias("change"))
            fixed = fixed.join(change, ["sample_id", "chrom"], "left").select("sample_id", "chrom", (F.col("reads") + F.coalesce("change", F.lit(0.0))).alias("reads"))
        frac = fractions(fixed)
        flagged = sorted(r[0] for r in outlier_samples(diagnose(frac, z_cutoff), rule, max_aberrant_chromosomes).select("sample_id").collect())
        if not flagged:
            log.append({"iteration": i, "dropped": [], "stop": "no_flagged_samples"})
            return kept(), log
        if n - len(dropped) - len(flagged) < min_controls:
            log.append({"iteration": i, "dropped": [], "stop": "min_controls"})
            return kept(), log
        dropped += flagged
        log.append({"iteration": i, "dropped": flagged, "stop": None})
        gone = rows.where(F.col("sample_id").isin(flagged)).join(sums.select("chrom", "bin", "x0"), ["chrom", "bin"]).withColumn("d", F.col("x") - F.col("x0"))
        gone = gone.groupBy("chrom", "bin").agg(F.count("*").alias("gc"), F.sum("d").alias("g1"), F.sum(F.col("d") ** 2).alias("g2"))
        sums = save(sums.join(gone, ["chrom", "bin"], "left").na.fill(0).select("chrom", "bin", "x0", (F.col("c") - F.col("gc")).alias("c"), (F.col("d1") - F.col("g1")).alias("d1"), (F.col("d2") - F.col("g2")).alias("d2")), f"sums-{i}")
    log[-1]["stop"] = "max_iterations"
    return kept(), log


EXCLUDED = (13, 18, 21)


def pairwise_distances(frac: DataFrame, others: DataFrame | None = None, exclude: tuple[int, ...] = EXCLUDED) -> DataFrame:
    """Sum of squared differences of autosomal fractions between samples: ``sample_a, sample_b, ssd`` (both orders).

    The join is by chromosome; its size is the result times 22, the result being the matrix that is asked for.
    """
    use = (F.col("chrom") <= 22) & ~F.col("chrom").isin(*exclude)
    a = frac.where(use).select(F.col("sample_id").alias("sample_a"), "chrom", F.col("frac").alias("fa"))
    b = (others if others is not None else frac).where(use).select(F.col("sample_id").alias("sample_b"), "chrom", F.col("frac").alias("fb"))
    return a.join(b, "chrom").groupBy("sample_a", "sample_b").agg(F.sum((F.col("fa") - F.col("fb")) ** 2).alias("ssd"))


def match_controls(sample_frac: DataFrame, control_frac: DataFrame, n: int, exclude: tuple[int, ...] = EXCLUDED) -> DataFrame:
    """The n nearest controls of each sample, ties by name."""
    w = Window.partitionBy("sample_a").orderBy("ssd", "sample_b")
    d = pairwise_distances(sample_frac, control_frac, exclude)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def match_outliers(distances: DataFrame) -> DataFrame:
    """Mean distance to the others and a flag beyond mean + 3 SD of these means."""
    mean = distances.where("sample_a <> sample_b").groupBy(F.col("sample_a").alias("sample_id")).agg(F.avg("ssd").alias("mean_ssd"))
    cut = mean.agg((F.avg("mean_ssd") + 3 * F.stddev_samp("mean_ssd")).alias("cutoff"))
    return mean.join(F.broadcast(cut)).withColumn("outlier", F.coalesce(F.col("mean_ssd") > F.col("cutoff"), F.lit(False)))


def qc_filter(qc: DataFrame, reads_col: str, gc_col: str, min_reads: float | None = None, max_reads: float | None = None, gc_mad_cutoff: float | None = None) -> DataFrame:
    """Samples with their reasons for exclusion, joined by ``;`` (empty: kept).

    GC outliers: farther from the median than the cutoff times the scaled MAD; no spread, no outliers; a value that is
    not finite is one.
    """
    med = qc.where(is_finite(gc_col)).agg(F.median(gc_col).alias("gc_median"))
    dev = qc.where(is_finite(gc_col)).join(F.broadcast(med)).agg((F.median(F.abs(F.col(gc_col) - F.col("gc_median"))) * 1.4826).alias("gc_mad"), F.max("gc_median").alias("gc_median"))
    out = qc.join(F.broadcast(dev))
    reasons: list[Column] = []
    if min_reads is not None:
        reasons.append(F.when(F.coalesce(F.col(reads_col) < min_reads, F.lit(True)), "too_few_reads"))
    if max_reads is not None:
        reasons.append(F.when(F.coalesce(F.col(reads_col) > max_reads, F.lit(True)), "too_many_reads"))
    if gc_mad_cutoff is not None:
        far = (F.col("gc_mad") > 0) & (F.abs(F.col(gc_col) - F.col("gc_median")) > gc_mad_cutoff * F.col("gc_mad"))
        reasons.append(F.when(~is_finite(gc_col) | F.coalesce(far, F.lit(False)), "gc_outlier"))
    return out.withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ";") if reasons else F.lit("")).withColumn("kept", F.col("reasons") == "")


def leave_one_out(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """z of each row against the other rows of its class, in closed form from the class's count, sum and squares.

    Squares are taken about the class mean, which keeps the digits that raw sums would lose.
    """
    w = Window.partitionBy(*by)
    out = rows.withColumn("_m", F.avg(value).over(w)).withColumn("_n", F.count(value).over(w)).withColumn("_d", F.col(value) - F.col("_m"))
    out = out.withColumn("_q", F.sum(F.col("_d") ** 2).over(w))
    n = F.col("_n")
    mean = F.col("_m") - safe_div("_d", n - 1)
    var = safe_div(F.col("_q") - F.col("_d") ** 2 * n / F.nullif(n - 1, F.lit(0)), n - 2)
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    return out.withColumn("loo_mean", mean).withColumn("loo_sd", sd).withColumn("loo_z", safe_div(F.col(value) - mean, F.nullif(sd, F.lit(0.0)))).drop("_m", "_n", "_d", "_q")


def subset_z(rows: DataFrame, value: str, member: str) -> DataFrame:
    """z of every row against the member rows, itself left out where it is one."""
    own = leave_one_out(rows.where(F.col(member)).withColumn("_all", F.lit(0)), value, ["_all"]).drop("_all", "loo_mean", "loo_sd").withColumnRenamed("loo_z", "subset_z")
    stats = rows.where(F.col(member)).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    other = rows.where(~F.col(member)).join(F.broadcast(stats)).withColumn("subset_z", safe_div(F.col(value) - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0)))).drop("_m", "_s")
    return own.unionByName(other)


def same_members(a: DataFrame, b: DataFrame) -> bool:
    """Both sides name the same samples, equally often."""
    a, b = a.select("sample_id"), b.select("sample_id")
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def decide_samples(samples: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """``sample_id, decision``: kept, not listed for inclusion, or excluded by name."""
    out = samples.select("sample_id").distinct().withColumn("_in", F.lit(True)).withColumn("_out", F.lit(False))
    if include is not None:
        out = out.drop("_in").join(include.select("sample_id").distinct().withColumn("_in", F.lit(True)), "sample_id", "left").fillna(False, ["_in"])
    if exclude is not None:
        out = out.drop("_out").join(exclude.select("sample_id").distinct().withColumn("_out", F.lit(True)), "sample_id", "left").fillna(False, ["_out"])
    return out.select("sample_id", F.when(F.col("_out"), "excluded").when(~F.col("_in"), "not_included").otherwise("kept").alias("decision"))


def seeded_order(name: Column | str, seed: int) -> Column:
    """An order that depends on name and seed alone, not on partitions."""
    return F.xxhash64(name if isinstance(name, Column) else F.col(name), F.lit(seed))
