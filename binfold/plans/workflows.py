"""Workflows that build models and apply them to cohorts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.operators import chi, cohort, gc, qc, scores, sex
from binfold.operators.bins import chromosome_totals, count_metadata, fractions, grid, reference_frame
from binfold.operators.cnv_predict import predict
from binfold.operators.cnv_reference import gender_correct, newref, predict_gender, y_fraction
from binfold.operators.reads import alignment_stats, bin_reads
from binfold.sources import bundles


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local master without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="binfold-")
    sc.setCheckpointDir(path)


def save_in_checkpoints(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """Cuts lineage by reliable checkpoints in the shared folder."""
    ensure_checkpoint_dir(spark)
    return lambda df, name: df.checkpoint()


def save_as_tables(spark: SparkSession, path: str) -> Callable[[DataFrame, str], DataFrame]:
    """Keeps every intermediate table as Parquet below a path, for models that are used again."""

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    return save


def predict_cohort(bins: DataFrame, lengths: DataFrame, binsize: int, samples: list | None = None, cases: DataFrame | None = None, refsize: int = 300, min_refs: int = 150, yfrac: float | None = None, components: int = 5, nipt: bool = False, alpha: float = 1e-4, zscore: float = 5.0, beta: float | None = None, save=None) -> dict[str, DataFrame]:
    """Reference from all of ``bins``; predictions of ``cases``, or of ``samples`` of the cohort (default all)."""
    spark = bins.sparkSession
    save = save or save_in_checkpoints(spark)
    bins = save(bins.select("sample_id", "chrom", "bin", "n"), "input")
    ref = newref(bins, nipt=nipt, refsize=refsize, yfrac=yfrac, components=components, binsize=binsize, save=save)
    if cases is not None:
        own = save(cases.select("sample_id", "chrom", "bin", "n"), "cases")
        genders = save(predict_gender(y_fraction(own), ref["meta"].first()["gender_cutoff"]), "case_genders")
        own = save(gender_correct(own, genders, nipt=nipt).drop("gender"), "corrected_cases")
    else:
        own, genders = bins if samples is None else bins.where(F.col("sample_id").isin(samples)), ref["genders"]
        own = gender_correct(own, genders, nipt=nipt).drop("gender")
    if nipt:  # one gonosome branch, whatever the label says
        genders = genders.withColumn("gender", F.lit("F"))
    every = grid(own, lengths.where("chrom <= 24"), binsize)
    return predict(own, ref, genders, every, binsize, min_refs=min_refs, alpha=alpha, zscore=zscore, beta=beta, refsize=refsize, save=save)


# --- chromosome-fraction path ----------------------------------------------------------------------------------------

FOCI = (13, 18, 21)
FRACTION_TABLES = ["settings", "membership", "controls", "profile", "fractions", "labels", "sex_models", "sex_reference", "ncv", "sex_ncv", "sex_regression", "qc_chromosomes", "qc_samples", "qc_bins", "qc_sex"]


def build_fraction_reference(
    bins: DataFrame, path: str, labels: DataFrame | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, sample_qc: DataFrame | None = None, min_reads: float | None = None, max_reads: float | None = None,
    gc_mad_cutoff: float | None = None, prune: bool = True, drop_sex_outliers: bool = False, chi_cutoff: float = 3.5, z_cutoff: float = 3.0, rule: str = "any_aberrant_score", min_controls: int = 10, ncv_sizes: tuple[int, int] = (1, 5), sex_ncv_sizes: tuple[int, int] = (6, 9), n_models: int = 4, n_predictors: int = 4,
) -> dict[str, DataFrame]:
    """Control group, chi profile, sex reference and score models of a cohort, published as a version below ``path``.

    A model that is there stays current until the new one is whole.

    Samples go by list (``include``, ``exclude``), by quality (``sample_qc``: ``sample_id, reads, gc``) and by rounds of
    correction and diagnosis (``prune``); ``membership`` says why. ``labels`` (``sample_id, sex``) are taken as they are,
    else two mixtures vote. With ``drop_sex_outliers`` the reference is made again without the first one's outliers.
    """
    spark = bins.sparkSession
    draft = bundles.Draft(spark, path)
    save = draft.save
    bins = bins.select("sample_id", "chrom", "bin", "n")
    member = cohort.decide_samples(bins, include, exclude)
    if sample_qc is not None:
        judged = cohort.qc_filter(sample_qc.join(member.where("decision = 'kept'"), "sample_id", "left_semi"), "reads", "gc", min_reads, max_reads, gc_mad_cutoff)
        member = member.join(judged.select("sample_id", "reasons"), "sample_id", "left").select("sample_id", F.when((F.col("decision") == "kept") & (F.coalesce("reasons", F.lit("")) != ""), F.col("reasons")).otherwise(F.col("decision")).alias("decision"))
    member = save(member, "first_membership")
    controls = save(bins.join(member.where("decision = 'kept'").select("sample_id"), "sample_id", "left_semi"), "first_controls")
    if prune:
        kept, _ = cohort.prune(controls, chi_cutoff, z_cutoff, rule, min_controls=min_controls, save=lambda df, name: save(df, f"prune-{name}"))
        controls = save(kept, "pruned_controls")

    def sexed(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[dict]]:
        totals = chromosome_totals(rows)
        f = sex.sex_fractions(totals)
        models = [sex.sex_model(f, m) for m in ("y_fraction", "xy_fraction")]
        named = labels.join(totals.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", "sex") if labels is not None else sex.predict_sex(f, models).select("sample_id", F.col("prediction").alias("sex"))
        return named, sex.build_reference(totals, named), models

    named, reference, models = sexed(controls)
    if drop_sex_outliers:
        bad = save(reference.where("outlier").select("sample_id"), "sex_outliers")
        controls = save(controls.join(bad, "sample_id", "left_anti"), "sexed_controls")
        named, reference, models = sexed(controls)
    left = controls.select("sample_id").distinct().withColumn("_left", F.lit(True))
    member = member.join(left, "sample_id", "left").select("sample_id", F.when((F.col("decision") == "kept") & F.col("_left").isNull(), "outlier").otherwise(F.col("decision")).alias("decision"))
    profile = save(chi.chi_profile(controls, chi_cutoff), "profile")
    corrected = chi.chi_correct(controls, profile)
    totals = save(chromosome_totals(corrected), "totals")
    reference = save(reference, "sex_reference")
    report = qc.control_group_qc(controls, chi_cutoff, z_cutoff, rule, named)
    settings = {"chi_cutoff": chi_cutoff, "z_cutoff": z_cutoff, "rule": rule, "prune": prune, "drop_sex_outliers": drop_sex_outliers, "labels": "given" if labels is not None else "predicted", "n_models": n_models, "n_predictors": n_predictors}
    out = {
        "settings": spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "key string, value string"), "membership": member, "controls": controls, "profile": profile, "fractions": fractions(totals), "labels": named, "sex_models": sex.model_table(spark, models), "sex_reference": reference,
        "ncv": scores.ncv_templates(totals, list(FOCI), *ncv_sizes), "sex_ncv": sex.sex_ncv_models(totals, reference, *sex_ncv_sizes), "sex_regression": sex.sex_regression_models(totals, reference, n_models, n_predictors),
        "qc_chromosomes": report["chromosomes"], "qc_samples": qc.sample_status(report["samples"]), "qc_bins": report["bins"], "qc_sex": report["sex"],
    }
    for name, df in out.items():
        if name not in ("profile", "sex_reference"):
            save(df, name)
    return bundles.load(spark, path, draft.commit(FRACTION_TABLES, settings_text(settings)))


def settings_text(settings: dict) -> dict[str, str]:
    return {k: str(v) for k, v in settings.items()}


def load_fraction_reference(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """Tables of the current model below ``path``, or of another version of it."""
    return bundles.load(spark, path, version)


def predict_fractions(cases: DataFrame, reference: dict[str, DataFrame], chi_corrected: bool = True, train_fraction: float = 0.6) -> dict[str, DataFrame]:
    """Scores of ``cases`` (``sample_id, chrom, bin, n``) against a stored reference, one pass for the whole cohort.

    ``autosomal`` (z of every chromosome), ``ncv``, ``regression``, ``sex`` (prediction and z), ``gonosomes`` and a
    ``summary`` row per sample: status, sex, and the scores of chromosomes 13, 18, 21, X and Y. A sample without reads
    on autosomes has status ``no_reads`` and no scores; it stops no other.
    """
    settings = {r["key"]: r["value"] for r in reference["settings"].collect()}
    models = [json.loads(r["model"]) for r in reference["sex_models"].orderBy(F.desc("method")).collect()]
    totals = chromosome_totals(chi.chi_correct(cases, reference["profile"]) if chi_corrected else cases)
    frac = fractions(totals)
    ctrl = reference["fractions"] if chi_corrected else fractions(chromosome_totals(reference["controls"]))
    names = cases.groupBy("sample_id").agg(F.sum(F.when(F.col("chrom") <= 22, F.col("n"))).alias("_reads")).select("sample_id", F.when(F.coalesce("_reads", F.lit(0)) > 0, "ok").otherwise("no_reads").alias("status"))
    usable = names.where("status = 'ok'").select("sample_id")
    totals, frac = totals.join(usable, "sample_id", "left_semi"), frac.join(usable, "sample_id", "left_semi")
    z = scores.z_score(frac.where("chrom <= 22"), ctrl.where("chrom <= 22"))
    ncv = scores.ncv_score(totals, reference["ncv"])
    rbz = scores.regression(frac, ctrl, list(FOCI), int(settings["n_models"]), int(settings["n_predictors"]), train_fraction=train_fraction)
    # Sex fractions as in the reference: of counts that chi has not touched.
    raw = chromosome_totals(cases).join(usable, "sample_id", "left_semi")
    called = sex.predict_sex(sex.sex_fractions(raw), models)
    sex_z = sex.sex_score(called, reference["sex_reference"])
    gono = sex.gonosome_report(sex_z, sex.sex_ncv_score(totals, reference["sex_ncv"]), sex.sex_regression_score(totals, reference["sex_regression"]))
    wide = lambda df, key, value, prefix, keys: df.groupBy("sample_id").pivot(key, keys).agg(F.first(value)).toDF("sample_id", *[f"{prefix}_{k}" for k in keys])
    summary = names.join(called.select("sample_id", F.col("prediction").alias("predicted_sex")), "sample_id", "left")
    for part in (wide(z, "chrom", "z", "z", list(FOCI)), wide(gono, "chromosome", "z_score", "z", ["X", "Y"]), wide(ncv, "focus", "z", "ncv", list(FOCI)), wide(rbz.where("model = 1"), "focus", "z", "rbz", list(FOCI))):
        summary = summary.join(part.withColumn("sample_id", F.col("sample_id").cast(dict(names.dtypes)["sample_id"])), "sample_id", "left")
    return {"autosomal": z, "ncv": ncv, "regression": rbz, "sex": sex_z, "gonosomes": gono, "summary": summary}


def preprocess_cohort(reads: DataFrame, lengths: DataFrame, gc_table: DataFrame, path: str, binsize: int = 50000, mapq: int = 0, exclude_flags: int = 0, rmdup: str = "none") -> dict[str, DataFrame]:
    """Counts, corrected counts and a quality row per sample, all samples at once, as tables below ``path``.

    A sample that lacks something required fails in ``sample_qc`` (``status``, ``missing``); the others go on.
    """
    save = save_as_tables(reads.sparkSession, path)
    bins = save(bin_reads(reads, lengths, binsize, mapq, 0, exclude_flags, rmdup), "bins")
    corrected = save(gc.bin_weight_correct(bins, gc_table), "corrected")
    before = reads.groupBy("sample_id", "chrom", F.floor(F.col("pos") / binsize).cast("int").alias("bin")).agg(F.count("*").alias("n_pre"), F.avg("mapq").alias("mean_mapq"))
    rows = gc.join_gc(before.join(bins.select("sample_id", "chrom", "bin", "n"), ["sample_id", "chrom", "bin"], "left").fillna(0, ["n"]), gc_table)
    layers = {
        "counts": count_metadata(rows.withColumn("gc_pre", F.col("gc")).withColumn("gc_post", F.col("gc"))), "alignment": alignment_stats(reads, mapq, 0, exclude_flags), "fractions": reference_frame(chromosome_totals(bins)),
        "sex": sex.sex_fractions(chromosome_totals(bins)),
    }
    return {"bins": bins, "corrected": corrected, "fit": save(gc.preprocess_qc(corrected), "fit"), "sample_qc": save(qc.sample_qc_rows(reads, layers), "sample_qc")}


def convert_table(spark: SparkSession, sam_path: str, out: str, binsize: int = 5000, **kw) -> DataFrame:
    """Alignment text to a partitioned Parquet table of bins."""
    from binfold.operators.reads import convert
    from binfold.sources.tables import read_sam, sam_lengths

    reads = read_sam(spark, sam_path)
    reads = reads.where(reads["chrom"].isin([str(i) for i in range(1, 25)])).withColumn("chrom", F.col("chrom").cast("int"))
    bins = convert(reads, sam_lengths(spark, sam_path), binsize, **kw)
    bins.write.mode("overwrite").partitionBy("sample_id").parquet(out)
    return spark.read.parquet(out)
