"""Command line: ``python -m binfold convert | gc | reference | predict | fraction-reference | fraction-predict | qc | compare``.

A stage works on all samples of its input at once; tables are Parquet, reports tab-separated.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from binfold.operators import chi, cnv_predict, cnv_reference, gc, qc
from binfold.operators.bins import grid
from binfold.plans.workflows import build_fraction_reference, convert_table, ensure_checkpoint_dir, load_fraction_reference, predict_fractions, save_as_tables, save_in_checkpoints
from binfold.sources import sinks, tables


def _convert(spark: SparkSession, a: argparse.Namespace) -> None:
    convert_table(spark, a.input, a.output, a.binsize, mapq=a.mapq, require_flags=a.require_flags, exclude_flags=a.exclude_flags, rmdup=a.rmdup, order=["read_no"])


def _gc(spark: SparkSession, a: argparse.Namespace) -> None:
    table = gc.gc_from_bases(tables.read_fasta(spark, a.input), a.binsize).where(F.col("chrom").isin([str(i) for i in range(1, 25)]))
    sinks.write_bed(table.withColumn("chrom", F.col("chrom").cast("int")).withColumn("seq_len", F.lit(a.binsize)), a.output, a.binsize, ["gc", "seq_len"])


def _reference(spark: SparkSession, a: argparse.Namespace) -> None:
    bins = spark.read.parquet(a.input).select("sample_id", "chrom", "bin", "n")
    cnv_reference.newref(bins, nipt=a.nipt, refsize=a.refsize, yfrac=a.yfrac, binsize=a.binsize, save=save_as_tables(spark, a.output))
    read = lambda name: spark.read.parquet(f"{a.output}/{name}")
    sinks.write_json(cnv_reference.reference_qc(read("knn"), a.min_refs, mask=read("mask")), f"{a.output}/qc_json")


def _predict(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cutoff, reference size and NIPT mode are those of the reference; ``--yfrac`` and ``--gender`` overrule the cutoff."""
    ref = {n: spark.read.parquet(f"{a.reference}/{n}") for n in ("bins", "knn", "null_ratio", "meta")}
    meta = ref["meta"].first()
    binsize = a.binsize or meta["binsize"]
    if not binsize:
        raise SystemExit("give --binsize: the reference does not name one")
    cases = spark.read.parquet(a.input).select("sample_id", "chrom", "bin", "n")
    genders = cnv_reference.predict_gender(cnv_reference.y_fraction(cases), meta["gender_cutoff"] if a.yfrac is None else a.yfrac) if a.gender is None else cases.select("sample_id").distinct().withColumn("gender", F.lit(a.gender))
    cases = cnv_reference.gender_correct(cases, genders, nipt=meta["nipt"]).drop("gender")
    if meta["nipt"]:  # one gonosome branch, whatever the label says
        genders = genders.withColumn("gender", F.lit("F"))
    lengths = cases.groupBy("chrom").agg(((F.max("bin") + 1) * binsize).alias("length"))
    black = cnv_predict.blacklist_bins(tables.read_blacklist(spark, a.blacklist), binsize) if a.blacklist else None
    out = cnv_predict.predict(cases, ref, genders, grid(cases, lengths, binsize), binsize, min_refs=a.min_refs, zscore=a.zscore, beta=a.beta, blacklist=black, refsize=meta["refsize"], save=save_in_checkpoints(spark))
    sinks.write_prediction(out, a.output, binsize)
    sinks.write_report(out["statistics"], f"{a.output}_profile")


def _fraction_reference(spark: SparkSession, a: argparse.Namespace) -> None:
    bins = spark.read.parquet(a.input)
    names = lambda p: tables.read_list(spark, p).select(F.col("item").alias("sample_id")) if p else None
    labels = tables.read_metrics(spark, a.labels).select("sample_id", "sex") if a.labels else None
    out = build_fraction_reference(bins.withColumn("sample_id", F.col("sample_id").cast("string")), a.output, labels, names(a.include), names(a.exclude), prune=not a.keep_outliers, drop_sex_outliers=a.drop_sex_outliers, min_controls=a.min_controls)
    for name in ("membership", "qc_chromosomes", "qc_samples", "qc_bins", "qc_sex", "settings"):
        sinks.write_report(out[name], f"{a.output}/text/{name}")


def _fraction_predict(spark: SparkSession, a: argparse.Namespace) -> None:
    cases = spark.read.parquet(a.input).withColumn("sample_id", F.col("sample_id").cast("string"))
    out = predict_fractions(cases, load_fraction_reference(spark, a.reference), chi_corrected=not a.raw)
    for name, df in out.items():
        flat = df.select(*[F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes if not t.startswith("map")])
        sinks.write_report(flat, f"{a.output}/{name}")


def _qc(spark: SparkSession, a: argparse.Namespace) -> None:
    bins = spark.read.parquet(a.input)
    for name, df in qc.control_group_qc(bins).items():
        sinks.write_report(df, f"{a.output}/{name}")
    sinks.write_report(chi.chi_bin_summary(chi.chi_profile(bins)), f"{a.output}/bin_summary")


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    keys = a.keys.split(",")
    left, right = (tables.read_metrics(spark, p).withColumn(a.value, F.col(a.value).try_cast("double")) for p in (a.input, a.other))
    qc.compare_results(left, right, keys, a.value, a.tolerance).show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="binfold")
    sub = p.add_subparsers(required=True)

    def command(name, run, *args):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("input")
        for flag, kw in args:
            c.add_argument(flag, **kw)

    number = lambda default, kind=int: {"type": kind, "default": default}
    command("convert", _convert, ("output", {}), ("--binsize", number(5000)), ("--mapq", number(1)), ("--require-flags", number(0)), ("--exclude-flags", number(0)), ("--rmdup", {"default": "streaming", "choices": ["streaming", "flag", "none"]}))
    command("gc", _gc, ("output", {}), ("--binsize", number(50000)))
    command("reference", _reference, ("output", {}), ("--refsize", number(300)), ("--nipt", {"action": "store_true"}), ("--yfrac", number(None, float)), ("--min-refs", number(150)), ("--binsize", number(None)))
    command("predict", _predict, ("reference", {}), ("output", {}), ("--binsize", number(None)), ("--min-refs", number(150)), ("--zscore", number(5.0, float)), ("--beta", number(None, float)), ("--yfrac", number(None, float)), ("--gender", {"choices": ["F", "M"]}), ("--blacklist", {}))
    command("fraction-reference", _fraction_reference, ("output", {}), ("--labels", {}), ("--include", {}), ("--exclude", {}), ("--keep-outliers", {"action": "store_true"}), ("--drop-sex-outliers", {"action": "store_true"}), ("--min-controls", number(10)))
    command("fraction-predict", _fraction_predict, ("reference", {}), ("output", {}), ("--raw", {"action": "store_true"}))
    command("qc", _qc, ("output", {}))
    command("compare", _compare, ("other", {}), ("--keys", {"default": "chr,start,end"}), ("--value", {"default": "ratio"}), ("--tolerance", number(1e-6, float)))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("binfold").getOrCreate()
    ensure_checkpoint_dir(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
