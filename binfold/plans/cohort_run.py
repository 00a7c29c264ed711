"""Cohort preprocessing in stages: a bad sample is noted and left out, and a run that broke off is taken up again.

A stage gets the samples that passed the one before and that it has not judged yet. It writes its rows and a verdict
for each sample (passed, or step, message and number), and then one commit file that names both. What has no commit
file never happened, so a run that dies leaves nothing half done, and the next run does only what is lacking. The
verdicts that are no pass are the ledger; later stages never see those samples.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.operators import gc, qc, sex
from binfold.operators.bins import chromosome_totals, count_metadata, reference_frame
from binfold.operators.reads import alignment_stats, bin_reads
from binfold.sources import storage, tables

STAGES = ("alignment", "counts", "gc", "qc")
VERDICT = "sample_id string, step string, message string, n long"


class StageStore:
    """Committed batches of every stage below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self, stage: str) -> list[str]:
        """Folders of the batches whose commit file stands."""
        folder = f"{self.path}/commits/{stage}"
        return [json.loads(storage.read_text(self.spark, f"{folder}/{n}"))["batch"] for n in storage.list_names(self.spark, folder) if not n.startswith(("_", "."))]

    def read(self, stage: str, part: str = "rows") -> DataFrame | None:
        paths = [f"{self.path}/{b}/{part}" for b in self.batches(stage)]
        return reduce(lambda a, b: a.unionByName(b), (self.spark.read.parquet(p) for p in paths)) if paths else None

    def verdicts(self, stage: str) -> DataFrame:
        """``sample_id, step, message, n`` of every sample that the stage has judged; no step where it passed."""
        found = self.read(stage, "verdicts")
        return self.spark.createDataFrame([], VERDICT) if found is None else found

    def passed(self, stage: str) -> DataFrame:
        return self.verdicts(stage).where("step is null").select("sample_id")

    def commit(self, stage: str, rows: Callable[[], DataFrame], verdicts: DataFrame) -> None:
        """Write verdicts, then the rows of what passed, then the commit file."""
        batch = f"{stage}/batch-{uuid.uuid4().hex}"
        verdicts.select("sample_id", "step", "message", F.col("n").cast("long").alias("n")).write.parquet(f"{self.path}/{batch}/verdicts")
        good = self.spark.read.parquet(f"{self.path}/{batch}/verdicts").where("step is null").select("sample_id")
        rows().join(good, "sample_id", "left_semi").write.parquet(f"{self.path}/{batch}/rows")
        storage.publish_text(self.spark, f"{self.path}/commits/{stage}/{uuid.uuid4().hex}.json", json.dumps({"batch": batch}))

    def forget(self, stage_names: tuple[str, ...], samples: list[str]) -> None:
        """Take samples out of stages, so that the next run judges them anew (their files were mended)."""
        for stage in stage_names:
            for name in storage.list_names(self.spark, folder := f"{self.path}/commits/{stage}"):
                batch = json.loads(storage.read_text(self.spark, f"{folder}/{name}"))["batch"]
                stays = f"{stage}/batch-{uuid.uuid4().hex}"
                for part in ("verdicts", "rows"):
                    self.spark.read.parquet(f"{self.path}/{batch}/{part}").where(~F.col("sample_id").isin(samples)).write.parquet(f"{self.path}/{stays}/{part}")
                storage.publish_text(self.spark, f"{folder}/{name}", json.dumps({"batch": stays}), replace=True)
                storage.delete(self.spark, f"{self.path}/{batch}")


def sample_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``sample_id, file, size`` of alignment files; nothing of a file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    folder = F.regexp_extract("path", r"/sample_id=([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.sam(\.gz)?$", "")
    return files.where("length > 0").select(F.when(folder != "", folder).otherwise(stem).alias("sample_id"), F.col("path").alias("file"), F.col("length").alias("size"))


def ledger(store: StageStore) -> DataFrame:
    """``sample_id, stage, step, message, n`` of every sample that some stage could not use."""
    parts = [store.verdicts(s).where("step is not null").select("sample_id", F.lit(s).alias("stage"), "step", "message", "n") for s in STAGES]
    return reduce(DataFrame.unionByName, parts)


def run_cohort(spark: SparkSession, sam_path: str, lengths: DataFrame, gc_table: DataFrame, path: str, binsize: int = 50000, mapq: int = 0, exclude_flags: int = 0, rmdup: str = "none") -> StageStore:
    """Alignment text of a cohort to counts, corrected counts and quality rows, sample by sample independent.

    ``alignment`` keeps parsed reads, and notes files without a header (step ``header``), with malformed lines
    (``parse``) or without reads (``reads``); ``counts`` notes samples of which no read passes the filters, ``gc``
    those without an eligible bin; ``qc`` has a row per sample that passed all. Only files of samples that
    ``alignment`` has not judged are opened.
    """
    store = StageStore(spark, path)

    def lacking(stage: str, candidates: DataFrame) -> DataFrame | None:
        todo = candidates.join(store.verdicts(stage).select("sample_id"), "sample_id", "left_anti")
        return None if todo.isEmpty() else todo

    todo = lacking("alignment", sample_files(spark, sam_path))
    if todo is not None:
        names = [r["file"] for r in todo.select("file").collect()]  # as many as the reader would list itself
        sample = tables.sample_of_file(r"\.sam(\.gz)?$")
        lines = tables.scan_sam(spark, names, sample)
        heads = spark.read.text(names).select("value", "_metadata").where(F.col("value").startswith("@SQ")).groupBy(sample.alias("sample_id")).agg(F.count("*").alias("heads"))
        # By sample and problem first, in numbers alone: an aggregate that keeps texts would sort all lines.
        kinds, wrong = lines.groupBy("sample_id", "problem").agg(F.count("*").alias("n"), F.min("read_no").alias("read_no")), F.col("problem").isNotNull()
        seen = kinds.groupBy("sample_id").agg(F.sum("n").alias("reads"), F.sum(F.when(wrong, F.col("n"))).alias("bad"), F.min_by("problem", F.when(wrong, F.col("read_no"))).alias("first"))
        judged = todo.select("sample_id").distinct().join(heads, "sample_id", "left").join(seen, "sample_id", "left").na.fill(0, ["heads", "reads", "bad"])
        step = F.when(F.col("bad") > 0, "parse").when(F.col("heads") == 0, "header").when(F.col("reads") == 0, "reads")
        message = F.when(F.col("bad") > 0, F.concat(F.lit("malformed lines, first: "), "first")).when(F.col("heads") == 0, "no @SQ line").when(F.col("reads") == 0, "no alignments")
        store.commit("alignment", lambda: lines.where("problem is null").drop("problem"), judged.select("sample_id", step.alias("step"), message.alias("message"), F.when(F.col("bad") > 0, F.col("bad")).otherwise(0).alias("n")))

    nuclear = F.col("chrom").isin([str(i) for i in range(1, 25)])

    def own(stage: str, part: DataFrame) -> DataFrame:
        return store.read(stage).join(part, "sample_id", "left_semi")

    def reads(part: DataFrame) -> DataFrame:
        return own("alignment", part).where(nuclear).withColumn("chrom", F.col("chrom").cast("int"))

    todo = lacking("counts", store.passed("alignment"))
    if todo is not None:
        counted = bin_reads(reads(todo), lengths, binsize, mapq, 0, exclude_flags, rmdup)
        judged = own("alignment", todo).groupBy("sample_id").agg(F.count("*").alias("all")).join(counted.groupBy("sample_id").agg(F.sum("n").alias("used")), "sample_id", "left")
        step = F.when(F.coalesce("used", F.lit(0)) == 0, "filter")
        store.commit("counts", lambda: counted, judged.select("sample_id", step.alias("step"), F.when(step.isNotNull(), "no read passes the filters").alias("message"), F.when(step.isNotNull(), F.col("all")).otherwise(0).alias("n")))

    todo = lacking("gc", store.passed("counts"))
    if todo is not None:
        bins = own("counts", todo)
        # Without an eligible bin there is no curve, so such samples go before the fit.
        usable = gc.join_gc(bins, gc_table).groupBy("sample_id").agg(F.count_if((F.col("chrom") <= 22) & (F.col("n") > 0) & F.col("gc").isNotNull()).alias("usable"))
        step = F.when(F.col("usable") == 0, "fit")
        judged = usable.select("sample_id", step.alias("step"), F.when(step.isNotNull(), "no autosomal bin has reads and a GC value").alias("message"), F.lit(0).alias("n"))
        store.commit("gc", lambda: gc.bin_weight_correct(bins.join(usable.where("usable > 0").select("sample_id"), "sample_id", "left_semi"), gc_table), judged)

    todo = lacking("qc", store.passed("gc"))
    if todo is not None:
        mine, bins = reads(todo), own("counts", todo)
        before = mine.groupBy("sample_id", "chrom", F.floor(F.col("pos") / binsize).cast("int").alias("bin")).agg(F.count("*").alias("n_pre"), F.avg("mapq").alias("mean_mapq"))
        rows = gc.join_gc(before.join(bins.select("sample_id", "chrom", "bin", "n"), ["sample_id", "chrom", "bin"], "left").fillna(0, ["n"]), gc_table)
        layers = {
            "counts": count_metadata(rows.withColumn("gc_pre", F.col("gc")).withColumn("gc_post", F.col("gc"))), "alignment": alignment_stats(mine, mapq, 0, exclude_flags),
            "fractions": reference_frame(chromosome_totals(bins)), "sex": sex.sex_fractions(chromosome_totals(bins)),
        }
        made = qc.sample_qc_rows(mine, layers)
        step = F.when(F.col("status") != "success", "layers")
        store.commit("qc", lambda: made, made.select("sample_id", step.alias("step"), F.when(step.isNotNull(), F.concat(F.lit("missing: "), F.col("missing").cast("string"))).alias("message"), F.lit(0).alias("n")))
    return store


def cohort_status(store: StageStore, samples: DataFrame) -> DataFrame:
    """A row per sample: ``sample_id, sample_processing_status, sample_failure_stage, sample_failure_step, sample_failure_message``."""
    failed = ledger(store).select("sample_id", F.col("stage").alias("sample_failure_stage"), F.col("step").alias("sample_failure_step"), F.col("message").alias("sample_failure_message"))
    done = store.passed("qc").withColumn("_done", F.lit(True))
    status = F.when(F.col("_done"), "success").when(F.col("sample_failure_stage").isNotNull(), "failed").otherwise("pending")
    rows = samples.select("sample_id").distinct().join(done, "sample_id", "left").join(failed, "sample_id", "left")
    return rows.select("sample_id", status.alias("sample_processing_status"), "sample_failure_stage", "sample_failure_step", "sample_failure_message")
