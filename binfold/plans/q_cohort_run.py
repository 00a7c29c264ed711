"""Queries of the staged cohort run: full results of the good samples, the ledger of the others, and a run taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.plans import data
from binfold.plans.cohort_run import StageStore, cohort_status, ledger, run_cohort, sample_files
from binfold.plans.data import READS
from binfold.plans.q_sources import _folder, by_sample, sam_lines
from binfold.plans.registry import query
from binfold.sources import storage

W = f"WITH {READS}"
#: Samples that the test cohort damages: lines cut short, a file of a header alone, and reads that no filter lets through.
CUT, BARE, POOR = 3, 7, 9


def write_cohort(spark: SparkSession, d: str, folder: str, damaged: bool) -> str:
    """The read view as alignment text, a folder a sample with one header in it; some samples damaged on request."""
    reads = data.reads(spark, d)
    names = reads.select("sample_id").distinct()
    if damaged:
        reads = reads.where(F.col("sample_id") != BARE).withColumn("mapq", F.when(F.col("sample_id") == POOR, 0).otherwise(F.col("mapq")))
    lines = sam_lines(reads).withColumn("o", F.lit(1))
    if damaged:
        broken = (F.col("sample_id") == CUT) & (F.xxhash64("value") % 7 == 0)
        lines = lines.withColumn("value", F.when(broken, F.array_join(F.slice(F.split("value", "\t"), 1, 5), "\t")).otherwise(F.col("value")))
    heads = names.join(data.lengths(spark)).select("sample_id", F.concat(F.lit("@SQ\tSN:chr"), F.expr("CASE chrom WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(chrom AS STRING) END"), F.lit("\tLN:"), F.col("length").cast("string")).alias("value"), F.lit(0).alias("o"))
    by_sample(lines.unionByName(heads)).sortWithinPartitions("sample_id", "o").select("sample_id", "value").write.mode("overwrite").partitionBy("sample_id").text(folder)
    return folder


def _run(spark: SparkSession, sam: str, out: str) -> StageStore:
    return run_cohort(spark, sam, data.lengths(spark), data.gc_table(spark), out, 50000, 10, 1024)


def _results(store: StageStore) -> DataFrame:
    return store.read("qc").select(F.col("sample_id").cast("int").alias("sample_id"), "pre_sum", "post_sum", "nonzero_bins", F.round("y_frac", 9).alias("y_frac"), "status")


_RESULTS = f"""c AS (SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n FROM reads WHERE mapq >= 10 AND flag & 1024 = 0 GROUP BY 1, 2, 3),
s AS (SELECT sample_id, CAST(sum(n) AS BIGINT) AS post_sum, count(*) AS nonzero_bins, round(CAST(sum(CASE WHEN chrom = 24 THEN n END) AS DOUBLE) / sum(CASE WHEN chrom <= 22 THEN n END), 9) AS y_frac FROM c GROUP BY 1), p AS (SELECT sample_id, count(*) AS pre_sum FROM reads GROUP BY 1)
SELECT sample_id, pre_sum, post_sum, nonzero_bins, y_frac, 'success' AS status FROM s JOIN p USING (sample_id)"""


@query("m01b_damaged_cohort", f"{W}, {_RESULTS} WHERE sample_id NOT IN ({CUT}, {BARE}, {POOR})")
def m01b(spark, d):
    """Three of twenty alignment files are damaged in three ways; the others have their full results."""
    return _results(_run(spark, write_cohort(spark, d, _folder(spark, "sam"), True), _folder(spark, "cohort")))


@query("m01c_failure_ledger", f"""{W} SELECT CAST({BARE} AS VARCHAR) AS sample_id, 'alignment' AS stage, 'reads' AS step, 'no alignments' AS message, CAST(0 AS BIGINT) AS reads UNION ALL SELECT CAST({CUT} AS VARCHAR), 'alignment', 'parse', 'malformed lines, first: fewer than 11 columns', 1
UNION ALL SELECT CAST({POOR} AS VARCHAR), 'counts', 'filter', 'no read passes the filters', count(*) FROM reads WHERE sample_id = {POOR}""")
def m01c(spark, d):
    """The ledger of the damaged cohort; of the malformed lines only that there are some (Spark's hash chose them)."""
    rows = ledger(_run(spark, write_cohort(spark, d, _folder(spark, "sam"), True), _folder(spark, "cohort")))
    return rows.select("sample_id", "stage", "step", "message", F.when(F.col("step") == "parse", F.least("n", F.lit(1))).otherwise(F.col("n")).cast("long").alias("reads"))


@query("m01d_resumed_cohort", f"{W}, {_RESULTS}")
def m01d(spark, d):
    """A damaged cohort whose run breaks off before the last stage; then its files are mended and it is run again."""
    sam, out = write_cohort(spark, d, _folder(spark, "sam"), True), _folder(spark, "cohort")
    store = _run(spark, sam, out)
    storage.delete(spark, f"{out}/commits/qc")  # what a run leaves that dies there
    write_cohort(spark, d, sam, False)
    store.forget(("alignment", "counts"), [str(s) for s in (CUT, BARE, POOR)])
    return _results(_run(spark, sam, out))


@query("m01e_cohort_status", f"{W} SELECT CAST(sample_id AS VARCHAR) AS sample_id, CASE WHEN sample_id IN ({CUT}, {BARE}, {POOR}) THEN 'failed' ELSE 'success' END AS status, CASE WHEN sample_id = {POOR} THEN 'counts' WHEN sample_id IN ({CUT}, {BARE}) THEN 'alignment' END AS stage FROM (SELECT DISTINCT sample_id FROM reads)")
def m01e(spark, d):
    sam = write_cohort(spark, d, _folder(spark, "sam"), True)
    status = cohort_status(_run(spark, sam, _folder(spark, "cohort")), sample_files(spark, sam))
    return status.select("sample_id", F.col("sample_processing_status").alias("status"), F.col("sample_failure_stage").alias("stage"))
