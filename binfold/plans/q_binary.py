"""Queries of binary alignments: all reads written in the format, and read again in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.operators import reads as R
from binfold.plans import data
from binfold.plans.data import READS
from binfold.plans.q_relational import _STATS
from binfold.plans.q_sources import _folder
from binfold.plans.registry import query
from binfold.sources.bam import bam_lengths, read_bam, write_bam

W = f"WITH {READS}"
#: Small, so that files of the test tables also have several splits.
SPLIT = 1 << 15


def binary_reads(spark: SparkSession, d: str, columns: str = "*") -> DataFrame:
    path = _folder(spark, "bam")
    write_bam(data.reads(spark, d).withColumn("name", F.col("l_orderkey")), data.lengths(spark), path)
    rows = read_bam(spark, path, SPLIT).withColumn("sample_id", F.col("sample_id").cast("int"))
    return rows.withColumn("chrom", F.col("chrom").try_cast("int")).withColumn("mate_chrom", F.col("mate_chrom").try_cast("int"))


@query("a01b_binary_scan", f"{W} SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n, count(*) FILTER (WHERE flag & 16 = 0) AS n_fwd, count(*) FILTER (WHERE flag & 16 <> 0) AS n_rev FROM reads WHERE mapq >= 1 AND flag & 1024 = 0 GROUP BY 1, 2, 3")
def a01b(spark, d):
    return R.bin_counts(R.remove_duplicates(R.filter_reads(binary_reads(spark, d), mapq=1), "flag"), 50000)


@query("a02b_binary_header", f"{W} SELECT sample_id, CAST(range AS INT) AS chrom, CAST(1000000 AS BIGINT) AS length FROM (SELECT DISTINCT sample_id FROM reads) CROSS JOIN range(1, 25)")
def a02b(spark, d):
    path = _folder(spark, "bam")
    write_bam(data.reads(spark, d).withColumn("name", F.col("l_orderkey")), data.lengths(spark), path)
    return bam_lengths(spark, path).distinct().select(F.col("sample_id").cast("int").alias("sample_id"), F.col("chrom").cast("int").alias("chrom"), "length")


@query("a03b_binary_idxstats", f"{W} SELECT sample_id, chrom, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 4 <> 0) AS unmapped FROM reads GROUP BY 1, 2")
def a03b(spark, d):
    return R.idxstats(binary_reads(spark, d))


@query("a13b_binary_stats", f"{_STATS} SELECT * EXCLUDE (error_rate, duplicated_read_fraction, duplicated_base_fraction) FROM st")
def a13b(spark, d):
    s = R.alignment_stats(binary_reads(spark, d), mapq=5, exclude_flags=512)
    return s.drop("error_rate", "duplicated_read_fraction", "duplicated_base_fraction")
