"""A read-depth view of the star-schema tables, as one SQL text that Spark and DuckDB both run.

``lineitem`` rows become reads of up to 20 samples on 24 chromosomes of 1 Mb (23 and 24 are X and Y). Bits of
``flag`` follow from keys. ``read_no`` columns make the order of reads at one position total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, BINSIZE, N_BINS = 1_000_000, 50_000, 20
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

COLUMNS = {
    "sample_id": "CAST(l_suppkey % 20 AS INT)",
    "chrom": "CAST(1 + l_partkey % 24 AS INT)",
    "pos": "CAST((l_orderkey * 37 + l_linenumber * 1009) % 1000000 AS BIGINT)",
    "mate_pos": "CAST((l_orderkey * 41 + l_linenumber * 977) % 1000000 AS BIGINT)",
    "mate_chrom": "CAST(1 + (l_partkey + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 24 AS INT)",
    "strand": "CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END",
    "mapq": "CAST(l_quantity AS INT)",
    "flag": (
        "CAST((CASE WHEN l_orderkey % 2 = 1 THEN 1 ELSE 0 END) + (CASE WHEN l_orderkey % 2 = 1 AND l_partkey % 10 < 9 THEN 2 ELSE 0 END) + (CASE WHEN l_suppkey % 83 = 0 THEN 4 ELSE 0 END)"
        " + (CASE WHEN l_orderkey % 13 = 0 THEN 8 ELSE 0 END) + (CASE l_linenumber % 4 WHEN 0 THEN 64 WHEN 1 THEN 128 WHEN 2 THEN 192 ELSE 0 END) + (CASE WHEN l_partkey % 71 = 0 THEN 512 ELSE 0 END) + (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 16 END) + (CASE WHEN l_partkey % 97 = 0 THEN 256 ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END) + (CASE WHEN l_partkey % 89 = 0 THEN 2048 ELSE 0 END) AS INT)"
    ),
    "seq_len": "CAST(CASE WHEN l_linenumber = 7 AND l_orderkey % 5 = 0 THEN 0 ELSE 30 + l_linenumber * 10 END AS INT)",
    "nm": "CAST(l_quantity AS INT) % 5",
    "cigar": "concat(CAST(20 + l_linenumber * 10 AS STRING), 'M2I1D', CAST(8 AS STRING), 'M')",
}

#: Common table expressions for DuckDB texts.
READS = "reads AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()).replace("AS STRING", "AS VARCHAR") + ", " + ", ".join(ORDER) + " FROM lineitem)"
#: Reads left by consecutive-position duplicate removal without a quality filter.
KEPT = (
    "ordered AS (SELECT *, lag(pos) OVER w AS p0, last_value(CASE WHEN flag & 1 = 1 THEN mate_pos END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m0 FROM reads WHERE NOT (flag & 1 = 1 AND flag & 2 = 0) WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos, " + ", ".join(ORDER) + ")), "
    "kept AS (SELECT * FROM ordered WHERE NOT (pos IS NOT DISTINCT FROM p0 AND (flag & 1 = 0 OR mate_pos IS NOT DISTINCT FROM m0)))"
)
GC = "0.35 + ((chrom * 7 + bin * 13) % 30) / 100.0"
GRID = "grid AS (SELECT sample_id, chrom, bin FROM (SELECT DISTINCT sample_id FROM reads) CROSS JOIN (SELECT CAST(range AS INT) AS chrom FROM range(1, 25)) CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(0, 20)))"
COUNTS = "counts AS (SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n, count(*) FILTER (WHERE flag & 16 = 0) AS n_fwd, count(*) FILTER (WHERE flag & 16 <> 0) AS n_rev FROM reads WHERE mapq >= 1 GROUP BY 1, 2, 3)"
DENSE = f"{GRID}, {COUNTS}, dense AS (SELECT sample_id, chrom, bin, coalesce(n, 0) AS n, coalesce(n_fwd, 0) AS n_fwd, coalesce(n_rev, 0) AS n_rev FROM grid LEFT JOIN counts USING (sample_id, chrom, bin))"
TOTALS = "totals AS (SELECT sample_id, chrom, CAST(sum(n) AS BIGINT) AS reads FROM dense GROUP BY 1, 2)"
FRACS = "fracs AS (SELECT sample_id, chrom, reads, coalesce(reads / nullif(sum(CASE WHEN chrom <= 22 THEN reads END) OVER (PARTITION BY sample_id), 0), 0) AS frac FROM totals)"
BASE = f"WITH {READS}, {DENSE}, {TOTALS}, {FRACS}"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns that a query uses reach the scan."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{v} AS {k}" for k, v in COLUMNS.items()], *ORDER)


def lengths(spark: SparkSession) -> DataFrame:
    return spark.range(1, 25).select(F.col("id").cast("int").alias("chrom"), F.lit(LENGTH).cast("long").alias("length"))


def gc_table(spark: SparkSession) -> DataFrame:
    """A fraction per bin from a rule; every 60th bin has no callable base."""
    cells = spark.range(1, 25).select(F.col("id").cast("int").alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(N_BINS - 1))).alias("bin"))
    return cells.selectExpr("chrom", "bin", f"CAST(CASE WHEN (chrom * 20 + bin) % 60 = 0 THEN NULL ELSE {GC} END AS DOUBLE) AS gc")


GC_CTE = f"gct AS (SELECT CAST(c.range AS INT) AS chrom, CAST(b.range AS INT) AS bin, CAST(CASE WHEN (c.range * 20 + b.range) % 60 = 0 THEN NULL ELSE {GC.replace('chrom', 'c.range').replace('bin', 'b.range')} END AS DOUBLE) AS gc FROM range(1, 25) AS c CROSS JOIN range(0, 20) AS b)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.operators.reads import bin_counts, filter_reads

    return bin_counts(filter_reads(reads(spark, sf_dir), mapq=1), BINSIZE)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.operators.bins import densify

    r = reads(spark, sf_dir)
    return densify(counts(spark, sf_dir), lengths(spark), BINSIZE, samples=r)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from binfold.operators.bins import chromosome_totals

    return chromosome_totals(dense(spark, sf_dir))
