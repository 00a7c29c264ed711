"""Queries of indexed interval files and of depth over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.operators import reads as R
from binfold.plans import data
from binfold.plans.data import READS
from binfold.plans.q_sources import _folder
from binfold.plans.registry import query
from binfold.sources import regions as G
from binfold.sources import tables

W = f"WITH {READS}"
#: Asked regions by rule: of 40 numbers k, chromosome 1 + 7 k mod 24, from 23,000 k on, 10,000 k mod 90,000 + 1 long.
ASKED = "SELECT CAST(k AS INT) AS region, CAST(1 + (7 * k) % 24 AS INT) AS chrom, CAST(23000 * k AS BIGINT) AS {start}, CAST(23000 * k + (10000 * k) % 90000 + 1 AS BIGINT) AS {end}"


def regions(spark: SparkSession) -> DataFrame:
    return spark.range(40).withColumnRenamed("id", "k").selectExpr(*ASKED.removeprefix("SELECT ").format(start="`start`", end="`end`").replace(", CAST", ";CAST").split(";"))


def indexed_reads(spark: SparkSession, d: str, parts: int | None = 8) -> str:
    path = _folder(spark, "indexed")
    rows = data.reads(spark, d).select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.col("seq_len")).alias("end"), "sample_id", "mapq")
    G.write_indexed(rows, path, ["sample_id", "mapq"], {"binsize": "50000"}, parts)
    return path


_OVER = f"{W}, asked AS ({ASKED.format(start='s', end='e')} FROM range(40) AS t(k)), hit AS (SELECT region, sample_id, pos, mapq FROM asked JOIN reads ON reads.chrom = asked.chrom AND pos < e AND greatest(pos + seq_len, pos + 1) > s)"


@query("a26b_region_read", f"{_OVER} SELECT region, sample_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, CAST(sum(mapq) AS BIGINT) AS sum_mapq FROM hit GROUP BY 1, 2")
def a26b(spark, d):
    """All reads as an indexed interval file; forty regions asked at once."""
    found = G.read_regions_of(spark, indexed_reads(spark, d), regions(spark), 5)
    return found.groupBy("region", F.col("column3").cast("int").alias("sample_id")).agg(F.count("*").alias("n"), F.sum(F.col("column1").cast("long")).alias("sum_pos"), F.sum(F.col("column4").cast("long")).alias("sum_mapq"))


@query("a26c_index_bins", f"{W} SELECT chrom, count(*) AS n FROM reads GROUP BY 1")
def a26c(spark, d):
    """The index knows every row: rows of all stretches by chromosome."""
    path = indexed_reads(spark, d)
    return spark.read.parquet(f"{path}/index/bins").groupBy("chrom").agg(F.sum("n").alias("n"))


@query("a04b_plain_read_of_indexed", f"{W} SELECT chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM reads GROUP BY 1")
def a04b(spark, d):
    """The same files read without their index, header lines skipped."""
    rows = tables.read_tabix(spark, f"{indexed_reads(spark, d)}/body", 3)
    return rows.groupBy(F.expr("CASE column0 WHEN 'X' THEN 23 WHEN 'Y' THEN 24 ELSE CAST(column0 AS INT) END").alias("chrom")).agg(F.count("*").alias("n"), F.sum(F.col("column1").cast("long")).alias("sum_pos"))


#: CIGARs of the view with deletions, insertions, skips and clips: a M, d D, 5 I, 30 M, s N, 8 =, 2 S.
_PARTS = {"a": "20 + l_linenumber * 10", "d": "l_linenumber % 4", "s": "500 * (l_orderkey % 3)"}
_CIGAR = f"CASE WHEN l_partkey % 53 = 0 THEN '*' ELSE concat(CAST({_PARTS['a']} AS STRING), 'M', CAST({_PARTS['d']} AS STRING), 'D5I30M', CAST({_PARTS['s']} AS STRING), 'N8=2S') END"
_BLOCKS = f"c AS (SELECT sample_id, chrom, pos, {_PARTS['a']} AS a, {_PARTS['d']} AS d, {_PARTS['s']} AS s FROM reads WHERE l_partkey % 53 <> 0)"


def _events_sql(blocks: str) -> str:
    return f"""{W}, {_BLOCKS}, b AS ({blocks}), e AS (SELECT sample_id, chrom, p0, sum(d) AS d FROM (SELECT sample_id, chrom, x AS p0, 1 AS d FROM b UNION ALL SELECT sample_id, chrom, y, -1 FROM b) GROUP BY 1, 2, 3),
p AS (SELECT sample_id, chrom, sum(d) OVER w AS depth, lead(p0) OVER w - p0 AS len FROM e WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY p0)),
q AS (SELECT sample_id, chrom, CAST(sum(len) AS BIGINT) AS length, CAST(sum(len * depth) AS BIGINT) AS bases, CAST(min(depth) AS BIGINT) AS min, CAST(max(depth) AS BIGINT) AS max FROM p WHERE len IS NOT NULL AND depth > 0 GROUP BY 1, 2)"""


_GAPS = "SELECT sample_id, chrom, pos AS x, pos + a AS y FROM c UNION ALL SELECT sample_id, chrom, pos + a + d, pos + a + d + 30 FROM c UNION ALL SELECT sample_id, chrom, pos + a + d + 30 + s, pos + a + d + 38 + s FROM c"


@query("a12b_cigar_depth", f"{_events_sql(_GAPS)} SELECT *, round(CAST(bases AS DOUBLE) / length, 9) AS mean FROM q")
def a12b(spark, d):
    """Depth of the aligned stretches, without deletions and skips."""
    reads = data.reads(spark, d).withColumn("cigar", F.expr(_CIGAR))
    return R.depth(reads, "gaps").withColumn("mean", F.round("mean", 9))


@query("a12c_coverage_summary", f"""{_events_sql("SELECT sample_id, chrom, pos AS x, pos + a + d + 38 + s AS y FROM c")}, g AS (SELECT s.sample_id, CAST(range AS VARCHAR) AS chrom, CAST(1000000 AS BIGINT) AS length, coalesce(bases, 0) AS bases, CASE WHEN coalesce(q.length, 0) < 1000000 THEN 0 ELSE min END AS min, coalesce(max, 0) AS max FROM (SELECT DISTINCT sample_id FROM reads) AS s CROSS JOIN range(1, 25) LEFT JOIN q ON q.sample_id = s.sample_id AND q.chrom = range),
t AS (SELECT * FROM g UNION ALL SELECT sample_id, 'total', CAST(sum(length) AS BIGINT), CAST(sum(bases) AS BIGINT), min(min), max(max) FROM g GROUP BY 1) SELECT *, round(CAST(bases AS DOUBLE) / length, 9) AS mean FROM t""")
def a12c(spark, d):
    """The summary of whole chromosomes and the genome, from first to last aligned base."""
    reads = data.reads(spark, d).withColumn("cigar", F.expr(_CIGAR))
    return R.coverage_summary(reads, data.lengths(spark)).withColumn("mean", F.round("mean", 9))
