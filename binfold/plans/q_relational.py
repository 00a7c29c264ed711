"""Queries of filters, joins, aggregates, windows, sorts and set operations over the read view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from binfold.functions.safe import chrom_key, chrom_label, safe_corr, safe_div
from binfold.operators import bins as B
from binfold.operators import cohort, gc, qc
from binfold.operators import reads as R
from binfold.plans import data
from binfold.plans.data import BASE, GC_CTE, ORDER, READS
from binfold.plans.registry import query

W = f"WITH {READS}"


def _counted(df):
    return df.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


def _counted_sql(where: str) -> str:
    return f"{W} SELECT sample_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM reads WHERE {where} GROUP BY 1"


# --- A, B: scans and filters -----------------------------------------------------------------------------------------


@query("a01_bin_scan", f"{W} SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n, count(*) FILTER (WHERE flag & 16 = 0) AS n_fwd, count(*) FILTER (WHERE flag & 16 <> 0) AS n_rev FROM reads WHERE mapq >= 1 AND flag & 1024 = 0 GROUP BY 1, 2, 3")
def a01(spark, d):
    return R.bin_counts(R.remove_duplicates(R.filter_reads(data.reads(spark, d), mapq=1), "flag"), 50000)


@query("a03_idxstats", f"{W} SELECT sample_id, chrom, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 4 <> 0) AS unmapped FROM reads GROUP BY 1, 2")
def a03(spark, d):
    return R.idxstats(data.reads(spark, d))


@query("a12_depth", f"""{W}, e AS (SELECT sample_id, chrom, pos AS p0, 1 AS d FROM reads UNION ALL SELECT sample_id, chrom, pos + seq_len, -1 FROM reads), s AS (SELECT sample_id, chrom, p0, sum(d) AS d FROM e GROUP BY 1, 2, 3),
p AS (SELECT sample_id, chrom, sum(d) OVER (PARTITION BY sample_id, chrom ORDER BY p0) AS depth, lead(p0) OVER (PARTITION BY sample_id, chrom ORDER BY p0) - p0 AS len FROM s)
SELECT sample_id, chrom, CAST(sum(len) AS BIGINT) AS length, CAST(sum(len * depth) AS BIGINT) AS bases, CAST(min(depth) AS BIGINT) AS min, CAST(max(depth) AS BIGINT) AS max, round(CAST(sum(len * depth) AS DOUBLE) / sum(len), 9) AS mean FROM p WHERE len IS NOT NULL AND depth > 0 GROUP BY 1, 2""")
def a12(spark, d):
    return R.depth(data.reads(spark, d)).withColumn("mean", F.round("mean", 9))


@query("b01_min_mapq", _counted_sql("mapq >= 30"))
def b01(spark, d):
    return _counted(R.filter_reads(data.reads(spark, d), mapq=30))


@query("b02_require_flags", _counted_sql("flag & 3 = 3"))
def b02(spark, d):
    return _counted(R.filter_reads(data.reads(spark, d), require_flags=3))


@query("b03_exclude_flags", _counted_sql("flag & 2304 = 0"))
def b03(spark, d):
    return _counted(R.filter_reads(data.reads(spark, d), exclude_flags=2304))


@query("b04_duplicate_flag", _counted_sql("flag & 1024 = 0"))
def b04(spark, d):
    return _counted(R.remove_duplicates(data.reads(spark, d), "flag"))


@query("b05_proper_pairs", _counted_sql("NOT (flag & 1 = 1 AND flag & 2 = 0)"))
def b05(spark, d):
    return _counted(R.proper_or_single(data.reads(spark, d)))


@query("b06_chromosomes", f"{W}, named AS (SELECT *, CASE WHEN chrom = 24 THEN 'chrM' ELSE 'chr' || CAST(chrom AS VARCHAR) END AS name FROM reads) SELECT sample_id, count(*) AS n FROM named WHERE name <> 'chrM' GROUP BY 1")
def b06(spark, d):
    named = data.reads(spark, d).withColumn("name", F.when(F.col("chrom") == 24, "chrM").otherwise(F.concat(F.lit("chr"), F.col("chrom").cast("string"))))
    return R.nuclear_only(named.withColumn("key", chrom_key("name")), "key").groupBy("sample_id").agg(F.count("*").alias("n"))


@query("b07_not_mitochondrial", f"{W}, named AS (SELECT sample_id, CASE WHEN chrom = 24 THEN 'chrM' WHEN chrom = 23 THEN '*' ELSE 'chr' || CAST(chrom AS VARCHAR) END AS name FROM reads) SELECT sample_id, count(*) AS n FROM named WHERE name NOT IN ('*', 'chrM', 'chrMT', 'M', 'MT') GROUP BY 1")
def b07(spark, d):
    named = data.reads(spark, d).withColumn("name", F.when(F.col("chrom") == 24, "chrM").when(F.col("chrom") == 23, "*").otherwise(F.concat(F.lit("chr"), F.col("chrom").cast("string"))))
    return R.not_mitochondrial(named, "name").groupBy("sample_id").agg(F.count("*").alias("n"))


@query("b13_gc_eligibility", f"""{BASE}, {GC_CTE} SELECT CASE WHEN gc IS NULL THEN 'missing_gc' WHEN gc <= 0 THEN 'nonpositive_gc' WHEN n IS NULL THEN 'missing_count' WHEN n <= 0 THEN 'zero_count' ELSE 'used' END AS reason, count(*) AS bins FROM dense LEFT JOIN gct USING (chrom, bin) GROUP BY 1""")
def b13(spark, d):
    rows = gc.join_gc(data.dense(spark, d), data.gc_table(spark))
    return rows.groupBy(F.coalesce(gc.eligibility(), F.lit("used")).alias("reason")).agg(F.count("*").alias("bins"))


@query("b19_chromosome_names", f"{W} SELECT CASE WHEN chrom = 23 THEN 'X' WHEN chrom = 24 THEN 'Y' ELSE CAST(chrom AS VARCHAR) END AS label, CAST(chrom AS VARCHAR) AS key, count(*) AS n FROM reads GROUP BY 1, 2")
def b19(spark, d):
    label = chrom_label("chrom")
    raw = F.concat(F.when(F.col("sample_id") % 2 == 0, "chr").otherwise("CHR"), F.lower(label))
    return data.reads(spark, d).groupBy(chrom_label(chrom_key(raw)).alias("label"), chrom_key(raw).alias("key")).agg(F.count("*").alias("n"))


@query("b20_coordinates", f"{BASE} SELECT sample_id, chrom, bin, CAST(bin * 50000 AS BIGINT) AS start, CAST(least(bin * 50000 + 50000, 980000) AS BIGINT) AS \"end\", n FROM dense")
def b20(spark, d):
    return B.coordinates(data.dense(spark, d), 50000, data.lengths(spark).withColumn("length", F.lit(980000))).select("sample_id", "chrom", "bin", "start", "end", "n")


# --- C: joins --------------------------------------------------------------------------------------------------------


@query("c01_left_bins", f"""{W}, c AS (SELECT sample_id, 'chr' || CAST(chrom AS VARCHAR) || '_' || CAST((pos - 1) // 50000 AS VARCHAR) AS bin_name, count(*) AS n FROM reads WHERE pos > 0 GROUP BY 1, 2), t AS (SELECT 'chr' || CAST(a.range AS VARCHAR) || '_' || CAST(b.range AS VARCHAR) AS bin_name FROM range(1, 25) AS a CROSS JOIN range(0, 22) AS b)
SELECT t.bin_name, count(c.sample_id) AS samples, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM t LEFT JOIN c USING (bin_name) GROUP BY 1""")
def c01(spark, d):
    names = spark.range(1, 25).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(21)), lambda b: F.concat(F.lit("chr"), F.col("id").cast("string"), F.lit("_"), b.cast("string")))).alias("bin_name"))
    c = R.string_bins(data.reads(spark, d).where("pos > 0"))
    return names.join(c, "bin_name", "left").groupBy("bin_name").agg(F.count("sample_id").alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("c04_gc_join", f"{BASE}, {GC_CTE} SELECT sample_id, chrom, count(gc) AS with_gc, round(sum(n * gc), 6) AS weighted FROM dense LEFT JOIN gct USING (chrom, bin) GROUP BY 1, 2")
def c04(spark, d):
    return gc.join_gc(data.dense(spark, d), data.gc_table(spark)).groupBy("sample_id", "chrom").agg(F.count("gc").alias("with_gc"), F.round(F.sum(F.col("n") * F.col("gc")), 6).alias("weighted"))


REGIONS = [(1, 1000, 60000), (1, 50000, 150000), (5, 0, 999999), (24, 100, 101), (24, 200000, 800000)]
_REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {s}, {e})" for c, s, e in REGIONS) + ") AS t(chrom, s, e))"


@query("c06_region_join", f"{W}, {_REG} SELECT sample_id, count(*) AS n_in FROM reads JOIN reg ON reads.chrom = reg.chrom AND pos >= s AND pos < e GROUP BY 1")
def c06(spark, d):
    return R.region_counts(data.reads(spark, d), spark.createDataFrame(REGIONS, "chrom int, start long, end long"))


@query("c07_nearest_gc", f"""{BASE}, {GC_CTE}, fit AS (SELECT sample_id, gc, min(n + 1.0) AS factor FROM dense JOIN gct USING (chrom, bin) WHERE chrom <= 22 AND gc IS NOT NULL AND bin % 7 = 0 GROUP BY 1, 2),
sex AS (SELECT sample_id, chrom, bin, gc FROM dense JOIN gct USING (chrom, bin) WHERE chrom >= 23 AND gc IS NOT NULL),
r AS (SELECT sex.*, fit.gc AS fit_gc, CAST(factor AS DOUBLE) AS factor, row_number() OVER (PARTITION BY sex.sample_id, chrom, bin ORDER BY abs(sex.gc - fit.gc), fit.gc) AS k FROM sex JOIN fit USING (sample_id))
SELECT sample_id, chrom, bin, gc, fit_gc, factor FROM r WHERE k = 1""")
def c07(spark, d):
    rows = gc.join_gc(data.dense(spark, d), data.gc_table(spark)).where("gc is not null")
    fit = rows.where("chrom <= 22 and bin % 7 = 0").select("sample_id", "gc", (F.col("n") + 1.0).cast("double").alias("factor"))
    return gc.nearest_fitted(rows.where("chrom >= 23"), fit)


@query("c08_densify", f"{BASE} SELECT sample_id, chrom, bin, n, n_fwd, n_rev FROM dense")
def c08(spark, d):
    return data.dense(spark, d).select("sample_id", "chrom", "bin", "n", "n_fwd", "n_rev")


@query("c11_pairwise_ssd", f"{BASE} SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(sum((a.frac - b.frac) * (a.frac - b.frac)), 12) AS ssd FROM fracs AS a JOIN fracs AS b ON a.chrom = b.chrom WHERE a.chrom <= 22 AND a.chrom NOT IN (13, 18, 21) GROUP BY 1, 2")
def c11(spark, d):
    return cohort.pairwise_distances(B.fractions(data.totals(spark, d))).withColumn("ssd", F.round("ssd", 12))


@query("c13_missing_members", f"{W}, w AS (SELECT CAST(range AS INT) AS sample_id FROM range(0, 25)) SELECT sample_id FROM w WHERE sample_id NOT IN (SELECT sample_id FROM reads)")
def c13(spark, d):
    return cohort.missing_members(spark.range(25).select(F.col("id").cast("int").alias("sample_id")), data.reads(spark, d))


@query("c12_semi_join", f"{W} SELECT sample_id, count(*) AS n FROM reads WHERE sample_id IN (1, 2, 3) GROUP BY 1")
def c12(spark, d):
    named = spark.range(1, 4).select(F.col("id").cast("int").alias("sample_id"))
    return data.reads(spark, d).join(named, "sample_id", "left_semi").groupBy("sample_id").agg(F.count("*").alias("n"))


@query("c14_compare_results", f"{BASE}, a AS (SELECT sample_id, chrom, frac AS v FROM fracs WHERE chrom <> 3), b AS (SELECT sample_id, chrom, frac + CASE WHEN chrom = 5 THEN 0.001 ELSE 0 END AS v FROM fracs WHERE chrom <> 4) SELECT count(*) FILTER (WHERE abs(a.v - b.v) <= 1e-6) AS equal, count(*) FILTER (WHERE abs(a.v - b.v) > 1e-6) AS different, count(*) FILTER (WHERE b.v IS NULL) AS only_a, count(*) FILTER (WHERE a.v IS NULL) AS only_b FROM a FULL OUTER JOIN b USING (sample_id, chrom)")
def c14(spark, d):
    f = B.fractions(data.totals(spark, d))
    other = f.where("chrom <> 4").withColumn("frac", F.col("frac") + F.when(F.col("chrom") == 5, 0.001).otherwise(0.0))
    return qc.compare_results(f.where("chrom <> 3"), other, ["sample_id", "chrom"], "frac")


# --- D: aggregates ---------------------------------------------------------------------------------------------------


@query("d01_bin_counts", f"{W}, {data.COUNTS} SELECT * FROM counts")
def d01(spark, d):
    return data.counts(spark, d)


@query("d02_string_bins", f"{W} SELECT sample_id, 'chr' || CAST(chrom AS VARCHAR) || '_' || CAST((pos - 1) // 50000 AS VARCHAR) AS bin_name, count(*) AS n FROM reads WHERE pos > 0 GROUP BY 1, 2")
def d02(spark, d):
    return R.string_bins(data.reads(spark, d).where("pos > 0"))


@query("d03_rescale", f"{BASE} SELECT sample_id, chrom, CAST(bin // 3 AS INT) AS bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_fwd) AS BIGINT) AS n_fwd, CAST(sum(n_rev) AS BIGINT) AS n_rev FROM dense GROUP BY 1, 2, 3")
def d03(spark, d):
    return B.rescale(data.dense(spark, d), 50000, 150000)


@query("d04_count_metadata", f"""{BASE}, {GC_CTE}, pre AS (SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n_pre, avg(mapq) AS mq FROM reads GROUP BY 1, 2, 3), j AS (SELECT sample_id, n_pre, coalesce(n, 0) AS n, gc, mq FROM pre LEFT JOIN dense USING (sample_id, chrom, bin) LEFT JOIN gct USING (chrom, bin))
SELECT sample_id, CAST(sum(n_pre) AS BIGINT) AS pre_sum, CAST(sum(n) AS BIGINT) AS post_sum, count(*) FILTER (WHERE n > 0) AS nonzero_bins, round(sum(gc * n_pre) / sum(CASE WHEN gc IS NOT NULL THEN n_pre END), 9) AS gc_perc_pre, round(sum(gc * n) / sum(CASE WHEN gc IS NOT NULL THEN n END), 9) AS gc_perc_post, round(sum(mq * n) / sum(n), 9) AS mean_mapq, round(CAST(sum(n) AS DOUBLE) / sum(n_pre), 9) AS retained_fraction FROM j GROUP BY 1""")
def d04(spark, d):
    pre = data.reads(spark, d).groupBy("sample_id", "chrom", F.floor(F.col("pos") / 50000).cast("int").alias("bin")).agg(F.count("*").alias("n_pre"), F.avg("mapq").alias("mean_mapq"))
    rows = gc.join_gc(pre.join(data.counts(spark, d).select("sample_id", "chrom", "bin", "n"), B.KEYS, "left").fillna(0, ["n"]), data.gc_table(spark)).withColumn("gc_pre", F.col("gc")).withColumn("gc_post", F.col("gc"))
    out = B.count_metadata(rows)
    return out.select("sample_id", "pre_sum", "post_sum", "nonzero_bins", *[F.round(c, 9).alias(c) for c in ("gc_perc_pre", "gc_perc_post", "mean_mapq", "retained_fraction")])


@query("d05_fractions", f"{BASE} SELECT sample_id, chrom, reads, round(frac, 12) AS frac FROM fracs")
def d05(spark, d):
    return B.fractions(data.totals(spark, d)).withColumn("frac", F.round("frac", 12))


@query("d05b_strand_fractions", f"{BASE}, t AS (SELECT sample_id, chrom, sum(n_fwd) AS f, sum(n_rev) AS r FROM dense WHERE chrom <= 22 GROUP BY 1, 2) SELECT sample_id, chrom, round(f / sum(f) OVER (PARTITION BY sample_id) / 2, 12) AS frac_fwd, round(r / sum(r) OVER (PARTITION BY sample_id) / 2, 12) AS frac_rev, round(f / sum(f + r) OVER (PARTITION BY sample_id), 12) AS group_fwd FROM t")
def d05b(spark, d):
    dense = data.dense(spark, d)
    a, b = B.strand_fractions(dense), B.strand_fractions(dense, "group").select("sample_id", "chrom", F.round("frac_fwd", 12).alias("group_fwd"))
    return a.select("sample_id", "chrom", F.round("frac_fwd", 12).alias("frac_fwd"), F.round("frac_rev", 12).alias("frac_rev")).join(b, ["sample_id", "chrom"])


@query("d06_moments", f"{BASE} SELECT chrom, round(avg(frac), 12) AS mean, round(stddev_samp(frac), 12) AS sd_samp, round(stddev_pop(frac), 12) AS sd_pop, round(stddev_samp(frac) / avg(frac), 9) AS cv FROM fracs GROUP BY 1")
def d06(spark, d):
    return B.fractions(data.totals(spark, d)).groupBy("chrom").agg(F.round(F.avg("frac"), 12).alias("mean"), F.round(F.stddev_samp("frac"), 12).alias("sd_samp"), F.round(F.stddev_pop("frac"), 12).alias("sd_pop"), F.round(safe_div(F.stddev_samp("frac"), F.avg("frac")), 9).alias("cv"))


@query("d07_median_mad", f"{BASE}, m AS (SELECT *, median(n) OVER (PARTITION BY sample_id) AS med FROM dense) SELECT sample_id, CAST(max(med) AS DOUBLE) AS med, round(median(abs(n - med)) * 1.4826, 9) AS mad FROM m GROUP BY 1")
def d07(spark, d):
    dense = data.dense(spark, d)
    med = dense.groupBy("sample_id").agg(F.median("n").alias("med"))
    return dense.join(med, "sample_id").groupBy("sample_id").agg(F.max("med").alias("med"), F.round(F.median(F.abs(F.col("n") - F.col("med"))) * 1.4826, 9).alias("mad"))


@query("d08_weighted_mean", f"{W} SELECT sample_id, chrom, round(CAST(sum(pos * mapq) AS DOUBLE) / sum(mapq), 6) AS weighted_pos FROM reads GROUP BY 1, 2 HAVING sum(mapq) > 0")
def d08(spark, d):
    return data.reads(spark, d).groupBy("sample_id", "chrom").agg(F.sum(F.col("pos") * F.col("mapq")).alias("s"), F.sum("mapq").alias("w")).where("w > 0").select("sample_id", "chrom", F.round(safe_div("s", "w"), 6).alias("weighted_pos"))


_STATS = f"""{W}, v AS (SELECT *, mapq >= 5 AND flag & 512 = 0 AS use, flag & 256 = 0 AS pri, flag & 2048 = 0 AS org, flag & 4 = 0 AS m, flag & 1 = 1 AS p, flag & 8 = 0 AS mm, flag & 1024 <> 0 AS dup, flag & 192 AS o12 FROM reads),
u AS (SELECT *, use AND pri AND seq_len > 0 AS seen, use AND pri AND seq_len > 0 AND org AS own, CASE WHEN NOT p OR o12 = 64 THEN 1 WHEN o12 = 128 THEN 2 ELSE 3 END AS frag FROM v),
n AS (SELECT sample_id, count(*) FILTER (WHERE NOT use) AS filtered_sequences, count(*) FILTER (WHERE own) AS sequences, count(*) FILTER (WHERE own AND frag = 1) AS first_fragments, count(*) FILTER (WHERE own AND frag = 2) AS last_fragments, count(*) FILTER (WHERE own AND frag = 3) AS other_fragments,
count(*) FILTER (WHERE own AND m) AS reads_mapped, count(*) FILTER (WHERE own AND p AND m AND mm) AS reads_mapped_and_paired, count(*) FILTER (WHERE own AND NOT m) AS reads_unmapped, count(*) FILTER (WHERE own AND p AND m AND mm AND flag & 2 = 2) AS reads_properly_paired, count(*) FILTER (WHERE own AND p) AS reads_paired,
count(*) FILTER (WHERE seen AND dup) AS reads_duplicated, count(*) FILTER (WHERE own AND m AND mapq = 0) AS reads_mq0, count(*) FILTER (WHERE own AND flag & 512 <> 0) AS reads_qc_failed, count(*) FILTER (WHERE use AND NOT pri) AS non_primary_alignments, count(*) FILTER (WHERE use AND pri AND NOT org) AS supplementary_alignments,
CAST(count(*) FILTER (WHERE own AND p AND m AND mm AND chrom <> mate_chrom) // 2 AS BIGINT) AS pairs_on_different_chromosomes, CAST(coalesce(sum(seq_len) FILTER (WHERE own), 0) AS BIGINT) AS total_length, CAST(coalesce(sum(seq_len) FILTER (WHERE own AND frag = 1), 0) AS BIGINT) AS total_first_fragment_length,
CAST(coalesce(sum(seq_len) FILTER (WHERE own AND frag = 2), 0) AS BIGINT) AS total_last_fragment_length, CAST(coalesce(sum(seq_len) FILTER (WHERE own AND m), 0) AS BIGINT) AS bases_mapped, CAST(coalesce(sum(30 + l_linenumber * 10) FILTER (WHERE seen AND m), 0) AS BIGINT) AS bases_mapped_cigar,
CAST(coalesce(sum(seq_len) FILTER (WHERE seen AND dup), 0) AS BIGINT) AS bases_duplicated, CAST(coalesce(sum(nm) FILTER (WHERE seen AND m), 0) AS BIGINT) AS mismatches_from_nm FROM u GROUP BY 1),
st AS (SELECT *, filtered_sequences + sequences AS raw_total_sequences, coalesce(CAST(mismatches_from_nm AS DOUBLE) / nullif(bases_mapped_cigar, 0), 0) AS error_rate, coalesce(CAST(reads_duplicated AS DOUBLE) / nullif(sequences, 0), 0) AS duplicated_read_fraction, coalesce(CAST(bases_duplicated AS DOUBLE) / nullif(total_length, 0), 0) AS duplicated_base_fraction FROM n)"""


def _stats(spark, d):
    return R.alignment_stats(data.reads(spark, d), mapq=5, exclude_flags=512)


@query("d09_alignment_stats", f"{_STATS} SELECT * REPLACE (round(error_rate, 9) AS error_rate, round(duplicated_read_fraction, 9) AS duplicated_read_fraction, round(duplicated_base_fraction, 9) AS duplicated_base_fraction) FROM st")
def d09(spark, d):
    s = _stats(spark, d)
    return s.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query("d11_gc_bin_weight", f"""{BASE}, {GC_CTE}, j AS (SELECT sample_id, chrom, bin, n, gc, CAST(round_even(gc * 1000, 0) AS INT) AS bucket FROM dense LEFT JOIN gct USING (chrom, bin)),
k AS (SELECT sample_id, bucket, avg(n) AS bucket_mean, sum(n) AS s, count(*) AS c FROM j WHERE chrom <= 22 AND n > 0 AND gc > 0 GROUP BY 1, 2),
w AS (SELECT sample_id, bucket, sum(s) OVER (PARTITION BY sample_id) / sum(c) OVER (PARTITION BY sample_id) / bucket_mean AS weight FROM k)
SELECT sample_id, chrom, bin, n, round(CASE WHEN chrom <= 22 THEN n * coalesce(weight, 1) ELSE n END, 9) AS corrected FROM j LEFT JOIN w USING (sample_id, bucket)""")
def d11(spark, d):
    return gc.bin_weight_correct(data.dense(spark, d), data.gc_table(spark)).select("sample_id", "chrom", "bin", "n", F.round("corrected", 9).alias("corrected"))


@query("d12_median_per_gc", f"{BASE}, {GC_CTE} SELECT sample_id, gc, CAST(median(n) AS DOUBLE) AS med, count(*) AS bins FROM dense JOIN gct USING (chrom, bin) WHERE chrom <= 22 AND gc IS NOT NULL GROUP BY 1, 2")
def d12(spark, d):
    return gc.join_gc(data.dense(spark, d), data.gc_table(spark)).where("chrom <= 22 and gc is not null").groupBy("sample_id", "gc").agg(F.median("n").alias("med"), F.count("*").alias("bins"))


@query("d13_shapiro")
def d13(spark, d):
    return cohort.chromosome_statistics(B.fractions(data.totals(spark, d)).where("chrom <= 22"))


@query("d14_gc_correlation", f"{BASE}, {GC_CTE} SELECT sample_id, round(corr(gc, n), 9) AS cor FROM dense JOIN gct USING (chrom, bin) WHERE chrom <= 22 AND gc IS NOT NULL AND n > 0 GROUP BY 1")
def d14(spark, d):
    return gc.join_gc(data.dense(spark, d), data.gc_table(spark)).where("chrom <= 22 and gc is not null and n > 0").groupBy("sample_id").agg(F.round(safe_corr("gc", "n"), 9).alias("cor"))


@query("d15_distinct_chromosomes", f"{W} SELECT sample_id, count(DISTINCT chrom) AS chromosomes, count(DISTINCT CASE WHEN flag & 1024 <> 0 THEN chrom END) AS with_duplicates FROM reads GROUP BY 1")
def d15(spark, d):
    return data.reads(spark, d).groupBy("sample_id").agg(F.countDistinct("chrom").alias("chromosomes"), F.countDistinct(F.when(R.has_bits("flag", 1024), F.col("chrom"))).alias("with_duplicates"))


@query("d20_reference_frame", f"{BASE} SELECT sample_id, " + ", ".join(f"CAST(sum(CASE WHEN chrom = {c} THEN reads ELSE 0 END) AS BIGINT) AS reads_{n}, round(sum(CASE WHEN chrom = {c} THEN frac ELSE 0 END), 12) AS frac_{n}" for c, n in [(c, str(c) if c < 23 else 'XY'[c - 23]) for c in range(1, 25)]) + " FROM fracs GROUP BY 1")
def d20(spark, d):
    f = B.reference_frame(data.totals(spark, d))
    return f.select(*[F.round(c, 12).alias(c) if c.startswith("frac_") else F.col(c) for c in f.columns])


@query("d21_match_outliers", f"""{BASE}, s AS (SELECT a.sample_id AS x, b.sample_id AS y, sum((a.frac - b.frac) * (a.frac - b.frac)) AS ssd FROM fracs AS a JOIN fracs AS b ON a.chrom = b.chrom WHERE a.chrom <= 22 AND a.chrom NOT IN (13, 18, 21) GROUP BY 1, 2), m AS (SELECT x AS sample_id, avg(ssd) AS m FROM s WHERE x <> y GROUP BY 1)
SELECT sample_id, round(m, 12) AS mean_ssd, m > (SELECT avg(m) + 3 * stddev_samp(m) FROM m) AS outlier FROM m""")
def d21(spark, d):
    return cohort.match_outliers(cohort.pairwise_distances(B.fractions(data.totals(spark, d)))).select("sample_id", F.round("mean_ssd", 12).alias("mean_ssd"), "outlier")


@query("d_rollup_extension", f"{W} SELECT coalesce(sample_id, -1) AS sample_id, coalesce(chrom, -1) AS chrom, count(*) AS n FROM reads GROUP BY ROLLUP (sample_id, chrom)")
def d_rollup(spark, d):
    """An extension: subtotals over samples and chromosomes."""
    return data.reads(spark, d).rollup("sample_id", "chrom").agg(F.count("*").alias("n")).fillna(-1)


# --- E: windows ------------------------------------------------------------------------------------------------------


def _mask(spark, d):
    return data.dense(spark, d).groupBy("chrom", "bin").agg((F.sum("n") % 3 != 0).alias("keep"))


_MASK = "mask AS (SELECT chrom, bin, sum(n) % 3 <> 0 AS keep FROM dense GROUP BY 1, 2)"


@query("e01_masked_cumulative", f"{BASE}, {_MASK}, k AS (SELECT chrom, count(*) FILTER (WHERE keep) AS kept FROM mask GROUP BY 1) SELECT chrom, kept, CAST(sum(kept) OVER (ORDER BY chrom) AS BIGINT) AS kept_cum FROM k")
def e01(spark, d):
    return B.masked_cumulative(_mask(spark, d))


@query("e02_masked_rank", f"{BASE}, {_MASK} SELECT chrom, bin, CAST(row_number() OVER (ORDER BY chrom, bin) - 1 AS INT) AS masked_idx FROM mask WHERE keep")
def e02(spark, d):
    return B.masked_rank(_mask(spark, d))


@query("e03_genome_offsets", f"{BASE}, m AS (SELECT chrom, max(bin) + 1 AS bins FROM dense GROUP BY 1) SELECT chrom, bins, CAST(coalesce(sum(bins) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM m")
def e03(spark, d):
    return B.genome_offsets(data.dense(spark, d))


@query("e04_running_median", f"{BASE} SELECT sample_id, chrom, bin, CAST(quantile_cont(n, 0.5) OVER (PARTITION BY sample_id, chrom ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DOUBLE) AS smooth FROM dense")
def e04(spark, d):
    return gc.running_median(data.dense(spark, d), "n", 5).select("sample_id", "chrom", "bin", "smooth")


@query("e06_gap_islands", f"""{BASE}, u AS (SELECT sample_id, chrom, bin, bin - lag(bin) OVER (PARTITION BY sample_id, chrom ORDER BY bin) - 1 > 1 AS g FROM dense WHERE n % 4 <> 0), i AS (SELECT sample_id, chrom, bin, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, chrom ORDER BY bin) AS island FROM u)
SELECT sample_id, chrom, CAST(island AS BIGINT) AS island, count(*) AS bins, min(bin) AS first_bin FROM i GROUP BY 1, 2, 3""")
def e06(spark, d):
    from binfold.operators.cnv_predict import gap_islands

    return gap_islands(data.dense(spark, d).withColumn("r", (F.col("n") % 4).cast("double")), 1).groupBy("sample_id", "chrom", "island").agg(F.count("*").alias("bins"), F.min("bin").alias("first_bin"))


_LOO = "l AS (SELECT a.sample_id, a.chrom, a.frac, avg(b.frac) AS m, stddev_samp(b.frac) AS s FROM fracs AS a JOIN fracs AS b ON a.chrom = b.chrom AND a.sample_id <> b.sample_id GROUP BY 1, 2, 3)"


@query("e07_leave_one_out", f"{BASE}, {_LOO} SELECT sample_id, chrom, round(frac, 9) AS frac, round((frac - m) / nullif(s, 0), 6) AS z FROM l")
def e07(spark, d):
    return cohort.leave_one_out(B.fractions(data.totals(spark, d)), "frac", ["chrom"]).select("sample_id", "chrom", F.round("frac", 9).alias("frac"), F.round("loo_z", 6).alias("z"))


@query("e09_row_standardise", f"{BASE} SELECT sample_id, chrom, round((frac - avg(frac) OVER w) / stddev_samp(frac) OVER w, 6) AS z FROM fracs WINDOW w AS (PARTITION BY chrom)")
def e09(spark, d):
    return cohort.chromosome_scores(B.fractions(data.totals(spark, d))).select("sample_id", "chrom", F.round("z", 6).alias("z"))


@query("e10_combinations", f"{W}, c AS (SELECT DISTINCT chrom FROM reads WHERE mapq >= 10) SELECT x.chrom AS a, y.chrom AS b, z.chrom AS c FROM c AS x JOIN c AS y ON x.chrom < y.chrom JOIN c AS z ON y.chrom < z.chrom")
def e10(spark, d):
    """Sets of three of the chromosomes that have reads, from their numbers in lexicographic order."""
    return B.combinations_of(R.filter_reads(data.reads(spark, d), mapq=10), "chrom", 3).selectExpr("items[0] AS a", "items[1] AS b", "items[2] AS c")


@query("e12_normalise", f"{BASE} SELECT sample_id, chrom, bin, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY sample_id), 12) AS x FROM dense")
def e12(spark, d):
    return B.normalised(data.dense(spark, d)).select("sample_id", "chrom", "bin", F.round("x", 12).alias("x"))


# --- F, G, H: order, sets, scalars -----------------------------------------------------------------------------------


@query("f01_text_order", f"{W}, c AS (SELECT sample_id, CAST(chrom AS VARCHAR) AS chrom, count(*) AS n FROM reads GROUP BY 1, 2) SELECT sample_id, chrom, n, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY chrom) AS INT) AS place FROM c")
def f01(spark, d):
    c = data.reads(spark, d).groupBy("sample_id", F.col("chrom").cast("string").alias("chrom")).agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("sample_id").orderBy("chrom")))


@query("f05_match_controls", f"""{BASE}, s AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, sum((a.frac - b.frac) * (a.frac - b.frac)) AS ssd FROM fracs AS a JOIN fracs AS b ON a.chrom = b.chrom WHERE a.chrom <= 22 AND a.chrom NOT IN (13, 18, 21) AND a.sample_id < 3 AND b.sample_id >= 3 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_a ORDER BY ssd, sample_b) AS INT) AS rank FROM s) SELECT sample_a, sample_b, round(ssd, 12) AS ssd, rank FROM r WHERE rank <= 5""")
def f05(spark, d):
    f = B.fractions(data.totals(spark, d))
    return cohort.match_controls(f.where("sample_id < 3"), f.where("sample_id >= 3"), 5).withColumn("ssd", F.round("ssd", 12))


@query("f07_frequency_order", f"{W}, c AS (SELECT mapq, count(*) AS n FROM reads GROUP BY 1) SELECT mapq, n, CAST(row_number() OVER (ORDER BY n DESC, mapq) AS INT) AS place FROM c QUALIFY place <= 10")
def f07(spark, d):
    c = data.reads(spark, d).groupBy("mapq").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "mapq"))).where("place <= 10")


@query("g01_union_by_name", f"{W} SELECT 'low' AS part, sample_id, count(*) AS n, CAST(-1 AS BIGINT) AS extra FROM reads WHERE mapq < 10 GROUP BY 2 UNION ALL SELECT 'high', sample_id, count(*), CAST(max(pos) AS BIGINT) FROM reads WHERE mapq >= 10 GROUP BY 2")
def g01(spark, d):
    r = data.reads(spark, d)
    low = r.where("mapq < 10").groupBy("sample_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("low"))
    high = r.where("mapq >= 10").groupBy("sample_id").agg(F.count("*").alias("n"), F.max("pos").alias("extra")).withColumn("part", F.lit("high"))
    return low.unionByName(high, allowMissingColumns=True).fillna(-1, ["extra"])


@query("g03_first_by_name", f"{W} SELECT sample_id, pos, l_orderkey FROM reads QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY pos, {', '.join(ORDER)}) = 1")
def g03(spark, d):
    w = Window.partitionBy("sample_id").orderBy("pos", *ORDER)
    return data.reads(spark, d).withColumn("nth", F.row_number().over(w)).where("nth = 1").select("sample_id", "pos", "l_orderkey")


@query("g04_set_difference", f"{W} SELECT DISTINCT chrom FROM reads WHERE chrom <= 22 EXCEPT SELECT * FROM (VALUES (13), (18), (21)) AS t(chrom)")
def g04(spark, d):
    return data.reads(spark, d).where("chrom <= 22").select("chrom").distinct().exceptAll(spark.createDataFrame([(13,), (18,), (21,)], "chrom int"))


@query("g05_intersection", f"{W} SELECT sample_id FROM reads WHERE chrom = 1 INTERSECT SELECT sample_id FROM reads WHERE chrom = 2")
def g05(spark, d):
    r = data.reads(spark, d)
    return r.where("chrom = 1").select("sample_id").intersect(r.where("chrom = 2").select("sample_id"))


@query("h_scalar_functions", f"""{W} SELECT sample_id, chrom, 'chr' || lpad(CAST(chrom AS VARCHAR), 2, '0') AS padded, round(log2(1 + count(*)), 9) AS log2n, round(log10(1 + count(*)), 9) AS log10n, round(sqrt(count(*)), 9) AS root, CAST(bit_or(flag) AS INT) AS all_bits, CAST(bit_count(bit_or(flag)) AS INT) AS set_bits, count(*) % 7 AS rest, upper(left('sample', 3)) AS tag FROM reads GROUP BY 1, 2""")
def h_scalar(spark, d):
    n = F.count("*")
    return data.reads(spark, d).groupBy("sample_id", "chrom").agg(F.round(F.log2(1 + n), 9).alias("log2n"), F.round(F.log10(1 + n), 9).alias("log10n"), F.round(F.sqrt(n), 9).alias("root"), F.bit_or("flag").alias("all_bits"), (n % 7).alias("rest")).select(
        "sample_id", "chrom", F.concat(F.lit("chr"), F.lpad(F.col("chrom").cast("string"), 2, "0")).alias("padded"), "log2n", "log10n", "root", "all_bits", F.bit_count("all_bits").alias("set_bits"), "rest", F.upper(F.substring(F.lit("sample"), 1, 3)).alias("tag"))


