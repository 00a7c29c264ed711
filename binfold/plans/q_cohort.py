"""Queries of the conversion path, corrections, control groups and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from binfold.operators import bins as B
from binfold.operators import chi, cohort, gc, qc, scores
from binfold.operators import reads as R
from binfold.plans import data
from binfold.plans.data import BASE, COUNTS, DENSE, FRACS, GC_CTE, GRID, ORDER, READS, TOTALS
from binfold.plans.q_relational import _STATS
from binfold.plans.registry import query
from binfold.plans.workflows import ensure_checkpoint_dir

W = f"WITH {READS}"

_DEDUP = (
    "ordered AS (SELECT *, lag(pos) OVER w AS p0, last_value(CASE WHEN flag & 1 = 1 THEN mate_pos END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m0 FROM reads WHERE mapq >= 1 AND NOT (flag & 1 = 1 AND flag & 2 = 0) WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos, " + ", ".join(ORDER) + ")), "
    "kept AS (SELECT * FROM ordered WHERE NOT (pos IS NOT DISTINCT FROM p0 AND (flag & 1 = 0 OR mate_pos IS NOT DISTINCT FROM m0)))"
)


@query("k01_convert", f"{W}, {_DEDUP}, {GRID}, c AS (SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n, count(*) FILTER (WHERE flag & 16 = 0) AS n_fwd, count(*) FILTER (WHERE flag & 16 <> 0) AS n_rev FROM kept GROUP BY 1, 2, 3) SELECT sample_id, chrom, bin, coalesce(n, 0) AS n, coalesce(n_fwd, 0) AS n_fwd, coalesce(n_rev, 0) AS n_rev FROM grid LEFT JOIN c USING (sample_id, chrom, bin)")
def k01(spark, d):
    return R.convert(data.reads(spark, d), data.lengths(spark), 50000, order=ORDER).select("sample_id", "chrom", "bin", "n", "n_fwd", "n_rev")


@query("k02_streaming_dedup", f"{W}, {_DEDUP} SELECT sample_id, chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM kept GROUP BY 1, 2")
def k02(spark, d):
    return R.streaming_dedup(R.filter_reads(data.reads(spark, d), 1), ORDER).groupBy("sample_id", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query("k03_bin_reads", f"{W}, {GRID}, c AS (SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n FROM reads WHERE flag & 1024 = 0 GROUP BY 1, 2, 3) SELECT sample_id, chrom, bin, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (sample_id, chrom, bin)")
def k03(spark, d):
    return R.bin_reads(data.reads(spark, d), data.lengths(spark), rmdup="flag").select("sample_id", "chrom", "bin", "n")


@query("k04_strands", f"{W}, {COUNTS} SELECT sample_id, CAST(sum(n_fwd) AS BIGINT) AS fwd, CAST(sum(n_rev) AS BIGINT) AS rev FROM counts GROUP BY 1")
def k04(spark, d):
    return data.counts(spark, d).groupBy("sample_id").agg(F.sum("n_fwd").alias("fwd"), F.sum("n_rev").alias("rev"))


# --- corrections -----------------------------------------------------------------------------------------------------

CHI = """
per AS (SELECT sample_id, sum(n) AS total FROM dense WHERE chrom <= 22 GROUP BY 1),
sc AS (SELECT sample_id, chrom, bin, CAST(n AS DOUBLE) * (SELECT avg(total) FROM per) / total AS s FROM dense JOIN per USING (sample_id) WHERE chrom <= 22),
ex AS (SELECT *, avg(s) OVER (PARTITION BY chrom, bin) AS e FROM sc),
prof AS (SELECT chrom, bin, max(e) AS expected, sum((e - s) * (e - s) / nullif(e, 0)) AS chi2, (SELECT count(*) FROM per) - 1 AS df FROM ex GROUP BY 1, 2),
profile AS (SELECT chrom, bin, expected, chi2, (chi2 - df) / sqrt(2.0 * df) AS z, CASE WHEN (chi2 - df) / sqrt(2.0 * df) > 3.5 THEN chi2 / df ELSE 1 END AS factor FROM prof)"""


@query("d10_chi_profile", f"{BASE}, {CHI} SELECT chrom, bin, round(expected, 6) AS expected, round(chi2, 6) AS chi2, round(z, 6) AS z, round(CAST(factor AS DOUBLE), 6) AS factor FROM profile")
def d10(spark, d):
    p = chi.chi_profile(data.dense(spark, d))
    return p.select("chrom", "bin", *[F.round(c, 6).alias(c) for c in ("expected", "chi2", "z", "factor")])


@query("b12_chi_validity", f"{BASE}, {CHI} SELECT CASE WHEN expected <= 0 THEN 'nonpositive_expected' ELSE 'valid' END AS reason, count(*) AS bins FROM profile GROUP BY 1")
def b12(spark, d):
    return chi.chi_profile(data.dense(spark, d)).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("bins"))


@query("k35_chi_correct", f"{BASE}, {CHI} SELECT sample_id, chrom, bin, round(n / coalesce(CAST(factor AS DOUBLE), 1), 9) AS n, round(n_fwd / coalesce(CAST(factor AS DOUBLE), 1), 9) AS n_fwd FROM dense LEFT JOIN profile USING (chrom, bin)")
def k35(spark, d):
    dense = data.dense(spark, d)
    return chi.chi_correct(dense, chi.chi_profile(dense), ["n", "n_fwd"]).select("sample_id", "chrom", "bin", F.round("n", 9).alias("n"), F.round("n_fwd", 9).alias("n_fwd"))


@query("k34_gc_loess")
def k34(spark, d):
    return gc.loess_correct(data.dense(spark, d), data.gc_table(spark), include_sex=True).select("sample_id", "chrom", "bin", "n", F.round("corrected", 6).alias("corrected"))


@query("k53_preprocess_qc", f"""{BASE}, {GC_CTE}, j AS (SELECT sample_id, chrom, bin, n, gc, CAST(round_even(gc * 1000, 0) AS INT) AS bucket FROM dense LEFT JOIN gct USING (chrom, bin)),
k AS (SELECT sample_id, bucket, avg(n) AS bucket_mean, sum(n) AS s, count(*) AS c FROM j WHERE chrom <= 22 AND n > 0 AND gc > 0 GROUP BY 1, 2), w AS (SELECT sample_id, bucket, sum(s) OVER (PARTITION BY sample_id) / sum(c) OVER (PARTITION BY sample_id) / bucket_mean AS weight FROM k),
x AS (SELECT sample_id, n, gc, n * coalesce(weight, 1) AS c FROM j LEFT JOIN w USING (sample_id, bucket) WHERE chrom <= 22 AND gc > 0 AND n > 0)
SELECT sample_id, count(*) AS fit_bins, round(stddev_samp(n) / avg(n), 9) AS cv_pre, round(stddev_samp(c) / avg(c), 9) AS cv_post, round(avg(c / n), 9) AS scale_mean, round(stddev_samp(c / n), 9) AS scale_sd, round(corr(gc, n), 6) AS gc_cor_pre, abs(corr(gc, c)) < 0.001 AS gc_free FROM x GROUP BY 1""")
def k53(spark, d):
    q = gc.preprocess_qc(gc.bin_weight_correct(data.dense(spark, d), data.gc_table(spark)))
    return q.select("sample_id", "fit_bins", *[F.round(c, 6 if c.startswith("gc_") else 9).alias(c) for c in q.columns[2:-1]], (F.abs("gc_cor_post") < 0.001).alias("gc_free"))


@query("l06_gc_curve", f"""{BASE}, {GC_CTE} SELECT sample_id, CAST(round_even(gc * 1000, 0) AS INT) AS bucket, count(*) AS bins, CAST(median(n) AS DOUBLE) AS median_pre FROM dense JOIN gct USING (chrom, bin) WHERE gc > 0 AND n > 0 GROUP BY 1, 2""")
def l06(spark, d):
    return gc.gc_curve(gc.bin_weight_correct(data.dense(spark, d), data.gc_table(spark))).select("sample_id", "bucket", "bins", "median_pre")


# --- control groups --------------------------------------------------------------------------------------------------


def _auto(spark, d):
    return B.fractions(data.totals(spark, d)).where("chrom <= 22")


_Z = "z AS (SELECT sample_id, chrom, (frac - avg(frac) OVER w) / stddev_samp(frac) OVER w AS z FROM fracs WHERE chrom <= 22 WINDOW w AS (PARTITION BY chrom))"


@query("k30_control_group", f"{W}, s AS (SELECT sample_id, count(*) AS n FROM reads GROUP BY 1) SELECT sample_id, 'combined' AS strand_type, n FROM s")
def k30(spark, d):
    s = data.reads(spark, d).groupBy("sample_id").agg(F.count("*").alias("n")).withColumn("strand_type", F.lit("combined"))
    doubled = s.withColumn("input_order", F.lit(1)).unionByName(s.withColumn("n", F.lit(0).cast("long")).withColumn("input_order", F.lit(2)))
    return cohort.as_control_group(doubled).drop("input_order")


@query("k31_diagnose", f"{BASE}, {_Z} SELECT sample_id, chrom, round(z, 6) AS z, abs(z) > 2 AS aberrant FROM z")
def k31(spark, d):
    return cohort.diagnose(_auto(spark, d), 2.0).select("sample_id", "chrom", F.round("z", 6).alias("z"), "aberrant")


@query("b17_aberrant", f"{BASE}, {_Z} SELECT sample_id, chrom, round(z, 6) AS z FROM z WHERE abs(z) > 2")
def b17(spark, d):
    return cohort.diagnose(_auto(spark, d), 2.0).where("aberrant").select("sample_id", "chrom", F.round("z", 6).alias("z"))


@query("k32_outlier_rule", f"{BASE}, {_Z}, a AS (SELECT sample_id, chrom, count(*) AS h FROM z WHERE abs(z) > 1.5 GROUP BY 1, 2) SELECT sample_id, count(*) AS chromosomes, max(h) AS strands FROM a GROUP BY 1 HAVING count(*) > 2 OR max(h) > 1")
def k32(spark, d):
    return cohort.outlier_samples(cohort.diagnose(_auto(spark, d), 1.5), "bidirectional_or_multichromosome")


def _prune_sql(rounds: int = 8, cutoff: float = 2.5, least: int = 5) -> str:
    """Rounds of correction and diagnosis written out; once no sample is flagged a round changes nothing."""
    out = [f"{BASE}, k0 AS MATERIALIZED (SELECT DISTINCT sample_id FROM dense)"]
    for i in range(rounds):
        out.append(f"""a{i} AS MATERIALIZED (SELECT sample_id, chrom, bin, CAST(n AS DOUBLE) AS v FROM dense JOIN k{i} USING (sample_id) WHERE chrom <= 22), t{i} AS (SELECT sample_id, sum(v) AS total FROM a{i} GROUP BY 1), m{i} AS (SELECT avg(total) AS mean_total, count(*) AS n FROM t{i}),
s{i} AS MATERIALIZED (SELECT a.*, v * mean_total / total AS s, n - 1 AS df FROM a{i} AS a JOIN t{i} USING (sample_id) CROSS JOIN m{i}), e{i} AS (SELECT chrom, bin, avg(s) AS e FROM s{i} GROUP BY 1, 2), c{i} AS MATERIALIZED (SELECT chrom, bin, sum((e - s) * (e - s) / nullif(e, 0)) AS chi2, any_value(df) AS df, any_value(e) AS e FROM s{i} JOIN e{i} USING (chrom, bin) GROUP BY 1, 2),
r{i} AS MATERIALIZED (SELECT sample_id, chrom, sum(CASE WHEN e > 0 AND (chi2 - df) / sqrt(2 * df) > 3.5 THEN v * df / chi2 ELSE v END) AS reads FROM a{i} JOIN c{i} USING (chrom, bin) GROUP BY 1, 2), f{i} AS MATERIALIZED (SELECT sample_id, chrom, reads / sum(reads) OVER (PARTITION BY sample_id) AS frac FROM r{i}),
x{i} AS MATERIALIZED (SELECT DISTINCT sample_id FROM (SELECT sample_id, abs((frac - avg(frac) OVER w) / nullif(stddev_samp(frac) OVER w, 0)) > {cutoff} AS bad FROM f{i} WINDOW w AS (PARTITION BY chrom)) WHERE bad),
k{i + 1} AS MATERIALIZED (SELECT sample_id FROM k{i} WHERE sample_id NOT IN (SELECT sample_id FROM x{i}) OR (SELECT count(*) FROM k{i}) - (SELECT count(*) FROM x{i}) < {least})""")
    return ", ".join(out) + f" SELECT sample_id, CAST(sum(n) AS BIGINT) AS n, CASE WHEN (SELECT count(*) FROM x{rounds - 1}) = 0 THEN 'no_flagged_samples' ELSE 'min_controls' END AS stop FROM dense JOIN k{rounds} USING (sample_id) GROUP BY 1"


@query("k33_prune", _prune_sql())
def k33(spark, d):
    ensure_checkpoint_dir(spark)
    kept, log = cohort.prune(data.dense(spark, d), z_cutoff=2.5, min_controls=5)
    return kept.groupBy("sample_id").agg(F.sum("n").alias("n")).withColumn("stop", F.lit(log[-1]["stop"]))


@query("b14_qc_filter", f"""{BASE}, s AS (SELECT sample_id, CAST(sum(n) AS BIGINT) AS reads, CAST(sum(n_fwd) AS DOUBLE) / sum(n) AS gc FROM dense GROUP BY 1), m AS (SELECT median(gc) AS c FROM s), v AS (SELECT median(abs(gc - c)) * 1.4826 AS mad FROM s, m)
SELECT sample_id, reads, concat_ws(';', CASE WHEN reads < 2400 THEN 'too_few_reads' END, CASE WHEN reads > 2500 THEN 'too_many_reads' END, CASE WHEN mad > 0 AND abs(gc - c) > 1.5 * mad THEN 'gc_outlier' END) AS reasons FROM s, m, v""")
def b14(spark, d):
    s = data.dense(spark, d).groupBy("sample_id").agg(F.sum("n").alias("reads"), (F.sum("n_fwd").cast("double") / F.sum("n")).alias("gc"))
    return cohort.qc_filter(s, "reads", "gc", 2400, 2500, 1.5).select("sample_id", "reads", "reasons")


@query("b15_drop_samples", f"{W} SELECT DISTINCT sample_id FROM reads WHERE sample_id NOT IN (1, 3)")
def b15(spark, d):
    return cohort.drop_samples(data.reads(spark, d).select("sample_id").distinct(), spark.createDataFrame([(1,), (3,)], "sample_id int"))


@query("k36_match_matrix", f"{BASE} SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(sum((a.frac - b.frac) * (a.frac - b.frac)), 12) AS ssd FROM fracs AS a JOIN fracs AS b ON a.chrom = b.chrom WHERE a.chrom IN (1, 2, 3, 4, 5) GROUP BY 1, 2")
def k36(spark, d):
    m = cohort.pairwise_distances(_auto(spark, d), exclude=tuple(range(6, 23)))
    return m.withColumn("ssd", F.round("ssd", 12))


@query("k37_reference_frame", f"{BASE} SELECT sample_id, CAST(sum(reads) AS BIGINT) AS all_reads, CAST(max(CASE WHEN chrom = 21 THEN reads END) AS BIGINT) AS reads_21, round(max(CASE WHEN chrom = 23 THEN frac END), 12) AS frac_x FROM fracs GROUP BY 1")
def k37(spark, d):
    f = B.reference_frame(data.totals(spark, d))
    every = sum((F.col(f"reads_{n}") for n in [*map(str, range(1, 23)), "X", "Y"]), F.lit(0))
    return f.select("sample_id", every.cast("long").alias("all_reads"), "reads_21", F.round("frac_X", 12).alias("frac_x"))


# --- scores ----------------------------------------------------------------------------------------------------------

_LOO = "l AS (SELECT a.sample_id, a.chrom, a.frac, avg(b.frac) AS m, stddev_samp(b.frac) AS s FROM fracs AS a JOIN fracs AS b ON a.chrom = b.chrom AND a.sample_id <> b.sample_id GROUP BY 1, 2, 3)"


@query("k38_chromosome_z", f"{BASE}, {_LOO} SELECT sample_id, chrom, round(frac, 9) AS frac, round((frac - m) / nullif(s, 0), 6) AS z FROM l WHERE chrom <= 22")
def k38(spark, d):
    """The flagship: every sample's chromosome shares against all other samples."""
    return scores.leave_one_out_z(_auto(spark, d)).select("sample_id", "chrom", F.round("frac", 9).alias("frac"), F.round("loo_z", 6).alias("z"))


@query("k38b_z_against_controls", f"{BASE}, c AS (SELECT chrom, avg(frac) AS m, stddev_samp(frac) AS s FROM fracs WHERE sample_id >= 3 GROUP BY 1) SELECT sample_id, chrom, round((frac - m) / s, 6) AS z FROM fracs JOIN c USING (chrom) WHERE sample_id < 3 AND chrom <= 22")
def k38b(spark, d):
    f = _auto(spark, d)
    return scores.z_score(f.where("sample_id < 3"), f.where("sample_id >= 3")).select("sample_id", "chrom", F.round("z", 6).alias("z"))


_POOL = "(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 17, 19, 20, 22)"


@query("k39_ncv_pairs", f"""{BASE}, p AS (SELECT x.sample_id, x.chrom AS a, y.chrom AS b, CAST(f.reads AS DOUBLE) / (x.reads + CASE WHEN x.chrom = y.chrom THEN 0 ELSE y.reads END) AS ratio FROM totals AS x JOIN totals AS y ON x.sample_id = y.sample_id AND x.chrom <= y.chrom JOIN totals AS f ON f.sample_id = x.sample_id AND f.chrom = 21 WHERE x.chrom IN {_POOL} AND y.chrom IN {_POOL})
SELECT a, b, round(avg(ratio), 9) AS mean, round(stddev_samp(ratio) / avg(ratio), 9) AS cv FROM p GROUP BY 1, 2""")
def k39(spark, d):
    return scores.ncv_pairs(data.totals(spark, d), 21).select("a", "b", F.round("mean", 9).alias("mean"), F.round("cv", 9).alias("cv"))


@query("d16_best_pair", f"""{BASE}, p AS (SELECT x.sample_id, x.chrom AS a, y.chrom AS b, CAST(f.reads AS DOUBLE) / (x.reads + CASE WHEN x.chrom = y.chrom THEN 0 ELSE y.reads END) AS ratio FROM totals AS x JOIN totals AS y ON x.sample_id = y.sample_id AND x.chrom <= y.chrom JOIN totals AS f ON f.sample_id = x.sample_id AND f.chrom = 21 WHERE x.chrom IN {_POOL} AND y.chrom IN {_POOL}),
c AS (SELECT a, b, stddev_samp(ratio) / avg(ratio) AS cv FROM p GROUP BY 1, 2) SELECT a, b, round(cv, 9) AS cv FROM c ORDER BY round(cv, 12), a <> b, a, b LIMIT 1""")
def d16(spark, d):
    """Best template of at most two denominators, by the search kernel."""
    t = scores.ncv_templates(data.totals(spark, d), [21], 1, 2)
    return t.select(F.element_at("denominators", F.lit(1)).alias("a"), F.element_at("denominators", F.lit(-1)).alias("b"), F.round("cv", 9).alias("cv"))


@query("k39b_ncv_scores", f"""{BASE.replace('WITH reads', 'WITH RECURSIVE reads', 1)}, pool AS (SELECT DISTINCT chrom FROM totals WHERE chrom IN {_POOL}), st AS (SELECT [chrom] AS dens, chrom AS last, 1 AS k FROM pool UNION ALL SELECT list_append(dens, pool.chrom), pool.chrom, k + 1 FROM st JOIN pool ON pool.chrom > last WHERE k < 5),
de AS (SELECT dens, k, sample_id, sum(reads) AS d FROM (SELECT dens, k, unnest(dens) AS chrom FROM st) JOIN totals USING (chrom) GROUP BY 1, 2, 3), ra AS (SELECT dens, k, t.chrom AS focus, sample_id, CAST(reads AS DOUBLE) / d AS ratio FROM de JOIN totals AS t USING (sample_id) WHERE t.chrom IN (13, 18, 21)),
mo AS (SELECT focus, dens, k, avg(ratio) AS mean, stddev_samp(ratio) AS sd FROM ra GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY focus ORDER BY sd / mean, k, dens) = 1)
SELECT sample_id, focus, round(ratio, 9) AS ratio, round((ratio - mean) / nullif(sd, 0), 6) AS z FROM ra JOIN mo USING (focus, dens)""")
def k39b(spark, d):
    t = data.totals(spark, d)
    return scores.ncv_score(t, scores.ncv_templates(t, [13, 18, 21], 1, 5)).select("sample_id", "focus", F.round("ratio", 9).alias("ratio"), F.round("z", 6).alias("z"))


@query("k40_regression")
def k40(spark, d):
    f = _auto(spark, d)
    return scores.regression(f.where("sample_id < 3"), f.where("sample_id >= 3"), [13, 18, 21])


@query("k41_regression_strands")
def k41(spark, d):
    dense = data.dense(spark, d)
    s = B.strand_fractions(dense)
    long = s.select("sample_id", "chrom", F.explode(F.array(F.struct(F.lit("F").alias("strand"), F.col("frac_fwd").alias("frac")), F.struct(F.lit("R").alias("strand"), F.col("frac_rev").alias("frac")))).alias("x")).select("sample_id", "chrom", "x.strand", "x.frac")
    long = long.join(B.chromosome_totals(dense), ["sample_id", "chrom"])
    return scores.regression(long.where("sample_id < 3"), long.where("sample_id >= 3"), [13, 18, 21])


@query("k51_control_group_qc", f"""{BASE}, {CHI}, ct AS (SELECT sample_id, chrom, sum(n / coalesce(CAST(factor AS DOUBLE), 1)) AS reads FROM dense LEFT JOIN profile USING (chrom, bin) GROUP BY 1, 2), cf AS (SELECT sample_id, chrom, reads / sum(CASE WHEN chrom <= 22 THEN reads END) OVER (PARTITION BY sample_id) AS frac FROM ct),
cz AS (SELECT sample_id, abs((frac - avg(frac) OVER w) / stddev_samp(frac) OVER w) > 3 AS far FROM cf WHERE chrom <= 22 WINDOW w AS (PARTITION BY chrom)), ab AS (SELECT sample_id, bool_or(coalesce(far, false)) AS aberrant FROM cz GROUP BY 1),
ss AS (SELECT a.sample_id AS a, b.sample_id AS b, sum((a.frac - b.frac) * (a.frac - b.frac)) AS ssd FROM cf AS a JOIN cf AS b ON a.chrom = b.chrom AND a.sample_id <> b.sample_id WHERE a.chrom <= 22 AND a.chrom NOT IN (13, 18, 21) GROUP BY 1, 2), ms AS (SELECT a AS sample_id, avg(ssd) AS mean_ssd FROM ss GROUP BY 1),
ou AS (SELECT *, mean_ssd > (SELECT avg(mean_ssd) + 3 * stddev_samp(mean_ssd) FROM ms) AS outlier FROM ms) SELECT sample_id, round(mean_ssd, 12) AS mean_ssd, outlier, aberrant, CASE WHEN aberrant THEN 'aberrant' WHEN outlier THEN 'distant' ELSE 'ok' END AS status FROM ou JOIN ab USING (sample_id)""")
def k51(spark, d):
    out = qc.control_group_qc(data.dense(spark, d))
    return qc.sample_status(out["samples"]).select("sample_id", F.round("mean_ssd", 12).alias("mean_ssd"), "outlier", "aberrant", "status")


_AUTO_FR = f"{BASE}, u AS (SELECT sample_id, chrom, frac FROM fracs WHERE chrom <= 22)"


@query("k51b_regression_controls", f"""{_AUTO_FR}, xy AS (SELECT y.sample_id, y.chrom AS focus, x.chrom AS c, x.frac AS x, y.frac AS y FROM u AS y JOIN u AS x ON x.sample_id = y.sample_id AND x.chrom <> y.chrom AND x.chrom NOT IN (13, 18, 21) WHERE y.chrom IN (13, 18, 21)),
st AS (SELECT focus, c, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum((x - ax) * (y - ay)) AS sxy, sum((x - ax) * (x - ax)) AS sxx FROM (SELECT *, avg(x) OVER (PARTITION BY focus, c) AS ax, avg(y) OVER (PARTITION BY focus, c) AS ay FROM xy) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY focus ORDER BY sxy * sxy / sxx DESC, c) = 1),
r AS (SELECT sample_id, st.focus, st.c, y, my + sxy / sxx * (x - mx) AS fitted, 1.0 / n + (x - mx) * (x - mx) / sxx AS h FROM xy JOIN st ON st.focus = xy.focus AND st.c = xy.c)
SELECT sample_id, focus, c AS predictor, round(y / fitted, 9) AS ratio, round(y / (y - (y - fitted) / (1 - h)), 9) AS ratio_out FROM r""")
def k51b(spark, d):
    """Every control against the best model of one predictor, fitted without it."""
    rows = qc.regression_controls(B.fractions(data.totals(spark, d)), [13, 18, 21], 1, 1)
    return rows.select("sample_id", "focus", F.get("predictors", F.lit(0)).alias("predictor"), F.round("ratio", 9).alias("ratio"), F.round("ratio_out", 9).alias("ratio_out"))


@query("k51c_ratio_family", f"{_AUTO_FR}, l AS (SELECT a.sample_id, a.chrom, any_value(a.frac) / avg(b.frac) AS ratio_out, (any_value(a.frac) - avg(b.frac)) / stddev_samp(b.frac) AS z FROM u AS a JOIN u AS b ON a.chrom = b.chrom AND a.sample_id <> b.sample_id GROUP BY 1, 2) SELECT chrom, count(*) AS n, round(stddev_samp(ratio_out) / avg(ratio_out), 9) AS cv_out, round(max(abs(z)), 6) AS max_abs_z, count(*) FILTER (WHERE abs(z) > 3) AS n_far FROM l GROUP BY 1")
def k51c(spark, d):
    out = qc.family_summary(qc.ratio_controls(B.fractions(data.totals(spark, d))), ["chrom"])
    return out.select("chrom", "n", F.round("cv_out", 9).alias("cv_out"), F.round("max_abs_z", 6).alias("max_abs_z"), "n_far")


@query("k54_sample_qc", f"{_STATS.replace('mapq >= 5 AND flag & 512 = 0 AS use', 'true AS use')}, {DENSE}, {TOTALS}, {FRACS} SELECT st.sample_id, sequences, reads_mapped, round(frac, 9) AS frac_21, 'success' AS status, '' AS missing FROM st JOIN fracs ON fracs.sample_id = st.sample_id AND chrom = 21")
def k54(spark, d):
    r = data.reads(spark, d)
    dense = data.dense(spark, d)
    stats = R.alignment_stats(r)
    frame = B.reference_frame(B.chromosome_totals(dense))
    return qc.sample_qc_rows(r, {"alignment": stats, "fractions": frame}).select("sample_id", "sequences", "reads_mapped", F.round("frac_21", 9).alias("frac_21"), "status", "missing")


@query("l01_plot_chromosomes")
def l01(spark, d):
    return qc.plot_chromosomes(qc.control_group_qc(data.dense(spark, d))["chromosomes"])


@query("l03_plot_bins", f"{BASE}, {CHI} SELECT chrom, bin, CAST((chrom - 1) * 20 + bin AS BIGINT) AS x, round(z, 6) AS y FROM profile")
def l03(spark, d):
    return qc.plot_bins(chi.chi_profile(data.dense(spark, d))).withColumn("y", F.round("y", 6))
