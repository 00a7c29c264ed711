"""Further registered operators: lookups, remaps, conditional scores, projections, and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.operators import bins as B
from binfold.operators import cnv_predict as P
from binfold.operators import cnv_reference as C
from binfold.operators import cohort, gc, qc, sex
from binfold.operators import reads as R
from binfold.plans import data, workflows
from binfold.plans.data import BASE, GC_CTE, KEPT, READS
from binfold.plans.q_models import SEXT, _gonosomes, _REFS, _sexed, _thinned
from binfold.plans.q_sources import _LETTERS, _PIECES, _SEQ, _folder, _write, by_sample, fasta, sam_lines
from binfold.plans.registry import query
from binfold.sources import sinks, tables
from binfold.streaming import counts as stream

W = f"WITH {READS}"


@query("a14_sam_columns", f"{W} SELECT sample_id, 'chr' || chrom || '_' || (pos // 50000) AS bin_name, count(*) AS n FROM reads GROUP BY 1, 2")
def a14(spark, d):
    """Chromosome and position of all reads as alignment text; positions count from 1 in bin names, a multiple of the size goes down."""
    folder = _folder(spark, "sam")
    by_sample(sam_lines(data.reads(spark, d))).write.partitionBy("sample_id").text(folder)
    r = tables.read_sam(spark, folder, tables.sample_of_file("")).withColumn("pos", F.col("pos") + 1).withColumn("sample_id", F.col("sample_id").cast("int"))
    return R.string_bins(r)


@query("a15_count_file", f"{BASE} SELECT 'chr' || chrom || '_' || bin AS bin_name, CAST(sum(n) AS BIGINT) AS n FROM dense GROUP BY 1")
def a15(spark, d):
    """Counts of every bin as a file of names and counts with a header."""
    n = data.dense(spark, d).groupBy("chrom", "bin").agg(F.sum("n").alias("n"))
    lines = n.select(F.lit(1).alias("o"), F.concat(F.lit("chr"), F.col("chrom").cast("string"), F.lit("_"), F.col("bin").cast("string"), F.lit("\t"), F.col("n").cast("string")).alias("value"))
    return tables.read_seqff_counts(spark, _write(lines.unionByName(spark.createDataFrame([(0, "binName\tcounts")], "o int, value string")), _folder(spark, "counts")))


@query("a11_interval_coverage", f"{W}, reg AS (SELECT * FROM (VALUES (24, 0, 300000), (1, 0, 50000)) AS t(chrom, s, e)) SELECT sample_id, count(*) AS n_in FROM reads JOIN reg ON reads.chrom = reg.chrom AND pos >= s AND pos < e WHERE mapq >= 10 AND flag & 1024 = 0 GROUP BY 1")
def a11(spark, d):
    regions = spark.createDataFrame([(24, 0, 300000), (1, 0, 50000)], "chrom int, start long, end long")
    return R.region_counts(R.filter_reads(data.reads(spark, d), 10, 0, 1024), regions)


@query("a21_run_table", "SELECT 'SRR' || o_orderkey AS run, CAST(o_custkey AS VARCHAR) AS spots, 'https://trace.ncbi.nlm.nih.gov/Traces/sra-db-be/runinfo?acc=PRJ%201' AS url FROM orders")
def a21(spark, d):
    """Orders as runs of a run table, with lines of separators alone."""
    folder = _folder(spark, "runs")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("SRR"), F.col("o_orderkey").cast("string")).alias("Run"), F.col("o_custkey").cast("string").alias("spots"))
    rows.unionByName(rows.select(F.lit(None).cast("string").alias("Run"), F.lit(None).cast("string").alias("spots")).limit(3)).write.option("header", True).csv(folder)
    return tables.read_sra_runinfo(spark, folder).select(F.col("Run").alias("run"), "spots", F.lit(tables.sra_runinfo_url("PRJ 1")).alias("url"))


@query("a27_gc_precompute", f"WITH {_SEQ}, {_PIECES}, c AS (SELECT CAST(1 + doc_id % 24 AS INT) AS chrom, bin, sum({_LETTERS.format('CG')}) AS gc, sum({_LETTERS.format('ACGT')}) AS n FROM p GROUP BY 1, 2) SELECT chrom, bin, round(CAST(gc AS DOUBLE) / nullif(n, 0), 9) AS gc FROM c")
def a27(spark, d):
    """All texts as sequences of 24 names, their GC table written and read again."""
    rows = tables.read_fasta(spark, fasta(spark, d, (1 + F.col("doc_id") % 24).cast("string")))
    table = gc.gc_from_bases(rows, 1000).withColumn("chrom", F.col("chrom").cast("int")).withColumn("len", F.lit(1000))
    out = _folder(spark, "gc")
    sinks.write_bed(table, out, 1000, ["gc", "len"])
    return tables.read_gc_table(spark, out).select("chrom", "bin", F.round("gc", 9).alias("gc"))


def _combined(spark, d, min_refs: int):
    """Within-sample rows of two thirds of the autosomal bins, n % 7 references each, combined to the whole grid."""
    dense = data.dense(spark, d)
    rows = dense.where("chrom <= 22 and (chrom + bin) % 3 <> 0").select("sample_id", (F.col("chrom") * 20 + F.col("bin")).alias("masked_idx"), "chrom", "bin", F.lit(1.0).alias("x"), (F.col("n") - 5).cast("double").alias("z"), ((F.col("n") + 1) / 5.0).alias("r"), (F.col("n") % 7).alias("n_refs"), F.lit("A").alias("branch"))
    w = rows.select("branch", "masked_idx", (1.0 + F.col("bin")).alias("w")).distinct()
    return P.combine(rows, None, w, dense.select("sample_id", "chrom", "bin"), min_refs)


@query("b11_min_references", f"{BASE}, e AS (SELECT sample_id, chrom, chrom <= 22 AND (chrom + bin) % 3 <> 0 AND n % 7 >= 3 AS ok FROM dense) SELECT sample_id, chrom, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS zeroed FROM e GROUP BY 1, 2")
def b11(spark, d):
    """Bins with fewer than three references get 0 in ratio, z and weight, like bins that are masked."""
    out = _combined(spark, d, 3)
    zero = (F.col("r") == 0) & (F.col("z") == 0) & (F.col("w") == 0)
    return out.groupBy("sample_id", "chrom").agg(F.count_if(~zero).alias("kept"), F.count_if(zero).alias("zeroed"))


@query("b16_sample_lists", f"{W} SELECT DISTINCT sample_id, CASE WHEN sample_id = 3 THEN 'excluded' WHEN sample_id > 5 THEN 'not_included' ELSE 'kept' END AS decision FROM reads")
def b16(spark, d):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id int")
    return cohort.decide_samples(data.reads(spark, d), ids(*range(6)), ids(3))


@query("c02_summary_join", f"{BASE}, a AS (SELECT sample_id, CAST(sum(reads) AS BIGINT) AS reads FROM totals GROUP BY 1), b AS (SELECT sample_id, round(max(frac), 12) AS top FROM fracs WHERE chrom <= 22 AND sample_id <> 2 GROUP BY 1) SELECT a.sample_id, reads, coalesce(top, -1) AS top FROM a LEFT JOIN b USING (sample_id)")
def c02(spark, d):
    t = data.totals(spark, d)
    top = B.fractions(t).where("chrom <= 22 and sample_id <> 2").groupBy("sample_id").agg(F.round(F.max("frac"), 12).alias("top"))
    return t.groupBy("sample_id").agg(F.sum("reads").alias("reads")).join(top, "sample_id", "left").fillna(-1.0, ["top"])


@query("c03_coverage_lookup", f"{W}, w AS (SELECT CAST(range AS INT) AS sample_id, 'q' || CAST(range AS VARCHAR) AS label FROM range(0, 8)), s AS (SELECT sample_id, count(*) AS n FROM reads GROUP BY 1) SELECT s.sample_id, n, coalesce(label, 'missing') AS label FROM s LEFT JOIN w USING (sample_id)")
def c03(spark, d):
    labels = spark.range(8).select(F.col("id").cast("int").alias("sample_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("label"))
    return data.reads(spark, d).groupBy("sample_id").agg(F.count("*").alias("n")).join(labels, "sample_id", "left").fillna("missing", ["label"])


_TWO = "ma AS (SELECT chrom, bin, row_number() OVER (ORDER BY chrom, bin) - 1 AS masked_idx FROM (SELECT chrom, bin FROM dense WHERE chrom <= 22 GROUP BY 1, 2 HAVING sum(n) % 3 <> 0)), mf AS (SELECT chrom, bin, row_number() OVER (ORDER BY chrom, bin) - 1 AS other_idx FROM (SELECT chrom, bin FROM dense WHERE chrom <= 23 GROUP BY 1, 2 HAVING sum(n) % 6 <> 0))"


@query("c09_mask_remap", f"{BASE}, {_TWO} SELECT CAST(masked_idx AS INT) AS masked_idx, CAST(coalesce(other_idx, -1) AS INT) AS other_idx, other_idx IS NULL AS missing FROM ma LEFT JOIN mf USING (chrom, bin)")
def c09(spark, d):
    mask = data.dense(spark, d).groupBy("chrom", "bin").agg((F.sum("n") % 3 != 0).alias("k3"), (F.sum("n") % 6 != 0).alias("k6"))
    a = B.masked_rank(mask.where("chrom <= 22").select("chrom", "bin", F.col("k3").alias("keep")))
    f = B.masked_rank(mask.where("chrom <= 23").select("chrom", "bin", F.col("k6").alias("keep")))
    return C.remap(a, f).fillna(-1, ["other_idx"])


@query("c10_gather", f"{BASE}, v AS (SELECT sample_id, chrom * 20 + bin AS i, n FROM dense), r AS (SELECT i.range AS i, (i.range * 7 + k.range * 13) % 480 + 20 AS ref FROM range(20, 500) AS i CROSS JOIN range(0, 5) AS k), g AS (SELECT v.sample_id, r.i, median(n) AS med, count(*) AS n_refs FROM r JOIN v ON v.i = r.ref GROUP BY 1, 2) SELECT g.sample_id, CAST(g.i AS BIGINT) AS i, n_refs, round(v.n / nullif(med, 0), 6) AS ratio FROM g JOIN v ON v.sample_id = g.sample_id AND v.i = g.i")
def c10(spark, d):
    """A bin's value over the median of the values its reference indices point to, in the same sample."""
    index = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("id") * 7 + k * 13) % 480 + 21)  # indices of a reference count from 1
    knn = spark.range(20, 500).select(F.col("id").alias("masked_idx"), index.alias("refs"), F.array_repeat(F.lit(0.5), 5).alias("distances"))
    v = data.dense(spark, d).select("sample_id", (F.col("chrom") * 20 + F.col("bin")).cast("long").alias("masked_idx"), "chrom", "bin", F.col("n").cast("double").alias("x"))
    return P.normalise_within(v, knn, float("inf"), 1).select("sample_id", F.col("masked_idx").alias("i"), "n_refs", F.round("r", 6).alias("ratio"))


@query("e05_local_minima", f"{W}, g AS (SELECT mapq AS x, count(*) AS y FROM reads GROUP BY 1), n AS (SELECT x, y, lag(y) OVER (ORDER BY x) AS a, lead(y) OVER (ORDER BY x) AS b FROM g) SELECT x, y FROM n WHERE y < a AND y < b")
def e05(spark, d):
    return C.local_minima(data.reads(spark, d).groupBy(F.col("mapq").alias("x")).agg(F.count("*").alias("y")))


@query("e08_subset_z", f"{BASE}, f AS (SELECT sample_id, frac, sample_id % 3 <> 0 AS m FROM fracs WHERE chrom = 21) SELECT a.sample_id, round((a.frac - avg(b.frac)) / stddev_samp(b.frac), 6) AS z FROM f AS a JOIN f AS b ON b.m AND b.sample_id <> a.sample_id GROUP BY a.sample_id, a.frac")
def e08(spark, d):
    f = B.fractions(data.totals(spark, d)).where("chrom = 21").withColumn("m", F.col("sample_id") % 3 != 0)
    return cohort.subset_z(f, "frac", "m").select("sample_id", F.round("subset_z", 6).alias("z"))


@query("f02_position_order", f"{W}, p AS (SELECT DISTINCT sample_id, chrom, pos FROM reads) SELECT sample_id, chrom, pos, CAST(row_number() OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS INT) AS place FROM p QUALIFY place <= 3")
def f02(spark, d):
    p = data.reads(spark, d).select("sample_id", "chrom", "pos").distinct()
    return p.withColumn("place", F.row_number().over(Window.partitionBy("sample_id", "chrom").orderBy("pos"))).where("place <= 3")


@query("f03_probe", f"{BASE} SELECT CAST(50000 AS INT) AS binsize, 5 AS columns, count(*) AS rows FROM dense")
def f03(spark, d):
    """Bin size and columns are found from the first row of files of all samples."""
    path = _folder(spark, "probe")
    sinks.write_beds(data.dense(spark, d), path, 50000, ["n", "n_fwd"], {"binsize": "none of a reader's business"})
    size, columns = tables.infer_binsize(spark, path), tables.column_count(spark, path)
    return tables.read_tabix(spark, path, columns).agg(F.lit(size).alias("binsize"), F.lit(columns).alias("columns"), F.count("*").alias("rows"))


@query("f06_forward_choice", f"{BASE}, f AS (SELECT a.chrom AS c, corr(a.frac, b.frac) AS r FROM fracs AS a JOIN fracs AS b ON a.sample_id = b.sample_id AND b.chrom = 21 WHERE a.chrom <= 22 AND a.chrom NOT IN (13, 18, 21) GROUP BY 1) SELECT c AS best FROM f ORDER BY r * r DESC, c LIMIT 1")
def f06(spark, d):
    """First predictor of the forward search: the chromosome of highest squared correlation."""
    from binfold.operators.scores import regression

    f = B.fractions(data.totals(spark, d)).where("chrom <= 22")
    m = regression(f.where("sample_id = 0"), f, [21], n_models=1, n_predictors=1, train_fraction=1.0)
    return m.select(F.element_at("predictors", F.lit(1)).cast("int").alias("best"))


@query("g02_row_bind", f"{BASE} SELECT 'chromosome' AS level, CAST(chrom AS VARCHAR) AS name, CAST(sum(reads) AS BIGINT) AS reads FROM totals GROUP BY 2 UNION ALL SELECT 'sample', CAST(sample_id AS VARCHAR), CAST(sum(reads) AS BIGINT) FROM totals GROUP BY 2")
def g02(spark, d):
    t = data.totals(spark, d)
    by = lambda level, c: t.groupBy(F.lit(level).alias("level"), F.col(c).cast("string").alias("name")).agg(F.sum("reads").alias("reads"))
    return by("chromosome", "chrom").unionByName(by("sample", "sample_id"))


@query("g06_set_equality", "SELECT true AS same, false AS other")
def g06(spark, d):
    a = data.reads(spark, d).select("sample_id").distinct()
    return spark.createDataFrame([(cohort.same_members(a, a), cohort.same_members(a, a.where("sample_id > 0")))], "same boolean, other boolean")


_LOADS = "lr AS (SELECT chrom, bin, row_number() OVER (ORDER BY chrom, bin) - 1 AS i, 0.0001 * (1 + (chrom + bin) % 5) AS mean, ((chrom * 3 + bin) % 7 - 3) / 20.0 AS l0, ((chrom + bin * 5) % 11 - 5) / 30.0 AS l1 FROM (SELECT DISTINCT chrom, bin FROM dense WHERE chrom <= 22 AND (chrom + bin) % 4 <> 0))"


def _loads(spark):
    cells = spark.range(1, 23).select(F.col("id").cast("int").alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("bin")).where("(chrom + bin) % 4 <> 0")
    idx = (F.row_number().over(Window.orderBy("chrom", "bin")) - 1).alias("masked_idx")
    return cells.select(F.lit("A").alias("branch"), idx, "chrom", "bin", (F.lit(0.0001) * (1 + (F.col("chrom") + F.col("bin")) % 5)).alias("mean"), F.array((((F.col("chrom") * 3 + F.col("bin")) % 7) - 3) / 20.0, (((F.col("chrom") + F.col("bin") * 5) % 11) - 5) / 30.0).alias("loading"))


@query("k16_branch_normalise", f"{BASE} SELECT sample_id, chrom, bin, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY sample_id), 12) AS x FROM dense WHERE chrom <= 23")
def k16(spark, d):
    return B.normalised(data.dense(spark, d), "n", 23).select("sample_id", "chrom", "bin", F.round("x", 12).alias("x"))


@query("k17_pca_projection", f"""{BASE}, {_LOADS}, x AS (SELECT sample_id, chrom, bin, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY sample_id) AS x FROM dense WHERE chrom <= 22), j AS (SELECT * FROM x JOIN lr USING (chrom, bin)),
s AS (SELECT sample_id, sum(l0 * (x - mean)) AS s0, sum(l1 * (x - mean)) AS s1 FROM j GROUP BY 1) SELECT sample_id, CAST(i AS INT) AS masked_idx, round(x / (mean + s0 * l0 + s1 * l1), 4) AS x FROM j JOIN s USING (sample_id) WHERE x > 0 AND abs(mean + s0 * l0 + s1 * l1) > 1e-5""")
def k17(spark, d):
    loads = _loads(spark)
    v = P.branch_values(data.dense(spark, d), loads, "A")
    x = B.normalised(data.dense(spark, d), "n", 22).select("sample_id", "chrom", "bin", F.col("x").alias("raw"))
    both = v.join(x, ["sample_id", "chrom", "bin"]).where((F.col("raw") > 0) & (F.abs(F.col("raw") / F.nullif(F.col("x"), F.lit(0.0))) > 1e-5))
    return both.select("sample_id", "masked_idx", F.round("x", 4).alias("x"))


@query("k21_combine", f"""{BASE}, r AS (SELECT sample_id, chrom, bin, (n + 1) / 5.0 AS r, CAST(n - 5 AS DOUBLE) AS z, n % 7 AS n_refs, 1.0 + bin AS w FROM dense WHERE chrom <= 22 AND (chrom + bin) % 3 <> 0),
c AS (SELECT sample_id, median(log2(r)) AS m_lr, median(z) AS m_z, avg(w) AS mw FROM r GROUP BY 1), o AS (SELECT sample_id, chrom, bin, CASE WHEN n_refs >= 2 AND log2(r) <> 0 THEN log2(r) - m_lr ELSE 0 END AS r, CASE WHEN n_refs >= 2 THEN z - m_z ELSE 0 END AS z, CASE WHEN n_refs >= 2 THEN w / mw ELSE 0 END AS w FROM r JOIN c USING (sample_id))
SELECT sample_id, chrom, bin, round(coalesce(r, 0), 9) AS r, round(coalesce(z, 0), 9) AS z, round(coalesce(w, 0), 9) AS w FROM dense LEFT JOIN o USING (sample_id, chrom, bin)""")
def k21(spark, d):
    return _combined(spark, d, 2).select("sample_id", "chrom", "bin", *[F.round(c, 9).alias(c) for c in ("r", "z", "w")])


@query("k43_sex_by_y_ratio", f"{SEXT} SELECT sample_id, sex AS prediction FROM f")
def k43(spark, d):
    """Sex from the ratio of reads in Y regions; the thinned cohort is separable."""
    regions = spark.createDataFrame([(24, 0, 1_000_000)], "chrom int, start long, end long")
    ratios = R.y_unique_ratio(_thinned(spark, d), regions)
    return sex.predict_sex(ratios, [sex.sex_model(ratios, "y_unique")]).select("sample_id", "prediction")


@query("l02_sample_status", f"""{BASE}, z AS (SELECT sample_id, chrom, (frac - avg(frac) OVER w) / stddev_samp(frac) OVER w AS z FROM fracs WHERE chrom <= 22 WINDOW w AS (PARTITION BY chrom)) SELECT sample_id, CASE WHEN max(abs(z)) > 2.5 THEN 'aberrant' WHEN max(abs(z)) > 2 THEN 'distant' ELSE 'ok' END AS status FROM z GROUP BY 1""")
def l02(spark, d):
    s = cohort.chromosome_scores(B.fractions(data.totals(spark, d)).where("chrom <= 22")).groupBy("sample_id").agg(F.max(F.abs("z")).alias("m"))
    return qc.sample_status(s.select("sample_id", (F.col("m") > 2.5).alias("aberrant"), (F.col("m") > 2).alias("outlier"))).select("sample_id", "status")


@query("a29_gonosome_report_file", f"{SEXT}, {_REFS}, s AS (SELECT sex, avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy FROM ref WHERE NOT outlier GROUP BY 1), z AS (SELECT f.sample_id, f.sex, (x - mx) / sx AS zx, 100 * sx / mx AS cx, (y - my) / sy AS zy, 100 * sy / my AS cy FROM f JOIN s USING (sex)) SELECT sample_id, sex AS predicted_sex, 'X' AS chromosome, round(zx, 5) AS z_score, round(cx, 5) AS cv FROM z UNION ALL SELECT sample_id, sex, 'Y', round(zy, 5), round(cy, 5) FROM z")
def a29(spark, d):
    """The gonosome report of every sample, written as text and read again."""
    path = _folder(spark, "report")
    sinks.write_report(_gonosomes(spark, d), path)
    back = tables.read_metrics(spark, path)
    return back.select(F.col("sample_id").cast("int").alias("sample_id"), "predicted_sex", "chromosome", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("z_score", "cv")])


@query("a31_json_report", f"{W}, v AS (SELECT chrom, count(*) FILTER (WHERE mapq > 48) AS v, count(*) FILTER (WHERE seq_len = 0 AND mapq > 45) AS low, stddev_samp(mapq) AS sd FROM reads WHERE mapq > 40 GROUP BY 1) SELECT 'chr' || chrom AS branch, v, CASE WHEN v = 0 THEN 'FAIL' WHEN low > 0 THEN 'WARN' WHEN sd > 2.9 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM v")
def a31(spark, d):
    """Verdicts per chromosome, written as JSON and read again."""
    path = _folder(spark, "json")
    s = data.reads(spark, d).where("mapq > 40").groupBy("chrom").agg(F.count_if(F.col("mapq") > 48).alias("v"), F.count_if((F.col("seq_len") == 0) & (F.col("mapq") > 45)).alias("low"), F.stddev_samp("mapq").alias("sd"))
    sinks.write_json(s.select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("branch"), "v", C.verdict(F.col("v"), F.col("low"), F.col("sd"), 2.9).alias("verdict")), path)
    return spark.read.schema("branch string, v long, verdict string").json(path)


@query("i03_online_dedup", f"{W}, {KEPT} SELECT sample_id, count(*) AS n FROM kept GROUP BY 1")
def i03(spark, d):
    """Stateful duplicate removal on a stream of sorted reads, compared with the batch form in the tests."""
    folder, out = _folder(spark, "reads"), _folder(spark, "kept")
    r = data.reads(spark, d)
    order = Window.partitionBy("sample_id", "chrom").orderBy("pos", *data.ORDER)
    r.withColumn("read_no", F.row_number().over(order).cast("long")).select("sample_id", "chrom", "pos", "mate_pos", "flag", "read_no").write.parquet(folder)
    src = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    q = stream.online_dedup(src).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("sample_id").agg(F.count("*").alias("n"))


def _deal(rows: DataFrame, folder: str, files: int = 1) -> None:
    """Three batches of reads at random, a number of files each; one job makes the rows and writes them all."""
    rows.repartition(3 * files, F.xxhash64("read_no", "sample_id", "chrom")).write.mode("append").parquet(folder)


@query("i03b_ordered_dedup", f"{W}, {KEPT} SELECT sample_id, count(*) AS n FROM kept GROUP BY 1")
def i03b(spark, d):
    """Reads dealt to batches at random: held back until the watermark has passed them, they give the batch result."""
    folder, out = _folder(spark, "shuffled"), _folder(spark, "kept")
    order = Window.partitionBy("sample_id", "chrom").orderBy("pos", *data.ORDER)
    cols = ["sample_id", "chrom", "pos", "mate_pos", "flag", "read_no", "ts"]
    rows = data.reads(spark, d).withColumn("read_no", F.row_number().over(order).cast("long")).withColumn("ts", F.timestamp_seconds(F.col("pos") / 1000 + 60)).select(*cols)
    files = spark.sparkContext.defaultParallelism
    _deal(rows, folder, files)
    for k in (1, 2):  # two batches of late reads of no sample move the watermark past all others
        spark.range(0, files, 1, files).selectExpr("-1 AS sample_id", "1 AS chrom", "1000000000L AS pos", "0L AS mate_pos", "0 AS flag", "0L AS read_no", f"timestamp_seconds({k}0000000) AS ts").write.mode("append").parquet(folder)
    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider)
    spark.conf.set(provider, rocks)
    try:
        src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
        q = stream.ordered_dedup(src, "30 minutes").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(out).where("sample_id >= 0").groupBy("sample_id").agg(F.count("*").alias("n"))


@query("d02b_gc_weighted_curve", f"{BASE}, {GC_CTE} SELECT CAST(round_even(gc * 100, 0) AS INT) AS percent, CAST(sum(n) AS BIGINT) AS n, count(*) AS bins FROM dense JOIN gct USING (chrom, bin) WHERE gc IS NOT NULL GROUP BY 1")
def d02b(spark, d):
    return gc.join_gc(data.dense(spark, d), data.gc_table(spark)).where("gc is not null").groupBy(F.bround(F.col("gc") * 100).cast("int").alias("percent")).agg(F.sum("n").alias("n"), F.count("*").alias("bins"))


@query("m01_preprocess_cohort", f"{W}, c AS (SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n FROM reads WHERE mapq >= 10 AND flag & 1024 = 0 GROUP BY 1, 2, 3), s AS (SELECT sample_id, CAST(sum(n) AS BIGINT) AS post_sum, count(*) AS nonzero_bins, round(CAST(sum(CASE WHEN chrom = 24 THEN n END) AS DOUBLE) / sum(CASE WHEN chrom <= 22 THEN n END), 9) AS y_frac FROM c GROUP BY 1), p AS (SELECT sample_id, count(*) AS pre_sum FROM reads GROUP BY 1) SELECT sample_id, pre_sum, post_sum, nonzero_bins, y_frac, 'success' AS status FROM s JOIN p USING (sample_id)")
def m01(spark, d):
    """Counts, GC correction and a quality row of every sample."""
    out = workflows.preprocess_cohort(data.reads(spark, d), data.lengths(spark), data.gc_table(spark), _folder(spark, "cohort"), 50000, 10, 1024)
    return out["sample_qc"].select("sample_id", "pre_sum", "post_sum", "nonzero_bins", F.round("y_frac", 9).alias("y_frac"), "status")


@query("m03_predict_cohort", f"{SEXT}, fr AS (SELECT sample_id, chrom, reads, CAST(reads AS DOUBLE) / sum(CASE WHEN chrom <= 22 THEN reads END) OVER (PARTITION BY sample_id) AS frac FROM t), c AS (SELECT chrom, avg(frac) AS m, stddev_samp(frac) AS s FROM fr WHERE sample_id >= 3 GROUP BY 1), z AS (SELECT sample_id, chrom, round((frac - m) / s, 6) AS z FROM fr JOIN c USING (chrom) WHERE sample_id < 3) SELECT z.sample_id, 'ok' AS status, any_value(sex) AS predicted_sex, max(CASE WHEN chrom = 13 THEN z END) AS z_13, max(CASE WHEN chrom = 18 THEN z END) AS z_18, max(CASE WHEN chrom = 21 THEN z END) AS z_21 FROM z JOIN f ON f.sample_id = z.sample_id GROUP BY 1")
def m03(spark, d):
    """A reference of all samples but three, stored, read again and asked about those three."""
    dense, path = _sexed(spark, d), _folder(spark, "fractions")
    workflows.build_fraction_reference(dense.where("sample_id >= 3"), path, prune=False, ncv_sizes=(1, 2), sex_ncv_sizes=(1, 2), n_models=2, n_predictors=2)
    out = workflows.predict_fractions(dense.where("sample_id < 3"), workflows.load_fraction_reference(spark, path), chi_corrected=False, train_fraction=1.0)
    return out["summary"].select("sample_id", "status", "predicted_sex", *[F.round(c, 6).alias(c) for c in ("z_13", "z_18", "z_21")])
