"""Properties and refusals of operators on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from binfold.functions.safe import chrom_key, is_finite, safe_div, safe_log2
from binfold.operators import bins as B
from binfold.operators import chi, cnv_predict, cnv_reference, cohort, gc, qc, sex
from binfold.operators import reads as R
from binfold.plans import data, workflows
from binfold.sources import sinks, tables
from binfold.streaming import counts as stream

DIR = "/root/testdata/sf0.001"


def test_safe_columns(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 0.0), (nan, 1.0), (None, 1.0), (inf, 2.0), (8.0, 2.0), (-1.0, 4.0)], "a double, b double")
    got = df.select(safe_div("a", "b").alias("d"), safe_log2("a").alias("l"), is_finite("a").alias("f")).collect()
    assert got[0]["d"] is None and got[4]["d"] == 4.0 and [r["f"] for r in got] == [True, False, False, False, True, True]
    assert [r["l"] for r in got] == [0.0, None, None, None, 3.0, None]
    names = spark.createDataFrame([("chrX",), ("CHR7",), ("y",), ("22",)], "c string").select(chrom_key("c").alias("k")).collect()
    assert [r["k"] for r in names] == ["23", "7", "24", "22"]


def test_streaming_dedup_state(spark):
    rows = [  # pos, mate, flag
        (10, 90, 3), (10, 90, 3), (10, 91, 3), (10, 91, 1), (10, 91, 3), (12, 0, 0), (12, 5, 0), (12, 5, 3),
    ]
    df = spark.createDataFrame([("s", 1, p, m, f, i) for i, (p, m, f) in enumerate(rows)], "sample_id string, chrom int, pos long, mate_pos long, flag int, read_no int")
    kept = [r["read_no"] for r in R.streaming_dedup(df, ["read_no"]).orderBy("read_no").collect()]
    assert kept == [0, 2, 5, 7]  # the last pair finds the mate of the pair before the single reads, 91
    with pytest.raises(ValueError):
        R.remove_duplicates(df, "other")


def test_online_dedup_equals_batch(spark, tmp_path):
    r = data.reads(spark, DIR).where("sample_id < 3").withColumn("read_no", F.monotonically_increasing_id())
    r.select("sample_id", "chrom", "pos", "mate_pos", "flag", "read_no").coalesce(1).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    q = stream.online_dedup(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = R.streaming_dedup(table, ["read_no"])
    assert spark.table("dedup_out").select("read_no").exceptAll(batch.select("read_no")).count() == 0
    assert spark.table("dedup_out").count() == batch.count()


def test_single_reads_leave_the_mate_of_the_last_pair(spark):
    """Pair, single, pair at one position: the second pair repeats the first; a mate may also come from before."""
    rows = [(1, 50, 3), (1, 0, 0), (1, 50, 3), (2, 0, 0), (2, 50, 3), (2, 60, 3), (70000, 0, 0), (70000, 60, 3), (70000, 61, 3), (70000, 61, 1), (70000, 61, 3), (90000, 61, 3)]
    df = spark.createDataFrame([("a", 1, p, m, f, i) for i, (p, m, f) in enumerate(rows)], "sample_id string, chrom int, pos long, mate_pos long, flag int, read_no long")
    want, at, pair = [], None, None
    for i, (p, m, f) in enumerate(rows):
        if f & 1 and not f & 2:
            continue
        if not (p == at and (not f & 1 or m == pair)):
            want.append(i)
        at, pair = p, m if f & 1 else pair
    assert want == [0, 3, 5, 6, 8, 11]
    for cell in (1, 3, 1 << 16):
        assert sorted(r["read_no"] for r in R.streaming_dedup(df, ["read_no"], cell).collect()) == want


def test_ordered_dedup_takes_shuffled_batches(spark, tmp_path):
    """Reads that arrive in any order within the lateness give the rows of the batch form."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        order = Window.partitionBy("sample_id", "chrom").orderBy("pos", *data.ORDER)
        r = data.reads(spark, DIR).where("sample_id < 3 AND chrom < 4").withColumn("read_no", F.row_number().over(order).cast("long")).select("sample_id", "chrom", F.expr("pos - pos % 4000").alias("pos"), F.expr("mate_pos % 3").alias("mate_pos"), "flag", "read_no")
        r = r.withColumn("ts", F.timestamp_seconds(F.col("pos") / 1000 + 60))  # the first watermark is at 0
        table = spark.createDataFrame(r.collect(), r.schema)
        pieces = [table.where(F.pmod(F.xxhash64("read_no", "sample_id", "chrom"), F.lit(4)) == k) for k in range(4)]
        end = spark.createDataFrame([(99, 1, 10**9, 0, 0, 0)], "sample_id int, chrom int, pos long, mate_pos long, flag int, read_no long").withColumn("ts", F.timestamp_seconds(F.lit(10**7)))
        source, out = f"{tmp_path}/in", f"{tmp_path}/out"
        got = []
        for piece in [*pieces, end, end.withColumn("ts", F.timestamp_seconds(F.lit(2 * 10**7)))]:
            piece.coalesce(1).write.mode("append").parquet(source)
            q = stream.ordered_dedup(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source), "30 minutes").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        got = spark.read.parquet(out).where("sample_id < 99")
        batch = R.streaming_dedup(table, ["read_no"])
        cols = ["sample_id", "chrom", "read_no"]
        assert got.count() == batch.count() < table.count()
        assert got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_rescale_keeps_sums(spark):
    df = spark.createDataFrame([("a", 1, i, i + 1) for i in range(7)], "sample_id string, chrom int, bin int, n long")
    got = {r["bin"]: r["n"] for r in B.rescale(df, 10, 30).collect()}
    assert got == {0: 6, 1: 15, 2: 7}
    with pytest.raises(ValueError):
        B.rescale(df, 10, 25)


def test_strand_modes_differ(spark):
    df = spark.createDataFrame([("a", 1, 0, 30, 10), ("a", 2, 0, 10, 10)], "sample_id string, chrom int, bin int, n_fwd long, n_rev long")
    s = {r["chrom"]: r for r in B.strand_fractions(df).collect()}
    g = {r["chrom"]: r for r in B.strand_fractions(df, "group").collect()}
    assert s[1]["frac_fwd"] == 0.375 and s[1]["frac_rev"] == 0.25 and g[1]["frac_fwd"] == 0.5


def biased(spark):
    rows, gct = [], []
    rng = np.random.default_rng(1)
    for c in range(1, 23):
        for b in range(50):
            g = 0.30 + 0.4 * b / 49 + 0.005 * (c % 3)
            gct.append((c, b, g))
            rows.append(("s", c, b, float(max(1, 100 * (1 + 2 * (g - 0.5)) + rng.normal(0, 3)))))
    return spark.createDataFrame(rows, "sample_id string, chrom int, bin int, n double"), spark.createDataFrame(gct, "chrom int, bin int, gc double")


@pytest.mark.parametrize("method", ["loess_correct", "bin_weight_correct"])
def test_gc_correction_removes_bias(spark, method):
    bins, gct = biased(spark)
    q = gc.preprocess_qc(getattr(gc, method)(bins, gct)).first()
    assert abs(q["gc_cor_pre"]) > 0.8 and abs(q["gc_cor_post"]) < 0.15 and q["cv_post"] < q["cv_pre"]


def test_chi_only_lowers_overdispersed_bins(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{s}", c, b, int(rng.poisson(200) * (4 if (c, b) == (3, 1) and s % 2 else 1))) for s in range(12) for c in range(1, 25) for b in range(4)]
    df = spark.createDataFrame(rows, "sample_id string, chrom int, bin int, n long")
    prof = chi.chi_profile(df)
    factors = {(r["chrom"], r["bin"]): r["factor"] for r in prof.collect()}
    assert all(f >= 1 for f in factors.values()) and max(factors, key=factors.get) == (3, 1)
    out = chi.chi_correct(df, prof)
    assert out.where("chrom >= 23").exceptAll(df.where("chrom >= 23").select(out.columns)).count() == 0
    with pytest.raises(ValueError):
        chi.chi_correct(df, prof, include_sex=True)


def test_distances_are_a_metric_table(spark):
    f = B.fractions(data.totals(spark, DIR))
    d = {(r["sample_a"], r["sample_b"]): r["ssd"] for r in cohort.pairwise_distances(f).collect()}
    assert all(abs(d[a, b] - d[b, a]) < 1e-15 for a, b in d) and all(d[a, a] == 0 for a, _ in d)
    known = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.3), ("b", 1, 0.2), ("b", 2, 0.2)], "sample_id string, chrom int, frac double")
    assert abs({(r["sample_a"], r["sample_b"]): r["ssd"] for r in cohort.pairwise_distances(known, exclude=()).collect()}["a", "b"] - 0.02) < 1e-12


def test_group_refusals(spark):
    one = spark.createDataFrame([("a", "combined", 1)], "sample_id string, strand_type string, input_order int")
    with pytest.raises(ValueError):
        cohort.as_control_group(one)
    with pytest.raises(ValueError):
        cohort.as_control_group(one.unionByName(spark.createDataFrame([("b", "separated", 1)], one.schema)))
    two = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    with pytest.raises(ValueError):
        cohort.drop_samples(two, two.limit(1))


def test_leave_one_out_equals_definition(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0.05, 1e-4, 9)
    got = {r["i"]: r["loo_z"] for r in cohort.leave_one_out(spark.createDataFrame([(i, "c", float(x)) for i, x in enumerate(v)], "i int, g string, x double"), "x", ["g"]).collect()}
    for i in range(9):
        rest = np.delete(v, i)
        assert abs(got[i] - (v[i] - rest.mean()) / rest.std(ddof=1)) < 1e-6


def cnv_cohort(spark, gain: tuple[int, int, int] | None = None, n: int = 14, bins: int = 24):
    rng, rows = np.random.default_rng(11), []
    shape = rng.uniform(0.8, 1.2, (25, bins))
    for s in range(n):
        male = s % 2
        for c in range(1, 25):
            for b in range(bins):
                lam = 600 * shape[c, b] * (0.5 if c == 23 and male else 1) * ((0.5 if male else 0.002) if c == 24 else 1)
                if gain and s == 0 and c == gain[0] and gain[1] <= b < gain[2]:
                    lam *= 1.5
                rows.append((s, c, b, int(rng.poisson(lam))))
    lengths = spark.createDataFrame([(c, bins * 10) for c in range(1, 25)], "chrom int, length long")
    return spark.createDataFrame(rows, "sample_id int, chrom int, bin int, n long"), lengths


def test_gain_is_called(spark):
    df, lengths = cnv_cohort(spark)
    cases, _ = cnv_cohort(spark, gain=(7, 6, 18), n=2)
    out = workflows.predict_cohort(df, lengths, 10, cases=cases, refsize=60, min_refs=10, yfrac=0.005, components=2, alpha=0.01)
    calls = [r for r in out["aberrations"].collect() if r["chrom"] <= 22]
    hit = [r for r in calls if r["sample_id"] == 0 and r["chrom"] == 7 and r["type"] == "gain"]
    assert hit and abs(min(r["start"] for r in hit) - 6) <= 1 and abs(max(r["end"] for r in hit) - 18) <= 1
    assert sum(r["sample_id"] == 1 for r in calls) <= 1
    stats = {r["sample_id"]: r["cpa"] for r in out["statistics"].collect()}
    assert stats[0] >= 0 and math.isfinite(stats[0])
    files = sinks.prediction_tables(out, 10)
    assert files["bins"].where("start % 10 <> 1").count() == 0 and files["segments"].count() == out["segments"].count()


def test_knn_never_stays_on_its_chromosome(spark):
    df, _ = cnv_cohort(spark, n=10, bins=6)
    m = cnv_reference.branch_matrix(df, cnv_reference.coverage_mask(df), "F")
    chrom = {r["masked_idx"]: r["chrom"] for r in m.collect()}
    for r in cnv_reference.knn_bins(m, 5, "F", block=16).collect():
        c = chrom[r["masked_idx"]]
        if c < 22:
            assert r["refs"] == [0] * 5 and r["distances"] == [1.0] * 5
        else:
            assert all(chrom[i - 1] != c for i in r["refs"])


def test_knn_in_chunks_equals_one_chunk(spark):
    df, _ = cnv_cohort(spark, n=10, bins=6)
    m = cnv_reference.branch_matrix(df, cnv_reference.coverage_mask(df), "F")
    for branch in ("A", "F"):
        rows = lambda **kw: {r["masked_idx"]: (r["refs"], r["distances"]) for r in cnv_reference.knn_bins(m, 9, branch, block=16, **kw).collect()}  # noqa: B023, E731
        assert rows(ref_bytes=8 * 10 * 20) == rows()
    few = {r["masked_idx"]: r["refs"] for r in cnv_reference.knn_bins(m.where("masked_idx < 8"), 9, "A", block=2, ref_bytes=8 * 10 * 2).collect()}
    assert all(x.count(0) == 9 - (2 if i < 6 else 6) for i, x in few.items())


@pytest.mark.parametrize("n, width", [(5_000, 64), (50_000, 64), (500_000, 64), (40_000, 800)])
def test_knn_sends_a_bin_as_often_whatever_the_number_of_bins(n, width):
    """And no part is larger than what fits, beyond which the copies have to grow."""
    block, chunk = cnv_reference.part_sizes(n, width, None, 32 << 20)
    assert 8 * width * max(block, chunk) <= 32 << 20
    assert -(-n // block) + -(-n // chunk) <= max(16, 2 * (1 + n * 8 * width // (32 << 20)))


def test_knn_equals_brute_force_and_leaves_out_bins_without_a_chromosome(spark):
    rng = np.random.default_rng(4)
    x, chrom = rng.normal(size=(2_500, 6)), [None if i % 50 == 0 else 1 + i % 3 for i in range(2_500)]
    m = spark.createDataFrame([(i, c, v.tolist()) for i, (c, v) in enumerate(zip(chrom, x))], "masked_idx long, chrom int, x array<double>")
    got = {r["masked_idx"]: r["refs"] for r in cnv_reference.knn_bins(m, 4).collect()}
    assert set(got) == {i for i, c in enumerate(chrom) if c}
    for i in rng.choice(sorted(got), 60, replace=False).tolist():
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[[j for j, c in enumerate(chrom) if c is None or c == chrom[i]]] = np.inf
        assert got[i] == (np.argsort(far, kind="stable")[:4] + 1).tolist()


def test_female_pruning_leaves_the_male_branch_alone(spark):
    df, lengths = cnv_cohort(spark, n=20)
    # Three bins of X vary wildly among females only, each in its own way: one component can't explain them all.
    wild = F.when((F.col("chrom") == 23) & F.col("bin").isin(3, 9, 15) & (F.col("sample_id") % 2 == 0), F.col("n") * (1 + F.pmod(F.col("sample_id") * F.col("bin") * 7 + F.col("bin"), F.lit(5)))).otherwise(F.col("n"))
    df = df.withColumn("n", wild.cast("long"))
    ref = cnv_reference.newref(df, yfrac=0.005, refsize=20, components=1, outliers={"floor": {"auto": 10.0, "X": 0.0, "Y": 10.0}, "multiplier": {"auto": 20.0, "X": 20.0, "Y": 50.0}}, save=workflows.save_in_checkpoints(spark))
    kept = {(r["branch"], r["bin"]): r["keep"] for r in ref["mask"].where("chrom = 23").collect()}
    gone = [b for b in (3, 9, 15) if not kept["F", b]]
    assert gone and all(kept["M", b] for b in gone)
    assert {r["branch"]: r["compatible"] for r in cnv_reference.mask_compatibility(ref["mask"]).collect()} == {"F": True, "M": True}
    qc_rows = {r["branch"]: r for r in cnv_reference.reference_qc(ref["knn"], 5, mask=ref["mask"]).collect()}
    assert set(qc_rows) == {"A", "F", "M"} and all(r["compatible"] and r["ready"] for r in qc_rows.values())
    off = ref["mask"].withColumn("keep", F.col("keep") & ~((F.col("branch") == "M") & (F.col("chrom") == 2) & (F.col("bin") == 1)))
    assert {r["branch"]: r["ready"] for r in cnv_reference.reference_qc(ref["knn"], 5, mask=off).collect()} == {"A": True, "F": True, "M": False}


def test_branches_need_their_minimum_of_samples(spark):
    df, _ = cnv_cohort(spark, n=14, bins=6)
    few = df.where("sample_id % 2 = 0 or sample_id < 8")  # 7 females, 4 males
    ref = cnv_reference.newref(few, yfrac=0.005, refsize=5, components=1, save=workflows.save_in_checkpoints(spark))
    assert {r[0] for r in ref["bins"].select("branch").distinct().collect()} == {"A", "F"}
    with pytest.raises(ValueError, match="NIPT"):
        cnv_reference.newref(df.where("sample_id % 2 = 1 or sample_id < 7"), nipt=True, yfrac=0.005, refsize=5)
    nipt = cnv_reference.newref(few, nipt=True, yfrac=0.005, refsize=5, components=1, max_null=3, save=workflows.save_in_checkpoints(spark))
    assert {r[0] for r in nipt["bins"].select("branch").distinct().collect()} == {"A", "F"}


def test_samples_of_other_bin_sizes_are_summed(spark):
    df = spark.createDataFrame([("a", 1, b, 1 + b) for b in range(6)] + [("b", 1, b, 10) for b in range(3)], "sample_id string, chrom int, bin int, n long")
    sizes = spark.createDataFrame([("a", 5), ("b", 10)], "sample_id string, binsize int")
    got = sorted((r["sample_id"], r["bin"], r["n"]) for r in cnv_reference.rescale_to(df, sizes, 10).collect())
    assert got == [("a", 0, 3), ("a", 1, 7), ("a", 2, 11), ("b", 0, 10), ("b", 1, 10), ("b", 2, 10)]
    with pytest.raises(Exception, match="does not divide"):
        cnv_reference.rescale_to(df, sizes.withColumn("binsize", F.lit(4)), 10).collect()


def test_beta_calls_expect_one_copy_in_males(spark):
    seg = spark.createDataFrame([("m", 23, 0, 9, 0.25, 1.0, True), ("f", 23, 0, 9, 0.25, 1.0, False), ("f", 23, 9, 12, 0.45, 1.0, False), ("m", 5, 0, 9, 0.25, 1.0, True)], "sample_id string, chrom int, start int, end int, ratio double, zscore double, male boolean")
    got = sorted((r["sample_id"], r["chrom"], r["start"]) for r in cnv_predict.call_aberrations(seg, beta=0.5, male=F.col("male")).collect())
    # log2((1 + 0.25) / 1) = 0.32, log2((2 + 0.25) / 2) = 0.17: a male's X needs the larger step
    assert got == [("f", 23, 0), ("f", 23, 9), ("m", 5, 0)]


def test_males_are_called_at_one_copy_by_predict(spark):
    """The same ratio on X is a gain in a female and none in a male."""
    df, lengths = cnv_cohort(spark)
    cases, _ = cnv_cohort(spark, n=2)
    raised = F.when((F.col("chrom") == 23) & F.col("bin").between(6, 17), F.col("n") * 1.18).otherwise(F.col("n"))
    out = workflows.predict_cohort(df, lengths, 10, cases=cases.withColumn("n", raised.cast("long")), refsize=60, min_refs=10, yfrac=0.005, components=2, alpha=0.01, beta=0.5)
    calls = {(r["sample_id"], r["type"]) for r in out["aberrations"].where("chrom = 23").collect()}
    assert (0, "gain") in calls and (1, "gain") not in calls


def test_fasta_in_splits(spark, tmp_path):
    rng = np.random.default_rng(2)
    seqs = {str(c): "".join(rng.choice(list("ACGTNacgt"), 700)) for c in (1, 2, 3)}
    lines = [x for c, s in seqs.items() for x in (f">chr{c} of a file", *[s[i : i + 60] for i in range(0, 700, 60)])]
    (tmp_path / "g.fa").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("90", "333", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back = {}
            for r in tables.read_fasta(spark, str(tmp_path / "g.fa")).collect():
                back.setdefault(r["chrom"], {})[r["start"]] = r["seq"]
            assert {c: "".join(v for _, v in sorted(x.items())) for c, x in back.items()} == seqs
            assert all(at == sum(len(v) for k, v in x.items() if k < at) for x in back.values() for at in x)
            got = {(r["chrom"], r["bin"]): r["gc"] for r in gc.gc_from_bases(tables.read_fasta(spark, str(tmp_path / "g.fa")), 100).collect()}
            for c, s in seqs.items():
                for b in range(7):
                    part = s[100 * b : 100 * b + 100].upper()
                    assert abs(got[c, b] - sum(part.count(x) for x in "CG") / sum(part.count(x) for x in "ACGT")) < 1e-12
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fraction_reference_and_prediction(spark, tmp_path):
    df, _ = cnv_cohort(spark, n=16, bins=8)
    # Sample 3 has three copies of chromosome 21, sample 5 too many reads on X for its sex, sample 9 is not wanted.
    n = F.when((F.col("sample_id") == 3) & (F.col("chrom") == 21), F.col("n") * 1.5).when((F.col("sample_id") == 5) & (F.col("chrom") == 23), F.col("n") * 1.4).otherwise(F.col("n"))
    df = df.withColumn("n", n.cast("long"))
    gone = spark.createDataFrame([(9,)], "sample_id int")
    workflows.build_fraction_reference(df, str(tmp_path), exclude=gone, drop_sex_outliers=True, min_controls=5, ncv_sizes=(1, 2), sex_ncv_sizes=(1, 2), n_models=2, n_predictors=2)
    ref = workflows.load_fraction_reference(spark, str(tmp_path))
    why = {r["sample_id"]: r["decision"] for r in ref["membership"].collect()}
    assert why[9] == "excluded" and why[3] == "outlier" and why[5] == "outlier" and sum(v == "kept" for v in why.values()) >= 10
    assert {r["sample_id"] for r in ref["controls"].select("sample_id").distinct().collect()} == {k for k, v in why.items() if v == "kept"}
    cases = df.where("sample_id in (2, 3, 7)").withColumn("n", F.when(F.col("sample_id") == 7, 0).otherwise(F.col("n")))
    rows = {r["sample_id"]: r for r in workflows.predict_fractions(cases, ref)["summary"].collect()}
    assert (rows[2]["status"], rows[2]["predicted_sex"], rows[3]["predicted_sex"]) == ("ok", "female", "male")
    assert rows[3]["z_21"] > 10 and rows[3]["ncv_21"] > 10 and rows[3]["rbz_21"] > 5 and abs(rows[2]["z_21"]) < 5
    assert rows[7]["status"] == "no_reads" and rows[7]["z_21"] is None and rows[7]["predicted_sex"] is None


def test_preprocessing_marks_failures(spark, tmp_path):
    rows = [("a", 1, 10 * i, None, 0, 60, "+", 50, 1, "50M", "r") for i in range(30)] + [("b", 24, 5, None, 4, 60, "+", 50, 1, "50M", "r")]
    reads = spark.createDataFrame(rows, "sample_id string, chrom int, pos long, mate_pos long, flag int, mapq int, strand string, seq_len int, nm int, cigar string, name string").withColumn("mate_chrom", F.col("chrom"))
    lengths = spark.createDataFrame([(c, 400) for c in range(1, 25)], "chrom int, length long")
    table = spark.range(1, 25).select(F.col("id").cast("int").alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bin")).withColumn("gc", F.lit(0.4))
    out = workflows.preprocess_cohort(reads.where("flag = 0 or sample_id = 'b'"), lengths, table, str(tmp_path), 100, exclude_flags=4)
    got = {r["sample_id"]: r for r in out["sample_qc"].collect()}
    assert got["a"]["status"] == "success" and got["a"]["pre_sum"] == 30
    assert got["b"]["status"] == "failed" and "frac_1" in got["b"]["missing"]
    assert out["bins"].where("sample_id = 'a'").agg(F.sum("n")).first()[0] == 30


def test_reference_refusals(spark):
    df, lengths = cnv_cohort(spark, n=4, bins=3)
    with pytest.raises(ValueError):
        cnv_reference.newref(df, yfrac=0.005)
    with pytest.raises(ValueError):
        cnv_predict.predict(df, {}, df, df, 10, min_refs=300, refsize=100)
    with pytest.raises(Exception, match="no reads"):
        cnv_reference.y_fraction(df.withColumn("n", F.lit(0))).collect()


def test_pca_ratio_flattens_a_component(spark):
    rng = np.random.default_rng(5)
    load, score = rng.normal(0, 0.2, 40), rng.normal(0, 1, 12)
    x = 1 + np.outer(load, score) * 0.1
    df = spark.createDataFrame([(i, 1, i, [float(v) for v in x[i]]) for i in range(40)], "masked_idx long, chrom int, bin int, x array<double>")
    model, scores = cnv_reference.train_pca(df, 1)
    out = np.array([r["x"] for r in cnv_reference.pca_ratio(df, model, scores).collect()])
    assert np.abs(out - 1).max() < 1e-6


def test_sex_vote(spark):
    rng = np.random.default_rng(6)
    rows = [(f"f{i}", float(rng.uniform(0.03, 0.04)), float(rng.uniform(1e-4, 1e-3))) for i in range(15)] + [(f"m{i}", float(rng.uniform(0.015, 0.02)), float(rng.uniform(2e-3, 5e-3))) for i in range(15)]
    df = spark.createDataFrame(rows, "sample_id string, x_frac double, y_frac double")
    models = [sex.sex_model(df, "y_fraction"), sex.sex_model(df, "xy_fraction")]
    got = sex.predict_sex(df, models).collect()
    assert all(r["prediction"] == ("male" if r["sample_id"][0] == "m" else "female") for r in got)
    with pytest.raises(ValueError):
        sex.sex_model(df.limit(3), "y_fraction")


def test_bed_round_trip_and_refusals(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0, 5, 2.5), ("a", 1, 1, 0, None), ("a", 23, 0, 7, None)], "sample_id string, chrom int, bin int, n long, corrected double")
    sinks.write_bed(df, f"{tmp_path}/one", 100, ["n"], {"k": "v=w"})
    assert tables.infer_binsize(spark, f"{tmp_path}/one") == 100
    assert sorted((r["chrom"], r["bin"], r["n"]) for r in tables.bed_to_sample(spark, f"{tmp_path}/one").collect()) == [(1, 0, 5), (1, 1, 0), (23, 0, 7)]
    assert tables.tabix_metadata(spark, f"{tmp_path}/one").first()["value"] == "v=w"
    sinks.write_bed(df, f"{tmp_path}/mixed", 100, ["n", "corrected"])
    with pytest.raises(Exception, match="mixes"):
        tables.bed_to_fractions(spark, f"{tmp_path}/mixed", 100).collect()
    with pytest.raises(ValueError):
        sinks.metadata_lines({"a=b": "c"})
    with pytest.raises(ValueError):
        tables.bed_to_fractions(spark, f"{tmp_path}/one", 100)


def test_npz_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0, 5), ("a", 1, 3, 2), ("a", 24, 0, 7)], "sample_id string, chrom int, bin int, n long")
    sinks.write_npz(df, f"{tmp_path}/s.npz", 100)
    shape = sinks.npz_shape(f"{tmp_path}/s.npz")
    assert shape["binsize"] == 100 and shape["bins"]["1"] == 4 and shape["bins"]["2"] is None


def test_sam_to_bins(spark, tmp_path):
    names = [*map(str, range(1, 23)), "X", "Y"]
    lines = [f"@SQ\tSN:chr{n}\tLN:100000" for n in names] + [f"r{i}\t0\tchr{c}\t{p}\t60\t50M\t*\t0\t0\t{'A' * 50}\t*" for i, (c, p) in enumerate([(1, 100), (1, 60000), (2, 100)])]
    (tmp_path / "toy.sam").write_text("\n".join(lines) + "\n")
    out = workflows.convert_table(spark, f"{tmp_path}/toy.sam", f"{tmp_path}/out", 50000, order=["read_no"])
    assert out.count() == 48 and sorted((r["chrom"], r["bin"]) for r in out.where("n > 0").collect()) == [(1, 0), (1, 1), (2, 0)]


def test_sample_qc_status(spark):
    s = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    layer = spark.createDataFrame([("a", 10, 9), ("b", None, 3)], "sample_id string, sequences long, reads_mapped long")
    got = {r["sample_id"]: (r["status"], r["missing"]) for r in qc.sample_qc_rows(s, {"alignment": layer}).collect()}
    assert got == {"a": ("success", ""), "b": ("failed", "sequences")}


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").orderBy("ts").coalesce(1)
    events.write.parquet(f"{tmp_path}/e")
    src = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = stream.windowed_counts(src, "1 day", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("windows_out").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = stream.windowed_counts(events, "1 day")
    assert spark.table("windows_out").select("start", "event_type", "n").exceptAll(batch.select("start", "event_type", "n")).count() == 0
    assert spark.table("windows_out").count() == batch.count()


def test_command_line(spark, tmp_path):
    from binfold.__main__ import main

    names = [*map(str, range(1, 23)), "X", "Y"]
    lines = [f"@SQ\tSN:chr{n}\tLN:100000" for n in names] + [f"r1\t0\tchr1\t100\t60\t50M\t*\t0\t0\t{'A' * 50}\t*"]
    (tmp_path / "toy.sam").write_text("\n".join(lines) + "\n")
    main(["convert", f"{tmp_path}/toy.sam", f"{tmp_path}/bins", "--binsize", "50000"])
    assert spark.read.parquet(f"{tmp_path}/bins").count() == 48
    (tmp_path / "toy.fa").write_text(">21\nAACCNNNNGG\n")
    main(["gc", f"{tmp_path}/toy.fa", f"{tmp_path}/gc", "--binsize", "10"])
    assert abs(tables.read_gc_table(spark, f"{tmp_path}/gc").first()["gc"] - 4 / 6) < 1e-9
    with pytest.raises(SystemExit):
        main(["unknown"])


def test_reference_statistics_across_batches():
    """Rows of a pair of bins, cut anywhere: a target's rows may lie in several batches."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [(t, sorted(rng.choice(5, rng.integers(1, 6), replace=False).tolist())) for t in np.repeat(np.arange(9), rng.integers(1, 8, 9)).tolist()]
    rows = [(t, s, [float(rng.choice([-1, 0.1, 0.1, 2.0, 3.7])) for _ in s]) for t, s in rows]
    for size in (1, 4, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())))], ["target", "s", "v"]) for i in range(0, len(rows), size)]
        got = [r for b in cnv_predict._reference_stats(5)(iter(batches)) for r in b.to_pylist()]
        assert [r["target"] for r in got] == list(range(9))
        for r in got:
            for k in range(5):
                v = [x for t, s, vs in rows if t == r["target"] for n, x in zip(s, vs) if n == k and x >= 0]
                assert r["n"][k] == len(v)
                if v:
                    assert r["m"][k] == pytest.approx(np.mean(v)) and r["med"][k] == np.median(v) and r["sd"][k] == pytest.approx(np.std(v), abs=1e-12)
                    assert len(set(v)) > 1 or r["sd"][k] == 0 and r["m"][k] == v[0]


def test_within_sample_where_samples_lack_bins(spark):
    """Names of samples are text here, two of them lack bins, values may be null, and equal references give no finite z."""
    rows = [(s, i, 1, i, None if (s, i) == ("b", 1) else 2.0 + (i == 3) * k) for k, s in enumerate("abc") for i in range(4) if (s, i) not in (("a", 2), ("c", 1))]
    values = spark.createDataFrame(rows, "sample_id string, masked_idx long, chrom int, bin int, x double")
    knn = spark.createDataFrame([(3, [1, 2, 3], [0.1, 0.2, 0.3]), (0, [0, 4], [0.1, 9.0])], "masked_idx long, refs array<long>, distances array<double>")
    got = {(r["sample_id"], r["masked_idx"]): r for r in cnv_predict.normalise_within(values, knn, 1.0, 2).collect()}
    assert set(got) == {r[:2] for r in rows}
    assert [got[s, 3]["n_refs"] for s in "abc"] == [2, 2, 2] and all(r["n_refs"] == 0 and math.isnan(r["z"]) and r["r"] is None for k, r in got.items() if k[1] != 3)
    assert math.isnan(got["a", 3]["z"]) and got["b", 3]["z"] == got["c", 3]["z"] == math.inf and [got[s, 3]["r"] for s in "abc"] == [1.0, 1.5, 2.0]


def test_missing_members_joins_names_not_rows(spark):
    """The side that is looked up is broadcast or hashed: one row a name, however many reads it has."""
    present = spark.range(1000).select((F.col("id") % 7).cast("int").alias("sample_id"))
    out = cohort.missing_members(spark.range(9).select(F.col("id").cast("int").alias("sample_id")), present)
    assert sorted(r["sample_id"] for r in out.collect()) == [7, 8]
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_a_stream_are_dealt_from_many_tasks(spark, tmp_path):
    from binfold.plans.q_more import _deal

    rows = spark.range(300).repartition(4).select(F.col("id").alias("read_no"), F.lit(1).alias("sample_id"), F.lit(1).alias("chrom"), F.spark_partition_id().alias("task"))
    _deal(rows, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("read_no").distinct().count() == 300 and len(list((tmp_path / "out").glob("*.parquet"))) == 3
    assert got.select("task").distinct().count() == 4
