"""Queries that write files and read them back, metadata, sequences, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.functions.safe import safe_div
from binfold.operators import bins as B
from binfold.operators import gc
from binfold.operators import reads as R
from binfold.plans import data
from binfold.plans.data import BASE, GC_CTE, KEPT, ORDER, READS
from binfold.plans.q_relational import _STATS
from binfold.plans.registry import query
from binfold.plans.workflows import ensure_checkpoint_dir
from binfold.sources import sinks, tables
from binfold.streaming import counts as stream

W = f"WITH {READS}"


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the cluster's shared folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _chr(c: str):
    return F.expr(f"concat('chr', CASE {c} WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST({c} AS STRING) END)")


def _chr_sql(c: str = "chrom") -> str:
    return f"'chr' || CASE {c} WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST({c} AS VARCHAR) END"


def _write(lines: DataFrame, path: str) -> str:
    """One text file; ``lines`` has the order ``o`` and the line ``value``, some hundreds at most."""
    lines.coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)
    return path


@query("a02_sam_header", f"{W} SELECT chrom, CAST(max(pos) + 500 AS BIGINT) AS length FROM reads GROUP BY 1")
def a02(spark, d):
    """A header with the reach of the reads of every chromosome, a foreign sequence, and the reads themselves."""
    r = data.reads(spark, d)
    heads = r.groupBy("chrom").agg((F.max("pos") + 500).alias("n")).select(F.lit(1).alias("o"), F.concat(F.lit("@SQ\tSN:"), _chr("chrom"), F.lit("\tLN:"), F.col("n").cast("string")).alias("value"))
    other = spark.createDataFrame([(0, "@HD\tVN:1.6"), (2, "@SQ\tSN:chrM\tLN:16569")], "o int, value string")
    folder = _folder(spark, "sam")
    _write(heads.unionByName(other), folder)
    sam_lines(r).select("value").write.mode("append").text(folder)
    return tables.sam_lengths(spark, folder)


@query("a04_tabix_read", f"{BASE} SELECT CAST(sample_id AS VARCHAR) AS filename, CASE WHEN chrom = 23 THEN 'X' WHEN chrom = 24 THEN 'Y' ELSE CAST(chrom AS VARCHAR) END AS column0, CAST(bin * 50000 AS VARCHAR) AS column1, CAST(bin * 50000 + 50000 AS VARCHAR) AS column2, CAST(n AS VARCHAR) AS column3 FROM dense")
def a04(spark, d):
    """Files of all samples, with header lines that the reader skips."""
    path = _folder(spark, "bed")
    sinks.write_beds(data.dense(spark, d), path, 50000, ["n"], {"binsize": "50000"})
    return tables.read_tabix(spark, path, 4)


@query("a05_bed_to_sample", f"{BASE} SELECT sample_id, chrom, bin, CAST(n AS INT) AS n FROM dense")
def a05(spark, d):
    path = _folder(spark, "bed")
    sinks.write_beds(data.dense(spark, d), path, 50000, ["n"])
    return tables.bed_to_sample(spark, path, 50000).withColumn("sample_id", F.col("sample_id").cast("int"))


@query("a06_bed_to_fractions", f"{BASE} SELECT sample_id, chrom, bin, round(CASE WHEN chrom <= 22 AND sample_id % 3 <> 0 THEN n * 0.5 ELSE n END, 6) AS n FROM dense")
def a06(spark, d):
    """Two thirds of the samples have corrected counts."""
    path = _folder(spark, "bed")
    rows = data.dense(spark, d).withColumn("corrected", F.when((F.col("chrom") <= 22) & (F.col("sample_id") % 3 != 0), F.col("n") * 0.5))
    sinks.write_beds(rows, path, 50000, ["n", "corrected"], {"kind": "combined"})
    return tables.bed_to_fractions(spark, path, 50000).select(F.col("sample_id").cast("int").alias("sample_id"), "chrom", "bin", F.round("n", 6).alias("n"))


@query("a07_many_files", f"{BASE} SELECT sample_id % 2 AS part, sample_id, CAST(count(*) AS BIGINT) AS bins, CAST(sum(n) AS BIGINT) AS n FROM dense GROUP BY 1, 2")
def a07(spark, d):
    """Two folders of files, with the counts in different columns, as one table by name."""
    base, dense = _folder(spark, "beds"), data.dense(spark, d)
    sinks.write_beds(dense.where("sample_id % 2 = 0"), f"{base}/even", 50000, ["n"])
    sinks.write_beds(dense.where("sample_id % 2 = 1"), f"{base}/odd", 50000, ["n_fwd", "n"])
    even = tables.read_tabix(spark, f"{base}/even", 4).select("filename", F.col("column3").alias("n"), F.lit(0).alias("part"))
    odd = tables.read_tabix(spark, f"{base}/odd", 5).select(F.lit(1).alias("part"), "filename", F.col("column4").alias("n"))
    both = even.unionByName(odd).select("part", F.col("filename").cast("int").alias("sample_id"), F.expr("try_cast(n AS LONG)").alias("n"))
    return both.groupBy("part", "sample_id").agg(F.count("*").alias("bins"), F.sum("n").alias("n"))


@query("a08_control_group", f"{BASE} SELECT sample_id, chrom, bin, CAST(n AS DOUBLE) AS n, CAST(n_fwd AS DOUBLE) AS n_fwd FROM dense")
def a08(spark, d):
    """A folder of files is a control group; bins that a file lacks are 0."""
    path = _folder(spark, "bed")
    rows = data.dense(spark, d).where("n > 0 or bin % 7 <> 0").withColumn("na", F.lit(None).cast("double"))
    sinks.write_beds(rows, path, 50000, ["n", "n_fwd", "n_rev", "na", "na", "na"])
    return tables.control_group_from_beds(spark, [path], binsize=50000).select(F.col("sample_id").cast("int").alias("sample_id"), "chrom", "bin", "n", "n_fwd")


#: Letters of texts as bases, by place in the alphabet.
_BASES = ("abcdefghijklmnopqrstuvwxyz", "ACGTNACGTNACGTNACGTNACGTNA")
_SEQ = f"s AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{_BASES[0]}', '{_BASES[1]}') AS seq FROM documents)"
_PIECES = "p AS (SELECT doc_id, CAST(i AS INT) AS bin, substr(seq, CAST(i * 1000 + 1 AS BIGINT), 1000) AS piece FROM (SELECT doc_id, seq, unnest(range(0, (length(seq) + 999) // 1000)) AS i FROM s))"
_LETTERS = "length(regexp_replace(piece, '[^{0}]', '', 'g'))"


def fasta(spark: SparkSession, d: str, name) -> str:
    """The letters of every text as a sequence, its name line before it, lines of 70 letters."""
    seq = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), *_BASES)
    rows = spark.read.parquet(f"{d}/documents.parquet").select(name.alias("name"), seq.alias("seq")).where("seq <> ''")
    cut = F.regexp_extract_all("seq", F.lit(".{1,70}"), 0)  # one pass; a cut by places would count from the start for every line
    path = _folder(spark, "fasta")
    rows.select(F.explode(F.concat(F.array(F.concat(F.lit(">"), "name", F.lit(" letters"))), cut)).alias("value")).write.text(path)
    return path


@query("a09_fasta_gc", f"WITH {_SEQ}, {_PIECES} SELECT CAST(doc_id AS VARCHAR) AS chrom, bin, round(CAST({_LETTERS.format('CG')} AS DOUBLE) / nullif({_LETTERS.format('ACGT')}, 0), 9) AS gc FROM p")
def a09(spark, d):
    """All texts as sequences; GC of every thousand letters."""
    rows = tables.read_fasta(spark, fasta(spark, d, F.col("doc_id").cast("string")))
    return gc.gc_from_bases(rows, 1000).select("chrom", "bin", F.round("gc", 9).alias("gc"))


@query("a10_gc_table", f"{BASE} SELECT chrom, bin, round(CAST(sum(n_fwd) AS DOUBLE) / nullif(sum(n), 0), 9) AS gc FROM dense GROUP BY 1, 2")
def a10(spark, d):
    """A share per bin, here of forward reads, written as a table of fractions and read again; NA where there are none."""
    path = _folder(spark, "gc")
    share = data.dense(spark, d).groupBy("chrom", "bin").agg(safe_div(F.sum("n_fwd"), F.sum("n")).alias("gc"))
    sinks.write_bed(share.withColumn("len", F.lit(50000)), path, 50000, ["gc", "len"])
    return tables.read_gc_table(spark, path).select("chrom", "bin", F.round("gc", 9).alias("gc"))


def _metadata_files(spark: SparkSession, d: str) -> str:
    """A file a sample, with its number of reads, whether it is even, and a note that holds an equals sign."""
    n = data.reads(spark, d).groupBy("sample_id").agg(F.count("*").alias("n"))
    made = F.array(F.concat(F.lit("##RWX_reads="), F.col("n").cast("string")), F.concat(F.lit("##RWX_even="), F.when(F.col("n") % 2 == 0, "TRUE").otherwise("FALSE")), F.concat(F.lit("##RWX_note=n="), F.col("n").cast("string")), F.lit("1\t0\t50000\t3"))
    path = _folder(spark, "meta")
    n.select("sample_id", F.explode(made).alias("value")).repartition("sample_id").write.partitionBy("sample_id").text(path)
    return path


_META = f"{W}, m AS (SELECT CAST(sample_id AS VARCHAR) AS filename, count(*) AS n FROM reads GROUP BY 1)"


@query("a16_metadata", f"{_META} SELECT filename, 'reads' AS key, CAST(n AS VARCHAR) AS value FROM m UNION ALL SELECT filename, 'even', CASE WHEN n % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END FROM m UNION ALL SELECT filename, 'note', 'n=' || n FROM m")
def a16(spark, d):
    return tables.tabix_metadata(spark, _metadata_files(spark, d))


@query("a17_metadata_frame", f"{_META} SELECT filename, CAST(n AS DOUBLE) AS reads, n % 2 = 0 AS even, 'n=' || n AS note FROM m")
def a17(spark, d):
    frame = tables.metadata_frame(tables.tabix_metadata(spark, _metadata_files(spark, d)), ["reads", "even", "note"])
    return frame.select("filename", tables.coerce("reads")["number"].alias("reads"), tables.coerce("even")["logical"].alias("even"), tables.coerce("note")["text"].alias("note"))


@query("a18_metrics_table", f"{W} SELECT CAST(sample_id AS VARCHAR) AS sample, round(avg(mapq), 6) AS value FROM reads WHERE sample_id = 2 GROUP BY 1")
def a18(spark, d):
    """A table of all samples with semicolons, and the one row of a sample."""
    value = data.reads(spark, d).groupBy("sample_id").agg(F.round(F.avg("mapq"), 6).alias("v"))
    lines = value.select(F.lit(1).alias("o"), F.concat_ws(";", F.col("sample_id").cast("string"), F.col("v").cast("string")).alias("value"))
    path = _write(lines.unionByName(spark.createDataFrame([(0, "sample;value")], "o int, value string")), _folder(spark, "metrics"))
    return tables.unique_row(tables.read_metrics(spark, path), "sample", "2").select("sample", F.col("value").cast("double").alias("value"))


@query("a19_regions", f"{W} SELECT CAST(chrom AS VARCHAR) AS chrom, CAST(min(pos) AS INT) AS start, CAST(max(pos) AS INT) AS \"end\", 'S' || sample_id AS name FROM reads GROUP BY chrom, sample_id")
def a19(spark, d):
    """The reach of every sample on every chromosome as a regions file with a header."""
    reach = data.reads(spark, d).groupBy("chrom", "sample_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    lines = reach.select(F.lit(1).alias("o"), F.concat_ws("\t", _chr("chrom"), F.col("a").cast("string"), F.col("b").cast("string"), F.concat(F.lit("S"), F.col("sample_id").cast("string"))).alias("value"))
    head = spark.createDataFrame([(0, "Chromosome\tStart\tEnd\tGeneName")], "o int, value string")
    return tables.read_regions(spark, _write(lines.unionByName(head), _folder(spark, "regions")))


@query("a20_blacklist", f"{W} SELECT chrom, CAST(pos // 50000 * 50000 AS INT) AS start, CAST(pos // 50000 * 50000 + 50000 AS INT) AS \"end\" FROM reads WHERE mapq < 2 GROUP BY ALL")
def a20(spark, d):
    """Bins with reads of quality below 2 as a blacklist, between lines that a reader has to skip."""
    low = data.reads(spark, d).where("mapq < 2").select("chrom", F.floor(F.col("pos") / 50000).alias("b")).distinct()
    lines = low.select(F.lit(1).alias("o"), F.concat_ws("\t", _chr("chrom"), (F.col("b") * 50000).cast("string"), (F.col("b") * 50000 + 50000).cast("string")).alias("value"))
    strange = low.select(F.lit(2).alias("o"), F.explode(F.array(F.concat(F.lit("chrUn"), F.col("b").cast("string"), F.lit("\t1\t2")), F.concat(_chr("chrom"), F.lit("\t7")))).alias("value"))
    return tables.read_blacklist(spark, _write(lines.unionByName(strange), _folder(spark, "black")))


@query("a33_lists", f"{W} SELECT DISTINCT 's' || sample_id || '.bam' AS item FROM reads")
def a33(spark, d):
    """A list of the samples' files with a header, comments, blank lines and blanks around names."""
    names = data.reads(spark, d).select("sample_id").distinct()
    lines = names.select(F.lit(1).alias("o"), F.explode(F.array(F.concat(F.lit(" s"), F.col("sample_id").cast("string"), F.lit(".bam ")), F.concat(F.lit("# "), F.col("sample_id").cast("string")), F.lit(""))).alias("value"))
    head = spark.createDataFrame([(-1, "# made here"), (0, "BAM")], "o int, value string")
    return tables.read_list(spark, _write(lines.unionByName(head), _folder(spark, "list")))


def sam_lines(reads: DataFrame) -> DataFrame:
    """``sample_id, value``: reads as alignment text."""
    fields = [F.col("l_orderkey"), F.col("flag"), _chr("chrom"), F.col("pos") + 1, F.col("mapq"), F.col("cigar"), _chr("mate_chrom"), F.col("mate_pos") + 1, F.lit(0), F.when(F.col("seq_len") == 0, "*").otherwise(F.repeat(F.lit("A"), F.col("seq_len"))), F.lit("*"), F.concat(F.lit("NM:i:"), F.col("nm").cast("string"))]
    return reads.select("sample_id", F.concat_ws("\t", *[c.cast("string") for c in fields]).alias("value"))


def by_sample(lines: DataFrame) -> DataFrame:
    """Lines dealt by sample for writing; a large sample goes to several tasks and files, so no task sorts a whole one."""
    return lines.hint("rebalance", "sample_id")


@query("a13_sam_text_stats", f"{_STATS} SELECT * EXCLUDE (error_rate, duplicated_read_fraction, duplicated_base_fraction) FROM st")
def a13(spark, d):
    """All reads as alignment text, a folder a sample, read back and counted."""
    folder = _folder(spark, "sam")
    by_sample(sam_lines(data.reads(spark, d))).write.partitionBy("sample_id").text(folder)
    s = R.alignment_stats(tables.read_sam(spark, folder, sample=F.regexp_extract("_metadata.file_path", r"sample_id=(\d+)/", 1).cast("int")), mapq=5, exclude_flags=512)
    return s.drop("error_rate", "duplicated_read_fraction", "duplicated_base_fraction")


@query("a28_prediction_text", f"{BASE} SELECT sample_id, CASE WHEN chrom = 23 THEN 'X' WHEN chrom = 24 THEN 'Y' ELSE CAST(chrom AS VARCHAR) END AS chr, CAST(bin * 50000 + 1 AS BIGINT) AS start, CAST(bin * 50000 + 50000 AS BIGINT) AS \"end\", CASE WHEN n = 5 THEN 'nan' ELSE CAST(n - 5 AS VARCHAR) END AS ratio FROM dense")
def a28(spark, d):
    rows = data.dense(spark, d).select("sample_id", "chrom", "bin", (F.col("n") - 5).cast("double").alias("r"), F.lit(0.0).alias("z"))
    none = spark.createDataFrame([], "sample_id int, chrom int, start int, end int, ratio double, zscore double, type string")
    chrom = spark.createDataFrame([], "sample_id int, chrom int, ratio_mean double, ratio_median double, zscore double")
    t = sinks.prediction_tables({"bins": rows, "segments": none.drop("type"), "aberrations": none, "chromosomes": chrom}, 50000)
    return t["bins"].select("sample_id", "chr", "start", "end", "ratio")


#: The SN lines in their order, for the SQL text.
_SN = [("raw total sequences", "raw_total_sequences"), ("filtered sequences", "filtered_sequences"), ("sequences", "sequences"), ("1st fragments", "first_fragments"), ("last fragments", "last_fragments"), ("reads mapped", "reads_mapped"), ("reads mapped and paired", "reads_mapped_and_paired"), ("reads unmapped", "reads_unmapped"), ("reads properly paired", "reads_properly_paired"), ("reads paired", "reads_paired"), ("reads duplicated", "reads_duplicated"), ("reads MQ0", "reads_mq0"), ("reads QC failed", "reads_qc_failed"), ("non-primary alignments", "non_primary_alignments"), ("supplementary alignments", "supplementary_alignments"), ("pairs on different chromosomes", "pairs_on_different_chromosomes"), ("total length", "total_length"), ("total first fragment length", "total_first_fragment_length"), ("total last fragment length", "total_last_fragment_length"), ("bases mapped", "bases_mapped"), ("bases mapped (cigar)", "bases_mapped_cigar"), ("bases duplicated", "bases_duplicated"), ("mismatches", "mismatches_from_nm")]
_SN_SQL = " UNION ALL ".join(f"SELECT sample_id, {i} AS i, 'SN' || chr(9) || '{label}:' || chr(9) || CAST({c} AS VARCHAR) AS line FROM st" for i, (label, c) in enumerate(_SN))


@query("a30_stats_text", f"{_STATS} {_SN_SQL} UNION ALL SELECT sample_id, 23, 'SN' || chr(9) || 'error rate:' || chr(9) || format('{{:e}}', error_rate) FROM st")
def a30(spark, d):
    """All 24 lines of every sample."""
    return sinks.stats_lines(R.alignment_stats(data.reads(spark, d), mapq=5, exclude_flags=512))


@query("g07_metadata_union", f"{W}, s AS (SELECT sample_id, count(*) AS n, min(mapq) AS q, max(pos) AS p FROM reads GROUP BY 1) SELECT sample_id, 'a' AS key, CAST(n AS VARCHAR) AS value FROM s UNION ALL SELECT sample_id, 'b', CAST(q AS VARCHAR) FROM s UNION ALL SELECT sample_id, 'c', CAST(p AS VARCHAR) FROM s")
def g07(spark, d):
    """Two maps a sample that share a key; the base map's value stays."""
    s = data.reads(spark, d).groupBy("sample_id").agg(F.count("*").cast("string").alias("n"), F.min("mapq").cast("string").alias("q"), F.max("pos").cast("string").alias("p"))
    base, extra = F.create_map(F.lit("a"), "n", F.lit("b"), "q"), F.create_map(F.lit("b"), F.lit("other"), F.lit("c"), "p")
    return s.select("sample_id", F.explode(tables.merge_metadata(base, extra)).alias("key", "value"))


@query("a25_strand_bed", f"{BASE} SELECT sample_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(n_fwd) AS BIGINT) AS fwd, CAST(sum(n_rev) AS BIGINT) AS rev, max(CAST(least(bin * 50000 + 50000, 980000) AS BIGINT)) AS last_end FROM dense GROUP BY 1")
def a25(spark, d):
    """Nine columns, ends clipped to the chromosome."""
    path = _folder(spark, "bed")
    rows = data.dense(spark, d).withColumn("na", F.lit(None).cast("double"))
    sinks.write_beds(rows, path, 50000, ["n", "n_fwd", "n_rev", "na", "na", "na"], lengths=data.lengths(spark).withColumn("length", F.lit(980000)))
    back = tables.read_tabix(spark, path, 9)
    whole = lambda i: F.expr(f"try_cast(column{i} AS LONG)")
    return back.groupBy(F.col("filename").cast("int").alias("sample_id")).agg(F.count("*").alias("lines"), F.sum(whole(4)).alias("fwd"), F.sum(whole(5)).alias("rev"), F.max(whole(2)).alias("last_end"))


@query("a26_metadata_body", f"{BASE} SELECT sample_id, k.key, CASE k.key WHEN 'binsize' THEN '50000' ELSE 'a=b' END AS value, lines FROM (SELECT sample_id, CAST(count(*) AS BIGINT) AS lines FROM dense GROUP BY 1) CROSS JOIN (VALUES ('binsize'), ('note')) AS k(key)")
def a26(spark, d):
    """Header lines before the body of every sample's file: both are found again, each by its own reader."""
    path = _folder(spark, "bed")
    sinks.write_beds(data.dense(spark, d), path, 50000, ["n"], {"binsize": "50000", "note": "a=b"})
    lines = tables.read_tabix(spark, path, 4).groupBy("filename").agg(F.count("*").alias("lines"))
    return tables.tabix_metadata(spark, path).join(lines, "filename").select(F.col("filename").cast("int").alias("sample_id"), "key", "value", "lines")


# --- streaming -------------------------------------------------------------------------------------------------------


@query("i01_batch_dedup", f"{W}, {KEPT} SELECT sample_id, count(*) AS n FROM kept GROUP BY 1")
def i01(spark, d):
    return R.streaming_dedup(data.reads(spark, d), ORDER).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("i04_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def i04(spark, d):
    out = stream.windowed_counts(spark.read.parquet(f"{d}/events.parquet"))
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("i04b_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def i04b(spark, d):
    return stream.session_counts(spark.read.parquet(f"{d}/events.parquet")).select("user_id", "start", "n")


def _stream(spark: SparkSession, path: str, build) -> DataFrame:
    """Run a stream over a folder to its end and return what it holds; the sink is a table in the shared folder."""
    out = _folder(spark, "stream")
    frame = spark.read.parquet(path)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{epoch}")

    src = spark.readStream.schema(frame.schema).parquet(path)
    q = build(src).writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress) if q.recentProgress else 0
    while last >= 0:
        try:
            return spark.read.parquet(f"{out}/{last}")
        except Exception:  # an epoch without rows leaves no table
            last -= 1
    return build(frame).limit(0)


@query("i02_stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def i02(spark, d):
    folder = _folder(spark, "events")
    spark.read.parquet(f"{d}/events.parquet").write.parquet(folder)
    return _stream(spark, folder, lambda s: s.groupBy("event_type").agg(F.count("*").alias("n")))


@query("i02b_stream_bins", f"{W} SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n FROM reads GROUP BY 1, 2, 3")
def i02b(spark, d):
    folder = _folder(spark, "reads")
    data.reads(spark, d).select("sample_id", "chrom", "pos").write.parquet(folder)
    return _stream(spark, folder, lambda s: stream.incremental_bin_counts(s, 50000))


@query("a22_dense_export", f"{W}, c AS (SELECT sample_id, chrom, CAST(pos // 50000 AS INT) AS bin, count(*) AS n FROM reads WHERE mapq >= 1 GROUP BY 1, 2, 3) SELECT s.sample_id, CAST(ch.range AS INT) AS chrom, CAST(count(*) AS BIGINT) AS bins, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT sample_id FROM reads WHERE mapq >= 1) AS s CROSS JOIN range(1, 25) AS ch CROSS JOIN range(0, 21) AS b LEFT JOIN c ON c.sample_id = s.sample_id AND c.chrom = ch.range AND c.bin = b.range GROUP BY 1, 2")
def a22(spark, d):
    """The grid of array exports: one bin more where the length is a multiple of the bin size."""
    c = data.counts(spark, d).select("sample_id", "chrom", "bin", "n")
    g = B.grid(c, data.lengths(spark), 50000, extra_bin=True)
    return g.join(c, B.KEYS, "left").groupBy("sample_id", "chrom").agg(F.count("*").alias("bins"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
