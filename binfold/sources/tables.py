"""Readers of tab-separated interval files, headers, sequences and lists; every one takes a path or several.

Text stays text until it is cast with ``try_cast``, so ``NA`` becomes NULL. Files ending in ``.gz`` may have several
compressed members; ``.bgz`` is read by naming the gzip codec.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.functions.safe import chrom_key

META = "##RWX_"
BED4 = ["chrom", "start", "end", "count"]
BED5 = [*BED4, "corrected_count"]
BED9 = ["chrom", "start", "end", "count", "count_fwd", "count_rev", "corrected_count", "corrected_fwd", "corrected_rev"]


def _text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", "_metadata")


def read_tabix(spark: SparkSession, path: str | list[str], columns: int) -> DataFrame:
    """All columns as text, ``column0`` on, and ``filename``; comment lines are skipped; short rows give NULL.

    Below a folder ``sample_id=<sample>`` the sample stands for the name of the file.
    """
    lines = _text(spark, path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    cells = F.split("value", "\t")
    return lines.select(*[F.get(cells, F.lit(i)).alias(f"column{i}") for i in range(columns)], _file_name())


def _file_name() -> Column:
    folder = F.regexp_extract("_metadata.file_path", r"/sample_id=([^/]+)/[^/]+$", 1)
    return F.when(folder != "", folder).otherwise(F.col("_metadata.file_name")).alias("filename")


def sample_name(filename: Column | str) -> Column:
    """File stem without the extensions of interval files."""
    return F.regexp_replace(F.col(filename) if isinstance(filename, str) else filename, r"(\.bed)?(\.b?gz)?$", "")


def _int(i: int) -> Column:
    return F.expr(f"try_cast(column{i} AS INT)")


def _double(i: int) -> Column:
    return F.expr(f"try_cast(column{i} AS DOUBLE)")


def infer_binsize(spark: SparkSession, path: str) -> int:
    """``end - start`` of the first row."""
    row = read_tabix(spark, path, 3).select((_int(2) - _int(1)).alias("b")).limit(1).collect()
    if not row or not row[0]["b"] or row[0]["b"] <= 0:
        raise ValueError("no bin size in the file")
    return row[0]["b"]


def column_count(spark: SparkSession, path: str) -> int:
    """Columns of the first row that is not a comment."""
    row = _text(spark, path).where(~F.col("value").startswith("#")).select(F.size(F.split("value", "\t")).alias("n")).limit(1).collect()
    return row[0]["n"] if row else 0


def bed_to_sample(spark: SparkSession, path: str | list[str], binsize: int | None = None) -> DataFrame:
    """``sample_id, chrom, bin, n`` of 4-column files; further columns are ignored, bins follow from positions."""
    size = binsize or infer_binsize(spark, path[0] if isinstance(path, list) else path)
    key = chrom_key("column0")
    rows = read_tabix(spark, path, 4).where(key.isin([str(i) for i in range(1, 25)]))
    return rows.select(sample_name("filename").alias("sample_id"), key.cast("int").alias("chrom"), F.floor(_int(1) / size).cast("int").alias("bin"), F.coalesce(_int(3), F.lit(0)).alias("n"))


def bed_to_fractions(spark: SparkSession, path: str | list[str], binsize: int | None = None, autosomal: str = "auto", sex: str = "match") -> DataFrame:
    """``sample_id, chrom, bin, n`` (and ``n_fwd, n_rev``) of 5- or 9-column files, raw or corrected.

    ``auto`` takes the corrected column where the file has one. A sample whose corrected column mixes values and NA on
    autosomes is an error. ``match`` treats X and Y like autosomes.
    """
    if autosomal not in ("auto", "raw", "corrected") or sex not in ("match", "raw", "corrected"):
        raise ValueError("unknown count source")
    one = path[0] if isinstance(path, list) else path
    size, width = binsize or infer_binsize(spark, one), column_count(spark, one)
    if width not in (5, 9):
        raise ValueError(f"expected 5 or 9 columns, found {width}")
    key = chrom_key("column0")
    raw, cor = ([3], [4]) if width == 5 else ([3, 4, 5], [6, 7, 8])
    names = ["n"] if width == 5 else ["n", "n_fwd", "n_rev"]
    rows = read_tabix(spark, path, width).where(key.isin([str(i) for i in range(1, 25)]))
    rows = rows.select(sample_name("filename").alias("sample_id"), key.cast("int").alias("chrom"), F.floor(_int(1) / size).cast("int").alias("bin"), *[_double(i).alias(f"raw_{n}") for i, n in zip(raw, names)], *[_double(i).alias(f"cor_{n}") for i, n in zip(cor, names)])
    has = rows.groupBy("sample_id").agg(*[F.count_if((F.col("chrom") <= 22) & F.col(f"cor_{n}").isNotNull()).alias(f"v_{n}") for n in names], F.count_if(F.col("chrom") <= 22).alias("autosomal"))
    mixed = F.lit(False)
    for n in names:
        mixed = mixed | ((F.col(f"v_{n}") > 0) & (F.col(f"v_{n}") < F.col("autosomal")))
    has = has.select("sample_id", F.when(mixed, F.raise_error(F.lit("a corrected column mixes values and NA")).cast("boolean")).otherwise(F.col("v_n") > 0).alias("corrected"))
    rows = rows.join(has, "sample_id")
    auto = {"auto": F.col("corrected"), "raw": F.lit(False), "corrected": F.when(F.col("corrected"), True).otherwise(F.raise_error(F.lit("no corrected counts")).cast("boolean"))}[autosomal]
    gono = auto if sex == "match" else F.lit(sex == "corrected")
    use = F.when(F.col("chrom") <= 22, auto).otherwise(gono)
    return rows.select("sample_id", "chrom", "bin", *[F.when(use, F.coalesce(F.col(f"cor_{n}"), F.when(F.col("chrom") >= 23, F.col(f"raw_{n}")))).otherwise(F.col(f"raw_{n}")).alias(n) for n in names])


def control_group_from_beds(spark: SparkSession, paths: list[str], **kw) -> DataFrame:
    """Several files as one table, padded to the largest bin of each chromosome in the group."""
    rows = bed_to_fractions(spark, paths, **kw)
    top = rows.groupBy("chrom").agg(F.max("bin").alias("top")).select("chrom", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bin"))
    genome = top.groupBy("chrom").agg(F.collect_list("bin").alias("bins")).agg(F.collect_list(F.struct("chrom", "bins")).alias("g"))
    cells = rows.select("sample_id").distinct().join(F.broadcast(genome)).select("sample_id", F.explode("g").alias("g")).select("sample_id", "g.chrom", F.explode("g.bins").alias("bin"))
    return cells.join(rows, ["sample_id", "chrom", "bin"], "left").fillna(0)


def tabix_metadata(spark: SparkSession, path: str | list[str], prefix: str = META) -> DataFrame:
    """``filename, key, value`` of header lines ``##RWX_key=value``; a key that repeats in a file is an error."""
    lines = _text(spark, path).where(F.col("value").startswith(prefix)).select(_file_name(), F.substr("value", F.lit(len(prefix) + 1)).alias("kv"))
    pair = F.split("kv", "=", 2)
    rows = lines.where(F.instr("kv", F.lit("=")) > 1).select("filename", F.get(pair, F.lit(0)).alias("key"), F.get(pair, F.lit(1)).alias("value"))
    return rows.groupBy("filename", "key").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("a metadata key repeats"))).otherwise(F.first("value")).alias("value"))


def metadata_frame(meta: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file and a column per key."""
    return meta.groupBy("filename").pivot("key", keys).agg(F.first("value"))


def coerce(value: Column | str) -> Column:
    """Logical, number or text of a header value: ``struct<logical, number, text>`` with one of them set."""
    v = F.trim(F.col(value) if isinstance(value, str) else value)
    logical = F.when(F.upper(v).isin("TRUE", "T"), True).when(F.upper(v).isin("FALSE", "F"), False)
    number = F.when(logical.isNull(), v.try_cast("double"))
    return F.struct(logical.alias("logical"), number.alias("number"), F.when(logical.isNull() & number.isNull() & (v != "NA") & (v != ""), v).alias("text"))


def merge_metadata(base: Column, extra: Column) -> Column:
    """Union of two maps; on equal keys the base wins."""
    return F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(base, k)), base)


def read_gc_table(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, bin, gc`` of ``chrom, start, end, pct_gc, seq_len``; NA is NULL."""
    key = chrom_key("column0")
    rows = read_tabix(spark, path, 5).where(key.isin([str(i) for i in range(1, 25)]))
    return rows.select(key.cast("int").alias("chrom"), F.floor(_int(1) / (_int(2) - _int(1))).cast("int").alias("bin"), _double(3).alias("gc"))


def _along_splits(rows: bool):
    """Names and offsets of FASTA lines ``f, split, head, seq, len`` in file order: a row per sequence line, or one per split.

    A line's name and offset are those since the last name line of its split; without one, ``name`` is NULL. What goes
    on from batch to batch is the split at hand, its last name and the length since then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, length = None, None, 0

        def tail() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([name], pa.string()), pa.array([length], pa.int64())], ["f", "split", "name", "len"])

        for b in batches:
            if not b.num_rows:
                continue
            split, size = b.column(1).to_numpy(), b.column(4).to_numpy().astype(np.int64)
            named, file = ~b.column(2).is_null().to_numpy(zero_copy_only=False), b.column(0).dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                here = (b.column(0)[lo].as_py(), int(split[lo]))
                if here != key:
                    if key and not rows:
                        yield tail()
                    key, name, length = here, None, 0
                heads, sums = np.flatnonzero(named[lo:hi]), np.cumsum(size[lo:hi])
                # The row of the last name line up to each row; -1 stands for what was carried here.
                last = np.full(hi - lo, -1)
                last[heads] = heads
                last = np.maximum.accumulate(last)
                since = np.where(last < 0, -length, sums[last])
                if rows:
                    body = np.flatnonzero(~named[lo:hi])
                    names = pa.concat_arrays([pa.array([name], pa.string()), b.column(2).slice(lo, hi - lo).cast(pa.string())]).take(pa.array(last[body] + 1))
                    at = (sums - size[lo:hi] - since)[body]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + body)), pa.array(split[lo:hi][body]), names, pa.array(at), b.column(3).take(pa.array(lo + body))], ["f", "split", "name", "at", "seq"])
                name, length = b.column(2)[lo + int(last[-1])].as_py() if last[-1] >= 0 else name, int(sums[-1] - since[-1])
        if key and not rows:
            yield tail()

    return run


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, seq`` per sequence line.

    A file is read in splits. Names and offsets are running values inside a split, kept by the task that reads it, so
    lines are neither shuffled nor sorted; what the splits before it left open reaches a split as one row of a table
    that has a row per split.
    """
    from pyspark.sql import Window

    raw = _text(spark, path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("split"), F.trim("value").alias("v")).where("v <> ''")
    head = F.col("v").startswith(">")
    lines = raw.select("f", "split", F.when(head, F.regexp_extract("v", r"^>(\S+)", 1)).alias("head"), F.when(~head, F.col("v")).alias("seq"), F.when(head, 0).otherwise(F.length("v")).cast("long").alias("len"))
    # What a split leaves open: its last name, and the length since then (or all of it, without a name).
    tails = lines.withColumn("seq", F.lit(None).cast("string")).mapInArrow(_along_splits(False), "f string, split long, name string, len long")
    files = Window.partitionBy("f").orderBy("split")
    tails = tails.withColumn("open", F.last("name", True).over(files)).withColumn("run", F.sum(F.col("name").isNotNull().cast("int")).over(files))
    tails = tails.withColumn("so_far", F.sum("len").over(Window.partitionBy("f", "run").orderBy("split")))
    tails = tails.select("f", "split", F.lag("open").over(files).alias("before"), F.coalesce(F.lag("so_far").over(files), F.lit(0)).alias("carried"))
    body = lines.mapInArrow(_along_splits(True), "f string, split long, name string, at long, seq string").join(F.broadcast(tails), ["f", "split"])
    first = F.col("name").isNull()
    return body.select(chrom_key(F.coalesce("name", "before")).alias("chrom"), (F.col("at") + F.when(first, F.col("carried")).otherwise(0)).alias("start"), "seq")


def sample_of_file(ending: str) -> Column:
    """Sample of a line's file: the folder ``sample_id=<sample>`` it lies in, else its name without ``ending`` (a pattern)."""
    folder = F.regexp_extract("_metadata.file_path", r"/sample_id=([^/]+)/[^/]+$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_replace("_metadata.file_name", ending, ""))


def scan_sam(spark: SparkSession, path: str | list[str], sample: Column | None = None) -> DataFrame:
    """Alignment text as reads, malformed lines included: the columns of ``read_sam`` and ``problem``.

    ``problem`` says what is wrong with a line, NULL where nothing is; no line is dropped and none raises.
    """
    lines = _text(spark, path).where(~F.col("value").startswith("@") & (F.length("value") > 0)).select(F.monotonically_increasing_id().alias("read_no"), (F.regexp_replace("_metadata.file_name", r"\.sam(\.gz)?$", "") if sample is None else sample).alias("sample_id"), "value", F.split("value", "\t").alias("c"))
    c = lambda i: F.get("c", F.lit(i))
    number = lambda i, kind="int": c(i).try_cast(kind)
    outside = lambda i, most: number(i).isNull() | ~number(i).between(0, most)
    flag = number(1)
    mate = F.when(c(6) == "=", c(2)).otherwise(c(6))
    problem = (
        F.when(F.size("c") < 11, "fewer than 11 columns").when(outside(1, 65535), "flag is no number of 16 bits").when(F.length(c(2)) == 0, "no reference name")
        .when(F.coalesce(number(3, "long"), F.lit(-1)) < 0, "position is no number").when(outside(4, 255), "mapping quality is no number of 8 bits")
        .when(~c(5).rlike(r"^(\*|([0-9]+[MIDNSHP=X])+)$"), "CIGAR is malformed").when(F.coalesce(number(7, "long"), F.lit(-1)) < 0, "mate position is no number").when(F.length(c(9)) == 0, "no sequence")
    )
    return lines.select(
        "sample_id", "read_no", flag.alias("flag"), chrom_key(c(2)).alias("chrom"), (number(3, "long") - 1).alias("pos"), number(4).alias("mapq"), c(5).alias("cigar"),
        chrom_key(mate).alias("mate_chrom"), (number(7, "long") - 1).alias("mate_pos"), F.when(c(9) == "*", 0).otherwise(F.length(c(9))).alias("seq_len"),
        F.coalesce(F.regexp_extract("value", r"\tNM:i:(\d+)", 1).try_cast("int"), F.lit(0)).alias("nm"), F.when(flag.bitwiseAND(16) == 0, "+").otherwise("-").alias("strand"), problem.alias("problem"),
    )


def read_sam(spark: SparkSession, path: str | list[str], sample: Column | None = None) -> DataFrame:
    """Alignment text as reads: ``sample_id, read_no, flag, chrom, pos, mapq, cigar, mate_chrom, mate_pos, seq_len, nm, strand``; positions from 0.

    A file is a sample named after it, unless ``sample`` says otherwise (it may use ``_metadata``). A malformed line is
    an error that names it; ``scan_sam`` goes on instead.
    """
    found = scan_sam(spark, path, sample)
    message = F.concat(F.lit("malformed alignment line of sample "), F.col("sample_id").cast("string"), F.lit(": "), F.col("problem"))
    # The running number keeps the filter above the columns; pushed below them it would split a line anew for every check.
    return found.where(F.when(F.col("problem").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.col("read_no") >= 0)).drop("problem")


def sam_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, length`` from @SQ header lines, keys 1 to 24."""
    head = _text(spark, path).where(F.col("value").startswith("@SQ"))
    rows = head.select(chrom_key(F.regexp_extract("value", r"\tSN:([^\t]+)", 1)).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    return rows.where(F.col("chrom").isin([str(i) for i in range(1, 25)])).select(F.col("chrom").cast("int").alias("chrom"), "length")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, end, name`` with or without a header line (a line whose start is no number is one)."""
    rows = read_tabix(spark, path, 4).where(_int(1).isNotNull() & _int(2).isNotNull())
    return rows.select(chrom_key("column0").alias("chrom"), _int(1).alias("start"), _int(2).alias("end"), F.col("column3").alias("name"))


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, end``; lines with fewer fields or unknown chromosomes are skipped."""
    return read_regions(spark, path).where(F.col("chrom").isin([str(i) for i in range(1, 25)])).select(F.col("chrom").cast("int").alias("chrom"), "start", "end")


def read_depth_summary(spark: SparkSession, path: str) -> DataFrame:
    """The total row of a depth summary: ``total_region`` if present, else ``total``."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    out = rows.where(F.col("chrom").isin("total_region", "total")).orderBy((F.col("chrom") != "total_region")).limit(1)
    return out.select("chrom", *[F.col(c).try_cast("double").alias(c) for c in ("length", "bases", "mean", "min", "max")])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header; comma, tab or semicolon, whichever is commonest in the first line."""
    first = _text(spark, path).limit(1).collect()
    line = first[0]["value"] if first else ""
    sep = max("\t,;", key=line.count)
    return spark.read.option("sep", sep).option("header", True).csv(path)


def unique_row(rows: DataFrame, column: str, value: str) -> DataFrame:
    """The one row with a value; none or several are an error."""
    out = rows.where(F.col(column) == value)
    n = out.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} row with {column} = {value}")
    return out


def read_list(spark: SparkSession, path: str, header: str = "bam") -> DataFrame:
    """Items of a list file: without blank lines and comments, and without the first item if it is the header.

    Only the first item of a file can be a header; an item further down may read like one.
    """
    lines = _text(spark, path).select(F.trim("value").alias("item"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).where((F.col("item") != "") & ~F.col("item").startswith("#"))
    first = lines.groupBy(F.col("f").alias("f1")).agg(F.min("i").alias("i1"))
    head = lines.where(F.lower("item") == header).join(first, (F.col("f") == F.col("f1")) & (F.col("i") == F.col("i1"))).select("i")
    return lines.join(head, "i", "left_anti").select("item")


def read_seqff_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tabix(spark, path, 2)
    return rows.select(F.col("column0").alias("bin_name"), F.expr("try_cast(column1 AS LONG)").alias("n")).where("n is not null")


def sra_runinfo_url(accession: str) -> str:
    """Address of the public run table of a study or run."""
    from urllib.parse import quote

    if not accession:
        raise ValueError("an accession is needed")
    return f"https://trace.ncbi.nlm.nih.gov/Traces/sra-db-be/runinfo?acc={quote(accession, safe='')}"


def read_sra_runinfo(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).dropna("all")
