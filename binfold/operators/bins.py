"""Dense bin grids, rescaling, totals and fractions.

Bins: ``sample_id, chrom, bin`` and counts. Chromosomes are whole numbers, 23 and 24 standing for X and Y.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from binfold.functions.kernels import unrank_sets
from binfold.functions.safe import is_finite, safe_div

KEYS = ["sample_id", "chrom", "bin"]


def grid(samples: DataFrame, lengths: DataFrame, binsize: int, extra_bin: bool = False) -> DataFrame:
    """Every bin of every chromosome for every sample: ``ceil(length / binsize)`` of them.

    ``extra_bin`` gives ``int(length / binsize) + 1`` instead, as array exports expect. The product is the size of
    the dense result itself; chromosomes are the small side.
    """
    n = F.floor(F.col("length") / binsize) + 1 if extra_bin else F.ceil(F.col("length") / binsize)
    per_chrom = lengths.where("length > 0").select("chrom", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("bin"))
    cells = per_chrom.groupBy("chrom").agg(F.collect_list("bin").alias("bins"))
    genome = cells.agg(F.collect_list(F.struct("chrom", "bins")).alias("genome"))
    # The genome is one row (as long as the genome has bins), so each sample row is simply expanded.
    rows = samples.select("sample_id").distinct().join(F.broadcast(genome)).select("sample_id", F.explode("genome").alias("g"))
    return rows.select("sample_id", "g.chrom", F.explode("g.bins").alias("bin"))


def densify(counts: DataFrame, lengths: DataFrame, binsize: int, samples: DataFrame | None = None) -> DataFrame:
    """Sparse counts on the dense grid, absent bins 0."""
    values = [c for c in counts.columns if c not in KEYS]
    return grid(samples if samples is not None else counts, lengths, binsize).join(counts, KEYS, "left").fillna(0, values)


def coordinates(bins: DataFrame, binsize: int, lengths: DataFrame | None = None) -> DataFrame:
    """``start`` and ``end`` of each bin; with lengths, the end is clipped to the chromosome."""
    out = bins.withColumn("start", (F.col("bin") * binsize).cast("long")).withColumn("end", (F.col("bin") * binsize + binsize).cast("long"))
    if lengths is None:
        return out
    return out.join(lengths.select("chrom", F.col("length").alias("_len")), "chrom", "left").withColumn("end", F.coalesce(F.least("end", "_len"), F.col("end"))).drop("_len")


def rescale(bins: DataFrame, from_size: int, to_size: int, values: list[str] | None = None) -> DataFrame:
    """Sum neighbouring bins; the last group may be short. The new size must be a multiple of the old one."""
    if to_size % from_size:
        raise ValueError("to_size must be a multiple of from_size")
    values = values or [c for c in bins.columns if c not in KEYS]
    return bins.groupBy("sample_id", "chrom", F.floor(F.col("bin") / (to_size // from_size)).cast("int").alias("bin")).agg(*[F.sum(v).alias(v) for v in values])


def chromosome_totals(bins: DataFrame, value: str = "n") -> DataFrame:
    return bins.groupBy("sample_id", "chrom").agg(F.sum(value).alias("reads"))


def fractions(totals: DataFrame, over: Column | None = None) -> DataFrame:
    """``frac``: chromosome reads over the sample's reads on chromosomes that ``over`` selects (default 1 to 22); 0 if none."""
    over = over if over is not None else F.col("chrom") <= 22
    w = Window.partitionBy("sample_id")
    return totals.withColumn("frac", F.coalesce(safe_div("reads", F.sum(F.when(over, F.col("reads"))).over(w)), F.lit(0.0)))


def strand_fractions(bins: DataFrame, mode: str = "sample") -> DataFrame:
    """Fractions of separated strands: ``sample`` normalises each strand and halves, ``group`` divides by both strands."""
    t = bins.where("chrom <= 22").groupBy("sample_id", "chrom").agg(F.sum("n_fwd").alias("f"), F.sum("n_rev").alias("r"))
    w = Window.partitionBy("sample_id")
    if mode == "group":
        both = F.sum(F.col("f") + F.col("r")).over(w)
        pair = (safe_div("f", both), safe_div("r", both))
    elif mode == "sample":
        pair = (safe_div("f", F.sum("f").over(w)) / 2, safe_div("r", F.sum("r").over(w)) / 2)
    else:
        raise ValueError("mode must be sample or group")
    zero = [F.coalesce(p, F.lit(0.0)) for p in pair]
    return t.select("sample_id", "chrom", zero[0].alias("frac_fwd"), zero[1].alias("frac_rev"))


def normalised(bins: DataFrame, value: str = "n", upto: int = 24) -> DataFrame:
    """Counts over the sample's total on chromosomes 1 to ``upto``, before any bin is masked."""
    return bins.where(F.col("chrom") <= upto).withColumn("x", F.coalesce(safe_div(value, F.sum(value).over(Window.partitionBy("sample_id"))), F.lit(0.0)))


def reference_frame(totals: DataFrame) -> DataFrame:
    """One row per sample: 24 read counts and 24 fractions."""
    f = fractions(totals)
    names = {c: str(c) if c <= 22 else "XY"[c - 23] for c in range(1, 25)}
    wide = f.groupBy("sample_id").agg(*[F.coalesce(F.sum(F.when(F.col("chrom") == c, F.col("reads"))), F.lit(0)).alias(f"reads_{n}") for c, n in names.items()], *[F.coalesce(F.sum(F.when(F.col("chrom") == c, F.col("frac"))), F.lit(0.0)).alias(f"frac_{n}") for c, n in names.items()])
    return wide


def count_metadata(bins: DataFrame, pre: str = "n_pre", post: str = "n", gc_pre: str = "gc_pre", gc_post: str = "gc_post", mapq: str = "mean_mapq") -> DataFrame:
    """Per sample: sums before and after filters, covered bins, retained share, read-weighted GC and quality."""
    weighted = lambda v, w: safe_div(F.sum(F.when(is_finite(v), F.col(v) * F.col(w))), F.sum(F.when(is_finite(v), F.col(w))))
    out = bins.groupBy("sample_id").agg(F.sum(pre).alias("pre_sum"), F.sum(post).alias("post_sum"), F.count_if(F.col(post) > 0).alias("nonzero_bins"), weighted(gc_pre, pre).alias("gc_perc_pre"), weighted(gc_post, post).alias("gc_perc_post"), weighted(mapq, post).alias("mean_mapq"))
    return out.withColumn("retained_fraction", safe_div("post_sum", "pre_sum"))


def genome_offsets(bins: DataFrame) -> DataFrame:
    """Bins before each chromosome, for an axis over the genome (one row per chromosome)."""
    last = bins.groupBy("chrom").agg((F.max("bin") + 1).alias("bins"))
    return last.withColumn("offset", F.coalesce(F.sum("bins").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def masked_rank(mask: DataFrame) -> DataFrame:
    """Rank of the kept bins in genome order (``chrom, bin, keep``), from 0; the mask has one row per genome bin."""
    return mask.where("keep").select("chrom", "bin", (F.row_number().over(Window.orderBy("chrom", "bin")) - 1).alias("masked_idx"))


def masked_cumulative(mask: DataFrame) -> DataFrame:
    per = mask.groupBy("chrom").agg(F.count_if("keep").alias("kept"))
    return per.withColumn("kept_cum", F.sum("kept").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, 0)))


def combinations_of(rows: DataFrame, column: str, size: int, at_once: int = 4096) -> DataFrame:
    """``rank, items``: all sets of ``size`` distinct values of a column, in lexicographic order.

    The values (a chromosome's or a sex's kind of column: at most 64, else it is an error) are numbered; each task makes
    the sets of a range of ranks from the ranks alone, so nothing is joined and nothing but the values reaches the driver.
    """
    spark = rows.sparkSession
    values = sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(65).collect())
    if len(values) > 64:
        raise ValueError(f"{column} has more than 64 values")
    total, kind, typed = comb(len(values), size), rows.select(column).dtypes[0][1], pa.list_(to_arrow_type(rows.schema[column].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in b.column(0).to_pylist():
                ranks = np.arange(lo, min(total, lo + at_once))
                items = [[values[i] for i in s] for s in unrank_sets(len(values), size, ranks).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(items, typed)], ["rank", "items"])

    return spark.range(0, total, at_once).mapInArrow(run, f"rank long, items array<{kind}>")
