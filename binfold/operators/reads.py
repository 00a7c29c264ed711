"""Read filters, duplicate removal and counting.

Reads: ``sample_id, chrom, pos, mate_pos, flag, mapq, strand, seq_len, nm, cigar`` plus a column that makes the order
of reads at one position total (``read_no``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.safe import safe_div

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, READ1, READ2, SECONDARY, QC_FAILED, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 64, 128, 256, 512, 1024, 2048
NUCLEAR = [str(i) for i in range(1, 23)] + ["X", "Y"]


def has_bits(flag: Column | str, bits: int) -> Column:
    return F.col(flag).bitwiseAND(bits) == bits if isinstance(flag, str) else flag.bitwiseAND(bits) == bits


def lacks_bits(flag: Column | str, bits: int) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(bits) == 0


def filter_reads(reads: DataFrame, mapq: int = 0, require_flags: int = 0, exclude_flags: int = 0) -> DataFrame:
    """Minimum quality, all required bits, no excluded bit; each filter reaches the scan as a predicate."""
    out = reads.where(F.col("mapq") >= mapq)
    if require_flags:
        out = out.where(has_bits("flag", require_flags))
    if exclude_flags:
        out = out.where(lacks_bits("flag", exclude_flags))
    return out


def proper_or_single(reads: DataFrame) -> DataFrame:
    """Drop reads that are paired but not properly paired."""
    return reads.where(~(has_bits("flag", PAIRED) & lacks_bits("flag", PROPER)))


def nuclear_only(reads: DataFrame, col: str = "chrom") -> DataFrame:
    return reads.where(F.col(col).cast("string").isin([*NUCLEAR, "23", "24"]))


def not_mitochondrial(reads: DataFrame, col: str = "chrom") -> DataFrame:
    """Leave out unmapped and mitochondrial reference names."""
    return reads.where(~F.col(col).isin("*", "chrM", "chrMT", "M", "MT"))


def streaming_dedup(reads: DataFrame, order: list[str], cell: int = 1 << 16) -> DataFrame:
    """Consecutive-position duplicates over coordinate-sorted reads.

    Two things are kept from read to read: the position of the last read, and the mate position of the last paired
    one. A paired read is a duplicate if both are its own, a single read if the position is. Reads that are paired but
    not proper are out of both count and state. So a single read between two pairs leaves the mate that is kept.

    The mate may come from an earlier position, so it is carried in two levels: inside cells of the genome by a window,
    and from cell to cell by a window with one row a cell; a chromosome's reads never meet in one task. ``order`` makes
    the order of reads at one position total.
    """
    used, place = proper_or_single(reads), ["pos", *order]
    rows = used.withColumn("_cell", F.floor(F.col("pos") / cell))
    mate = F.when(has_bits("flag", PAIRED), F.struct(F.col("mate_pos").alias("m")))
    cells = rows.groupBy("sample_id", "chrom", "_cell").agg(F.max_by(mate, F.when(has_bits("flag", PAIRED), F.struct(*place))).alias("_left"))
    line = Window.partitionBy("sample_id", "chrom").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("sample_id", "chrom", "_cell", F.last("_left", ignorenulls=True).over(line).alias("_carried"))
    inside = Window.partitionBy("sample_id", "chrom", "_cell").orderBy(*place)
    rows = rows.withColumn("_before", F.lag("pos").over(inside)).withColumn("_mate", F.last(mate, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(cells, ["sample_id", "chrom", "_cell"])
    known = F.coalesce("_mate", "_carried")
    same = F.col("pos").eqNullSafe(F.col("_before")) & (lacks_bits("flag", PAIRED) | (known.isNotNull() & F.col("mate_pos").eqNullSafe(known["m"])))
    return rows.where(~same).select(*[F.col(f"`{c}`") for c in reads.columns])


def remove_duplicates(reads: DataFrame, rmdup: str = "streaming", order: list[str] | None = None) -> DataFrame:
    if rmdup == "none":
        return reads
    if rmdup == "flag":
        return reads.where(lacks_bits("flag", DUPLICATE))
    if rmdup == "streaming":
        return streaming_dedup(reads, order or ["read_no"])
    raise ValueError("rmdup must be streaming, flag or none")


def bin_counts(reads: DataFrame, binsize: int) -> DataFrame:
    """``sample_id, chrom, bin, n, n_fwd, n_rev``; partial counts before the only shuffle."""
    fwd = lacks_bits("flag", REVERSE)
    return reads.groupBy("sample_id", "chrom", F.floor(F.col("pos") / binsize).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(fwd).alias("n_fwd"), F.count_if(~fwd).alias("n_rev")
    )


def convert(reads: DataFrame, lengths: DataFrame, binsize: int = 5000, mapq: int = 1, require_flags: int = 0, exclude_flags: int = 0, rmdup: str = "streaming", order: list[str] | None = None) -> DataFrame:
    """Filter, remove duplicates, count and densify: ``sample_id, chrom, bin, n, n_fwd, n_rev`` for every bin."""
    from binfold.operators.bins import densify

    kept = remove_duplicates(filter_reads(reads, mapq, require_flags, exclude_flags), rmdup, order)
    return densify(bin_counts(kept, binsize), lengths, binsize)


def bin_reads(reads: DataFrame, lengths: DataFrame, binsize: int = 50000, mapq: int = 0, require_flags: int = 0, exclude_flags: int = 0, rmdup: str = "none") -> DataFrame:
    """Defaults of the chromosome-fraction path; duplicates by flag or not at all."""
    if rmdup not in ("none", "flag"):
        raise ValueError("rmdup must be none or flag")
    return convert(reads, lengths, binsize, mapq, require_flags, exclude_flags, rmdup)


def idxstats(reads: DataFrame) -> DataFrame:
    """Mapped and unmapped reads per reference."""
    unmapped = has_bits("flag", UNMAPPED)
    return reads.groupBy("sample_id", "chrom").agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))


def string_bins(reads: DataFrame, binsize: int = 50000) -> DataFrame:
    """Counts per ``chr_bin`` name; a position that is a multiple of the bin size falls in the lower bin."""
    name = F.concat_ws("_", F.concat(F.lit("chr"), F.col("chrom").cast("string")), F.floor((F.col("pos") - 1) / binsize).cast("string"))
    return reads.groupBy("sample_id", name.alias("bin_name")).agg(F.count("*").alias("n"))


def region_counts(reads: DataFrame, regions: DataFrame, cell: int = 10000) -> DataFrame:
    """Reads that start inside regions ``chrom, start, end`` (half open), per sample; a read counts once per region.

    A range join as an equi-join: a region is listed once per cell it covers, a read has one cell.
    """
    cells = regions.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.greatest("end", F.col("start") + 1) - 1) / cell))))
    hit = reads.withColumn("cell", F.floor(F.col("pos") / cell)).join(cells, ["chrom", "cell"]).where("pos >= start and pos < end")
    return hit.groupBy("sample_id").agg(F.count("*").alias("n_in"))


def y_unique_ratio(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads in Y regions over reads on nuclear chromosomes; 0 without reads."""
    total = nuclear_only(reads).groupBy("sample_id").agg(F.count("*").alias("n_all"))
    joined = total.join(region_counts(reads, regions), "sample_id", "left")
    return joined.select("sample_id", F.coalesce("n_in", F.lit(0)).alias("n_in"), "n_all", F.coalesce(safe_div(F.coalesce("n_in", F.lit(0)), "n_all"), F.lit(0.0)).alias("ratio"))


def covered_blocks(reads: DataFrame, spans: str = "length") -> DataFrame:
    """``sample_id, chrom, start, end``: stretches of the reference that reads cover.

    ``length``: from ``pos`` for ``seq_len`` bases. ``whole``: from the first to the last base that the CIGAR aligns,
    gaps included. ``gaps``: the CIGAR's aligned stretches, without deletions (D) and skips (N).
    """
    if spans == "length":
        return reads.select("sample_id", "chrom", F.col("pos").alias("start"), (F.col("pos") + F.col("seq_len")).alias("end"))
    if spans not in ("whole", "gaps"):
        raise ValueError("spans must be length, whole or gaps")
    kinds = dict(reads.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                coded = b.column(3).dictionary_encode()  # a CIGAR is taken apart once a batch
                stretches = [_stretches(c, spans) for c in coded.dictionary.to_pylist()]
                flat, held = np.array([x for c in stretches for x in c], np.int64).reshape(-1, 2), np.array([len(c) for c in stretches], np.int64)
                code = coded.indices.to_numpy()
                row, nth = _repeated(held[code])
                found = flat[(np.cumsum(held) - held)[code][row] + nth] + b.column(2).to_numpy()[row][:, None]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(found[:, 0]), pa.array(found[:, 1])], ["sample_id", "chrom", "start", "end"])

    used = reads.select("sample_id", "chrom", F.col("pos").cast("long").alias("pos"), "cigar").where("pos is not null and cigar is not null")
    return used.mapInArrow(run, f"sample_id {kinds['sample_id']}, chrom {kinds['chrom']}, start long, end long")


def _stretches(cigar: str, spans: str) -> list[tuple[int, int]]:
    """What a CIGAR covers, from the read's position on: its aligned stretches, or all from first to last."""
    at, out = 0, []
    for n, kind in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
        if kind in "M=X" and spans == "gaps" and int(n):
            out.append((at, at + int(n)))
        at += int(n) if kind in "MDN=X" else 0
    return out if spans == "gaps" else [(0, at)] if at else []


def _repeated(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, each as often as ``n`` says, and the count from 0 inside each."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - (np.cumsum(n) - n)[row]


def _packed(cell: int, most: int = 200_000):
    """Blocks ``sample_id, chrom, start, end`` as rows ``sample_id, chrom, cell, first, last``.

    Blocks are cut where cells begin; ``first`` and ``last`` hold the first and last places, counted from the start of
    the cell, of up to ``most`` pieces of one cell.
    """
    width = "<u2" if cell <= 1 << 16 else "<u4"

    def pack(blocks: pa.Table) -> Iterator[pa.RecordBatch]:
        sample, chrom = (blocks.column(k).combine_chunks().dictionary_encode("encode") for k in (0, 1))
        start, end = (blocks.column(k).to_numpy() for k in (2, 3))
        group = sample.indices.to_numpy().astype(np.int64) * len(chrom.dictionary) + chrom.indices.to_numpy()
        pieces = (end - 1) // cell - start // cell + 1
        parts = (np.cumsum(pieces) - pieces) // most  # long blocks are not all cut at once
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for lo, hi in zip(edges, edges[1:]):
            row, nth = _repeated(pieces[lo:hi])
            row += lo
            at = start[row] // cell + nth
            order = np.lexsort((at, group[row]))
            row, at = row[order], at[order]
            begins = np.concatenate(([0], np.flatnonzero((np.diff(group[row]) != 0) | (np.diff(at) != 0)) + 1))
            offsets = np.append(begins, len(row))
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((offsets * x.itemsize).astype(np.int32)), pa.py_buffer(x)])  # noqa: E731,B023
            first, last = np.maximum(start[row] - at * cell, 0), np.minimum(end[row] - at * cell, cell) - 1
            of = group[row[begins]]
            yield pa.RecordBatch.from_arrays([sample.dictionary.take(pa.array(of // len(chrom.dictionary))), chrom.dictionary.take(pa.array(of % len(chrom.dictionary))), pa.array(at[begins]), binary(first.astype(width)), binary(last.astype(width))], ["sample_id", "chrom", "cell", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b] if b.num_rows else held, n + b.num_rows
            if n >= most:
                yield from pack(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from pack(pa.Table.from_batches(held))

    return run


def _laid_down(cell: int, segments: bool):
    """Sorted rows of ``_packed`` to the segments of each cell, or to one row a cell; a task holds one cell's depth."""
    width = "<u2" if cell <= 1 << 16 else "<u4"
    names = ["start", "len", "depth"] if segments else ["length", "bases", "min", "max"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, delta, kinds = None, np.zeros(cell + 1, np.int64), None

        def done() -> pa.RecordBatch:
            depth = np.cumsum(delta[:cell])
            if segments:
                at = np.flatnonzero(delta[:cell])
                size, at_depth = np.diff(np.append(at, cell)), depth[at]
                out = [(at + key[2] * cell)[at_depth > 0], size[at_depth > 0], at_depth[at_depth > 0]]
            else:
                covered = depth[depth > 0]
                out = [np.array([v], np.int64) for v in (len(covered), covered.sum(), covered.min(), covered.max())]
            return pa.RecordBatch.from_arrays([*(pa.array([k] * len(out[0]), t) for k, t in zip(key, kinds)), *map(pa.array, out)], ["sample_id", "chrom", *names])

        for b in batches:
            if not b.num_rows:
                continue
            kinds = [b.schema.field(0).type, b.schema.field(1).type]
            codes = [b.column(k).dictionary_encode("encode").indices.to_numpy() for k in (0, 1, 2)]
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in codes])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                here = tuple(b.column(k)[lo].as_py() for k in (0, 1, 2))
                if here != key:
                    if key:
                        yield done()
                    key = here
                    delta[:] = 0
                first, last = (np.frombuffer(b"".join(b.column(k).slice(lo, hi - lo).to_pylist()), width).astype(np.int64) for k in (3, 4))
                delta += np.bincount(first, minlength=cell + 1)
                delta -= np.bincount(last + 1, minlength=cell + 1)
        if key:
            yield done()

    return run


def _by_cell(blocks: DataFrame, cell: int, segments: bool) -> DataFrame:
    kinds, place = dict(blocks.dtypes), ["sample_id", "chrom", "cell"]
    group = f"sample_id {kinds['sample_id']}, chrom {kinds['chrom']}, "
    blocks = blocks.select("sample_id", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("start < end")
    packed = blocks.mapInArrow(_packed(cell), group + "cell long, first binary, last binary").repartition(*place).sortWithinPartitions(*place)
    return packed.mapInArrow(_laid_down(cell, segments), group + ("start long, len long, depth long" if segments else "length long, bases long, min long, max long"))


def depth_segments(blocks: DataFrame, cell: int = 1 << 16) -> DataFrame:
    """``sample_id, chrom, start, len, depth``: stretches of equal depth above 0, by prefix sums inside cells of the genome.

    Blocks are cut where cells begin, so a cell's depth follows from its own blocks. They travel packed, many to a row, and
    are laid down cell by cell on an array of the cell's places. So no task sees a chromosome's blocks, however deep
    it is sequenced, and what it holds depends on ``cell`` alone. A stretch is cut where a cell begins.
    """
    return _by_cell(blocks, cell, True)


def depth(reads: DataFrame, spans: str = "length", cell: int = 1 << 16) -> DataFrame:
    """Per sample and chromosome: covered bases, total bases, mean, min and max depth over covered segments."""
    cells = _by_cell(covered_blocks(reads, spans), cell, False)
    return cells.groupBy("sample_id", "chrom").agg(*[f(c).alias(c) for f, c in ((F.sum, "length"), (F.sum, "bases"), (F.min, "min"), (F.max, "max"))]).withColumn("mean", safe_div("bases", "length"))


def coverage_summary(reads: DataFrame, lengths: DataFrame, spans: str = "whole", cell: int = 1 << 16) -> DataFrame:
    """``sample_id, chrom, length, bases, mean, min, max`` over whole chromosomes, and a row ``total`` of the genome.

    Every sample has a row per chromosome of ``lengths``; bases that no read covers count with depth 0.
    """
    seg = depth(reads, spans, cell).select("sample_id", "chrom", F.col("length").alias("covered"), "bases", F.col("min").alias("low"), F.col("max").alias("high"))
    cells = reads.select("sample_id").distinct().join(F.broadcast(lengths.select("chrom", F.col("length").cast("long").alias("length")))).join(seg, ["sample_id", "chrom"], "left").na.fill(0, ["covered", "bases", "low", "high"])
    least = F.when(F.col("covered") < F.col("length"), 0).otherwise(F.col("low")).cast("long")
    rows = cells.select("sample_id", F.col("chrom").cast("string").alias("chrom"), "length", "bases", least.alias("min"), F.col("high").cast("long").alias("max"))
    total = rows.groupBy("sample_id").agg(F.lit("total").alias("chrom"), F.sum("length").alias("length"), F.sum("bases").alias("bases"), F.min("min").alias("min"), F.max("max").alias("max"))
    return rows.unionByName(total).withColumn("mean", safe_div("bases", "length"))


def alignment_stats(reads: DataFrame, mapq: int = 0, require_flags: int = 0, exclude_flags: int = 0, filtered_stream: bool = False) -> DataFrame:
    """The 27 counters and rates of an alignment file, per sample, in one aggregate.

    Reads that a filter leaves out count as filtered only; with ``filtered_stream`` they were never there. Secondary
    reads count as non-primary only. Reads without a sequence count no further than supplementary. Supplementary reads
    count towards mapped bases by CIGAR, mismatches and duplicates, and in no other number. A paired read is first or
    last by exactly one of its two flags, an unpaired read is first. Rates are 0 where their denominator is.
    """
    use = (F.col("mapq") >= mapq) if mapq else F.lit(True)
    use = use & has_bits("flag", require_flags) if require_flags else use
    use = use & lacks_bits("flag", exclude_flags) if exclude_flags else use
    primary = use & lacks_bits("flag", SECONDARY)
    seen = primary & (F.col("seq_len") > 0)
    own, mapped, dup = seen & lacks_bits("flag", SUPPLEMENTARY), lacks_bits("flag", UNMAPPED), has_bits("flag", DUPLICATE)
    paired = has_bits("flag", PAIRED)
    both = own & paired & mapped & lacks_bits("flag", MATE_UNMAPPED)
    first = own & (~paired | (has_bits("flag", READ1) & lacks_bits("flag", READ2)))
    last = own & paired & lacks_bits("flag", READ1) & has_bits("flag", READ2)
    cigar_bases = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MI=X]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    # What is asked of a read is worked out once; counters that each spell it out make code too long to be compiled.
    asked = {
        "use": use, "own": own, "first": first, "last": last, "own_mapped": own & mapped, "both": both, "proper": has_bits("flag", PROPER), "paired": paired, "seen_dup": seen & dup, "mq0": F.col("mapq") == 0, "failed": has_bits("flag", QC_FAILED),
        "secondary": use & has_bits("flag", SECONDARY), "supplementary": primary & has_bits("flag", SUPPLEMENTARY), "apart": F.col("chrom") != F.col("mate_chrom"), "size": F.col("seq_len"), "seen_mapped": seen & mapped, "nm": F.col("nm"), "cigar_bases": F.when(seen & mapped, cigar_bases),
    }
    rows = reads.select("sample_id", *[v.alias(k) for k, v in asked.items()])
    n, c, size = F.count_if, F.col, F.col("size")
    s = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    out = rows.groupBy("sample_id").agg(
        n(~c("use")).alias("filtered_sequences"), n(c("own")).alias("sequences"), n(c("first")).alias("first_fragments"), n(c("last")).alias("last_fragments"), n(c("own") & ~c("first") & ~c("last")).alias("other_fragments"),
        n(c("own_mapped")).alias("reads_mapped"), n(c("both")).alias("reads_mapped_and_paired"), n(c("own") & ~c("own_mapped")).alias("reads_unmapped"), n(c("both") & c("proper")).alias("reads_properly_paired"), n(c("own") & c("paired")).alias("reads_paired"),
        n(c("seen_dup")).alias("reads_duplicated"), n(c("own_mapped") & c("mq0")).alias("reads_mq0"), n(c("own") & c("failed")).alias("reads_qc_failed"),
        n(c("secondary")).alias("non_primary_alignments"), n(c("supplementary")).alias("supplementary_alignments"), F.floor(n(c("both") & c("apart")) / 2).cast("long").alias("pairs_on_different_chromosomes"),
        s(c("own"), size).alias("total_length"), s(c("first"), size).alias("total_first_fragment_length"), s(c("last"), size).alias("total_last_fragment_length"), s(c("own_mapped"), size).alias("bases_mapped"),
        s(c("seen_mapped"), c("cigar_bases")).alias("bases_mapped_cigar"), s(c("seen_dup"), size).alias("bases_duplicated"), s(c("seen_mapped"), c("nm")).alias("mismatches_from_nm"),
    )
    if filtered_stream:
        out = out.withColumn("filtered_sequences", F.lit(0).cast("long"))
    rate = lambda a, b: F.coalesce(safe_div(a, b), F.lit(0.0))
    rest = [c for c in out.columns if c != "sample_id"]
    return out.select("sample_id", (F.col("filtered_sequences") + F.col("sequences")).alias("raw_total_sequences"), *rest, rate("mismatches_from_nm", "bases_mapped_cigar").alias("error_rate"), rate("reads_duplicated", "sequences").alias("duplicated_read_fraction"), rate("bases_duplicated", "total_length").alias("duplicated_base_fraction"))
