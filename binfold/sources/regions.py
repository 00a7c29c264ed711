"""Interval files in genome order with an index, and region reads that open only the blocks they need.

Below a path, ``body`` holds block-compressed text files (any gzip reader can read them, ``read_tabix`` among them) and
``index`` two Parquet tables: ``bins`` has a row per stretch of rows of one bin of the interval hierarchy, with its
place in a file; ``linear`` has, per file and 16 kb window, the first place of a row that reaches into the window.
A region read joins the regions with the index, and each task reads the stretches of a file that are left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.functions.safe import chrom_label
from binfold.sources import storage
from binfold.sources.blocks import BlockReader, BlockWriter, locate
from binfold.sources.sinks import metadata_lines

#: The hierarchy: windows of 2**14 bases, and six levels above, each eight times as wide.
SHIFT, DEPTH = 14, 6


def level_start(level: int) -> int:
    """Number of the first bin of a level; level 0 is the one bin over everything."""
    return (8**level - 1) // 7


def bin_of(start: Column, end: Column) -> Column:
    """Smallest bin that holds a half-open interval."""
    last = F.greatest(end, start + 1) - 1
    out = F.lit(0).cast("long")
    for level in range(1, DEPTH + 1):
        wide = SHIFT + 3 * (DEPTH - level)
        out = F.when(F.shiftright(start, wide) == F.shiftright(last, wide), level_start(level) + F.shiftright(start, wide)).otherwise(out)
    return out


def bins_over(start: Column, end: Column) -> Column:
    """``array<struct<first, last>>``: the ranges of bins, one a level, that may hold intervals overlapping a region."""
    last = F.greatest(end, start + 1) - 1
    wide = lambda level: SHIFT + 3 * (DEPTH - level)
    return F.array(*[F.struct((level_start(k) + F.shiftright(start, wide(k))).alias("first"), (level_start(k) + F.shiftright(last, wide(k))).alias("last")) for k in range(DEPTH + 1)])


BINS = "file string, chrom int, bin long, begin long, end long, n long"
LINEAR = "file string, chrom int, window long, first long"


def write_indexed(rows: DataFrame, path: str, values: list[str], metadata: dict[str, str] | None = None, parts: int | None = None) -> None:
    """Rows ``chrom, start, end`` and ``values`` in genome order below ``path``, with their index.

    Rows are dealt by ranges of the genome; a task writes one file under a draft name and hands its index rows on. The
    driver moves the drafts of the tasks that came through, so retried tasks leave nothing behind.
    """
    spark, head = rows.sparkSession, "".join(line + "\n" for line in metadata_lines(metadata or {})).encode()
    body, drafts = f"{path.rstrip('/')}/body", f"{path.rstrip('/')}/_drafts"
    storage.make_folder(spark, drafts)
    line = F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in (chrom_label("chrom"), F.col("start"), F.col("end"), *[F.col(v) for v in values])])
    lines = rows.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *values).select(F.col("chrom").cast("int").alias("chrom"), "start", "end", bin_of(F.col("start"), F.col("end")).alias("bin"), line.alias("line"))
    order = ["chrom", "start", "end", "line"]
    lines = lines.repartitionByRange(parts, *order[:2]) if parts else lines.repartitionByRange(*order[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = uuid.uuid4().hex
        out, stretch, windows, done = None, None, {}, []
        for b in batches:
            for chrom, start, end, bin_, text in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    system, inner = locate(f"{drafts}/{file}")
                    out = BlockWriter(system.open_output_stream(inner))
                    out.write(head)
                at = out.place()
                if stretch is None or stretch[:2] != [chrom, bin_]:
                    if stretch:
                        done.append((*stretch[:3], at, stretch[3]))
                    stretch = [chrom, bin_, at, 0]
                stretch[3] += 1
                for w in range(start >> SHIFT, (max(end, start + 1) - 1 >> SHIFT) + 1):
                    windows.setdefault((chrom, w), at)
                out.write(text.encode() + b"\n")
        if out:
            done.append((*stretch[:3], out.place(), stretch[3]))
            out.close()
            rows = [(file, "bin", c, x, b, e, n) for c, x, b, e, n in done] + [(file, "window", c, w, at, None, None) for (c, w), at in windows.items()]
            for lo in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 100_000]), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["file", "kind", "chrom", "number", "begin", "end", "n"])

    made = lines.sortWithinPartitions(*order).mapInArrow(run, "file string, kind string, chrom int, number long, begin long, end long, n long")
    made.write.mode("overwrite").parquet(f"{drafts}/index")
    index = spark.read.parquet(f"{drafts}/index")
    first = index.where("kind = 'bin'").groupBy("file").agg(F.min(F.struct("chrom", "number", "begin")).alias("o")).orderBy("o")
    names = {r["file"]: f"part-{k:05d}.bed.gz" for k, r in enumerate(first.collect())}
    for draft, name in names.items():
        storage.move(spark, f"{drafts}/{draft}", f"{body}/{name}")
    renamed = index.join(F.broadcast(spark.createDataFrame(list(names.items()), "file string, name string")), "file") if names else index.withColumn("name", F.col("file"))
    renamed.where("kind = 'bin'").select(F.col("name").alias("file"), "chrom", F.col("number").alias("bin"), "begin", "end", "n").sort("chrom", "bin").write.mode("overwrite").parquet(f"{path}/index/bins")
    renamed.where("kind = 'window'").select(F.col("name").alias("file"), "chrom", F.col("number").alias("window"), F.col("begin").alias("first")).sort("chrom", "window").write.mode("overwrite").parquet(f"{path}/index/linear")
    storage.delete(spark, drafts)


def stretches(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """``region, r_start, r_end, file, begin, end``: what has to be read for regions ``region, chrom, start, end``.

    Bins that can't overlap a region fall away by the hierarchy; of the wide bins above, what ends before the first
    row that reaches into the region's first window falls away by the linear table.
    """
    bins, linear = spark.read.schema(BINS).parquet(f"{path}/index/bins"), spark.read.schema(LINEAR).parquet(f"{path}/index/linear")
    wanted = regions.select("region", F.col("chrom").cast("int").alias("chrom"), F.col("start").cast("long").alias("r_start"), F.col("end").cast("long").alias("r_end")).where("r_end > r_start")
    # Regions are listed once per bin and window, so that both joins are on equal keys.
    numbers = F.flatten(F.transform(bins_over(F.col("r_start"), F.col("r_end")), lambda r: F.sequence(r["first"], r["last"])))
    asked = wanted.withColumn("bin", F.explode(numbers))
    found = asked.join(bins, ["chrom", "bin"]).select("region", "r_start", "r_end", "file", "begin", F.col("end").alias("stop"))
    # The first place from which a row reaches into any window of the region; rows before it end before the region.
    over = wanted.select("region", "chrom", F.explode(F.sequence(F.shiftright("r_start", SHIFT), F.shiftright(F.col("r_end") - 1, SHIFT))).alias("window"))
    reach = over.join(linear, ["chrom", "window"]).groupBy("region", "file").agg(F.min("first").alias("first"))
    left = found.join(reach, ["region", "file"]).where(F.col("stop") > F.col("first"))
    return left.select("region", "r_start", "r_end", "file", "begin", F.col("stop").alias("end"))


def read_regions_of(spark: SparkSession, path: str, regions: DataFrame, columns: int) -> DataFrame:
    """``region, column0 ..``: rows of an indexed file that overlap each region (half open); a row counts once a region."""
    body = f"{path.rstrip('/')}/body"
    asked = stretches(spark, path, regions)
    kind = dict(asked.dtypes)["region"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for region, start, end, file, begin, stop in zip(*(c.to_pylist() for c in b.columns)):
                reader = BlockReader(f"{body}/{file}")
                # ``stop`` lies in the block of its own offset, or right before it where the block has not begun.
                data, last = b"", None
                for at, more in reader.blocks(begin >> 16, (stop >> 16) + (1 if stop & 0xFFFF else 0)):
                    last = len(data) if at == stop >> 16 else last
                    data += more
                reader.close()
                data = data[begin & 0xFFFF : len(data) if last is None else last + (stop & 0xFFFF)]
                rows = [c for c in (x.split("\t") for x in data.decode().split("\n") if x) if int(c[1]) < end and max(int(c[2]), int(c[1]) + 1) > start]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([region] * len(rows)).cast(b.column(0).type), *[pa.array([c[k] if k < len(c) else None for c in rows], pa.string()) for k in range(columns)]], ["region", *[f"column{k}" for k in range(columns)]])

    return asked.repartition("file", "begin").mapInArrow(run, f"region {kind}, " + ", ".join(f"column{k} string" for k in range(columns)))
