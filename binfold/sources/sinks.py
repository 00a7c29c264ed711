"""Writers: interval files with metadata headers, prediction reports, statistics text, arrays, JSON.

Parquet is the main format of the engine; these files are small exports, one file per sample or report.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from binfold.functions.safe import chrom_label
from binfold.sources.tables import META


def metadata_lines(meta: dict[str, str]) -> list[str]:
    """``##RWX_key=value`` lines; keys are unique by type and hold no ``=``, tab or line break."""
    for k, v in meta.items():
        if not k or any(c in k for c in "=\t\r\n") or any(c in str(v) for c in "\t\r\n"):
            raise ValueError(f"{k!r} can't be written as metadata")
    return [f"{META}{k}={v}" for k, v in meta.items()]


def _bed_lines(bins: DataFrame, binsize: int, values: list[str], lengths: DataFrame | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, a place in genome order and the text line of each bin; with lengths the end is clipped."""
    rows = bins.withColumn("start", (F.col("bin") * binsize).cast("long")).withColumn("end", F.col("start") + binsize)
    if lengths is not None:
        rows = rows.join(F.broadcast(lengths.select("chrom", F.col("length").alias("_len"))), "chrom").withColumn("end", F.least("end", "_len"))
    cells = [chrom_label("chrom"), F.col("start"), F.col("end"), *[F.col(v) for v in values]]
    return rows.select(*keep, (F.col("chrom").cast("long") * 2**32 + F.col("bin")).alias("_order"), F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cells]).alias("value"))


def _head(spark: SparkSession, metadata: dict[str, str] | None) -> DataFrame:
    head = metadata_lines(metadata or {})
    return spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "_order long, value string")


def write_bed(bins: DataFrame, path: str, binsize: int, values: list[str], metadata: dict[str, str] | None = None, lengths: DataFrame | None = None) -> None:
    """One compressed text file per call: header lines, then ``chrom, start, end`` and values in genome order.

    The rows of one sample fit a task.
    """
    body = _head(bins.sparkSession, metadata).unionByName(_bed_lines(bins, binsize, values, lengths, []))
    body.coalesce(1).sortWithinPartitions("_order").select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def write_beds(bins: DataFrame, path: str, binsize: int, values: list[str], metadata: dict[str, str] | None = None, lengths: DataFrame | None = None) -> None:
    """Every sample's file at once, below ``path/sample_id=<sample>``; readers take the sample from that folder."""
    head = bins.select("sample_id").distinct().join(F.broadcast(_head(bins.sparkSession, metadata)))
    body = head.unionByName(_bed_lines(bins, binsize, values, lengths, ["sample_id"]))
    body.repartition("sample_id").sortWithinPartitions("sample_id", "_order").select("sample_id", "value").write.mode("overwrite").partitionBy("sample_id").option("compression", "gzip").text(path)


@F.pandas_udf(StringType())
def shortest(v: pd.Series) -> pd.Series:
    """Shortest decimal text that reads back as the same number; whole numbers without a fraction."""
    return v.map(lambda x: None if x is None or pd.isna(x) else repr(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x)))


def number(c: Column | str, zero_is_nan: bool = False) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad | (c == 0) if zero_is_nan else bad, "nan").otherwise(shortest(F.when(~bad, c)))


def prediction_tables(pred: dict[str, DataFrame], binsize: int) -> dict[str, DataFrame]:
    """Text columns of the four report files; starts count from 1, bins mark zero and non-finite numbers ``nan``."""
    place = lambda df, end: df.withColumn("chr", chrom_label("chrom")).withColumn("from", (F.col(end[0]) * binsize + 1).cast("long")).withColumn("to", (F.col(end[1]) * binsize).cast("long"))
    bins = place(pred["bins"].withColumn("next", F.col("bin") + 1), ("bin", "next"))
    name = F.concat_ws(":", "chr", F.concat_ws("-", F.col("from").cast("string"), F.col("to").cast("string")))
    seg = place(pred["segments"], ("start", "end"))
    ab = place(pred["aberrations"], ("start", "end"))
    return {
        "bins": bins.select("sample_id", "chrom", "bin", "chr", F.col("from").alias("start"), F.col("to").alias("end"), name.alias("id"), number("r", True).alias("ratio"), number("z", True).alias("zscore")),
        "segments": seg.select("sample_id", "chrom", F.col("start").alias("bin"), "chr", F.col("from").alias("start"), F.col("to").alias("end"), number("ratio").alias("ratio"), number("zscore").alias("zscore")),
        "aberrations": ab.select("sample_id", "chrom", F.col("start").alias("bin"), "chr", F.col("from").alias("start"), F.col("to").alias("end"), number("ratio").alias("ratio"), number("zscore").alias("zscore"), "type"),
        "statistics": pred["chromosomes"].select("sample_id", "chrom", F.lit(0).alias("bin"), chrom_label("chrom").alias("chr"), number("ratio_mean").alias("ratio.mean"), number("ratio_median").alias("ratio.median"), number("zscore").alias("zscore")),
    }


def write_prediction(pred: dict[str, DataFrame], prefix: str, binsize: int) -> None:
    """``<prefix>_bins``, ``_segments``, ``_aberrations`` and ``_statistics``, a folder per sample in each."""
    for name, df in prediction_tables(pred, binsize).items():
        cols = [c for c in df.columns if c not in ("sample_id", "chrom", "bin")]
        df.repartition("sample_id").sortWithinPartitions("sample_id", "chrom", "bin").select("sample_id", *cols).write.mode("overwrite").partitionBy("sample_id").option("sep", "\t").option("header", True).csv(f"{prefix}_{name}")


#: Counters of the SN section in the order of the format, where the label is not the name with spaces.
STATS_LABELS = {
    "first_fragments": "1st fragments", "reads_mq0": "reads MQ0", "reads_qc_failed": "reads QC failed", "non_primary_alignments": "non-primary alignments",
    "bases_mapped_cigar": "bases mapped (cigar)", "mismatches_from_nm": "mismatches",
}
#: Counters of the table that the SN section does not have.
NOT_IN_STATS = {"sample_id", "other_fragments", "duplicated_read_fraction", "duplicated_base_fraction"}


def stats_lines(stats: DataFrame) -> DataFrame:
    """``sample_id, i, line``: the 24 SN lines of each sample; counts plain, the rate in exponent form."""
    fields = [c for c in stats.columns if c not in NOT_IN_STATS]
    number = lambda f: F.format_string("%e", F.col(f)) if dict(stats.dtypes)[f] == "double" else F.col(f).cast("string")
    cells = [F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"SN\t{STATS_LABELS.get(f, f.replace('_', ' '))}:\t"), number(f)).alias("line")) for i, f in enumerate(fields)]
    return stats.select("sample_id", F.explode(F.array(*cells)).alias("c")).select("sample_id", "c.i", "c.line")


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one tab-separated file with a header."""
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_npz(bins: DataFrame, path: str, binsize: int, value: str = "n") -> None:
    """One sample as int32 arrays per chromosome key; a chromosome without rows is stored as None.

    The sample's bins come to the driver: as many as the genome has, checked.
    """
    import numpy as np

    if bins.select("sample_id").distinct().limit(2).count() > 1:
        raise ValueError("one sample at a time")
    pdf = bins.select("chrom", "bin", value).limit(5_000_001).toPandas()
    if len(pdf) > 5_000_000:
        raise ValueError("too many bins for one array file")
    out = {}
    for c in range(1, 25):
        own = pdf[pdf["chrom"] == c]
        arr = None
        if len(own):
            arr = np.zeros(int(own["bin"].max()) + 1, np.int32)
            arr[own["bin"].to_numpy()] = own[value].to_numpy()
        out[str(c)] = arr
    np.savez_compressed(path, binsize=binsize, sample=np.array(out, dtype=object))


def npz_shape(path: str) -> dict:
    """Bin size and lengths per chromosome of an array file."""
    import numpy as np

    with np.load(path, allow_pickle=True) as f:
        return {"binsize": int(f["binsize"]), "bins": {k: None if v is None else len(v) for k, v in f["sample"].item().items()}}
