"""Shared helpers: intermediate tables in the cluster's shared folder, word counts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
HOT_SHARE = 1000
FEW_EDGES = 1_000_000  # pairs of 64-bit numbers: 16 MB


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (tests, a local master) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and known.isDefined():
        base = known.get()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="binfold-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/binfold/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that a finished step no longer needs, through the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file beside the data of a table; a leading underscore in its name hides it from Spark's readers."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_note(spark: SparkSession, path: str) -> str | None:
    """What ``write_note`` wrote, or None."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    stream = fs.open(hadoop)
    try:
        return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def has_files(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop)) and len(fs.listStatus(hadoop)) > 0


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "inner", few: int = 0) -> DataFrame:
    """``rows`` joined to one row per key of ``groups`` without a hot task.

    ``size``: a column of ``groups``, the number of ``rows`` of a key, of which the sum is at most ``total``. So at most
    ``HOT_SHARE`` keys hold more than a ``HOT_SHARE``-th of the rows; these are broadcast (their number is the bound)
    and their rows stay where they are. All others meet in a sort-merge join, none of them a large part of it. With at
    most ``few`` rows in all, where even one task could take everything, the join is a plain one.
    """
    if total <= few:
        return rows.hint("merge").join(groups, on, how)
    is_hot = F.col(size) * HOT_SHARE > total
    hot = F.broadcast(groups.where(is_hot))
    rest = rows.join(F.broadcast(groups.where(is_hot).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.hint("merge").join(groups.where(~is_hot), on, how))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words of a text (0 for null) as long."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges``: columns ``u, v`` (same orderable type). Returns ``node, comp`` for every node that has an
    edge, ``comp`` being the smallest node of its component. Each round is two grouped minima with their joins, split
    at hubs; its result is written to the shared folder, and only a count returns to the driver. Self loops, repeated
    edges and null ends are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    kept: list[str] = []

    def save(df: DataFrame) -> DataFrame:
        kept.append(new_path(spark, "stars"))
        out = table(df, "stars", kept[-1])
        while len(kept) > 2:
            delete_path(spark, kept.pop(0))
        return out

    cur = save(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, size = None, cur.count()
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_groups(both, low, ["u"], "n", 2 * size, few=FEW_EDGES).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_groups(large, low2, ["u"], "n", 2 * size, few=FEW_EDGES)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = save(small)
        now = cur.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        # Every node hangs on one smaller node and that node is no one's child: stars only, nothing moves any more.
        if tuple(now) == state and now[0] == now[2]:
            break
        state, size = tuple(now), now[0]
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
