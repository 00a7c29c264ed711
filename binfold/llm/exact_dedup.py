"""Exact dedup over a persistent digest index (DataFrame functions only).

The index is a list of runs below a path. A run is a Parquet table bucketed by digest, with one file a bucket that is
sorted by digest, so a sort-merge join reads it without an exchange and without a sort, however large it is. A batch is
hashed, its digests are grouped and looked up once in every run; digests that none has become a new run. When there are
more than ``MOST_RUNS``, all are merged into one. A head file names the runs that count; it is written last.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.llm.common import ascii_lower, delete_path, has_files, join_groups, new_path, table
from binfold.sources import storage

MOST_RUNS = 8


def text_digest(col: Column) -> Column:
    """SHA-256 (32 bytes) of the text after lower-casing A-Z; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(col).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, each with the id of the row that stays: ``digest, keep_id``.

    ``path`` may hold an index that an earlier run left. Its bucket count and key type are kept in its head and hold
    from then on, whatever is asked for later; another key type is an error, and so is data without a head. A batch
    is in the index or not: what has no head is not read, and of two writers at once the second gets an error.

    Spark uses the order of bucketed files only with ``spark.sql.legacy.bucketedTableScan.outputOrdering``, which is
    set on the session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, key_type: str = "bigint"):
        self.spark, self.path, self._tables = spark, path or new_path(spark, "digests"), {}
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        heads = [n for n in storage.list_names(spark, f"{self.path}/heads") if n.endswith(".json")]
        if heads:
            self.number = int(heads[-1][:-5])
            self.state = json.loads(storage.read_text(spark, f"{self.path}/heads/{heads[-1]}"))
        else:
            if path and has_files(spark, path):
                raise ValueError(f"{path} holds files but no head: not an index")
            self.number, self.state = 0, {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "key_type": key_type, "runs": []}
            self._publish([])
        if self.state["key_type"] != key_type:
            raise ValueError(f"the index at {self.path} keeps ids of type {self.state['key_type']}, not {key_type}")
        self.buckets = self.state["buckets"]

    def _publish(self, runs: list[str]) -> None:
        state = self.state | {"runs": runs}
        storage.publish_text(self.spark, f"{self.path}/heads/{self.number + 1:012d}.json", json.dumps(state))
        self.number, self.state = self.number + 1, state

    def _write(self, rows: DataFrame) -> str:
        """A run: the rows of each bucket in one task, so in one file, in order."""
        run = f"run-{uuid.uuid4().hex}"
        name = f"digest_{run.replace('-', '_')}"
        rows.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{run}").saveAsTable(name)
        self._tables[run] = name
        return run

    def run(self, run: str) -> DataFrame:
        if run not in self._tables:
            self._tables[run] = f"digest_{run.replace('-', '_')}_{uuid.uuid4().hex[:8]}"
            self.spark.sql(
                f"CREATE TABLE {self._tables[run]} (digest BINARY, keep_id {self.state['key_type']}) USING parquet LOCATION '{self.path}/{run}' "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )
        return self.spark.table(self._tables[run])

    def read(self) -> DataFrame:
        """All digests, in any order."""
        runs = [self.run(r) for r in self.state["runs"]]
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], f"digest binary, keep_id {self.state['key_type']}")

    def find(self, digests: DataFrame) -> DataFrame:
        """``digest, keep_id`` of those of ``digests`` (a column ``digest``, without repeats) that the index has."""
        found = [self.run(r).join(digests.select("digest").hint("merge"), "digest").select("digest", "keep_id") for r in self.state["runs"]]
        return reduce(DataFrame.unionByName, found) if found else self.read()

    def append(self, fresh: DataFrame) -> None:
        """Add digests that the index lacks as a run, and merge the runs when they are many."""
        if fresh.isEmpty():
            return
        self._publish([*self.state["runs"], self._write(fresh)])
        if len(self.state["runs"]) > MOST_RUNS:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one. Readers that still use the old ones have to open the index anew."""
        old = self.state["runs"]
        if len(old) > 1:
            self._publish([self._write(self.read())])
            for run in old:
                self._drop(run)
                storage.delete(self.spark, f"{self.path}/{run}")

    def _drop(self, run: str) -> None:
        if run in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(run)}")

    def close(self) -> None:
        """Take the runs out of the session's catalog; their files stay."""
        for run in list(self._tables):
            self._drop(run)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: ``<id>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts in one batch the row with the largest id
    stays; a text that the index already had stays with the row that the index names, and of this batch only that row
    is kept, if it is in it. So a batch that is run again, whole or in part, after a failure anywhere, gives the rows
    it gave before. ``group_size`` counts the rows of this batch. Nulls: a null text counts as empty; a null id loses
    against any other id and, alone, is kept under a null ``keep_id``. Rows that repeat id and text: one of them is
    kept. Empty input gives an empty result; further columns of ``docs`` are not read, whatever their names.
    """
    spark, own = docs.sparkSession, index is None
    index = index or DigestIndex(spark, key_type=docs.select(id_col).dtypes[0][1])
    paths = [new_path(spark, f"dedup-{k}") for k in range(5)]
    rows = table(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "rows", paths[0])
    # The row number, fixed once written, tells apart rows that repeat id and text; null ids order first.
    pairs = table(rows.groupBy("digest", "id").agg(F.max("row").alias("row"), F.count("*").alias("n")), "pairs", paths[1])
    groups = pairs.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("last"), F.sum("n").alias("group_size"))
    groups = table(groups.select("digest", F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"), "groups", paths[2])
    seen = table(index.find(groups), "seen", paths[3])
    fresh = groups.join(seen.select("digest"), "digest", "left_anti")
    # Of a text that the index had, the row that stays is the one with the index's id.
    again = seen.join(groups.select("digest", "group_size"), "digest").alias("s").join(pairs.alias("p"), (F.col("s.digest") == F.col("p.digest")) & F.col("s.keep_id").eqNullSafe(F.col("p.id")), "left")
    again = again.select("s.digest", "s.keep_id", F.col("p.row").alias("keep_row"), "s.group_size")
    known = table(fresh.unionByName(again), "known", paths[4])
    index.append(known.join(seen.select("digest"), "digest", "left_anti").select("digest", "keep_id"))
    # A text that holds a large part of all rows is no hot task of this join.
    out = join_groups(rows, known, ["digest"], "group_size", rows.count())
    kept = F.col("row").eqNullSafe(F.col("keep_row"))
    out = table(out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")), "dedup")
    if own:
        index.close()
        delete_path(spark, index.path)
    for path in paths:
        delete_path(spark, path)
    return out
