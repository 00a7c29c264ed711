"""Reads that wait for the watermark: packed in state, judged cell by cell, as if all had been sorted."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from binfold.plans.q_more import _deal
from binfold.streaming import counts as stream


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map(dict):
    writes = 0

    def updateValue(self, k, v):  # noqa: N802
        self.writes += 1
        self[k] = v

    getValue, removeKey = dict.get, dict.__delitem__  # noqa: N815


class Handle:
    """State of one key in memory."""

    def __init__(self):
        self.timers, self.map, self.values = set(), Map(), {}

    def getMapState(self, *a):  # noqa: N802
        return self.map

    def getValueState(self, name, *a):  # noqa: N802
        return self.values.setdefault(name, Value())

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


def packed(reads: pd.DataFrame, held_rows: int = 1 << 20) -> pd.DataFrame:
    t = pa.Table.from_pandas(reads, pa.schema([("sample_id", pa.string()), ("chrom", pa.int32()), ("pos", pa.int64()), ("mate_pos", pa.int64()), ("flag", pa.int32()), ("read_no", pa.int64()), ("ms", pa.int64())]), preserve_index=False)
    return pa.Table.from_batches(list(stream._packing(held_rows)(iter(t.to_batches(max_chunksize=7))))).to_pandas()


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_cells_of_waiting_reads_are_judged_in_order(cell):
    rng = np.random.default_rng(cell)
    n = 600
    pos = np.sort(rng.integers(0, 60, n))
    reads = pd.DataFrame({"sample_id": "a", "chrom": 1, "pos": pos, "mate_pos": pd.array(rng.integers(0, 3, n), "Int64"), "flag": rng.choice([0, 1, 3], n), "read_no": rng.permutation(n)})
    reads["ms"] = 100 + np.sort(pos * 5 + rng.integers(0, 4, n))  # reads of one position may lie in two cells
    reads.loc[(reads["flag"] == 0) & (reads.index % 2 == 0), "mate_pos"] = pd.NA
    want, at, pair = [], None, None
    for r in reads.sort_values(["pos", "read_no"]).itertuples():
        if r.flag & 1 and not r.flag & 2:
            continue
        if not (r.pos == at and (not r.flag & 1 or r.mate_pos == pair)):
            want.append(r.read_no)
        at, pair = r.pos, r.mate_pos if r.flag & 1 else pair
    handle, got, now = Handle(), [], 0
    step = stream._Ordered(10**6, cell, held_rows=100)
    step.init(handle)
    batches = np.minimum((reads["ms"] - 100) // 80 + rng.integers(0, 2, n), 4)  # a batch late at most
    for b, mark in enumerate([99, 99 + 80, 99 + 160, 99 + 240, 99 + 10**4]):
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: now)  # noqa: B023
        step.handleInputRows(("a", 1), iter([packed(reads[batches == b], 64)]), clock)
        now = mark if b == 4 else max(0, mark - 80)
        while handle.timers and min(handle.timers) <= now:
            handle.timers.remove(min(handle.timers))
            got += [f for f in step.handleExpiredTimer(("a", 1), clock, None) if len(f)]
    out = pd.concat(got)
    assert out["read_no"].tolist() == want
    known = reads.set_index("read_no")["mate_pos"]
    assert [None if pd.isna(v) else int(v) for v in out["mate_pos"]] == [None if pd.isna(v) else int(v) for v in known[want]]
    assert not handle.map and not handle.values["parts"].exists() and len(handle.timers) == 1
    if cell > 1:
        assert handle.map.writes < n / 2


def test_reads_the_watermark_has_passed_are_dropped():
    reads = pd.DataFrame({"sample_id": "a", "chrom": 1, "pos": [1, 2, 3], "mate_pos": 0, "flag": 0, "read_no": [1, 2, 3], "ms": [50, 60, 70]})
    handle, step = Handle(), stream._Ordered(10**6, 10)
    step.init(handle)
    step.handleInputRows(("a", 1), iter([packed(reads)]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 60))
    assert list(handle.map) == [(7, 0)] and handle.timers == {70}


def test_reads_of_all_keys_are_packed():
    reads = pd.DataFrame({"sample_id": ["b", None, "a", "b", None, "b"], "chrom": pd.array([1, 2, 1, 1, 2, None], "Int32"), "pos": range(6), "mate_pos": 0, "flag": 0, "read_no": range(6), "ms": [5, 9, 1, 7, 2, 3]})
    found = {(r.sample_id, None if pd.isna(r.chrom) else int(r.chrom)): (np.frombuffer(r.reads, stream.PACKED)["read_no"].tolist(), r.ms) for r in packed(reads).itertuples()}
    assert found == {("b", 1): ([0, 3], 7), (None, 2): ([1, 4], 9), ("a", 1): ([2], 1), ("b", None): ([5], 3)}


def test_batches_of_many_files_are_written_by_one_job(spark, tmp_path):
    rows = spark.range(900, numPartitions=4).selectExpr("id AS read_no", "1 AS sample_id", "1 AS chrom")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    _deal(rows, str(tmp_path / "out"), 4)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 2
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 12 and spark.read.parquet(str(tmp_path / "out")).distinct().count() == 900
