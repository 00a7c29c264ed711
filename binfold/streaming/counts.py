"""Streaming counting and duplicate removal; each has a batch form with equal results."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp with time zone (watermarks take no other), and a watermark on streams."""
    src = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return src.withWatermark("ts", late) if src.isStreaming else src


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Counts and sums per key and event-time window; works on streams (late rows past the watermark are dropped) and tables."""
    src = _watermarked(events, late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return src.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", key: str = "user_id") -> DataFrame:
    """Sessions per key: rows closer than the gap belong together."""
    src = _watermarked(events, late)
    return src.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def incremental_bin_counts(reads: DataFrame, binsize: int) -> DataFrame:
    """Bin counts over arriving reads, for ``update`` or ``complete`` output."""
    return reads.groupBy("sample_id", "chrom", F.floor(F.col("pos") / binsize).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def not_duplicates(reads: pd.DataFrame | np.ndarray, last: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """Which of the reads, in order, are counted, and the state after them: last position, mate of the last pair."""
    pos, mate, flag = (np.asarray(reads[c]) for c in ("pos", "mate_pos", "flag"))
    used = (flag & 1 == 0) | (flag & 2 != 0)
    pos, mate, paired = pos[used], mate[used], flag[used] & 1 == 1
    if not len(pos):
        return used, last
    pair = np.maximum.accumulate(np.where(paired, np.arange(len(pos)), -1))  # the last one so far
    before = np.append(-1, pair[:-1])
    same = (pos == np.append(last[0], pos[:-1])) & (~paired | (mate == np.where(before < 0, last[1], mate[before])))
    keep = used.copy()
    keep[used] = ~same
    return keep, (int(pos[-1]), last[1] if pair[-1] < 0 else int(mate[pair[-1]]))


def online_dedup(reads: DataFrame) -> DataFrame:
    """Consecutive-position duplicate removal on a stream of coordinate-sorted reads.

    State per sample and chromosome: position of the last read, and mate position of the last paired one. Paired reads
    that are not proper pass neither into the count nor the state. Reads of one batch may come in any order; those of a
    batch before must not come later than those of the next (``ordered_dedup`` takes disorder between batches too).
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (-1, -1)
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["pos", "read_no"])
        keep, last = not_duplicates(pdf, last)
        state.update(last)
        yield pdf[keep][["sample_id", "chrom", "pos", "mate_pos", "flag", "read_no"]]

    cols = reads.select("sample_id", "chrom", "pos", "mate_pos", "flag", "read_no")
    kind = dict(cols.dtypes)["sample_id"]
    return cols.groupBy("sample_id", "chrom").applyInPandasWithState(run, f"sample_id {kind}, chrom int, pos long, mate_pos long, flag int, read_no long", "pos long, mate long", "append", GroupStateTimeout.NoTimeout)


ORDERED = "sample_id string, chrom int, pos long, mate_pos long, flag int, read_no long, ms long"
#: A waiting read. Reads reach the state and lie in it packed, as rows one by one cost the more.
PACKED = np.dtype([("pos", "<i8"), ("mate_pos", "<i8"), ("flag", "<i4"), ("read_no", "<i8"), ("ms", "<i8")])
NO_MATE = np.iinfo(np.int64).min


def _packing(held_rows: int = 1 << 20):
    """Reads to rows ``sample_id, chrom, reads, ms`` (the last time), one for each chromosome of a sample among ``held_rows`` reads."""

    def pack(t: pa.Table) -> pa.RecordBatch:
        keys, code = {c: t[c].combine_chunks() for c in ("sample_id", "chrom")}, np.zeros(len(t), np.int64)
        for c in keys.values():
            d = c.dictionary_encode()
            code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy()
        reads = np.empty(len(t), PACKED)
        for c in PACKED.names:
            reads[c] = t[c].fill_null(NO_MATE).to_numpy() if c == "mate_pos" else t[c].to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        parts, first = np.split(reads[order], starts[1:]), pa.array(order[starts])
        cols = [*(c.take(first) for c in keys.values()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([p["ms"].max() for p in parts], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["sample_id", "chrom", "reads", "ms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in chain(batches, [None]):
            if b is not None and len(b):
                held.append(b)
            if held and (b is None or sum(map(len, held)) >= held_rows):
                yield pack(pa.Table.from_batches(held).combine_chunks())
                held = []

    return run


class _Ordered(StatefulProcessor):
    """Holds reads back until the watermark has passed them, then judges them in order, cell by cell of event time."""

    def __init__(self, forget_ms: int, cell_ms: int, held_rows: int = 1 << 18):
        self.forget_ms, self.cell_ms, self.held_rows = forget_ms, cell_ms, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cell long, part long", "reads binary")
        self.parts = handle.getValueState("parts", "n long")
        self.last = handle.getValueState("last", "pos long, mate long")

    def _keep(self, reads: np.ndarray, part: int) -> int:
        """Puts reads in state, a part a cell; returns the first time."""
        reads = reads[np.argsort(reads["ms"], kind="stable")]
        cells = reads["ms"] // self.cell_ms
        for own in np.split(np.arange(len(reads)), np.flatnonzero(np.diff(cells)) + 1):
            self.waiting.updateValue((int(cells[own[0]]), part), (reads[own].tobytes(),))
        return int(reads["ms"][0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        part, first, held = self.parts.get()[0] if self.parts.exists() else 0, None, []
        for packed in chain((b for pdf in rows for b in pdf["reads"]), [None]):
            if packed is not None:
                reads = np.frombuffer(packed, PACKED)
                held.append(reads[reads["ms"] > now])
            count = sum(map(len, held))
            if count and (packed is None or count >= self.held_rows):
                at = self._keep(np.concatenate(held), part)
                part, first, held = part + 1, at if first is None else min(first, at), []
        if first is not None:
            self.parts.update((part,))
            self._wake(first)
        return iter(())

    def _wake(self, ms: int) -> None:
        """One timer, at the earliest time asked for."""
        known = [int(t) for t in self.handle.listTimers()]
        if not known or ms < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held: dict[int, list[int]] = {}
        for cell, part in list(self.waiting.keys()):
            held.setdefault(cell, []).append(part)
        if not held:
            self.last.clear()  # nothing came for so long that the state may go
            return
        last, over, wake = self.last.get() if self.last.exists() else (-1, -1), np.empty(0, PACKED), None
        for cell in sorted(held):
            if cell * self.cell_ms > now:
                wake = cell * self.cell_ms
                break
            reads = np.concatenate([np.frombuffer(self.waiting.getValue((cell, p))[0], PACKED) for p in held[cell]])
            rest, due = reads[reads["ms"] > now], reads[reads["ms"] <= now]
            if len(due):
                for p in held[cell]:
                    self.waiting.removeKey((cell, p))
                if len(rest):
                    self.waiting.updateValue((cell, held[cell][0]), (rest.tobytes(),))
            due = np.concatenate((over, due))
            due = due[np.lexsort((due["read_no"], due["pos"]))]
            over = due[len(due) and np.searchsorted(due["pos"], due["pos"][-1]) :]  # this position may go on in the next cell
            due = due[: len(due) - len(over)]
            keep, last = not_duplicates(due, last)
            yield self._rows(key, due[keep])
            if len(rest):
                wake = int(rest["ms"].min())
                break
        keep, last = not_duplicates(over, last)
        yield self._rows(key, over[keep])
        self.last.update(last)
        if wake is None:
            self.parts.clear()
        self.handle.registerTimer(now + self.forget_ms if wake is None else wake)

    def _rows(self, key: tuple, reads: np.ndarray) -> pd.DataFrame:
        mate = reads["mate_pos"]
        if (mate == NO_MATE).any():
            mate = pd.array(mate, "Int64")
            mate[reads["mate_pos"] == NO_MATE] = pd.NA
        # Texts as objects: as a list they may become a chunked array on the way out, which is refused.
        return pd.DataFrame({"sample_id": np.full(len(reads), key[0], object), "chrom": np.full(len(reads), key[1], "int32"), "pos": reads["pos"], "mate_pos": mate, "flag": reads["flag"], "read_no": reads["read_no"], "ms": reads["ms"]})

    def close(self) -> None:
        pass


def ordered_dedup(reads: DataFrame, late: str = "10 minutes", forget: int = 24 * 3600 * 1000, cell: int = 60_000) -> DataFrame:
    """Consecutive-position duplicate removal on a stream whose reads come out of order, between batches as well.

    ``ts`` is the read's event time and never falls while the position in a sample's chromosome grows. Reads wait in
    state until the watermark (``late`` behind the newest ``ts``) has passed them, and are then judged by position and
    ``read_no``, so the result is that of the batch form for every read that is not later than ``late``; those that the
    watermark has passed when they come are dropped. What has been judged leaves the state at once, and the two numbers that remain of a
    sample's chromosome go after ``forget`` milliseconds of event time without a read. Waiting reads are packed by cells
    of ``cell`` milliseconds of event time; a task holds those of one cell of a sample's chromosome at a time. The session
    needs the RocksDB state store.
    """
    kind = dict(reads.dtypes)["sample_id"]
    src = reads.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("chrom").cast("int").alias("chrom"), "pos", "mate_pos", F.col("flag").cast("int").alias("flag"), "read_no", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    packed = src.where("ms is not null").mapInArrow(_packing(), "sample_id string, chrom int, reads binary, ms long").select("sample_id", "chrom", "reads", F.timestamp_millis("ms").alias("ts"))
    out = packed.withWatermark("ts", late).groupBy("sample_id", "chrom").transformWithStateInPandas(_Ordered(forget, cell), ORDERED, "Append", "EventTime")
    return out.select(F.col("sample_id").cast(kind).alias("sample_id"), "chrom", "pos", "mate_pos", "flag", "read_no", F.timestamp_millis("ms").alias("ts"))
