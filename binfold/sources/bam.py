"""Binary alignments as a Spark data source, read in splits that begin inside of files, and their writer.

    spark.dataSource.register(BamSource)
    spark.read.format("binfold_bam").load(path)

A split is a range of compressed bytes. Its task looks for the first block in the range, then for the first record in
that block's data: a place from which several records in a row are plausible. It returns the records that begin in its
blocks, the last of which may end in the next split's. So a file of any size is read by many tasks without an index.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from binfold.sources import storage
from binfold.sources.blocks import BlockReader, BlockWriter, list_files, locate

SCHEMA = "sample_id string, read_no long, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, seq_len int, nm int, strand string"
#: Fixed values of the format: file mark, letters of CIGAR operations and bases, bytes of the tag types.
BAM, CIGAR_OPS, BASES = b"BAM\x01", "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
TAG_BYTES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
TAG_NUMBER = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I"}
_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("span", "<i4")])
#: Records in a row that must be plausible where a split begins, places that are judged together, and bytes of data decoded or written together.
IN_A_ROW, PLACES, CHUNK, PIECE = 12, 1 << 10, 4 << 20, 1 << 20
#: Compressed bytes up to which a split grows where there are many.
WIDEST = 64 << 20


def _key(name: str) -> str:
    bare = (name[3:] if name[:3].lower() == "chr" else name).upper()
    return {"X": "23", "Y": "24"}.get(bare, bare)


def read_header(reader: BlockReader) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, references with lengths, and the place of the first record."""
    data, starts = bytearray(), []
    blocks = reader.blocks(0, reader.size)

    def need(n: int) -> None:
        while len(data) < n:
            at, more = next(blocks, (None, b""))
            if at is None:
                raise ValueError("the header is cut off")
            starts.append((len(data), at))
            data.extend(more)

    need(12)
    if data[:4] != BAM:
        raise ValueError("not a binary alignment file")
    text = struct.unpack_from("<i", data, 4)[0]
    need(12 + text)
    at, refs = 12 + text, []
    for _ in range(struct.unpack_from("<i", data, 8 + text)[0]):
        need(at + 4)
        n = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + n)
        refs.append((bytes(data[at + 4 : at + 3 + n]).decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
        at += 8 + n
    first = max((s for s in starts if s[0] <= at), key=lambda s: s[0])
    return bytes(data[8 : 8 + text]).rstrip(b"\0").decode(), refs, first[1] << 16 | at - first[0]


def _plausible(data: bytes, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a record may begin at each place (all have 36 bytes after them)."""
    raw = np.frombuffer(data, np.uint8)
    f = np.lib.stride_tricks.as_strided(raw, (len(raw) - 35, 36), (1, 1))[at].view(_FIXED).reshape(-1)
    most = np.append(lengths, 0)  # reference -1 takes the last
    ok = np.ones(len(f), bool)
    for ref, pos in (("ref", "pos"), ("mate", "mate_pos")):
        known = (f[ref] >= -1) & (f[ref] < len(lengths))
        ok &= known & (f[pos] >= -1) & ((f[ref] < 0) | (f[pos] <= most[np.where(known, f[ref], -1)]))
    least = 32 + f["name"].astype(np.int64) + 4 * f["ops"].astype(np.int64) + (f["seq"].astype(np.int64) + 1) // 2 + f["seq"]
    ok &= (f["name"] > 1) & (f["seq"] >= 0) & (f["size"] >= least)
    last = at + 35 + f["name"]
    inside = last < len(raw)
    ok[inside] &= raw[last[inside]] == 0
    return ok


def _places(data: bytes, lengths: np.ndarray) -> Iterator[int]:
    """Plausible places in order; the first is mostly near, so few are judged at a time."""
    for lo in range(0, len(data) - 35, PLACES):
        places = np.arange(lo, min(lo + PLACES, len(data) - 35))
        yield from places[_plausible(data, places, lengths)].tolist()


def find_record(data: bytes, lengths: np.ndarray, whole: bool) -> int | None:
    """First place of ``data`` where records begin; None if more data is needed to tell, -1 if there is none.

    ``whole``: the file ends with the data.
    """
    if len(data) < 36:
        return -1 if whole else None
    for at in _places(data, lengths):
        n, end = 0, at
        while n < IN_A_ROW:
            if end == len(data) and whole:
                return at
            if end + 36 > len(data):
                if not whole:
                    return None
                break
            if not _plausible(data, np.array([end]), lengths)[0]:
                break
            end += 4 + struct.unpack_from("<i", data, end)[0]
            n += 1
        if n == IN_A_ROW:
            return at
    return -1 if whole else None


def _mismatches(tags: bytes) -> int:
    """The NM tag, 0 without one."""
    at = 0
    while at + 3 <= len(tags):
        kind = tags[at + 2 : at + 3]
        if tags[at : at + 2] == b"NM" and kind in TAG_NUMBER:
            return struct.unpack_from(TAG_NUMBER[kind], tags, at + 3)[0]
        if kind in (b"Z", b"H"):
            at = tags.index(b"\0", at + 3) + 1
        elif kind == b"B":
            at += 8 + TAG_BYTES[tags[at + 3 : at + 4]] * struct.unpack_from("<I", tags, at + 4)[0]
        else:
            at += 3 + TAG_BYTES[kind]
    return 0


def _decode(data: bytes, at: np.ndarray, places: np.ndarray, sample: str, names: np.ndarray) -> pa.RecordBatch:
    raw = np.frombuffer(data, np.uint8)
    f = np.lib.stride_tricks.as_strided(raw, (len(raw) - 35, 36), (1, 1))[at].view(_FIXED).reshape(-1)
    ops_at = at + 36 + f["name"]
    tags_at = ops_at + 4 * f["ops"].astype(np.int64) + (f["seq"] + 1) // 2 + f["seq"]
    known: dict[bytes, str] = {b"": "*"}
    cigar, nm = [], []
    for o, n, t, end in zip(ops_at.tolist(), f["ops"].tolist(), tags_at.tolist(), (at + 4 + f["size"]).tolist()):
        code = data[o : o + 4 * n]
        if code not in known:
            known[code] = "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for x in struct.unpack(f"<{n}I", code))
        cigar.append(known[code])
        nm.append(_mismatches(data[t:end]))
    columns = [
        pa.array([sample] * len(at)), pa.array(places), pa.array(f["flag"].astype(np.int32)), pa.array(names[f["ref"]].tolist(), pa.string()), pa.array(f["pos"].astype(np.int64)), pa.array(f["mapq"].astype(np.int32)), pa.array(cigar, pa.string()),
        pa.array(names[f["mate"]].tolist(), pa.string()), pa.array(f["mate_pos"].astype(np.int64)), pa.array(f["seq"].astype(np.int32)), pa.array(nm, pa.int32()), pa.array(np.where(f["flag"] & 16, "-", "+").tolist(), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def read_split(path: str, sample: str, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """Records that begin in the blocks of a range of compressed bytes."""
    reader = BlockReader(path)
    try:
        _, refs, first = read_header(reader)
        if end <= first >> 16:
            return
        lengths = np.array([n for _, n in refs], np.int64)
        names = np.array([*(_key(n) for n, _ in refs), "*"], object)
        headed = begin <= first >> 16
        start = first >> 16 if headed else reader.first_block(begin)
        if start >= min(end, reader.size):
            return
        data, blocks, at = b"", [], start
        skip: int | None = first & 0xFFFF if headed else None
        while True:
            # Blocks of the split as long as there are any; behind its end only what the last record lacks.
            own = at < min(end, reader.size)
            if own or (data and at < reader.size):
                more, after = reader.inflate(at)
                blocks.append((len(data), at))
                data, at = data + more, after
                if own and at < min(end, reader.size) and len(data) < CHUNK:
                    continue
            whole = at >= reader.size
            limit = next((p for p, b in blocks if b >= end), len(data))
            if skip is None:
                skip = find_record(data, lengths, whole)
                if skip is None and limit == len(data):
                    continue
                if skip is None or skip < 0 or skip >= limit:
                    if skip is None and not whole:
                        continue
                    return
            found, here = [], skip
            while here < limit and here + 4 <= len(data):
                size = struct.unpack_from("<i", data, here)[0]
                if here + 4 + size > len(data):
                    break
                found.append(here)
                here += 4 + size
            if found:
                place = np.array(found)
                offsets = np.array([p for p, _ in blocks])
                inside = np.searchsorted(offsets, place, side="right") - 1
                yield _decode(data, place, np.array([b for _, b in blocks])[inside] << 16 | place - offsets[inside], sample, names)
            if here >= limit and limit < len(data) or here >= limit and at >= min(end, reader.size):
                return
            if whole:
                if here < len(data):
                    raise ValueError(f"{path}: the last record is cut off")
                return
            # Keep the blocks of the record that is not whole yet.
            stays = max((k for k, (p, _) in enumerate(blocks) if p <= here), default=0)
            cut = blocks[stays][0]
            blocks, data, skip = [(p - cut, b) for p, b in blocks[stays:]], data[cut:], here - cut
    finally:
        reader.close()


@dataclass
class BamSplit(InputPartition):
    path: str
    sample: str
    begin: int
    end: int


def plan_splits(path: str, split_bytes: int, tasks: int | None = None) -> list[BamSplit]:
    """Ranges of all files below a path; a file's sample is its folder ``sample_id=<sample>``, else its stem.

    With more data than ``tasks`` splits hold, splits grow up to ``WIDEST`` bytes: a task costs more than a small split.
    """
    files = list_files(path, ".bam")
    if tasks:
        split_bytes = max(split_bytes, min(WIDEST, sum(size for _, size in files) // tasks))
    out = []
    for file, size in files:
        folder = file.split("/")[-2] if "/" in file else ""
        sample = folder[10:] if folder.startswith("sample_id=") else file.split("/")[-1].removesuffix(".bam")
        out += [BamSplit(file, sample, b, min(size, b + split_bytes)) for b in range(0, size, split_bytes)]
    return out


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split_bytes = options["path"], int(options.get("splitbytes", WIDEST))
        self.tasks = int(options["tasks"]) if "tasks" in options else None

    def partitions(self) -> list[InputPartition]:
        return plan_splits(self.path, self.split_bytes, self.tasks)

    def read(self, partition: BamSplit) -> Iterator[pa.RecordBatch]:
        yield from read_split(partition.path, partition.sample, partition.begin, partition.end)


class BamSource(DataSource):
    """Options: ``path``, a file or folder that executors can open; ``splitBytes``, compressed bytes a task reads; ``tasks``, beyond which splits grow."""

    @classmethod
    def name(cls) -> str:
        return "binfold_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, split_bytes: int = WIDEST) -> DataFrame:
    """Reads of binary alignments with the columns of ``read_sam``; ``read_no`` is the record's place in its file.

    Splits smaller than ``WIDEST`` grow where they would make more than eight tasks a core.
    """
    spark.dataSource.register(BamSource)
    return spark.read.format("binfold_bam").option("splitBytes", split_bytes).option("tasks", 8 * spark.sparkContext.defaultParallelism).load(path)


def bam_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, chrom, length`` from the headers, one task per file."""
    files = [(s.path, s.sample) for s in plan_splits(path, 1 << 62)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, sample in zip(*(c.to_pylist() for c in b.columns)):
                reader = BlockReader(file)
                rows += [(sample, _key(n), size) for n, size in read_header(reader)[1]]
                reader.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["sample_id", "chrom", "length"])

    if not files:
        return spark.createDataFrame([], "sample_id string, chrom string, length long")
    return spark.createDataFrame(files, "file string, sample_id string").repartition(len(files)).mapInArrow(run, "sample_id string, chrom string, length long")


def _record(row: dict, refs: dict[str, int]) -> bytes:
    ops = [(int(n) << 4) | CIGAR_OPS.index(o) for n, o in zip(row["cigar"][::2], row["cigar"][1::2])]
    name = (row["name"] or "*").encode() + b"\0"
    ref, mate = refs.get(row["chrom"], -1), refs.get(row["mate_chrom"], -1)
    body = struct.pack("<iiBBHHHiiii", ref, row["pos"], len(name), row["mapq"], 0, len(ops), row["flag"], row["seq_len"], mate, row["mate_pos"], 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + b"\x11" * ((row["seq_len"] + 1) // 2) + b"\xff" * row["seq_len"] + b"NMi" + struct.pack("<i", row["nm"])
    return struct.pack("<i", len(body)) + body


def _records(batch: pa.RecordBatch, refs: dict[str, int]) -> Iterator[bytes]:
    """Records of a batch of reads with their CIGAR as text, as ``_record`` makes them one by one; in pieces of about ``PIECE`` bytes."""
    col = {n: batch.column(n).to_pylist() for n in ("name", "chrom", "mate_chrom", "cigar")}
    limits = {"pos": (-(1 << 31), 1 << 31), "flag": (0, 1 << 16), "mapq": (0, 1 << 8), "mate_pos": (-(1 << 31), 1 << 31), "seq_len": (0, 1 << 31), "nm": (-(1 << 31), 1 << 31)}
    number = {}
    for n, (lo, hi) in limits.items():
        v = batch.column(n)
        number[n] = v.to_numpy(zero_copy_only=False)
        if v.null_count or len(v) and not (lo <= number[n].min() and number[n].max() < hi):
            raise ValueError(f"{n} has values that the format cannot hold")
    ops = {}
    for c in set(col["cigar"]):
        found = [] if c == "*" else re.findall(r"\d+|[MIDNSHP=X]", c)
        ops[c] = b"".join(struct.pack("<I", int(n) << 4 | CIGAR_OPS.index(o)) for n, o in zip(found[::2], found[1::2]))
    names = [(n or "*").encode() + b"\0" for n in col["name"]]
    cigars = [ops[c] for c in col["cigar"]]
    f = np.zeros(len(names), _FIXED)
    name_bytes, cigar_bytes = np.array([len(n) for n in names], np.int64), np.array([len(c) for c in cigars], np.int64)
    if len(names) and (name_bytes.max() > 255 or cigar_bytes.max() > 4 * 65535):
        raise ValueError("a name or CIGAR is longer than the format can hold")
    size = 39 + name_bytes + cigar_bytes + (number["seq_len"].astype(np.int64) + 1) // 2 + number["seq_len"]
    f["ref"], f["mate"] = [refs.get(c, -1) for c in col["chrom"]], [refs.get(c, -1) for c in col["mate_chrom"]]
    for to, own in (("pos", "pos"), ("mapq", "mapq"), ("flag", "flag"), ("seq", "seq_len"), ("mate_pos", "mate_pos")):
        f[to] = number[own]
    f["size"], f["name"], f["ops"] = size, name_bytes, cigar_bytes // 4
    fixed, tags = f.tobytes(), number["nm"].astype("<i4").tobytes()
    parts, held = [], 0
    for i, (name, cigar, n) in enumerate(zip(names, cigars, number["seq_len"].tolist())):
        parts += (fixed[36 * i : 36 * i + 36], name, cigar, b"\x11" * ((n + 1) // 2), b"\xff" * n, b"NMi", tags[4 * i : 4 * i + 4])
        held += n + n // 2 + 64
        if held > PIECE:
            yield b"".join(parts)
            parts, held = [], 0
    yield b"".join(parts)


def write_bam(reads: DataFrame, lengths: DataFrame, path: str, parts: int | None = None) -> None:
    """Reads as files ``sample_id=<sample>/part-<k>.bam`` in genome order; ``lengths`` is the header (a row per chromosome).

    ``reads``: ``sample_id, name, chrom, pos, flag, mapq, cigar, mate_chrom, mate_pos, seq_len, nm``; sequences are
    written as A. Each task writes ranges of whole samples' order under a draft name; the driver moves the drafts of
    tasks that came through, so retries leave nothing that a reader would see.
    """
    spark = reads.sparkSession
    refs = [(str(r["chrom"]), r["length"]) for r in lengths.orderBy("chrom").select("chrom", "length").collect()]
    label = lambda k: {"23": "X", "24": "Y"}.get(k, k)
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:chr{label(k)}\tLN:{n}\n" for k, n in refs)
    head = BAM + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs))
    for k, n in refs:
        name = f"chr{label(k)}".encode() + b"\0"
        head += struct.pack("<i", len(name)) + name + struct.pack("<i", n)
    index = {k: i for i, (k, _) in enumerate(refs)}
    drafts = f"{path.rstrip('/')}/_drafts"
    storage.make_folder(spark, drafts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_for, out, file = [], None, None, ""
        for b in batches:
            at = 0
            for sample, own in itertools.groupby(b.column("sample_id").to_pylist()):
                n = sum(1 for _ in own)
                if sample != open_for:
                    if out:
                        out.close()
                        done.append((open_for, file))
                    open_for, file = sample, f"{drafts}/{uuid.uuid4().hex}.bam"
                    system, inner = locate(file)
                    out = BlockWriter(system.open_output_stream(inner))
                    out.write(head)
                for piece in _records(b.slice(at, n), index):
                    out.write(piece)
                at += n
        if out:
            out.close()
            done.append((open_for, file))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["sample_id", "file"])

    rows = reads.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("name").cast("string").alias("name"), F.col("chrom").cast("string").alias("chrom"), "pos", "flag", "mapq", "cigar", F.col("mate_chrom").cast("string").alias("mate_chrom"), "mate_pos", "seq_len", "nm")
    order = ["sample_id", F.col("chrom").try_cast("int").asc_nulls_last(), "pos"]
    rows = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    files = sorted(map(tuple, rows.sortWithinPartitions(*order).mapInArrow(run, "sample_id string, file string").collect()))
    for k, (sample, file) in enumerate(files):
        storage.move(spark, file, f"{path.rstrip('/')}/sample_id={sample}/part-{k:05d}.bam")
    storage.delete(spark, drafts)
