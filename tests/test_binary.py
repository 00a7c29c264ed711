import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import binfold.plans.registry  # noqa: F401
from binfold.plans import data, q_binary
from binfold.sources import bam
from binfold.sources.blocks import MAGIC, BlockReader, BlockWriter, block, block_size

DIR = "/root/testdata/sf0.001"


def write(path, rows, refs=(("1", 10_000_000), ("23", 5_000_000)), filler=b""):
    head = bam.BAM + struct.pack("<i", len(filler)) + filler + struct.pack("<i", len(refs))
    for k, n in refs:
        name = f"chr{k}".encode() + b"\0"
        head += struct.pack("<i", len(name)) + name + struct.pack("<i", n)
    out = BlockWriter(open(path, "wb"))
    out.write(head)
    for r in rows:
        out.write(bam._record(r, {k: i for i, (k, _) in enumerate(refs)}))
    out.close()


def made(seed, n, longest=300):
    rnd = random.Random(seed)
    return [
        {"name": f"r{rnd.randint(0, 10**9)}", "chrom": rnd.choice(["1", "23", "*"]), "pos": rnd.randint(0, 4_999_999), "flag": rnd.choice([0, 16, 1024, 99, 4]), "mapq": rnd.randint(0, 60), "cigar": rnd.choice([[], ["50", "M"], ["20", "M", "3", "D", "30", "M"]]), "mate_chrom": rnd.choice(["1", "*"]), "mate_pos": rnd.randint(0, 9), "seq_len": rnd.choice([0, 50, longest]), "nm": rnd.randint(0, 9)}
        for _ in range(n)
    ]


def splits(path, size):
    total = BlockReader(path).size
    return [list(bam.read_split(path, "s", b, min(total, b + size))) for b in range(0, total, size)]


def rows_of(parts):
    return [r for p in parts for b in p for r in b.to_pylist()]


@pytest.mark.parametrize("size", [700, 5_000, 40_000, 1 << 30])
@pytest.mark.parametrize("seed, longest", [(1, 300), (2, 200_000)])
def test_every_record_is_read_once(tmp_path, size, seed, longest):
    """Whatever the splits, also where records are longer than blocks and than splits."""
    rows = made(seed, 1200 if longest < 1000 else 60, longest)
    path = str(tmp_path / "s.bam")
    write(path, rows, filler=b"@CO\t" + random.Random(5).randbytes(3000).hex().encode())
    if BlockReader(path).size // size > 400:
        size = BlockReader(path).size // 400 + 1
    got = rows_of(splits(path, size))
    want = [(r["flag"], r["chrom"], r["pos"], r["mapq"], "".join(r["cigar"]) or "*", r["mate_chrom"], r["mate_pos"], r["seq_len"], r["nm"]) for r in rows]
    assert [(r["flag"], r["chrom"], r["pos"], r["mapq"], r["cigar"], r["mate_chrom"], r["mate_pos"], r["seq_len"], r["nm"]) for r in got] == want
    places = [r["read_no"] for r in got]
    assert places == sorted(set(places))


def test_false_block_marks_are_passed_over(tmp_path):
    """A stored block that holds the first bytes of another block."""
    fake = block(b"x" * 100)
    path = tmp_path / "f"
    noise = fake[:18] + np.random.default_rng(1).bytes(20000)
    path.write_bytes(block(noise, level=0) + block(b"second") + block(b""))
    r = BlockReader(str(path))
    first = block_size(path.read_bytes())
    assert path.read_bytes().count(MAGIC) == 4 and r.first_block(1) == first and r.inflate(first)[0] == b"second"
    assert r.first_block(r.size - 3) == r.size


def test_damaged_files_raise(tmp_path):
    path = str(tmp_path / "s.bam")
    write(path, made(3, 2000))
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[: len(whole) // 2])
    with pytest.raises(ValueError):
        splits(path, 1 << 30)
    open(path, "wb").write(whole[:3000] + b"\0\0\0\0" + whole[3004:])
    with pytest.raises(Exception):
        splits(path, 1 << 30)
    open(path, "wb").write(block(b"no alignments at all"))
    with pytest.raises(ValueError):
        splits(path, 1 << 30)


def test_empty_file_and_tags(tmp_path):
    path = str(tmp_path / "s.bam")
    write(path, [])
    assert rows_of(splits(path, 50)) == []
    tags = b"XAZabc\0" + b"XBBi" + struct.pack("<I3i", 3, 1, 2, 3) + b"XCf" + struct.pack("<f", 1) + b"XDAq"
    assert bam._mismatches(tags) == 0 and bam._mismatches(tags + b"NMC\x07") == 7 and bam._mismatches(b"NMs\x05\x00" + tags) == 5


def test_scan_runs_in_several_tasks(spark):
    path = q_binary._folder(spark, "bam")
    reads = data.reads(spark, DIR).withColumn("name", F.col("l_orderkey")).withColumn("sample_id", F.lit(5))
    bam.write_bam(reads, data.lengths(spark), path, parts=1)
    got = bam.read_bam(spark, path, 1 << 14)
    assert got.rdd.getNumPartitions() >= 4
    per_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] > 0 for r in per_task) >= 4 and sum(r["count"] for r in per_task) == reads.count()
    assert {r["sample_id"] for r in got.select("sample_id").distinct().collect()} == {"5"}


def test_batches_of_records_equal_single_ones(monkeypatch):
    monkeypatch.setattr(bam, "PIECE", 5_000)
    rows, refs = made(7, 500), {"1": 0, "23": 1}
    batch = pa.RecordBatch.from_pylist([r | {"cigar": "".join(r["cigar"]) or "*", "name": None if i % 50 == 0 else r["name"]} for i, r in enumerate(rows)])
    want = b"".join(bam._record(r | {"name": None if i % 50 == 0 else r["name"]}, refs) for i, r in enumerate(rows))
    got = list(bam._records(batch, refs))
    assert len(got) > 5 and b"".join(got) == want
    for bad in ({"mapq": 256}, {"flag": 70_000}, {"pos": 1 << 31}, {"nm": None}, {"name": "n" * 255}):
        with pytest.raises(ValueError):
            list(bam._records(pa.RecordBatch.from_pylist([batch.slice(0, 1).to_pylist()[0] | bad]), refs))


def test_the_first_record_is_found_without_judging_all_places(monkeypatch):
    refs, lengths, judged = {"1": 0, "23": 1}, np.array([10_000_000, 5_000_000]), []
    data = b"\x07" * 40 + b"".join(bam._record(r, refs) for r in made(8, 3000))
    plausible = bam._plausible
    monkeypatch.setattr(bam, "_plausible", lambda d, at, n: judged.append(len(at)) or plausible(d, at, n))
    assert bam.find_record(data, lengths, False) == 40 and sum(judged) < 2_000 < len(data)


def test_small_splits_grow_with_the_files(tmp_path):
    path = str(tmp_path / "s.bam")
    write(path, made(9, 3000))
    size = BlockReader(path).size
    few = bam.plan_splits(path, size // 100, 4)
    assert len(bam.plan_splits(path, size // 100)) >= 100 and len(few) in (4, 5) and len(bam.plan_splits(path, size // 2 + 1, 4)) == 2
    assert [s.begin for s in few] == [0, *(s.end for s in few[:-1])] and few[-1].end == size
    assert len(rows_of([list(bam.read_split(s.path, s.sample, s.begin, s.end)) for s in few])) == 3000
