import random

import pytest
from pyspark.sql import functions as F

import binfold.plans.registry  # noqa: F401
from binfold.plans import q_regions
from binfold.sources import regions, tables
from binfold.sources.blocks import BlockReader, list_files

DIR = "/root/testdata/sf0.001"


def bin_by_hand(start, end):
    """The smallest window of the hierarchy that holds an interval, counted level by level from the top."""
    number, found, first = 0, 0, 0
    for level in range(regions.DEPTH + 1):
        wide = 2 ** (regions.SHIFT + 3 * (regions.DEPTH - level))
        if start // wide == (max(end, start + 1) - 1) // wide:
            found = first + start // wide
        number = 8**level
        first += number
    return found


def test_bins(spark):
    rnd = random.Random(1)
    rows = [(s, s + rnd.choice([0, 1, 100, 20_000, 3_000_000, 400_000_000])) for s in (rnd.randint(0, 2**31) for _ in range(300))] + [(0, 2**14), (0, 2**14 + 1), (2**14 - 1, 2**14)]
    df = spark.createDataFrame(rows, "s long, e long").select("s", "e", regions.bin_of(F.col("s"), F.col("e")).alias("b"), regions.bins_over(F.col("s"), F.col("e")).alias("r"))
    for r in df.collect():
        assert r["b"] == bin_by_hand(r["s"], r["e"])
        assert any(x["first"] <= r["b"] <= x["last"] for x in r["r"])


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rnd = random.Random(2)
    rows = []
    for _ in range(6000):
        start = rnd.randint(0, 60_000_000)
        rows.append((rnd.choice([1, 1, 2, 23]), start, start + rnd.choice([1, 50, 20_000, 5_000_000]), f"v{rnd.randint(0, 10**12)}"))
    rows += [rows[0], rows[0], (2, 5, 5, None)]
    path = f"file://{tmp_path_factory.mktemp('x')}/i"
    regions.write_indexed(spark.createDataFrame(rows, "chrom int, start long, end long, v string"), path, ["v"], {"made": "here"}, parts=6)
    return path, rows


def test_regions_equal_a_filter(spark, written):
    path, rows = written
    rnd = random.Random(3)
    asked = [(k, rnd.choice([1, 2, 23, 9]), s, s + rnd.choice([1, 1000, 100_000, 30_000_000])) for k, s in enumerate(rnd.randint(0, 61_000_000) for _ in range(40))] + [(90, 1, 0, 2**31), (91, 1, 5, 5), (92, 2, 5, 6)]
    got = regions.read_regions_of(spark, path, spark.createDataFrame(asked, "region int, chrom int, start long, end long"), 4).collect()
    label = {1: "1", 2: "2", 23: "X"}
    want = sorted((k, label[c], str(s), str(e), v or "NA") for k, rc, a, b in asked if b > a for c, s, e, v in rows if c == rc and s < b and max(e, s + 1) > a)
    assert sorted(map(tuple, got)) == want


def test_a_region_opens_few_files_and_bytes(spark, written):
    path, rows = written
    files = list_files(f"{path}/body", ".gz")
    assert len(files) == 6
    asked = regions.stretches(spark, path, spark.createDataFrame([("a", 2, 30_000_000, 30_010_000)], "region string, chrom int, start long, end long")).collect()
    opened = {r["file"] for r in asked}
    size = {f.rsplit("/", 1)[-1]: n for f, n in files}
    assert 1 <= len(opened) < 6
    places = sum(((r["end"] >> 16) - (r["begin"] >> 16)) for r in asked)
    assert places < sum(size.values()) / 4


def test_files_are_plain_gzip_with_a_header(spark, written):
    path, rows = written
    assert tables.read_tabix(spark, f"{path}/body", 4).count() == len(rows)
    meta = tables.tabix_metadata(spark, f"{path}/body").collect()
    assert len(meta) == 6 and {(r["key"], r["value"]) for r in meta} == {("made", "here")}
    reader = BlockReader(list_files(f"{path}/body", ".gz")[0][0])
    assert b"".join(x for _, x in reader.blocks(0, reader.size)).startswith(b"##RWX_made=here\n")


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    regions.write_indexed(spark.createDataFrame([], "chrom int, start long, end long"), path, [])
    assert regions.read_regions_of(spark, path, q_regions.regions(spark), 3).count() == 0
