"""Steps whose memory or time must not grow faster than their input: plans without a shuffle of rows, and equal results."""

import re

import pytest

from binfold.operators import reads as R
from binfold.plans import registry  # noqa: F401
from binfold.plans.q_sources import by_sample
from binfold.sources import tables


def test_fasta_lines_are_not_shuffled(spark, tmp_path):
    """Names and offsets run on over batches and splits, and no window takes the lines of a split."""
    lines = ["ACGT", ">chr1 one", "ACGTA", "", "CC", ">chr2", ">chr3", "GGGG", "T", ">", "AC"]
    (tmp_path / "a.fa").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.fa").write_text(">chr9\nTT\nA\n")
    want = [(None, 0, "ACGT"), ("1", 0, "ACGTA"), ("1", 5, "CC"), ("3", 0, "GGGG"), ("3", 4, "T"), ("", 0, "AC"), ("9", 0, "TT"), ("9", 2, "A")]
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    old = [spark.conf.get(k) for k in keys]
    try:
        for size, batch in (("4", "1"), ("9", "2"), ("1000000", "3"), ("1000000", "10000")):
            spark.conf.set(keys[0], size), spark.conf.set(keys[1], batch)
            found = tables.read_fasta(spark, str(tmp_path))
            assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(f#" in plan and not re.search(r"windowspecdefinition\(f#\d+, split#\d+L?, ", plan)


def test_depth_events_travel_packed(spark):
    """Reads of few cells reach the shuffle as few rows, CIGARs are not walked by lambdas, and rows without a place count nowhere."""
    df = spark.range(30_000).selectExpr("1 AS sample_id", "'7' AS chrom", "id * 7 % 200000 AS pos", "'50M3D20M' AS cigar")
    odd = spark.createDataFrame([(1, "7", None, "9M"), (1, "7", 5, None), (1, "7", 300_000, "0M5N"), (2, None, 70_000, "140000M")], "sample_id int, chrom string, pos long, cigar string")
    found = R.depth(df.unionByName(odd), "gaps").orderBy("sample_id")
    got = [tuple(r)[:6] for r in found.collect()]
    covered: dict[int, int] = {}
    for i in range(30_000):
        at = i * 7 % 200_000
        for p in (*range(at, at + 50), *range(at + 53, at + 73)):
            covered[p] = covered.get(p, 0) + 1
    assert got == [(1, "7", len(covered), 30_000 * 70, min(covered.values()), max(covered.values())), (2, None, 140_000, 140_000, 1, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "Generate" not in plan and "Exchange hashpartitioning(sample_id" in plan
    packed = R.covered_blocks(df, "gaps").coalesce(1).mapInArrow(R._packed(1 << 16), "sample_id int, chrom string, cell long, first binary, last binary")
    assert packed.count() == 4


def test_a_line_is_split_once_and_conditions_are_worked_out_once(spark, tmp_path):
    (tmp_path / "a.sam").write_text("".join(f"q{i}\t{16 * (i % 2)}\tchr1\t{i + 1}\t{i % 60}\t10M\t*\t0\t0\t{'A' * 10}\t*\tNM:i:2\n" for i in range(50)))
    found = R.alignment_stats(tables.read_sam(spark, str(tmp_path)), mapq=5)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x and "split(" in x]
    assert not [x for x in plan if "HashAggregate" in x and "flag#" in x]
    got = found.first()
    assert (got["sample_id"], got["filtered_sequences"], got["sequences"], got["bases_mapped_cigar"], got["mismatches_from_nm"]) == ("a", 5, 45, 450, 90)
    (tmp_path / "b.sam").write_text("q\t0\tchr1\n")
    with pytest.raises(Exception, match="malformed alignment line of sample b: fewer than 11 columns"):
        tables.read_sam(spark, str(tmp_path)).groupBy("chrom").count().collect()


def test_a_large_sample_is_written_by_several_tasks(spark, tmp_path):
    lines = spark.range(40_000, numPartitions=4).selectExpr("CAST(id % 40 = 0 AS INT) AS sample_id", "sha2(CAST(id AS STRING), 256) AS value")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "200000")
        by_sample(lines).write.partitionBy("sample_id").text(str(tmp_path / "t"))
    finally:
        spark.conf.set(key, old)
    assert len(list((tmp_path / "t" / "sample_id=0").glob("*.txt"))) > 2
    back = spark.read.text(str(tmp_path / "t"))
    assert back.count() == 40_000 and back.exceptAll(lines.select("value", "sample_id")).isEmpty()
