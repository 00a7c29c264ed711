import random
import re

import pytest

from binfold.operators import reads as R

REFERENCE, ALIGNED = "MDN=X", "M=X"


def brute(rows, spans):
    out = {}
    for sample, chrom, pos, size, cigar in rows:
        at = pos
        ops = [(int(n), k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", cigar)] if spans != "length" else [(size, "M")]
        for n, k in ops:
            if k in (ALIGNED if spans == "gaps" else REFERENCE):
                for p in range(at, at + n):
                    out.setdefault((sample, chrom), {}).setdefault(p, 0)
                    out[sample, chrom][p] += 1
            at += n if k in REFERENCE else 0
    return {k: (len(v), sum(v.values()), min(v.values()), max(v.values())) for k, v in out.items() if v}


@pytest.mark.parametrize("spans", ["length", "whole", "gaps"])
@pytest.mark.parametrize("cell", [7, 100, 1 << 16])
def test_depth_equals_counting_bases(spark, spans, cell):
    rnd = random.Random(cell)
    cigars = ["50M", "10M3D20M", "5S20M400N20M2S", "*", "3H10=1X5I9M2P4M", "12D", "1M1I1M1D1M"]
    rows = [(rnd.choice("ab"), rnd.choice([1, 2]), rnd.randint(0, 900), rnd.choice([0, 1, 60]), rnd.choice(cigars)) for _ in range(150)]
    df = spark.createDataFrame(rows, "sample_id string, chrom int, pos long, seq_len int, cigar string")
    got = {(r["sample_id"], r["chrom"]): (r["length"], r["bases"], r["min"], r["max"]) for r in R.depth(df, spans, cell).collect()}
    assert got == brute(rows, spans)


def test_summary_counts_uncovered_bases(spark):
    df = spark.createDataFrame([("a", 1, 0, 10, "10M"), ("a", 1, 5, 5, "5M"), ("b", 2, 3, 4, "4M")], "sample_id string, chrom int, pos long, seq_len int, cigar string")
    lengths = spark.createDataFrame([(1, 10), (2, 20)], "chrom int, length long")
    got = {(r["sample_id"], r["chrom"]): (r["length"], r["bases"], r["min"], r["max"], r["mean"]) for r in R.coverage_summary(df, lengths).collect()}
    assert got == {("a", "1"): (10, 15, 1, 2, 1.5), ("a", "2"): (20, 0, 0, 0, 0.0), ("a", "total"): (30, 15, 0, 2, 0.5), ("b", "1"): (10, 0, 0, 0, 0.0), ("b", "2"): (20, 4, 0, 1, 0.2), ("b", "total"): (30, 4, 0, 1, pytest.approx(4 / 30))}
    with pytest.raises(ValueError):
        R.covered_blocks(df, "other")


def test_no_window_holds_a_chromosome(spark):
    """Cells hold their own events; a million reads at different places leave none of them large."""
    df = spark.range(100_000).selectExpr("1 AS sample_id", "1 AS chrom", "id * 30 AS pos", "100 AS seq_len", "'100M' AS cigar")
    seg = R.depth_segments(R.covered_blocks(df, "gaps"))
    assert seg.agg({"len": "sum"}).first()[0] == 99_999 * 30 + 100
    plan = seg._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "windowspecdefinition(" in line:
            keys = line.split("windowspecdefinition(", 1)[1]
            assert "cell#" in keys
