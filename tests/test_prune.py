import random

import pytest

from binfold.operators import cohort
from binfold.operators.bins import chromosome_totals, fractions
from binfold.operators.chi import chi_correct, chi_profile
from binfold.plans.workflows import save_in_checkpoints


def again_from_the_start(bins, cutoff, least):
    """The same rounds with everything computed anew from the bins of the members that are left."""
    now, out, n = bins, [], bins.select("sample_id").distinct().count()
    while True:
        frac = fractions(chromosome_totals(chi_correct(now, chi_profile(now)))).where("chrom <= 22")
        flagged = sorted(r[0] for r in cohort.outlier_samples(cohort.diagnose(frac, cutoff)).select("sample_id").collect())
        if not flagged or n - len(flagged) < least:
            return out, "min_controls" if flagged else "no_flagged_samples"
        out.append(flagged)
        n -= len(flagged)
        now = now.where(~now["sample_id"].isin(flagged))


@pytest.mark.parametrize("seed, cutoff, least", [(1, 2.2, 5), (2, 2.6, 5), (3, 1.9, 10)])
def test_rounds_equal_recomputing(spark, seed, cutoff, least):
    rnd = random.Random(seed)
    depth = [rnd.uniform(0.5, 2) for _ in range(16)]
    rows = []
    for c in (1, 2, 3, 22, 23):
        for b in range(12):
            wild = 0.6 if (c * 12 + b) % 17 == 0 else 0.03
            rows += [(f"s{s:02d}", c, b, int(1000 * depth[s] * max(0.0, rnd.gauss(1, wild)) * (1.3 if s == 4 and c == 2 else 1.1 if s == 9 and c == 3 else 1))) for s in range(16)]
    bins = spark.createDataFrame(rows, "sample_id string, chrom int, bin int, n long")
    kept, log = cohort.prune(bins, z_cutoff=cutoff, min_controls=least, save=save_in_checkpoints(spark))
    dropped, stop = again_from_the_start(bins, cutoff, least)
    assert [x["dropped"] for x in log if x["dropped"]] == dropped and log[-1]["stop"] == stop
    gone = {s for d in dropped for s in d}
    assert {r["sample_id"] for r in kept.select("sample_id").distinct().collect()} == {f"s{s:02d}" for s in range(16)} - gone
    assert kept.count() == len(rows) - 60 * len(gone)


def test_members_without_reads(spark):
    rows = [(f"s{s}", c, b, 0 if s == 0 else 100 + (s * b * c) % 7) for s in range(6) for c in (1, 2) for b in range(5)]
    bins = spark.createDataFrame(rows, "sample_id string, chrom int, bin int, n long")
    kept, log = cohort.prune(bins, z_cutoff=9.0, min_controls=2, save=save_in_checkpoints(spark))
    assert log[-1]["stop"] == "no_flagged_samples" and kept.count() == len(rows)
