"""Every query of the engine that has SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from binfold.plans import data, registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def ask(spark, name: str) -> list:
    return registry.QUERIES[name](spark, DIR).collect()


def test_every_query_without_sql_has_a_test_here():
    assert set(registry.QUERIES) - set(registry.ORACLES) == set(CHECKS)


def check_shapiro(rows, duck):
    assert rows and all(0 <= v <= 1 for r in rows for k, v in r.asDict().items() if k.endswith("_p") or k == "p" if v is not None and not math.isnan(v))


def check_cutoff(rows, duck):
    """The cutoff parts the thinned half of the samples from the other."""
    y = duck.execute(registry.ORACLES["k05_y_fraction"]).fetchdf().set_index("sample_id")["y_frac"]
    assert max(v for k, v in y.items() if k % 2 == 0) <= rows[0]["cutoff"] <= min(v for k, v in y.items() if k % 2)


def check_ratio(rows, duck):
    bins = duck.execute(registry.ORACLES["k09_branch_matrix"]).fetchdf()
    assert {(r["chrom"], r["bin"]) for r in rows} == set(zip(bins["chrom"], bins["bin"]))
    assert sorted(r["masked_idx"] for r in rows) == list(range(len(rows))) and 0.8 < np.median([r["first"] for r in rows]) < 1.2


def check_outliers(rows, duck):
    assert len({r["masked_idx"] for r in rows}) == len(rows) and all(r["d"] > 0 for r in rows)


def check_loess(rows, duck):
    assert len(rows) == duck.execute(f"{data.BASE} SELECT count(*) FROM dense").fetchone()[0]
    assert all(r["corrected"] >= 0 and (r["n"] > 0 or r["corrected"] == 0) for r in rows)
    assert abs(sum(r["corrected"] for r in rows) / sum(r["n"] for r in rows) - 1) < 0.2


def check_regression(rows, duck):
    used = {}
    for r in rows:
        chroms = [int(p.split(":")[0]) for p in r["predictors"]]
        assert r["focus"] in (13, 18, 21) and not set(chroms) & {13, 18, 21} and len(set(chroms)) == len(chroms)
        assert r["cv_type"] in ("practical", "theoretical") and r["cv"] > 0 and abs(r["z"] - (r["ratio"] - 1) / r["cv"]) < 1e-6
        for p in r["predictors"]:  # no predictor serves two models
            assert used.setdefault((r["sample_id"], r["focus"], p), r["model"]) == r["model"]
    assert {r["sample_id"] for r in rows} == {"0", "1", "2"} and {r["focus"] for r in rows} == {13, 18, 21}


def check_sex_regression(rows, duck):
    own = [r for r in rows if r["sex"] == ("male" if r["sample_id"] % 2 else "female")]
    assert own and abs(np.median([r["ratio"] for r in own]) - 1) < 0.3
    for r in rows:
        same = [x["z"] for x in rows if (x["sample_id"], x["sex"], x["focus"]) == (r["sample_id"], r["sex"], r["focus"]) and x["z"] is not None]
        assert not same or abs(r["mean_z"] - np.mean(same)) < 1e-6


def check_seqff(rows, duck):
    assert len(rows) == duck.execute(f"WITH {data.READS} SELECT count(DISTINCT sample_id) FROM reads").fetchone()[0]
    assert all(abs(r["seqff"] - (r["enet"] + r["wrsc"]) / 2) < 1e-9 for r in rows)


def check_segments(rows, duck):
    """Segments of a chromosome follow each other, and a ratio is the weighted mean of its bins."""
    n = {(s, c, b): v for s, c, b, v in duck.execute(f"{data.BASE} SELECT sample_id, chrom, bin, n FROM dense").fetchall()}
    by = {}
    for r in rows:
        by.setdefault((r["sample_id"], r["chrom"]), []).append(r)
        bins = [n[r["sample_id"], r["chrom"], b] for b in range(r["start"], r["end"])]
        bins = [v for v in bins if v != 5]
        assert abs(r["ratio"] - sum((v - 5) * max(v, 1e-99) for v in bins) / sum(max(v, 1e-99) for v in bins)) < 1e-6
    for own in by.values():
        own.sort(key=lambda r: r["start"])
        assert all(a["end"] <= b["start"] for a, b in zip(own, own[1:]))


def check_predictions(rows, duck):
    assert {r["sample_id"] for r in rows} == {r[0] for r in duck.execute("SELECT DISTINCT l_suppkey % 20 FROM lineitem").fetchall()}
    assert all(r["segments"] >= 20 and math.isfinite(r["cpa"]) and r["cpa"] >= 0 for r in rows)


def check_chromosome_plot(rows, duck):
    assert {(r["chrom"], r["method"]) for r in rows} == {(c, m) for c in range(1, 23) for m in ("raw", "chi")}
    assert all(r["cv_percent"] > 0 and r["shape"] in ("normal", "not_normal", "unknown") for r in rows)


CHECKS = {
    "d13_shapiro": check_shapiro, "k06_gender_cutoff": check_cutoff, "k10_pca_ratio": check_ratio, "k11_distance_outliers": check_outliers, "k34_gc_loess": check_loess, "k40_regression": check_regression,
    "k41_regression_strands": check_regression, "k49_sex_regression": check_sex_regression, "k52_seqff": check_seqff, "k21b_segments": check_segments, "newref_predict": check_predictions, "l01_plot_chromosomes": check_chromosome_plot,
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_other_queries(spark, duck, name):
    CHECKS[name](ask(spark, name), duck)


def test_vector_queries_read_the_whole_table(spark, duck):
    got = registry.QUERIES["k12_knn"](spark, DIR)
    assert got.select("a").distinct().count() == duck.execute("SELECT count(*) FROM embeddings").fetchone()[0] > 400


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
