"""Chromosome scores of samples against a control group: z, normalised chromosome value, stepwise regression.

A cohort is a few hundred samples by 24 chromosomes. Denominators are searched by ranges of numbered sets, so one search
spreads over tasks; predictors are searched from sums over the controls.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.kernels import forward_from_gram, shapiro, unrank_sets
from binfold.functions.safe import safe_div
from binfold.operators.cohort import EXCLUDED

AUTOSOMES = tuple(range(1, 23))


def z_score(sample_frac: DataFrame, control_frac: DataFrame) -> DataFrame:
    """Per sample and chromosome: (fraction - control mean) / control SD."""
    stats = control_frac.groupBy("chrom").agg(F.avg("frac").alias("ctrl_mean"), F.stddev_samp("frac").alias("ctrl_sd"))
    return sample_frac.join(stats, "chrom").withColumn("z", safe_div(F.col("frac") - F.col("ctrl_mean"), F.nullif(F.col("ctrl_sd"), F.lit(0.0))))


def leave_one_out_z(frac: DataFrame) -> DataFrame:
    """Each sample against all others of the table."""
    from binfold.operators.cohort import leave_one_out

    return leave_one_out(frac, "frac", ["chrom"])


def denominator_pool(focus: int, exclude: tuple[int, ...] = EXCLUDED, include: tuple[int, ...] | None = None) -> list[int]:
    return [c for c in (include or AUTOSOMES) if c != focus and (include or c not in exclude)]


def ncv_pairs(control_reads: DataFrame, focus: int, exclude: tuple[int, ...] = EXCLUDED) -> DataFrame:
    """CV of focus / denominator over controls for every set of one or two denominators, as plain SQL aggregates.

    ``a = b`` stands for a single denominator. The join pairs the chromosomes of one sample with each other.
    """
    pool = denominator_pool(focus, exclude)
    r = control_reads.where("chrom <= 22").select("sample_id", "chrom", "reads")
    a = r.where(F.col("chrom").isin(pool)).withColumnsRenamed({"chrom": "a", "reads": "ra"})
    b = r.where(F.col("chrom").isin(pool)).withColumnsRenamed({"chrom": "b", "reads": "rb"})
    f = r.where(F.col("chrom") == focus).select("sample_id", F.col("reads").alias("rf"))
    ratio = safe_div("rf", F.col("ra") + F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("rb")))
    pairs = a.join(b, "sample_id").where("a <= b").join(f, "sample_id").withColumn("ratio", ratio)
    return pairs.groupBy("a", "b").agg(F.avg("ratio").alias("mean"), F.stddev_samp("ratio").alias("sd")).withColumn("cv", safe_div("sd", "mean"))


#: Sets per task row and samples per block of the denominator search; they cut the work, not the answer.
SETS, SAMPLES = 4096, 4096


def denominator_search(rows: DataFrame, keys: dict[str, str], p: int, min_size: int, max_size: int) -> DataFrame:
    """The set of denominators whose ratio varies least, per key: ``<keys>, chosen, mean, sd, cv, n``.

    ``rows``: ``<keys>`` (names with types), ``focus`` and ``reads``, an array of ``p`` numbers, a row per sample.
    Sets are numbered in lexicographic order by size. A task takes a range of numbers and a block of samples, makes its
    sets from their numbers, and returns sums over its samples, taken about a centre that all blocks of a set share, so
    sums add up to the variance without losing digits. Sets and samples may both be many. Sets with a ratio that is
    not finite take no part; ties go to the smaller, then to the earlier set. ``chosen`` are places in ``reads``.
    """
    spark, names = rows.sparkSession, list(keys)
    schema = ", ".join(f"{k} {v}" for k, v in keys.items())
    ranges = [(k, lo, min(comb(p, k), lo + SETS)) for k in range(min_size, min(max_size, p) + 1) for lo in range(0, comb(p, k), SETS)]
    empty = f"{schema}, chosen array<int>, mean double, sd double, cv double, n long"
    if not ranges:
        return spark.createDataFrame([], empty)
    blocks = max(1, -(-rows.count() // SAMPLES))
    part = rows.withColumn("_block", F.pmod(F.xxhash64("focus", "reads"), F.lit(blocks))).groupBy(*names, "_block").agg(F.collect_list("focus").alias("focus"), F.flatten(F.collect_list("reads")).alias("reads"))
    centre = rows.groupBy(*names).agg(F.sum("focus").alias("all_focus"), F.array(*[F.sum(F.get("reads", F.lit(i))) for i in range(p)]).alias("all_reads"))
    work = part.join(centre, names).join(F.broadcast(spark.createDataFrame(ranges, "size int, lo long, hi long")))  # one row per range of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sets = unrank_sets(p, row["size"], np.arange(row["lo"], row["hi"]))
                focus, reads = np.array(row["focus"], float), np.array(row["reads"], float).reshape(-1, p)
                with np.errstate(all="ignore"):
                    middle = row["all_focus"] / np.array(row["all_reads"], float)[sets].sum(axis=1)
                    s1, s2 = np.zeros(len(sets)), np.zeros(len(sets))
                    step = max(1, 2_000_000 // max(1, len(sets)))
                    for at in range(0, len(focus), step):
                        below = np.zeros((len(focus[at : at + step]), len(sets)))
                        for j in range(row["size"]):
                            below += reads[at : at + step][:, sets[:, j]]
                        off = focus[at : at + step, None] / below - middle
                        s1, s2 = s1 + off.sum(axis=0), s2 + (off**2).sum(axis=0)
                ok = np.isfinite(s2) & np.isfinite(middle)
                n = len(sets)
                own = [pa.array([row[k]] * n, b.schema.field(k).type) for k in names]
                own += [pa.array([row["size"]] * n, pa.int32()), pa.array(np.arange(row["lo"], row["hi"])), pa.array(np.where(ok, len(focus), 0)), pa.array(np.where(ok, s1, 0.0)), pa.array(np.where(ok, s2, 0.0)), pa.array(np.where(ok, middle, 0.0)), pa.array(ok)]
                yield pa.RecordBatch.from_arrays(own, [*names, "size", "rank", "n", "s1", "s2", "middle", "ok"])

    sums = work.repartition(max(1, min(len(ranges), 200)), "lo", "size").mapInArrow(run, f"{schema}, size int, rank long, n long, s1 double, s2 double, middle double, ok boolean")
    sums = sums.groupBy(*names, "size", "rank").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.first("middle").alias("middle"), F.min("ok").alias("ok")).where("ok and n > 1")
    # Guarded, as the filter on n may be evaluated after the quotients.
    mean = F.col("middle") + safe_div("s1", "n")
    sd = F.sqrt(safe_div(F.greatest(F.col("s2") - safe_div(F.col("s1") * F.col("s1"), "n"), F.lit(0.0)), F.col("n") - 1))
    rated = sums.select(*names, "size", "rank", "n", mean.alias("mean"), sd.alias("sd")).withColumn("cv", safe_div("sd", F.nullif(F.col("mean"), F.lit(0.0)))).where("cv is not null and not isnan(cv)")
    best = rated.groupBy(*names).agg(F.min(F.struct("cv", "size", "rank", "mean", "sd", "n")).alias("b")).select(*names, "b.*")

    def name_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["chosen"] = [unrank_sets(p, int(k), np.array([r]))[0].tolist() for k, r in zip(pdf["size"], pdf["rank"])]
            yield pdf[[*names, "chosen", "mean", "sd", "cv", "n"]]

    return best.mapInPandas(name_sets, empty)


def ncv_templates(control_reads: DataFrame, foci: list[int], min_elements: int = 1, max_elements: int = 5, exclude: tuple[int, ...] = EXCLUDED, candidates: tuple[int, ...] | None = None) -> DataFrame:
    """Best denominators per focus: ``focus, denominators, mean, sd, cv, shapiro_p, n_controls``."""
    rows = control_reads.select("sample_id", F.col("chrom").cast("int").alias("chrom"), F.col("reads").cast("double").alias("reads"))
    present = {r["chrom"] for r in rows.select("chrom").distinct().collect()}
    of = rows.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("chrom", "reads"))).alias("m"))
    count = lambda c: F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0))
    out = None
    for focus in foci:
        pool = [c for c in denominator_pool(focus, exclude, candidates) if c in present]
        asked = of.select(F.lit(focus).alias("focus_chrom"), count(focus).alias("focus"), F.array(*[count(c) for c in pool]).cast("array<double>").alias("reads"))
        found = denominator_search(asked, {"focus_chrom": "int"}, len(pool), min_elements, max_elements)
        found = found.select(F.col("focus_chrom").alias("focus"), F.transform("chosen", lambda i: F.get(F.array(*[F.lit(c) for c in pool]), i)).alias("denominators"), "mean", "sd", "cv", F.col("n").alias("n_controls"))
        out = found if out is None else out.unionByName(found)

    @F.pandas_udf("double")
    def p_value(v: pd.Series) -> float:
        return shapiro(v.to_numpy(float))[1]

    ratios = ncv_score(rows, out).groupBy("focus").agg(p_value("ratio").alias("shapiro_p"))
    return out.join(ratios, "focus", "left").select("focus", "denominators", "mean", "sd", "cv", "shapiro_p", "n_controls")


def ncv_score(sample_reads: DataFrame, templates: DataFrame) -> DataFrame:
    """z of each sample's ratio under each template."""
    t = templates.select("focus", "denominators", "mean", "sd")
    rows = sample_reads.join(F.broadcast(t)).groupBy("sample_id", "focus").agg(
        F.sum(F.when(F.col("chrom") == F.col("focus"), F.col("reads"))).alias("focus_reads"), F.sum(F.when(F.array_contains("denominators", F.col("chrom").cast("int")), F.col("reads"))).alias("denominator_reads"),
        F.first("mean").alias("mean"), F.first("sd").alias("sd"),
    )
    return rows.withColumn("ratio", safe_div("focus_reads", "denominator_reads")).withColumn("z", safe_div(F.col("ratio") - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))))


def split_controls(samples: DataFrame, train_fraction: float, seed: int) -> DataFrame:
    """``train`` per sample: the first share by seeded hash; all for a fraction of 1 or more."""
    w = Window.orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id")
    n = samples.count()
    take = n if train_fraction >= 1 else int(np.ceil(n * train_fraction))
    return samples.withColumn("train", F.row_number().over(w) <= take)


def centred_products(rows: DataFrame, column: str, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means, and the ``p`` by ``p`` matrix of centred products of an array column, summed in the cluster."""
    first = rows.agg(F.count("*"), *[F.avg(F.get(column, F.lit(i))) for i in range(p)]).first()
    mean = np.array([v or 0.0 for v in first[1:]])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((p, p))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, p) - mean
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p)), pa.array(gram.reshape(-1))], ["i", "g"])

    gram = np.zeros(p * p)
    for i, g in rows.select(column).mapInArrow(products, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        gram[i] = g
    return first[0], mean, gram.reshape(p, p)


def regression(sample_frac: DataFrame, control_frac: DataFrame, foci: list[int], n_models: int = 4, n_predictors: int = 4, exclude: tuple[int, ...] = EXCLUDED, train_fraction: float = 0.6, overdispersion: float = 1.15, force_practical_cv: bool = False, seed: int = 1995) -> DataFrame:
    """Regression scores: ``sample_id, focus, model, predictors, ratio, cv, cv_type, z, shapiro_p``.

    Each model selects predictors forward by adjusted R2 on the training share of the controls; no predictor serves
    two models. ``z = (observed / predicted - 1) / cv`` with the practical CV of the other controls or the theoretical
    one, ``overdispersion / sqrt(reads)``, whichever is larger. Separated strands: give ``strand`` columns F and R on
    both tables; the response is then F + R, and the other strand of a predictor is barred from the same model.

    Models come from sums over the training controls (means and products of at most 44 fractions and the responses), so
    a cohort may be of any size; other controls and samples are scored where they are, and only the CV of a model and
    the Shapiro-Wilk p of its control ratios are joined to the samples.
    """
    stranded = "strand" in control_frac.columns
    cells = [(c, s) for c in range(1, 23) for s in (("F", "R") if stranded else ("",))]
    names, chrom, p = [f"{c}:{s}" if s else str(c) for c, s in cells], np.array([c for c, _ in cells]), len(cells)

    def shape(df: DataFrame) -> DataFrame:
        """Per sample the fractions of all cells, then the responses; and the reads of each focus."""
        mine = lambda c, s: (F.col("chrom") == c) & ((F.col("strand") == s) if s else F.lit(True))
        total = lambda cond, v: F.coalesce(F.sum(F.when(cond, F.col(v).cast("double"))), F.lit(0.0))
        values = [total(mine(c, s), "frac") for c, s in cells] + [total(F.col("chrom") == f, "frac") for f in foci]
        return df.where("chrom <= 22").groupBy(F.col("sample_id").cast("string").alias("sample_id")).agg(F.array(*values).alias("f"), F.array(*[total(F.col("chrom") == f, "reads") for f in foci]).alias("r"))

    role = split_controls(control_frac.select("sample_id").distinct(), train_fraction, seed).select(F.col("sample_id").cast("string").alias("sample_id"), "train")
    controls = shape(control_frac).join(role, "sample_id")
    n, mean, gram = centred_products(controls.where("train"), "f", p + len(foci))
    pairs = {i: {j for j in range(p) if j != i and chrom[j] == chrom[i]} for i in range(p)}
    models = []
    for k, focus in enumerate(foci):
        allowed = np.append(~np.isin(chrom, [focus, *exclude]), np.zeros(len(foci), bool))
        for m in range(1, n_models + 1):
            cols = forward_from_gram(gram, p + k, n_predictors, n, allowed, pairs)
            if not cols:
                break
            allowed[cols] = False
            coef = np.linalg.solve(gram[np.ix_(cols, cols)], gram[cols, p + k])
            models.append((k, focus, m, cols, float(mean[p + k] - coef @ mean[cols]), coef))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, reads = np.array(pdf["f"].tolist(), float).reshape(-1, p + len(foci)), np.array(pdf["r"].tolist(), float).reshape(-1, len(foci))
            for k, focus, m, cols, base, coef in models:
                with np.errstate(all="ignore"):
                    ratio = x[:, p + k] / (base + x[:, cols] @ coef)
                yield pd.DataFrame({"sample_id": pdf["sample_id"], "focus": focus, "model": m, "predictors": [[names[c] for c in cols]] * len(x), "ratio": ratio, "reads": reads[:, k]})

    scored = "sample_id string, focus int, model int, predictors array<string>, ratio double, reads double"
    rest = controls.where("not train")
    if train_fraction >= 1 or rest.limit(2).count() < 2:
        rest = controls.where("train")

    @F.pandas_udf("double")
    def p_value(v: pd.Series) -> float:
        return shapiro(v.to_numpy(float))[1]

    ratios = rest.select("sample_id", "f", "r").mapInPandas(score, scored)
    practical = ratios.groupBy("focus", "model").agg(safe_div(F.stddev_samp("ratio"), F.avg("ratio")).alias("practical")).join(ratios.groupBy("focus", "model").agg(p_value("ratio").alias("shapiro_p")), ["focus", "model"])
    rows = shape(sample_frac).mapInPandas(score, scored).join(F.broadcast(practical), ["focus", "model"])  # a row per model
    theory = F.coalesce(safe_div(F.lit(overdispersion), F.sqrt(F.nullif(F.col("reads"), F.lit(0.0)))), F.lit(float("inf")))
    use = F.lit(True) if force_practical_cv else F.coalesce(F.col("practical") >= theory, F.lit(False))
    out = rows.withColumn("cv", F.when(use, F.col("practical")).otherwise(theory)).withColumn("cv_type", F.when(use, "practical").otherwise("theoretical"))
    return out.withColumn("z", safe_div(F.col("ratio") - 1, F.nullif(F.col("cv"), F.lit(0.0)))).select("sample_id", "focus", "model", "predictors", "ratio", "cv", "cv_type", "z", "shapiro_p")
