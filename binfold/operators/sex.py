"""Sex models, references with sex labels, and gonosome scores."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binfold.functions.kernels import forward_selection, gmm, gmm_classify
from binfold.functions.safe import safe_div
from binfold.operators.cohort import leave_one_out
from binfold.operators.scores import denominator_search

CANDIDATES = (*range(1, 13), *range(14, 17), 20, 22)
SEX_CHROMS = {"X": 23, "Y": 24}


def sex_fractions(totals: DataFrame) -> DataFrame:
    """X and Y reads over autosomal reads per sample; 0 without autosomal reads."""
    auto = F.sum(F.when(F.col("chrom") <= 22, F.col("reads")))
    part = lambda c: F.coalesce(safe_div(F.sum(F.when(F.col("chrom") == c, F.col("reads"))), auto), F.lit(0.0))
    return totals.groupBy("sample_id").agg(part(23).alias("x_frac"), part(24).alias("y_frac"), auto.alias("autosomal_reads"))


def sex_model(values: DataFrame, method: str = "y_fraction") -> dict:
    """Two-component mixture of one row per sample; the component with the higher median Y value is male.

    ``y_fraction`` and ``y_unique`` use one column, ``xy_fraction`` two. Fractions of a cohort (a row per sample) come
    to the driver; each component has a covariance of its own and mixing is equal.
    """
    cols = {"y_fraction": ["y_frac"], "xy_fraction": ["x_frac", "y_frac"], "y_unique": ["ratio"]}[method]
    pdf = values.select("sample_id", *cols).orderBy("sample_id").toPandas()
    if len(pdf) < 4:
        raise ValueError("a sex model needs at least 4 samples")
    x = pdf[cols].to_numpy(float)
    model = gmm(x, equal_mixing=True)
    label = gmm_classify(model, x)
    y = [np.median(x[label == k, -1]) if (label == k).any() else model["mean"][k][-1] for k in range(2)]
    return {"method": method, "columns": cols, "weight": model["weight"].tolist(), "mean": model["mean"].tolist(), "cov": model["cov"].tolist(), "male": int(np.argmax(y))}


def model_table(spark, models: list[dict]) -> DataFrame:
    return spark.createDataFrame([(m["method"], json.dumps(m)) for m in models], "method string, model string")


def _log_density(m: dict, k: int):
    """Log of weight times density of component k as a column; the covariance is inverted here, once."""
    mean, cov = np.array(m["mean"][k]), np.array(m["cov"][k])
    inv, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
    d = [F.col(c) - F.lit(float(mean[i])) for i, c in enumerate(m["columns"])]
    quad = sum((F.lit(float(inv[i, j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return F.lit(float(np.log(m["weight"][k]) - 0.5 * det)) - quad * 0.5


def predict_sex(values: DataFrame, models: list[dict]) -> DataFrame:
    """Majority of the models' votes; a tie is female. The models are a few constants, so scoring stays in SQL."""
    votes = [F.when(_log_density(m, m["male"]) > _log_density(m, 1 - m["male"]), "male").otherwise("female") for m in models]
    out = values.withColumn("votes", F.map_from_arrays(F.array(*[F.lit(m["method"]) for m in models]), F.array(*votes)))
    males = F.size(F.filter(F.map_values("votes"), lambda v: v == "male"))
    return out.withColumn("prediction", F.when(males * 2 > len(models), "male").otherwise("female"))


def build_reference(totals: DataFrame, labels: DataFrame, outlier_z: float = 3.0) -> DataFrame:
    """Reference rows ``sample_id, sex, rr_x, rr_y`` with leave-one-out z of X and Y within a sex and an outlier flag."""
    f = sex_fractions(totals).join(labels.select("sample_id", "sex"), "sample_id").withColumnsRenamed({"x_frac": "rr_x", "y_frac": "rr_y"})
    out = leave_one_out(f, "rr_x", ["sex"]).withColumnRenamed("loo_z", "rr_x_z").drop("loo_mean", "loo_sd")
    out = leave_one_out(out, "rr_y", ["sex"]).withColumnRenamed("loo_z", "rr_y_z").drop("loo_mean", "loo_sd")
    far = lambda c: F.coalesce(F.abs(c) >= outlier_z, F.lit(False))
    return out.withColumn("outlier", far("rr_x_z") | far("rr_y_z"))


def sex_score(samples: DataFrame, reference: DataFrame, min_controls: int = 2) -> DataFrame:
    """z and CV of X and Y fractions against non-outlier references of either sex; ``selected`` follows the prediction.

    ``samples``: ``sample_id, x_frac, y_frac, prediction``.
    """
    stats = reference.where(~F.col("outlier") & F.col("sex").isin("female", "male")).groupBy("sex").agg(F.count("*").alias("n"), *[g(c).alias(f"{p}_{c}") for c in ("rr_x", "rr_y") for p, g in (("mean", F.avg), ("sd", F.stddev_samp))])
    rows = samples.join(F.broadcast(stats)).where(F.col("n") >= min_controls)
    z = lambda v, c: safe_div(F.col(v) - F.col(f"mean_{c}"), F.nullif(F.col(f"sd_{c}"), F.lit(0.0)))
    return rows.select("sample_id", "sex", "prediction", (F.col("sex") == F.col("prediction")).alias("selected"), F.col("n").alias("reference_size"), z("x_frac", "rr_x").alias("z_x"), z("y_frac", "rr_y").alias("z_y"), (safe_div("sd_rr_x", "mean_rr_x") * 100).alias("cv_x"), (safe_div("sd_rr_y", "mean_rr_y") * 100).alias("cv_y"))


def sex_ncv_models(totals: DataFrame, reference: DataFrame, min_elements: int = 6, max_elements: int = 9, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """Denominators of X and Y per sex, all sets of the candidates searched: ``sex, focus, denominators, mean, sd, cv, n``."""
    use = reference.where(~F.col("outlier") & F.col("sex").isin("female", "male")).select("sample_id", "sex")
    rows = totals.join(use, "sample_id").select("sample_id", "sex", F.col("chrom").cast("int").alias("chrom"), F.col("reads").cast("double").alias("reads"))
    present = {r["chrom"] for r in rows.select("chrom").distinct().collect()}
    pool = [c for c in candidates if c in present]
    of = rows.groupBy("sample_id", "sex").agg(F.map_from_entries(F.collect_list(F.struct("chrom", "reads"))).alias("m"))
    count = lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))
    asked = of.withColumn("gonosome", F.explode(F.array(F.lit(23), F.lit(24)))).select("sex", "gonosome", count(F.col("gonosome")).alias("focus"), F.array(*[count(F.lit(c)) for c in pool]).cast("array<double>").alias("reads"))
    found = denominator_search(asked, {"sex": "string", "gonosome": "int"}, len(pool), min_elements, max_elements)
    return found.select("sex", F.col("gonosome").alias("focus"), F.transform("chosen", lambda i: F.get(F.array(*[F.lit(c) for c in pool]), i)).alias("denominators"), "mean", "sd", (F.col("cv") * 100).alias("cv"), "n")


def sex_ncv_score(totals: DataFrame, models: DataFrame) -> DataFrame:
    """z of each sample under each (sex, focus) model; models are four rows."""
    m = models.select("sex", "focus", "denominators", "mean", "sd")
    rows = totals.join(F.broadcast(m)).groupBy("sample_id", "sex", "focus").agg(F.sum(F.when(F.col("chrom") == F.col("focus"), F.col("reads"))).alias("f"), F.sum(F.when(F.array_contains("denominators", F.col("chrom").cast("int")), F.col("reads"))).alias("d"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    return rows.select("sample_id", "sex", "focus", safe_div(safe_div("f", "d") - F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0))).alias("ncv"))


def sex_regression_models(totals: DataFrame, reference: DataFrame, n_models: int = 4, n_predictors: int = 4, candidates: tuple[int, ...] = CANDIDATES, extra: DataFrame | None = None) -> DataFrame:
    """Stepwise models of X and Y fractions per sex: ``sex, focus, model, predictors, coef, mean_ratio, sd_ratio``.

    Fractions are over autosomal reads. ``extra``: further numeric predictors, ``sample_id`` and columns; samples
    without them are left out by the join.
    """
    use = reference.where(~F.col("outlier") & F.col("sex").isin("female", "male")).select("sample_id", "sex")
    w = Window.partitionBy("sample_id")
    frac = totals.withColumn("v", safe_div("reads", F.sum(F.when(F.col("chrom") <= 22, F.col("reads"))).over(w)))
    rows = frac.select("sample_id", F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("name"), "v")
    if extra is not None:
        names = [c for c in extra.columns if c != "sample_id"]
        rows = rows.unionByName(extra.select("sample_id", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))).alias("name", "v")))
    rows = rows.join(use, "sample_id").withColumn("focus", F.explode(F.array(F.lit(23), F.lit(24))))
    allowed_names = {f"chr{c}" for c in candidates} | (set(extra.columns) - {"sample_id"} if extra is not None else set())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sex, focus = key[0], int(key[1])
        wide = pdf.pivot_table(index="sample_id", columns="name", values="v").sort_index()
        pool = sorted((c for c in wide.columns if c in allowed_names), key=lambda c: (not c.startswith("chr"), int(c[3:]) if c.startswith("chr") else 0, c))
        wide = wide.dropna(subset=pool)
        x, y = wide[pool].to_numpy(float), wide[f"chr{focus}"].to_numpy(float) if f"chr{focus}" in wide else np.zeros(len(wide))
        open_, out = np.ones(len(pool), bool), []
        for m in range(1, n_models + 1):
            cols = forward_selection(y, x, min(n_predictors, max(0, len(y) - 2)), open_)
            if not cols:
                break
            open_[cols] = False
            design = np.column_stack((np.ones(len(x)), x[:, cols]))
            coef = np.linalg.lstsq(design, y, rcond=None)[0]
            with np.errstate(all="ignore"):
                ratio = y / design.dot(coef)
            out.append((sex, focus, m, [pool[c] for c in cols], coef.tolist(), float(ratio.mean()), float(ratio.std(ddof=1)) if len(ratio) > 1 else np.nan))
        return pd.DataFrame(out, columns=["sex", "focus", "model", "predictors", "coef", "mean_ratio", "sd_ratio"])

    return rows.groupBy("sex", "focus").applyInPandas(run, "sex string, focus int, model int, predictors array<string>, coef array<double>, mean_ratio double, sd_ratio double")


def sex_regression_score(totals: DataFrame, models: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """z per (sample, sex, focus, model) and the mean over models (``mean_z``)."""
    w = Window.partitionBy("sample_id")
    frac = totals.withColumn("v", safe_div("reads", F.sum(F.when(F.col("chrom") <= 22, F.col("reads"))).over(w)))
    rows = frac.select("sample_id", F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("name"), "v")
    if extra is not None:
        names = [c for c in extra.columns if c != "sample_id"]
        rows = rows.unionByName(extra.select("sample_id", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))).alias("name", "v")))
    values = rows.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("v"))
    terms = F.zip_with("predictors", F.slice("coef", F.lit(2), F.size("predictors")), lambda p, c: c * F.element_at("v", p))
    fitted = F.element_at("coef", F.lit(1)) + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    out = values.join(F.broadcast(models)).withColumn("ratio", safe_div(F.element_at("v", F.concat(F.lit("chr"), F.col("focus").cast("string"))), fitted))
    out = out.select("sample_id", "sex", "focus", "model", "ratio", safe_div(F.col("ratio") - F.col("mean_ratio"), F.nullif(F.col("sd_ratio"), F.lit(0.0))).alias("z"))
    return out.withColumn("mean_z", F.avg("z").over(Window.partitionBy("sample_id", "sex", "focus")))


def gonosome_report(scores: DataFrame, ncv: DataFrame, reg: DataFrame) -> DataFrame:
    """One row per sample and gonosome: predicted sex, selected z and CV, and scores under both sexes."""
    label = F.when(F.col("focus") == 23, "X").otherwise("Y")
    base = scores.where("selected").select("sample_id", F.col("prediction").alias("predicted_sex"), F.explode(F.array(F.struct(F.lit("X").alias("chromosome"), F.col("z_x").alias("z_score"), F.col("cv_x").alias("cv")), F.struct(F.lit("Y").alias("chromosome"), F.col("z_y").alias("z_score"), F.col("cv_y").alias("cv")))).alias("s")).select("sample_id", "predicted_sex", "s.*")
    pick = lambda df, v, name: df.groupBy("sample_id", label.alias("chromosome")).agg(F.max(F.when(F.col("sex") == "female", F.col(v))).alias(f"{name}_female"), F.max(F.when(F.col("sex") == "male", F.col(v))).alias(f"{name}_male"))
    out = base.join(pick(ncv, "ncv", "ncv_score"), ["sample_id", "chromosome"], "left").join(pick(reg.dropDuplicates(["sample_id", "sex", "focus"]), "mean_z", "regression_score"), ["sample_id", "chromosome"], "left")
    chosen = lambda n: F.when(F.col("predicted_sex") == "male", F.col(f"{n}_male")).otherwise(F.col(f"{n}_female"))
    return out.withColumn("ncv_score_selected", chosen("ncv_score")).withColumn("regression_score_selected", chosen("regression_score"))
