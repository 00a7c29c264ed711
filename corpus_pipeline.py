"""The corpus pipeline: each stage works on what the one before kept, written as Parquet and read again.

Language ID drops what it rejects, exact dedup keeps one row of equal texts, the Jaccard join keeps one document of
each near-duplicate group, mixing keeps what the target weights select, packing places the rest in batches.

Rows are told apart by id and text, so an id that two texts share never brings back what a stage dropped. A row that
repeats both is the same document, kept once from exact dedup on. Columns pass through whatever their names. Every
stage gives an empty result for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binfold.llm.common import delete_path, new_path
from binfold.llm.exact_dedup import exact_dedup, text_digest
from binfold.llm.jaccard_join import near_duplicates
from binfold.llm.language_id import keep_identified, train
from binfold.llm.mixing import leaf_columns, mix
from binfold.llm.packing import pack

#: Target weights of the mixture; what is not named weighs 1.
TARGET = {"lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src1": 3, "src4": 2}}


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _row_key(digest: Column) -> Column:
    """Orders by id, null ids last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"))


def _keep(docs: DataFrame, key: Column, keys: DataFrame, once: bool) -> DataFrame:
    """Rows of ``docs`` whose key is in the one column of ``keys``; with ``once`` one row of a key.

    One shuffle of the rows serves the join and the window, whose keys are the rows' own, so none is hot.
    """
    name = _unused(docs, "row_key")
    rows = docs.withColumn(name, key).join(keys.toDF(name), name, "left_semi")
    if once:
        nth = _unused(docs, "nth")
        rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(name).orderBy(F.lit(1)))).where(F.col(nth) == 1)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go with what the model rejects; null ids and repeated rows are rows like others.

    Without one usable label outside the held-out fold there is no model, and nothing can be accepted.
    """
    try:
        model = train(docs)
    except ValueError:
        return docs.limit(0)
    return keep_identified(docs, model)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in either case; null and empty alike) the row with the largest id stays, a null id last."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id"), F.unhex("text_sha256").alias("digest"))
    return _keep(docs, _row_key(text_digest(F.col("text"))), kept.select(_row_key(F.col("digest"))), once=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays (null ids only where there is no other); texts without words all stay."""
    key = _row_key(text_digest(F.col("text")))
    found = near_duplicates(docs.select(key.alias("row"), "text"), id_col="row")
    return _keep(docs, key, found.where("row = component_id").select("row"), once=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch at most: the mixture selects, it does not repeat documents. Null labels are the leaf ``unknown``; rows
    that repeat id and leaf go or stay together; texts without words stay only where their leaf stays whole."""
    leaf = lambda *cols: F.struct(F.col("doc_id").alias("id"), *cols)
    taken = mix(docs, budget_share=0.7, max_epochs=1, weights=TARGET).where("copies > 0")
    return _keep(docs, leaf(*leaf_columns()), taken.select(leaf("domain", "lang", "source")), once=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a place: null and empty texts have length 1, null ids and repeated rows are rows like others."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", dedup_exact),
    ("n-gram Jaccard join", dedup_near),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Language ID is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
