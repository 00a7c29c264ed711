"""Versioned bundles of tables: a model is replaced in one step, and a rebuild that dies leaves the old one readable.

Below a path, ``versions/<id>`` holds the tables of a version, with a manifest that names each table's rows, schema and
digest. ``heads`` holds one small file per version that was ever current, numbered; the highest number is current. A
head is written last and never replaced, so readers see the old version or the new one, and of two writers that
finish at once one is told. Tables are read by version, so a reader keeps its version while another is published.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binfold.sources import storage


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows of a table, and a digest that depends on the rows but not on their order."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) if t.startswith(("float", "double")) else F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c, t in df.dtypes]
    row = F.sha2(F.concat_ws("\x01", *cells), 256)
    part = lambda k: F.bit_xor(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("long"))
    # Of equal rows an exclusive or only knows whether they are even, so rows and the sum of a part count too.
    total = F.sum(F.conv(F.substring(row, 61, 4), 16, 10).cast("long"))
    n, *parts = df.agg(F.count("*"), total, *[part(k) for k in range(4)]).first()
    return n, ":".join(f"{p or 0:x}" for p in parts)


class Draft:
    """A version in the making; nothing of it can be seen before ``commit``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path.rstrip("/"), uuid.uuid4().hex
        self.after = heads(spark, path)[-1][0] if heads(spark, path) else 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table of this version and read it back; also steps that will be no part of the model."""
        where = f"{self.path}/versions/{self.version}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def commit(self, names: list[str], notes: dict[str, str] | None = None) -> str:
        """Write the manifest, make the version current, and remove the steps that are no part of it."""
        tables = {}
        for name in names:
            df = self.spark.read.parquet(f"{self.path}/versions/{self.version}/{name}")
            rows, own = digest(df)
            tables[name] = {"rows": rows, "digest": own, "schema": df.schema.simpleString()}
        manifest = {"version": self.version, "tables": tables, "notes": notes or {}}
        storage.publish_text(self.spark, f"{self.path}/versions/{self.version}/manifest.json", json.dumps(manifest))
        storage.publish_text(self.spark, f"{self.path}/heads/{self.after + 1:012d}.json", json.dumps({"version": self.version}))
        for name in storage.list_names(self.spark, f"{self.path}/versions/{self.version}"):
            if name not in {*names, "manifest.json"}:
                storage.delete(self.spark, f"{self.path}/versions/{self.version}/{name}")
        return self.version


def heads(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and version of all that were ever current, oldest first."""
    folder = f"{path.rstrip('/')}/heads"
    return [(int(n[:-5]), json.loads(storage.read_text(spark, f"{folder}/{n}"))["version"]) for n in storage.list_names(spark, folder) if n[:1].isdigit() and n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: str | None = None) -> dict:
    """The manifest of a version, or of the current one."""
    if version is None:
        known = heads(spark, path)
        if not known:
            raise FileNotFoundError(f"no version below {path}")
        version = known[-1][1]
    text = storage.read_text(spark, f"{path.rstrip('/')}/versions/{version}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"no version {version} below {path}")
    return json.loads(text)


def load(spark: SparkSession, path: str, version: str | None = None, verify: bool = False) -> dict[str, DataFrame]:
    """Tables of a version (the current one by default); with ``verify``, an error where rows, digest or schema differ."""
    known = manifest(spark, path, version)
    out = {}
    for name, what in known["tables"].items():
        out[name] = spark.read.parquet(f"{path.rstrip('/')}/versions/{known['version']}/{name}")
        if verify and ((what["rows"], what["digest"]) != digest(out[name]) or what["schema"] != out[name].schema.simpleString()):
            raise ValueError(f"table {name} of version {known['version']} is not what was published")
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` published versions, and drafts without a head; returns what went.

    Run it when no writer is at work: a draft in the making has no head either.
    """
    stays = {v for _, v in heads(spark, path)[-keep:]}
    gone = [v for v in storage.list_names(spark, f"{path.rstrip('/')}/versions") if v not in stays]
    for v in gone:
        storage.delete(spark, f"{path.rstrip('/')}/versions/{v}")
    return gone
