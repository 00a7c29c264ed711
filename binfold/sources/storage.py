"""Small files and folders of the cluster's file system, through the session's own Hadoop configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file whole, or None where there is none."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """Write a small file so that readers see all of it or none: under another name first, then renamed.

    Without ``replace`` an existing file is an error. With it the old file goes just before the rename.
    """
    fs, where = _open(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where.getParent()}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if replace and fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(draft, where):
        fs.delete(draft, False)
        raise FileExistsError(path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    fs, where = _open(spark, path)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.delete(where, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.mkdirs(where)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file, making the folder it goes to."""
    fs, where = _open(spark, path)
    _, target = _open(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(where, target):
        raise OSError(f"{path} could not be moved to {to}")
