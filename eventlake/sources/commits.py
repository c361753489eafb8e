"""Commit files: what a table shows is what its newest commit names.

A writer lays down data under a name of its own and then commits a small JSON document for its version. The document is
written under a temporary name and renamed, so a reader sees all of a version or nothing of it; a version that is written
again replaces itself. The store must rename files atomically, as HDFS and local disks do.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commit(spark: SparkSession, root: str, version: int, document: dict) -> None:
    fs, target = _fs(spark, f"{root}/_commits/{version:020d}.json")
    _, draft = _fs(spark, f"{root}/_commits/_{version:020d}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(document).encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"commit {version} of {root} could not be renamed")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first."""
    fs, folder = _fs(spark, f"{root}/_commits")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def document(spark: SparkSession, root: str, version: int) -> dict:
    fs, path = _fs(spark, f"{root}/_commits/{version:020d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, dict] | None:
    """The newest version, or the newest one below `before`."""
    known = [v for v in versions(spark, root) if before is None or v < before]
    return (known[-1], document(spark, root, known[-1])) if known else None
