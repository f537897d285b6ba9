"""Outputs that are there as a whole or not at all: written under another name, checked, and renamed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Refused(ValueError):
    """What was written is too little to take the place of what is there."""


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def footers(spark: SparkSession, path: str) -> dict[str, int]:
    """Files, bytes and rows of a folder of Parquet files; rows come from the footers, no column is read."""
    fs, to = _store(spark, path)
    sizes = [f.getLen() for f in fs.listStatus(to(path)) if f.isFile() and f.getPath().getName().endswith(".parquet")]
    return {"files": len(sizes), "bytes": sum(sizes), "least": min(sizes, default=0), "rows": spark.read.parquet(path).select().count() if sizes else 0}


def replace(rows: DataFrame, path: str, least_rows: int = 1, least_bytes: int = 100) -> dict[str, int]:
    """Write ``rows`` as Parquet in place of what is at ``path``, if it passes the check; else the old state stays.

    The check wants ``least_rows`` rows in all and ``least_bytes`` bytes in every file. The old folder is set aside, the new
    one takes its name, and the old one goes; a process that dies between the two renames leaves both, and ``recover``
    puts the old one back. ``replace`` recovers first.
    """
    spark = rows.sparkSession
    fs, to = _store(spark, path)
    recover(spark, path)
    path = path.rstrip("/")
    new, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        rows.write.parquet(new)
        found = footers(spark, new)
        if found["rows"] < least_rows or found["least"] < least_bytes:
            raise Refused(f"{path}: {found['rows']} rows, smallest file of {found['least']} bytes")
        if fs.exists(to(path)) and not fs.rename(to(path), to(old)):
            raise OSError(f"{path} cannot be renamed")
        if not fs.rename(to(new), to(path)):
            fs.rename(to(old), to(path))
            raise OSError(f"{new} cannot be renamed")
        fs.delete(to(old), True)
        return found
    finally:
        fs.delete(to(new), True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back a folder that a broken replacement had set aside, and delete what it left; whether there was one to put back."""
    fs, to = _store(spark, path)
    at = to(path.rstrip("/"))
    if not fs.exists(at.getParent()):
        return False
    beside = [f.getPath() for f in fs.listStatus(at.getParent())]
    aside = [p for p in beside if p.getName().startswith(f"{at.getName()}.old-")]
    back = bool(aside) and not fs.exists(at)
    if back:
        fs.rename(aside.pop(), at)
    for p in [*aside, *(p for p in beside if p.getName().startswith(f"{at.getName()}.new-"))]:
        fs.delete(p, True)
    return back


def write_document(spark: SparkSession, document: dict, path: str, violations: list[str] | None = None) -> None:
    """Write a JSON document in place of the one at ``path`` by one rename; not if something about it is wrong."""
    if violations:
        raise Refused(f"{path}: {', '.join(violations)}")
    fs, to = _store(spark, path)
    new = to(f"{path}.new-{uuid.uuid4().hex}")
    try:
        out = fs.create(new, False)
        try:
            out.write(json.dumps(document, ensure_ascii=False, sort_keys=True).encode())
        finally:
            out.close()
        jvm = spark._jvm.org.apache.hadoop.fs
        options = spark._sc._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, to(path), options)
    finally:
        fs.delete(new, False)


def read_document(spark: SparkSession, path: str) -> dict:
    fs, to = _store(spark, path)
    file = fs.open(to(path))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
    finally:
        file.close()
