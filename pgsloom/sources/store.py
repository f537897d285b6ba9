"""A keyed table of results in parts, changed by merges that keep everything else that is stored.

A part is a value of one column (a trait). A merge reads the parts that its rows belong to, leaves out old rows with the
same keys, and writes the parts in which anything differs into a folder of their own. What is stored is said by a
manifest, one small file a version that lists the folder of every part; a version comes to be by one rename, so a merge that
breaks off at any point leaves the old state, and readers of an older version are not disturbed. A merge that changes nothing
makes no version. Manifests grow with the number of parts, not with rows.

Defined cases: of rows that repeat a key in one merge the greatest by its other columns stays; null is a value like
others, in keys too; rows without a part (null) have a part of their own; an empty merge changes nothing; columns of a
new version of the program are null in older rows, and older columns stay.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Conflict(RuntimeError):
    """Another writer has made this version in the meantime."""


class ResultStore:
    """``keys`` name a row; ``by`` is the column of parts; ``stamp`` is a column that a changed row gets the time in."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], by: str, stamp: str | None = None):
        self.spark, self.folder, self.keys, self.by, self.stamp = spark, folder.rstrip("/"), keys, by, stamp
        self._jvm = spark._jvm

    # files

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version (the last) holds: its schema, and the folder of each part; None before the first merge."""
        found = self.versions()
        if not found:
            return None
        path = f"{self.folder}/manifest/{found[-1] if version is None else version:09d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        """Write a manifest under another name and give it the next version's name, if nobody has taken it."""
        fs = self._fs()
        path, name = self._path(f"manifest/.{uuid.uuid4().hex}"), f"{manifest['version']:09d}.json"
        out = fs.create(path, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(path, self._path(f"manifest/{name}"), options)
        except Exception as e:
            fs.delete(path, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.folder} has a version {manifest['version']} by another writer") from e
            raise

    # reading

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a filter on the parts' column reads those parts only."""
        said = self.manifest(version)
        if said is None:
            raise FileNotFoundError(f"nothing stored in {self.folder}")
        schema = StructType.fromJson(said["schema"])
        if not said["parts"]:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields, StructField("__write", StringType())])
        paths = [f"{self.folder}/data/{where}/{part}" for part, where in sorted(said["parts"].items())]
        rows = self.spark.read.schema(whole).option("basePath", f"{self.folder}/data").parquet(*paths)
        return rows.select(*[F.col(f"`{c}`") for c in schema.names])

    # changing

    def _same(self, old: str, new: str, columns: list[str]) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(f"{old}.`{c}`").eqNullSafe(F.col(f"{new}.`{c}`"))
        return out

    def _in(self, parts: list) -> Column:
        """Rows of these parts: a filter that prunes folders."""
        named = [p for p in parts if p is not None]
        kept = F.col(self.by).isin(named) if named else F.lit(False)
        return kept | F.col(self.by).isNull() if len(named) < len(parts) else kept

    def _write(self, rows: DataFrame, said: dict, touched: set[str], schema: StructType) -> int:
        """Write parts into a folder of their own and commit: parts that were touched and have no rows now are gone."""
        where = f"__write={uuid.uuid4().hex}"
        rows.write.partitionBy(self.by).parquet(f"{self.folder}/data/{where}")
        written = [n for n in self._names(f"data/{where}") if "=" in n]
        parts = {p: w for p, w in said["parts"].items() if p not in touched} | dict.fromkeys(written, where)
        self._commit({"version": said["version"] + 1, "schema": schema.jsonValue(), "parts": parts})
        return said["version"] + 1

    def _folders(self, parts: list) -> set[str]:
        escape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return {escape(self.by, p if p is None else str(p)) for p in parts}

    def merge(self, new: DataFrame) -> int | None:
        """Store rows: those with the keys of a stored row replace it. The version made, None if nothing differs."""
        batch = f"{self.folder}/batch/{uuid.uuid4().hex}"
        rest = [c for c in new.columns if c not in self.keys and c != self.stamp]
        best = F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__row") if rest else F.count("*").alias("__row")
        one = new.groupBy(*self.keys).agg(best).select(*self.keys, *([F.col(f"__row.`{c}`").alias(c) for c in rest] if rest else []))
        one.write.parquet(batch)  # read several times below
        try:
            return self._merge(self.spark.read.parquet(batch))
        finally:
            self._fs().delete(self._path(f"batch/{batch.rsplit('/', 1)[1]}"), True)

    def _merge(self, new: DataFrame) -> int | None:
        said = self.manifest() or {"version": 0, "parts": {}, "schema": None}
        if self.stamp:
            new = new.withColumn(self.stamp, F.current_timestamp())
        if said["schema"]:
            old = self.read(said["version"])
            more = [f for f in new.schema.fields if f.name not in old.columns]
            for f in more:
                old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
            for f in old.schema.fields:
                new = new.withColumn(f.name, F.lit(None).cast(f.dataType)) if f.name not in new.columns else new
            new = new.select(*[F.col(f"`{c}`").cast(old.schema[c].dataType).alias(c) for c in old.columns])
        else:
            old = self.spark.createDataFrame([], new.schema)
        schema = StructType([StructField(f.name, f.dataType) for f in old.schema.fields])
        parts = [r[0] for r in new.select(self.by).distinct().collect()]  # no more than there are parts
        old = old.filter(self._in(parts))
        values = [c for c in old.columns if c not in self.keys and c != self.stamp]
        beside = new.alias("n").join(old.alias("o").withColumn("__old", F.lit(True)), self._same("o", "n", self.keys), "left")
        alike = F.coalesce(F.col("__old"), F.lit(False)) & self._same("o", "n", values)
        changed = [r[0] for r in beside.filter(~alike).select(F.col(f"n.`{self.by}`")).distinct().collect()]
        if not changed:
            return None
        # an unchanged row keeps its time
        kept = [F.when(alike, F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`")).alias(c) if c == self.stamp else F.col(f"n.`{c}`") for c in old.columns]
        others = old.alias("o").join(new.alias("n"), self._same("o", "n", self.keys), "left_anti")
        whole = beside.select(*kept).unionByName(others).filter(self._in(changed))
        return self._write(whole, said, self._folders(changed), schema)

    def delete(self, gone: DataFrame) -> int | None:
        """Delete the rows that have the values of a row of ``gone`` in its columns; the version made, None if there are none."""
        said = self.manifest()
        if said is None:
            return None
        old, on = self.read(said["version"]), gone.columns
        same = self._same("o", "g", on)
        parts = [r[0] for r in old.alias("o").join(gone.alias("g"), same, "left_semi").select(self.by).distinct().collect()]
        if not parts:
            return None
        rest = old.filter(self._in(parts)).alias("o").join(gone.alias("g"), same, "left_anti")
        return self._write(rest, said, self._folders(parts), StructType.fromJson(said["schema"]))

    def vacuum(self, keep: int = 5) -> int:
        """Delete versions but the last ``keep``, and data that none of those names; the number of folders deleted."""
        fs, found = self._fs(), self.versions()
        for v in found[:-keep]:
            fs.delete(self._path(f"manifest/{v:09d}.json"), False)
        live = {w for v in found[-keep:] for w in self.manifest(v)["parts"].values()}
        dead = [n for n in self._names("data") if n not in live]
        for n in dead:
            fs.delete(self._path(f"data/{n}"), True)
        return len(dead)
