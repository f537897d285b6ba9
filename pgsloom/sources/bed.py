"""Two-bit genotype matrices (.bed) as a Spark data source that reads files by ranges of variants.

``spark.read.format("genotype_bed")`` takes a file or a folder in any store that Arrow opens by URI. The driver sees the
sizes of the files; a task reads its range of bytes, a few variants at a time, and decodes the samples that are asked for.
Filters on ``variant`` and ``sample`` are pushed down to the bytes where the session allows it
(``spark.sql.python.filterPushdown.enabled``), and can be given as options in any case.

Options: ``samples`` (number of samples, required), ``form`` (``long``: a row for each variant and sample; ``panel``: a
row for each variant with the places and dosages of the samples that are called), ``from`` and ``to`` (variants, the end
excluded), ``only`` (samples, by comma), ``rangeBytes``, ``push`` (take filters; ``read_bed`` asks the session).

Defined cases: an empty matrix has no rows; a file that is not variant-major .bed, or whose size does not fit the number
of samples, is an error; a missing genotype is a null dosage in the long form and left out of a panel's arrays.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: The first bytes of a variant-major file, and the copies that two bits stand for (-1: missing).
MAGIC = b"\x6c\x1b\x01"
COPIES = np.array([2, -1, 1, 0], np.int8)
FORMS = {"long": "file string, variant bigint, sample int, dosage smallint", "panel": "file string, variant bigint, at array<int>, dosages array<double>"}
#: Genotypes that a task decodes at once.
AT_ONCE = 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    low: int
    high: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


class BedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):  # names in lower case
        self.path, self.n = options["path"], int(options["samples"])
        self.form, self.width = options.get("form", "long"), (self.n + 3) // 4
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", 1 << 62))
        self.only = sorted({int(x) for x in options["only"].split(",")}) if options.get("only") else list(range(self.n))
        self.per_range = max(1, int(options.get("rangebytes", 16 << 20)) // self.width)

    def files(self) -> list[fs.FileInfo]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        return [f for f in found if f.is_file and f.path.endswith(".bed")]

    def partitions(self) -> list[Range]:
        out = []
        for f in self.files():
            variants, rest = divmod(f.size - len(MAGIC), self.width)
            if rest:
                raise ValueError(f"{f.path}: {f.size} bytes are no matrix of {self.n} samples")
            low, high = max(0, self.low), min(variants, self.high)
            out += [Range(f.path, a, min(high, a + self.per_range)) for a in range(low, high, self.per_range)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file or not self.only:
            return
        store, _ = opened(self.path)
        only = np.array(self.only)
        byte, shift = only // 4, (only % 4 * 2).astype(np.uint8)
        with store.open_input_file(partition.file) as file:
            if file.read_at(len(MAGIC), 0) != MAGIC:
                raise ValueError(f"{partition.file} is not a variant-major .bed file")
            step = max(1, AT_ONCE // max(1, len(only)))
            for a in range(partition.low, partition.high, step):
                b = min(partition.high, a + step)
                raw = np.frombuffer(file.read_at((b - a) * self.width, len(MAGIC) + a * self.width), np.uint8).reshape(b - a, self.width)
                yield self.batch(partition.file, a, COPIES[(raw[:, byte] >> shift) & 3])

    def batch(self, file: str, first: int, calls: np.ndarray) -> pa.RecordBatch:
        variants = first + np.arange(len(calls))
        there = calls >= 0
        if self.form == "panel":
            ends = pa.array(np.concatenate(([0], np.cumsum(there.sum(axis=1)))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.array(self.only, np.int32)[np.nonzero(there)[1]], calls[there].astype(float))]
            return pa.RecordBatch.from_arrays([pa.array([file] * len(calls)), pa.array(variants), *lists], names=["file", "variant", "at", "dosages"])
        n = len(self.only)
        names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(calls.size, np.int32)), pa.array([file])).cast(pa.string())
        columns = [names, pa.array(np.repeat(variants, n)), pa.array(np.tile(np.array(self.only, np.int32), len(calls))), pa.array(calls.ravel().astype(np.int16), mask=~there.ravel())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "variant", "sample", "dosage"])


class PushingBedReader(BedReader):
    """The reader for sessions that let Python sources take filters (Spark refuses one that could, where they do not)."""

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            name, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if name == "variant" and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value + 1)
            elif name == "variant" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif name == "variant" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            elif name == "sample" and isinstance(f, (EqualTo, In)):
                self.only = sorted(set(self.only) & set(value if isinstance(f, In) else [value]))
            else:
                yield f


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "genotype_bed"

    def schema(self) -> str:
        return FORMS[self.options.get("form", "long")]

    def reader(self, schema) -> BedReader:
        return (PushingBedReader if self.options.get("push") == "true" else BedReader)(dict(self.options))


def read_bed(spark: SparkSession, path: str, n_samples: int, **options: object) -> DataFrame:
    """(variant, sample, dosage) of variant-major .bed files, or a panel of arrays (``form="panel"``)."""
    spark.dataSource.register(BedSource)
    named = {k.rstrip("_"): ",".join(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in options.items()}
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("genotype_bed").options(samples=n_samples, push=push, **named).load(path)
