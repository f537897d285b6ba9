"""Scoring files: gzip TSV with comment lines and one of several headers."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.plans import etl


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names: the first line that is neither blank nor a comment."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).limit(1).collect()
    return lines[0]["value"].split("\t") if lines else []


def read_strings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings."""
    return spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)


def read_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Lines that do not fit the header are left out."""
    return spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False, mode="DROPMALFORMED")


def read_headerless(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=False, comment="#", inferSchema=False).toDF(*names)


def headers(spark: SparkSession, paths: str | list[str], step: int = 1 << 16) -> DataFrame:
    """(file, header, bytes_read) of many files: the first line that is neither blank nor a comment.

    Files are listed by Spark, which reads no content for that; a task opens each of its files and reads, and unpacks if the
    name ends in .gz or .bgz, no more than ``step`` bytes at a time until the line is complete. So what is read does not grow with the
    files. A file without such a line is left out.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    tasks = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, length in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                packed = name.endswith((".gz", ".bgz"))
                with store.open_input_file(name) as file:
                    line, read = first_line(lambda at, n: file.read_at(n, at), length, step, packed)
                if line is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([line]), pa.array([read], pa.int64())], names=["file", "header", "bytes_read"])

    return files.repartition(tasks, "path").mapInArrow(first, "file string, header string, bytes_read bigint")


def first_line(read_at: Callable[[int, int], bytes], length: int, step: int, packed: bool) -> tuple[str | None, int]:
    """The first line in use of a file that is read piece by piece, and how many bytes that took."""
    unpack, at, rest = zlib.decompressobj(31) if packed else None, 0, b""
    while at < length:
        piece = read_at(at, min(step, length - at))
        at += len(piece)
        while piece:
            rest += unpack.decompress(piece) if unpack else piece
            piece = unpack.unused_data if unpack and unpack.eof else b""
            if piece:  # the next member of a file in blocks
                unpack = zlib.decompressobj(31)
        *lines, rest = rest.split(b"\n")
        for line in lines if at < length else [*lines, rest]:
            text = line.decode(errors="replace").rstrip("\r")
            if text.strip() and not text.startswith("#"):
                return text, at
    return None, at


def read_scores(spark: SparkSession, paths: str, pgs_id: str = r"(PGS\d{6})") -> DataFrame:
    """Files of any layout as one pack: files of the same header are one read; the id of a score is in its file's name."""
    groups = defaultdict(list)
    for r in headers(spark, paths).collect():  # one row a file
        groups[r["header"]].append(r["file"])
    tables = []
    for files in groups.values():
        rows = read_strings(spark, sorted(files))
        tables.append(rows.withColumn("pgs_id", F.regexp_extract(F.input_file_name(), pgs_id, 1)))
    return etl.etl(tables)
