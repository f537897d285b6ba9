"""Token counts by scanning flat token files for separators.

A flat token file holds nothing but token ids of fixed width, each document followed by an end-of-document id; there is
no index. Files are cut into blocks of bytes that tasks read by range. In each block the separators are found with one
vectorised comparison. A document may begin blocks before it ends, so blocks are stitched by a prefix scan: the last
separator before a block (a running maximum) gives where its first document begins, and the number of separators before
it (a running sum) gives that document's place in the file. Tokens after the last separator are a document that is not
ended.

Files are read and written through Arrow's file systems by URI, so local, HDFS and object stores do alike. A writer's
task writes a file of its own under another name and then renames it, so a task that runs again leaves the same file.

Defined cases: a null or empty text is a document of no tokens; repeated rows and null doc_ids are documents of their
own; an empty file has no documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pgsloom.llm.common import cut, remove, shared_folder, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Places that are an end of a piece under that pattern whatever is around them: before a space or line feed that follows
#: something else, and where a run of letters or numbers meets ASCII or punctuation of another kind.
BOUNDARY = regex.compile(r"(?<=\S)(?=[ \n])|(?<=\p{L})(?=[\x00-@\[-`{-\x7f\p{P}])|(?<=\p{N})(?=[\x00-/:-\x7f\p{P}])")


class Tokenizer:
    """A byte-level vocabulary from the bytes of a rank file; the first free id ends a document."""

    def __init__(self, file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None, step: int = 100_000) -> np.ndarray:
        """Ids of a whole text; a very long one is encoded in stretches that end between two pieces, so no id changes."""
        text, out, at = text or "", [], 0
        while at < len(text):
            m = BOUNDARY.search(text, at + step) if len(text) - at > step else None
            to = m.start() if m else len(text)
            out.append(np.array(self.encoding.encode_ordinary(text[at:to]), self.dtype))
            at = to
        return np.concatenate(out) if out else np.zeros(0, self.dtype)


def rank_file(path: str) -> bytes:
    """The vocabulary file, read on the driver; tasks get its bytes (a few MB) with a broadcast."""
    with open(path, "rb") as file:
        return file.read()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write flat token files, one for each partition, and return (file, ordinal, doc_id) of what is in them."""
    shared = docs.sparkSession.sparkContext.broadcast({"file": rank_file(tokenizer)})
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        box = shared.value  # kept by the worker process from task to task
        code = box["code"] = box.get("code") or Tokenizer(box["file"])
        name, n = f"part-{TaskContext.get().partitionId():06d}.bin", 0
        own = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            for part in parts:
                for text in part.column(1):
                    out.write(code.encode(text.as_py()).tobytes() + np.array([code.end], code.dtype).tobytes())
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows, pa.string()), pa.array(range(n, n + rows), pa.int64()), part.column(0)], names=["file", "ordinal", "doc_id"])
                n += rows
        store.move(own, f"{path}/{name}")

    return cut(docs.select("doc_id", "text").mapInArrow(write, f"file string, ordinal bigint, doc_id {id_type}"))


def scan_tokens(spark: SparkSession, folder: str, end: int, dtype: str = "<u2", block_bytes: int = 4 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) for each document of the flat token files of a folder."""
    store, path = fs.FileSystem.from_uri(folder)
    width = np.dtype(dtype).itemsize
    found = [(f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".bin")]
    if not found:
        return spark.createDataFrame([], "file string, ordinal bigint, start bigint, n_tokens bigint, ended boolean")
    per = block_bytes // width * width
    files = spark.createDataFrame(found, "file string, size bigint")
    ranges = files.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {per}"))).alias("block"))
    n_ranges = sum(-(-size // per) for _, size in found)
    ranges = ranges.repartition(max(1, min(n_ranges, 10_000)), "file", "block")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for part in parts:
            for row in part.to_pylist():
                with store.open_input_file(f"{path}/{row['file']}") as f:
                    ids = np.frombuffer(f.read_at(min(per, row["size"] - row["block"] * per), row["block"] * per), dtype)
                at = np.flatnonzero(ids == end) + row["block"] * per // width
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64()))], names=["file", "block", "ends"])

    blocks = ranges.mapInArrow(search, "file string, block bigint, ends array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("ends", F.when(F.size("ends") > 0, -1))
    blocks = blocks.withColumn("last", last).withColumn("n", F.size("ends").cast("long"))
    blocks = blocks.withColumn("open", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).withColumn("place", F.coalesce(F.sum("n").over(before), F.lit(0)))
    docs = blocks.select("file", "open", "place", "ends", F.posexplode("ends").alias("k", "stop"))
    begin = F.when(F.col("k") == 0, F.col("open")).otherwise(F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1)
    docs = docs.select("file", (F.col("place") + F.col("k")).alias("ordinal"), begin.alias("start"), (F.col("stop") - begin).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = blocks.groupBy("file").agg((F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.sum("n").alias("ordinal")).join(files, "file")
    tails = tails.withColumn("n_tokens", F.expr(f"size div {width}") - F.col("start")).filter("n_tokens > 0")
    return docs.unionByName(tails.select("file", "ordinal", "start", "n_tokens", F.lit(False).alias("ended")))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, keep_files: bool = True) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal, start) for each document, from the flat token files of the table.

    The files stay in a folder of their own below the checkpoint folder; without ``keep_files`` they go when the counts
    are written there. What is in the files is joined to the counts by a sort-merge join, as both grow with the table.
    """
    spark, code = docs.sparkSession, Tokenizer(rank_file(tokenizer))
    folder = shared_folder(spark, "tokens")
    manifest = write_tokens(docs, folder, tokenizer)
    counts = scan_tokens(spark, folder, code.end, code.dtype.str)
    out = manifest.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
    if not keep_files:
        out = cut(out)
        remove(spark, folder)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), keep_files=False)
