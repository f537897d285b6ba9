"""Exact duplicates by a persistent index of digests, bucketed and sorted by digest.

Two texts are equal when they are identical after all white space is deleted. The index is a table with one row for
each digest ever seen. A new batch is matched against it by a sort-merge anti-join in which the index needs neither a
shuffle nor a sort; digests that are new are appended with their best row, and of those that were there already a row
goes to a second table of the same buckets, since a later copy may be longer than the one that stays. The state of a digest
is its index row and those later rows, joined bucket by bucket. All of it is DataFrame operations.

Both tables lie in the shared checkpoint folder unless another one is given. Each batch has a name of its own; to add
one that the index holds is an error, not a second count.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null doc_id comes after all others;
rows that repeat a doc_id are the same document; of rows equal in length and id any may stay, as they are alike but for
white space; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.llm.common import SPACE, cut, remove, shared_folder, table


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_points): SHA-256 of the text without white space, and the code points of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("digest"), F.char_length(text).cast("long").alias("n_points"))


def winners(found: DataFrame) -> DataFrame:
    """For each digest the row that stays (most code points, then smallest doc_id) and the number of rows."""
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
    return found.groupBy("digest").agg(best.alias("b"), F.count("*").alias("group_size")).select("digest", F.col("b.d").alias("keep_id"), (-F.col("b.n")).alias("keep_points"), "group_size")


BEST = "struct(-n_points as n, doc_id is null as z, doc_id as d)"


class DigestIndex:
    """Tables ``name`` (digest, keep_id, keep_points, n, batch), a row a digest, and ``name_later``, a row a digest and later batch.

    An index is known by its folder, not by the session's catalog: the folder holds both tables' files and a small list of
    the batches that are in it, and a session that opens it again registers the tables with their buckets as they are. A
    batch counts from the moment it is in that list; what a batch left that broke off before is never read. A folder
    that has files but no list is refused.
    """

    LIST = "batches.json"

    def __init__(self, spark: SparkSession, name: str, buckets: int = 32, folder: str | None = None):
        self.spark, self.name = spark, name
        self.folder = (folder or shared_folder(spark, name)).rstrip("/")
        self.about = self._load() or {"buckets": buckets, "schema": None, "batches": {}}
        self.buckets = self.about["buckets"]
        if self.about["schema"]:
            for table in (name, f"{name}_later"):
                self._register(table)

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _load(self) -> dict | None:
        store, path = self._path(self.LIST)
        if store.exists(path):
            return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])
        store, path = self._path()
        if store.exists(path) and len(store.listStatus(path)):
            raise ValueError(f"{self.folder} has files that are no index")
        return None

    def _save(self) -> None:
        """Write the list under another name and put it in place of the old one by one rename."""
        (store, path), (_, new) = self._path(self.LIST), self._path(f".{uuid.uuid4().hex}")
        out = store.create(new, False)
        try:
            out.write(json.dumps(self.about).encode())
        finally:
            out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, path, options)

    def _register(self, table: str) -> None:
        """Make a table of this folder known to the session, with the buckets that its files were written in."""
        where = f"{self.folder}/{'later' if table.endswith('_later') else 'first'}"
        if self.spark.catalog.tableExists(table):
            known = next(r["data_type"] for r in self.spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r["col_name"] == "Location")
            if re.sub("^file:/+", "/", known) != re.sub("^file:/+", "/", where):
                raise ValueError(f"the session has a table {table} in {known}")
            return
        self.spark.sql(f"CREATE TABLE {table} ({self.about['schema']}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def _append(self, rows: DataFrame, name: str) -> None:
        # one file a bucket and batch, as rows were dealt by the hash that also picks the bucket
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(name)

    def drop(self) -> None:
        """Forget the index and delete its files."""
        for name in (self.name, f"{self.name}_later"):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.folder)

    def _rows(self, name: str) -> DataFrame:
        """The rows of a table that belong to a listed batch."""
        return self.spark.table(name).filter(F.col("batch").isin(list(self.about["batches"].values())))

    def add(self, found: DataFrame, batch: str) -> None:
        """Append the digests (doc_id, digest, n_points) of a batch: new ones by anti-join to the index, the others beside it."""
        if batch in self.about["batches"]:
            raise ValueError(f"batch {batch!r} is in the index already")
        own = f"{batch}/{uuid.uuid4().hex}"  # another try of a batch that broke off has another name
        groups = winners(found).select("digest", "keep_id", "keep_points", F.col("group_size").alias("n"), F.lit(own).alias("batch"))
        groups = cut(groups.repartition(self.buckets, "digest"))
        if self.about["schema"] is None:
            self.about["schema"] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields)
            for table in (self.name, f"{self.name}_later"):
                self._register(table)
        if self.about["batches"]:
            index = self._rows(self.name).select("digest").hint("merge")
            # both are worked out before either table grows
            fresh, again = cut(groups.join(index, "digest", "left_anti")), cut(groups.join(index, "digest", "left_semi"))
            self._append(fresh, self.name)
            self._append(again, f"{self.name}_later")
        else:
            self._append(groups, self.name)
        self.about["batches"][batch] = own
        self._save()

    def state(self) -> DataFrame:
        """(digest, keep_id, keep_points, group_size, batch) of each digest over all batches; batch is the first."""
        later = self._rows(f"{self.name}_later").withColumnsRenamed({"keep_id": "doc_id", "keep_points": "n_points"})
        later = later.groupBy("digest").agg(F.min(F.expr(BEST)).alias("l"), F.sum("n").alias("more"))
        first = self._rows(self.name).withColumn("f", F.expr(BEST.replace("n_points", "keep_points").replace("doc_id", "keep_id")))
        both = first.join(later.hint("merge"), "digest", "left").withColumn("b", F.least("f", "l"))
        return both.select("digest", F.col("b.d").alias("keep_id"), (-F.col("b.n")).alias("keep_points"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"), "batch")

    def dedup(self, docs: DataFrame, batch: str) -> DataFrame:
        """Match a batch against the index, append what is new, and return a row for each document of the batch.

        A document is kept if no batch before had its text and it is the best of the texts equal to it in this batch.
        keep_id and group_size are those over all batches so far.
        """
        found = cut(digests(docs))
        self.add(found, batch)
        own = winners(found).select("digest", F.col("keep_id").alias("own_id"))
        state = cut(self.state().join(own.hint("merge"), "digest").withColumn("fresh", F.col("batch") == self.about["batches"][batch]))
        kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("own_id"))
        return found.join(state, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def index_of(found: DataFrame, buckets: int = 32, batches: int = 2) -> DataFrame:
    """(digest, keep_id, keep_points, group_size): digests run through an index of their own, batch after batch.

    Rows are dealt to batches by a hash of their id. The index goes when the result is written, or when that fails.
    """
    index = DigestIndex(found.sparkSession, f"digests_{uuid.uuid4().hex}", buckets)
    try:
        for k in range(batches):
            index.add(found.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(batches)) == k), str(k))
        return cut(index.state().drop("batch"))
    finally:
        index.drop()


def exact_dedup(docs: DataFrame, buckets: int = 32, batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each document of one table."""
    found = cut(digests(docs))
    groups = index_of(found, buckets, batches)
    # both sides are dealt by the join itself, so that a digest with very many rows is split at run time
    return found.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with their columns as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("__digest"), F.char_length(text).cast("long").alias("__n"))
    keep = index_of(cut(digests(docs)))
    on = (F.col("__digest") == F.col("digest")) & F.col("__row.doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__n") == F.col("keep_points"))
    return mine.join(keep, on, "left_semi").dropDuplicates(["__digest"]).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, length(t) as n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as h from d),
r as (select doc_id, h, row_number() over (partition by h order by n desc, doc_id) as k, count(*) over (partition by h) as c,
             first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id from n)
select doc_id, keep_id, cast(c as bigint) as group_size, doc_id = keep_id as kept, h as text_sha256 from r
"""
