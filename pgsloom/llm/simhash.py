"""Near duplicates by SimHash: fingerprints within a few bits are linked, links make components.

The 64 bits are cut into three segments. Of up to four differing bits one segment has at most one, so each fingerprint
is indexed under 64 keys: a segment with one of its bits left out. Two fingerprints that agree on a segment but for one
bit share the key without that bit. Keys are joined by equality, and the join itself verifies the distance and lets a
pair through under one key only (the first that the two can share). Many fingerprints make keys of one segment too
common: they are shared by chance, the more often the larger the table. Then a key holds some other bits too. Either a
segment has no difference, and then one of five pieces of the other bits has none; or each has one at least, and then two
have just one, so the one agrees but for a bit and the other one in one of its halves. That makes 15 and 128 keys of some
30 bits. Neither way loses a link.

Defined cases: a null text counts as empty and has fingerprint zero; documents with equal fingerprints are one node, so
exact copies never make pairs; a null doc_id is skipped as a component's name unless it is all there is; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pgsloom.llm.common import components, cut, in_slices, table

SEGMENTS = ((0, 22), (22, 43), (43, 64))
#: One salt for each round: the least of ``node ^ salt`` picks a node, and turning it back gives the node.
SALTS = (0x0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x27BB2EE687B0B0FD)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a whole text over its word shingles, repeats included, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly the six white space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), dtype=np.uint64, count=n)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype("<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * set_bits > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for each document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(parts):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in part.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {id_type}, fp bigint")


def _bits(low: int, high: int) -> int:
    value = ((1 << high) - 1) ^ ((1 << low) - 1)
    return value - (1 << 64) if value >> 63 else value


def _by_segment(form: str) -> Column:
    """A CASE over the segment that the column ``bit`` lies in; the form may use {mask} and {low}."""
    cases = [f"when bit < {high} then " + form.format(mask=f"{_bits(low, high)}L", low=low) for low, high in SEGMENTS]
    return F.expr(f"case {' '.join(cases)} end")


def masks() -> list[int]:
    """The bits of a fingerprint that its 143 longer keys hold, as signed integers."""
    out = []
    for i, (low, high) in enumerate(SEGMENTS):
        others = [b for b in range(64) if not low <= b < high]
        out += [_bits(low, high) | sum(_bits(b, b + 1) for b in others[at : at + 9]) for at in range(0, 45, 9)]
        start, stop = SEGMENTS[(i + 1) % 3]
        middle = (start + stop) // 2
        out += [_bits(low, high) & ~_bits(b, b + 1) | half for b in range(low, high) for half in (_bits(start, middle), _bits(middle, stop))]
    return out


def keys(fps: DataFrame, pieces: bool, keep: str = "fp") -> DataFrame:
    """(key, ``keep``): 64 keys of a segment a fingerprint, or its 143 longer ones if ``pieces``; those are hashes, so what shares one is to be compared."""
    if pieces:
        return fps.select(F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(masks())])).alias("key"), keep)
    out = fps.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return out.select(F.expr("shiftleft(cast(bit as bigint), 32)").bitwiseOR(_by_segment("shiftrightunsigned(fp & {mask} & ~shiftleft(1L, bit), {low})")).alias("key"), keep)


def links(fps: DataFrame, distance: int = 4, common: int = 8_000_000) -> DataFrame:
    """(a, b) for all pairs of distinct fingerprints a < b that differ in at most ``distance`` (up to four) bits."""
    if not 0 <= distance <= 4:
        raise ValueError("three segments tolerate up to four differing bits")
    deep = fps.count() > common
    index = keys(fps, deep)
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(x) <= distance)
    if not deep:
        near = near & (first_key(x) == F.shiftrightunsigned("key", 32))
    # merge: Spark takes an explode for as many rows as it starts from, and would broadcast 64 keys of each of some 200,000 fingerprints
    found = index.withColumnRenamed("fp", "a").hint("merge").join(index.withColumnRenamed("fp", "b"), "key").filter(near).select("a", "b")
    return found.distinct() if deep else found


def first_key(x: Column) -> Column:
    """The wildcard bit of the first key that two fingerprints with these differing bits share."""
    out = None
    for low, high in SEGMENTS:
        inside = x.bitwiseAND(F.lit(_bits(low, high)))
        # the place of a single set bit is the number of bits below it; no set bit: the segment's first bit
        place = F.when(inside == 0, F.lit(low)).otherwise(F.bit_count(F.shiftrightunsigned(inside, low) - 1) + low)
        out = F.when(F.bit_count(inside) <= 1, place) if out is None else out.when(F.bit_count(inside) <= 1, place)
    return out.cast("long")


def component_links(fps: DataFrame, distance: int = 4, common: int = 0) -> DataFrame:
    """(a, b): links within ``distance`` that give the same components as all of them, but not all pairs of a dense group.

    Longer keys are used for more than ``common`` fingerprints: of random ones hardly any two share one of these, so the keys
    are shuffled once and what several fingerprints have is in proportion to the links. Each fingerprint of such a
    key is compared with a few others of it first (the least under each of ``SALTS``). The links found
    make groups, and a key all of whose fingerprints are in one group is done. In the other keys fingerprints of
    different groups are compared, and one link is kept for each fingerprint and group that it meets. What comes out is in proportion to the
    fingerprints and their keys, however dense they lie.
    """
    fps = fps.distinct()
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance
    here = F.count("*").over(Window.partitionBy("key"))
    index = cut(keys(fps, fps.count() > common).withColumn("n", here).filter("n > 1").select("key", "fp"))
    least = index.groupBy("key").agg(*[F.min(F.expr(f"fp ^ {salt}L")).alias(f"r{i}") for i, salt in enumerate(SALTS)])
    some = least.select("key", F.array_distinct(F.array(*[F.expr(f"r{i} ^ {salt}L") for i, salt in enumerate(SALTS)])).alias("some"))
    # merge: the size that Spark knows of ``index`` and what comes from it is that before the keys were made
    stars = index.join(some.hint("merge"), "key").select(F.col("fp").alias("a"), F.explode("some").alias("b")).filter((F.col("a") != F.col("b")) & near("a", "b"))
    stars = cut(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    groups = components(stars)
    grouped = index.join(groups, index["fp"] == groups["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("group"))
    mixed = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("key")
    open_keys = cut(grouped.join(mixed, "key", "left_semi"))
    left, right = (open_keys.withColumnsRenamed({"fp": c, "group": f"g{c}"}) for c in "ab")
    met = left.join(right, "key").filter((F.col("ga") < F.col("gb")) & near("a", "b"))
    return stars.unionByName(met.groupBy("a", "gb").agg(F.min("b").alias("b")).select("a", "b"))


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each document."""
    found = cut(fingerprints(docs, shingle))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(cut(component_links(nodes.select("fp"), distance)))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(groups, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct word shingles of a whole text (of all its words, if there are fewer)."""
    words = words_of(text)
    own = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in own), dtype=np.uint64, count=len(own)).view(np.int64)


def _nodes(docs: DataFrame) -> DataFrame:
    """Documents by a hash of id and text, under which rows that repeat are one."""
    return docs.select(F.xxhash64("doc_id", "text").alias("node"), "doc_id", "text")


def similar(docs: DataFrame, pairs: DataFrame, width: int, similarity: float, few: int = 4_000_000) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of word shingles have at least this Jaccard similarity.

    The nodes in question are sent to the texts if there are at most ``few`` (8 bytes each), else the texts are shuffled to them.
    """

    def texts_of(pairs: DataFrame, made, schema: str) -> DataFrame:
        wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        if wanted.count() <= few:
            wanted = F.broadcast(wanted)

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in in_slices(parts):
                yield pa.RecordBatch.from_arrays([part.column(0), *made([shingle_hashes(t.as_py(), width) for t in part.column(1)])], names=["node", *[c.split()[0] for c in schema.split(", ")]])

        return cut(_nodes(docs).select("node", "text").join(wanted, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(batches, f"node bigint, {schema}"))

    # first by the numbers of shingles in 512 places: sets that differ in d elements differ by at most d there
    counts = texts_of(pairs, lambda sets: [pa.array([len(x) for x in sets], pa.int64()), pa.array([places(x) for x in sets], pa.list_(pa.int32()))], "n bigint, c array<int>")
    some = pairs
    for side in ("a", "b"):
        some = some.join(counts.select(F.col("node").alias(side), F.col("c").alias(f"c{side}"), F.col("n").alias(f"n{side}")), side)
    differ = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    some = cut(some.filter(differ <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6).select("a", "b"))
    sets = texts_of(some, lambda sets: [pa.array(sets, pa.list_(pa.int64()))], "s array<bigint>")
    both = some.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"))


def places(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall in each of 512 places."""
    return np.bincount(hashes.view(np.uint64) % np.uint64(512), minlength=512).astype(np.int32)


def prefix_length(n: int, similarity: float) -> int:
    """How many of the first of n elements, in any order that all sets share, must have one in common with a similar set."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def parities(hashes: np.ndarray) -> list[int]:
    """512 bits as signed 64-bit integers: bit h mod 512 turns with each element. A difference of d elements turns at most d bits."""
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(512), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _common(docs: DataFrame, width: int, similarity: float, often: int = 20, most: int = 100_000) -> np.ndarray:
    """Shingles that many documents have among their first by hash, sorted: at most ``most``, the commonest.

    A task sends the shingles that it sees more than once. Which ones are called common changes the work, not the result.
    """

    def firsts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in in_slices(parts):
            owns = [np.sort(shingle_hashes(t.as_py(), width)) for t in part.column(0)]
            first = [x[: prefix_length(len(x), similarity)] for x in owns]
            both = np.concatenate([keys, *first])
            weights = np.concatenate([counts, np.ones(len(both) - len(keys), np.int64)])
            keys, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, weights, minlength=len(keys)).astype(np.int64)
        seen = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[seen]), pa.array(counts[seen])], names=["key", "n"])

    counts = docs.select("text").mapInArrow(firsts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > often)
    return np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(most).collect()], np.int64))


def near_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, lowest: int = 4) -> DataFrame:
    """(node, doc_id, stays) for documents in groups linked by five-word shingle similarity; one of each group stays.

    First come the SimHash links of this module, over shingles of this width: documents of one component are compared
    with a few of it (the least under each of ``SALTS``), and so are documents that share one of their ``lowest`` least
    shingle hashes. This joins a large group of near copies by few links and decides nothing else, as a similarity
    of 0.8 turns about ten of 64 bits and no index of one-wildcard keys reaches that far. So all pairs that are not yet in
    one group and may have the similarity are then found by the prefix filter: in an order that all documents share
    (common shingles last, then by hash), similar sets have an element in common among their first fifth and one. A pair
    goes only where it cannot be similar: by the sizes, by the places of the shared shingle, or because the parity bits
    differ in more places than the sets may. What is left is compared by the exact sets, so no pair is lost. The documents
    of a shingle's largest group are not paired with each other, so a group that holds much of the table costs its size.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, width, similarity))

    def described(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.append(shared.value, np.iinfo(np.int64).max)
        for part in in_slices(parts):
            rows = []
            for t in part.column(2):
                own = np.sort(shingle_hashes(t.as_py(), width))
                late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                rows.append((len(own), fingerprint(t.as_py(), width), parities(own), own[:lowest], np.concatenate((own[~late], own[late]))[: prefix_length(len(own), similarity)]))
            n, fps, bits, low, first = zip(*rows) if rows else [()] * 5
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bits, low, first)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), *lists], names=["node", "doc_id", "n", "fp", "bits", "low", "first"])

    # rows that repeat are one node and stay beside each other here: no step pairs a node with itself
    found = cut(_nodes(docs).mapInArrow(described, f"node bigint, doc_id {id_type}, n bigint, fp bigint, bits array<bigint>, low array<bigint>, first array<bigint>"))
    sketch = found.select("node", F.struct("n", "bits").alias("sketch")).dropDuplicates(["node"])

    def possible(p: str, q: str) -> Column:
        """Neither the sizes nor the parity bits of two documents rule the similarity out."""
        differ = " + ".join(f"bit_count({p}.bits[{i}] ^ {q}.bits[{i}])" for i in range(8))
        sizes = F.least(f"{p}.n", f"{q}.n") >= similarity * F.greatest(f"{p}.n", f"{q}.n") - 1e-6
        return sizes & (F.expr(differ) <= (1 - similarity) / (1 + similarity) * (F.col(f"{p}.n") + F.col(f"{q}.n")) + 1e-6)

    def described_pairs(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), each once, that the sketches let through."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        for side in ("a", "b"):
            pairs = pairs.join(sketch.select(F.col("node").alias(side), F.col("sketch").alias(f"s{side}")), side)
        return cut(pairs.filter(possible("sa", "sb")).select("a", "b"))

    alike = components(cut(links(found.select("fp").distinct()))).select(F.col("node").alias("fp"), F.xxhash64(F.lit("component"), "root").alias("component"))
    own = F.array_compact(F.array_append("low", F.coalesce("component", F.xxhash64(F.lit("component"), "fp"))))
    whole = found.join(alike, "fp", "left").select("node", F.explode(own).alias("key"))
    least = [F.min(F.expr(f"node ^ {salt}L")).alias(f"r{i}") for i, salt in enumerate(SALTS)]
    some = whole.groupBy("key").agg(F.count("*").alias("n"), *least).filter("n > 1")
    some = some.select("key", F.array_distinct(F.array(*[F.expr(f"r{i} ^ {salt}L") for i, salt in enumerate(SALTS)])).alias("some"))
    pairs = described_pairs(whole.join(some, "key").select(F.col("node").alias("a"), F.explode("some").alias("b")))
    near = similar(docs, pairs, width, similarity)

    def mixed(index: DataFrame, groups: DataFrame) -> DataFrame:
        """(key, node, group, at, largest) of keys that several groups have; ``largest`` is the one with most rows."""
        by_key = Window.partitionBy("key")
        index = index.join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("group"), "at")
        index = index.withColumn("low", F.min("group").over(by_key)).withColumn("high", F.max("group").over(by_key)).filter("low <> high")
        index = cut(index.select("key", "node", "group", "at"))
        counts = index.groupBy("key", "group").agg(F.count("*").alias("n"))
        return index.join(counts.groupBy("key").agg(F.max(F.struct("n", "group"))["group"].alias("largest")), "key")

    # what is not in a key's largest group is compared with one of that group, another one for each key
    groups = cut(components(near))
    index = mixed(found.select("node", F.posexplode("first").alias("at", "key")), groups)
    one = index.filter("group = largest").groupBy("key").agg(F.min(F.expr("node ^ key")).alias("m")).select("key", F.expr("m ^ key").alias("b"))
    again = described_pairs(index.filter("group <> largest").select("key", F.col("node").alias("a")).join(one, "key").select("a", "b"))
    # a node hangs from its root, which joins what all links so far join: those need not be gone through again
    star = lambda groups: groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
    groups = cut(components(star(groups).unionByName(similar(docs, again.join(pairs, ["a", "b"], "left_anti"), width, similarity))))
    pairs = pairs.unionByName(again)
    index = mixed(index.select("key", "node", "at"), groups)
    # a pair with several keys in common comes at the first: not where an earlier key of both is among the four before
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("at").rowsBetween(-4, -1))
    index = index.withColumn("before", before).join(sketch, "node")
    index = index.select("key", F.struct("node", "group", "at", "before", "sketch.n", "sketch.bits").alias("one"), "largest")
    # no more than the shared shingle and all after it can be common, if it is the first that the two share
    rest = F.least(F.col("p.n") - F.col("p.at"), F.col("q.n") - F.col("q.at")) >= similarity / (1 + similarity) * (F.col("p.n") + F.col("q.n")) - 1e-6
    # p: any document, q: one outside the key's largest group; two of those are paired once
    once = (F.col("p.group") == F.col("largest")) | (F.col("p.node") < F.col("q.node"))
    apart = (F.col("p.group") != F.col("q.group")) & once & rest & possible("p", "q") & ~F.arrays_overlap("p.before", "q.before")
    more = index.withColumnRenamed("one", "p").join(index.filter("one.group <> largest").select("key", F.col("one").alias("q")), "key").filter(apart)
    more = more.select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")  # compared before
    roots = cut(components(star(groups).unionByName(similar(docs, cut(more), width, similarity))))
    named = found.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("node").alias("best"))).alias("m"))
    return named.join(best, "root").select("node", "doc_id", (F.col("node") == F.col("m.best")).alias("stays"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group of near duplicates (the smallest doc_id), columns as they are."""
    columns = docs.columns
    stay = near_components(docs, width, similarity).filter("stays").select(F.col("node").alias("__stay"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.xxhash64("doc_id", "text").alias("__node"))
    return rows.join(stay, F.col("__node") == F.col("__stay"), "left_semi").dropDuplicates(["__node"]).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
