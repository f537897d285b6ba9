"""Substring deduplication by level-wise doubling of repeated windows of words.

A window of ``window`` words that repeats holds a shorter run of words that repeats. Levels go from a short length to
twice that length and so on up to the window: of each window still in question, one run of the level's length (the one
with the least hash, so equal windows choose alike) is looked for over the corpus, and a window whose run is in one block of documents only
is settled there. What is left at the last level is compared as whole windows; every occurrence but the earliest is covered.

Documents are dealt to blocks by doc_id and text once; every level reads the blocks from that one shuffle. A block sends
each key and each window only once, whatever the number of its occurrences in the block, so that a passage found in a
third of all documents makes as many rows as there are blocks, not as there are documents. Whole windows are compared by a
window function over their hashes: sorted and spilled by Spark, never gathered in a Python task.

A word's hash is two polynomials of its bytes modulo two primes; a window is known by two 64-bit hashes of its words'
hashes, 128 bits in all. Levels use the first only: they choose what is compared and remove nothing.

Defined cases: a null or empty text has no words and the digest of the empty string; windows do not cross documents;
rows that repeat a doc_id count as documents of their own, ordered by a hash of the text, then by the text; a null doc_id
comes last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pgsloom.llm.common import table, trim

BASE = np.uint64(0x9E3779B97F4A7C15)
#: For the second hash of a window.
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
#: Two primes below 2^31 and a base of each.
PRIMES = ((2**31 - 1, 1_330_147_213), (2**31 - 19, 872_631_407))
STEP = 1 << 20


def _power(n: int, base: np.uint64 = BASE) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.cache
def powers(prime: int, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)))
    return out[:n]


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prime: int, base: int) -> np.ndarray:
    """For each range of at most STEP bytes in all, the polynomial of its bytes, turned down to its own start."""
    n = np.uint64(prime)
    # a term is below 2^8 * 2^31 and there are 2^20 of them: no sum overflows
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * powers(prime, base, STEP)[: len(data)])))
    return (sums[ends] - sums[starts]) % n * powers(prime, pow(base, -1, prime), STEP)[starts] % n


def _long_word(word: bytes) -> int:
    """The hash of a word above STEP bytes, where sums of bytes could overflow."""
    return int.from_bytes(hashlib.sha256(word).digest()[:8], "little")


def word_hashes(data: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 bytes, by running sums of byte values times powers of a base."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # a stretch of whole words at a time
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        if high - low > STEP:  # a single word, as a stretch of more is cut to ``step``
            out[at] = _long_word(data[low:high].tobytes())
        else:
            s, e = starts[at:to] - low, ends[at:to] - low
            one, two = (_polynomials(data[low:high], s, e, *p) for p in PRIMES)
            out[at:to] = mixed((one << np.uint64(31) | two) + (e - s).astype(np.uint64) * OTHER)
        at = to
    return out, starts, ends


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if k < width else h


class Doc:
    """Words of one document, with the hashes of its windows."""

    def __init__(self, text: str | None, window: int):
        self.raw = (text or "").encode()
        data = np.frombuffer(self.raw, np.uint8)
        self.words, starts, ends = word_hashes(data)
        small = np.int32 if len(data) < 1 << 31 else np.int64
        self.starts, self.ends = starts.astype(small), ends.astype(small)
        self.window, self.n = window, max(0, len(self.words) - window + 1)

    def runs(self, length: int, base: np.uint64 = BASE) -> np.ndarray:
        """Hashes of all runs of ``length`` words, built by doubling where the length is even."""
        if length % 2 == 0:
            half = self.runs(length // 2, base)
            return half[: -(length // 2)] * _power(length // 2, base) + half[length // 2 :]
        out = self.words[: len(self.words) - length + 1].copy()
        for j in range(1, length):
            out = out * base + self.words[j : len(self.words) - length + 1 + j]
        return out

    def keys(self, length: int) -> np.ndarray:
        """For each window the least mixed hash of its runs of ``length`` words."""
        return least(mixed(self.runs(length)), self.window - length + 1)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window."""
        return mixed(self.runs(self.window)), mixed(self.runs(self.window, OTHER))


def _sorted_docs(block: pa.Table) -> list[tuple]:
    """(doc_id, text, hash of the text) of a block in the order that says which document is earlier."""
    rows = zip(*[block.column(c).to_pylist() for c in ("doc_id", "text", "th")])
    return sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[2], r[1] is not None, r[1] or ""))


def _known(survivors: pa.Table, length: int | None) -> np.ndarray | None:
    return None if length is None else np.sort(survivors.column("key").to_numpy().astype(np.int64).view(np.uint64))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def level_keys(block: pa.Table, survivors: pa.Table | None, window: int, before: int | None, length: int) -> np.ndarray:
    """The keys of one level in one block, each once."""
    known, found = _known(survivors, before), [np.zeros(0, np.uint64)]
    for text in block.column("text").to_pylist():
        doc = Doc(text, window)
        if doc.n:
            k = doc.keys(length)
            if known is not None:
                k = k[_among(doc.keys(before), known)]
            found.append(k[np.concatenate(([True], k[1:] != k[:-1]))] if len(k) else k)
    return np.unique(np.concatenate(found))


def firsts(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which windows are the first with both of their hashes."""
    out = np.zeros(len(one), bool)
    order = np.argsort(one, kind="stable")
    in_order = one[order]
    same = in_order[1:] == in_order[:-1]
    del in_order
    if (two[order][1:] == two[order][:-1])[same].all():  # equal by the first hash: equal by the other
        new = ~same
    else:  # a collision
        order = np.lexsort((np.arange(len(one)), two, one))
        new = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    out[order[:1]] = True
    out[order[1:][new]] = True
    return out


def _windows(docs: list[tuple], window: int) -> tuple[list[Doc], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, the two hashes of all windows in order, where each document's windows begin, which are the first of their kind."""
    parsed = [Doc(text, window) for _, text, _ in docs]
    offsets = np.concatenate(([0], np.cumsum([d.n for d in parsed], dtype=np.int64)))
    one, two = (np.empty(offsets[-1], np.uint64) for _ in range(2))
    for d, a, b in zip(parsed, offsets, offsets[1:]):
        if d.n:
            one[a:b], two[a:b] = d.whole()
    return parsed, one, two, offsets, firsts(one, two)


def window_rows(block: pa.Table, survivors: pa.Table, window: int, length: int) -> pa.Table:
    """(one, two, doc_id, th, place, at): windows that may repeat elsewhere and are new in the block."""
    known = _known(survivors, length)
    docs = _sorted_docs(block)
    parsed, one, two, offsets, first = _windows(docs, window)
    found = [np.flatnonzero(_among(d.keys(length), known) & first[offsets[i] : offsets[i + 1]]) if d.n else np.zeros(0, np.int64) for i, d in enumerate(parsed)]
    place = np.repeat(np.arange(len(found)), [len(x) for x in found])
    at = np.concatenate([np.zeros(0, np.int64), *found])
    which = offsets[place] + at
    order = pa.table({"doc_id": pa.array([d for d, _, _ in docs], block.schema.field("doc_id").type), "th": pa.array([h for _, _, h in docs], pa.int64())}).take(pa.array(place))
    columns = [pa.array(x[which].view(np.int64)) for x in (one, two)] + [order.column(0), order.column(1), pa.array(place, pa.int32()), pa.array(at, pa.int32())]
    return pa.table(columns, names=["one", "two", "doc_id", "th", "place", "at"])


def finish(block: pa.Table, marks: pa.Table, window: int) -> Iterator[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) for each document of a block, given the windows that start earlier in other blocks."""
    docs = _sorted_docs(block)
    parsed, _, _, offsets, first = _windows(docs, window)
    covered = ~first
    if marks.num_rows:
        place, at = (marks.column(c).to_numpy().astype(np.int64) for c in ("place", "at"))
        covered[offsets[place] + at] = True
    for i, doc in enumerate(parsed):
        n = len(doc.words)
        gone = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(covered[offsets[i] : offsets[i + 1]])
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
        keep = np.flatnonzero(np.cumsum(gone)[:n] == 0)
        raw, s, e = doc.raw, doc.starts, doc.ends
        kept = b" ".join([raw[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist())])
        yield docs[i][0], n, n - len(keep), hashlib.sha256(kept).hexdigest()


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def substring_dedup(docs: DataFrame, window: int = 20, shortest: int = 5, block_mb: float = 24) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) after words covered by a window that also starts earlier are removed.

    Levels are ``shortest``, twice that, and so on below ``window``. A block holds about ``block_mb`` of text.
    """
    levels = [shortest]
    while levels[-1] * 2 < window:
        levels.append(levels[-1] * 2)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    n_blocks = max(1, round((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (block_mb * 2**20)))
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "th"), F.lit(n_blocks)).cast("int"))
    dealt = blocks.groupBy("block")

    def level(before: int | None, length: int):
        def made(left, right=None):
            keys = level_keys(left, right, window, before, length)
            trim()
            return pa.table([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), left.column("block")[0].as_py() if left.num_rows else 0, np.int32))], names=["key", "block"])

        return (lambda left: made(left)) if before is None else (lambda left, right: made(left, right))

    survivors, before = None, None
    for length in levels:
        work = dealt if survivors is None else dealt.cogroup(survivors.groupBy("block"))
        rows = work.applyInArrow(level(before, length), "key bigint, block int")
        # a key has one row a block; what only one block has is settled in that block
        survivors, before = rows.withColumn("many", F.expr("count(*) over (partition by key)")).filter("many > 1").select("block", "key"), length

    def whole(key, left, right):
        out = window_rows(left, right, window, before)
        trim()
        return out.append_column("block", pa.array(np.full(out.num_rows, key[0].as_py() or 0, np.int32)))

    windows = dealt.cogroup(survivors.groupBy("block")).applyInArrow(whole, f"one bigint, two bigint, doc_id {kind}, th bigint, place int, at int, block int")
    # a window has one row a block: every row but the first in the order of documents starts later than another
    order = Window.partitionBy("one", "two").orderBy(F.col("doc_id").asc_nulls_last(), "th", "place", "at")
    marks = windows.withColumn("nth", F.row_number().over(order)).filter("nth > 1").select("block", "place", "at")

    def last(key, left, right):
        found = list(finish(left, right, window))
        trim()
        return _table(found, ["doc_id", "n_words", "n_removed", "kept_sha256"], [arrow, pa.int64(), pa.int64(), pa.string()])

    return dealt.cogroup(marks.groupBy("block")).applyInArrow(last, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
k as (select doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as nth from k) where nth > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from later),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
left_over as (select words.doc_id, count(*) as n, string_agg(word, ' ' order by words.j) as kept from words anti join gone on words.doc_id = gone.doc_id and words.j = gone.j group by words.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join left_over on w.doc_id = left_over.doc_id
"""
