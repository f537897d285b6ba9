"""Periodic runs of words: stretches that repeat a period three times or more.

Names of all stretches of 1, 2, 4, ... words come from pairs of names of half the length, the way of Karp, Miller and
Rosenberg; two stretches of one length are equal if and only if their names are. The common extension of two places is
read off by going down the levels, one step a level. A run of period q has the same words at i and i + q for all i of an
interval of at least max(2 q, shortest - q) places. So a grid of a coarser step than q meets it: at one grid place at
least the 2^k words from there on are equal to those q further, 2^k being half the interval's least length. Grid places
that fail this one comparison of names go; the others are extended both ways. Names stop at the length at which no
stretch repeats, so a text in which no eight words repeat costs three sorts. Everything is exact: no hash, no suffix
sorting. Work is n log n for the candidates of n words and log n for each that is extended; candidates come in chunks of
bounded size, so memory is that of the names (four bytes a word and level that has repeats).

A stretch has several periods if it repeats often enough; all of them are found on the same words, and the smallest stays.

Defined cases: a null or empty text has no words and no runs; a null doc_id has no hash and so its words stay as they
are; repeated rows and null doc_ids are documents of their own; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pgsloom.llm.common import table

CHUNK = 1 << 19


class Runs(NamedTuple):
    """Runs by start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """Level k names the stretch of 2^k words from each place; the last level is the last on which a name repeats."""
    levels, width = [words], 1
    while 2 * width < len(words):
        low = levels[-1]
        m = len(low) - width
        pairs = low[:m].astype(np.int64) * (int(low.max()) + 1) + low[width:]
        found, named = np.unique(pairs, return_inverse=True)
        if len(found) == m:
            break
        levels.append(named.astype(np.int32))
        width *= 2
    return levels


def extension(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places i < j on (or before them) are equal; below twice the top level's width for any pair."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, names = 1 << k, levels[k]
        if back:
            a, b = i - out - width, j - out - width
            fits = a >= 0
        else:
            a, b = i + out, j + out
            fits = b + width <= n
        at = np.flatnonzero(fits)
        at = at[names[a[at]] == names[b[at]]]
        out[at] += width
    return out


def candidates(n: int, shortest: int, repeats: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Grid places in chunks: (place, period, level of the names to compare, least interval of equal pairs)."""
    q = np.arange(1, n // repeats + 1, dtype=np.int64)
    least = np.maximum((repeats - 1) * q, shortest - q)
    q, least = q[least + q <= n], least[least + q <= n]
    level = np.frexp(np.maximum(least // 2, 1).astype(float))[1] - 1
    q, least, level = (x[level <= top] for x in (q, least, level))
    step = least - (1 << level) + 1
    count = (n - q - (1 << level)) // step + 1
    ends = np.cumsum(count)
    for low in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        flat = np.arange(low, min(low + CHUNK, int(ends[-1])))
        of = np.searchsorted(ends, flat, side="right")
        yield (flat - (ends - count)[of]) * step[of], q[of], level[of], least[of]


def find_runs(words: np.ndarray, shortest: int = 24, repeats: int = 3) -> Runs:
    """All runs of at least ``shortest`` words and ``repeats`` times their smallest period, over numbered words."""
    levels, found = name_levels(words), []
    for place, q, level, least in candidates(len(words), shortest, repeats, len(levels) - 1):
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            names = levels[k]
            at = at[names[place[at]] == names[place[at] + q[at]]]
            i, j = place[at], place[at] + q[at]
            before = extension(levels, i, j, back=True)
            equal = before + extension(levels, i, j)
            far = equal >= least[at]
            found.append(np.stack([i - before, equal + q[at], q[at]])[:, far])
    if not found:
        return Runs(*np.zeros((3, 0), np.int64))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)  # of equal stretches the one with the smallest period
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return Runs(start[order], length[order], period[order])


def repeated(runs: Runs, n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:-1]) > 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word by a number, equal for equal words."""
    ids: dict[bytes, int] = {}
    return np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int32, len(words))


def periodic_source(n: int, doc_id: int | None) -> np.ndarray | None:
    """For one id in ten the word that stands at each place instead: from some place on the text repeats a period; else None."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    a, g = h // 10 % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def periodic_runs(docs: DataFrame, shortest: int = 24, repeats: int = 3, planted: bool = False) -> DataFrame:
    """(doc_id, runs: array of start, length, period, collapsed): runs of each text, and the text with one period of each.

    ``planted`` first repeats the words of one document in ten, as ``periodic_source`` says.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            all_runs, texts = [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = (text.as_py() or "").encode().split()  # on bytes: exactly the six white space bytes
                source = periodic_source(len(words), doc_id) if planted else None
                if source is not None:
                    words = [words[k] for k in source.tolist()]
                runs = find_runs(numbered(words), shortest, repeats)
                if len(runs.start):
                    words = [words[k] for k in np.flatnonzero(~repeated(runs, len(words))).tolist()]
                all_runs.append(runs)
                texts.append(b" ".join(words))
            ends = np.cumsum([0, *[len(r.start) for r in all_runs]])
            flat = [np.concatenate([r[k] for r in all_runs]) if all_runs else np.zeros(0, np.int64) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], fields=list(run)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {id_type}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def summary(found: DataFrame) -> DataFrame:
    """A row for each document: its number of runs, the one with the greatest exponent, and digests of runs and text."""
    id_type = found.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for runs, text in zip(part.column(1), part.column(2)):
                start, length, period = (np.array(x) for x in (runs.values.flatten() if len(runs) else np.zeros((3, 0), np.int64)))
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
                best = [None] * 4
                if len(start):
                    k = int(np.argmax(length / period))  # quotients of numbers below 2^26 are equal as doubles only if they are equal
                    best = [int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k])]
                rows.append((len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.as_py().encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(x, pa.int64()) for x in columns[:5]], *[pa.array(x, pa.string()) for x in columns[5:]]],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    schema = f"doc_id {id_type}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return found.mapInArrow(batches, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(periodic_runs(table(spark, sf_dir, "documents"), planted=True))
