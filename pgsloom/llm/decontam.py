"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space becomes single spaces. An item of m characters may differ by
k = floor(rate * m) edits. Cut into k + 1 pieces, one piece at least must be in the text as it is; an Aho-Corasick
automaton finds all exact piece hits in one pass over the whole text, and the text around a hit is verified with the
bit-parallel algorithm of Myers.

Items of fewer than ``least_chars`` characters are too short for edits to tell a copy from chance: they must be in the text
as they are, between characters that are not letters or digits.

Items are a stated query set: they are held in blocks of at most ``block_chars`` characters, each block one pass over
the documents, so what is sent to the tasks has a fixed bound whatever the number of items. A worker process builds a
block's automaton once and keeps it for its later tasks.

Defined cases: a null text counts as empty; a null or empty item matches nothing; items that share an item_id or a text
are each reported; of equally good matches of an item the first in the text is; item_id may be of any type, null
too; a document whose rows repeat is reported for each row; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pgsloom.llm.common import in_slices, table, trim


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of the text, end of the first such part)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full  # a match may begin anywhere in the text
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def pieces(item: str, k: int) -> list[tuple[object, str]]:
    """(offset, piece): the item cut into k + 1 nearly equal pieces."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def alone(text: str, start: int, end: int) -> bool:
    """Whether a stretch of a text is not part of longer words."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    after = end < len(text) and text[end].isalnum() and text[end - 1].isalnum()
    return not before and not after


class Matcher:
    """A block of items, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float, least_chars: int):
        self.items = [(i, t, int(rate * len(t)) if len(t) >= least_chars else 0, len(t) < least_chars) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k, _) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                found.setdefault(piece, []).append((n, offset))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> Iterator[tuple[object, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item, in characters of the normal text.

        ``start`` is the end less the item's length: exact where nothing is inserted or left out.
        """
        text = normal(text)
        if not self.items or not text:
            return
        spans: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                _, item, k, short = self.items[n]
                begin = end + 1 - size - offset
                if short and not alone(text, begin, end + 1):
                    continue
                low, high = max(0, begin - k), min(len(text), begin + len(item) + k)
                stretch = spans.setdefault(n, [])
                if stretch and low <= stretch[-1][1] and low >= stretch[-1][0]:
                    stretch[-1][1] = max(high, stretch[-1][1])
                else:
                    stretch.append([low, high])
        for n, stretch in spans.items():
            item_id, item, k, _ = self.items[n]
            best = None
            for low, high in stretch:
                at = text.find(item, low, high)
                distance, end = (0, at + len(item) - low) if at >= 0 else myers(item, text[low:high])
                if distance <= k and (best is None or distance < best[1]):
                    best = (item_id, distance, max(0, low + end - len(item)), low + end)
                    if not distance:
                        break
            if best:
                yield best


def blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in lists of about ``block_chars`` characters."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    n = -(-total // block_chars)
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _finder(shared, rate: float, least_chars: int):
    """The search of a broadcast block; the automaton stays with the broadcast value in this process."""
    box = shared.value
    if "find" not in box:
        box["find"] = Matcher(box["items"], rate, least_chars).matches
    return box["find"]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.05, least_chars: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance, start, end): each item that a document holds within the error budget."""
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, distance int, start int, end int"
    out = None
    for block in blocks(items, block_chars):
        part = _scan(docs.select("doc_id", "text"), block, rate, least_chars, schema, to_arrow_type(item_type))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _scan(docs: DataFrame, block: list[tuple[object, str]], rate: float, least_chars: int, schema: str, item_type: pa.DataType) -> DataFrame:
    names = ["item_id", "distance", "start", "end"]
    types = [item_type, pa.int32(), pa.int32(), pa.int32()]
    shared = docs.sparkSession.sparkContext.broadcast({"items": block})

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(shared, rate, least_chars)
        for part in in_slices(parts):
            rows = [(i, *m) for i, t in enumerate(part.column(1)) for m in find(t.as_py())]
            columns = list(zip(*rows)) if rows else [()] * 5
            ids = part.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names=["doc_id", *names])

    return docs.mapInArrow(scan, schema)


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.05, least_chars: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they are."""
    for block in blocks(items, block_chars):
        docs = docs.filter(_free(docs.sparkSession.sparkContext.broadcast({"items": block}), rate, least_chars))
    return docs


def _free(shared, rate: float, least_chars: int) -> Column:
    @F.pandas_udf("boolean")
    def free(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder(shared, rate, least_chars)
        for part in texts:
            yield pd.Series([next(find(t), None) is None for t in part], dtype=bool)
        trim()

    return free("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
