"""Byte-level BPE by replaying merges over all words of a block of texts at once, and back.

Texts are cut into blocks of bounded size. The distinct words of a block (matches of the vocabulary's pattern) are laid
out as one row of byte symbols. An inverted index from each token pair, under the rank of what it merges to, to the places
where it stands is built once; merges are then applied in rank order, each at all its places from left to right, and
only the two neighbours of a place are looked at again. A merge that gives rise to a pair of lower rank lets that one go
first, so the order is that of the least rank first in every word, as the tiktoken library has it; like that library, a
word that is itself in the vocabulary is its token. Words do not touch each other, so the result does not depend on blocks.

The pattern is applied by classes of characters: letters, numbers, white space, others. Each word's first place follows
from the class there and before. Which characters are letters or numbers depends on the Unicode version of the library;
what Python's tables do not know is asked of the library once, on the driver.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows and null doc_ids are documents of
their own; an empty table gives an empty result; other columns are not read; a very long text is cut into stretches that end
between two words (a text without any such place is one stretch); an id out of the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pgsloom.llm.common import table
from pgsloom.llm.tokens import BOUNDARY, PATTERN, TOKENIZER, rank_file

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Symbols are below 2^SHIFT; a pair of them is one number.
SHIFT = 21
BLOCK_CHARS = 6_000_000


def read_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of every code point, as the pattern of the tiktoken library takes it."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    for kind, form in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(form, every)]] = kind
    # characters that were added to Unicode later than Python's tables: two of one class are one word, so one token here
    late = [c for c in np.flatnonzero((out == LETTER) | (out == NUMBER)).tolist() if unicodedata.category(chr(c)) == "Cn"]
    ranks = {bytes([b]): b for b in range(256)}
    for lead in "a1":
        for c in late:
            whole = f"{lead}{chr(c)}".encode()
            for end in range(2, len(whole) + 1):
                ranks.setdefault(whole[:end], len(ranks))
    probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in late:
        out[c] = LETTER if len(probe.encode_ordinary(f"a{chr(c)}")) == 1 else NUMBER if len(probe.encode_ordinary(f"1{chr(c)}")) == 1 else OTHER
    return out


def word_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin among code points of several texts that begin at the places ``first``."""
    n = len(points)
    kind = classes[points]
    new = np.zeros(n + 1, bool)
    new[first] = True
    new[n] = True
    same = np.zeros(n, bool)  # the character before is of the same class and text
    same[1:] = (kind[1:] == kind[:-1]) & ~new[1:n]
    start = ~same
    space = kind == SPACE
    # the last white space before something else: a blank goes with it, anything else is a word of its own
    last = space & ~new[1:]
    last[:-1] &= ~space[1:]
    start |= last
    after = np.zeros(n, bool)
    after[1:] = (last & (points == 32))[:-1]
    start &= ~after
    # 's 't 'm 'd 're 've 'll where the apostrophe begins a word
    quote = np.flatnonzero((points == 39) & start)
    padded = np.append(points, [0, 0]).astype(np.int64)
    ends = np.append(new, True)
    one, two = padded[quote + 1], padded[quote + 2]
    here, there = ~ends[quote + 1], ~ends[quote + 1] & ~ends[np.minimum(quote + 2, n)]
    short = here & np.isin(one, [ord(c) for c in "stmd"])
    long = there & np.isin(one << SHIFT | two, [ord(a) << SHIFT | ord(b) for a, b in ("re", "ve", "ll")])
    start[(quote + 1)[short | long]] = False
    for size, chosen in ((2, short), (3, long & ~short)):
        rest = (quote + size)[chosen]
        start[rest[rest < n]] = True
    start[first[first < n]] = True
    return np.flatnonzero(start)


class Words(NamedTuple):
    """Ids of words, one after the other; word k has ids[at[k]:at[k + 1]]."""

    ids: np.ndarray
    at: np.ndarray


class Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Codec:
    """A vocabulary of ranks with the classes of its pattern; ``encode`` takes many texts at once.

    Words of earlier blocks are known with their ids, up to ``most_words`` of them or ``most_bytes`` in all; beyond that
    all are forgotten and worked out again. This changes the work, not the ids.
    """

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray, most_words: int = 600_000, most_bytes: int = 32 << 20):
        self.ranks, self.classes, self.most_words, self.most_bytes = ranks, classes, most_words, most_bytes
        if max(ranks.values(), default=0) >= 1 << SHIFT:
            raise ValueError(f"ranks have to be below {1 << SHIFT}")
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.symbol = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        merges = {ranks[t[:k]] << SHIFT | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = np.array([*sorted(merges), np.iinfo(np.int64).max], np.int64)
        self.ranks_of = np.array([*(merges[p] for p in self.pairs[:-1].tolist()), -1], np.int64)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.size = Numbers(), 0
        self.known = Words(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def rank(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """What pairs of symbols merge to; -1: nothing, also where a symbol is -1."""
        keys = np.asarray(left) << SHIFT | np.asarray(right)  # below zero if one of them is
        found = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[found] == keys, self.ranks_of[found], -1)

    def replay(self, words: list[bytes]) -> Words:
        """Apply the merges to distinct words, none of them empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        edge = np.concatenate(([0], np.cumsum(lengths)))
        # a symbol beyond either end that merges with nothing stands for a missing neighbour
        symbols = np.append(self.symbol[np.frombuffer(b"".join(words), np.uint8)], -1)
        n = len(symbols) - 1
        if (symbols[:n] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        right, left = np.arange(1, n + 2), np.arange(-1, n)
        right[edge[1:] - 1] = n
        left[edge[:-1]] = n
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            """Put places into the index under the ranks of their pairs."""
            some = np.flatnonzero(ranks >= 0)
            some = some[np.argsort(ranks[some], kind="stable")]
            places, ranks = places[some], ranks[some]
            cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
            for r, a, b in zip(ranks[cuts[:-1]].tolist() if len(ranks) else [], cuts, cuts[1:]):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(places[a:b])

        def apply(p: np.ndarray, r: int) -> None:
            """Merge the pairs at these places, no two of which overlap, and look at their neighbours again."""
            q = right[p]
            symbols[p], symbols[q] = r, -1
            after = right[q]
            right[p] = after
            left[after] = p  # the place beyond the end takes what does not matter
            before = left[p]
            enter(np.concatenate((before, p)), np.concatenate((self.rank(symbols[before], symbols[p]), self.rank(symbols[p], symbols[after]))))

        enter(np.arange(n), self.rank(symbols[:n], symbols[right[:n]]))
        while heap:
            r = heapq.heappop(heap)
            p = np.concatenate(index.pop(r))
            p = np.sort(p[self.rank(symbols[p], symbols[right[p]]) == r])  # not where another merge has taken one of the two
            p = p[np.concatenate(([True], p[1:] != p[:-1]))[: len(p)]]
            if not len(p):
                continue
            # of places that overlap, one after the other, every second is taken, from the left
            every, chain = p, np.arange(len(p))
            chained = np.concatenate(([False], right[p[:-1]] == p[1:]))
            p = p[(chain - np.maximum.accumulate(np.where(chained, 0, chain))) % 2 == 0]
            # what merges here make with their neighbours as they are and as they are to be
            made = np.concatenate([np.atleast_1d(self.rank(*pair)) for pair in ((symbols[left[p]], r), (r, symbols[right[right[p]]]), (r, r))])
            if ((made >= 0) & (made < r)).any():  # a lower rank goes first: each word waits after its first merge
                word = np.searchsorted(edge, every, side="right")
                begins = np.concatenate(([True], word[1:] != word[:-1]))
                if not begins.all():
                    index[r].append(every[~begins])
                    heapq.heappush(heap, r)
                p = every[begins]
            apply(p, r)
        alive = symbols[:n] >= 0
        return Words(symbols[:n][alive].astype(np.int32), np.concatenate(([0], np.cumsum(alive)))[edge])

    def learn(self, words: list[bytes]) -> None:
        """Work out the ids of words that are not known yet."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        single = whole >= 0
        rest = [w for w, known in zip(words, single.tolist()) if not known]
        merged = self.replay(rest) if rest else Words(np.zeros(0, np.int32), np.zeros(1, np.int64))
        count = np.ones(len(words), np.int64)
        count[~single] = np.diff(merged.at)
        at = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(at[-1], np.int32)
        ids[at[:-1][single]] = whole[single]
        ids[np.repeat(~single, count)] = merged.ids
        self.known = Words(np.concatenate((self.known.ids, ids)), np.concatenate((self.known.at, at[1:] + self.known.at[-1])))
        self.size += sum(map(len, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts together should be of bounded size."""
        sizes = [len(t) for t in texts]
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        first = np.concatenate(([0], np.cumsum(sizes)))
        starts = word_starts(points, first[:-1][np.array(sizes) > 0], self.classes)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        bounds = np.concatenate(([0], np.cumsum(width)))[np.append(starts, len(points))].tolist()
        data = joined.encode()
        words = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(self.numbers) > self.most_words or self.size > self.most_bytes:
            self.forget()
        before = len(self.numbers)
        of = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > before:
            self.learn(list(islice(self.numbers, before, None)))
        at = self.known.at
        n = at[of + 1] - at[of]
        shift = np.cumsum(n) - n
        flat = self.known.ids[np.arange(int(n.sum())) + np.repeat(at[of] - shift, n)]
        edges = np.append(shift, len(flat))[np.searchsorted(starts, first)]
        return [flat[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def stretches(self, text: str, most: int = BLOCK_CHARS) -> Iterator[str]:
        """A text in pieces of some ``most`` characters that end between two words."""
        at = 0
        while len(text) - at > most:
            m = BOUNDARY.search(text, at + most)
            while m and unicodedata.category(text[m.start() - 1]) == "Cn":  # a letter to one library, something else to another
                m = BOUNDARY.search(text, m.start() + 1)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class Shared:
    """A codec of a vocabulary file that a worker process makes once from the bytes of a broadcast."""

    def __init__(self, spark: SparkSession, tokenizer: str = TOKENIZER):
        self.sent = spark.sparkContext.broadcast({"file": rank_file(tokenizer), "classes": character_classes()})

    def codec(self) -> Codec:
        box = self.sent.value
        if "codec" not in box:
            box["codec"] = Codec(read_ranks(box["file"]), box["classes"])
        return box["codec"]


def encode(docs: DataFrame, shared: Shared | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) for each document."""
    shared, id_type = shared or Shared(docs.sparkSession), docs.schema["doc_id"].dataType.simpleString()

    def rows(keys: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), lists], names=["doc_id", "ids"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        keys, texts, size = [], [], 0
        for part in parts:
            for k in range(part.num_rows):
                key, text = part.column(0).slice(k, 1), part.column(1)[k].as_py() or ""
                if texts and size + len(text) > block_chars:
                    yield rows(keys, codec.encode(texts))
                    keys, texts, size = [], [], 0
                if len(text) > block_chars:
                    yield rows([key], [np.concatenate([codec.encode([x])[0] for x in codec.stretches(text, block_chars)])])
                else:
                    keys.append(key)
                    texts.append(text)
                    size += len(text)
        if texts:
            yield rows(keys, codec.encode(texts))

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, shared: Shared | None = None) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids); null ids decode to no bytes."""
    shared, id_type = shared or Shared(encoded.sparkSession), encoded.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for part in parts:
            for some in (part.slice(k, 256) for k in range(0, part.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([codec.decode(ids_of(x)) for x in some.column(1)], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(batches, f"doc_id {id_type}, decoded binary")


def ids_of(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy() if value.is_valid else np.zeros(0, np.int32)


def round_trip(encoded: DataFrame, shared: Shared | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids): digests of the ids and of the bytes they decode to."""
    shared, id_type = shared or Shared(encoded.sparkSession), encoded.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for part in parts:
            found = [ids_of(x) for x in part.column(1)]
            sizes = pa.array([len(x) for x in found], pa.int64())
            ids = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string())
            decoded = pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, ids, decoded], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(batches, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark)
    return round_trip(encode(table(spark, sf_dir, "documents"), shared), shared)
