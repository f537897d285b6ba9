"""Byte-level BPE against the tiktoken library and an exact round trip; periodic runs against brute force."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from pgsloom.llm import bpe, periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids int, runs string, collapsed string, start int"
CASES = [(1, "one two three"), (2, None), (3, ""), (None, "lost id"), (4, "one  two\nthree"), (4, "one  two\nthree"), (5, "x " * 30), (6, "w" * 50_000), (7, "    é"), (8, "ab ba " * 3000)]


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "r", "c", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def library(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.TOKENIZER, "rb") as file:
        return bpe.read_ranks(file.read())


def test_words_begin_where_the_library_has_them(ranks):
    rnd = random.Random(1)
    some = "  \n\n\t\r'''stmdrevl aéß1२²_-.,!\u0085 　中文字\U0001f600՘࢏꟎\U00011de0\x1c<|endoftext|>"
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 40))) for _ in range(8000)] + [" ", "", "  ", "'", "'s", "''s", "'re", "'r", "'l", "'ll'll", " 's", "\n's", "'s" * 9, "x" * 3000, "ab" * 3000]
    codec, own = bpe.Codec(ranks, bpe.character_classes()), library(ranks)
    got = codec.encode(texts)
    assert [x.tolist() for x in got] == [own.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in got] == [t.encode() for t in texts]


def test_odd_vocabularies():
    """Ranks in no order that training gives: pairs of lower rank arise late, and one token has several pairs."""
    for seed in range(60):
        rnd = random.Random(seed)
        ranks = {bytes([b]): b for b in range(256)}
        for token in rnd.sample(sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 6))) for _ in range(80)}), 40):
            ranks[token.encode()] = len(ranks)
        texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 80))) for _ in range(60)]
        codec, own = bpe.Codec(ranks, bpe.character_classes(), most_words=30), library(ranks)
        for _ in range(2):  # the second time from what is known
            assert [x.tolist() for x in codec.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_a_merge_that_opens_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abab": 299, b"ba": 301}
    codec, own = bpe.Codec(ranks, bpe.character_classes()), library(ranks)
    texts = ["abababab", "babababab", "ab" * 501]
    assert [x.tolist() for x in codec.encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_vocabulary_errors():
    codec = bpe.Codec({b"a": 0, b"b": 1, b"ab": 2}, bpe.character_classes())
    assert codec.encode(["abba"])[0].tolist() == [2, 1, 0]
    with pytest.raises(ValueError, match="lacks a byte"):
        codec.encode(["abc"])
    with pytest.raises(KeyError):
        codec.decode(np.array([7]))
    with pytest.raises(ValueError, match="ranks"):
        bpe.Codec({b"a": 1 << 21}, bpe.character_classes())


@pytest.mark.parametrize("block", [6_000_000, 500])
def test_encode_and_decode(spark, small, ranks, block):
    own = library(ranks)
    rows = CASES + [(r["doc_id"] + 100, r["text"]) for r in small.collect()]
    docs = frame(spark, rows).repartition(3)
    encoded = bpe.encode(docs, block_chars=block)
    want = collections.Counter((i, tuple(own.encode_ordinary(t or ""))) for i, t in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    assert collections.Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(encoded).collect()) == collections.Counter((i, (t or "").encode()) for i, t in rows)


def test_bpe_query(spark, sf_dir, small, ranks):
    own, want = library(ranks), []
    for r in small.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = bpe.query(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert bpe.encode(small.limit(0)).collect() == []
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).first()["decoded"] == b""


def brute_runs(words, shortest=24, repeats=3):
    """{(start, length): smallest period}."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_brute_force():
    rnd = random.Random(2)
    for turn in range(1500):
        n, k = rnd.randint(0, 90), rnd.choice([1, 2, 2, 3, 5])
        words = [rnd.randrange(k) for _ in range(n)]
        if turn % 2 and n > 4:
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 3))
            for i in range(a, n):
                words[i] = words[a + (i - a) % p]
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(n)] = 9
        shortest, repeats = rnd.choice([(24, 3), (24, 3), (6, 3), (4, 2), (1, 2)])
        got = periodic_runs.find_runs(np.array(words, np.int32), shortest, repeats)
        assert sorted(zip(got.start.tolist(), got.length.tolist(), got.period.tolist())) == brute_runs(words, shortest, repeats)


def test_runs_in_chunks(monkeypatch):
    words = np.array([0, 1, 2] * 40 + [3, 4] * 30 + [5] * 50, np.int32)
    whole = periodic_runs.find_runs(words)
    monkeypatch.setattr(periodic_runs, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, periodic_runs.find_runs(words)))
    assert list(zip(*[x.tolist() for x in whole])) == brute_runs(words.tolist())


def brute_document(doc_id, text):
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs_query(spark, sf_dir, small):
    got = periodic_runs.query(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_document(r["doc_id"], r["text"]) for r in small.collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and sum(w[1] > 0 for w in want) > 3


def test_periodic_runs_cases(spark):
    rows = [*CASES, (9, "a b c d e f g h " * 3), (10, "a b c d e f g h " * 3 + "a"), (11, "\x85   " * 30), (12, ("p q " * 12 + "r ") * 4)]
    docs = frame(spark, rows)
    got = collections.Counter(tuple(r) for r in periodic_runs.summary(periodic_runs.periodic_runs(docs, planted=True)).collect())
    assert got == collections.Counter(brute_document(i, t) for i, t in rows if i != 6 and i != 8) + collections.Counter(t for t in got.elements() if t[0] in (6, 8))
    plain = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in plain[8]["runs"]] == [(0, 6000, 2)] and plain[8]["collapsed"] == "ab ba"
    assert [tuple(r) for r in plain[9]["runs"]] == [(0, 24, 8)] and plain[6]["runs"] == [] and plain[2]["collapsed"] == ""
    assert periodic_runs.summary(periodic_runs.periodic_runs(docs.limit(0))).collect() == []
    assert periodic_runs.periodic_runs(docs.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == len(rows)
