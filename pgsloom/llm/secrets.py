"""Secret scans: fixed patterns, and Markov models that tell random strings from ordinary identifiers.

Two character chains are trained from labelled samples: one on random strings (keys and tokens), one on ordinary words
and identifiers. A long run of key characters is a secret when the log-likelihood ratio of the two chains, per character,
is above zero and a high quantile of the ordinary samples of that length kept for this, plus a margin. The fixed patterns stay beside it as they are.

Labelled samples: random strings made by rule from a fixed seed; identifiers and long runs of other kinds (rules, numbers, sequences of few letters, addresses) made by rule; and the
words of at most ``sample`` documents (the ones with the least hash of their id), but for those that a pattern marks. A
word is a run of 4 to 19 small letters, the first may be a capital: too short to be a candidate itself, so no key is one.
Scanning covers every whole text. Offsets are code points, ends exclusive.

Defined cases: a null text counts as empty, without spans; the spans of repeated rows are reported for each row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.llm.common import table

#: The patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
#: Fixed value: a run that is ordinary whatever the document holds.
ORDINARY_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]{3,18}(?![A-Za-z0-9+/_=-])")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Fixed value: plain words that ordinary identifiers are made of.
PLAIN = (
    "account action active address after apply array async base batch before block body border buffer build button cache call case change "
    "channel check child class clean click client close code color column command config connect content context copy count create current "
    "data date default delete detail device dialog display document edit element email enable entry error event field file filter first "
    "folder format frame function get group handle handler hash head height image import index info init input insert internal item key label "
    "last layout length level line link list load local location lock log main manager map margin menu message method mode model module name "
    "network node number object offset open option order output owner page panel param parent parse path pattern position post process "
    "product project property query queue read record refresh register remove render report request reset resource response result root row "
    "rule run sample save scale schema scope score screen script search section select send server service session set settings show size "
    "source stack start state status step stop store stream string style submit system table target task template test text time title "
    "total track tree trigger type update upload user value version view visible watch width window worker write zone"
).split()
SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
CODE = {c: i + 1 for i, c in enumerate(SYMBOLS)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed patterns find."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def apart(places: Iterable[tuple[int, int]], spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Those of the places, in order and apart from each other, that touch no span: one sweep over both."""
    order = sorted((s, e) for s, e, _ in spans)
    k, reach = 0, 0  # of the spans that begin before a place's end, how far they reach
    for a, b in places:
        while k < len(order) and order[k][0] < b:
            reach = max(reach, order[k][1])
            k += 1
        if reach <= a:
            yield a, b


def random_strings(n: int, seed: int = 11) -> list[str]:
    """Labelled random: keys and tokens of the usual alphabets and lengths."""
    rnd = random.Random(seed)
    kinds = (string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return ["".join(rnd.choices(rnd.choice(kinds), k=rnd.randint(20, 64))) for _ in range(n)]


def identifiers(n: int, seed: int = 12) -> list[str]:
    """Labelled ordinary: names in the usual spellings, paths, dates, numbered versions."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        words = rnd.choices(PLAIN, k=rnd.randint(2, 7))
        out.append(rnd.choice((
            "_".join(words), "-".join(words), "/".join(words), words[0] + "".join(w.title() for w in words[1:]), "".join(w.title() for w in words),
            "_".join(words).upper(), "_".join(words) + f"_v{rnd.randint(1, 20)}", "-".join(words) + f"-20{rnd.randint(10, 30)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}", "".join(words),
        )))
    return out


def plain_runs(n: int, seed: int = 13) -> list[list[str]]:
    """Labelled ordinary, kind by kind: long runs that are no names. Rules and alphabets, numbers, sequences of few letters, addresses."""
    rnd = random.Random(seed)

    def size() -> int:
        return rnd.randint(20, 64)

    def title() -> str:
        return "".join(rnd.choice(PLAIN) for _ in range(rnd.randint(1, 3))).title()

    kinds = (
        lambda: rnd.choice((string.ascii_lowercase, string.ascii_uppercase, "0123456789" * 6, *[c * size() for c in SYMBOLS]))[: size()],
        lambda: rnd.choice(("".join(rnd.choices("0123456789", k=size())), "-".join(f"{rnd.randrange(10**4):04d}" for _ in range(size() // 4)))),
        lambda: "".join(rnd.choices(rnd.choice(("ACGT", "acgt", "01", "ACGU")), k=size())),
        lambda: rnd.choice((f"en/wiki/{'_'.join(title() for _ in range(rnd.randint(2, 4)))}", f"{rnd.choice(PLAIN)}/{rnd.randrange(1990, 2030)}/{rnd.randrange(1, 13):02d}/{'-'.join(rnd.choices(PLAIN, k=3))}")),
    )
    return [[make() for _ in range(n)] for make in kinds]


def codes(s: str) -> np.ndarray:
    return np.array([CODE.get(c, 0) for c in s], np.int64)


def chain(samples: list[str]) -> np.ndarray:
    """Log probabilities of each symbol after each symbol, smoothed; row 0 is the start."""
    counts = np.full((len(SYMBOLS) + 1, len(SYMBOLS) + 1), 0.05)
    for s in samples:
        c = codes(s)
        if len(c):
            np.add.at(counts, (np.concatenate(([0], c[:-1])), c), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


class Model:
    """A chain of secrets against one of each kind of ordinary string: the kind that fits a run best is compared with it."""

    def __init__(self, secret: list[str], ordinary: list[list[str]], margin: float = 0.1, quantile: float = 0.999):
        rnd, chains, long = random.Random(5), [], []
        for kind in ordinary:
            kept = set(rnd.sample(range(len(kind)), len(kind) // 4))  # for the threshold only
            chains.append(chain([s for i, s in enumerate(kind) if i not in kept]))
            long += [kind[i] for i in kept if len(kind[i]) >= 20]  # what can be a candidate
        self.ratio = chain(secret)[None] - np.array(chains)
        scores = [self.score(s) for s in long]
        self.threshold = max(0.0, float(np.quantile(scores, quantile)) if scores else 0.0) + margin

    def score(self, s: str) -> float:
        """Log-likelihood ratio of random against the likeliest kind of ordinary, per character."""
        c = codes(s)
        return float(self.ratio[:, np.concatenate(([0], c[:-1])), c].mean(axis=1).min()) if len(c) else 0.0

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans of a text, by start, then kind."""
        base = base_spans(text)
        free = apart((m.span() for m in CANDIDATE.finditer(text)), base)
        found = base + [(a, b, "markov") for a, b in free if self.score(text[a:b]) > self.threshold]
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def train(docs: DataFrame, sample: int = 300) -> Model:
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()
    ordinary = set()
    for r in rows:
        text = r["text"] or ""
        ordinary |= {text[a:b] for a, b in apart((m.span() for m in ORDINARY_WORD.finditer(text)), base_spans(text))}
    words = sorted(ordinary)
    rnd = random.Random(6)
    # long ordinary runs, as in texts whose words are not parted
    long = ["".join(rnd.choices(words, k=rnd.randint(2, 5))) for _ in range(4000)] if words else []
    return Model(random_strings(4000), [identifiers(4000) + words + long, *plain_runs(2000)])


def line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for each document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for t in part.column(1):
                spans = model.spans(t.as_py() or "")
                kinds = [k for _, _, k in spans]
                base = line([s for s in spans if s[2] != "markov"])
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), line(spans)))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2)]], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
