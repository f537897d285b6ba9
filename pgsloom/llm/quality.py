"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are the documents labelled good; the unlabelled text is a draw from all documents, whatever their label
says or does not say. The share of good documents among the unlabelled is estimated first: a classifier of positives against unlabelled text, fitted on one half of the
samples, ranks the other positives and every unlabelled document of the table, and the least ratio of unlabelled to positive
mass above a rank bounds the share. A small network is then fitted to the unbiased risk
``p R+(pos) + (R-(unl) - p R-(pos))`` whose bracket may not fall below zero.

Features come from the whole text: shares of byte classes, words, lines, repetition. They never see doc_id, lang,
source or labels. The fit uses at most ``sample`` documents of each kind (the ones with the least hash of their id);
the class prior is counted over all, and scoring covers every document.

Defined cases: a null text counts as empty and is scored like one; a null doc_id counts as the text ''; a document
labelled twice is a positive only if no label says otherwise; rows that repeat are scored alike, and count as often as they
stand there; without positives every score is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgsloom.llm.common import cut, table, trim

#: Classes of bytes, one feature each.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:", "!", "?", "#$%&*@^~", "|", "<>{}[]()", "=+/\\_-", "\"'`")
CHUNK = 100


def _class_table() -> np.ndarray:
    out = np.zeros((256, len(CLASSES) + 1))
    out[128:, -1] = 1
    for i, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars], i] = 1
    return out


CLASS_TABLE = _class_table()


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    shares = np.bincount(data, minlength=256) @ CLASS_TABLE / max(1, len(data))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    if not n:
        return np.concatenate((shares, np.zeros(10)))
    chunks = [words[i : i + CHUNK] for i in range(0, n, CHUNK)]
    new = sum(len(set(c)) for c in chunks) / n
    pairs = sum(len(set(zip(c, c[1:]))) for c in chunks) / max(1, n - len(chunks))
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    top = max(Counter(words).values()) / n
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    last = data[:-1][~gap[:-1] & gap[1:]]
    ends = np.bincount(last, minlength=256) @ CLASS_TABLE[:, [5, 6, 8]] / n
    return np.concatenate((shares, [np.log1p(n), len(data) / n, new, pairs, again, top, len(set(lines)) / len(lines)], ends))


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), len(CLASSES) + 11)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Network:
    """One hidden layer over standardised features; ``score`` is between 0 and 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(np.tanh(z @ w1 + b1) @ w2 + b2)


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 40, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam; ``prior`` None: plain logistic loss of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate((pos, unl))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    pos, unl = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    weights = [rng.normal(0, both.shape[1] ** -0.5, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t, steps = [0 * w for w in weights], [0 * w for w in weights], 0, max(1, max(len(pos), len(unl)) // 512)
    for epoch in range(epochs):
        p_rows, u_rows = (np.array_split(rng.permutation(len(x)), steps) for x in (pos, unl))
        for i, j in zip(p_rows, u_rows):
            if not len(i) or not len(j):
                continue
            x = np.concatenate((pos[i], unl[j]))
            h = np.tanh(x @ weights[0] + weights[1])
            f = h @ weights[2] + weights[3]
            fp, fu = f[: len(i)], f[len(i) :]
            if prior is None:
                g = np.concatenate((-_sigmoid(-fp) / len(i), _sigmoid(fu) / len(j)))
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                if negative >= 0:
                    g = np.concatenate((-prior * (_sigmoid(-fp) + _sigmoid(fp)) / len(i), _sigmoid(fu) / len(j)))
                else:  # the negative risk may not be below zero: step back from it
                    g = np.concatenate((prior * _sigmoid(fp) / len(i), -_sigmoid(fu) / len(j)))
            gh = np.outer(g, weights[2]) * (1 - h * h)
            grads = [x.T @ gh + 1e-4 * weights[0], gh.sum(axis=0), h.T @ g + 1e-4 * weights[2], g.sum(keepdims=True)]
            t += 1
            for k, grad in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                weights[k] = weights[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, weights)


def cuts(ranker: Network, pos: np.ndarray, least: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Scores at which to compare, and the share of positives above each; the ranker has not seen these positives."""
    p = ranker.score(pos)
    at = np.quantile(p, np.linspace(0, 1 - least, 40))
    return at, np.array([(p >= c).mean() for c in at])


def bound(above: np.ndarray, positives: np.ndarray) -> float:
    """Upper bound of the share of positives among rows of which these shares are above the cuts."""
    return float(np.clip((above / positives).min(), 0.02, 0.98))


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Upper bound of the share of positives among unlabelled rows, from a ranking learned on the other half of them."""
    ranker = _train(pos[::2], unl[::2], None)
    at, positives = cuts(ranker, pos[1::2])
    u = ranker.score(unl[1::2])
    return bound(np.array([(u >= c).mean() for c in at]), positives)


def untrained() -> Network:
    k = len(CLASSES) + 11
    return Network(np.zeros(k), np.ones(k), [np.zeros((k, 1)), np.zeros(1), np.zeros(1), np.zeros(1)])


def fit(pos: np.ndarray, unl: np.ndarray, prior: float) -> Network:
    net = _train(pos, unl, prior)
    net.prior = prior
    return net


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every whole text, written once."""

    @F.pandas_udf("array<double>")
    def of_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series(list(matrix(text)))
        trim()

    return cut(docs.select("doc_id", of_text("text").alias("x")))


def learn(found: DataFrame, labels: DataFrame, sample: int = 8_000) -> Network:
    """Fit on at most ``sample`` positives and as many unlabelled rows of described documents, none of them held out."""
    of = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    rows = found.filter("doc_id is not null").filter(remainder(F.col("doc_id")) != 0)
    unlabelled = rows  # a label decides nothing here, so no number of labels changes what the text is drawn from
    some = [F.xxhash64(F.lit(3), "doc_id"), "doc_id"]

    def least(df: DataFrame) -> list:
        return df.dropDuplicates(["doc_id"]).orderBy(*some).limit(sample).collect()

    pos = least(rows.join(of.filter("q = 1").select("doc_id"), "doc_id", "left_semi"))
    unl = least(unlabelled)
    if len(pos) < 4 or len(unl) < 4:
        return untrained()
    xp, xu = (np.array([r["x"] for r in x]) for x in (pos, unl))
    ranker = _train(xp[::2], xu[::2], None)
    at, positives = cuts(ranker, xp[1::2])
    # at most half of ``sample`` ids: all other unlabelled documents are counted
    seen = docs_of(found, [r["doc_id"] for r in unl[::2]])
    rest = unlabelled.join(F.broadcast(seen), "doc_id", "left_anti").select(scored(ranker, F.col("x"), described=True).alias("score"))
    counts = rest.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("score") >= float(c), 1)).alias(f"c{i}") for i, c in enumerate(at)]).first()
    above = np.array(counts[1:]) / max(1, counts["n"])
    return fit(xp, xu, bound(above, positives) if counts["n"] else 0.5)


def docs_of(found: DataFrame, ids: list) -> DataFrame:
    return found.sparkSession.createDataFrame([(i,) for i in ids], found.select("doc_id").schema)


def scored(net: Network, column: Column, described: bool = False) -> Column:
    """The score of a column of texts, or of features."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in parts:
            yield pd.Series(net.score(np.array(values.tolist()).reshape(len(values), -1) if described else matrix(values)))
        trim()

    return score(column)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    found = described(docs)
    net = learn(found, labels, sample)
    out = found.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), scored(net, F.col("x"), described=True).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
