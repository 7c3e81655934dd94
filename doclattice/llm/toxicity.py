"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence has a logistic score from its distinct words and word beginnings; a document's score is the noisy-or of its
sentences, 1 - prod(1 - p). Only document labels are known: the weights are trained on the bag
likelihood, by Adam in numpy on the driver, from at most TRAIN_DOCS labelled documents (those with
the smallest hash of their id; of a longer text a piece of TRAIN_CHARS characters) and the at most FEATURES features that depend most clearly on the label. Sentences that carry a document's score
can then be located.

Nulls: a null text has no sentences, as an empty one, and scores 0. Labels that are null or belong
to no document are not used; a document with several labels counts with the largest. Repeated rows
are each answered, empty tables give no rows; without labels every weight is 0. Inputs of the score
are words only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.common import table, texts

#: Bounds of what the driver gathers to fit the model: labelled rows, and characters of each.
TRAIN_DOCS = 6000
TRAIN_CHARS = 20_000
FEATURES = 3000
#: Least log-likelihood ratio of a feature and the label over documents.
CLEAR = 12.0
PREFIX = 4
EPOCHS = 80
THRESHOLD = 0.3

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def bags(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and features of each sentence that has a word: its distinct lower-cased words, and
    the beginnings of the longer ones with a mark."""
    for m in SENTENCE.finditer(text):
        if words := set(WORD.findall(m[0].lower())):
            words |= {w[:PREFIX] + "~" for w in words if len(w) > PREFIX}
            yield m.start(), m.end(), words


def _clear(sentences: list[list[set[str]]], y: np.ndarray) -> dict[str, float]:
    """Features that depend on the label, with their log odds."""
    toxic, clean = Counter(), Counter()
    for doc, label in zip(sentences, y, strict=True):
        (toxic if label else clean).update(set().union(*doc))
    p, n, out = int(y.sum()), int((~y).sum()), []
    for w in toxic.keys() | clean.keys():
        a, b = toxic[w], clean[w]
        if a + b < 3:
            continue
        rate = (a + b) / (p + n)
        cells = ((a, p * rate), (p - a, p * (1 - rate)), (b, n * rate), (n - b, n * (1 - rate)))
        g = 2 * sum(k * math.log(k / e) for k, e in cells if k)
        if g >= CLEAR:
            out.append((g, w, math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (n + 1))))
    return {w: odds for _, w, odds in sorted(out, key=lambda x: (-x[0], x[1]))[:FEATURES]}


@dataclass
class Model:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known = self.weights.keys()
        self.plain = math.log1p(math.exp(self.bias))  # -log(1 - p) of a sentence without known words

    def sentence(self, words: set[str]) -> float:
        """-log(1 - p)."""
        hits = self.known & words
        if not hits:
            return self.plain
        z = self.bias + sum(map(self.weights.__getitem__, sorted(hits)))
        return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))

    def score(self, text: str) -> float:
        return -math.expm1(-sum(self.sentence(w) for _, _, w in bags(text)))


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, l1: float = 1e-3, rate: float = 0.05) -> Model:
    """rows: text and label. A full-batch Adam with shrinkage towards 0."""
    if not rows or not any(y for _, y in rows):
        return Model()
    sentences = [[w for _, _, w in bags(text)] for text, _ in rows]
    y = np.array([y for _, y in rows], bool)
    odds = _clear(sentences, y)
    vocabulary = {w: i for i, w in enumerate(odds)}
    doc_of, flat, bag_of, s = [], [], [], 0
    for d, doc in enumerate(sentences):
        for words in doc:
            known = [vocabulary[w] for w in words if w in vocabulary]
            flat.extend(known)
            bag_of.extend([s] * len(known))
            doc_of.append(d)
            s += 1
    x, bag, doc = np.array(flat, np.int64), np.array(bag_of, np.int64), np.array(doc_of, np.int64)
    k = len(vocabulary)
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    theta[:k] = np.clip(list(odds.values()), -1, 6)
    theta[k] = math.log(max(y.mean(), 1e-3) / max(s / len(rows), 1)) - 2
    for t in range(1, epochs + 1):
        z = np.clip(theta[k] + np.bincount(bag, theta[x], s), -30, 30)
        p = 1 / (1 + np.exp(-z))
        not_toxic = np.bincount(doc, np.logaddexp(0, z), len(rows))  # -log(1 - P)
        whole = np.maximum(-np.expm1(-not_toxic), 1e-9)
        pull = np.where(y, -(1 - whole) / whole, 1.0) / len(rows)
        g = p * pull[doc]
        grad = np.append(np.bincount(x, g[bag], k), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        theta[:k] = np.sign(theta[:k]) * np.maximum(np.abs(theta[:k]) - rate * l1, 0)
    kept = {w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 0.05}
    return Model(float(theta[k]), kept)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that aren't held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(TRAIN_DOCS)
    start = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1)))
    piece = F.substring(F.col("text"), start.cast("int"), F.lit(TRAIN_CHARS)).alias("text")
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", piece, "toxic")
    got = sorted((r.doc_id, r.text, int(r.toxic)) for r in rows.toLocalIterator())
    return fit([(text, int(y > 0)) for _, text, y in got])


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """For each document: held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return texts(docs, held_out(F.col("doc_id").cast("long")).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Sentences with a score of at least `least`: doc_id, start, end (code points), score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(i, a, b, p) for a, b, words in bags(text) if (p := -math.expm1(-model.sentence(words))) >= least]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "start", "end", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, start long, end long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, trained(docs, table(spark, sf_dir, "labels")))
