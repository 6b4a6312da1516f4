"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Model: P(grade <= k) = sigmoid(theta_k - w.x) for k = 0 .. K-2 with one weight vector w for all thresholds and
theta_0 < theta_1 < ...; a document's severity is its expected grade.  x holds 1 for every lower-cased word of the text
and for every 4- and 5-letter beginning of one, so inflected and compound forms of a word share its evidence.

``labels`` has one toxic bit.  Grade 0 is a clean document; toxic training documents are graded by how many of their
words are markers (features that the sample's clean documents practically never have): 1 below the median, 2 from it on.

The model is fitted on a bounded sample of labelled rows, the MAX_TOXIC toxic and MAX_CLEAN clean ids of smallest hash;
every document is scored over its whole text.  The weights are at most MAX_FEATURES entries, so they are broadcast.

Defined cases: a null or empty text has no features and gets the model's prior; repeated rows are scored each; with no
labelled row of one of the two kinds every document gets grade 0 and severity 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table, text_of

#: Labelled rows that the fit uses at most.
MAX_TOXIC, MAX_CLEAN = 2_500, 5_000
MAX_FEATURES = 20_000
#: A feature counts from this many documents of the sample on.
MIN_DOCS = 4
#: Chi-squared that a feature needs: chance alone lifts about one in ten million so far.
MIN_CHI2 = 30.0
GRADES = 3
#: A document is toxic from this probability of a grade above 0 on.
DECIDE = 0.1
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(words: set[str]) -> list[str]:
    """The words, then marked beginnings of 4 and 5 letters."""
    return [*words, *{f"4{w[:4]}" for w in words if len(w) >= 4}, *{f"5{w[:5]}" for w in words if len(w) >= 5}]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class CumulativeLink:
    """Ordinal regression with shared weights, fitted by gradient steps (Adam) with an L2 penalty."""

    grades: int = GRADES
    l2: float = 3e-5
    rounds: int = 300
    rate: float = 0.08
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: dict[str, float] = field(default_factory=dict)

    def fit(self, docs: list[list[str]], y: np.ndarray) -> CumulativeLink:
        df = Counter(f for d in docs for f in d)
        pos = Counter(f for d, g in zip(docs, y) if g for f in d)
        n, n_pos = len(docs), max(1, int((y > 0).sum()))
        n_neg, tell = max(1, n - n_pos), {}
        for f, c in df.items():
            if c >= MIN_DOCS:  # chi-squared of the feature against grade 0
                a, b = pos[f], c - pos[f]
                cells = float(a + b) * (n - a - b) * n_pos * n_neg
                tell[f] = n * (a * (n_neg - b) - b * (n_pos - a)) ** 2 / cells if cells else 0.0
        names = sorted((f for f in tell if tell[f] >= MIN_CHI2), key=lambda f: (-tell[f], f))[:MAX_FEATURES]
        at = {f: i for i, f in enumerate(names)}
        cols = [np.array([at[f] for f in d if f in at], np.int64) for d in docs]
        row, col = np.repeat(np.arange(n), [len(c) for c in cols]), np.concatenate([np.empty(0, np.int64), *cols])
        share = np.array([(y <= k).mean() for k in range(self.grades - 1)]).clip(1e-3, 1 - 1e-3)
        theta, w = np.maximum.accumulate(np.log(share / (1 - share))), np.zeros(len(names))
        # theta_k = theta_0 + sum of exp(gap)
        p = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-3)), w])
        k1, m1, m2 = self.grades - 1, np.zeros(len(p)), np.zeros(len(p))
        for t in range(1, self.rounds + 1):
            theta = p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:k1]))])
            s = np.bincount(row, p[k1:][col], n)
            cdf = np.hstack([np.zeros((n, 1)), _sigmoid(theta[None] - s[:, None]), np.ones((n, 1))])
            slope = cdf * (1 - cdf)
            like = np.maximum(cdf[np.arange(n), y + 1] - cdf[np.arange(n), y], 1e-9)
            d_score = (slope[np.arange(n), y + 1] - slope[np.arange(n), y]) / like / n  # of -log like, by the score
            d_theta = np.zeros(k1)
            for k in range(k1):
                d_theta[k] = -((slope[y == k, k + 1] / like[y == k]).sum() - (slope[y == k + 1, k + 1] / like[y == k + 1]).sum()) / n
            g = np.concatenate([[d_theta.sum()], [d_theta[k:].sum() * np.exp(p[k]) for k in range(1, k1)], np.bincount(col, d_score[row], len(w)) + self.l2 * p[k1:]])
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            step = self.rate / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
            p = p - step * m1 / (1 - 0.9**t)
        self.theta = p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:k1]))])
        self.weights = {f: float(p[k1 + i]) for f, i in at.items() if abs(p[k1 + i]) > 1e-6}
        return self

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def grades_of(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) of each score."""
        n = len(scores)
        cdf = np.hstack([np.zeros((n, 1)), _sigmoid(self.theta[None] - scores[:, None]), np.ones((n, 1))])
        return np.diff(cdf, axis=1)


def grade(docs: list[list[str]], toxic: np.ndarray) -> np.ndarray:
    """Severity grades of the training documents."""
    pos = Counter(f for d, t in zip(docs, toxic) if t for f in d)
    neg = Counter(f for d, t in zip(docs, toxic) if not t for f in d)
    n_pos, n_neg = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    marker = {f for f, c in pos.items() if c >= MIN_DOCS and c / n_pos > 20 * (neg[f] + 0.5) / n_neg}
    found = np.array([sum(f in marker for f in d) for d in docs])
    middle = np.median(found[toxic == 1]) if toxic.any() else 0
    return np.where(toxic == 0, 0, np.where(found < middle, 1, 2)).astype(np.int64)


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """words (space-joined, distinct) and toxic of at most MAX_TOXIC + MAX_CLEAN labelled documents."""
    once = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = once.where("_toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(once.where("_toxic = 0").orderBy(*order).limit(MAX_CLEAN))
    picked = docs.select("doc_id", text_of().alias("_text")).join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [" ".join(sorted(words_of(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string()), b.column(2)], ["doc_id", "words", "toxic"])

    return picked.select("doc_id", "_text", F.col("_toxic").cast("int")).mapInArrow(run, "doc_id long, words string, toxic int")


def fit(docs: DataFrame, labels: DataFrame) -> CumulativeLink | None:
    rows = sorted(training_sample(docs, labels).collect())
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    if not toxic.any() or toxic.all():
        return None
    features = [features_of(set(r["words"].split())) for r in rows]
    return CumulativeLink().fit(features, grade(features, toxic))


def score_docs(docs: DataFrame, model: CumulativeLink | None) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (most likely) and toxic of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if m is None:
                p = np.tile(np.eye(GRADES)[0], (len(b), 1))
            else:
                p = m.grades_of(np.array([m.score(features_of(words_of(t.as_py()))) for t in b.column(1)], float))
            p_toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p @ np.arange(GRADES)), pa.array(p_toxic), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p_toxic >= DECIDE)],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    schema = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_docs(docs, fit(docs, table(spark, sf_dir, "labels")))
