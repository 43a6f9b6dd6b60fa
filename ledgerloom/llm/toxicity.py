"""Toxicity by cumulative-link ordinal regression on hashed words.

For grades 0 to K the model is P(grade <= k) = sigmoid(t_k - w.x): ordered thresholds t share one weight
vector w. x marks which of ``WIDTH`` hashed words a text holds. A word counts by how far the mean grade of
the sampled texts that hold it stands from that of all, in standard errors, less ``SCREEN``; words
inside that, or in fewer than ``LEAST`` texts, have no weight, so that x is sparse. The output is the expected grade, the sum of P(grade > k).

Learning uses at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their key, of which only the
hashed words reach the driver. Scoring covers every text whole.

Defined cases: a null or empty text holds no word and gets the expected grade of that; null or
contradicted labels are not learnt from; where fewer than two grades are labelled, every text
gets the lowest labelled grade, or 0; repeated rows score alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import words_of

WIDTH = 1 << 18
LEAST = 3
SCREEN = 2.5
SAMPLE_ROWS = 16_000
ROUNDS = 200
RIDGE = 1e-3


@dataclass(frozen=True)
class Model:
    grades: tuple[int, ...]
    thresholds: np.ndarray
    weights: np.ndarray


def hashed(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the words of a text."""
    return np.unique(np.fromiter((zlib.crc32(w) % WIDTH for w in set(words_of(text))), np.int32))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def beyond(thresholds: np.ndarray, z: np.ndarray) -> np.ndarray:
    """P(grade > k) for every text and threshold."""
    return _sigmoid(z[:, None] - thresholds[None, :])


def _word_values(flat: np.ndarray, grade: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What each hashed word counts in x, from the grades of the texts that hold it."""
    held = np.bincount(flat, minlength=WIDTH)
    mean = np.bincount(flat, grade, WIDTH) / np.maximum(held, 1)
    error = np.sqrt(np.maximum(y.var() * (1 / np.maximum(held, 1) - 1 / len(y)), 1e-12))
    return np.where(held >= LEAST, np.maximum(np.abs(mean - y.mean()) / error - SCREEN, 0), 0.0)


def fitted(x: list[np.ndarray], y: np.ndarray, grades: tuple[int, ...], rounds: int = ROUNDS) -> Model:
    """Full-gradient descent with Adam steps on the penalised likelihood; y holds places in ``grades``."""
    k = len(grades) - 1
    flat = np.concatenate([*x, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(x)), [len(r) for r in x])
    value = _word_values(flat, y[row], y)
    row, flat = row[value[flat] > 0], flat[value[flat] > 0]
    words, col = np.unique(flat, return_inverse=True)
    worth = value[words]
    n, share = len(y), np.array([(y > j).mean() for j in range(k)])
    # thresholds: the first, and the logarithms of the steps to the next ones
    first = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    p = np.concatenate([np.zeros(len(words)), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    over = y[:, None] > np.arange(k)[None, :]
    for step in range(1, rounds + 1):
        w, t = p[: len(words)], np.cumsum(np.r_[p[len(words)], np.exp(p[len(words) + 1 :])])
        z = np.bincount(row, (w * worth)[col], n)
        g = np.c_[np.ones(n), beyond(t, z), np.zeros(n)]  # P(grade > -1), P(grade > 0), ..., 0
        take = np.arange(n)
        up, down = g[take, y], g[take, y + 1]
        mass = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up), down * (1 - down)
        # gradient of -log P(y) by z and by each threshold
        dz = -(d_up - d_down) / mass
        dt = np.zeros(k)
        np.add.at(dt, y[y > 0] - 1, (d_up / mass)[y > 0])
        np.add.at(dt, y[y < k], -(d_down / mass)[y < k])
        steps = np.exp(p[len(words) + 1 :])
        tail = np.cumsum(dt[::-1])[::-1]
        grad = np.concatenate(
            [np.bincount(col, dz[row], len(words)) * worth / n + RIDGE * w, tail[:1] / n, tail[1:] * steps / n]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(WIDTH, np.float32)
    weights[words] = p[: len(words)] * worth
    return Model(grades, np.cumsum(np.r_[p[len(words)], np.exp(p[len(words) + 1 :])]), weights)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learnt_from: Column,
    key: str = "doc_id",
    text: str = "text",
    label_key: str = "doc_id",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn from labelled rows for which ``learnt_from`` (over the column ``key``) holds."""
    known = (
        labels.select(F.col(label_key).alias("key"), F.col(label).cast("int").alias("label"))
        .where("key is not null and label is not null")
        .groupBy("key")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where((F.col("label") == F.col("most")) & learnt_from)
    )
    picked = known.orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("key", "label")
    texts = documents.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))
    rows = texts.where("body is not null").join(F.broadcast(picked), "key").select("key", "label", "body")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [hashed(t).astype(np.int32).tobytes() for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.binary())], ["label", "x"])

    points = sorted((r.label, bytes(r.x)) for r in rows.mapInArrow(features, "label int, x binary").collect())
    grades = tuple(sorted({label for label, _ in points}))
    if len(grades) < 2:
        return Model(grades or (0,), np.zeros(0), np.zeros(WIDTH, np.float32))
    y = np.array([grades.index(label) for label, _ in points])
    return fitted([np.frombuffer(x, np.int32) for _, x in points], y, grades)


def severities(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, severity (expected grade), grade (the likeliest)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grades = np.array(model.grades, float)
        for batch in batches:
            z = np.array([model.weights[hashed(t)].sum() for t in batch.column("body").to_pylist()], float)
            above = np.c_[np.ones(len(z)), beyond(model.thresholds, z), np.zeros(len(z))]
            mass = above[:, :-1] - above[:, 1:]
            best = grades[mass.argmax(axis=1)].astype(int) if len(z) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(mass @ grades, pa.float64()), pa.array(best, pa.int32())],
                ["key", "severity", "grade"],
            )

    return rows.mapInArrow(scored, f"key {dict(rows.dtypes)['key']}, severity double, grade int")
