"""Quality by compression: which of two dictionaries shortens a text more.

A zstandard dictionary is built from good and one from bad labelled text. A text is cut into blocks
of ``BLOCK`` bytes, all of which are compressed with either; the difference of the two compressed
sizes, over the length and over the larger of them, and the compressed length itself go through
a logistic calibration, fitted on labelled texts that neither dictionary has seen.

Learning uses bounded samples of labelled rows, chosen by a hash of their key: ``DICTIONARY_ROWS``
rows of each class, cut into blocks of which ``DICTIONARY_BLOCKS`` are gathered, and ``CALIBRATION_ROWS``
rows with their own class shares, of which only the features are gathered. Scoring covers every text.

Defined cases: a null or empty text has score 0; rows whose label is null or contradicted are not learnt
from; without labels of both classes every other text scores the share of good labels, (good +
1) / (all + 2); repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import bodies, kept_and_body

BLOCK = 2048
LEVEL = 3
DICTIONARY_BYTES = 112 << 10
DICTIONARY_ROWS = 1000
DICTIONARY_BLOCKS = 3000
CALIBRATION_ROWS = 6000
FEATURES = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    base: float


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train one, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of a text with one dictionary, without what every frame costs."""

    def __init__(self, content: bytes):
        loaded = zstandard.ZstdCompressionDict(content)
        loaded.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=loaded, write_checksum=False, write_content_size=False, write_dict_id=False
        ).compress
        self.empty = len(self.compress(b""))

    def __call__(self, blocks: list[bytes]) -> int:
        return sum(len(self.compress(b)) - self.empty for b in blocks)


def features(text: bytes, good: Sizes, bad: Sizes) -> tuple[float, float, float]:
    blocks = blocks_of(text)
    a, b = good(blocks), bad(blocks)
    return (b - a) / len(text), (b - a) / max(a, b, 1), a / len(text)


def calibrated(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps, each halved until the penalised loss falls."""
    x = np.c_[np.ones(len(x)), x]

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve(
            x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w
        )
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(text: bytes | None, model: Model, good: Sizes | None, bad: Sizes | None) -> float:
    if not text:
        return 0.0
    if good is None:
        return model.base
    return float(sigmoid(np.dot(model.weights, (1.0, *features(text, good, bad)))))


def _sizes(model: Model) -> tuple[Sizes | None, Sizes | None]:
    return (Sizes(model.good), Sizes(model.bad)) if model.weights else (None, None)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, numbers, parts = [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
            for number, part in enumerate(blocks_of(text)):
                keys.append(key), numbers.append(number), parts.append(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, batch.column("key").type), pa.array(numbers, pa.int64()), pa.array(parts, pa.binary())],
            ["key", "number", "part"],
        )


def _measure(dictionaries):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = (Sizes(d) for d in dictionaries)
        for batch in batches:
            rows = [features(text, good, bad) for text in batch.column("body").to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(FEATURES)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *columns], ["label", "f0", "f1", "f2"])

    return measure


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learnt_from: Column,
    key: str = "doc_id",
    text: str = "text",
    label_key: str = "doc_id",
    label: str = "quality",
    dictionary_rows: int = DICTIONARY_ROWS,
    dictionary_blocks: int = DICTIONARY_BLOCKS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> Model:
    """Learn from labelled rows for which ``learnt_from`` (over the column ``key``) holds."""
    known = (
        labels.select(F.col(label_key).alias("key"), F.col(label).cast("int").alias("label"))
        .where("key is not null and label in (0, 1)")
        .groupBy("key")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where((F.col("label") == F.col("most")) & learnt_from)
        .select("key", "label")
    )
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    base = (good + 1) / (good + bad + 2)
    order = F.xxhash64("key"), F.col("key")
    texts = documents.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))
    texts = texts.where("key is not null and length(body) > 0")

    def chosen(rows: DataFrame) -> DataFrame:
        # At most as many rows as the parameters say, so the broadcast is bounded.
        return texts.join(F.broadcast(rows), "key")

    def first(of: int, rows: int) -> DataFrame:
        # A dictionary never takes more than half of its class, so that some is left for calibration.
        return known.where(F.col("label") == of).orderBy(*order).limit(min(rows, (counts.get(of, 0) + 1) // 2))

    def content(of: int) -> list[bytes]:
        kind = dict(texts.dtypes)["key"]
        parts = chosen(first(of, dictionary_rows)).select("key", "body").mapInArrow(_cut, f"key {kind}, number bigint, part binary")
        picked = parts.orderBy(F.xxhash64("key", "number"), "key", "number", "part").limit(dictionary_blocks)
        return [bytes(r.part) for r in picked.collect()]

    samples = {of: content(of) for of in (1, 0)} if good and bad else {}
    if not samples or not all(samples.values()):
        return Model(b"", b"", (), base)
    dictionaries = dictionary(samples[1]), dictionary(samples[0])
    used = first(1, dictionary_rows).unionByName(first(0, dictionary_rows)).select("key")
    rest = known.join(F.broadcast(used), "key", "left_anti")
    picked = rest.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(calibration_rows)
    measured = chosen(picked).select("label", "body").mapInArrow(
        _measure(dictionaries), "label int, f0 double, f1 double, f2 double"
    )
    # In a fixed order, so that sums do not depend on which task ends first.
    points = np.array(sorted(tuple(r) for r in measured.collect()), dtype=float).reshape(-1, 1 + FEATURES)
    if len(set(points[:, 0])) < 2:
        return Model(b"", b"", (), base)
    weights = calibrated(points[:, 1:], points[:, 0])
    return Model(*dictionaries, tuple(float(w) for w in weights), base)


def scores(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, score from 0 to 1, the likelihood that the text is good."""
    return with_score(documents, model, [key], text).select(F.col("row")[key].alias("key"), "score")


def with_score(documents: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """As ``scores``, with the columns ``keep`` of the documents as a struct ``row``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = kept_and_body(documents, keep, text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(shared.value)
        for batch in batches:
            found = [score(body, shared.value, *sizes) for body in bodies(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], ["row", "score"])

    return rows.mapInArrow(scored, f"row {dict(rows.dtypes)['row']}, score double")
