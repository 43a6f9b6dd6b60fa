"""Resampling of documents towards a target distribution, by importance weights of hashed word runs.

The features of a text are its runs of one to ``LONGEST`` words; a feature's bucket is the CRC-32 of its words
joined by single spaces, modulo the number of buckets. No run is ever built as a string:

- the distinct words of a slice of texts, each between two spaces, are the patterns of an Aho-Corasick automaton; each carries
  its CRC-32 and its length;
- one scan over the folded slice emits the payloads of its words in order, as neighbours share the space between them;
- checksums of neighbours compose: that of "a b" is that of "a " moved on by the length of b, exclusive-or that of b.
  Moving on is linear in the 32 bits, so it is four table lookups, by NumPy for all runs of a slice at once.

The dictionary is that of a slice and not of the corpus, whose distinct words have no bound and could not be broadcast. The scan is done
once: its buckets are stored, counted, and then scored. A bucket's gain compares the target's
share of it with the corpus' share; a document's weight is the sum of its gains; weights with Gumbel noise, which is fixed by seed
and key, draw without replacement.

Defined cases: a null text has no words; a text without words has no feature and weight 0; texts below the least number of words are
weighed but never drawn; a null key counts as the empty text for the noise and sorts last; rows that repeat a key are weighed and
drawn one by one, in the order of score, key, number of features; an empty corpus gives no row, an empty target
gives every bucket a count of 0; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import folded, ranked, written

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
SEED = 42
#: Text whose distinct words share one automaton.
SLICE_BYTES = 8 << 20
#: Stands between two texts of a slice; folding leaves no such word in a text.
BREAK = "\x01"

# The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


# checksums of runs -----------------------------------------------------------------------


@functools.cache
def _byte_steps() -> np.ndarray:
    """For each value of the low byte, what eight shifts make of it."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ POLYNOMIAL, steps >> 1).astype(np.uint32)
    return steps


def _moved(table: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The sums moved on by a table of shape (4, 256): one lookup per byte."""
    return table[0][sums & 255] ^ table[1][sums >> 8 & 255] ^ table[2][sums >> 16 & 255] ^ table[3][sums >> 24]


@functools.lru_cache(maxsize=4096)
def _move(length: int) -> np.ndarray:
    """The table that moves a sum on by ``length`` zero bytes, by halving the length."""
    basis = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    if length == 0:
        return basis
    if length == 1:
        return basis >> 8 ^ _byte_steps()[basis & 255]
    half = _move(length // 2)
    whole = _moved(half, half)
    return _moved(_move(1), whole) if length % 2 else whole


class Runs:
    """Checksums of runs of neighbouring words, given each word's checksum and length."""

    def __init__(self, sums: np.ndarray, lengths: np.ndarray):
        self.sums = sums
        self.spaced = _moved(_move(1), sums) ^ np.uint32(zlib.crc32(b" "))  # of the word with a space behind it
        kinds, self.kind = np.unique(lengths, return_inverse=True)
        self.tables = np.stack([_move(int(n)) for n in kinds]) if len(kinds) else np.empty((0, 4, 256), np.uint32)

    def _behind(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Checksums of what ``sums`` stand for, each with one more of ``words`` behind it."""
        kind = self.kind[words]
        out = self.sums[words].copy()
        for byte in range(4):
            out ^= self.tables[kind, byte, sums >> (8 * byte) & 255]
        return out

    def of(self, words: np.ndarray, longest: int) -> Iterator[np.ndarray]:
        """For runs of 1, 2, ... words the checksum of the run that starts at each place."""
        last, space = _move(1), np.uint32(zlib.crc32(b" "))
        run = self.sums[words]
        yield run
        for size in range(1, longest):
            run = run[: max(len(words) - size, 0)]
            run = self._behind(_moved(last, run) ^ space, words[size:])
            yield run


# features --------------------------------------------------------------------------------


def _scan(texts: list[bytes]) -> tuple[np.ndarray, Runs]:
    """The words of all texts in order, as numbers of distinct words, with -1 between two texts; and their payloads."""
    mark = BREAK.encode()
    slice_text = b" " + (b" " + mark + b" ").join(folded(text) for text in texts) + b" "
    distinct = sorted(set(slice_text.split()) - {mark})
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    automaton.add_word(f" {BREAK} ", -1)
    for number, word in enumerate(distinct):
        automaton.add_word(f" {word.decode('latin-1')} ", number)
    automaton.make_automaton()
    found = np.fromiter((number for _, number in automaton.iter(slice_text.decode("latin-1"))), np.int64)
    sums = np.array([zlib.crc32(word) for word in distinct], np.uint32)
    return found, Runs(sums, np.array([len(word) for word in distinct], np.int64))


def slice_buckets(texts: list[bytes], buckets: int, longest: int) -> list[tuple[int, np.ndarray]]:
    """Per text the number of words and the buckets of all its runs."""
    found, payloads = _scan(texts)
    breaks = np.flatnonzero(found < 0)
    starts = np.concatenate([[0], breaks + 1])
    ends = np.concatenate([breaks, [len(found)]])
    # A run that meets a break is cut out below, so any word may stand in for a break.
    words = np.where(found < 0, 0, found)
    runs = [(s % np.uint32(buckets)).astype(np.uint32) for s in payloads.of(words, longest)] if len(payloads.sums) else []
    out = []
    for start, end in zip(starts, ends):
        parts = [run[start : max(start, end - size)] for size, run in enumerate(runs)]
        out.append((int(end - start), np.concatenate(parts) if parts else np.empty(0, np.uint32)))
    return out


def _slices(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _features(buckets: int, longest: int, slice_bytes: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("body").to_pylist(), slice_bytes):
                found = slice_buckets(texts, buckets, longest)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column("key").slice(at, len(texts)),
                        "n_words": pa.array([n for n, _ in found], pa.int64()),
                        "n_features": pa.array([len(b) for _, b in found], pa.int64()),
                        "buckets": pa.array([b.astype(_kind(buckets)).tobytes() for _, b in found], pa.binary()),
                    }
                )
                at += len(texts)

    return find


def features(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: key, n_words, n_features, buckets (little-endian, two bytes each, four above 65536 buckets)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    rows = documents.select(F.col(key).alias("key"), body)
    schema = f"key {dict(rows.dtypes)['key']}, n_words bigint, n_features bigint, buckets binary"
    return rows.mapInArrow(_features(buckets, longest, slice_bytes), schema)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Features per bucket: (bucket, n), buckets without features left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column("buckets"):
                total += np.bincount(np.frombuffer(one.as_buffer(), _kind(buckets)), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met), "n": pa.array(total[met])})

    # Each task sends at most one row per bucket.
    return found.select("buckets").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, in thousandths of the logarithm of the target's share over the corpus' share."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    all_s, all_t = (side.agg(F.sum("n").alias("n")).first()["n"] or 0 for side in (corpus, target))
    met = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    more = lambda name: F.coalesce(F.col(name), F.lit(0)) + 1.0
    ratio = more("t") * float(all_s + buckets) / (more("s") * float(all_t + buckets))
    return met.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))


def weights(found: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``features`` with a weight instead of the buckets."""
    table = np.zeros(buckets, np.int64)
    for row in gain.collect():  # one number per bucket
        table[row.bucket] = row.gain
    shared = found.sparkSession.sparkContext.broadcast(table)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(shared.value[np.frombuffer(b.as_buffer(), _kind(buckets))].sum()) for b in batch.column("buckets")]
            yield pa.RecordBatch.from_pydict(
                {**{n: batch.column(n) for n in ("key", "n_words", "n_features")}, "weight": pa.array(sums, pa.int64())}
            )

    return found.mapInArrow(weigh, f"key {dict(found.dtypes)['key']}, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and key."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def resampled(
    documents: DataFrame,
    target: DataFrame,
    percent: int,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: key, n_words, n_features, weight, score, rank.

    Of the N documents with ``min_words`` words or more, floor(percent * N / 100) are drawn; their rank
    counts from 1, that of the others is null.
    """
    found = written(features(documents, key, text, buckets, longest))
    wanted = written(features(target.select(F.lit(0).alias("key"), F.col(target_text).alias("body")), "key", "body", buckets, longest))
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets)
    weighed = weights(found, gain, buckets)
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    enough = F.col("n_words") >= min_words
    drawn = (scored.where(enough).count() * percent) // 100
    placed = ranked(
        scored.withColumns({"_short": ~enough, "_down": -F.col("score"), "_last": F.col("key").isNull()}),
        "_short", "_down", "_last", "key", "n_features",
    )
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("bigint")
    return placed.select("key", "n_words", "n_features", "weight", "score", rank.alias("rank"))
