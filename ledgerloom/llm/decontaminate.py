"""Benchmark decontamination by Wu-Manber search over words.

Test items are cut into windows of ``WINDOW`` consecutive words; an item of fewer words is one window.
Windows of one length form one pattern set. The last two words of the scanned window are looked up in
a shift table that says how far the window may be moved without passing an occurrence; where
the shift is zero, the bucket of that suffix, divided by first word, names the test strings, and
these are compared word by word. Documents are scanned where they lie: no shuffle.

The items reach executors as a broadcast of at most ``BLOCK_BYTES`` of text. A larger benchmark is
searched in several blocks one after the other, each pass carrying what was found so far.

Defined cases: a null or empty text has no words, as document it is clean, as item it has no window; a
null item id shows as the empty text; ids that items repeat count once; an empty benchmark leaves every
document clean; repeated document rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bodies, kept_and_body, words_of

WINDOW = 10
BLOCK_BYTES = 1 << 20


class Matcher:
    """All pattern sets of a block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        self.words = [words for _, words in items]
        self.sets: dict[int, tuple[dict, dict]] = {}
        for number, words in enumerate(self.words):
            m = min(window, len(words))
            if m:
                shift, bucket = self.sets.setdefault(m, ({}, {}))
                for start in range(len(words) - m + 1):
                    self._add(shift, bucket, m, number, words, start)

    @staticmethod
    def _add(shift, bucket, m, number, words, start):
        size = min(2, m)
        for end in range(size, m + 1):
            block = tuple(words[start + end - size : start + end])
            shift[block] = min(shift.get(block, m), m - end)
        firsts = bucket.setdefault(tuple(words[start + m - size : start + m]), {})
        firsts.setdefault(words[start], []).append((number, start))

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans of all occurrences, and the numbers of the items they belong to."""
        spans, found, n = [], set(), len(text)
        for m, (shift, bucket) in self.sets.items():
            if m == 1:
                for p, word in enumerate(text):
                    if (word,) in bucket:
                        spans.append((p, p + 1))
                        found.update(number for number, _ in bucket[word,][word])
                continue
            p, far, jump = m, m - 1, shift.get
            while p <= n:
                step = jump((text[p - 2], text[p - 1]), far)
                if step:
                    p += step
                    continue
                start, hit = p - m, False
                candidates = bucket[text[p - 2], text[p - 1]].get(text[start])
                if candidates:
                    part = text[start:p]
                    for number, at in candidates:
                        if self.words[number][at : at + m] == part:
                            found.add(number)
                            hit = True
                    if hit:
                        spans.append((start, p))
                p += 1
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"


def _pass(bench, text: str, window: int, first: bool, last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(bench.value, window)
        for batch in batches:
            n_words, spans, items = [], [], []
            for i, body in enumerate(bodies(batch, text)):
                words = words_of(body)
                seen, numbers = matcher.search(words)
                names = {matcher.names[k] for k in numbers}
                if not first:
                    seen += [(s["start"], s["end"]) for s in batch.column("spans")[i].as_py()]
                    names.update(batch.column("items")[i].as_py())
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(seen)])
                items.append(sorted(names))
            columns = {
                "row": batch.column("row"),
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array(spans, SPANS),
                "items": pa.array(items, pa.list_(pa.string())),
            }
            if not last and "body" in batch.schema.names:
                columns["body"] = batch.column("body")
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: key, n_words, spans (merged word spans of all occurrences), items (ids as
    text, sorted)."""
    found = with_contamination(documents, benchmark, [key], text, item, item_text, window, block_bytes)
    return found.select(F.col("row")[key].alias("key"), "n_words", "spans", "items")


def with_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """As ``contamination``, with the columns ``keep`` of the documents as a struct ``row``."""
    spark = documents.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("binary").alias("body")
    ).where(F.col("body").isNotNull())
    size = items.agg(F.sum(F.length("body")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-size // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks)))
    rows = kept_and_body(documents, keep, text)
    kind = dict(rows.dtypes)["row"]
    for number in range(blocks):
        block = [(r.name, words_of(bytes(r.body))) for r in items.where(F.col("block") == number).toLocalIterator()]
        bench = spark.sparkContext.broadcast(block)
        last = number == blocks - 1
        schema = f"row {kind}, {FOUND}" + ("" if last or text in keep else ", body binary")
        rows = rows.mapInArrow(_pass(bench, text, window, number == 0, last), schema)
    return rows
