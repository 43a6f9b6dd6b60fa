"""Main text of web pages by differencing each with the nearest page of its host.

Pages are ordered by host and path; each is paired with the neighbour in its host whose path has the
smaller edit distance. The text lines of the two are aligned by a longest common subsequence and the lines
they share are deleted: what a site repeats from page to page is not the article. Two things mark-up knows
better. A line inside an article or main element stays although the neighbour has it too,
because neighbours may be copies or hold copied passages; and lines in menus, headers,
footers, sidebars, notices, adverts, forms and comments go although the neighbour has others
there. In a page without an article element what differencing leaves is the text.

Pages are numbered along (host, path) by a range sort, so a neighbour is an equality join on a
number: a host with a third of all pages is no hot key. Only line hashes travel to the neighbour.

Defined cases: a null or empty page has empty text; a page whose URL is null or has no host has no
neighbour, and neither has the only page of a host; pages that repeat key, URL and content are one page, with one
result per row; an empty table gives an empty result; other columns are ignored; whole pages are read,
however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import ranked, written
from .markup import MAIN, OPEN, lines_of, shared
from .url_filter import host_of, path_of

ROWS_AT_ONCE = 256


def _identified(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """Rows told apart by what they hold, so that each can be found again without being stored."""
    mark = F.xxhash64(F.col(url), F.col(page))
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"), mark.alias("mark"))


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(start, ROWS_AT_ONCE)
            hashes = [[line_hash(t) for t, _ in lines_of(p)] for p in batch.column("page").to_pylist()]
            columns = [batch.column(c) for c in ("key", "mark", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.list_(pa.int64()))], ["key", "mark", "host", "path", "hashes"])


def _pack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their kinds, compressed; a line that mark-up has settled to go leaves only its place."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(start, ROWS_AT_ONCE)
            packed, kinds = [], []
            for page in batch.column("page").to_pylist():
                lines = lines_of(page)
                wanted = MAIN if any(kind == MAIN for _, kind in lines) else OPEN
                # White space inside a line is one blank, so line ends are free to separate lines.
                packed.append(pack("\n".join(text if kind == wanted else "" for text, kind in lines).encode()))
                kinds.append(bytes(kind for _, kind in lines))
            columns = [batch.column(c) for c in ("key", "mark", "url")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary()), pa.array(kinds, pa.binary())], ["key", "mark", "url", "packed", "kinds"])


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, counts, met = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("packed", "kinds", "shared"))
        for packed, kinds, shared_places in zip(*columns):
            lines, gone = unpack(packed).decode().split("\n"), set(shared_places or ())
            if MAIN in kinds:
                kept = [line for line, kind in zip(lines, kinds) if kind == MAIN]
            else:
                kept = [line for i, (line, kind) in enumerate(zip(lines, kinds)) if kind == OPEN and i not in gone]
            texts.append("\n".join(kept))
            counts.append(len(kinds))
            met.append(len(gone))
        columns = [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(met, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "url", "text", "n_lines", "n_shared"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("hashes").to_pylist(), batch.column("other").to_pylist())
        found = [shared(a, b) for a, b in pairs]
        columns = [batch.column("key"), batch.column("mark"), pa.array(found, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "mark", "shared"])


def shared_lines(rows: DataFrame) -> DataFrame:
    """(key, mark, shared): the line numbers that a page has in common with its nearest page."""
    kind = dict(rows.dtypes)["key"]
    placed = rows.select("key", "mark", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "page")
    hashed = placed.mapInArrow(_hash_lines, f"key {kind}, mark bigint, host string, path string, hashes array<bigint>")
    # Rows that are equal throughout are one page.
    pages = written(hashed.where("host <> ''").dropDuplicates(["key", "mark"]))
    order = ranked(pages.select("host", "path", "key", "mark"), "host", "path", "key", "mark")
    before = order.select((F.col("rank") + 1).alias("rank"), F.struct("host", "path", "key", "mark").alias("before"))
    after = order.select((F.col("rank") - 1).alias("rank"), F.struct("host", "path", "key", "mark").alias("after"))
    both = order.join(before, "rank", "left").join(after, "rank", "left")
    away = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), F.levenshtein("path", F.col(f"{side}.path")))
    nearest = (
        F.when(away("after") < away("before"), F.col("after"))
        .when(away("before").isNotNull(), F.col("before"))
        .when(away("after").isNotNull(), F.col("after"))
    )
    pairs = both.select("key", "mark", nearest.alias("near")).where("near is not null")
    pairs = pairs.select("key", "mark", F.col("near.key").alias("near_key"), F.col("near.mark").alias("near_mark"))
    other = pages.select(F.col("key").alias("other_key"), F.col("mark").alias("other_mark"), F.col("hashes").alias("other"))
    same_other = F.col("near_key").eqNullSafe(F.col("other_key")) & (F.col("near_mark") == F.col("other_mark"))
    own = pages.select(F.col("key").alias("own_key"), F.col("mark").alias("own_mark"), "hashes")
    same_own = F.col("key").eqNullSafe(F.col("own_key")) & (F.col("mark") == F.col("own_mark"))
    met = pairs.join(other, same_other).join(own, same_own).select("key", "mark", "hashes", "other")
    return met.mapInArrow(_align, f"key {kind}, mark bigint, shared array<int>")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_lines (lines of the page), n_shared (those that differencing met
    in the nearest page)."""
    rows = _identified(pages, key, url, page)
    kind = dict(rows.dtypes)["key"]
    gone = shared_lines(rows).where(F.size("shared") > 0)
    gone = gone.select(F.col("key").alias("gone_key"), F.col("mark").alias("gone_mark"), "shared")
    packed = rows.mapInArrow(_pack_lines, f"key {kind}, mark bigint, url string, packed binary, kinds binary")
    met = packed.join(gone, F.col("key").eqNullSafe(F.col("gone_key")) & (F.col("mark") == F.col("gone_mark")), "left")
    met = met.select("key", "url", "packed", "kinds", "shared")
    return met.mapInArrow(_join_lines, f"key {kind}, url string, text string, n_lines bigint, n_shared bigint")
