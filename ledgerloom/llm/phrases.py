"""Phrase collocations: runs of words that stand together more often than their parts would.

Counting all runs of up to three words exactly would shuffle nearly as many runs as there are words. So a first pass finds, with
mergeable Misra-Gries summaries, a small superset of the frequent ones, and a second pass counts only those, exactly:

1. Texts are packed into portions of one language, normalised once and stored.
2. Each portion counts its own runs by a hash, whose high part deals them to hash partitions and whose low 32 bits name them
   inside the partition. A portion's counts are its summaries, one for each hash partition.
3. A partition's summaries are merged under a fixed number of counters, more than its mass (the occurrences of all its runs) over the
   least count: where there are more, the count of the first that does not fit is taken off all and counters at nought
   go. All that is ever taken off is under the least count, so every frequent run keeps a counter; those whose
   counter with all that was taken off reaches the least count survive. Two runs of one name add up, which can only keep more.
4. Each portion gets back which of its own runs survive, and counts these by their words. The sums are exact.

Nothing is broadcast and nothing passes the driver; the number of partitions grows with the text, so a task's
counters do not.

Defined cases: a null text is the empty text, a null language is ``und`` (as is a language of that name); texts without words, and
a text whose pieces have one word each, have no phrase; repeated rows count repeatedly; an empty table gives no phrase;
a language without a candidate gives no row; other columns are ignored. Words are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import release_memory, written

LONGEST = 3
LEAST = 10
TOP = 2000
#: A phrase goes if a longer one that holds it has this percentage of its occurrences.
HELD_PERCENT = 50
NO_LANGUAGE = "und"
LEAST_SALTS = 16
#: Text of a portion, and text whose runs make up one hash partition.
PORTION_BYTES = 6 << 20
PART_BYTES = 32 << 20
#: Counters of a summary, as a multiple of the least number that keeps every frequent run; with more, fewer others survive.
SPARE = 2

# Characters that end a piece.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: What stands for all of them; bytes, A-Z lower-cased.
BREAK = b"."
NORMAL = bytes(
    BREAK[0] if c in PIECE_ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


# words and runs --------------------------------------------------------------------------


class Words:
    """The words of a normalised body in order, as numbers of its distinct words."""

    def __init__(self, body: bytes):
        spaced = pa.array([body.replace(BREAK, b" " + BREAK + b" ")], pa.large_binary())
        found = pc.split_pattern(spaced, b" ").flatten()
        found = found.filter(pc.greater(pc.binary_length(found), 0)).dictionary_encode()
        self.distinct = found.dictionary
        self.ids = found.indices.to_numpy(zero_copy_only=False)
        del spaced, found
        pa.default_memory_pool().release_unused()
        self.inside = self.ids != pc.index(self.distinct, pa.scalar(BREAK, pa.large_binary())).as_py()

    def starts(self, size: int) -> np.ndarray:
        """Places where a run of so many words of one piece starts."""
        count = len(self.ids) - size + 1
        if count <= 0:
            return np.empty(0, np.int64)
        whole = self.inside[:count].copy()
        for k in range(1, size):
            whole &= self.inside[k : k + count]
        return np.flatnonzero(whole)

    def hashes(self, language: str, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1, 2, ... words where they start and a 64-bit hash of language and words."""
        seed = xxhash.xxh32_intdigest(language.encode())
        word = np.array([xxhash.xxh3_64_intdigest(w.as_buffer(), seed) for w in self.distinct], np.uint64)[self.ids]
        run = np.zeros(len(self.ids), np.uint64)
        for size in range(1, longest + 1):
            run = run[: max(len(word) - size + 1, 0)]
            run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + word[size - 1 :])
            places = self.starts(size)
            yield places, run[places]


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    values = (values ^ values >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ values >> np.uint64(29)


def _names(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition in the high 32 bits and name inside it in the low ones."""
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    return (high * np.uint64(parts) >> np.uint64(32)) << np.uint64(32) | _mixed(low + high * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)


LOW = np.uint64(0xFFFFFFFF)


class Summary:
    """A Misra-Gries summary of fixed capacity; what is taken off counters is bounded by mass over capacity.

    A counter is one number, the name above its count, so that merging is one sort. A count stops at 2 ** 32 - 1, which
    is beyond any least count.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.counters = np.empty(0, np.uint64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, names: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append(names.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64))
        self.held += len(names)
        if self.held > self.capacity:
            self.merge()

    def merge(self) -> None:
        every = np.concatenate([self.counters, *self.waiting])
        self.waiting, self.held = [], 0
        every.sort()
        firsts = np.flatnonzero(np.concatenate([[len(every) > 0], (every[1:] ^ every[:-1]) > LOW]))
        if len(firsts) == 0:
            return
        names, counts = every[firsts] & ~LOW, np.add.reduceat(every & LOW, firsts)
        if len(names) > self.capacity:
            off = np.partition(counts, -self.capacity - 1)[-self.capacity - 1]
            self.lost += int(off)
            left = counts > off
            names, counts = names[left], counts[left] - off
        self.counters = names | np.minimum(counts, LOW)

    def reaching(self, least: int) -> np.ndarray:
        """Names, in order, that may occur so often."""
        self.merge()
        able = (self.counters & LOW) + np.uint64(self.lost) >= np.uint64(least)
        return (self.counters[able] >> np.uint64(32)).astype(np.uint32)


def packed_names(names: np.ndarray) -> bytes:
    """Sorted names as their gaps, byte by byte of all gaps, compressed: about half their size."""
    return _planes(np.diff(names, prepend=np.uint32(0)))


def names_of(packed: bytes) -> np.ndarray:
    return _numbers(packed).cumsum(dtype=np.uint32)


def _planes(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


# steps -----------------------------------------------------------------------------------


def _portions(portion_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        task, number = TaskContext.get().partitionId(), 0

        def flushed(language: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            # Numbers of one language lie together: 15 bits of its hash, 24 of the task, 24 of the place in the task.
            name = (xxhash.xxh32_intdigest(language.encode()) & 0x7FFF) << 48 | task << 24 | number
            body = zstandard.compress(b"\n".join(held.pop(language)).translate(NORMAL), 1)
            del sizes[language]
            return pa.RecordBatch.from_pydict({"portion": [name], "lang": [language], "body": pa.array([body], pa.binary())})

        for batch in batches:
            for language, body in zip(batch.column("lang").to_pylist(), batch.column("body")):
                text = body.as_py()
                held.setdefault(language, []).append(text)
                sizes[language] = sizes.get(language, 0) + len(text) + 1
                if sizes[language] >= portion_bytes:
                    yield flushed(language)
                elif sum(sizes.values()) >= 2 * portion_bytes:
                    yield flushed(max(sizes, key=sizes.get))
        for language in list(held):
            yield flushed(language)
        release_memory()

    return pack


def _counted_names(words: Words, language: str, parts: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names of all runs, in order, and how often each occurs."""
    every, held = np.empty(longest * len(words.ids), np.uint64), 0
    for places, hashes in words.hashes(language, longest):
        every[held : held + len(places)] = _names(hashes, parts)
        held += len(places)
    every = every[:held]
    every.sort()
    firsts = np.flatnonzero(np.concatenate([[held > 0], every[1:] != every[:-1]]))
    return every[firsts], np.diff(firsts, append=held)


def _summaries(parts: int, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion, language, body in zip(*(batch.column(n) for n in ("portion", "lang", "body"))):
                words = Words(zstandard.decompress(body.as_buffer()))
                names, counts = _counted_names(words, language.as_py(), parts, longest)
                cuts = np.flatnonzero(np.diff(names >> np.uint64(32), prepend=np.uint64(parts))) if len(names) else []
                ends = [*cuts[1:], len(names)]
                low = names.astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "portion": pa.array([portion.as_py()] * len(cuts), pa.int64()),
                        "part": pa.array([int(names[a] >> np.uint64(32)) for a in cuts], pa.int64()),
                        "mass": pa.array([int(counts[a:b].sum()) for a, b in zip(cuts, ends)], pa.int64()),
                        "names": pa.array([packed_names(low[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
                        "counts": pa.array([_planes(counts[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
                    }
                )
        release_memory()

    return count


def _met(names: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which of the names are among the sorted ``kept``."""
    if not len(kept):
        return np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(kept, names), len(kept) - 1)
    return kept[at] == names


def _answers(least: int):
    """Rows come by part. A part's summaries are merged, and each portion's names shrink to those that survive.

    The capacity follows from the mass of the whole part, so its summaries wait, packed, until all are there: about
    two bytes for each name that a portion of the part has, which the size of a part bounds.
    """

    def answered(part: int, waiting: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        summary = Summary(SPARE * sum(mass for _, mass, _, _ in waiting) // least + 1)
        for _, _, names, counts in waiting:
            summary.add(names_of(names), _numbers(counts))
        kept = summary.reaching(least)
        found = [(portion, these[_met(these, kept)]) for portion, these in ((w[0], names_of(w[2])) for w in waiting)]
        found = [(portion, packed_names(names)) for portion, names in found if len(names)]
        return pa.RecordBatch.from_pydict(
            {
                "portion": pa.array([portion for portion, _ in found], pa.int64()),
                "part": pa.array([part] * len(found), pa.int64()),
                "names": pa.array([names for _, names in found], pa.binary()),
            }
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = None, []
        for batch in batches:
            for portion, this, mass, names, counts in zip(*(batch.column(n) for n in ("portion", "part", "mass", "names", "counts"))):
                if this.as_py() != part:
                    if waiting:
                        yield answered(part, waiting)
                    part, waiting = this.as_py(), []
                waiting.append((portion.as_py(), mass.as_py(), names.as_py(), counts.as_py()))
        if waiting:
            yield answered(part, waiting)
        release_memory()

    return merge


def _exact(parts: int, longest: int):
    """Rows come by portion, the names that survive first; counts by words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, []
        for batch in batches:
            for portion, part, names, language, body in zip(*(batch.column(n) for n in ("portion", "part", "names", "lang", "body"))):
                if portion.as_py() != current:
                    current, kept = portion.as_py(), []
                if not body.is_valid:
                    kept.append(names_of(names.as_py()).astype(np.uint64) | np.uint64(part.as_py() << 32))
                    continue
                words, lang = Words(zstandard.decompress(body.as_buffer())), language.as_py()
                release_memory()
                yield _rows(lang, 0, pa.array([""], pa.large_binary()), np.array([words.inside.sum()]))
                alive = np.sort(np.concatenate(kept)) if kept else np.empty(0, np.uint64)
                for size, (places, hashes) in enumerate(words.hashes(lang, longest), 1):
                    yield _counted(words, lang, size, places[_met(_names(hashes, parts), alive)])
        release_memory()

    return count


def _counted(words: Words, language: str, size: int, places: np.ndarray) -> pa.RecordBatch:
    """Exact counts of the runs that start at the places, told apart by all their words."""
    many = len(words.distinct)
    key, bound = words.ids[places].astype(np.int64), many
    for k in range(1, size):
        if bound * many >= 1 << 63:
            kinds, key = np.unique(key, return_inverse=True)
            bound = len(kinds)
        key, bound = key * many + words.ids[places + k], bound * many
    _, firsts, counts = np.unique(key, return_index=True, return_counts=True)
    texts = [words.distinct.take(pa.array(words.ids[places[firsts] + k])) for k in range(size)]
    phrases = texts[0] if size == 1 else pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary()))
    return _rows(language, size, phrases, counts)


def _rows(language: str, size: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "lang": pa.array([language] * len(counts), pa.string()),
            "size": pa.array(np.full(len(counts), size, np.int32)),
            "phrase": phrases.cast(pa.binary()).cast(pa.string()),
            "n": pa.array(counts.astype(np.int64)),
        }
    )


def frequent_runs(
    documents: DataFrame,
    text: str = "text",
    language: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    portion_bytes: int = PORTION_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Exact counts (lang, size, phrase, n) of all runs of up to ``longest`` words that occur ``least`` times or more, and with
    size 0 the number of words of each language."""
    lang = F.coalesce(F.col(language).cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    rows = documents.select(lang, body)
    portions = written(rows.mapInArrow(_portions(portion_bytes), "portion bigint, lang string, body binary"))
    size = rows.agg(F.sum(F.octet_length("body")).alias("bytes")).first()["bytes"] or 0
    parts = max(1, -(-size // part_bytes))
    summaries = portions.mapInArrow(_summaries(parts, longest), "portion bigint, part bigint, mass bigint, names binary, counts binary")
    by_part = summaries.repartition("part").sortWithinPartitions("part")
    answers = written(by_part.mapInArrow(_answers(least), "portion bigint, part bigint, names binary"))

    nothing = F.lit(None)
    told = answers.select("portion", "part", "names", nothing.cast("string").alias("lang"), nothing.cast("binary").alias("body"))
    told = told.unionByName(
        portions.select("portion", nothing.cast("bigint").alias("part"), nothing.cast("binary").alias("names"), "lang", "body")
    )
    # By range: portions of one language are neighbours, so a task's counts of them add up before the shuffle.
    told = told.repartitionByRange("portion").sortWithinPartitions(F.col("portion"), F.col("part").asc_nulls_last())
    counted = told.mapInArrow(_exact(parts, longest), "lang string, size int, phrase string, n bigint")
    sums = counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return sums.where((F.col("size") == 0) | (F.col("n") >= least))


# scores ----------------------------------------------------------------------------------


def collocations(
    documents: DataFrame,
    text: str = "text",
    language: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    held_percent: int = HELD_PERCENT,
    **sizes: int,
) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score."""
    runs = written(frequent_runs(documents, text, language, longest, least, **sizes))
    counts = runs.where("size > 0").select("lang", "phrase", F.col("n").alias("f"))
    candidates = runs.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns(
        {"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")}
    )
    # Frequent words are hot keys here; adaptive execution splits their partitions of the larger side.
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    # Decimals that hold counts up to 10 ** 14; the quotient is at most a million.
    wide = "cast({} as decimal(14,0))".format
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("size").alias("size"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )

    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m),"
        " s -> array_join(slice(split(phrase, ' '), s + 1, m), ' '))))"
    )
    held = candidates.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * held_percent)
    )
    scored = written(left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best_of = lambda rows, *key: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *key).orderBy(*order))).where(F.col("rank") <= top)
    # A language may hold most phrases: the first of every salt of it, and again, until those are few enough for one task.
    left, some = scored.count(), scored
    salts = max(LEAST_SALTS, left // (20 * top))
    while left > 2 * LEAST_SALTS * top or salts == LEAST_SALTS:
        some = best_of(some.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))), "salt").drop("rank", "salt")
        left = salts * top
        salts = left // (20 * top)
    first = best_of(some)
    words = runs.where("size = 0").select("lang", "n")
    return first.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
