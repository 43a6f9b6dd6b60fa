"""Token ids in binary files.

Texts are dealt by ranges of their key and sorted, so that the files hold the documents in ascending order
of their key. Each task encodes its documents and packs them into blocks, one block a file:

- a fixed header: magic, shard, number in the shard, tokens of the shard before this block, counts and sizes;
- key, number of ids and a null mark per document;
- the distinct ids of the block by falling frequency, so that an id's place in this table is its rank;
- control bytes: two bits an id for the length of its rank, four ids a byte;
- data bytes: the ranks, one to four little-endian bytes each;
- a checksum, and a line feed that Spark's writer puts behind every record.

Ranks are by frequency in the block and not in the corpus: so texts are encoded once, a block decodes without any other
file, and a lost task repeats only its own blocks. Files are written by Spark's text writer, which copies the bytes as they are,
so they reach any store that Spark can write, and attempts of a lost task leave nothing behind.

Encoding tells the words of a slice of texts apart by Arrow, and looks up the units of each distinct word once: white space with the
word or the marks behind it. No token reaches from a word into the white space or the marks behind it, so a text's
ids are those of its units in turn. Only units that a worker does not remember are given to the tokenizers library.

Defined cases: a null text is the empty text and has the end id only; a null key sorts last and comes back null;
documents that repeat a key are ordered by the checksum of their text and the text; an empty
table gives no block and no row; other columns are ignored; a document is never split, so a block of one very long document is
longer than others.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_folder

MAGIC = b"TOKFILE1"
HEADER = struct.Struct(">8s7Q")
#: Text in one shard, which one task writes; the driver gathers one number per shard.
SHARD_BYTES = 32 << 20
#: Ids after which a block is closed.
BLOCK_IDS = 2 << 20
#: Units that a worker remembers at most, and text that is encoded in one step.
MOST_UNITS = 500_000
STEP_BYTES = 6 << 20

# ASCII characters that the vocabulary's expression takes for neither letters nor digits.
MARKS = r"!-/:-@\[-`{-~"
#: White space, then either marks with the word behind them or a word.
UNIT = re.compile(rf"\s*(?:[{MARKS}]+[^\s{MARKS}]*|[^\s{MARKS}]+)|\s+")
WORD = re.compile(r"\s*\S+|\s+")
# ASCII and Latin-1 letters, and where a unit surely ends inside a word (in the syntax of Arrow's library).
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
UNIT_END = rf"([0-9{LETTERS}])([{MARKS}])"
#: Units that the vocabulary's expression does not divide.
ONE_PIECE = re.compile(f" ?[{LETTERS}]+")
#: In no text that is told apart by Arrow.
SEPARATOR = "\x1c"
#: White space to Python but not to the vocabulary's expression.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Those, and characters other than ASCII and the letters of Latin-1: whether they are letters is left to the library.
OTHER = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
#: Texts with more than single spaces, and one or two line feeds, between words (in the syntax of Arrow's library).
UNEVEN = (
    r"[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|^ | \z|  | \n|\n |\n\n\n|\n\n\z"
)
#: Lengths of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: Ids under this are counted in a table instead of sorted.
DENSE_IDS = 1 << 22
#: The sign that stands for each byte in this kind of vocabulary: printable bytes for themselves, the others for those from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b for b in _PRINTED} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_PLACES = np.arange(4, dtype=np.uint8)


# coding ----------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """The id of each rank, control bytes and data bytes of a run of ids."""
    if len(ids) and int(ids.max()) < DENSE_IDS:
        counts = np.bincount(ids)
        values, rank_of = np.flatnonzero(counts), np.zeros(len(counts), np.uint32)
        order = np.argsort(-counts[values], kind="stable")
        rank_of[values[order]] = np.arange(len(order), dtype=np.uint32)
        ranks = rank_of[ids].astype("<u4")
    else:
        values, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank_of = np.empty(len(order), np.uint32)
        rank_of[order] = np.arange(len(order), dtype=np.uint32)
        ranks = rank_of[place.ravel()].astype("<u4")
    extra = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    extra[: len(ranks)] = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = extra.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[_PLACES <= extra[: len(ranks), None]]
    return values[order].astype("<u4"), control.tobytes(), data.tobytes()


def unpack(table: np.ndarray, control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ids of a packed run; control bytes give lengths by table lookup, ranks give ids by another."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    ranks = np.zeros((count, 4), np.uint8)
    ranks[_PLACES < lengths[:, None]] = data
    return table[ranks.view("<u4").reshape(-1)]


def block(shard: int, number: int, before: int, keys: list, sizes: list[int], ids: np.ndarray) -> bytes:
    table, control, data = pack(ids)
    head = HEADER.pack(MAGIC, shard, number, before, len(keys), len(ids), len(table), len(data))
    body = b"".join(
        (
            head,
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array(sizes, "<u8").tobytes(),
            bytes(k is None for k in keys),
            table.tobytes(),
            control,
            data,
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


def parse(content: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """Shard, ids of the shard before this block, keys, sizes, ids."""
    magic, shard, _, before, n_docs, n_ids, n_table, n_data = HEADER.unpack_from(content)
    at = HEADER.size

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, kind, count, at)
        at += found.nbytes
        return found

    keys, sizes, nulls = part("<i8", n_docs), part("<u8", n_docs), part("u1", n_docs)
    table, control, data = part("<u4", n_table), part("u1", -(-n_ids // 4)), part("u1", n_data)
    if magic != MAGIC or part("<u4", 1)[0] != zlib.crc32(content[: at - 4]):
        raise ValueError("not a whole block of token ids")
    named = [None if gone else int(k) for k, gone in zip(keys, nulls)]
    return shard, before, named, sizes.astype(np.int64), unpack(table, control, data, n_ids)


# encoding --------------------------------------------------------------------------------


class UnitCoder:
    """Ids of texts by lookup of their units; remembers a bounded number of units."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        pieces = self.tokenizer.pre_tokenizer
        # The units are those of this kind of vocabulary; with another, a whole text is one unit.
        self.divides = (
            type(pieces).__name__ == "ByteLevel" and pieces.use_regex and not pieces.add_prefix_space and self.tokenizer.normalizer is None
        )
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.divides &= all(re.search(f"[{MARKS}]", a) and not re.search(r"\s", a) for a in added)
        self.places: dict[str, int] = {}
        self.flat, self.ends, self.used = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the half of the units that was looked up most."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: MOST_UNITS // 2])
        units = list(self.places)  # in the order of their places
        self.places = {units[k]: n for n, k in enumerate(keep.tolist())}
        self.flat, sizes = self._ids_at(keep)
        self.ends = np.concatenate([[0], sizes.cumsum()])
        self.used = np.zeros(len(keep), np.int64)

    def _learn(self, units: list[str]) -> None:
        model, found = self.tokenizer.model, []
        rest = []
        for unit in units:
            if self.divides and ONE_PIECE.fullmatch(unit):
                found.append([t.id for t in model.tokenize(unit.encode().decode("latin-1").translate(BYTE_SIGNS))])
            else:
                rest.append(len(found))
                found.append(unit)
        for k, encoded in zip(rest, self.tokenizer.encode_batch([found[k] for k in rest], add_special_tokens=False)):
            found[k] = encoded.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32, sizes.sum())])
        self.ends = np.concatenate([self.ends, self.ends[-1] + sizes.cumsum()])
        self.used = np.concatenate([self.used, np.zeros(len(units), np.int64)])
        self.places.update(zip(units, range(len(self.places), len(self.places) + len(units))))

    def _ids_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        return _gathered(self.flat, starts, sizes), sizes

    def _places(self, units: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.places.get, units, itertools.repeat(-1)), np.int64, len(units))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self._learn(list(dict.fromkeys(units[k] for k in unknown)))
            at[unknown] = [self.places[units[k]] for k in unknown]
        self.used += np.bincount(at, minlength=len(self.used))
        return at

    def encode(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        """Per text its ids and the end id."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        step = sizes.cumsum() // STEP_BYTES
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(step)) + 1):
            if len(part):
                yield from self._slice(texts.slice(part[0], len(part)), end)

    def _slice(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        if len(self.places) > MOST_UNITS:
            self._forget()
        uneven = pc.match_substring_regex(texts, UNEVEN) if self.divides else pa.array([True] * len(texts))
        even, at = self._even(texts.filter(pc.invert(uneven))), 0
        for text, alone in zip(texts, uneven.to_pylist()):
            if alone:
                ids, _ = self._ids_at(self._places(self._units(text.as_py())))
            else:
                ids, at = even[0][even[1][at] : even[1][at + 1]], at + 1
            yield np.append(ids, np.uint32(end))

    def _units(self, text: str) -> list[str]:
        if not self.divides:
            return [text]
        if not OTHER.search(text):
            return UNIT.findall(text)
        return [text] if NOT_SPACE.search(text) else WORD.findall(text)

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's begin; each distinct word of the slice is looked at once."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        found = lists.flatten().dictionary_encode()
        words, codes, starts = found.dictionary, found.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        starts = starts - starts[0]
        spaced = pc.binary_join_element_wise(pa.scalar(" "), words, pa.scalar(""))
        # The first word of a text has no space before it, nor has one behind a line feed.
        firsts, first_code = np.unique(codes[starts[:-1]], return_inverse=True)
        codes[starts[:-1]] = len(words) + first_code.ravel()
        words = pa.concat_arrays([pc.if_else(pc.starts_with(words, "\n"), words, spaced), words.take(pa.array(firsts))])

        parts = pc.split_pattern(pc.replace_substring_regex(words, UNIT_END, rf"\1{SEPARATOR}\2"), SEPARATOR)
        units = parts.flatten().dictionary_encode()
        places = self._places(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = self._ids_at(places[units.indices.to_numpy()])
        sizes = _summed(sizes, np.diff(parts.offsets.to_numpy()))
        every = sizes[codes]
        flat = _gathered(ids, (sizes.cumsum() - sizes)[codes], every)
        return flat, np.concatenate([[0], every.cumsum()])[starts]


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of values one after another, given where each starts and its size."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    shifts = (starts - sizes.cumsum() + sizes).astype(kind)
    return values[np.repeat(shifts, sizes) + np.arange(total, dtype=kind)]


def _summed(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many neighbouring sizes each."""
    ends = np.concatenate([[0], sizes.cumsum()])
    upto = counts.cumsum()
    return ends[upto] - ends[upto - counts]


_CODERS: dict[str, UnitCoder] = {}


def _coder(vocabulary: str) -> UnitCoder:
    """One coder a worker, which serves its later tasks as well."""
    if vocabulary not in _CODERS:
        _CODERS.clear()
        _CODERS[vocabulary] = UnitCoder(vocabulary)
    return _CODERS[vocabulary]


def _blocks(vocabulary: str, end: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        keys, sizes, parts, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([block(shard, number, before, keys, sizes, np.concatenate(parts))], pa.binary())}
            )

        for batch in batches:
            names = batch.column("key").to_pylist()
            for key, ids in zip(names, _coder(vocabulary).encode(batch.column("body"), end)):
                keys.append(key)
                sizes.append(len(ids))
                parts.append(ids)
                held += len(ids)
                if held >= block_ids:
                    yield closed()
                    number, before = number + 1, before + held
                    keys, sizes, parts, held = [], [], [], 0
        if keys:
            yield closed()

    return write


def write_token_files(
    documents: DataFrame,
    path: str,
    vocabulary: str,
    end: int,
    key: str = "doc_id",
    text: str = "text",
    shard_bytes: int = SHARD_BYTES,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of all texts to the folder ``path``; ``key`` is integral."""
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body")).alias("bytes")).first()["bytes"] or 0
    shards = max(1, -(-size // shard_bytes))
    order = [F.col("key").asc_nulls_last(), F.crc32(F.col("body").cast("binary")).asc(), F.col("body").asc()]
    dealt = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(_blocks(vocabulary, end, block_ids), "block binary")
    # As text the bytes are copied unchanged; one record a file keeps every file within a block's size.
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


# reading ---------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > HEADER.size).select("content")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids in all files before each shard, read from the headers: (shard, start)."""
    field = lambda n: F.conv(F.hex(F.substring("content", 9 + 8 * n, 8)), 16, 10).cast("bigint")
    heads = _files(spark, path).select(field(0).alias("shard"), (field(2) + field(4)).alias("upto"))
    starts, total = [], 0
    # One number per shard of SHARD_BYTES of text.
    for row in heads.groupBy("shard").agg(F.max("upto").alias("ids")).orderBy("shard").collect():
        starts.append((row.shard, total))
        total += row.ids
    return spark.createDataFrame(starts, "shard bigint, start bigint")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            shard, before, keys, sizes, ids = parse(content.as_buffer().to_pybytes())
            ends = np.concatenate([[0], sizes.cumsum()])
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array(np.full(len(keys), shard, np.int64)),
                    "key": pa.array(keys, pa.int64()),
                    "place": pa.array(before + ends[:-1]),
                    "n_ids": pa.array(sizes),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                }
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: key, start (ids of all documents before it), n_ids, ids (little-endian 32-bit, end id included)."""
    rows = _files(spark, path).mapInArrow(_documents, "shard bigint, key bigint, place bigint, n_ids bigint, ids binary")
    met = rows.join(F.broadcast(shard_starts(spark, path)), "shard")
    return met.select("key", (F.col("start") + F.col("place")).alias("start"), "n_ids", "ids")


def written_and_read(documents: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """The documents written to a folder of their own in the shared folder, and read back."""
    spark = documents.sparkSession
    path = new_folder(spark)
    write_token_files(documents, path, vocabulary, end)
    return read_token_files(spark, path)
