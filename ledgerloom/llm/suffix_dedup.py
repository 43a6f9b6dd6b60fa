"""Removal of byte strings that an earlier document has, by sorting the suffixes of a difference cover.

Only suffixes at the positions of a difference cover are sorted: positions chosen so that two equal strings of
``LENGTH`` bytes, wherever they start, have a covered position at the same distance from their starts. A cover by
residues modulo three holds two thirds of all bytes. Here it is chosen by content: of the hashes of
the ``GRAM``-byte strings inside a window of ``LENGTH`` bytes the smallest is covered (all of equal ones), which
equal windows do alike, and one byte in thirteen is enough. The steps are those of the difference-cover algorithm:

1. Names. The gram at each covered position gets a name. Names of one document only are told from others by
   counting them in packed blocks; what remains is a bit map of bounded size, which lets some others through
   and misses none.
2. Triples. A covered position with a repeated name becomes a triple: the bytes before, the gram, the bytes after, as
   far as a window that holds the gram can reach. Triples are sorted by name and content; equal triples are
   neighbours, and the smallest document that has one is its owner. Every other document loses it. Before the
   shuffle each group of documents drops all but its smallest key, so a passage that very many documents
   share is one record per group; what comes back to a document are the places that it owns.
3. Remaining suffixes. Every window start between covered positions is ordered through the covered position
   it reaches: the windows of owned triples with the same name but other neighbours are sorted.
4. Adjacent prefixes of ``LENGTH`` bytes are compared; where an owner meets a smaller document, it loses that window.

Triples are told apart by 48 bits of a hash of their bytes, next to the 47 bits of the name; windows are compared
themselves. What travels between documents and names goes in packed blocks, one per group of documents and range of
names, and comes back in blocks by document; bit maps are made by all tasks at the same time. A name with more than ``MOST_TRIPLES`` different triples is not held in one task; its windows are
grouped by Spark.

Keys are integers. Defined cases: a null text is empty; a null key comes after all others; rows of equal keys are
never earlier than each other; texts shorter than ``LENGTH`` bytes stay whole; an empty table gives an
empty result; other columns are ignored; whole texts are read, in pieces of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import release_memory, with_group, written

LENGTH = 50
GRAM = 24
SIDE = LENGTH - GRAM  # bytes that a window may reach to either side of the gram
CONTEXT = GRAM + 2 * SIDE
STARTS = SIDE + 1
TRIPLE = -(-(CONTEXT + 2) // 8) * 8  # bytes of a triple: what it has to either side, its context, zeros up to whole words
NAME_BITS = 47
MOST_TRIPLES = 50_000
#: The bit map of repeated names grows with the input up to this bound, 64 MB.
MOST_FILTER_BITS = 1 << 29
PIECE_BYTES = 1 << 17
GROUP_BYTES = 1 << 24
GROUP_ROW_BITS = 64 - NAME_BITS
PART_BYTES = 1 << 24
PACKED_BYTES = 1 << 19
TRIPLES_AT_ONCE = 1 << 16
NO_KEY = (1 << 63) - 1

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number (along the last axis)."""
    if data.ndim == 1:
        found = np.empty(len(data) - 7, np.uint64)
        for start in range(min(8, len(found))):
            whole = (len(data) - start) // 8
            found[start::8] = np.frombuffer(data, "<u8", whole, start)
        return found
    view = np.lib.stride_tricks.sliding_window_view(data, 8, axis=-1)
    return np.ascontiguousarray(view).view(np.uint64)[..., 0]


def _words_at(data: np.ndarray) -> np.ndarray:
    """The same without copies, to be asked at a few positions."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _stir(h: np.ndarray, words: np.ndarray) -> None:
    """Takes the next words into these hashes. The upper half comes down, or differences in the last bytes of words
    would only ever meet the last bytes of others, and one pair of two hundred would cancel out."""
    h ^= words
    h *= _M1
    h ^= h >> np.uint64(32)


def _hash(words: np.ndarray, offsets: list[int], width: int) -> np.ndarray:
    """Hash of the strings that the words at these offsets make up, from ``width`` positions on."""
    h = np.full((*words.shape[:-1], width), _M3)
    for at in offsets:
        _stir(h, words[..., at : at + width])
    return _mixed(h)


def _joined(columns) -> np.ndarray:
    """One hash of the numbers of each row."""
    h = np.full(len(columns[0]), _M3)
    for column in columns:
        _stir(h, column.astype(np.uint64, copy=False))
    return _mixed(h)


def _ranks(data: np.ndarray) -> np.ndarray:
    """A number over zero for the gram at every position: a polynomial of its bytes, by doubling, scrambled."""
    h, base = data.astype(np.uint32), 0x01000193
    for have in (1, 2, 4):
        longer = h[:-have] * np.uint32(pow(base, have, 1 << 32))
        longer += h[have:]
        h = longer
    eight, size = np.uint32(pow(base, 8, 1 << 32)), len(data) - GRAM + 1
    rank = h[:size] * eight
    for at in range(8, GRAM, 8):
        rank += h[at : at + size]
        if at + 8 < GRAM:
            rank *= eight
    rank ^= rank >> np.uint32(15)
    rank *= np.uint32(0x2C1B3C6D)
    rank ^= rank >> np.uint32(13)
    return rank | np.uint32(1)


def _slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def covered(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covered positions of joined documents that end at ``ends``, and the names of their grams.

    Windows that reach over the end of a document cover nothing."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Any function of the gram may choose; grams of equal rank are covered together.
    rank = _ranks(data)
    least = _slid(rank, SIDE + 1, np.minimum)  # by window start
    across = (ends[:-1, None] - np.arange(1, LENGTH)).ravel()
    least[across[(across >= 0) & (across < len(least))]] = 0
    padding = np.zeros(SIDE, np.uint32)
    # A gram is covered if it is the least of some window that holds it.
    most = _slid(np.concatenate([padding, least, padding]), SIDE + 1, np.maximum)
    at = np.flatnonzero(most[: len(rank)] == rank)
    words = _words_at(data)
    return at, _joined([words[at + i] for i in range(0, GRAM, 8)]) >> np.uint64(64 - NAME_BITS)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one value after the other, and the edges of the values."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, edges, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(edges, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column of the values between these edges."""
    buffers = [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, buffers)


def _portions(edges: np.ndarray, size: int, rows: int = 1 << GROUP_ROW_BITS) -> Iterator[tuple[int, int]]:
    """The values between these edges in portions of so many bytes and rows at most, of one value at least."""
    start = 0
    while start < len(edges) - 1:
        stop = int(np.searchsorted(edges, edges[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), start + rows)
        yield start, stop
        start = stop


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in groups of bounded size."""
    for batch in batches:
        for start, stop in _portions(_values(batch.column("body"))[1], GROUP_BYTES):
            yield batch.slice(start, stop - start)


def _marked(data: np.ndarray, edges: np.ndarray, chosen=None, cut=None) -> tuple:
    """Covered positions of the documents between these edges: document number, place in it, name, and what ``cut``
    makes of their triples (``_triples``).

    ``chosen`` takes these columns and says which rows to return. Documents are read in pieces that fit a cache."""
    found = []
    for first, last in _portions(edges, PIECE_BYTES):
        piece, inner = data[edges[first] : edges[last]], edges[first : last + 1] - edges[first]
        at, names = covered(piece, inner[1:])
        document = np.searchsorted(inner[1:], at, side="right")
        place = at - inner[document]
        if chosen is not None:
            met = chosen(document + first, place, names)
            at, document, place, names = at[met], document[met], place[met], names[met]
        columns = [document + first, place, names]
        if cut is not None:
            columns.append(cut(_triples(piece, at, place, inner[document + 1] - at)))
        found.append(columns)
    return tuple(np.concatenate(c) for c in zip(*found))


def _triples(data: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Triples as rows of ``TRIPLE`` bytes: how many reach to either side, and the context padded with zeros.

    ``before`` and ``after`` are the bytes of the document before the position and from it on."""
    table = np.zeros((len(at), TRIPLE), np.uint8)
    padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
    if len(at):
        contexts = np.ndarray(len(padded) - CONTEXT + 1, f"V{CONTEXT}", padded, strides=(1,))
        table[:, 2 : CONTEXT + 2] = contexts[at].view(np.uint8).reshape(-1, CONTEXT)
    left, right = np.minimum(before, SIDE), np.minimum(after - GRAM, SIDE)
    table[:, 0], table[:, 1] = left, right
    edge = np.flatnonzero((left < SIDE) | (right < SIDE))
    column = np.arange(CONTEXT)
    outside = (column < (SIDE - left[edge])[:, None]) | (column >= (SIDE + GRAM + right[edge])[:, None])
    table[edge, 2 : CONTEXT + 2] = np.where(outside, 0, table[edge, 2 : CONTEXT + 2])
    return table


def _hashed_triples(table: np.ndarray) -> np.ndarray:
    return _joined(table.view("<u8").T) >> np.uint64(16)


def _together(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows that are equal in these columns are neighbours, and which rows of it differ from the
    one before. Rows are sorted by one hash; should different ones share it, by the columns."""
    hashed = _joined(columns)
    order = np.argsort(hashed)
    differ = _differ(*(c[order] for c in columns))
    if (differ != _differ(hashed[order])).any():
        order = np.lexsort(columns)
        differ = _differ(*(c[order] for c in columns))
    return order, differ


def _differ(*columns: np.ndarray) -> np.ndarray:
    found = np.ones(len(columns[0]), bool)
    found[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return found


def _last(differ: np.ndarray) -> np.ndarray:
    """Which rows are the last of their group."""
    return np.r_[differ[1:], True][: len(differ)]


def _least(values: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The least value of each row's group; groups begin where ``differ``."""
    if not len(values):
        return values
    heads = np.flatnonzero(differ)
    return np.repeat(np.minimum.reduceat(values, heads), np.diff(heads, append=len(values)))


def _in_map(bit_map: bytes | bytearray, bits: int, width: int):
    """Whether the leading bits of numbers of ``width`` bits are set in the map."""
    known, shift = np.frombuffer(bit_map, np.uint8), np.uint64(width - (bits.bit_length() - 1))

    def test(numbers: np.ndarray) -> np.ndarray:
        place = (numbers >> shift).astype(np.int64)
        return (known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    return test


def _gathered(found: DataFrame, bits: int) -> bytearray:
    """A bit map of bounded size from its parts (part, bits), which all tasks make at the same time."""
    whole = bytearray(bits // 8)
    for row in found.collect():
        size = len(row.bits)
        whole[row.part * size : (row.part + 1) * size] = row.bits
    return whole


# 1. names --------------------------------------------------------------------------------


def _blocks(part: np.ndarray, pack) -> list[pa.Array]:
    """One row (part, block) for each part that these sorted numbers hold."""
    first = np.flatnonzero(_differ(part))
    blocks = [pack(a, b) for a, b in zip(first, [*first[1:], len(part)])]
    return [pa.array(part[first], pa.int64()), pa.array(blocks, pa.binary())]


def _name_blocks(parts: int):
    shift = np.uint64(NAME_BITS - (parts.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            document, _, names = _marked(*_values(rows.column("body")))
            both = np.sort((names << np.uint64(GROUP_ROW_BITS)) | document.astype(np.uint64))
            names = both >> np.uint64(GROUP_ROW_BITS)
            differ = _differ(names)
            first, last = np.flatnonzero(differ), np.flatnonzero(_last(differ))
            # The lowest bit says that the name is known to be in several documents.
            names, several = names[first], both[first] != both[last]
            packed = (names << np.uint64(1)) | several.astype(np.uint64)
            raw = packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            found = _blocks((names >> shift).astype(np.int64), lambda a, b: raw[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(found, ["part", "block"])
        release_memory()

    return run


def _by_part(column: str, names: list[str], finish):
    """Gathers the rows of each part, which come one after the other, and yields what ``finish`` makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for rows in batches:
            for part, value in zip(rows.column("part").to_pylist(), rows.column(column).to_pylist()):
                if part != last and last is not None:
                    yield pa.RecordBatch.from_arrays(finish(last, held), names)
                    held = []
                last = part
                held.append(value)
        if last is not None:
            yield pa.RecordBatch.from_arrays(finish(last, held), names)
        release_memory()

    return run


def _bits_of(places: np.ndarray, part: int, per_part: int) -> list[pa.Array]:
    flags = np.zeros(per_part, np.uint8)
    flags[places - part * per_part] = 1
    return [pa.array([part], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())]


def _repeated_bits(parts: int, bits: int):
    def finish(part: int, blocks: list[bytes]) -> list[pa.Array]:
        raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 6)
        packed = np.zeros((len(raw), 8), np.uint8)
        packed[:, :6] = raw
        packed = np.sort(packed.view("<u8").ravel())
        names = packed >> np.uint64(1)
        same = names[1:] == names[:-1]
        repeated = np.concatenate([names[1:][same], names[(packed & np.uint64(1)) == 1]])
        return _bits_of((repeated >> np.uint64(NAME_BITS - (bits.bit_length() - 1))).astype(np.int64), part, bits // parts)

    return _by_part("block", ["part", "bits"], finish)


def _power_of_two(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def _sizes(total: int) -> tuple[int, int]:
    """Bits of a map and number of parts for so many bytes of text."""
    bits = min(max(_power_of_two(total // 8), 1 << 16), MOST_FILTER_BITS)
    return bits, min(_power_of_two(max(8, total // PART_BYTES)), bits // 8)


def repeated_names(rows: DataFrame, bits: int, parts: int) -> bytearray:
    """A bit map over the leading bits of names: set where a name is in several documents."""
    blocks = rows.select("body").mapInArrow(_name_blocks(parts), "part bigint, block binary")
    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part")
    return _gathered(dealt.mapInArrow(_repeated_bits(parts, bits), "part bigint, bits binary"), bits)


# 2. triples ------------------------------------------------------------------------------

#: Blocks of owners by document, and (``spots`` true) of the numbers of their places.
OWNERS = "spots boolean, part bigint, block binary"


def _document(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return _mixed(key.astype(np.uint64) * _M1 + mark.astype(np.uint64))


def spots(key: np.ndarray, mark: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number of 63 bits for each place of each document."""
    return _mixed(_document(key, mark) + place.astype(np.uint64) * _M2) >> np.uint64(1)


def _named(chosen):
    return lambda document, place, names: chosen(names)


def _packed(columns: list[np.ndarray], compress):
    """Rows from a to b of these columns as one block. Bytes of equal weight lie together, so that small numbers shrink."""
    return lambda a, b: compress(b"".join(x[a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for x in columns))


def _triple_blocks(shared, bits: int, parts: int):
    """The triples with repeated names of each group of documents, of equal ones those of the smallest key."""
    shift = np.uint64(NAME_BITS - (parts.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        chosen = _named(_in_map(shared.value, bits, NAME_BITS))
        for rows in _groups(batches):
            document, place, name, triple = _marked(*_values(rows.column("body")), chosen, _hashed_triples)
            key = rows.column("key").to_numpy()[document]
            order, differ = _together(name, triple)
            keep = order[key[order] == _least(key[order], differ)]
            keep = keep[np.argsort(name[keep])]
            mark = rows.column("mark").to_numpy()[document[keep]]
            name, triple, key, place = name[keep], triple[keep], key[keep], place[keep]
            part = (name >> shift).astype(np.int64)
            steps = np.diff(name, prepend=np.uint64(0))
            steps[_differ(part)] = name[_differ(part)]
            narrow = np.ascontiguousarray(triple.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            columns = [steps.astype("<u8"), narrow, key.astype("<i8"), mark.astype("<i4"), place.astype("<i4")]
            yield pa.RecordBatch.from_arrays(_blocks(part, _packed(columns, compress)), ["part", "block"])
        release_memory()

    return run


TRIPLE_COLUMNS = ((8, "<u8"), (6, "<u8"), (8, "<i8"), (4, "<i4"), (4, "<i4"))
OWNER_COLUMNS = ((8, "<i8"), (4, "<i4"), (4, "<i4"))


def _unpacked(blocks: list[bytes], kinds, stepped: bool = False) -> list[np.ndarray]:
    """The columns of several blocks, joined; if ``stepped``, the first holds the steps from row to row."""
    unpack, found = zstandard.ZstdDecompressor().decompress, []
    for block in blocks:
        raw = np.frombuffer(unpack(block), np.uint8)
        rows = len(raw) // sum(width for width, _ in kinds)
        columns, at = [], 0
        for width, kind in kinds:
            column = np.zeros((rows, np.dtype(kind).itemsize), np.uint8)
            column[:, :width] = raw[at : at + width * rows].reshape(width, rows).T
            columns.append(column.view(kind).ravel())
            at += width * rows
        if stepped:
            columns[0] = np.cumsum(columns[0], dtype=np.uint64)
        found.append(columns)
    return [np.concatenate(c) for c in zip(*found)]


def _of_several(name: np.ndarray) -> np.ndarray:
    """Which of these names are there more than once."""
    order = np.argsort(name)
    differ = _differ(name[order])
    found = np.empty(len(name), bool)
    found[order] = ~(differ & _last(differ))
    return found


def _find_owners(parts: int, folders: int):
    spot_shift, folder_shift = (np.uint64(63 - (parts.bit_length() - 1)), np.uint64(64 - (folders.bit_length() - 1)))

    def finish(_, blocks: list[bytes]) -> list[pa.Array]:
        name, triple, key, mark, place = _unpacked(blocks, TRIPLE_COLUMNS, stepped=True)
        order, differ = _together(name, triple)
        keep = key[order] == _least(key[order], differ)
        # A name with several triples: their windows have to be compared.
        heads = np.flatnonzero(differ)
        several = np.repeat(_of_several(name[order[heads]]), np.diff(heads, append=len(order)))[keep]
        key, mark, place = (x[order[keep]] for x in (key, mark, place))
        asked = np.sort(spots(key[several], mark[several], place[several])).astype("<u8")
        spot_blocks = _blocks((asked >> spot_shift).astype(np.int64), lambda a, b: asked[a:b].tobytes())
        document = _document(key, mark)
        order = np.argsort(document)
        columns = [x[order] for x in (key, mark, place)]
        folder = (document[order] >> folder_shift).astype(np.int64)
        owner_blocks = _blocks(folder, _packed(columns, zstandard.ZstdCompressor(level=1).compress))
        kind = np.repeat([True, False], [len(spot_blocks[0]), len(owner_blocks[0])])
        return [pa.array(kind), *(pa.concat_arrays(x) for x in zip(spot_blocks, owner_blocks))]

    return finish


def triple_owners(rows: DataFrame, shared, bits: int, parts: int) -> DataFrame:
    """The places of triples in the smallest document that has them, in blocks by document: key, mark, place. Of names
    that have other triples too the numbers ``spots`` of these places as well."""
    blocks = rows.mapInArrow(_triple_blocks(shared, bits, parts), "part bigint, block binary")
    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_by_part("block", ["spots", "part", "block"], _find_owners(parts, parts)), OWNERS)


def _spot_bits(parts: int, bits: int):
    shift = np.uint64(63 - (bits.bit_length() - 1))

    def finish(part: int, blocks: list[bytes]) -> list[pa.Array]:
        found = np.frombuffer(b"".join(blocks), "<u8")
        return _bits_of((found >> shift).astype(np.int64), part, bits // parts)

    return _by_part("block", ["part", "bits"], finish)


def _dealt(owners: DataFrame, kind: str, parts: int) -> DataFrame:
    return owners.where(kind).select("part", "block").repartition(parts, "part").sortWithinPartitions("part")


def spot_map(owners: DataFrame, bits: int, parts: int) -> bytearray:
    """A bit map over the leading bits of the spots."""
    dealt = _dealt(owners, "spots", parts)
    return _gathered(dealt.mapInArrow(_spot_bits(parts, bits), "part bigint, bits binary"), bits)


def _owned(_, blocks: list[bytes]) -> list[pa.Array]:
    key, mark, place = _unpacked(blocks, OWNER_COLUMNS)
    order, differ = _together(key, mark)
    first = np.flatnonzero(differ)
    edges = np.append(first, len(order)) * 4
    places = _binary(place[order].astype("<i4").view(np.uint8), edges)
    return [pa.array(key[order[first]]), pa.array(mark[order[first]]), places]


def owned_places(owners: DataFrame, parts: int) -> DataFrame:
    """One row per document that owns triples: order, mark, places."""
    fields = ["order", "mark", "places"]
    return _dealt(owners, "not spots", parts).mapInArrow(_by_part("block", fields, _owned), "order bigint, mark int, places binary")


# 3. and 4. remaining suffixes, adjacent prefixes -------------------------------------------

CONTEXTS = "name bigint, key bigint, mark int, place int, triple binary"
LOST = "key bigint, mark int, place int, starts int, triple binary"


def _contexts(names, marked_spots, bits: int):
    """The triples whose windows have to be compared, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, asked = _in_map(names.value, bits, NAME_BITS), _in_map(marked_spots.value, bits, 63)
        for rows in _groups(batches):
            key, mark = rows.column("key").to_numpy(), rows.column("mark").to_numpy()

            def chosen(document, place, name):
                met = np.flatnonzero(named(name))
                document, place = document[met], place[met]
                return met[asked(spots(key[document], mark[document], place))]

            document, place, name, table = _marked(*_values(rows.column("body")), chosen, lambda table: table)
            for first in range(0, len(name), TRIPLES_AT_ONCE):
                some = slice(first, first + TRIPLES_AT_ONCE)
                numbers = [name[some].astype(np.int64), key[document[some]], mark[document[some]], place[some].astype(np.int32)]
                triples = _binary(table[some].ravel(), np.arange(len(numbers[0]) + 1) * TRIPLE)
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), triples], ["name", "key", "mark", "place", "triple"])
        release_memory()

    return run


def _valid(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the window starts round a gram lie inside the document, per triple."""
    start = np.arange(STARTS)
    return (start >= (SIDE - left)[:, None]) & (start <= right[:, None])


def _as_bits(flags: np.ndarray) -> np.ndarray:
    return (flags.astype(np.int64) << np.arange(STARTS)).sum(axis=1).astype(np.int32)


def _beaten(group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose group has a smaller owner, and for each of them a row of the group with the smallest."""
    order = np.argsort(group)
    differ, by_group = _differ(group[order]), owner[order]
    least = _least(by_group, differ)
    smallest = np.flatnonzero(by_group == least)
    heads = np.flatnonzero(differ)
    leader = np.repeat(smallest[np.searchsorted(smallest, heads)], np.diff(heads, append=len(order)))
    lost = by_group != least
    return order[lost], order[leader[lost]]


def met_before(name: np.ndarray, table: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For triples (rows of ``table``) and window starts: whether a triple of the same name in a smaller
    document has the same window."""
    valid = _valid(table[:, 0].astype(np.int64), table[:, 1].astype(np.int64))
    words = _words(table[:, 2 : CONTEXT + 2])
    offsets = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    row, start = np.nonzero(valid)
    name = name.astype(np.uint64)
    hashed = _hash(words, offsets, STARTS)
    hashed += _mixed(name * _M1)[:, None]
    hashed += np.arange(STARTS, dtype=np.uint64) * _M2
    lost, before = _beaten(hashed[row, start], owner[row])
    columns = lambda at: [name[row[at]], start[at], *(words[row[at], start[at] + x] for x in offsets)]
    if any((a != b).any() for a, b in zip(columns(lost), columns(before))):
        # Different windows share a hash: all are told apart by what they are.
        whole = columns(slice(None))
        order = np.lexsort(whole)
        group = np.empty(len(row), np.int64)
        group[order] = np.cumsum(_differ(*(c[order] for c in whole)))
        lost, before = _beaten(group, owner[row])
    found = np.zeros(valid.shape, bool)
    found[row[lost], start[lost]] = True
    return found


def _losses(rows: pa.RecordBatch, deferred: bool) -> pa.RecordBatch:
    """What documents lose, from rows that hold all triples of their names; if ``deferred``, the rows as they are."""
    key, mark, place = (rows.column(c) for c in ("key", "mark", "place"))
    if deferred:
        columns = [key, mark, place, pa.nulls(len(key), pa.int32()), rows.column("triple")]
        return pa.RecordBatch.from_arrays(columns, ["key", "mark", "place", "starts", "triple"])
    table = _values(rows.column("triple"))[0].reshape(-1, TRIPLE)
    starts = _as_bits(met_before(rows.column("name").to_numpy(), table, key.to_numpy()))
    take = np.flatnonzero(starts)
    columns = [key.take(pa.array(take)), mark.take(pa.array(take)), place.take(pa.array(take)), pa.array(starts[take])]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(take), pa.binary())], ["key", "mark", "place", "starts", "triple"])


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, deferred = None, None  # rows of the last name; the name that is too large, if any
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([rest, batch]) if rest is not None else batch
            names = rows.column("name").to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            done, rest = rows.slice(0, cut), rows.slice(cut)
            if deferred is not None and cut:
                end = int(np.searchsorted(names[:cut], deferred, side="right"))
                yield _losses(done.slice(0, end), True)
                done, deferred = done.slice(end), None
            if done.num_rows:
                yield _losses(done, False)
            if rest.num_rows > most or deferred is not None:
                deferred = int(names[-1])
                yield _losses(rest, True)
                rest = None
        if rest is not None and rest.num_rows:
            yield _losses(rest, False)

    return run


def _deferred_losses(waiting: DataFrame) -> DataFrame:
    """The same comparison for names with very many triples: windows are grouped by Spark."""
    byte = lambda at: F.conv(F.hex(F.substring("triple", at, 1)), 16, 10).cast("int")
    start = F.explode(F.sequence(SIDE - byte(1), byte(2))).alias("start")
    # A document shorter than a window has no triples, so each of them holds a window.
    windows = waiting.select("key", "mark", "place", "triple", start)
    window = F.substring("triple", F.col("start") + 3, F.lit(LENGTH))
    windows = written(windows.select("key", "mark", "place", "start", F.concat(F.col("start").cast("string").cast("binary"), window).alias("window")))
    least = windows.groupBy("window").agg(F.min("key").alias("least"), F.count("*").alias("size")).where("size > 1")
    met = with_group(windows, written(least), "window").where("least < key")
    return met.select("key", "mark", "place", F.expr("shiftleft(1, start)").alias("starts"))


# documents -------------------------------------------------------------------------------


RESULT = "key {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What these stretches cover together, as runs that do not touch."""
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > end[:-1]
    return begin[fresh], end[_last(fresh)]


def _lost(data: np.ndarray, edges: np.ndarray, chosen, owned: tuple, met: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the documents between these edges lose: document, and where in ``data`` each removed run begins and ends.

    ``owned`` has document and place of the triples that a document owns, ``met`` document, place and window starts
    that it loses of those."""
    size = np.diff(edges)
    document, place, _ = _marked(data, edges, chosen)
    # A covered place with a repeated name is its owner's or lost.
    mine = np.zeros(len(data), bool)
    inside = owned[1] < size[owned[0]]
    mine[edges[owned[0][inside]] + owned[1][inside]] = True
    lost = ~mine[edges[document] + place]
    document, place = document[lost], place[lost]
    begin, end = np.maximum(place - SIDE, 0), np.minimum(place, size[document] - LENGTH) + LENGTH
    row, start = np.nonzero((met[2][:, None] >> np.arange(STARTS)) & 1)
    late = met[1][row] - SIDE + start
    document = np.concatenate([document, met[0][row]])
    # A gap after each document keeps the runs of neighbours apart.
    shift = edges[document] + document
    begin, end = _runs(np.concatenate([begin, late]) + shift, np.concatenate([end, late + LENGTH]) + shift)
    document = np.searchsorted(edges[:-1] + np.arange(len(size)), begin, side="right") - 1
    return document, begin - document, end - document


def _remove(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        chosen = _named(_in_map(shared.value, bits, NAME_BITS))
        for batch in batches:
            for first, last in _portions(_values(batch.column("packed"))[1], PACKED_BYTES):
                rows = batch.slice(first, last - first)
                bodies = [unpack(p) for p in rows.column("packed").to_pylist()]
                edges = np.cumsum([0, *map(len, bodies)])
                data = np.frombuffer(b"".join(bodies), np.uint8) if edges[-1] else np.zeros(0, np.uint8)
                numbers = np.arange(len(bodies))
                places, told = _values(rows.column("places"))
                owned = (np.repeat(numbers, np.diff(told) // 4), places.copy().view("<i4").astype(np.int64))
                met = rows.column("met")
                told = pc.fill_null(pc.list_value_length(met), 0).to_numpy()
                at, starts = (met.flatten().field(n).to_numpy().astype(np.int64) for n in ("place", "starts"))
                document, begin, end = _lost(data, edges, chosen, owned, (np.repeat(numbers, told), at, starts))
                gone = np.zeros(len(data) + 1, np.int8)
                gone[begin] += 1
                gone[end] -= 1
                kept = data[np.cumsum(gone[:-1], dtype=np.int8) == 0]
                removed = np.r_[0, np.cumsum(np.bincount(document, end - begin, len(bodies)).astype(np.int64))]
                pairs = pa.StructArray.from_arrays([pa.array(x - edges[document]) for x in (begin, end)], ["start", "end"])
                counts = np.r_[0, np.cumsum(np.bincount(document, minlength=len(bodies)))]
                spans = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs)
                columns = [rows.column("key"), pa.array(np.diff(edges)), spans, _binary(kept, edges - removed)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "spans", "kept"])
        release_memory()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [packer.compress(b) for b in batch.column("body").to_pylist()]
        columns = [batch.column(c) for c in ("key", "order", "mark")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], ["key", "order", "mark", "packed"])


def without_repeated_strings(documents: DataFrame, key: str = "doc_id", text: str = "text", most_triples: int = MOST_TRIPLES) -> DataFrame:
    """One row per document: key, n_bytes, spans (maximal removed runs of bytes), kept (the remaining bytes)."""
    spark: SparkSession = documents.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY))
    sizes = documents.select(order.alias("order"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).alias("size"))
    per_key = sizes.groupBy("order").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    counts = per_key.agg(F.max("rows").alias("most"), F.sum("size").alias("total")).first()
    # Rows that share a key are told apart by their text; else the mark is constant and costs nothing.
    mark = F.xxhash64(F.col(key), F.col(text)).bitwiseAND(F.lit(0x7FFFFFFF)) if (counts.most or 0) > 1 else F.lit(0)
    rows = documents.select(F.col(key).alias("key"), order.alias("order"), mark.cast("int").alias("mark"), body.alias("body"))
    kind = dict(rows.dtypes)["key"]
    bits, parts = _sizes(counts.total or 0)
    context = spark.sparkContext
    names = context.broadcast(repeated_names(rows, bits, parts))
    numbered = rows.select(F.col("order").alias("key"), "mark", "body")
    owners = written(triple_owners(numbered, names, bits, parts))
    asked = context.broadcast(spot_map(owners, bits, parts))
    contexts = numbered.mapInArrow(_contexts(names, asked, bits), CONTEXTS).repartition("name").sortWithinPartitions("name")
    lost = written(contexts.mapInArrow(_compare(most_triples), LOST))
    late = _deferred_losses(lost.where("triple is not null"))
    part = lost.where("triple is null").drop("triple").unionByName(late)
    by_document = part.groupBy(F.col("key").alias("order"), "mark").agg(F.collect_list(F.struct("place", "starts")).alias("met"))
    packed = rows.mapInArrow(_pack, f"key {kind}, order bigint, mark int, packed binary")
    same = ["order", "mark"]
    joined = packed.join(owned_places(owners, parts), same, "left").join(by_document, same, "left").select("key", "packed", "places", "met")
    return joined.mapInArrow(_remove(names, bits), RESULT.format(kind=kind))
