"""SentencePiece encoding by forward filtering and backward sampling, and its exact inverse.

The pieces of a given model span a lattice over a text. Forward filtering sums, for every position, the
weights of all ways to reach it; backward sampling then walks from the end to the start and draws
each piece with the share of the sum that goes through it, so whole segmentations are drawn from
their joint distribution. The draws of a row come from a generator that is seeded by the row's key
only: the same row gets the same pieces in every run and on any number of executors.

A piece weighs p ** ``sharpness``; p is the model's probability or, for models whose scores are merge ranks,
1 / (2 + rank), Zipf's law. Text is taken as it is: no dummy prefix, no normalisation. A blank stands for
the model's space mark, while a space mark in the text itself, like every character without a piece,
is spelt in byte pieces. So decoding gives back each text exactly.

No piece reaches over the start of a word (a run of blanks and what follows it), so the lattice falls
apart into words. A worker remembers the filtered lattices of words it has met, up to a bound; the new words of a group of rows are
filtered together, and all its words are sampled together, one piece a step. A word's lattice does not depend on the
words beside it, so what a worker remembers changes no result. Whole texts are encoded; a word may be of any length.

Defined cases: a null text has null ids and decodes to null, an empty one has none; a null key seeds like
the word "null"; rows that repeat a key and text get the same ids; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import release_memory

SHARPNESS = 0.5
SEED = 20_240_229
SPACE_MARK = "▁"
WORD = re.compile(" *[^ ]+| +")
CHUNK_CHARACTERS = 500_000
ROWS_AT_ONCE = 1000
#: Ways (pieces between two places) of the lattices that a worker remembers, 16 bytes each.
MOST_WAYS = 2_500_000

class Vocabulary:
    """Pieces of a model file as a trie with log weights, and what each id decodes to."""

    def __init__(self, model_file: str, sharpness: float = SHARPNESS):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        scores = [model.get_score(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        by_rank = all(scores[i] <= 0 and scores[i] == int(scores[i]) for i in plain)
        weigh = (lambda s: -math.log(2 - s)) if by_rank else (lambda s: s)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.spelling = np.zeros(256, np.int32)
        self.meaning = [b""] * size
        spelt = 0
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:-1], 16)
                self.spelling[value] = i
                self.meaning[i] = bytes([value])
                spelt += 1
        if spelt < 256:
            raise ValueError("lossless encoding needs a model with byte pieces")
        for i in plain:
            raw = model.id_to_piece(i).replace(SPACE_MARK, " ")
            self.meaning[i] = raw.encode()
            if WORD.fullmatch(raw):  # else it would reach over the start of a word
                self.pieces[raw] = sharpness * weigh(scores[i]), i
        self.byte_weight = min(weight for weight, _ in self.pieces.values()) - math.log(256)
        self._build_trie()
        self.known = KnownWords(self)

    def _build_trie(self) -> None:
        nodes, edges = {"": 0}, {}
        for piece in self.pieces:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in nodes:
                    nodes[piece[:end]] = len(nodes)
                    edges[nodes[piece[: end - 1]] << 21 | ord(piece[end - 1])] = nodes[piece[:end]]
        self.edge = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[e] for e in self.edge.tolist()], np.int64)
        self.node_id = np.full(len(nodes), -1, np.int32)
        self.node_weight = np.zeros(len(nodes))
        for piece, (weight, number) in self.pieces.items():
            self.node_id[nodes[piece]] = number
            self.node_weight[nodes[piece]] = weight


class Lattice:
    """The lattices of distinct words side by side, filtered forward.

    Positions of all words are numbered on: word w begins at ``begin[w]`` and ends at ``end[w]``. The ways into
    a position lie together in ``start`` (where the piece starts) and ``piece`` (its id, or minus one minus the
    character for one that is spelt in bytes); ``bound`` holds position * 2**33 plus the cumulative share in units of
    2**-32, as integers, so that a draw does not depend on which words lie beside each other.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(text)) + word  # position before each character
        starts, ends, ids, weights = [], [], [], []
        single = np.zeros(len(text), bool)
        at, node, offset = np.arange(len(text)), np.zeros(len(text), np.int64), 0
        while len(at):  # all substrings that begin some piece, longer by one character each time
            key = node << 21 | text[at + offset]
            found = np.minimum(np.searchsorted(vocabulary.edge, key), len(vocabulary.edge) - 1)
            hit = vocabulary.edge[found] == key
            at, node = at[hit], vocabulary.child[found[hit]]
            number = vocabulary.node_id[node]
            whole = number >= 0
            starts.append(place[at[whole]])
            ends.append(place[at[whole]] + offset + 1)
            ids.append(number[whole])
            weights.append(vocabulary.node_weight[node[whole]])
            if offset == 0:
                single[at[whole]] = True
            offset += 1
            on = place[at] + offset < self.end[word[at]]
            at, node = at[on], node[on]
        alone = np.flatnonzero(~single)
        code = text[alone]
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        start = np.concatenate([*starts, place[alone]])
        end = np.concatenate([*ends, place[alone] + 1])
        piece = np.concatenate([*ids, -1 - code])
        weight = np.concatenate([*weights, n_bytes * vocabulary.byte_weight])
        # No piece is longer than the search went, so one number orders by end, then by start.
        order = np.argsort(end * (offset + 1) + start - end + offset)
        self.start, self.piece = start[order], piece[order]
        self._filter(end[order], weight[order])

    def _filter(self, end: np.ndarray, weight: np.ndarray) -> None:
        """Sums of all ways to each position, position by position for all words at once."""
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]][: len(end)])
        position, count = end[first], np.diff(np.r_[first, len(end)])
        total = np.zeros(int(self.end[-1]) + 1 if len(self.end) else 0)
        depth = position - self.begin[np.searchsorted(self.end, position)]
        share = np.zeros(len(end))
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(depth[by_depth]) > 0, True]) if len(depth) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            group = by_depth[a:b]
            counts = count[group]
            heads = np.cumsum(counts) - counts
            rows = np.repeat(first[group] - heads, counts) + np.arange(counts.sum())
            logs = total[self.start[rows]] + weight[rows]
            top = np.maximum.reduceat(logs, heads)
            parts = np.exp(logs - np.repeat(top, counts))
            sums = np.add.reduceat(parts, heads)
            total[position[group]] = top + np.log(sums)
            share[rows] = parts / np.repeat(sums, counts)
        rank = np.arange(len(end)) - np.repeat(first, count)
        for n in range(1, int(count.max()) if len(count) else 0):
            rows = np.flatnonzero(rank == n)
            share[rows] += share[rows - 1]
        bound = (np.minimum(share, 1.0) * 2.0**32).astype(np.int64)
        bound[first + count - 1] = 1 << 32
        self.bound = (end << 33) + bound


class KnownWords:
    """Filtered lattices of many words behind each other, added to as words come."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.number: dict[str, int] = {}
        self.begin, self.end, self.ways = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        self.start, self.piece, self.bound = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64)
        self.first = np.empty(0, np.int32)  # per position its first way
        self.used = np.empty(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; new ones are filtered first."""
        if len(self.bound) > MOST_WAYS:
            self._forget()
        found = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(found < 0).tolist()
        if unknown:
            self._add(list(dict.fromkeys(words[k] for k in unknown)))
            found[unknown] = [self.number[words[k]] for k in unknown]
        self.used += np.bincount(found, minlength=len(self.used))
        return found

    def _add(self, words: list[str]) -> None:
        new = Lattice(words, self.vocabulary)
        shift = int(self.end[-1]) + 1 if len(self.end) else 0
        ways = np.searchsorted(new.bound >> 33, new.end, side="right")
        self.first = np.append(self.first, self._firsts(new.bound, int(new.end[-1]) + 1) + np.int32(len(self.bound)))
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.begin, self.end = np.append(self.begin, new.begin + shift), np.append(self.end, new.end + shift)
        self.ways = np.append(self.ways, self.ways[-1] + ways)
        self.start = np.append(self.start, (new.start + shift).astype(np.int32))
        self.piece = np.append(self.piece, new.piece.astype(np.int32))
        self.bound = np.append(self.bound, new.bound + (shift << 33))
        self.used = np.append(self.used, np.zeros(len(words), np.int64))

    @staticmethod
    def _firsts(bound: np.ndarray, positions: int) -> np.ndarray:
        return np.searchsorted(bound >> 33, np.arange(positions)).astype(np.int32)

    def drawn(self, at: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """For each position the way into it whose share of the sum a draw of 32 bits falls in."""
        way, key = self.first[at], (at << 33) + draw
        below = np.arange(len(at))
        while len(below):
            below = below[self.bound[way[below]] <= key[below]]
            way[below] += 1
        return way

    def _forget(self) -> None:
        """Keep the words that were used most, up to half of the ways."""
        order = np.argsort(-self.used, kind="stable")
        sizes = np.diff(self.ways)
        keep = np.sort(order[sizes[order].cumsum() <= MOST_WAYS // 2])
        words = list(self.number)  # in the order of their numbers
        self.number = {words[k]: n for n, k in enumerate(keep.tolist())}
        sizes, lengths = sizes[keep], (self.end - self.begin)[keep]
        rows = np.repeat(self.ways[keep] - sizes.cumsum() + sizes, sizes) + np.arange(sizes.sum())
        end = (lengths + 1).cumsum() - 1
        moved = end - lengths - self.begin[keep]
        shift = np.repeat(moved, sizes)
        self.start, self.piece = (self.start[rows] + shift).astype(np.int32), self.piece[rows]
        self.bound = self.bound[rows] + (shift << 33)
        self.begin, self.end, self.ways = end - lengths, end, np.r_[0, sizes.cumsum()]
        self.first = self._firsts(self.bound, int(end[-1]) + 1 if len(end) else 0)
        self.used = np.zeros(len(keep), np.int64)


@functools.lru_cache(maxsize=1)
def vocabulary_of(model_file: str, sharpness: float) -> Vocabulary:
    """One a worker, which serves its later tasks as well."""
    return Vocabulary(model_file, sharpness)


@functools.lru_cache(maxsize=1)
def meanings_of(model_file: str) -> np.ndarray:
    """What each id decodes to."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    hidden = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    spelt = lambda i, name: bytes([int(name[3:-1], 16)]) if model.is_byte(i) else name.replace(SPACE_MARK, " ").encode()
    return np.array([b"" if hidden(i) else spelt(i, name) for i, name in enumerate(names)], dtype=object)


_STEP, _PLACE = 0x9E3779B97F4A7C15, np.uint64(0xD1342543DE82EF95)


def draws(seed: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """32 random bits for each word of a row and step of its segmentation, from these numbers alone."""
    h = seed + place.astype(np.uint64) * _PLACE + np.uint64((step + 1) * _STEP % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(32)).astype(np.int64)


def sampled(texts: list[str], seeds: list[int], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one sampled segmentation of each text, one after the other, and how many each has."""
    parts = [WORD.findall(t) for t in texts]
    per_text = np.array([len(part) for part in parts], np.int64)
    if not per_text.sum():
        return np.zeros(0, np.int32), per_text
    lattice = vocabulary.known
    words = lattice.numbers(list(itertools.chain.from_iterable(parts)))
    text = np.repeat(np.arange(len(texts)), per_text)
    seed = np.array(seeds, np.uint64)[text]
    place = np.arange(len(words)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    # Backward sampling: one piece less for every word that is not yet at its start.
    open_words, at, stop = np.arange(len(words)), lattice.end[words], lattice.begin[words]
    taken, length = [], np.zeros(len(words), np.int64)
    while len(open_words):
        drawn = draws(seed[open_words], place[open_words], len(taken))
        way = lattice.drawn(at, drawn)
        taken.append((open_words, way))
        length[open_words] += 1
        at = lattice.start[way].astype(np.int64)
        going = at > stop[open_words]
        open_words, at = open_words[going], at[going]
    after = np.cumsum(length)
    piece = np.zeros(int(after[-1]), np.int64)
    for step, (word, way) in enumerate(taken):
        piece[after[word] - 1 - step] = lattice.piece[way]
    owner = np.repeat(text, length)
    spelt = np.flatnonzero(piece < 0)
    if not len(spelt):
        return piece.astype(np.int32), np.bincount(owner, minlength=len(texts))
    spellings = [vocabulary.spelling[list(chr(-1 - c).encode())] for c in piece[spelt].tolist()]
    width = np.ones(len(piece), np.int64)
    width[spelt] = [len(x) for x in spellings]
    ids = np.repeat(piece, width).astype(np.int32)
    ids[np.repeat(piece < 0, width)] = np.concatenate(spellings)
    return ids, np.bincount(np.repeat(owner, width), minlength=len(texts))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Rows in groups of bounded length."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > CHUNK_CHARACTERS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"null" if key is None else str(key).encode(), seed)


def encoded(documents: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """One row per document: key, text, ids."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model_file, sharpness)
        for whole in _slices(batches):
            texts = whole.column("text").to_pylist()
            seeds = [row_seed(k, seed) for k in whole.column("key").to_pylist()]
            for a, b in _chunks(texts):
                batch = whole.slice(a, b - a)
                ids, counts = sampled([t or "" for t in texts[a:b]], seeds[a:b], vocabulary)
                missing = pa.array([t is None for t in texts[a:b]])
                ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()), mask=missing)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text"), lists], ["key", "text", "ids"])

    return rows.mapInArrow(encode, f"key {dict(rows.dtypes)['key']}, text string, ids array<int>")


def decoded(rows: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """The rows with the text that ``ids`` stand for in a last column ``decoded``."""
    fields = [c for c in rows.columns if c != "decoded"]
    kept = rows.select(*fields)
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in kept.dtypes), "decoded string"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers change roles from task to task; one that decodes needs no lattices.
        vocabulary_of.cache_clear()
        release_memory()
        meaning = meanings_of(model_file)
        for batch in _slices(batches):
            lists = batch.column(ids)
            texts = [b"".join(meaning[x.values.to_numpy()]).decode() if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*fields, "decoded"])

    return kept.mapInArrow(decode, schema)
