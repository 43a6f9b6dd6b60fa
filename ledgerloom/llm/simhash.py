"""Near duplicates by SimHash fingerprints, found in BK-trees.

A fingerprint has a bit set where more than half of the text's word shingles have it set in their XXH64.
Two fingerprints are linked when they differ in at most ``RADIUS`` bits; documents of one connected
component are one group.

Distinct fingerprints are dealt to shards so that any two that may be linked share one: of
four blocks of 16 bits two are equal, so a fingerprint belongs to six shards by pairs of blocks. A shard
of more than ``TREE`` fingerprints is divided again in the same way by pairs of bytes of the other two
blocks; what is left has at most 65,536 members by construction and is cut into several trees
that each member visits. In a task each shard is a BK-tree: children are keyed by their Hamming
distance to the parent, and a search follows only edges within the radius. A task sends out a
spanning forest of the links it finds, never all pairs. The trees are not sent through the driver: that
would gather the fingerprints of all documents there.

``similar_texts`` links texts by their fingerprints in the same way, and also links those whose sets of shingles are similar by 0.8 or
more, most of which a radius of two bits would miss; a group is what both kinds of links join. For the second kind a text belongs
to shards by pairs of its smallest shingle hashes under several
permutations, and the trees are searched with a wide radius by fingerprints of the distinct shingles. Of what they find, pairs whose sketches of ``SKETCH``
permutations may belong to similar texts are confirmed by the whole sets; only texts in such a pair
are hashed again, and only they travel with their sets.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; null keys sort after all others, so a component has a null
id only if all its keys are null; repeated rows have one fingerprint; an empty table gives an empty
result; other columns are ignored; very long texts are counted in pieces of bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, with_group, written

RADIUS = 2
SHINGLE = 3
SEED = 42
TREE = 2048
PIECE = 1 << 13


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, in pieces of bounded size."""
    words = text.lower().split() if text else []  # bytes know ASCII letters and spaces only
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), PIECE):
        cuts = zip(starts[i : i + PIECE].tolist(), ends[i : i + PIECE].tolist())
        yield np.array([digest(line[a:b], SEED) for a, b in cuts], np.uint64)


def majority(pieces: list[np.ndarray] | Iterator[np.ndarray]) -> int:
    """The signed 64-bit number whose bits are those set in over half the hashes."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in pieces:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text in UTF-8."""
    return majority(shingle_hashes(text, shingle))


class BKTree:
    """Distinct fingerprints; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while node != new:
            distance = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(distance, new)

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes within the radius."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            children = self.children[node]
            if children:
                todo += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]


def shard_links(inside: list[int], visitors: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the members of a tree, and of visitors to them."""
    tree = BKTree()
    for value in inside:
        tree.add(value)
    values = inside + visitors
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(value, values[root(i)]) for i, value in enumerate(values) if root(i) != i]


def _links(radius: int):
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after the other; the last one of a batch may go on in the next."""
        last, inside, visitors, mask = None, [], [], (1 << 64) - 1

        def done():
            found = shard_links(inside, visitors, radius) if len(inside) + len(visitors) > 1 else []
            # Unsigned while distances are counted, signed outside.
            signed = lambda v: v - (1 << 64) if v >> 63 else v
            return [signed(a) for a, _ in found], [signed(b) for _, b in found]

        for batch in batches:
            a, b = [], []
            columns = (batch.column(c).to_pylist() for c in ("shard", "cut", "member", "fp"))
            for shard, cut, member, fp in zip(*columns):
                if (shard, cut) != last:
                    x, y = done()
                    a, b = a + x, b + y
                    last, inside, visitors = (shard, cut), [], []
                (inside if member else visitors).append(fp & mask)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)
        x, y = done()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names)

    return run


def _bits(value: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << width) - 1))


def _outer_keys(fp: Column) -> Column:
    """One shard key per pair of 16-bit blocks. Keys are hashes; if two shards share one, their trees
    are one, which links no more, as distances are compared anyway."""
    pairs = enumerate(combinations(range(4), 2))
    return F.array(*[F.xxhash64(F.lit(n), _bits(fp, 16 * i, 16), _bits(fp, 16 * j, 16)) for n, (i, j) in pairs])


def _inner_keys(fp: Column, number: Column, shard: Column) -> Column:
    """Keys inside a shard: pairs of bytes of the two 16-bit blocks that the shard leaves open."""
    options = F.lit(None)
    for n, taken in enumerate(combinations(range(4), 2)):
        open_bytes = [2 * b + h for b in range(4) if b not in taken for h in (0, 1)]
        keys = [F.xxhash64(shard, F.lit(m), _bits(fp, 8 * i, 8), _bits(fp, 8 * j, 8)) for m, (i, j) in enumerate(combinations(open_bytes, 2))]
        options = F.when(number == n, F.array(*keys)).otherwise(options)
    return options


def _sized(rows: DataFrame, tree: int) -> tuple[DataFrame, DataFrame]:
    """Rows of shards that fit a tree, and rows of larger shards with the number ``cuts`` of trees."""
    large = written(rows.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > tree))
    fits = rows.join(large, "shard", "left_anti")
    return fits, with_group(rows, large, "shard").withColumn("cuts", F.ceil(F.col("size") / tree).cast("int")).drop("size")


def link_fingerprints(found: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b): a spanning forest for every shard, over distinct fingerprints ``fp``."""
    if radius > 2:
        raise ValueError("two of four blocks are equal only up to two differing bits")
    outer = F.posexplode(_outer_keys(F.col("fp"))).alias("number", "shard")
    fits, large = _sized(written(found.select("fp", outer)), tree)
    inner = F.explode(_inner_keys(F.col("fp"), F.col("number"), F.col("shard"))).alias("shard")
    fits_inner, larger = _sized(written(large.select("fp", inner)), tree)
    one = lambda rows: rows.select("shard", F.lit(0).alias("cut"), F.lit(True).alias("member"), "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    many = larger.select("shard", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    many = many.select("shard", "cut", (F.col("cut") == F.col("own")).alias("member"), "fp")
    dealt = one(fits).unionByName(one(fits_inner)).unionByName(many).repartition("shard", "cut")
    return dealt.sortWithinPartitions("shard", "cut", "member", "fp").mapInArrow(_links(radius), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: key, fp (fingerprint, signed), component (its smallest key), size (number of
    documents in the component)."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(body, shingle) for body in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints, pa.int64())], ["key", "fp"])

    prints = written(rows.mapInArrow(hashed, f"key {dict(rows.dtypes)['key']}, fp bigint"))
    distinct = written(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("size")))
    joined = components(link_fingerprints(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = written(
        distinct.join(joined, "fp", "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    )
    sums = written(
        rooted.groupBy("root").agg(F.min("least").alias("component"), F.sum("size").alias("documents"), F.count("*").alias("prints"))
    )
    named = with_group(rooted, sums, "root", "prints").select("fp", "size", "component", "documents")
    return with_group(prints, written(named), "fp").select("key", "fp", "component", F.col("documents").alias("size"))


# groups by the similarity of shingle sets ------------------------------------------------

SKETCH = 256
BANDS = 8
#: A bit of two fingerprints at a similarity of 0.8 differs with a probability of 0.1875 at most (four and five shingles;
#: computed for all sets of up to 59 common shingles, and 80 to 400 at the widest), so over 28 bits in 2 of a million pairs.
WIDE_RADIUS = 28
SIMILARITY = 0.8
#: Candidates are pairs whose sketches agree in no less than the similarity minus this: six standard errors.
SLACK = 0.15
#: A tree holds so many shingles for each of its texts on average.
VOLUME = 1024
_random = np.random.default_rng(SEED)
_TIMES = _random.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_FLIP = _random.integers(1, 1 << 63, SKETCH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def distinct_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    pieces = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)


def text_node(text: bytes | None) -> int:
    """One number for all texts of the same words."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()) if text else b"") - (1 << 63)


def sketch(pieces: list[np.ndarray]) -> tuple[list[int], bytes]:
    """Shard keys from pairs of smallest values, and two bytes of the smallest value of each permutation."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for hashes in pieces:
        for i in range(0, len(hashes), 1024):
            part = np.unique(hashes[i : i + 1024])
            least = np.minimum(least, ((part[None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[2 * b : 2 * b + 2].tobytes(), b) - (1 << 63) for b in range(BANDS)]
    return keys, ((least * _MIX) >> np.uint64(48)).astype(np.uint16).tobytes()


class SimilarTree:
    """The members of a tree with their sketches, and which of all texts seen so far are linked."""

    def __init__(self, radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        self.tree, self.places, self.nodes, self.sketches, self.sets = BKTree(), [], [], [], []
        self.group: list[int] = []

    def root(self, i: int) -> int:
        while self.group[i] != i:
            self.group[i] = self.group[self.group[i]]
            i = self.group[i]
        return i

    def candidates(self, fp: int, values: bytes) -> list[int]:
        """Members near in fingerprint whose sketch agrees so far that the sets may be similar, likeliest first."""
        near = list(self.tree.near(fp, self.radius))
        if not near:
            return []
        table = np.frombuffer(b"".join([self.sketches[j] for j in near]), np.uint16).reshape(len(near), -1)
        share = (table == np.frombuffer(values, np.uint16)).mean(axis=1)
        order = np.argsort(-share, kind="stable")
        return [near[j] for j in order[share[order] >= self.similarity - SLACK].tolist()]

    def add(self, node: int, fp: int, values: bytes, hashes: np.ndarray | None = None) -> None:
        self.tree.add(fp)
        self.nodes.append(node), self.sketches.append(values), self.sets.append(hashes)

    def links(self, node: int, fp: int, values: bytes, hashes: np.ndarray, member: bool) -> list[tuple[int, int]]:
        """Links of the next text to members, each confirmed by the whole sets. Pairs that are linked already by way of
        others are not compared."""
        place, found = len(self.group), []
        self.group.append(place)
        for j in self.candidates(fp, values):
            a, b = self.root(place), self.root(self.places[j])
            if a != b and overlap(hashes, self.sets[j]) >= self.similarity:
                self.group[max(a, b)] = min(a, b)
                found.append((node, self.nodes[j]))
        if member:
            self.places.append(place)
            self.add(node, fp, values, hashes)
        return found


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


#: Rows of a batch that are Python objects at a time.
SLICE = 256


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    for i in range(0, batch.num_rows, SLICE):
        yield from zip(*(batch.column(c).slice(i, SLICE).to_pylist() for c in names))


def _alike(radius: int, similarity: float):
    """(shard, cut, member, node) of the texts of a tree that have a candidate there; members come before visitors."""
    names = ["shard", "cut", "member", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree, hit = None, None, set()

        def batch_of(rows):
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            out = []
            for shard, cut, member, node, fp, values in _rows(batch, [*names, "fp", "sketch"]):
                if (shard, cut) != last:
                    out += [(*last, True, tree.nodes[j]) for j in hit] if last else []
                    last, tree, hit = (shard, cut), SimilarTree(radius, similarity), set()
                fp &= (1 << 64) - 1
                near = tree.candidates(fp, values)
                hit.update(near)
                if member:
                    if near:
                        hit.add(len(tree.nodes))
                    tree.add(node, fp, values)
                elif near:
                    out.append((shard, cut, False, node))
            yield batch_of(out)
        yield batch_of([(*last, True, tree.nodes[j]) for j in hit] if last else [])

    return run


def _similar(radius: int, similarity: float):
    """(a, b): confirmed links of each tree; members come before visitors, whose sets are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            pairs = []
            for shard, cut, member, node, fp, values, hashes in _rows(batch, ["shard", "cut", "member", "node", "fp", "sketch", "hashes"]):
                if (shard, cut) != last:
                    last, tree = (shard, cut), SimilarTree(radius, similarity)
                pairs += tree.links(node, fp & ((1 << 64) - 1), values, np.frombuffer(hashes, np.uint64), member)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _shingle_sets(documents: DataFrame, key: str, text: str, shingle: int, firsts: DataFrame) -> DataFrame:
    """(node, hashes): the sorted distinct shingle hashes of the texts ``firsts`` (node, least), read again from the
    documents, as few texts have a candidate."""
    wanted = firsts.select(F.col("least.key").alias("_key"), F.col("least.mark").alias("_mark"))
    same = documents[key].eqNullSafe(wanted["_key"]) & (F.xxhash64(documents[text]) == wanted["_mark"])
    rows = documents.join(wanted, same, "left_semi").select(F.col(text).cast("binary").alias("body"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                texts = batch.column("body").slice(i, SLICE).to_pylist()
                sets = [distinct_hashes(body, shingle).tobytes() for body in texts]
                yield pa.RecordBatch.from_arrays([pa.array([text_node(b) for b in texts], pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])

    # Rows that repeat key and text are one node.
    return rows.mapInArrow(hashed, "node bigint, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _with_cuts(keyed: DataFrame, tree: int) -> tuple[DataFrame, Column]:
    """The rows (node, shingles, shard) of shards with several texts, with ``size`` and ``volume`` (shingles) of the shard, and
    the number of trees that it takes."""
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("size"), F.sum("shingles").alias("volume")).where("size > 1")
    cuts = F.ceil(F.greatest(F.col("size"), F.col("volume") / VOLUME) / tree).cast("int")
    return with_group(keyed, written(sizes), "shard"), F.greatest(cuts, F.lit(1))


def _link_texts(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], radius: int, similarity: float, tree: int) -> DataFrame:
    """(a, b): links between distinct texts that spread over each shard's groups; ``sets`` gives the shingle
    sets (node, hashes) of some nodes."""
    keyed = written(nodes.select("node", "shingles", F.explode("bands").alias("shard")))
    dealt, cuts = _with_cuts(keyed, tree)
    # A shard too large for a tree is divided by ranges of the number of shingles. Numbers of similar texts differ by no more
    # than the similarity, so their levels are equal or neighbours; a range holds two levels, and any similar pair shares one.
    level = F.floor(F.log(F.greatest("shingles", F.lit(1))) / -np.log(similarity - 1e-6))
    ranges = F.explode(F.array(level, level + 1)).alias("range")
    finer = dealt.where(cuts > 1).select("node", "shingles", "shard", ranges)
    finer, _ = _with_cuts(written(finer.select("node", "shingles", F.xxhash64("shard", "range").alias("shard"))), tree)
    every = dealt.where(cuts == 1).unionByName(finer)
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    # What is still too large is cut into trees that each member visits.
    spread = every.withColumn("cuts", cuts).select("node", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    rows = spread.select("node", "shard", "cut", (F.col("cut") == F.col("own")).alias("member"))
    described = nodes.select("node", "fp", "sketch")

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("shard", "cut").sortWithinPartitions("shard", "cut", F.desc("member"), "node")

    alike = written(
        in_order(rows.join(described, "node")).mapInArrow(_alike(radius, similarity), "shard bigint, cut int, member boolean, node bigint")
    )
    found = written(sets(nodes.select("node", "least").join(alike.select("node").distinct(), "node")))
    whole = alike.join(described, "node").join(found, "node")
    return in_order(whole).mapInArrow(_similar(radius, similarity), "a bigint, b bigint")


def _link_prints(nodes: DataFrame, radius: int, tree: int) -> DataFrame:
    """(a, b): links between distinct texts whose fingerprints ``print`` differ in at most ``radius`` bits. Texts of one fingerprint
    are linked to the first of them, and only that one to those of other fingerprints."""
    firsts = written(nodes.groupBy("print").agg(F.min("node").alias("first"), F.count("*").alias("size")))
    same = with_group(nodes.select("node", "print"), firsts.where("size > 1"), "print")
    same = same.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = written(link_fingerprints(firsts.select(F.col("print").alias("fp")), radius, tree).where("a <> b").distinct())
    named = lambda side: firsts.select(F.col("print").alias(side), F.col("first").alias(f"first_{side}"))
    near = links.join(named("a"), "a").join(named("b"), "b")
    return same.unionByName(near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def similar_texts(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = SIMILARITY, radius: int = WIDE_RADIUS, tree: int = TREE
) -> DataFrame:
    """One row per document: key, mark (hash of its text), component (smallest key of its group), kept (whether
    it is the document that stays: the smallest key, then the smallest mark), size.

    Texts are linked whose fingerprints, those of ``near_duplicates``, differ in at most ``RADIUS`` bits, or whose sets of
    ``shingle`` words are similar by ``similarity``."""
    rows = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("body"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, counts, fps, bands, values = [], [], [], [], [], []
            for body in batch.column("body").to_pylist():
                hashes = distinct_hashes(body, shingle)
                # Each shingle counts once, as it does in the similarity.
                pieces = [hashes[i : i + PIECE] for i in range(0, len(hashes), PIECE)]
                keys, small = sketch(pieces)
                nodes.append(text_node(body)), prints.append(fingerprint(body)), counts.append(len(hashes))
                fps.append(majority(pieces)), bands.append(keys), values.append(small)
            columns = [pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(counts, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), *columns], ["key", "mark", "node", "print", "shingles", "fp", "bands", "sketch"])

    kind = dict(rows.dtypes)["key"]
    made = written(rows.mapInArrow(sketched, f"key {kind}, mark bigint, node bigint, print bigint, shingles bigint, fp bigint, bands array<bigint>, sketch binary"))
    # Copies of a text are one node.
    order = F.struct(F.col("key").isNull().alias("last"), "key", "mark")
    nodes = written(
        made.groupBy("node").agg(
            F.min(order).alias("least"), F.count("*").alias("size"), F.min("print").alias("print"), F.min("shingles").alias("shingles"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")
        )
    )
    sets = lambda firsts: _shingle_sets(documents, key, text, shingle, firsts)
    links = _link_prints(nodes, RADIUS, tree).unionByName(_link_texts(nodes, sets, radius, similarity, tree))
    joined = components(links)
    rooted = written(nodes.join(joined, "node", "left").select("node", "least", "size", F.coalesce("root", "node").alias("root")))
    sums = rooted.groupBy("root").agg(F.min("least").alias("first"), F.sum("size").alias("documents"), F.count("*").alias("texts"))
    named = with_group(rooted, written(sums), "root", "texts").select("node", "size", "first", "documents")
    found = with_group(made.select("key", "mark", "node"), written(named), "node")
    kept = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("mark") == F.col("first.mark"))
    return found.select("key", "mark", F.col("first.key").alias("component"), kept.alias("kept"), F.col("documents").alias("size"))
