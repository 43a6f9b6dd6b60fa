"""Exact, line, near and substring duplicates next to brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from ledgerloom.llm.common import components, ranked, with_group

from .rows import DOCUMENTS, LONG, MESSY, documents, empty


def collected(frame):
    return [r.asDict() for r in frame.collect()]


def last(key):
    return (key is None, key or 0)


# exact -----------------------------------------------------------------------------------


def brute_exact(texts):
    groups = {}
    for key, text in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(key)
    out = []
    for text, keys in groups.items():
        keys = sorted(keys, key=last)
        for n, key in enumerate(keys):
            out.append((last(key), last(keys[0]), len(keys), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("blocks", [1, 4])
def test_exact_groups(spark, monkeypatch, blocks):
    monkeypatch.setattr(exact_dedup, "MOST_BLOCKS", blocks)
    texts = MESSY + [(100 + i, f"text {i % 40}") for i in range(120)]
    found = collected(exact_dedup.duplicate_groups(documents(spark, texts)))
    got = sorted((last(r["key"]), last(r["keep_id"]), r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in found)
    assert got == brute_exact(texts)


def test_exact_with_a_filter_that_lets_everything_through(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_BITS", 2)
    texts = [(i, f"text {i % 7}") for i in range(30)]
    found = collected(exact_dedup.duplicate_groups(documents(spark, texts)))
    assert sorted((r["key"], r["keep_id"]) for r in found) == [(i, i % 7) for i in range(30)]


def test_a_filter_cell_is_the_bit_it_says(spark):
    found = spark.sql("select bitmap_construct_agg(bit) b from values (5), (77), (32767) as t(bit)")
    bits = [exact_dedup._bit_set(found["b"], exact_dedup.F.lit(i)).alias(f"b{i}") for i in (4, 5, 77, 78, 32767)]
    assert tuple(found.select(*bits).first()) == (False, True, True, False, True)


def test_exact_of_nothing(spark):
    assert exact_dedup.duplicate_groups(empty(spark)).count() == 0


# lines -----------------------------------------------------------------------------------


def brute_lines(texts, run):
    order = sorted(texts, key=lambda r: last(r[0]))
    seen, out = set(), []
    for key, text in order:
        lines = (text or "").split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
        gone = set()
        for n in range(len(solid) - run + 1):
            window = tuple(lines[i].strip(" \t\n\v\f\r") for i in solid[n : n + run])
            if window in seen:
                gone.update(solid[n : n + run])
            seen.add(window)
        kept = None if text is None else "\n".join(line for i, line in enumerate(lines) if i not in gone)
        out.append((key, kept, len(solid), len(gone)))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_lines_like_brute_force(spark, run):
    rng = random.Random(run)
    texts = [(i, "\n".join(rng.choice(["a", " b", "c ", "d", "", "e", "f g"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    texts += [(900, None), (901, ""), (902, "x\n" * 3000), (903, LONG)]
    found = collected(line_dedup.without_repeated_lines(documents(spark, texts), run=run))
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found)
    assert got == sorted(brute_lines(texts, run), key=lambda r: r[0])


def test_lines_of_messy_rows(spark):
    rows = documents(spark, MESSY)
    found = line_dedup.without_repeated_lines(rows)
    assert found.columns == [*rows.columns, "n_lines", "n_removed"]
    texts = {(r.doc_id, r.text) for r in found.collect()}
    assert found.count() == len(MESSY)
    assert (1, "First line here\nsecond line there\nthird line\n") in texts
    assert (2, "another\n\n  \n") in texts
    assert (None, "") in texts  # the copy without an id comes last; its blank end stays
    assert (3, None) in texts and (4, "") in texts and (5, " \t\n") in texts
    assert line_dedup.without_repeated_lines(empty(spark)).count() == 0


def test_only_ascii_white_space_is_trimmed(spark):
    """A space before another line terminator is inside the line, like in the SQL."""
    texts = {1: "alpha beta \x85\nsecond line", 2: "alpha beta\x85\nsecond line", 3: " \talpha beta\x85\x0b\r\f\n\x0bsecond line "}
    got = {r["doc_id"]: r["n_removed"] for r in collected(line_dedup.without_repeated_lines(documents(spark, texts.items())))}
    assert got == {1: 0, 2: 0, 3: 2}


def test_long_single_lines_go_and_short_ones_stay(spark):
    rng = random.Random(12)
    passage = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    lines = [passage(n) for n in (50, 51, 60, 49, 48, 3, 1)] + ["x" * 200, "a", "b", "", " "]
    texts = [(i, "\n".join(rng.choice(lines) + rng.choice(["", " "]) for _ in range(rng.randrange(5)))) for i in range(60)]
    texts += [(70, lines[0]), (71, f"p\n{lines[1]}\nq"), (72, None), (None, lines[2])]
    both = {key: set() for key, _ in texts}
    solid = lambda text: [(i, s) for i, line in enumerate((text or "").split("\n")) if (s := line.strip(" \t\n\v\f\r"))]
    seen = set()
    for key, text in sorted(texts, key=lambda r: last(r[0])):
        found = solid(text)
        windows = [found[n : n + 2] for n in range(len(found) - 1)] + [[x] for x in found if len(x[1].split()) >= 50]
        for window in sorted(windows, key=lambda w: w[0][0]):
            if tuple(s for _, s in window) in seen:
                both[key].update(i for i, _ in window)
            seen.add(tuple(s for _, s in window))
    want = {}
    for key, text in texts:
        kept = None if text is None else "\n".join(s for i, s in enumerate(text.split("\n")) if i not in both[key])
        want[key] = (kept, len(solid(text)), len(both[key]))
    got = collected(line_dedup.without_repeated_lines(documents(spark, texts), long_words=50))
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == want
    assert want[70] == ("", 1, 1) and want[71] == ("p\nq", 3, 1)


# near copies -----------------------------------------------------------------------------


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints(spark):
    assert [simhash.fingerprint(t.encode()) & (1 << 64) - 1 for _, t in MESSY[:2]] == [brute_fingerprint(t) for _, t in MESSY[:2]]
    for text in ("", "a", "A b", "É ß x", "one two three four"):
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0
    assert simhash.fingerprint(LONG.encode()) & (1 << 64) - 1 == brute_fingerprint(LONG)


def near_fingerprints(seed, n):
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(values) < n:
        value = rng.choice(values)
        for _ in range(rng.randrange(5)):
            value ^= 1 << rng.randrange(64 if rng.random() < 0.3 else 8)
        values.append(value)
    return list(dict.fromkeys(values))


def test_bk_tree_finds_all_within_the_radius():
    values = near_fingerprints(1, 400)
    tree = simhash.BKTree()
    for value in values:
        tree.add(value)
    for query in values[::7]:
        want = [i for i, v in enumerate(values) if (v ^ query).bit_count() <= 2]
        assert sorted(tree.near(query, 2)) == want


@pytest.mark.parametrize("tree", [3, 2048])
def test_links_like_brute_force(spark, tree):
    """Small trees force divided shards and shards of several trees."""
    values = near_fingerprints(2, 300)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp bigint"), tree=tree)
    at = {v: i for i, v in enumerate(signed)}
    want = brute_groups(values, lambda a, b: (a ^ b).bit_count() <= 2)
    pairs = [(r.a, r.b) for r in links.collect()]
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = root(at[a]), root(at[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(values))] == want
    with pytest.raises(ValueError):
        simhash.link_fingerprints(links.select(links.a.alias("fp")), radius=3)


def test_near_duplicates_of_messy_rows(spark):
    found = collected(simhash.near_duplicates(documents(spark, MESSY)))
    assert len(found) == len(MESSY)
    blank = [r for r in found if r["fp"] == 0]
    assert {r["component"] for r in blank} == {3} and {r["size"] for r in blank} == {len(blank)} and len(blank) == 4
    assert {r["component"] for r in found if r["key"] in (6, 7)} == {6}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = sorted({x for e in edges for x in e})
    linked = {(min(e), max(e)) for e in edges}
    groups = brute_groups(nodes, lambda a, b: (b, a) in linked or (a, b) in linked)
    assert {n: got.get(n, n) for n in nodes} == {n: nodes[g] for n, g in zip(nodes, groups)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize("tree", [4, 2048])
def test_similar_texts(spark, tree):
    rng = random.Random(4)
    texts, want = [], {}
    for group in range(12):
        base = words(rng, 200)
        for copy in range(1 + group % 4):
            changed = list(base)
            for _ in range(copy):  # at most three words: far more than 0.8 stays
                changed[rng.randrange(200)] = "new"
            key = len(texts)
            texts.append((key, " ".join(changed)))
            want[key] = key - copy
    half = words(rng, 200)
    texts += [(900, " ".join(half + words(rng, 200))), (901, " ".join(half + words(rng, 200)))]  # similar by a third
    want |= {900: 900, 901: 901}
    found = collected(simhash.similar_texts(documents(spark, texts), tree=tree))
    assert {r["key"]: r["component"] for r in found} == want
    assert all(r["kept"] == (r["key"] == r["component"]) for r in found)


def test_similar_messy_texts(spark):
    found = collected(simhash.similar_texts(documents(spark, MESSY)))
    assert len(found) == len(MESSY)
    kept = sorted(((r["key"] is None, r["key"]) for r in found if r["kept"]))
    # ids 9: two equal rows are kept as one document is, and the other text of that id
    assert kept == [(False, k) for k in (1, 2, 3, 6, 9, 9, 9, 10)]
    assert simhash.similar_texts(empty(spark)).count() == 0


def brute_similar(texts, shingle=5, similarity=0.8):
    """Key of the first text of each text's group, by the exact similarity of all pairs."""
    sets = [{tuple(t.lower().split()[i : i + shingle]) for i in range(max(1, len(t.split()) - shingle + 1))} for _, t in texts]
    groups = brute_groups(sets, lambda a, b: len(a & b) / len(a | b) >= similarity)
    return {key: texts[g][0] for (key, _), g in zip(texts, groups)}


def similar_to_a_degree(seed, groups, least, most):
    """Texts, and changed copies of them whose similarity to them lies between ``least`` and ``most``."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = words(rng, rng.randrange(150, 400))
        n = len(base) - 4
        tail = int(n / rng.uniform(least, most)) - n
        texts += [(len(texts), " ".join(base)), (len(texts) + 1, " ".join(base + words(rng, tail)))]
    return texts


@pytest.mark.parametrize("tree", [4, 2048])
def test_similarity_is_that_of_the_whole_sets(spark, tree):
    texts = similar_to_a_degree(8, 80, 0.75, 0.85)
    want = brute_similar(texts)
    assert 20 < sum(k != c for k, c in want.items()) < 60
    found = collected(simhash.similar_texts(documents(spark, texts), tree=tree))
    assert {r["key"]: r["component"] for r in found} == want


def test_repeated_sentences_do_not_hide_a_similarity(spark):
    """The sets of both texts are nearly equal, the counts of their shingles are not."""
    rng, texts = random.Random(9), []
    for i in range(12):
        base = words(rng, 400)
        texts += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + base[:15] * (10, 20, 100)[i % 3]))]
    want = brute_similar(texts)
    assert want == {k: k - k % 2 for k, _ in texts}
    found = collected(simhash.similar_texts(documents(spark, texts)))
    assert {r["key"]: r["component"] for r in found} == want


def test_the_wide_radius_misses_few_of_small_sets():
    rng, near = np.random.default_rng(10), 0
    for _ in range(20_000):
        hashes = rng.integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 5, dtype=np.uint64)
        a, b = (simhash.majority([h]) & (1 << 64) - 1 for h in (hashes, hashes[:4]))
        near += (a ^ b).bit_count() <= simhash.WIDE_RADIUS
    assert near >= 20_000 - 2


@pytest.mark.parametrize("tree", [2, 2048])
def test_texts_of_near_fingerprints_are_one_group(spark, tree):
    """Pairs, and chains of three, within two bits whose sets of five words are similar by less than 0.8."""
    rng, texts, pairs = random.Random(12), [], 0
    distance = lambda a, b: ((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())) & (1 << 64) - 1).bit_count()
    while pairs < 8:
        # One sentence over and over, with a few words in between: repeats decide the fingerprint, not the set.
        base = words(rng, 12) * 30
        text = " ".join(base)
        other = " ".join(base + words(rng, 8))
        if distance(text, other) <= 2:
            pairs += 1
            texts += [(3 * pairs, text), (3 * pairs + 1, other), (3 * pairs + 2, " ".join(words(rng, 100)))]
    assert brute_similar(texts) == {k: k for k, _ in texts}
    want = brute_groups([t for _, t in texts], lambda a, b: distance(a, b) <= 2)
    found = collected(simhash.similar_texts(documents(spark, texts), tree=tree))
    assert {r["key"]: r["component"] for r in found} == {k: texts[g][0] for (k, _), g in zip(texts, want)}


@pytest.mark.parametrize("tree", [2, 2048])
def test_candidates_do_not_depend_on_the_size_of_a_shard(spark, tree):
    """Every text has one band in common with all, and no other with any."""
    texts = similar_to_a_degree(11, 10, 0.81, 0.9)
    rows = []
    for key, text in texts:
        hashes = simhash.distinct_hashes(text.encode(), 5)
        fp = simhash.majority([hashes])
        bands = [7] + [1000 * (key + 1) + b for b in range(1, simhash.BANDS)]
        rows.append((key, len(hashes), fp, bands, bytearray(simhash.sketch([hashes])[1]), bytearray(hashes.tobytes())))
    kinds = "node bigint, shingles bigint, fp bigint, bands array<bigint>, sketch binary, hashes binary"
    table = spark.createDataFrame(rows, kinds).withColumn("least", simhash.F.lit(0))
    sets = lambda firsts: table.select("node", "hashes").join(firsts.select("node"), "node")
    links = simhash._link_texts(table, sets, simhash.WIDE_RADIUS, 0.8, tree).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links} == {(2 * i, 2 * i + 1) for i in range(10)}


# byte strings ----------------------------------------------------------------------------


def brute_strings(texts, length=50):
    texts = sorted(((key, (text or "").encode()) for key, text in texts), key=lambda r: last(r[0]))
    first, out = {}, []
    for key, body in texts:
        for i in range(len(body) - length + 1):
            first.setdefault(body[i : i + length], last(key))
    for key, body in texts:
        lost = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            if first[body[i : i + length]] < last(key):
                lost[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, lost, False])).reshape(-1, 2).tolist()
        out.append((last(key), len(body), edges, bytes(np.frombuffer(body, np.uint8)[~lost])))
    return sorted(out)


def string_texts(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [make(rng.randrange(45, 140)) for _ in range(6)]
    texts = [(i, "".join(rng.choice(shared) if rng.random() < 0.5 else make(rng.randrange(80)) for _ in range(rng.randrange(7)))) for i in range(50)]
    tail = shared[0][:60]
    return texts + [(70 + i, make(10) + tail + make(10)) for i in range(30)] + [(200, "ab" * 300), (201, "ab" * 100 + make(30))]


@pytest.mark.parametrize("most", [2, suffix_dedup.MOST_TRIPLES])
def test_repeated_strings_like_brute_force(spark, most):
    """A small limit sends names with several triples the other way."""
    texts = string_texts(5) + MESSY
    found = collected(suffix_dedup.without_repeated_strings(documents(spark, texts), most_triples=most))
    got = sorted((last(r["key"]), r["n_bytes"], [[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) for r in found)
    assert got == brute_strings(texts)


def test_strings_in_many_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = string_texts(6)
        for most in (2, 50_000):
            found = collected(suffix_dedup.without_repeated_strings(documents(spark, texts), most_triples=most))
            got = sorted((last(r["key"]), r["n_bytes"], [[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) for r in found)
            assert got == brute_strings(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_window_has_a_covered_position_that_its_content_decides():
    rng = np.random.default_rng(7)
    window = rng.integers(97, 100, 50).astype(np.uint8)
    places = set()
    for size in (0, 3, 40):
        data = np.concatenate([rng.integers(97, 100, size), window, rng.integers(97, 100, 60)]).astype(np.uint8)
        at, _ = suffix_dedup.covered(data, np.array([len(data)]))
        places.add(tuple(p - size for p in at if size <= p <= size + 50 - suffix_dedup.GRAM))
        for start in range(len(data) - 49):
            assert any(start <= p <= start + 50 - suffix_dedup.GRAM for p in at)
    common = set.intersection(*map(set, places))
    assert common


def lost_strings(spark, texts):
    found = collected(suffix_dedup.without_repeated_strings(documents(spark, texts)))
    return sorted((last(r["key"]), r["n_bytes"], [[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) for r in found)


def test_strings_that_differ_in_the_last_bytes_of_words(spark):
    """Changes eight bytes apart that a polynomial of words, multiplied by a number that ends in 0x15, cancels out."""
    rng = random.Random(21)
    base = [rng.choice("cdfgh ") for _ in range(6000)]
    other, third = list(base), list(base)
    for at in range(60, 5900, 90):
        base[at], base[at + 8], third[at], third[at + 8] = "azaz"
        other[at], other[at + 8] = "be"
        third[at + 45] = "x"
    texts = [(k, "".join(t)) for k, t in enumerate((base, other, third))]
    assert lost_strings(spark, texts) == brute_strings(texts)


def test_jobs_of_strings_do_not_grow_with_the_parts(spark, monkeypatch):
    texts, jobs = string_texts(8), []
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    for parts in (4, 64):
        monkeypatch.setattr(suffix_dedup, "_sizes", lambda total, parts=parts: (1 << 16, parts))
        before = scheduler.numTotalJobs()
        assert lost_strings(spark, texts) == brute_strings(texts)
        jobs.append(scheduler.numTotalJobs() - before)
    assert jobs[1] < jobs[0] + 10


def test_rows_whose_hashes_are_equal(monkeypatch):
    rng = np.random.default_rng(3)
    name, triple, owner = (rng.integers(0, n, 400).astype(np.uint64) for n in (5, 7, 50))
    gram = rng.integers(97, 99, (400, suffix_dedup.TRIPLE)).astype(np.uint8)
    gram[:, 2:] = gram[:4, 2:][rng.integers(0, 4, 400)]
    gram[:, 2 + rng.integers(0, 20)] = rng.integers(97, 99, 400)
    gram[:, 0], gram[:, 1] = rng.integers(20, 27, 400), rng.integers(20, 27, 400)
    groups = lambda order, differ: sorted(sorted(g.tolist()) for g in np.split(order, np.flatnonzero(differ)[1:]))
    want, met = groups(*suffix_dedup._together(name, triple)), suffix_dedup.met_before(name, gram, owner)
    monkeypatch.setattr(suffix_dedup, "_mixed", lambda h: h * np.uint64(0))
    assert groups(*suffix_dedup._together(name, triple)) == want and len(want) == 35
    assert (suffix_dedup.met_before(name, gram, owner) == met).all() and met.any()


@pytest.mark.parametrize("size", [1, 200, 1 << 17])
def test_pieces_and_portions_do_not_change_what_is_covered(monkeypatch, size):
    rng = random.Random(4)
    bodies = [bytes(rng.choice(b"ab ") for _ in range(rng.randrange(160))) for _ in range(60)] + [b""]
    edges = np.cumsum([0, *map(len, bodies)])
    want = []
    for i, body in enumerate(bodies):
        at, names = suffix_dedup.covered(np.frombuffer(body, np.uint8), np.array([len(body)]))
        want += [(i, *x) for x in zip(at.tolist(), names.tolist())]
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", size)
    found = suffix_dedup._marked(np.frombuffer(b"".join(bodies), np.uint8), edges)
    assert [*zip(*(x.tolist() for x in found))] == want
    assert all(b - a == 1 or edges[b] - edges[a] <= size for a, b in suffix_dedup._portions(edges, size))


def test_strings_of_nothing(spark):
    assert suffix_dedup.without_repeated_strings(empty(spark)).count() == 0


# helpers ---------------------------------------------------------------------------------


def test_group_join_keeps_every_row_of_hot_and_rare_keys(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "size")
    joined = with_group(rows, groups, "k")
    assert joined.count() == 5000 and joined.where("k = 0 and size <> 1667").count() == 0


def test_ranks_are_dense_and_in_order(spark):
    rows = spark.range(500).selectExpr("(id * 7919) % 500 as v").repartition(5)
    got = ranked(rows, "v").collect()
    assert sorted((r["rank"], r.v) for r in got) == [(i, i) for i in range(500)]
    assert ranked(rows.where("v < 0"), "v").count() == 0


def test_schemas_do_not_depend_on_the_rows(spark):
    assert exact_dedup.duplicate_groups(empty(spark)).columns == ["key", "keep_id", "group_size", "kept", "digest"]
    assert DOCUMENTS.names[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
