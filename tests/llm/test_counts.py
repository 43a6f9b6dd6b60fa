"""Resampling, token files and phrases next to brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import phrases, resampling, token_files
from ledgerloom.llm.common import new_folder
from ledgerloom.llm.queries import TOKEN_END, TOKEN_VOCABULARY, TOKENIZERS

from .rows import LONG, MESSY, documents, empty

VOCABULARY = f"{TOKENIZERS}/{TOKEN_VOCABULARY}"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


# resampling ------------------------------------------------------------------------------


def brute_features(text, longest=3):
    words = WORD.findall(lowered(text))
    return len(words), [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resampled(texts, target, percent, buckets, least):
    found = [(i, *brute_features(t)) for i, t in texts]
    s, t = Counter(), Counter()
    for _, _, fs in found:
        s.update(zlib.crc32(f) % buckets for f in fs)
    for text in target:
        t.update(zlib.crc32(f) % buckets for f in brute_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, fs in found:
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: percent * len(able) // 100]
    out = [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in able[len(drawn) :]]
    return sorted(map(str, out + [(*r, None) for r in rows if r[1] < least]))


TARGET = ["First line here alpha", None, "", "a a a a word1x1 word2x2", "ß É 漢字"]


@pytest.mark.parametrize("percent,buckets,slice_bytes", [(50, 10_000, 8 << 20), (100, 97, 40), (0, 70_000, 300)])
def test_resampling_equals_brute_force(spark, monkeypatch, percent, buckets, slice_bytes):
    monkeypatch.setattr(resampling.features, "__defaults__", (*resampling.features.__defaults__[:-1], slice_bytes))
    target = documents(spark, list(enumerate(TARGET)))
    found = resampling.resampled(documents(spark, MESSY), target, percent, buckets=buckets, min_words=4)
    assert found.columns == ["key", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_resampled(MESSY, TARGET, percent, buckets, 4)


def test_resampling_of_empty_tables(spark):
    assert resampling.resampled(empty(spark), documents(spark, MESSY), 5).count() == 0
    rows = resampling.resampled(documents(spark, MESSY), empty(spark), 5).collect()
    assert len(rows) == len(MESSY) and all(r.weight == 0 for r in rows if not r.n_features)


def test_a_target_like_text_weighs_more(spark):
    common = [(i, " ".join(random.Random(i).choices("one two three four five six".split(), k=30))) for i in range(40)]
    rows = resampling.resampled(documents(spark, [*common, (99, "lemma proof theorem " * 10)]), documents(spark, [(0, "lemma proof theorem " * 50)]), 5)
    assert max(rows.collect(), key=lambda r: r.weight).key == 99


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("aB1é .\n\x01", max_size=30), max_size=6))
def test_buckets_of_any_slice(texts):
    found = resampling.slice_buckets([t.encode() for t in texts], 997, 4) if texts else []
    assert [(n, sorted(b.tolist())) for n, b in found] == [
        (n, sorted(zlib.crc32(f) % 997 for f in fs)) for n, fs in (brute_features(t, 4) for t in texts)
    ]


def test_checksums_move_on_by_any_length():
    rng = random.Random(3)
    for length in (0, 1, 2, 7, 300, 70_001):
        a, b = rng.randbytes(9), rng.randbytes(length)
        moved = resampling._moved(resampling._move(length), np.array([zlib.crc32(a)], np.uint32))[0]
        assert moved ^ zlib.crc32(b) == zlib.crc32(a + b)


# token files -----------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def brute_files(texts, end):
    tool = tokenizer()
    rows = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()), (r[1] or "").encode()))
    out, start = [], 0
    for key, text in rows:
        ids = tool.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((key, start, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_bytes,block_ids", [(32 << 20, 4 << 20), (50_000, 20)])
def test_files_give_back_every_id(spark, shard_bytes, block_ids):
    path = new_folder(spark)
    token_files.write_token_files(documents(spark, MESSY), path, VOCABULARY, TOKEN_END, shard_bytes=shard_bytes, block_ids=block_ids)
    rows = token_files.read_token_files(spark, path).collect()
    got = sorted(((r.key, r.start, r.n_ids, bytes(r.ids)) for r in rows), key=lambda r: r[1])
    assert got == brute_files(MESSY, TOKEN_END)


def test_no_file_for_an_empty_table(spark):
    assert token_files.written_and_read(empty(spark), VOCABULARY, TOKEN_END).count() == 0


@settings(deadline=None, max_examples=400)
@given(st.lists(st.text("ab'_s ,.-\n\t\r　\xa0\x1c1é²’漢<|endoftext|>", max_size=40) | st.text("ab, \n", max_size=12), min_size=1, max_size=6))
def test_units_have_the_ids_of_the_whole_text(texts):
    coder = token_files._coder(VOCABULARY)
    found = [ids.tolist() for ids in coder.encode(pa.array(texts, pa.string()), 7)]
    assert found == [coder.tokenizer.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_a_coder_that_forgets_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_UNITS", 50)
    monkeypatch.setattr(token_files, "STEP_BYTES", 100)
    coder = token_files.UnitCoder(VOCABULARY)
    texts = [t or "" for _, t in MESSY] + [LONG[:5000], "x" * 5000, "漢字" * 500]
    assert [i.tolist() for i in coder.encode(pa.array(texts, pa.string()), 2)] == [tokenizer().encode(t, add_special_tokens=False).ids + [2] for t in texts]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.integers(1, 5))
def test_packed_runs_of_any_ids(ids, times):
    ids = np.array(ids * times, np.uint32)
    table, control, data = token_files.pack(ids)
    back = token_files.unpack(table, np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ids))
    assert (back == ids).all() and len(control) == -(-len(ids) // 4)


def test_frequent_ids_take_one_byte_and_long_ranks_more():
    ids = np.concatenate([np.repeat(np.arange(100_000, 100_256, dtype=np.uint32), 9), np.arange(70_000, dtype=np.uint32)])
    table, control, data = token_files.pack(ids)
    assert set(table[:256].tolist()) == set(range(100_000, 100_256))
    assert len(data) == 256 * 9 + (65_536 - 256) * 2 + (70_000 + 256 - 65_536) * 3
    back = token_files.unpack(table, np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ids))
    assert (back == ids).all()


def test_a_damaged_block_is_refused():
    whole = token_files.block(0, 0, 0, [5], [3], np.array([7, 7, 9], np.uint32))
    assert token_files.parse(whole + b"\n")[2] == [5]
    with pytest.raises(ValueError):
        token_files.parse(whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:])


# phrases ---------------------------------------------------------------------------------


def brute_phrases(texts, least, top):
    """texts: (lang, text) pairs."""
    f, n = Counter(), Counter()
    for lang, text in texts:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        found = []
        for (of, words), a in f.items():
            if of != lang or len(words) < 2 or a < least:
                continue
            longer = max((m for (o, w), m in f.items() if o == lang and len(w) > len(words) and m >= least and words in (w[:-1], w[1:])), default=0)
            if 100 * longer >= 50 * a:
                continue
            score, _, l, r = min((1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            found.append((-score, -a, b" ".join(words), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def chatter(seed, count):
    rng = random.Random(seed)
    words = "the red fox SAID hello, wide. sea ém 漢 \t a;b fish\nnet it's".split(" ")
    return [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(40)))) for _ in range(count)]


@pytest.mark.parametrize("sizes,top", [({}, 2000), ({"portion_bytes": 500, "part_bytes": 3000}, 7)])
def test_phrases_equal_brute_force(spark, sizes, top):
    texts = [*chatter(1, 150), ("en", None), (None, ""), ("en", "."), ("de", "one"), ("de", "Red fox " * 300)]
    rows = spark.createDataFrame([(i, l, t, 1, "x") for i, (l, t) in enumerate(texts)], "doc_id int, lang string, text string, n int, phrase string")
    found = phrases.collocations(rows.repartition(5), top=top, **sizes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(texts, 10, top)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(empty(spark)).count() == 0


def test_scores_of_counts_whose_products_pass_64_bits(spark):
    big, half = 10**13 + 7, 5 * 10**12 + 1
    row = spark.sql(
        f"select (cast(1000000 as decimal(7,0)) * cast({half}L as decimal(14,0)) * cast({half}L as decimal(14,0)))"
        f" div (cast({big}L as decimal(14,0)) * cast({big - 3}L as decimal(14,0))) as score"
    ).first()
    assert row.score == 1000000 * half * half // (big * (big - 3))


@settings(deadline=None, max_examples=80)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 30), min_size=1), max_size=12), st.integers(1, 12))
def test_summaries_keep_every_frequent_name(parts, least):
    mass = sum(sum(p.values()) for p in parts)
    whole = Counter()
    summary = phrases.Summary(mass // least + 1)
    for part in parts:
        whole.update(part)
        names = sorted(part)
        summary.add(np.array(names, np.uint32), np.array([part[k] for k in names], np.int64))
    kept = set(summary.reaching(least).tolist())
    assert {k for k, c in whole.items() if c >= least} <= kept
    assert len(summary.counters) <= summary.capacity and summary.lost * (summary.capacity + 1) <= mass


def test_a_count_beyond_32_bits_stays_a_survivor():
    summary = phrases.Summary(2)
    for _ in range(3):
        summary.add(np.array([5, 6, 7], np.uint32), np.array([2**32 - 1, 1, 1], np.int64))
    assert 5 in summary.reaching(10) and phrases.Summary(5).reaching(1).tolist() == []


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 2**32 - 1), max_size=40))
def test_packed_names_come_back(names):
    names = np.array(sorted(names), np.uint32)
    assert phrases.names_of(phrases.packed_names(names)).tolist() == names.tolist()


def test_summaries_do_drop_rare_names():
    summary = phrases.Summary(10_000 // 10 + 1)
    for start in range(0, 9_000, 500):
        summary.add(np.arange(start, start + 500, dtype=np.uint32), np.ones(500, np.int64))
    summary.add(np.array([77], np.uint32), np.array([1_000], np.int64))
    assert 77 in summary.reaching(10) and len(summary.counters) <= 1_001


def test_equal_names_of_other_words_are_counted_apart(spark, monkeypatch):
    """Every hash the same: all runs survive, and counts are still by words."""
    monkeypatch.setattr(phrases, "_names", lambda hashes, parts: np.zeros(len(hashes), np.uint64))
    words = phrases.Words(b"a b.a b.c d")
    kept = np.zeros(1, np.uint64)
    for size, (places, hashes) in enumerate(words.hashes("en", 2), 1):
        found = phrases._counted(words, "en", size, places[phrases._met(phrases._names(hashes, 1), kept)])
        got = dict(zip(found.column("phrase").to_pylist(), found.column("n").to_pylist()))
        assert got == ({"a": 2, "b": 2, "c": 1, "d": 1} if size == 1 else {"a b": 2, "c d": 1})
