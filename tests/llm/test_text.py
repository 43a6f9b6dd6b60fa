"""Page text, URL rules, decontamination, pieces and classifiers next to brute force."""

import math
import os
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import decontaminate, html_text, markup, pieces, quality, toxicity, url_filter

from .rows import LONG, MESSY, documents, empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


# pages -----------------------------------------------------------------------------------


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("most_bits", [1 << 28, 8])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, most_bits):
    rng = random.Random(8)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(14))]
        b = [rng.randrange(6) for _ in range(rng.randrange(14))]
        places = markup._aligned(a, b, most_bits)
        assert len(places) == lcs_length(a, b) and places == sorted(set(places))
        rest = iter(b)
        assert all(a[i] in rest for i in places)  # in b in the same order
        assert len(markup.shared(a, b)) == lcs_length(a, b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><!-- note -->
<div id="cookie-notice">We use cookies</div><article><h1>Head &amp;  line</h1><p>One <b>bold<br>
<p class=x>Two&nbsp;&lt;three&gt; <i>it</i>alic</p><aside>Side</aside><form>Name</form>
<div class="comments"><p>Nice!</p></div></article><footer>&copy; End</footer></body></html>"""
WANTED = "Head & line\nOne bold\nTwo <three> italic"
PLAIN = "<body><div>Same top</div><p>Own {0}</p><div>Shared middle</div><p>More {0}</p><div>Same end</div></body>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], "page_id bigint, url string, html string, key string, text string")


def texts_of(frame):
    return {r.key: r.text for r in frame.collect()}


def test_mark_up_rules(spark):
    assert texts_of(html_text.main_text(pages(spark, [(1, "http://a.b/x", PAGE)]))) == {1: WANTED}


def test_shared_lines_of_the_nearest_page_go(spark):
    rows = [(i, f"http://h.org/a/{i}", PLAIN.format(f"number {i}")) for i in range(6)] + [(9, "http://h.org/z", "<p>Alone here")]
    rows += [(20, "http://other.org/", PLAIN.format("single"))]
    found = texts_of(html_text.main_text(pages(spark, rows)))
    assert all(found[i] == f"Own number {i}\nMore number {i}" for i in range(6))
    assert found[9] == "Alone here"
    assert found[20] == "Same top\nOwn single\nShared middle\nMore single\nSame end"  # no neighbour


def test_copies_keep_their_article(spark):
    found = texts_of(html_text.main_text(pages(spark, [(i, f"http://h.org/{i}", PAGE) for i in range(3)])))
    assert set(found.values()) == {WANTED}


def test_page_cases(spark):
    long = "<article>" + "<p>line &#x41; </p>" * 20_000 + "</article>"
    rows = [(1, None, PAGE), (2, "nothing", PAGE), (3, "http://h/1", None), (4, "http://h/2", ""), (5, "http://h/3", long)]
    rows += [(None, "http://h/4", "<p>x"), (6, "http://h/5", "<p>a < b & c <p"), (6, "http://h/5", "<p>a < b & c <p"), (7, "http://h/6", '<p class="un>closed</p>')]
    frame = html_text.main_text(pages(spark, rows))
    assert frame.count() == len(rows)
    found = texts_of(frame)
    assert found[1] == found[2] == WANTED and found[3] == found[4] == ""
    assert found[5] == "\n".join(["line A"] * 20_000)
    assert found[None] == "x" and found[6] == "a < b & c <p" and found[7] == "closed"
    assert html_text.main_text(pages(spark, [])).count() == 0


# URLs ------------------------------------------------------------------------------------

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/fr/x", "block")]
URLS = [
    "http://example.net/en/1", "https://m.EXAMPLE.net/de/1", "http://net", "http://net/", "http://xnet/", "ftp://x.example.com/de/?q",
    "http://example.com/De/", "http://b.a.org/fr/xy", "http://a.org/fr/x", "http://aa.org/fr/x", "http://ba.org/en", "no url", "", None,
    "http://free-bets.example.de/", "http://bets.de/path", "http://alphabets.de/", "http://h/?casino", "http://h/Casino/x", "http://h/fr/#net/",
    "a://b://net/", "http://free-bets.example.net/en/",
]


def brute_verdict(url, rules, words):
    match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = match.groups() if match else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        best = max(fits)
        return host, path, best[1], best[2]
    spam = any(re.search(rf"(?i)(?:^|[./_-]){re.escape(w)}(?:[./_-]|\Z)", host + path) for w in words)
    return host, path, None, "block" if spam else "allow"


@pytest.mark.parametrize("inline", [0, 200])
def test_urls_like_brute_force(spark, inline):
    """Once as a map inside the plan, once joined by token."""
    rules = [url_filter.host_rule(*r) for r in RULES] + url_filter.spam_rules()
    rows = pages(spark, [(i, url, "") for i, url in enumerate(URLS)] + [(None, URLS[0], None), (0, URLS[0], "")])
    frame = url_filter.judge_urls(rows, rules, inline=inline)
    assert frame.count() == len(URLS) + 2
    for r in frame.collect():
        if r.key is not None:
            assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(URLS[r.key], RULES, url_filter.SPAM_WORDS), URLS[r.key]


def test_a_rule_is_filed_under_its_rarest_token(spark):
    rows = pages(spark, [(i, f"http://a.common.net/en/{i}", "") for i in range(9)] + [(10, "http://b.rare.net/en/", "")])
    parts = url_filter._parts(rows, "page_id", "url")
    filed = url_filter._filed(parts, [url_filter.host_rule("rare.net", "/en/", "block"), url_filter.Rule("any", ".", (), "block", False)])
    assert {t: [r.name for r in rules] for t, rules in filed.items()} == {"rare": ["rare.net/en/"], "": ["any"]}


def test_url_rules_without_a_token_or_without_rules(spark):
    rows = pages(spark, [(1, "http://h/", "")])
    anything = url_filter.Rule("any", ".", (), "block", False)
    assert url_filter.judge_urls(rows, [anything]).first().verdict == "block"
    assert url_filter.judge_urls(rows, []).first().verdict == "allow"
    assert url_filter.judge_urls(pages(spark, []), [anything]).count() == 0


# decontamination -------------------------------------------------------------------------


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(texts, items, window):
    patterns = {}
    for item, text in items:
        words = brute_words(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            patterns.setdefault(tuple(words[i : i + m]), set()).add("" if item is None else str(item))
    out = []
    for key, text in texts:
        words, hit, found = brute_words(text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(words) - m + 1):
                items_of = patterns.get(tuple(words[i : i + m]))
                if items_of:
                    hit.update(range(i, i + m))
                    found |= items_of
        out.append((str(key), len(words), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_like_brute_force(spark, block_bytes):
    """A small block size searches the benchmark in several passes."""
    rng = random.Random(9)
    sentence = lambda n: " ".join(rng.choice("aa bb cc, É7 dd".split()) for _ in range(n))
    items = [(i, sentence(rng.randrange(1, 9))) for i in range(25)] + [(3, "aa bb aa bb"), (None, "CC dd É7"), (90, None), (91, " .,; "), (92, "zz")]
    texts = [(i, sentence(rng.randrange(60))) for i in range(40)] + MESSY
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, key string")
    for window in (4, 10):
        found = decontaminate.contamination(documents(spark, texts), bench, window=window, block_bytes=block_bytes)
        got = sorted((str(r.key), r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found.collect())
        assert got == brute_contamination(texts, items, window)


def test_contamination_of_nothing(spark):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    found = decontaminate.contamination(documents(spark, MESSY), nothing).collect()
    assert len(found) == len(MESSY) and not any(r.spans or r["items"] for r in found)
    assert decontaminate.contamination(empty(spark), nothing).count() == 0


# pieces ----------------------------------------------------------------------------------

vocabulary_file = pytest.mark.skipif(not os.path.exists(MODEL), reason="public vocabulary files are absent")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


def segmentations(word, vocabulary):
    if not word:
        yield (), 0.0
    for i in range(1, len(word) + 1):
        if word[:i] in vocabulary.pieces:
            weight, number = vocabulary.pieces[word[:i]]
            for rest, more in segmentations(word[i:], vocabulary):
                yield (number, *rest), weight + more


@vocabulary_file
@pytest.mark.parametrize("word", [" the", " thing", "ation", "   "])
def test_segmentations_are_drawn_with_their_probability(vocabulary, word):
    ways = dict(segmentations(word, vocabulary))
    total, n = sum(map(math.exp, ways.values())), 20_000
    ids, counts = pieces.sampled([word] * n, list(range(n)), vocabulary)
    ends = np.cumsum(counts)
    drawn = {}
    for end, count in zip(ends, counts):
        way = tuple(ids[end - count : end].tolist())
        drawn[way] = drawn.get(way, 0) + 1
    assert set(drawn) <= set(ways)
    for way, weight in ways.items():
        p = math.exp(weight) / total
        assert abs(drawn.get(way, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


@vocabulary_file
def test_pieces_round_trip_and_do_not_depend_on_neighbours(spark, vocabulary):
    texts = MESSY + [(50, "▁▁ \u0000\x7f 𝒳 \U0010ffff"), (51, "x" * 5000), (52, " " * 333), (53, "\n\n a\t b ")]
    encoded = pieces.encoded(documents(spark, texts), MODEL)
    rows = pieces.decoded(encoded, MODEL).collect()
    assert len(rows) == len(texts)
    assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in rows)
    again = pieces.encoded(documents(spark, texts).repartition(7), MODEL).collect()
    order = lambda rs: sorted((str(r.key), r.text or "", tuple(r.ids or ())) for r in rs)
    assert order(rows) == order(again)
    ids, counts = pieces.sampled([LONG, "a"], [pieces.row_seed(6, pieces.SEED), 1], vocabulary)
    assert ids[: counts[0]].tolist() == next(r.ids for r in rows if r.key == 6)
    assert next(r.ids for r in rows if r.key == 6) != next(r.ids for r in rows if r.key == 7)  # another seed
    assert pieces.decoded(pieces.encoded(empty(spark), MODEL), MODEL).count() == 0


# classifiers -----------------------------------------------------------------------------


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, extra string")


def good_and_bad(n):
    rng = random.Random(10)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    prose = lambda: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(60, 200)))
    junk = lambda: " | ".join(w.upper() + "!!" for w in prose().split())
    return [(i, prose() if i % 4 else junk(), int(bool(i % 4))) for i in range(n)]


def test_quality_on_held_out_rows(spark):
    made = good_and_bad(400)
    docs = documents(spark, [r[:2] for r in made] + MESSY[2:5] + [(None, "no key")])
    labels = [(i, q, None, "x") for i, _, q in made] + [(0, 1, None, None), (None, 1, None, None), (5, None, None, None), (99_999, 0, 0, "")]
    held = lambda key: key % 3 == 1
    model = quality.fit(docs, labelled(spark, labels), quality.F.col("key") % 3 != 1)
    found = quality.scores(docs, model).collect()
    assert len(found) == len(made) + 4 and all(0 <= r.score <= 1 for r in found)
    wrong = [r.key for r in found if r.key is not None and r.key > 9 and held(r.key) and (r.score >= 0.5) != bool(r.key % 4)]
    assert len(wrong) <= 4
    again = quality.fit(docs.repartition(5), labelled(spark, labels), quality.F.col("key") % 3 != 1)
    assert again == model
    blank = [r.score for r in quality.scores(documents(spark, [(1, None), (2, "")]), model).collect()]
    assert blank == [0.0, 0.0]


def test_quality_without_both_classes(spark):
    docs = documents(spark, [(1, "a text"), (2, "another"), (3, "")])
    every = quality.F.lit(True)
    assert {r.key: r.score for r in quality.scores(docs, quality.fit(docs, labelled(spark, [(1, 1, 0, "")]), every)).collect()} == {1: 2 / 3, 2: 2 / 3, 3: 0.0}
    model = quality.fit(empty(spark), labelled(spark, []), every)
    assert {r.score for r in quality.scores(docs, model).collect()} == {0.5, 0.0}
    assert quality.scores(empty(spark), model).count() == 0
    few = quality.fit(docs, labelled(spark, [(1, 1, 0, ""), (2, 0, 0, "")]), every)  # too few to calibrate
    assert {r.key: r.score for r in quality.scores(docs, few).collect()} == {1: 0.5, 2: 0.5, 3: 0.0}


def test_calibration_finds_the_weights_of_a_logistic_model():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(20_000, 2))
    y = rng.random(20_000) < quality.sigmoid(0.5 + x @ [2.0, -1.0])
    assert np.allclose(quality.calibrated(x, y.astype(float)), [0.5, 2.0, -1.0], atol=0.1)


def test_ordinal_model_recovers_order_and_shared_weights():
    rng = np.random.default_rng(12)
    words = [np.unique(rng.integers(0, 60, 8)).astype(np.int32) for _ in range(4000)]
    effect = np.linspace(-2, 2, 60)
    strength = np.array([effect[w].sum() for w in words])
    grade = np.digitize(strength + rng.logistic(size=4000), [-2, 1, 3])
    model = toxicity.fitted(words, grade, (0, 1, 2, 5))
    assert np.all(np.diff(model.thresholds) > 0)
    assert np.corrcoef(model.weights[:60], effect)[0, 1] > 0.95
    assert np.corrcoef([model.weights[w].sum() for w in words], strength)[0, 1] > 0.97


def toxic_docs(n):
    rng = random.Random(13)
    calm = [f"calm{i}" for i in range(300)]
    out = []
    for i in range(n):
        grade = (i % 9 == 0) + (i % 18 == 0)
        words = rng.choices(calm, k=80) + rng.choices(["rude", "mean"], k=2 * (grade == 1)) + rng.choices(["vile", "hateful"], k=3 * (grade == 2))
        rng.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


def test_toxicity_on_held_out_rows(spark):
    made = toxic_docs(900)
    docs = documents(spark, [r[:2] for r in made])
    labels = labelled(spark, [(i, None, g, "") for i, _, g in made] + [(2, 0, 1, ""), (None, 0, 1, "")])
    model = toxicity.fit(docs, labels, toxicity.F.col("key") % 5 != 1)
    assert model.grades == (0, 1, 2)
    found = {r.key: r for r in toxicity.severities(docs, model).collect()}
    tested = [(i, g) for i, _, g in made if i % 5 == 1]
    assert sum(found[i].grade != g for i, g in tested) <= 5
    mean = lambda g: np.mean([found[i].severity for i, x in tested if x == g])
    assert mean(0) < 0.2 < mean(1) < mean(2)
    blank = toxicity.severities(documents(spark, MESSY), model).collect()
    assert len(blank) == len(MESSY) and all(0 <= r.severity <= 2 for r in blank)


def test_toxicity_without_two_grades(spark):
    docs = documents(spark, MESSY)
    for rows, grade in (([], 0), ([(1, 0, 1, "")], 1)):
        model = toxicity.fit(docs, labelled(spark, rows), toxicity.F.lit(True))
        assert {(r.severity, r.grade) for r in toxicity.severities(docs, model).collect()} == {(float(grade), grade)}
    assert toxicity.severities(empty(spark), model).count() == 0


def test_a_worker_that_forgets_words_draws_the_same_pieces(vocabulary, monkeypatch):
    texts = [LONG[:3000], "aab bba  abab aab", "", "ßé漢 🙂 aab", LONG[2000:6000], "aab bba  abab aab"]
    seeds = list(range(len(texts)))
    fresh = pieces.Vocabulary(MODEL)
    whole = pieces.sampled(texts, seeds, fresh)
    monkeypatch.setattr(pieces, "MOST_WAYS", 300)
    small = pieces.Vocabulary(MODEL)
    for _ in range(2):
        parts = [pieces.sampled([t], [s], small) for t, s in zip(texts, seeds)]
        assert [x for ids, _ in parts for x in ids.tolist()] == whole[0].tolist()
        assert [int(c[0]) for _, c in parts] == whole[1].tolist()
    assert len(small.known.number) < len(fresh.known.number)
    assert list(pieces.meanings_of(MODEL)) == fresh.meaning
