"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, exact_dedup, html_text, line_dedup, phrases, pieces, quality, resampling, simhash, suffix_dedup, token_files, toxicity, url_filter
from .common import held_out, table


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.main_text(table(spark, folder, "pages"))
    n_chars = F.length("text").cast("bigint").alias("n_chars")
    return found.select(F.col("key").alias("page_id"), "url", "text", n_chars, "n_lines", "n_shared")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.without_repeated_strings(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "spans",
    )


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.duplicate_groups(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP4_SQL = r"""
with t as (
    select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
    from documents
)
select doc_id,
       min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id) = 1 as kept,
       text_sha256
from t
"""


# The host rules of the query, as (host, path, verdict).
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = [url_filter.host_rule(*rule) for rule in URL_RULES] + url_filter.spam_rules()
    return url_filter.judge_urls(table(spark, folder, "pages"), rules).withColumnRenamed("key", "page_id").select(
        "page_id", "host", "path", "rule", "verdict", "pattern"
    )


def _op6_sql() -> str:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
    words = ", ".join(f"('{word}')" for word in url_filter.SPAM_WORDS)
    return rf"""
with p as (
    select row_number() over () as n, page_id,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
    from pages
), rules(h, p, verdict) as (values {rules}), words(word) as (values {words}),
hosts as (
    select n, max(struct_pack(length := length(h || r.p), rule := h || r.p, verdict := verdict)) as best
    from p join rules r on (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, r.p)
    group by n
), spam as (
    select n, max(word) as pattern
    from p join words on regexp_matches(host || path, '(?i)(?:^|[./_-])' || word || '(?:[./_-]|$)')
    group by n
)
select page_id, host, path, best.rule as rule,
       coalesce(best.verdict, case when pattern is not null then 'block' else 'allow' end) as verdict,
       case when best is null then pattern end as pattern
from p left join hosts using (n) left join spam using (n)
"""


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
with d as (
    select row_number() over () as n, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), b as (
    select cast(item_id as varchar) as item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), wins as (
    select distinct item, least(10, len(w)) as m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
    from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)
), lens as (select distinct m from wins),
cuts as (
    select n, m, i, array_to_string(w[i : i + m - 1], ' ') as win
    from (select n, w, m, unnest(range(1, len(w) - m + 2)) as i from d, lens where len(w) >= m)
), hits as (select n, i, m, item from cuts join wins using (m, win)),
covered as (
    select n, count(*) as n_hit
    from (select distinct n, unnest(range(i, i + m)) as at from (select distinct n, i, m from hits)) group by n
), named as (
    select n, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct n, item from hits) group by n
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (n) left join named using (n)
"""


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.without_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))


OP8_SQL = rf"""
with raw as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
parts as (
    select doc_id, i, lines[i] as line, regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as trimmed
    from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from raw)
), solid as (
    select doc_id, i, trimmed, row_number() over (partition by doc_id order by i) as n from parts where trimmed <> ''
), windows as (
    select doc_id, n, [trimmed, {", ".join(f"lead(trimmed, {k}) over w" for k in range(1, line_dedup.RUN))}] as win,
           lead(n, {line_dedup.RUN - 1}) over w as upto
    from solid window w as (partition by doc_id order by n)
), ordered as (
    select doc_id, n, row_number() over (partition by win order by doc_id, n) as occurrence from windows where upto is not null
), gone as (
    select distinct doc_id, unnest(range(n, n + {line_dedup.RUN})) as n from ordered where occurrence > 1
), marked as (
    select p.doc_id, p.i, p.line, s.n is not null as is_line, g.n is not null as is_gone
    from parts p left join solid s using (doc_id, i) left join gone g on p.doc_id = g.doc_id and s.n = g.n
)
select r.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
       case when r.text is null then null else coalesce(kept, '') end as kept_text
from raw r left join (
    select doc_id, count_if(is_line) as n_lines, count_if(is_gone) as n_removed,
           string_agg(line, chr(10) order by i) filter (where not is_gone) as kept
    from marked group by doc_id
) m on r.doc_id = m.doc_id
"""


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
        "size",
    )


#: Where the public vocabulary files lie; every executor has them.
TOKENIZERS = "/opt/tokenizers"
PIECE_MODEL = "piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    model_file = f"{tokenizers}/{PIECE_MODEL}"
    rows = pieces.decoded(pieces.encoded(table(spark, folder, "documents"), model_file), model_file)
    return rows.select(
        F.col("key").alias("doc_id"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids"),
        "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = quality.fit(documents, table(spark, folder, "labels"), ~held_out(F.col("key")))
    return quality.scores(documents, model).select(
        F.col("key").alias("doc_id"),
        held_out(F.col("key")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Grades are those that ``labels.toxic`` holds; a text counts as toxic from half a grade on."""
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"), ~held_out(F.col("key")))
    return toxicity.severities(documents, model).select(
        F.col("key").alias("doc_id"), "severity", "grade", (F.col("severity") >= 0.5).alias("toxic")
    )


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=5)
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


OP11_SQL = r"""
with folds as (
    select 0 as side, row_number() over () as n, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
    union all
    select 1, row_number() over (), null,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    from benchmark
), feats as (
    select side, n, array_to_string(w[i : i + k - 1], ' ') as feature
    from (select side, n, w, k, unnest(range(1, len(w) - k + 2)) as i from folds, range(1, 4) as sizes(k) where len(w) >= k)
), counted as (select side, n, feature, count(*) as c from feats group by all),
steps as (
    select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as step
), sums as (
    select feature, xor(list_reduce(
        list_transform(range(octet_length(encode(feature))), lambda i: cast('0x' || substr(hex(encode(feature)), cast(2 * i + 1 as int), 2) as bigint)),
        lambda c, b: xor(c >> 8, step[cast(xor(c, b) & 255 as int) + 1]), 4294967295), 4294967295) % 10000 as bucket
    from (select distinct feature from counted), steps
), held as (select side, n, c, bucket from counted join sums using (feature)),
totals as (
    select bucket, coalesce(sum(c) filter (where side = 0), 0) as s, coalesce(sum(c) filter (where side = 1), 0) as t
    from (select side, bucket, c from held union all select 0, range, 0 from range(10000)) group by bucket
), gains as (
    select bucket, cast(floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double
                                        / ((s + 1)::double * (sum(t) over () + 10000)::double))) as bigint) as gain
    from totals
), weighed as (select n, sum(c) as n_features, sum(c * gain) as weight from held join gains using (bucket) where side = 0 group by n),
scored as (
    select f.n, doc_id, len(w) as n_words, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
           cast(coalesce(weight, 0) as bigint) + cast(floor(-1000 * ln(-ln((
               cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
    from folds f left join weighed using (n) where side = 0
), drawn as (
    select n, row_number() over (order by score desc, doc_id nulls last, n_features) as place
    from scored where n_words >= 20
)
select doc_id, n_features, weight, score,
       case when place <= (select 5 * count(*) // 100 from drawn) then place end as rank
from scored left join drawn using (n)
"""


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


OP13_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, row_number() over () as piece, regexp_extract_all(words, '[^\x20\x09]+') as w
    from (select lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as words
        from documents)
), runs as (
    select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, 4) as sizes(k) where len(w) >= k)
    group by all
), totals as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
candidates as (select lang, k as size, phrase, f as a, string_split(phrase, ' ') as w from runs where k > 1 and f >= 10),
cuts as (
    select lang, size, phrase, a, k, array_to_string(w[1 : k], ' ') as head, array_to_string(w[k + 1 : size], ' ') as tail
    from (select *, unnest(range(1, size)) as k from candidates)
), best as (
    select lang, phrase, a, l, r, score from (
        select c.lang, c.phrase, c.a, h.f as l, t.f as r, c.k,
               cast(cast(1000000 as hugeint) * c.a * c.a // (cast(h.f as hugeint) * t.f) as bigint) as score
        from cuts c join runs h on c.lang = h.lang and c.head = h.phrase join runs t on c.lang = t.lang and c.tail = t.phrase
    ) qualify row_number() over (partition by lang, phrase order by score, k) = 1
), held as (
    select lang, inner_phrase as phrase, max(a) as longer
    from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as inner_phrase
          from candidates where size = 3)
    group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best left join held using (lang, phrase) join totals using (lang)
where longer is null or 100 * longer < 50 * a
qualify rank <= 2000
"""


TOKEN_VOCABULARY = "byte_bpe_50k.json"
TOKEN_END = 2


def op12_token_files(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    vocabulary = f"{tokenizers}/{TOKEN_VOCABULARY}"
    found = token_files.written_and_read(table(spark, folder, "documents"), vocabulary, TOKEN_END)
    return found.select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op5_sentencepiece": op5_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_resampling": op11_resampling,
    "op12_token_files": op12_token_files,
    "op13_phrases": op13_phrases,
}
CHECKS = {
    "op4_exact_dedup": OP4_SQL,
    "op6_url_filter": _op6_sql(),
    "op8_line_dedup": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_resampling": OP11_SQL,
    "op13_phrases": OP13_SQL,
}


def llm_queries() -> dict:
    return dict(QUERIES)


def llm_checks() -> dict[str, str]:
    return dict(CHECKS)
