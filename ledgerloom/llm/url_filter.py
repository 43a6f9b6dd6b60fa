"""Judging URLs by rules that are indexed by their rarest literal token.

Every rule is a regular expression over host + path together with the literal tokens that any
URL it fits must contain. A rule is filed under the one of its tokens that the URLs hold least
often; the tokens of a URL fetch the rules filed under them, and only those are run. Rules without a
token are run for every URL. Host rules come before pattern rules; among host rules the longest
wins, then the greater text; among pattern rules blocking wins.

A list of up to ``INLINE_RULES`` rules is a map inside the plan, so that judging is a scan without a
shuffle; a longer list is joined by token, with the same results.

Defined cases: a null URL or one without ``://`` has an empty host and path, and is judged like
any other; rows are judged one by one, so repeated rows and null keys come out as they went in;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

INLINE_RULES = 200
ALLOW, BLOCK = "allow", "block"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    of_host: bool


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and all its subdomains where the URL's path starts with ``path``."""
    # The last token of a path that ends inside a word may go on in the URL.
    whole = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)
    ends = r"(?=/|\z)" if not path else ""
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}{ends}"
    return Rule(host + path, regex, (*_tokens(host), *_tokens(whole)), verdict, True)


def word_rule(word: str, verdict: str = BLOCK) -> Rule:
    """Fits where the word stands between separators of the host or path."""
    return Rule(word, rf"(?i)(?:^|[./_-]){re.escape(word)}(?:[./_-]|\z)", tuple(_tokens(word)), verdict, False)


# Words that mark betting, adult, dating, counterfeit and tracking sites.
SPAM_WORDS = (
    "ads-track", "adult", "bet", "bets", "betting", "casino", "cheap-pills", "clickbait", "dating",
    "escort", "free-bets", "jackpot", "lottery", "malware", "phishing", "pills", "poker", "porn",
    "replica", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx",
)


def spam_rules() -> list[Rule]:
    return [word_rule(word) for word in SPAM_WORDS]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def _parts(pages: DataFrame, key: str, url: str) -> DataFrame:
    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    subject = F.concat("host", "path")
    words = F.split(F.translate(subject, UPPER, LOWER), "[^a-z0-9]+")
    return parts.withColumns({"subject": subject, "tokens": F.array_distinct(F.filter(words, lambda t: t != ""))})


def _filed(parts: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; at most one count per literal token is gathered."""
    literal = sorted({t for rule in rules for t in rule.tokens})
    seen = {}
    if literal:
        counts = parts.select(F.explode("tokens").alias("token")).where(F.col("token").isin(literal))
        seen = {r.token: r["count"] for r in counts.groupBy("token").count().collect()}
    filed: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (seen.get(t, 0), t), default="")
        filed.setdefault(rarest, []).append(rule)
    return filed


def _fields(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.of_host).alias("of_host"),
        F.lit(len(rule.name) if rule.of_host else 0).alias("length"),
        F.lit(rule.verdict == BLOCK).alias("blocks"),
        F.lit(rule.name).alias("name"),
        F.lit(rule.regex).alias("regex"),
    )


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """One row per page: key, host, path, rule (the host rule that decides), pattern (the pattern rule
    that decides), verdict. A URL that no rule fits is allowed."""
    parts = _parts(pages, key, url)
    filed = _filed(parts, rules) if rules else {}
    if not rules:
        best = parts.withColumn("best", F.expr("cast(null as struct<of_host: boolean, length: int, blocks: boolean, name: string>)"))
    elif len(rules) <= inline:
        best = _judged_inline(parts, filed)
    else:
        best = _judged_by_join(parts, filed)
    is_host = F.col("best.of_host")
    return best.select(
        "key",
        "host",
        "path",
        F.when(is_host, F.col("best.name")).alias("rule"),
        F.when(~is_host, F.col("best.name")).alias("pattern"),
        F.when(F.col("best.blocks"), BLOCK).otherwise(ALLOW).alias("verdict"),
    )


def _judged_inline(parts: DataFrame, filed: dict[str, list[Rule]]) -> DataFrame:
    cells = [x for token, found in filed.items() for x in (F.lit(token), F.array(*map(_fields, found)))]
    index = F.create_map(*cells)
    # The empty token stands for the rules that have none.
    asked = F.filter(F.concat(F.array(F.lit("")), F.col("tokens")), lambda t: F.map_contains_key(index, t))
    candidates = F.flatten(F.transform(asked, lambda t: F.element_at(index, t)))
    fits = F.filter(candidates, lambda rule: F.rlike(F.col("subject"), rule["regex"]))
    return parts.withColumn("best", F.array_max(fits))


def _judged_by_join(parts: DataFrame, filed: dict[str, list[Rule]]) -> DataFrame:
    """Each URL text is judged once, so that a page that many rows repeat is no hot key."""
    spark = parts.sparkSession
    rows = [(t, r.of_host, len(r.name) if r.of_host else 0, r.verdict == BLOCK, r.name, r.regex) for t, found in filed.items() for r in found]
    kinds = "token string, of_host boolean, length int, blocks boolean, name string, regex string"
    index = spark.createDataFrame(rows, kinds)
    texts = parts.select("subject", "tokens").distinct()
    asked = texts.select("subject", F.explode(F.concat(F.array(F.lit("")), F.col("tokens"))).alias("token"))
    rule = F.struct("of_host", "length", "blocks", "name", "regex")
    best = (
        asked.join(index, "token")
        .where(F.rlike(F.col("subject"), F.col("regex")))
        .groupBy(F.col("subject").alias("judged"))
        .agg(F.max(rule).alias("best"))
    )
    return parts.join(best, F.col("subject") == F.col("judged"), "left")
