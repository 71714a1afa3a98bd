"""URL filter: host rules, and a weighted vocabulary counted with an Aho-Corasick automaton."""

from __future__ import annotations

from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import ascii_lower

# One of these as a whole word of the URL rejects it.
STRICT = ("adult-x", "camgirl", "casino", "cialis", "escort", "hentai", "keygen", "malware", "porn", "viagra", "warez", "xxx")
# Each is harmless alone, several distinct ones reject the URL.
SOFT = (
    "ads", "adult", "banner", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "farm", "free", "gambling",
    "loan", "nude", "pills", "poker", "popup", "promo", "sex", "slots", "spam", "torrent", "track", "tracker", "win",
)
#: Weights: a strict term reaches the limit alone, soft terms reach it together.
SOFT_LIMIT = 2
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

# Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@cache
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """The vocabulary as one automaton; a term in both lists is strict."""
    machine = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (SOFT_LIMIT, strict)):
        for term in terms:
            machine.add_word(term, (weight, term))
    machine.make_automaton()
    return machine


def count_terms(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and distinct soft terms of a lower-cased URL that stand between boundaries."""
    if not url or not (strict or soft):
        return 0, 0
    found = set()
    for end, (weight, term) in automaton(strict, soft).iter(url):
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in WORD) and (end + 1 == len(url) or url[end + 1] not in WORD):
            found.add((weight, term))
    heavy = sum(weight > 1 for weight, _ in found)
    return heavy, len(found) - heavy


def term_counter(strict: tuple[str, ...], soft: tuple[str, ...]):
    @F.pandas_udf("strict int, soft int")
    def counts(urls: pd.Series) -> pd.DataFrame:
        rows = [count_terms(url, strict, soft) for url in urls]
        return pd.DataFrame(rows, columns=["strict", "soft"], index=urls.index).astype("int32")

    return counts


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first '://', A-Z lower-cased, and the path up to '?' or '#'; both empty without '://'."""
    start = F.instr(url, "://")
    rest = F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))
    pattern = "^([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(rest, pattern, 1)), F.regexp_extract(rest, pattern, 2)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    df: DataFrame, key: str = "page_id", url: str = "url", *, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT
) -> DataFrame:
    """Allow or block every row of `df` by its URL.

    A fitting host rule decides, the longest first. Otherwise the vocabulary does: terms count as whole words (no
    a-z, 0-9 at either side) of the URL with A-Z lower-cased; one strict term or `soft_limit` distinct soft terms
    block, everything else is allowed. One row leaves for each that enters, repeated rows too.

    A null URL, an empty one and one without '://' have empty host and path and fit no rule; a null URL has no term
    and is allowed. Columns beyond `key` and `url` are not read, so their names can't clash. An empty table gives an
    empty table. The automaton holds the vocabulary only; a URL is scanned once, however long.
    """
    host, path = host_and_path(F.col("_url"))
    rows = df.select(F.col(key).alias(key), F.col(url).alias("_url")).select(key, "_url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict)
    rows = rows.withColumn("_hits", term_counter(tuple(strict), tuple(soft))(ascii_lower(F.col("_url"))))
    rejected = (F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= soft_limit)
    method = F.when(rejected, "block").otherwise("allow")
    return rows.select(
        key, "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"),
        F.col("_hits.strict").alias("strict_hits"), F.col("_hits.soft").alias("soft_hits"),
    )


def judge_urls_sql() -> str:
    """`judge_urls` on `pages` for DuckDB."""
    lists = {name: "[" + ", ".join(f"'{t}'" for t in terms) + "]" for name, terms in (("strict", STRICT), ("soft", SOFT))}
    hits = "len(list_filter({}, lambda t: regexp_matches(lower_url, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))::INTEGER"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [(k, d + p, f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')") for k, d, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{name}'" for _, name, f in fits)
    verdict = " ".join(f"WHEN {f} THEN '{kind}'" for kind, _, f in fits)
    return f"""
WITH split AS (
  SELECT page_id, translate(url, '{UPPER_SQL}', '{LOWER_SQL}') AS lower_url,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, lower_url, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER_SQL}', '{LOWER_SQL}') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM split),
counted AS (
  SELECT *, CASE WHEN lower_url IS NULL THEN 0 ELSE {hits.format(lists['strict'])} END AS strict_hits,
         CASE WHEN lower_url IS NULL THEN 0 ELSE {hits.format(lists['soft'])} END AS soft_hits
  FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
       COALESCE(CASE {verdict} END, CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits
FROM counted"""


UPPER_SQL, LOWER_SQL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
