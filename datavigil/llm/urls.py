"""Operator 5: URL filter with a weighted vocabulary, found by an Aho-Corasick automaton with boundary checks, under a list
of host and path rules that comes first. One pass, no shuffle."""

from __future__ import annotations

from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One of these rejects a URL.
STRICT = ("adult", "casino", "escort", "gambling", "hentai", "malware", "nude", "phishing", "porn", "porno", "sex", "viagra",
          "warez", "xxx")
#: Several different ones of these reject a URL; the number is the weight of the term.
SOFT = {"ads": 1, "babes": 1, "bet": 1, "bets": 1, "cheap": 1, "crack": 1, "dating": 1, "farm": 1, "free": 1, "hot": 1, "jackpot": 1,
        "keygen": 1, "loan": 1, "loans": 1, "pill": 1, "pills": 1, "poker": 1, "replica": 1, "slots": 1, "spam": 1, "torrent": 1,
        "track": 1, "win": 1}
SOFT_LIMIT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_FOUND = T.StructType([T.StructField("strict", T.IntegerType()), T.StructField("soft", T.IntegerType())])

Rule = tuple[str, str, str]


@cache
def _automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term, weight in terms:
        automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def _hits(url: str, automaton: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict terms, and the weight of the distinct soft terms, that stand between boundaries."""
    found = {}
    for last, (term, weight) in automaton.iter(url):
        first = last - len(term) + 1
        if (first == 0 or url[first - 1] not in _WORD) and (last + 1 == len(url) or url[last + 1] not in _WORD):
            found[term] = weight
    return sum(w < 0 for w in found.values()), sum(w for w in found.values() if w > 0)


def vocabulary_hits(url: Column, strict=STRICT, soft=None) -> Column:
    """Struct (strict, soft) of a lower-cased URL; a null URL has no hits."""
    soft = SOFT if soft is None else soft
    terms = tuple(sorted({**{t: w for t, w in soft.items()}, **{t: -1 for t in strict}}.items()))

    @F.arrow_udf(_FOUND)
    def hits(urls: pa.Array) -> pa.Array:
        if not terms:
            counts = [(0, 0)] * len(urls)
        else:
            automaton = _automaton(terms)
            counts = [_hits(u, automaton) if u else (0, 0) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([c[i] for c in counts], pa.int32()) for i in (0, 1)], ["strict", "soft"])

    return hits(url)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, empty for a null URL or one without `://`."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    has = F.coalesce(at > 0, F.lit(False))
    host = F.when(has, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")
    return host, F.when(has, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and what it says; null where none fits. Of equal lengths the longer host wins,
    then the first in order of text."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, says = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, verdict).otherwise(says)
    return name, says


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", strict=STRICT, soft=None,
          soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """pages with host, path, rule, n_strict, soft_weight and verdict (allow or block).

    The longest rule (host with all subdomains, begin of the path) decides; without one a URL is blocked if it holds a
    strict term or soft terms of weight soft_limit together. Terms count once each, in the lower-cased URL, and only if no
    letter a-z or digit stands next to them. A null or empty URL fits no rule and is allowed. URLs of any length are read
    whole. Columns of pages with these names are replaced.
    """
    url = F.col(f"`{url_col}`")
    host, path = split_url(url)
    out = pages.withColumns({"host": host, "path": path})
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_says": says, "_hits": vocabulary_hits(F.translate(url, UPPER, LOWER), strict, soft)})
    bad = (F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= soft_limit)
    return out.withColumns({"n_strict": F.col("_hits.strict"), "soft_weight": F.col("_hits.soft"), "verdict": F.coalesce(
        "_says", F.when(bad, "block").otherwise("allow"))}).drop("_says", "_hits")


def judge_sql(rules: list[Rule], strict=STRICT, soft=None, soft_limit: int = SOFT_LIMIT) -> str:
    """The same over the table pages for a SQL engine with RE2 patterns."""
    soft = SOFT if soft is None else soft

    def has(term: str) -> str:
        return f"CAST(regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INTEGER)"

    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    return f"""
    WITH cut AS (
      SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
      FROM pages
    ), parts AS (
      SELECT page_id, low, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM cut
    ), counted AS (
      SELECT *, {' + '.join(map(has, strict))} AS n_strict, {' + '.join(f'{w} * {has(t)}' for t, w in soft.items())} AS soft_weight
      FROM parts
    )
    SELECT page_id, host, path, {rule} AS rule, n_strict, CAST(soft_weight AS INTEGER) AS soft_weight,
           coalesce({says}, CASE WHEN n_strict > 0 OR soft_weight >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict
    FROM counted"""
