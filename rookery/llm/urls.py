"""URL filters: pattern rules found by their rarest literal token.

Rules are written as in common block lists: ``||`` begins at a host label, ``|`` is an end of the
URL, ``*`` any text, ``^`` a separator or the end, and ``@@`` in front makes an exception. Case doesn't
matter. A rule's literal tokens are its runs of letters and digits that any URL it matches must have as
whole runs. Each rule is filed under the one that the fewest URLs have; a URL's tokens fetch
its candidates, and only those run their regular expressions. Rules without such a token are
candidates of every URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import col, table

#: Rules that op7 applies to ``pages``.
RULES = (
    "||example.net^", "@@||example.net/en/*", "||m.*.example.com^", "||example.org/de/", "/fr/8*?page=", "?page=2&ref=x|", "#top|", "/es/1", "||www.*^en^",
    "ref=x", "@@/en/7", "|http://th", "/de/*#top", "||ththre.example.com^", "/en/42|", "/en/1?page=", ".org/fr/", "||example.org^es^", "@@||m.*/es/*?page", "/login", "/tag/*/feed",
    "||ads.example.com^", "&utm_source=", "/print/", "sessionid=", "@@|https://*.example.org/fr/2", "/de/5*|", "^page=2^", "||tracker.example.net^", "/cgi-bin/", "||nosuch.invalid^", "/wp-admin/",
)
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


def compile_rule(rule: str) -> tuple[str, list[str], bool]:
    """A rule's regular expression (the same in Java, Python and RE2), its safe tokens, and whether it is an exception."""
    text = rule.lower()
    allow = text.startswith("@@")
    text = text[2 * allow :]
    host = text.startswith("||")
    begin = not host and text.startswith("|")
    text = text[2 if host else 1 if begin else 0 :]
    end = text.endswith("|")
    body = text[: len(text) - end]
    parts = ["^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.])?" if host else "^" if begin else ""]
    for c in body:
        plain = not c.isascii() or c.isalnum() or c in "_ "
        parts.append(".*" if c == "*" else _SEPARATOR if c == "^" else c if plain else "\\" + c)
    parts.append("$" if end else "")
    tokens = []
    for m in re.finditer("[a-z0-9]+", body):
        before, after = body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1]
        closed_left = before not in ("", "*") or (m.start() == 0 and (host or begin))
        closed_right = after not in ("", "*") or (m.end() == len(body) and end)
        if closed_left and closed_right:
            tokens.append(m[0])
    return "".join(parts), sorted(set(tokens)), allow


def _distinct(rules: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(r for r in rules if r and r.strip("*|@")))


def _rules(spark: SparkSession, rules: Sequence[str]) -> DataFrame:
    rows = []
    for rule in _distinct(rules):
        regex, tokens, allow = compile_rule(rule)
        rows.append((rule, regex, allow, tokens))
    return spark.createDataFrame(rows, "rule string, regex string, allow boolean, tokens array<string>")


def matches(urls: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """(url, rule, allow) for each distinct URL in column ``url`` and each rule that matches it.

    Which join the small side of rules and tokens gets is left to the planner, which knows
    its size. Null and empty URLs match no rule with a token; whole URLs are matched, however long. Of a rule's equally rare tokens the
    first in order files it, which changes nothing in the result. Empty rules are ignored, repeated ones count once; no URLs or no rules give no rows.
    """
    spark = urls.sparkSession
    lower = urls.where(F.col("url").isNotNull()).select("url").distinct().withColumn("low", F.lower("url"))
    tokens = lower.select("url", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), 0))).alias("token"))
    known = _rules(spark, rules)
    wanted = known.select("rule", F.explode("tokens").alias("token"))
    seen = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    filed = known.join(rarest, "rule").select("rule", "regex", "allow", "token")
    fetched = tokens.join(filed, "token").select("url", "low", "rule", "regex", "allow")
    # rules without a token come with every URL, in the row itself
    unfiled = [(r, regex, allow) for r, (regex, tokens_, allow) in ((r, compile_rule(r)) for r in _distinct(rules)) if not tokens_]
    if unfiled:
        listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(x).alias("regex"), F.lit(a).alias("allow")) for r, x, a in unfiled])
        fetched = fetched.unionAll(lower.select("url", "low", F.inline(listed)))
    return fetched.where(F.regexp_like("low", F.col("regex"))).select("url", "rule", "allow")


def filtered(pages: DataFrame, rules: Sequence[str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row (page_id, url, rules, blocked) for every row of ``pages``.

    rules lists the matching rules in order, separated by spaces, '' if there are none. A page is
    blocked if a rule matches that isn't an exception, and no exception does. Null URLs
    match nothing and aren't blocked. Repeated rows stay; other columns are left out.
    """
    slim = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"))
    found = matches(slim, rules).groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("rule")), " ").alias("rules"), (~F.bool_or("allow")).alias("blocked"))
    return slim.join(found, "url", "left").select("page_id", "url", F.coalesce("rules", F.lit("")).alias("rules"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(r)}, {quote(compile_rule(r)[0])}, {str(compile_rule(r)[2]).lower()})" for r in RULES)
    return f"""
WITH rules(rule, regex, allow) AS (VALUES {rows}),
found AS (
  SELECT u.url, string_agg(rule, ' ' ORDER BY encode(rule)) AS rules, NOT bool_or(allow) AS blocked
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) u JOIN rules ON regexp_matches(lower(u.url), regex) GROUP BY u.url
)
SELECT p.page_id, p.url, coalesce(f.rules, '') AS rules, coalesce(f.blocked, false) AS blocked FROM pages p LEFT JOIN found f ON p.url = f.url
"""


SQL = _sql()
