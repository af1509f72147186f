"""URL filtering by pattern rules, indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL it matches must hold, or with
several lists of tokens, one of which every such URL holds in full. The rule is filed, once per list,
under that one of its tokens which the fewest URLs of the table hold. The tokens of a URL fetch
the rules filed under them by an equi-join, and only these candidates run their expression.

Two kinds of rules exist: site rules (host and path, fitting the host and all its subdomains; the longest
wins) and word rules (any expression over the URL), which judge the URLs that no site rule fits.

The work runs on distinct URLs, so a URL repeated a million times is judged once. Rule lists of any
length are tables; Spark broadcasts them only where their measured size allows it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str       # shown in the result; for site rules host and path, as `example.net/en/`
    verdict: str    # block or allow
    pattern: str    # over host + path + rest, host lower-cased
    tokens: tuple[str, ...]
    site: bool
    others: tuple[tuple[str, ...], ...] = ()   # tokens of other forms, such as one without an optional hyphen


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a beginning of the path.

    Tokens of the path count only where a separator closes them, since the URL's path may go on.
    """
    whole = re.findall(TOKEN + "(?=[^a-z0-9])", path.lower())
    quoted = "".join(c if re.fullmatch("[A-Za-z0-9/]", c) else "\\" + c for c in host.lower())
    tail = "".join(c if re.fullmatch("[A-Za-z0-9/]", c) else "\\" + c for c in path)
    return Rule(host.lower() + path, verdict, rf"^([^/?#]*\.)?{quoted}" + (tail or "([/?#]|$)"),
                tuple(re.findall(TOKEN, host.lower())) + tuple(whole), True)


def word_rule(verdict: str, pattern: str, *tokens: str, others: tuple[tuple[str, ...], ...] = ()) -> Rule:
    """A rule for any expression. Tokens count only where the expression closes them at both ends."""
    return Rule(pattern, verdict, pattern, tokens, False, others)


# The site rules asked for.
SITE_RULES = [
    site_rule("block", "net", "/"),
    site_rule("allow", "example.net", "/en/"),
    site_rule("block", "example.com", "/de/"),
    site_rule("allow", "org", "/fr/"),
]

# Word rules for hosts and paths that training text should not come from.
WORD_RULES = [
    word_rule("block", r"(^|[.-])spam-?farm[.-]", "spam", "farm", others=(("spamfarm",),)),
    word_rule("block", r"(^|[./-])link-farm([./-]|$)", "link", "farm"),
    word_rule("block", r"(^|[./-])casino([./-]|$)", "casino"),
    word_rule("block", r"(^|[./-])poker([./-]|$)", "poker"),
    word_rule("block", r"(^|[./-])porn([./-]|$)", "porn"),
    word_rule("block", r"(^|[./-])xxx([./-]|$)", "xxx"),
    word_rule("block", r"(^|[./-])adult-content([./-]|$)", "adult", "content"),
    word_rule("block", r"(^|[./-])malware([./-]|$)", "malware"),
    word_rule("block", r"^ads?[.-]", "ad"),
    word_rule("block", r"^ads?[.-]", "ads"),
    word_rule("block", r"/ads/", "ads"),
    word_rule("block", r"/click-?track/", "click", "track", others=(("clicktrack",),)),
    word_rule("block", r"/wp-login\.php", "wp", "login"),
]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per rule and list of tokens; rule_id is in the order of the rules."""
    forms = [(r, tokens) for r in rules for tokens in (r.tokens, *r.others)]
    rows = [(i, r.name, r.verdict, r.pattern, list(tokens), r.site) for i, (r, tokens) in enumerate(forms)]
    return spark.createDataFrame(
        rows, "rule_id int, name string, verdict string, pattern string, tokens array<string>, site boolean")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, matched (name of the rule that decided, word rules included).

    `rules` is a table as rule_table makes it. Of several site rules that fit, the longest name wins, then
    the first in letter order; among word rules the first listed. Without any, the verdict is allow. A URL
    that is null or has no `://` has an empty host and path, and no rule fits. Repeated rows are judged
    row by row; an empty table gives no rows; other columns are ignored.
    """
    clean = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    # what follows `://`, its host lower-cased, is what the expressions see
    rest = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)$", 1)
    urls = clean.select("url").where(F.instr("url", "://") > 0).distinct().select(
        "url", F.concat(host_of(F.col("url")), rest).alias("seen"))
    held = urls.select("url", "seen", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("seen"), F.lit(f"({TOKEN})"), 1))).alias("token"))

    # the rarest token of each rule over this table
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    often = held.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    filed = (
        wanted.join(often, "token", "left")
        .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token"))
        .join(rules.drop("tokens"), "rule_id")
    )
    fits = held.join(filed, "token").where(F.expr("seen RLIKE pattern"))
    best = fits.groupBy("url").agg(
        F.min(F.when(F.col("site"), F.struct(-F.length("name"), "name", "verdict"))).alias("site_rule"),
        F.min(F.when(~F.col("site"), F.struct("rule_id", "name", "verdict"))).alias("word_rule"))
    return clean.join(best, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("site_rule.name").alias("rule"),
        F.coalesce("site_rule.verdict", "word_rule.verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("site_rule.name", "word_rule.name").alias("matched"))


def oracle() -> str:
    """The same judgement as plain conditions, for the rules above."""
    words = "\n".join(
        f"            WHEN seen <> '' AND regexp_matches(seen, '{r.pattern}') THEN '{r.pattern}'" for r in WORD_RULES)
    return f"""
WITH parts AS (
    SELECT page_id, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(.*)$', 1), '') AS rest
    FROM pages),
seen AS (SELECT page_id, coalesce(host, '') AS host, path, coalesce(host, '') || rest AS seen FROM parts),
ruled AS (
    SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                   WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                   WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
           CASE
{words}
           END AS word
    FROM seen)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
       coalesce(rule, word) AS matched
FROM ruled
"""
