"""Column expressions for text, numbers and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: the 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Fixed value: what counts as blank, Unicode spaces and the four separator controls included.
BLANK = r"(?U)[\s\x1c-\x1f]"

# Fixed value: the same characters, spelled out for trimming.
BLANK_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once per row, however often the body uses it. Inside
    lambdas Spark shares no sub-expressions, so costly ones are bound this way."""
    return F.transform(F.array(value), body)[0]


def present(c: Column) -> Column:
    """The value, with the empty string read as absent."""
    return F.nullif(c, F.lit(""))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def trim_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when one of the literal strings occurs (case-sensitive)."""
    quoted = "|".join("\\Q" + n + "\\E" for n in needles)
    return c.rlike(quoted)


def reads_as_float(c: Column) -> Column:
    return trim_blank(c).rlike(_FLOAT)


def as_float(c: Column) -> Column:
    """Number written in `c`, underscores between digits allowed; null when it is none."""
    t = F.lower(F.regexp_replace(trim_blank(c), "_", ""))
    bare = F.regexp_replace(t, r"^[+-]", "")
    special = (
        F.when(bare == "nan", F.lit(float("nan")))
        .when(bare.isin("inf", "infinity") & t.startswith("-"), F.lit(float("-inf")))
        .when(bare.isin("inf", "infinity"), F.lit(float("inf")))
        .otherwise(F.expr("CAST(NULL AS DOUBLE)"))
    )
    return F.when(reads_as_float(c), F.coalesce(special, t.try_cast("double")))


def loose_number(c: Column) -> Column:
    """Number after dropping $ % and comma; anything unreadable is infinity."""
    return F.coalesce(as_float(F.translate(c, "$%,", "")), F.lit(float("inf")))


def equal_numbers(a: Column, b: Column) -> Column:
    """Plain float equality: unlike SQL, NaN equals nothing."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def squeeze(c: Column, drop_punctuation: bool = True) -> Column:
    """Lower case without blanks, and without punctuation unless told otherwise."""
    s = F.lower(F.regexp_replace(c, BLANK, ""))
    return F.translate(s, PUNCTUATION, "") if drop_punctuation else s


def snake_name(c: Column) -> Column:
    return F.translate(F.lower(c), " -", "__")


_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(c: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; '' where absent."""
    clean = F.regexp_replace(c, r"^[\x00-\x20]+|[\t\r\n]", "")
    return F.coalesce(F.regexp_extract(clean, _URL, group), F.lit(""))


def canonical_url(c: Column) -> Column:
    """Link without fragment and trailing slashes, host in lower case, query kept; '' for no link."""
    path = F.regexp_replace(url_part(c, 3), r";[^/]*$", "")
    path = F.coalesce(present(F.regexp_replace(path, r"/+$", "")), F.lit("/"))
    query = url_part(c, 4)
    whole = F.concat(
        F.lower(url_part(c, 1)), F.lit("://"), F.lower(url_part(c, 2)), path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(whole)


# Escapes that stay encoded (URL delimiters, the percent sign and the space).
KEPT_ESCAPES = [
    "2f", "3f", "23", "26", "3d", "40", "3a", "5b", "5d", "21", "24", "27", "28", "29", "2a", "2b", "2c", "3b", "25", "20",
]


def readable_url(c: Column) -> Column:
    """Percent escapes decoded except the kept ones; only text with both 'http' and '%' changes.

    Everything that must survive is escaped once more, so one decoding pass gives it back.
    """
    kept = "|".join(KEPT_ESCAPES)
    s = F.regexp_replace(c, rf"(?i)%({kept})", "%25$1")
    s = F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25")
    s = F.regexp_replace(s, r"\+", "%2B")
    return F.when(c.contains("http") & c.contains("%"), F.coalesce(F.try_url_decode(s), c)).otherwise(c)


def cut_at_paragraph(c: Column, limit: int) -> Column:
    """First `limit` characters, back to the last blank line if that lies beyond 0.7 * limit."""
    head = F.substring(c, 1, limit)
    # what stands before the last blank line; the greedy prefix takes as much as it can
    before = F.regexp_extract(head, r"(?s)^(.*)\n\n", 1)
    broken = head.contains("\n\n") & (F.length(before) > F.lit(limit * 0.7))
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.when(broken, before).otherwise(head), F.lit("\n\n[... truncated ...]"))
    )
