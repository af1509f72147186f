"""Boilerplate lines by their frequency within a site.

For each host: the number of its pages that hold a line, divided by the number of its pages. Lines whose
share exceeds a ratio are navigation, footers and notices; they are dropped from every page of the host.

Counts are aggregated before the shuffle, so a host with a third of all pages, or a line on all of them,
costs no task more than others. The lines of a host over the ratio are few: their shares add up to at
most the mean number of distinct lines per page, so there are at most that mean divided by the ratio.
This bounded list, not the lines, goes back to the pages, where it is applied inside the row. The lists of hosts with
a large share of all pages are few and are broadcast, if they are small; their pages are dealt out by a hash of the
page. No other host has so many pages that a join by host would put much of the table into one task.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.urls import host_of
from gradeloom.session import cut

RATIO = 0.3       # more than this share of the host's pages
HOT = (1000, 50)  # hosts with one page in so many: their lists are broadcast if all are small, else those of the second
HOT_BYTES = 64 << 20
MIN_PAGES = 2     # and more than one page, so that a host's only page is not its own boilerplate

_BREAK = r"(?i)</?(p|div|br|li|ul|ol|nav|tr|table|h1|h2|h3|h4|h5|h6|article|section|header|footer|title|head|body|html|main|aside|blockquote|pre)\b[^>]*>"
_UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def lines_of(html: Column) -> Column:
    """Visible lines of a page: block elements end a line, other tags vanish, ends are trimmed, empty
    lines are left out. A null page has none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BREAK, "\n"), "<[^>]*>", "")
    trimmed = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, "^[ \t\r]+|[ \t\r]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def drop_site_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_text (the lines left, joined by newlines).

    Every page counts, repeated rows too; a line counts once per page. URLs that are null or have no
    `://` share the empty host, which is treated like any other. Pages without lines have an empty text. An
    empty table gives no rows; other columns are ignored.
    """
    paged = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    totals = cut(pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages")))
    n_pages = totals.agg(F.sum("n_pages")).first()[0] or 0

    def is_hot(one_in: int) -> Column:
        return F.col("n_pages") * one_in >= n_pages

    def joined(rows: DataFrame, values: DataFrame, name: str, one_in: int, *spread: str) -> DataFrame:
        """Rows with the value of their host. Rows of hot hosts, which get theirs by broadcast, are dealt out by a hash."""
        hot = totals.where(is_hot(one_in)).join(values.drop("n_pages"), "host", "left").select("host", F.col(name).alias("of_hot"), F.lit(True).alias("hot"))
        cold = values.join(totals.where(~is_hot(one_in)).select("host"), "host").select(F.col("host").alias("key"), F.col(name).alias("of_cold"))
        key = F.when(F.col("hot"), F.concat(F.lit("\0"), F.xxhash64(*spread).cast("string"))).otherwise(F.col("host"))
        keyed = rows.join(F.broadcast(hot), "host", "left").withColumn("key", key)
        return keyed.join(cold, "key", "left").withColumn(name, F.coalesce("of_hot", "of_cold")).drop("key", "hot", "of_hot", "of_cold")

    counts = (
        paged.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    )
    pages_of = totals.withColumn("of_host", F.col("n_pages"))
    common = cut(
        joined(counts, pages_of, "of_host", HOT[0], "line").where(F.col("n") > F.lit(ratio) * F.col("of_host"))
        .groupBy("host").agg(F.collect_list("line").alias("common")))
    for one_in in HOT:
        of_hot = common.join(F.broadcast(totals.where(is_hot(one_in))), "host")
        if (of_hot.agg(F.sum(F.length(F.array_join("common", "\n")))).first()[0] or 0) <= HOT_BYTES:
            break
    found = joined(paged, common, "common", one_in, "page_id", "lines").withColumn(
        "common", F.coalesce("common", F.array().cast("array<string>")))
    kept = found.withColumn("kept", F.filter("lines", lambda s: ~F.array_contains(F.col("common"), s)))
    return kept.select(
        "page_id", "host", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"))


ORACLE = f"""
WITH flat AS (
    SELECT row_number() OVER () AS page_row, page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_UNSEEN}', '', 'g'),
               '{_BREAK}', chr(10), 'g'), '<[^>]*>', '', 'g') AS text
    FROM pages),
paged AS (
    SELECT page_row, page_id, host, list_filter(list_transform(string_split(text, chr(10)),
               lambda s: regexp_replace(s, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda s: s <> '') AS lines FROM flat),
totals AS (SELECT host, count(*) AS n_pages FROM paged GROUP BY host),
counts AS (
    SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM paged) GROUP BY host, line),
common AS (SELECT host, line FROM counts JOIN totals USING (host) WHERE n >= {MIN_PAGES} AND n > {RATIO} * n_pages),
marked AS (
    SELECT page_row, pos, line, c.line IS NOT NULL AS out FROM (
        SELECT page_row, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM paged) p
    LEFT JOIN common c USING (host, line)),
kept AS (
    SELECT page_row, CAST(sum(CASE WHEN out THEN 1 ELSE 0 END) AS INTEGER) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '') AS kept_text
    FROM marked GROUP BY page_row)
SELECT page_id, host, CAST(len(lines) AS INTEGER) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(kept_text, '') AS kept_text
FROM paged LEFT JOIN kept USING (page_row)
"""
