"""Queries over search results, attachments and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog.registry import query
from gradeloom.operators import search as S

URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(n, c="link"):
    return f"regexp_extract({c}, '{URL_RE}', {n})"


NORM = f""", n AS (SELECT *, CASE WHEN coalesce(link, '') = '' THEN '' ELSE concat(lower({part(1)}), '://', lower({part(2)}),
 coalesce(nullif(rtrim(regexp_replace({part(3)}, ';[^/]*$', ''), '/'), ''), '/'),
 CASE WHEN {part(4)} <> '' THEN '?' || {part(4)} ELSE '' END) END AS norm_url FROM v_search)"""


@query("block_domains", "v_search", """SELECT page_id, link FROM v_search WHERE NOT (coalesce(link, '') LIKE '%huggingface.co/datasets%'
OR coalesce(link, '') LIKE '%huggingface.co/spaces%')""")
def _(d):
    return S.block_domains(d.v_search).select("page_id", "link")


@query("normalize_url", "v_search", NORM + " SELECT page_id, link, norm_url FROM n")
def _(d):
    return S.normalize_url(d.v_search).select("page_id", "link", "norm_url")


@query("interleave_dedup", "v_search", NORM + """ SELECT query_id, engine, rnk, link, norm_url FROM (SELECT *, row_number() OVER
(PARTITION BY query_id, norm_url ORDER BY rnk, engine) AS rn FROM n) WHERE rn = 1 OR norm_url = ''""")
def _(d):
    return S.interleave_dedup(d.v_search).select("query_id", "engine", "rnk", "link", "norm_url")


# queries by negative id: too few results, one host, just enough of both, one host next to results without a link
FEW = """SELECT * FROM (VALUES (-1, 'https://a.org/1', 'Jan 2026', 's'), (-1, 'https://b.org/1', NULL, 's'),
 (-2, 'https://a.org/1', NULL, 's'), (-2, 'https://a.org/2', NULL, 's'), (-2, 'https://a.org/3', NULL, 'in 2026'),
 (-3, 'https://a.org/1', NULL, 's'), (-3, 'https://a.org/2', NULL, NULL), (-3, 'https://b.org/1', '2025-03-01', 's'),
 (-4, 'https://a.org/1', NULL, 's'), (-4, NULL, NULL, 'in 2026'), (-4, '', NULL, 's')) AS few(query_id, link, date, snippet)"""


SEARCHABLE = f""", r AS (SELECT query_id, link, date, snippet FROM v_search UNION ALL {FEW}),
h AS (SELECT *, coalesce({part(2)}, '') AS host FROM r), e AS (SELECT query_id, count(*) AS result_count,
 count(DISTINCT host) AS source_diversity, bool_or(contains(concat(coalesce(date, ''), coalesce(snippet, '')), '2026')) AS has_recent
 FROM h GROUP BY query_id) SELECT * FROM e WHERE result_count >= 3 AND source_diversity >= 2"""


# one rule under both of its names
@query("searchable_filter", "v_search", SEARCHABLE)
@query("searchable_filter_all", "v_search", SEARCHABLE)
def _(d):
    return S.searchable_filter(d.v_search.select("query_id", "link", "date", "snippet").unionByName(d.spark.sql(FEW)))


@query("top_sources", "v_search", f""", h AS (SELECT DISTINCT query_id, coalesce({part(2)}, '') AS host FROM v_search)
SELECT query_id, host FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY host) <= 5""")
def _(d):
    return S.top_sources(d.v_search, 5)


# escapes that decode (an accented letter, a tilde) next to escapes that stay
@query("decode_urls", "", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'p%C3%A9' WHEN page_id % 4 = 1 THEN concat(url, '/café%2Fx~%20+%zz')
 WHEN page_id % 4 = 2 THEN concat(url, '/%5Ba%5d') ELSE url END AS link, concat(url, '|', url, '/é') AS links FROM pages""")
def _(d):
    rows = d.wide("pages").selectExpr(
        "page_id",
        "CASE WHEN page_id % 4 = 0 THEN 'p%C3%A9' WHEN page_id % 4 = 1 THEN concat(url, '/caf%C3%A9%2Fx%7E%20+%zz')"
        " WHEN page_id % 4 = 2 THEN concat(url, '/%5Ba%5d') ELSE url END AS link",
        "array(url, concat(url, '/%C3%A9')) AS links")
    return S.decode_urls(rows, "link", "links").withColumn("links", F.array_join("links", "|"))


# each page's reply carries a graph, an answer box and snippets
@query("trim_search_payload", "", """SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'no json' ELSE
concat('{"organic":[{"link":"', url, '","position":', page_id, '}', CASE WHEN page_id % 2 = 0 THEN ',"bare",null' ELSE '' END, '],"peopleAlsoAsk":[{"question":"q"}]}') END AS payload FROM pages""")
def _(d):
    made = d.wide("pages").selectExpr("page_id", """CASE WHEN page_id % 5 = 4 THEN 'no json' ELSE
        concat('{"knowledgeGraph": {"a": 1}, "answerBox": {"b": [1]}, "organic": [{"link": "', url, '", "position": ', page_id,
        ', "snippet": "s"}', CASE WHEN page_id % 2 = 0 THEN ', "bare", null' ELSE '' END, '], "peopleAlsoAsk": [{"question": "q", "snippet": "t"}]}') END AS payload""")
    return made.withColumn("payload", S.trim_search_payload(F.col("payload")))


@query("attach_documents", "", """SELECT a.doc_id AS id,
 concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), b.text, c.text) AS attachment,
 cast((b.text IS NOT NULL)::int + (c.text IS NOT NULL)::int AS int) AS n_attached, b.text IS NOT NULL OR c.text IS NOT NULL AS has_attachment
FROM documents a LEFT JOIN documents b ON b.doc_id = (a.doc_id * 7) % 100003 AND b.doc_id % 3 <> 0 LEFT JOIN documents c ON c.doc_id = a.doc_id + 1 AND c.doc_id % 3 <> 0""")
def _(d):
    docs = d.documents
    entries = docs.selectExpr("doc_id AS id", """array(
        named_struct('filename', 'a', 'type', 'txt', 'dir', concat('att/', (doc_id * 7) % 100003, '.txt'), 'size', '1'),
        named_struct('filename', 'none', 'type', 'txt', 'dir', '', 'size', '1'),
        named_struct('filename', 'b', 'type', 'txt', 'dir', concat('att/', doc_id + 1, '.txt'), 'size', '1')) AS files""")
    stored = docs.where("doc_id % 3 <> 0").selectExpr("concat('att/', doc_id, '.txt') AS path", "text AS content")
    return S.attach_documents(entries, stored).select(
        "id", F.coalesce("attachment", F.lit("")).alias("attachment"), "n_attached", "has_attachment")


FILES = """, f AS (SELECT doc_id AS id, unnest([concat('a.', lang, '.JPG'), concat('b.', CASE doc_id % 5 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'ppt'
 WHEN 2 THEN 'm4a' WHEN 3 THEN 'PDF' ELSE 'zip' END), concat('no_dot_', lang)]) AS name FROM documents),
 t AS (SELECT id, CASE WHEN name LIKE '%.JPG' THEN 'Image' WHEN name = 'b.jsonld' THEN 'Json' WHEN name = 'b.ppt' THEN 'PPT' WHEN name = 'b.m4a' THEN 'MP3'
 WHEN name = 'b.PDF' THEN 'pdf' WHEN name = 'b.zip' THEN 'Zip' ELSE name END AS file_type FROM f)"""


def _files(d):
    return d.documents.selectExpr("doc_id AS id", """transform(array(concat('a.', lang, '.JPG'), concat('b.', CASE doc_id % 5 WHEN 0 THEN 'jsonld'
        WHEN 1 THEN 'ppt' WHEN 2 THEN 'm4a' WHEN 3 THEN 'PDF' ELSE 'zip' END), concat('no_dot_', lang)), n -> named_struct('filename', n)) AS files""")


@query("file_type_mix", "v_seed", FILES + " SELECT file_type, count(*) AS n FROM t GROUP BY 1")
def _(d):
    return S.file_type_mix(_files(d))


@query("file_type_mix_by_query", "v_seed", FILES + " SELECT id, file_type, count(*) AS n FROM t GROUP BY 1, 2")
def _(d):
    return S.file_type_mix(_files(d), "id")


def strip(c):
    t = f"regexp_replace(regexp_replace({c}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')"
    for name, ch in S.ENTITIES:
        t = f"replace({t}, '{name}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@query("page_text", "", f"""SELECT page_id, {strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
{strip("regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gsi'), '^.*?<body[^>]*>', '', 'si'), '</body>.*$', '', 'si')")} AS text FROM pages""")
def _(d):
    return S.page_text(d.wide("pages"))


@query("page_links", "", f"""SELECT page_id, pos - 1 AS pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(href, '^(?i)(https?|file):')
 THEN '' ELSE href END AS href, text FROM (SELECT page_id, pos, coalesce(regexp_extract(tag, 'href="([^"]*)"', 1), '') AS href, {strip("inner_html")} AS text
 FROM (SELECT page_id, generate_subscripts(t, 1) AS pos, unnest(t) AS tag, unnest(i) AS inner_html FROM
  (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 1) AS t, regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a>', 2) AS i FROM pages))) WHERE text <> ''""")
def _(d):
    return S.page_links(d.wide("pages")).withColumn("pos", F.col("pos").cast("bigint"))


# the pages hold no images, so each gets two: one by address, one inline
@query("page_images", "", """SELECT page_id, 0 AS pos, 'chart' AS alt, concat(url, '/i.png') AS src FROM pages
UNION ALL SELECT page_id, 1, '', 'data:image/png;base64...' FROM pages""")
def _(d):
    made = d.wide("pages").selectExpr("page_id", """concat(html, '<img alt="chart" src="', url, '/i.png">', '<IMG src=''data:image/png;base64,AAA,BB''>') AS html""")
    return S.page_images(made)


@query("strip_markdown_links", "", """SELECT doc_id, trim(regexp_replace(concat(replace(text, '. ', ' here <b> '), chr(10) || chr(10), 'http://x.org/a'),
 '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents""")
def _(d):
    made = d.wide("documents").selectExpr("doc_id", """concat(replace(text, '. ', ' [here](http://x.org/a?b=c) ![pic](data:x)<b> '),
        chr(10), chr(10), chr(10), chr(10), '<http://x.org/a>') AS text""")
    return made.select("doc_id", S.strip_markdown_links(F.col("text")).alias("text"))


@query("page_stats", "", """SELECT page_id, length(t) AS char_count, length(t) - length(replace(t, chr(10), '')) + 1 AS line_count,
length(t[:1500]) - length(replace(t[:1500], chr(10), '')) + 1 AS last_char_line, length(t) <= 1500 AS all_displayed
FROM (SELECT page_id, replace(html, 'e', chr(10)) AS t FROM pages)""")
def _(d):
    made = d.wide("pages").selectExpr("page_id", "replace(html, 'e', chr(10)) AS html")
    return S.page_stats(made, "html", 1500).selectExpr(
        "page_id", "cast(char_count AS bigint) AS char_count", "cast(line_count AS bigint) AS line_count",
        "cast(last_char_line AS bigint) AS last_char_line", "all_displayed")
