"""Search results, attachments and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradeloom.functions.numbering import first_n
from gradeloom.functions.text import canonical_url, first_present, let, readable_url, trim_blank, url_part

# Link parts that are never used as a source.
BLOCKED_LINKS = ["huggingface.co/datasets", "huggingface.co/spaces"]

# Attachment labels by file extension; other extensions are their own label.
FILE_LABELS = {
    "Image": ["jpg", "jpeg", "png", "gif", "webp"], "Text": ["txt"], "Json": ["jsonld", "json"],
    "PPT": ["pptx", "ppt"], "WAV": ["wav"], "MP3": ["mp3", "m4a"], "Zip": ["zip"],
}
# Fixed value: separator between the texts of several attachments.
ATTACHMENT_BREAK = "\n\n---\n\n"


# ---- search results ------------------------------------------------------------------------


def block_domains(results: DataFrame, link: str = "link") -> DataFrame:
    """Results whose link is not on the blocked list; a missing link is kept."""
    c = F.coalesce(F.col(link), F.lit(""))
    keep = ~(c.contains(BLOCKED_LINKS[0]) | c.contains(BLOCKED_LINKS[1]))
    return results.where(keep)


def normalize_url(results: DataFrame, link: str = "link", out: str = "norm_url") -> DataFrame:
    return results.withColumn(out, canonical_url(F.col(link)))


def interleave_dedup(results: DataFrame) -> DataFrame:
    """Two engines merged by rank, first engine first, one result per query and normalised link.
    Results without link all stay. The merged order is (rnk, engine), unique per query."""
    apart = F.when(F.col("norm_url") == "", F.struct("rnk", "engine"))
    named = normalize_url(results).withColumn("__apart", apart)
    return first_n(named, ["query_id", "norm_url", "__apart"], [F.col("rnk"), F.col("engine")], 1).drop("__apart")


def host(link: Column) -> Column:
    """Authority of a link, '' for none."""
    return F.coalesce(url_part(F.coalesce(link, F.lit("")), 2), F.lit(""))


def search_evidence(results: DataFrame) -> DataFrame:
    """Result count, distinct hosts (a missing link is host '') and recency per query."""
    said = F.concat(F.coalesce("date", F.lit("")), F.coalesce("snippet", F.lit("")))
    return results.groupBy("query_id").agg(
        F.count("*").alias("result_count"),
        F.count_distinct(host(F.col("link"))).alias("source_diversity"),
        F.bool_or(said.contains("2026")).alias("has_recent"),
    )


def searchable_filter(results: DataFrame, min_results: int = 3, min_hosts: int = 2) -> DataFrame:
    """Queries with enough results from enough hosts."""
    return search_evidence(results).where(
        (F.col("result_count") >= min_results) & (F.col("source_diversity") >= min_hosts))


def top_sources(results: DataFrame, n: int = 5) -> DataFrame:
    """The first n distinct hosts per query, in name order."""
    hosts = results.select("query_id", host(F.col("link")).alias("host")).distinct()
    return first_n(hosts, ["query_id"], [F.col("host")], n)


def decode_urls(df: DataFrame, *columns: str) -> DataFrame:
    """Link columns with harmless percent escapes decoded; arrays (nested too) element by element."""

    def decoded(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: decoded(x, kind.elementType))
        if isinstance(kind, T.StructType):
            fields = [decoded(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*fields))
        return readable_url(c) if isinstance(kind, T.StringType) else c

    return df.withColumns({n: decoded(F.col(n), df.schema[n].dataType) for n in columns})


def trim_search_payload(payload: Column, drop_graph: bool = True, drop_answer: bool = True, drop_snippets: bool = True) -> Column:
    """Search reply without the chosen parts; a reply that is no JSON object stays as it is.

    Values stay variants, so whatever else the reply holds keeps its type.
    """
    drop = [k for k, on in (("knowledgeGraph", drop_graph), ("answerBox", drop_answer)) if on]
    fields = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    if drop:
        fields = F.map_filter(fields, lambda k, v: ~k.isin(drop))
    if drop_snippets:

        def bare(v):
            # item by item: what is no object stays
            def item(x: Column) -> Column:
                members = F.try_variant_get(x, "$", "map<string,variant>")
                return F.coalesce(F.to_json(F.map_filter(members, lambda k, _: k != "snippet")), F.to_json(x), F.lit("null"))

            items = F.transform(F.try_variant_get(v, "$", "array<variant>"), item)
            return F.coalesce(F.try_parse_json(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))), v)

        fields = F.transform_values(fields, lambda k, v: F.when(
            k.isin("organic", "peopleAlsoAsk"), bare(v)).otherwise(v))
    return F.coalesce(F.to_json(fields), payload)


# ---- attachments ---------------------------------------------------------------------------


def attach_documents(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries with the texts of their files, in file order. Files that do not exist are dropped.

    Only ids and paths go through the join; the gathered list is as long as the entry's own file list.
    """
    wanted = (
        entries.select("id", F.posexplode("files").alias("pos", "file"))
        .select("id", "pos", F.col("file.dir").alias("path")).where("path <> ''")
    )
    parts = (
        wanted.join(documents.select("path", "content"), "path")
        .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "content"))).alias("parts"))
    )
    text = F.array_join(F.transform("parts", lambda p: p["content"]), ATTACHMENT_BREAK)
    joined = parts.select("id", text.alias("attachment"), F.size("parts").alias("n_attached"))
    return (
        entries.join(joined, "id", "left")
        .withColumn("n_attached", F.coalesce("n_attached", F.lit(0)))
        .withColumn("has_attachment", trim_blank(F.coalesce("attachment", F.lit(""))) != "")
    )


def file_label(name: Column) -> Column:
    ext = F.lower(F.substring_index(name, ".", -1))
    label = None
    for text, exts in FILE_LABELS.items():
        label = F.when(ext.isin(exts), text) if label is None else label.when(ext.isin(exts), text)
    return label.otherwise(ext)


def file_type_mix(entries: DataFrame, *keys: str) -> DataFrame:
    """Attachments per type label, and per key if keys are given."""
    files = entries.select(*keys, F.explode("files").alias("file"))
    return files.groupBy(*keys, file_label(F.col("file.filename")).alias("file_type")).agg(F.count("*").alias("n"))


# ---- pages ---------------------------------------------------------------------------------

# Entities that are decoded, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def plain_markup(c: Column) -> Column:
    """Markup as text: tags and comments blanked, entities decoded, blanks collapsed."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, ch in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_text(pages: DataFrame) -> DataFrame:
    """Title and body text of each page, scripts and styles removed. Pages without a body use all of it."""
    bare = F.regexp_replace("html", r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")
    body = F.regexp_replace(F.regexp_replace("__h", r"(?is)^.*?<body\b[^>]*>", ""), r"(?is)</body>.*$", "")
    title = plain_markup(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    return pages.withColumn("__h", bare).select("page_id", title.alias("title"), plain_markup(body).alias("text"))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.coalesce(first_present(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)]), F.lit(""))


def page_links(pages: DataFrame) -> DataFrame:
    """Anchors with visible text. A link whose scheme is not http, https or file is reduced to its text."""
    anchor = F.lit(r"(?is)<a\b([^>]*)>(.*?)</a>")
    found = F.arrays_zip(
        F.regexp_extract_all("html", anchor, 1).alias("tag"), F.regexp_extract_all("html", anchor, 2).alias("inner"))

    def link(a, pos):
        return let(_attribute(a["tag"], "href"), lambda href: F.struct(
            pos.alias("pos"),
            F.when(F.lower(url_part(href, 1)).isin("", "http", "https", "file"), href).otherwise("").alias("href"),
            plain_markup(a["inner"]).alias("text")))

    return pages.select("page_id", F.inline(F.filter(F.transform(found, link), lambda x: x["text"] != "")))


def page_images(pages: DataFrame) -> DataFrame:
    """Images with alternative text and source; inline data is cut to its type."""
    src = _attribute(F.col("tag"), "src")
    return (
        pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<img\b([^>]*)>"), 1)).alias("pos", "tag"))
        .select("page_id", "pos", _attribute(F.col("tag"), "alt").alias("alt"),
                F.when(src.startswith("data:"), F.concat(F.substring_index(src, ",", 1), F.lit("..."))).otherwise(src).alias("src"))
    )


def strip_markdown_links(c: Column) -> Column:
    """Markdown with links reduced to their text, images dropped and blank lines collapsed."""
    t = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"<(https?://[^>\s]+)>", "$1")
    return trim_blank(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def page_stats(df: DataFrame, content: str, max_chars: int = 409_600) -> DataFrame:
    """Size of a page, the part that is shown, and the line its last shown character is on."""

    def lines(c):
        return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1)

    whole = F.coalesce(F.col(content), F.lit(""))
    return (
        df.withColumn("shown", F.substring(whole, 1, max_chars))
        .withColumn("char_count", F.length(whole)).withColumn("line_count", lines(whole))
        .withColumn("last_char_line", lines(F.col("shown")))
        .withColumn("all_displayed", F.length(whole) <= max_chars)
    )
