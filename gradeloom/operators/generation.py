"""Task generation: seeds, prompts, the three filters, export and counts."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.numbering import first_n, number_rows
from gradeloom.functions.text import let, trim_blank
from gradeloom.session import cut

# Canonical domains in the order they are tried, then keywords and their domain.
DOMAINS = ["finance", "policy", "tech", "cybersecurity", "health", "science", "education", "legal", "energy", "trade", "crypto"]
DOMAIN_KEYWORDS = [
    (["macro", "invest", "banking", "econom"], "finance"),
    (["regulat", "compliance", "legislation", "governance"], "policy"),
    (["software", "engineer", "ai ", "ml ", "model", "llm", "machine learn"], "tech"),
    (["medical", "pharma", "drug", "clinical", "biotech"], "health"),
    (["supply chain", "logistic", "industrial", "manufactur"], "trade"),
    (["workforce", "hiring", "talent", "hr", "human resource"], "education"),
    (["climate", "carbon", "grid", "renewable"], "energy"),
    (["quantum", "biology", "research", "publish"], "science"),
    (["geopolit", "international"], "trade"),
]
OTHER_DOMAIN = "tech"

# What stands in a prompt when a topic has no trends or seeds, and the size limits.
NO_TRENDS = "(No trends found — use known recent developments)"
NO_SEEDS = "(No seeds available)"
MAX_TRENDS, TREND_CHARS, MAX_SEEDS, SEED_CHARS = 15, 150, 5, 300


# ---- filters -------------------------------------------------------------------------------


def needs_research(reply: Column, threshold: float = 0.7) -> Column:
    """Judge reply says deep research is needed, with enough confidence; missing confidence is 0."""
    def verdict(r):
        sure = F.coalesce(r["confidence_score"], F.lit(0.0).cast("double")) >= threshold
        return F.coalesce(r["needs_deep_research"], F.lit(False)) & sure

    return let(F.from_json(reply, "needs_deep_research boolean, confidence_score double"), verdict)


def deep_research_filter(queries: DataFrame, reply: str = "dr_reply", threshold: float = 0.7) -> DataFrame:
    return queries.where(needs_research(F.col(reply), threshold))


def is_hard(reply: Column, threshold: float = 0.75) -> Column:
    """The answer without search was poor: low or medium quality, search required, score not above
    the threshold. Missing values read as high, false and 1."""
    def verdict(r):
        return (
            F.coalesce(r["overall_quality"], F.lit("high")).isin("low", "medium")
            & F.coalesce(r["requires_search"], F.lit(False))
            & (F.coalesce(r["quality_score"], F.lit(1.0).cast("double")) <= threshold)
        )

    return let(F.from_json(reply, "overall_quality string, quality_score double, requires_search boolean"), verdict)


def hard_query_filter(queries: DataFrame, reply: str = "quality_reply", threshold: float = 0.75) -> DataFrame:
    return queries.where(is_hard(F.col(reply), threshold))


def normalize_domain(raw: Column) -> Column:
    """Canonical domain of a free label: the first domain name it contains, else the first keyword
    rule that applies, else the general one."""
    r = trim_blank(F.lower(raw))
    chain = None
    for words, domain in [([d], d) for d in DOMAINS] + DOMAIN_KEYWORDS:
        hit = r.rlike("|".join(words))
        chain = F.when(hit, domain) if chain is None else chain.when(hit, domain)
    return chain.otherwise(OTHER_DOMAIN)


def stage_flags(queries: DataFrame) -> DataFrame:
    """All filters as columns, so that one pass over the data serves every stage and the funnel."""
    return queries.withColumns({
        "passed_search": F.coalesce("searchable", F.lit(False)),
        "passed_research": needs_research(F.col("dr_reply")),
        "passed_quality": is_hard(F.col("quality_reply")),
    })


def funnel_counts(flagged: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """Rows that survive each stage, in one aggregation. `stages` pairs a label with its flag column."""
    alive, counts = F.lit(True), [F.struct(F.lit(0).alias("step"), F.lit("generated").alias("stage"), F.count("*").alias("n"))]
    for i, (label, flag) in enumerate(stages, 1):
        alive = alive & F.col(flag)
        counts.append(F.struct(F.lit(i).alias("step"), F.lit(label).alias("stage"), F.count_if(alive).alias("n")))
    return flagged.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def domain_distribution(queries: DataFrame) -> DataFrame:
    """Queries per canonical domain, most common first."""
    counts = queries.groupBy(normalize_domain(F.col("domain")).alias("domain")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "domain")


def export_queries(queries: DataFrame, order: str = "qid") -> DataFrame:
    """Final data set: ids from 1 in a fixed order, a random chat id, and the annotation record."""
    dr = F.from_json("dr_reply", "confidence_score double, search_complexity string")
    quality = F.from_json("quality_reply", "quality_score double")
    zero = F.lit(0.0).cast("double")
    annotation = F.struct(
        F.lit("text-auto").alias("category"), F.lit("en").alias("language"),
        normalize_domain(F.coalesce("domain", F.lit("other"))).alias("domain"),
        F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("persona", F.lit("")).alias("persona"),
        F.coalesce("anchored_event", F.lit("")).alias("anchored_event"),
        F.coalesce("time_sensitive", F.lit(False)).alias("time_sensitive"),
        F.coalesce(dr["confidence_score"], zero).alias("dr_confidence"),
        F.coalesce(quality["quality_score"], zero).alias("quality_score"),
        F.coalesce(dr["search_complexity"], F.lit("")).alias("search_complexity"),
        F.struct(F.coalesce("result_count", F.lit(0)).alias("result_count"), F.coalesce("source_diversity", F.lit(0)).alias("source_diversity"),
                 F.coalesce("has_recent", F.lit(False)).alias("has_recent_results")).alias("search_validation"))
    shaped = queries.select(order, "query", annotation.alias("annotation"))
    return number_rows(shaped, [order], "id").select(
        "id", F.uuid().alias("chat_id"), "query", F.array().cast("array<string>").alias("files"), "annotation")


# ---- seeds ---------------------------------------------------------------------------------


def match_seeds(topics: DataFrame, seeds: DataFrame, n: int = 5) -> DataFrame:
    """The n best seed questions per topic: those of the same topic; while these are fewer than n,
    those of topics that share a word of more than three letters; while there are fewer than two,
    all of them. Questions with the same first 100 characters count once.

    `seeds` has topic, pos and query; topics follow each other in order of first appearance. Every
    list is cut to the few entries that can still matter before it is joined: a topic that uses the
    second tier has fewer than n own seeds, so 2n entries per shared word are enough, and one that
    uses the third has at most one match, so n + 2 entries of the whole list are. No join pairs a
    group with itself.
    """
    named = seeds.withColumn("topic", F.coalesce("topic", F.lit("Other")))
    own = named.where(F.length("query") > 20).withColumn("prefix", F.substring("query", 1, 100))
    starts = own.groupBy("topic").agg(F.min("pos").alias("topic_pos"), F.count("*").alias("n_own"))
    at = [F.col("topic_pos"), F.col("pos")]
    # at most 2n rows per topic; everything below reads these, so they are kept
    heads = cut(first_n(first_n(own, ["topic", "prefix"], [F.col("pos")], 1), ["topic"], [F.col("pos")], 2 * n).join(starts, "topic"))
    known = heads.select("topic", "topic_pos", "n_own").distinct()

    def words(c):
        return F.array_distinct(F.transform(F.filter(F.split(trim_blank(c), r"(?U)\s+"), lambda w: F.length(w) > 3), F.lower))

    def by_word(df):
        return df.withColumn("word", F.explode(words(F.col("topic")))).withColumnRenamed("topic", "seed_topic")

    word_heads = first_n(first_n(by_word(heads), ["word", "prefix"], at, 1), ["word"], at, 2 * n)
    # three topics per word tell whether at least two others share it
    word_topics = first_n(by_word(known), ["word"], [F.col("topic_pos")], 3)

    cols = ["topic", "tier", "topic_pos", "pos", "query", "prefix"]
    names = topics.select("topic").distinct()
    wanted = names.join(known.select("topic", "n_own"), "topic", "left").fillna(0, ["n_own"])
    first = names.join(heads, "topic").withColumn("tier", F.lit(1)).select(cols)

    short = wanted.where(F.col("n_own") < n)
    short_words = short.select("topic", F.explode(words(F.col("topic"))).alias("word"))
    second = short_words.join(word_heads, "word").where("seed_topic <> topic").withColumn("tier", F.lit(2)).select(cols)
    n_shared = (
        short_words.join(word_topics, "word").where("seed_topic <> topic")
        .select("topic", "seed_topic", "n_own").distinct()
        .groupBy("topic").agg(F.sum("n_own").alias("n_shared"))
    )
    bare = (
        short.join(n_shared, "topic", "left").fillna(0, ["n_shared"]).where("n_own + n_shared < 2").select("topic")
    )
    # n + 2 rows of the whole list, as one array value
    overall = first_n(heads, ["prefix"], at, 1).orderBy(*at).limit(n + 2)
    spare = overall.agg(F.collect_list(F.struct("topic_pos", "pos", "query", "prefix"))).scalar()
    third = bare.withColumn("__s", spare).select("topic", F.inline("__s")).withColumn("tier", F.lit(3)).select(cols)

    pool = first.unionByName(second).unionByName(third)
    order = [F.col("tier"), *at]
    best = first_n(first_n(pool, ["topic", "prefix"], order, 1), ["topic"], order, n)
    # at most n rows per topic are left
    ranks = F.sort_array(F.collect_list(F.struct("tier", "topic_pos", "pos", "query")))
    return best.groupBy("topic").agg(ranks.alias("s")).select("topic", F.posexplode("s").alias("rank", "s")).select(
        "topic", (F.col("rank") + 1).alias("rank"), "s.tier", "s.query")


# ---- prompts -------------------------------------------------------------------------------


def fill(template: str, **values: Column) -> Column:
    """A format string with {name} fields as a column; text inside the values is never read again."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


# Fixed value: how the question and one part of the report are set off.
CHECK_TEMPLATE = (
    "\n[user_query start]>>>\n{query}\n[user_query end]>>>\n\n[part_start]>>>\n{part}\n[part_end]>>>\n"
)


def check_prompt(query: Column, part: Column) -> Column:
    return fill(CHECK_TEMPLATE, query=query, part=part)


def choose_template(has_attachment: Column, with_files: str, without: str, **values: Column) -> Column:
    """The template with key facts for entries that have attachments, else the plain one."""
    return F.when(has_attachment, fill(with_files, **values)).otherwise(fill(without, **values))


def generation_prompts(topics: DataFrame, trends: DataFrame, matched: DataFrame, template: str, per_topic: int) -> DataFrame:
    """One prompt per topic with its first trends and best seeds, both cut to size."""
    line = F.concat(F.lit("- ["), F.coalesce("date", F.lit("recent")), F.lit("] "), "title", F.lit(": "), F.substring("snippet", 1, TREND_CHARS))
    recent = first_n(trends, ["topic"], [F.col("pos")], MAX_TRENDS).select("topic", "pos", line.alias("line"))

    def block(df, pos):
        return df.groupBy("topic").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct(pos, "line"))), lambda s: s["line"]), "\n").alias("text"))

    seeds = matched.where(F.col("rank") <= MAX_SEEDS).select(
        "topic", "rank", F.concat(F.lit("- "), F.substring("query", 1, SEED_CHARS)).alias("line"))
    joined = (
        topics.join(block(recent, "pos").withColumnRenamed("text", "trends"), "topic", "left")
        .join(block(seeds, "rank").withColumnRenamed("text", "seeds"), "topic", "left")
    )
    return joined.select("topic", fill(
        template, n=F.lit(per_topic), topic=F.col("topic"), subtopics=F.array_join("subtopics", ", "),
        trends=F.coalesce("trends", F.lit(NO_TRENDS)), seeds=F.coalesce("seeds", F.lit(NO_SEEDS))).alias("prompt"))
