"""Mixing sources to target weights by whole copies of documents.

Words are added up per source. A target per source follows from the weights: what the mix takes in all is
shared out by weight, but no source gives more than CAP times its words, and what a stopped source leaves
goes to the others by weight until none is above. Target over words is the source's repetition rate, and a
document comes floor(rate) times, plus once more if its draw, a number in [0, 1) made from a hash of seed,
id and text, lies below the rate's fraction. The draws of different documents are independent, so the words
taken from a source spread around its target by the square root of fraction * (1 - fraction) * sum of size^2.

Targets in closed form: with sources in order of words over weight, those that stop are a prefix; running
sums over numbered blocks tell for each source whether it stops. So the number of jobs does not depend on
the number of sources, and no window holds more than BLOCK of them.

Rates go back to documents by two joins. Sources with at least one row in HOT are at most HOT many: they are
broadcast. No other source holds more than one row in HOT, so those can be shuffled.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.numbering import BLOCK, number_rows
from gradeloom.session import cut

WEIGHTS = (5, 2, 1)   # of the sources in order, repeating
SHARE = 1.5           # words of the mix over words there are
CAP = 2               # words a source may give over words it has
SEED = "mix"
HOT = 10_000

_WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 2 ** 52      # a draw is a multiple of one over this


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def _draw(doc_id: Column, text: Column, seed: str) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(_STEPS))


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds `target` to one row per source (source, source_size). Sources are weighed in order of their names
    (bytes of UTF-8, null last); `share` must not exceed `cap`."""
    if share > cap:
        raise ValueError("the mix takes more than all sources may give")
    named = number_rows(sources.withColumn("__last", F.col("source").isNull()), ["__last", "source"], "__rank")
    weighed = named.withColumn("__w", F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights)).cast("int")))
    limited = weighed.withColumn("__most", F.lit(float(cap)) * F.col("source_size"))
    ordered = cut(number_rows(limited.withColumn("__ratio", F.col("__most") / F.col("__w")), ["__ratio", "__rank"], "__pos")
                  .withColumn("__b", F.floor(F.col("__pos") / BLOCK)))
    # what sources before this one in the order may give and weigh: inside its block, and in blocks before
    inside = Window.partitionBy("__b").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ordered.groupBy("__b").agg(F.sum("__most").alias("m"), F.sum("__w").alias("w"))
    carried = blocks.select(
        F.col("__b").alias("__cb"), F.coalesce(F.sum("m").over(before), F.lit(0.0)).alias("__cm"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("__cw"))
    everything = ordered.agg(F.struct(
        (F.lit(float(share)) * F.sum("source_size")).alias("taken"), F.sum("__w").alias("w"))).scalar()
    summed = (
        ordered.withColumn("__im", F.coalesce(F.sum("__most").over(inside), F.lit(0.0)))
        .withColumn("__iw", F.coalesce(F.sum("__w").over(inside), F.lit(0.0)))
        .join(carried, F.col("__b") == F.col("__cb"))
        .withColumn("__all", everything)
    )
    left = F.col("__all.taken") - F.col("__im") - F.col("__cm")
    stops = cut(summed.withColumn(
        "__stops", F.col("__most") * (F.col("__all.w") - F.col("__iw") - F.col("__cw")) < left * F.col("__w")))
    rest = stops.agg(F.struct(
        F.coalesce(F.sum(F.when(F.col("__stops"), F.col("__most"))), F.lit(0.0)).alias("given"),
        F.sum(F.when(~F.col("__stops"), F.col("__w"))).alias("w"))).scalar()
    by_weight = (F.col("__all.taken") - F.col("__rest.given")) * F.col("__w") / F.col("__rest.w")
    return stops.withColumn("__rest", rest).select(
        *sources.columns, F.when(F.col("__stops"), F.col("__most")).otherwise(by_weight).alias("target"))


def _with_copies(rows: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """`rows` (doc, source, size, draw) with source_size, target and copies."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    shares = cut(source_targets(cut(sources), weights, share, cap)).select(
        F.col("source").alias("of"), "source_size", "target", "n_rows")
    all_rows = shares.agg(F.sum("n_rows")).scalar()
    marked = shares.withColumn("hot", F.col("n_rows") * HOT >= all_rows)
    hot = F.broadcast(marked.where("hot").drop("hot", "n_rows"))
    same = F.col("source").eqNullSafe(F.col("of"))
    found = rows.join(hot, same).unionByName(
        rows.join(hot, same, "left_anti").join(marked.where("NOT hot").drop("hot", "n_rows"), same))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    return found.withColumn("copies", whole + (F.col("draw") < rate - whole).cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of `docs`, all columns, as often as they are taken."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", n_words(F.col("text")).alias("size"),
        _draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    taken = _with_copies(rows, weights, share, cap).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def mix_report(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (size times copies) and copies of every row.

    A null text has no words. A null source is a source of its own, the last. Rows that repeat id and text
    share one draw. Where all texts are empty, targets are 0 and nothing is taken. An empty table gives no rows; other columns
    are ignored.
    """
    rows = cut(docs.select(
        F.col("doc_id").alias("doc"), "source", n_words(F.col("text")).alias("size"),
        _draw(F.col("doc_id"), F.col("text"), seed).alias("draw")))
    return _with_copies(rows, weights, share, cap).select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = f"""
WITH rows AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
           CAST(CAST(concat('0x', substr(md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13)) AS BIGINT) AS DOUBLE)
               / CAST({_STEPS} AS DOUBLE) AS draw
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CAST(list_value({', '.join(map(str, WEIGHTS))})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w
    FROM rows GROUP BY source),
ordered AS (
    SELECT *, CAST({CAP} * source_size AS DOUBLE) AS most, CAST({SHARE} * sum(source_size) OVER () AS DOUBLE) AS total,
           coalesce(sum(CAST({CAP} * source_size AS DOUBLE)) OVER before, 0) AS most_before,
           sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_from
    FROM sources
    WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopping AS (SELECT *, most * w_from < (total - most_before) * w AS stops FROM ordered),
targets AS (
    SELECT source, source_size, CASE WHEN stops THEN most ELSE
           (total - coalesce(sum(most) FILTER (WHERE stops) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT stops) OVER () END AS target
    FROM stopping),
rated AS (
    SELECT doc_id, size, source_size, target, draw, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0) AS rate
    FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM (
    SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated)
"""
