"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight; a
source's documents sorted by key are a weighted sample without replacement at
every length. A source takes whole epochs first, then the documents of lowest
key until their sizes add up to the rest of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samphire.llm.common import cut_lineage

#: Documents of a bin of keys, on average; the prefix sums run within bins and over them.
BIN_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), limit: float = 3.0) -> DataFrame:
    """``sources`` (source, source_size long, further columns) with weight, target double and source_no int.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; no target passes
    ``limit`` times its source's size, and what is over goes to the others by weight. That is one level for the target a
    unit of weight: sources in order of limit * size / weight reach their limit while it is below the level. One row a
    source, so the windows over all of them stay small.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("source_no", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    listed = listed.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * F.lit(float(limit)))
    by_ratio = W.orderBy(F.col("__cap") / F.col("weight"), "source_no")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()).cast("double") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = listed.withColumn("__level", level)
    holds = F.col("__cap") / F.col("weight") >= F.col("__level")
    # the level is that of the first source which doesn't reach its limit; rounding may leave none, then it is the last one's
    chosen = F.max(F.when(holds, F.col("__level"))).over(W.partitionBy())
    last = F.min("__level").over(W.partitionBy())
    more = [F.col(f"`{c}`") for c in sources.columns if c not in ("source", "source_size")]
    return leveled.select(
        "source", "source_no", "source_size", "weight", F.least("__cap", F.coalesce(chosen, last) * F.col("weight")).alias("target"), *more
    )


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the key's text: the first 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    limit: float = 3.0,
    quality_weights: tuple[float, float, float] = (0.5, 1.0, 2.0),
    seed: str = "mix",
    carry: tuple[str, ...] | list[str] = (),
) -> DataFrame:
    """(id, size, source_size, target, taken) and the ``carry`` columns of every document.

    ``size``: words of the text, 0 if it is null. ``taken``: words that the mix takes, repeats counted: epochs * size,
    and in the last, partial epoch the whole size below the budget, and of the one document that crosses it the part
    that fits. ``quality`` (id, quality 0 or 1): weights for 0, unknown and 1 are ``quality_weights``; several labels of
    an id count as the best. Sources without words have target 0. Null ids draw their keys from the text; rows equal in
    source, id, key and size take equally many words, so of those that cross the budget each takes its share, rounded
    down. Reruns agree: keys depend on the id and ``seed`` alone. An empty table gives none. ``carry`` columns may have
    any name; if it is one of the results', the result has it twice, as a select of both would.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    kept = [F.col(f"`{c}`").alias(f"__carry{i}") for i, c in enumerate(carry)]
    sized = cut_lineage(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__source"), size.alias("__size"), (-F.ln(uniform(draw))).alias("__exp"), *kept))
    if quality is None:
        keyed = sized.withColumn("__key", F.col("__exp") / quality_weights[1])
    else:
        labels = quality.where("quality IS NOT NULL").groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max("quality").alias("__q"))
        low, none, high = map(float, quality_weights)
        graded = F.when(F.col("__q") > 0, high).when(F.col("__q") <= 0, low).otherwise(none)
        keyed = sized.join(labels, "__id", "left").withColumn("__key", F.col("__exp") / graded)
    totals = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.count("*").alias("__docs"))
    plan = cut_lineage(targets(totals, weights, limit))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.select(F.col("source").alias("__s"), F.col("source_no").alias("__no"), F.col("source_size").alias("__total"), F.col("target").alias("__target"), epochs.alias("__epochs"), F.ceil(F.col("__docs") / BIN_ROWS).alias("__bins"))
    plan = plan.withColumn("__rest", F.round("__target").cast("long") - F.col("__epochs") * F.col("__total"))
    joined = keyed.join(plan, F.col("__source").eqNullSafe(F.col("__s")))
    binned = joined.withColumn("__bin", F.least(F.floor((1 - F.exp(-F.col("__key"))) * F.col("__bins")), F.col("__bins") - 1))
    # rows that are equal in all that the order knows are one group: however many, they don't make a bin longer
    groups = binned.groupBy("__no", "__bin", "__key", "__id", "__size").agg(F.count("*").alias("__rows"), F.max("__rest").alias("__rest")).withColumn("__words", F.col("__size") * F.col("__rows"))
    upto = W.partitionBy("__no").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    sums = groups.groupBy("__no", "__bin").agg(F.sum("__words").alias("__in_bin"))
    sums = sums.select("__no", "__bin", F.coalesce(F.sum("__in_bin").over(upto), F.lit(0)).alias("__before"))
    within = W.partitionBy("__no", "__bin").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, -1)
    placed = groups.withColumn("__earlier", F.coalesce(F.sum("__words").over(within), F.lit(0))).join(sums, ["__no", "__bin"])
    words = F.greatest(F.lit(0), F.least(F.col("__words"), F.col("__rest") - F.col("__before") - F.col("__earlier")))
    part = placed.select(F.col("__no").alias("__n"), F.col("__key").alias("__k"), F.col("__id").alias("__i"), F.col("__size").alias("__z"), F.floor(words / F.col("__rows")).cast("long").alias("__part"))
    same = (F.col("__no") == F.col("__n")) & (F.col("__key") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__size") == F.col("__z"))
    taken = binned.join(part, same)
    named = [F.col(f"__carry{i}").alias(c) for i, c in enumerate(carry)]
    return taken.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), (F.col("__epochs") * F.col("__size") + F.col("__part")).cast("long").alias("taken"), *named)


#: DuckDB's SQL for ``mix`` over documents and labels with the default parameters.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) AS e
  FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT s.*, e / CASE WHEN quality > 0 THEN 2.0::DOUBLE WHEN quality <= 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
  FROM sized s LEFT JOIN q USING (doc_id)),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_no, 3.0::DOUBLE * source_size AS cap FROM totals),
leveled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM weighed),
plan AS (
  SELECT source, source_size,
         least(cap, coalesce(max(CASE WHEN cap / w >= lev THEN lev END) OVER (), min(lev) OVER ()) * w) AS target FROM leveled),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM plan),
grouped AS (SELECT source, k, doc_id, size, count(*) AS m FROM keyed GROUP BY ALL),
placed AS (
  SELECT g.*, b.source_size, b.target, b.epochs, CAST(round(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
         coalesce(sum(size * m) OVER (PARTITION BY g.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM grouped g JOIN budget b ON g.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, s.size, source_size, target,
       CAST(epochs * s.size + floor(greatest(0, least(p.size * m, rest - earlier)) / m) AS BIGINT) AS taken
FROM keyed s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id AND s.source IS NOT DISTINCT FROM p.source AND s.size = p.size AND s.k = p.k
"""
