"""Health metrics of tags. Sums of integers come first and floats last, so results don't hang on the order of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samphire.functions.text import is_blank, utf16_length


def concentration(frequency: DataFrame) -> DataFrame:
    """One row of a (tag, n) table: token_count, unique_tag_count, entropy (nats), effective_tag_count, hhi.

    Without tags entropy and hhi are 0 and the effective count is 1.
    """
    n = F.col("n").cast("double")
    total = F.sum("n").cast("double")
    row = frequency.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("token_count"),
        F.count("*").alias("unique_tag_count"),
        F.coalesce(F.ln(total) - F.sum(n * F.ln(n)) / total, F.lit(0.0)).alias("entropy"),
        F.coalesce(F.sum(n * n) / (total * total), F.lit(0.0)).alias("hhi"),
    )
    return row.withColumn("effective_tag_count", F.exp("entropy"))


def gini(frequency: DataFrame) -> DataFrame:
    """One row: gini of a (tag, n) table, 0 without tags.

    Tags of equal count form a block of the sorted order whose share of the running sums is known in closed form, so the
    window runs over the distinct counts, not over the tags.
    """
    blocks = frequency.groupBy("n").agg(F.count("*").alias("m"))
    below = F.coalesce(F.sum("m").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("r", below).withColumn("u", F.sum("m").over(W.partitionBy()))
    m, r, u = (F.col(c).cast("decimal(38,0)") for c in ("m", "r", "u"))
    area = F.col("n").cast("decimal(38,0)") * (m * (u + 1) - m * r - m * (m + 1) / 2)
    row = placed.agg(F.sum(area.cast("double")).alias("area"), F.sum((F.col("n") * F.col("m")).cast("double")).alias("total"), F.max("u").alias("u"))
    return row.select(F.coalesce((F.col("u") + 1 - 2 * F.col("area") / F.col("total")) / F.col("u"), F.lit(0.0)).alias("gini"))


def top_k_mass(frequency: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(k, mass) for each distinct k: the share of the k most frequent tags, ties by tag; 0 if k is 0 or less."""
    spark = frequency.sparkSession
    wanted = sorted(set(ks))
    asked = spark.createDataFrame([(int(k),) for k in wanted], "k int")
    most = max([0, *wanted])
    first = frequency.orderBy(F.desc("n"), "tag").limit(most)
    ranked = first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "tag")))
    total = frequency.agg(F.sum("n").alias("total"))
    sums = asked.join(F.broadcast(ranked), F.col("rank") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top"))  # most rows
    return sums.crossJoin(F.broadcast(total)).select("k", F.coalesce(F.col("top") / F.col("total"), F.lit(0.0)).alias("mass"))  # one row


def jensen_shannon(frequency: DataFrame, target: DataFrame) -> DataFrame:
    """One row: jsd in bits between (tag, n) and the target (tag, weight), which is scaled to sum 1.

    Null if the target is empty or sums to 0; 0.5 if only the observed side is empty.
    """
    observed = frequency.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__n"))
    wanted = target.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("__w"))
    both = frequency.join(target, "tag", "full_outer").crossJoin(F.broadcast(observed)).crossJoin(F.broadcast(wanted))  # one row each
    p = F.coalesce(F.col("n") / F.greatest(F.lit(1), F.col("__n")), F.lit(0.0))
    q = F.coalesce(F.col("weight") / F.when(F.col("__w") > 0, F.col("__w")), F.lit(0.0))
    both = both.select(p.alias("p"), q.alias("q"), "__w").withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.when(F.col(x) > 0, 0.5 * F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    row = both.agg(F.sum(term("p") + term("q")).alias("jsd"), F.max("__w").alias("__w"))
    return row.select(F.when(F.col("__w") > 0, F.col("jsd")).alias("jsd"))


def target_frame(spark: SparkSession, weights: Mapping[str, float] | None) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in (weights or {}).items()], "tag string, weight double")


def stop_tags(documents: DataFrame, sample_count: int, min_df: int = 2, limit: int = 50) -> DataFrame:
    """(tag, document_frequency, inverse_document_frequency) of the most common tags, lowest idf first."""
    idf = F.ln(F.lit(sample_count + 1.0) / (F.col("df") + 1)) + 1
    common = documents.where(F.col("df") >= min_df).select("tag", F.col("df").alias("document_frequency"), idf.alias("inverse_document_frequency"))
    # equal counts give equal idf, so the order by count is the order by idf
    return common.orderBy(F.desc("document_frequency"), "tag").limit(max(0, limit))


def pointwise_mutual_information(pair_table: DataFrame, documents: DataFrame, sample_count: int, min_support: int = 2, limit: int = 50) -> DataFrame:
    """(left_tag, right_tag, cooccurrence_count, pmi in bits) of the strongest pairs with ``min_support`` or more."""
    left = documents.select(F.col("tag").alias("left"), F.col("df").alias("l"))
    right = documents.select(F.col("tag").alias("right"), F.col("df").alias("r"))
    joined = pair_table.where(F.col("c") >= min_support).join(left, "left").join(right, "right")
    ratio = (F.col("c") * float(sample_count)) / (F.col("l") * F.col("r").cast("double"))
    table = joined.select(F.col("left").alias("left_tag"), F.col("right").alias("right_tag"), F.col("c").alias("cooccurrence_count"), F.log2(ratio).alias("pmi"))
    return table.orderBy(F.desc(F.round("pmi", 12)), F.desc("cooccurrence_count"), "left_tag", "right_tag").limit(max(0, limit))


def near_duplicate_rate(groups: DataFrame) -> DataFrame:
    """One row of (sample_id, group_key): rate of samples in groups of two or more, and redundant_copy_rate.

    Null and blank keys are no group. Without samples both are 0.
    """
    sized = groups.groupBy("group_key").agg(F.count("*").alias("size"))
    real = (F.col("size") > 1) & ~is_blank(F.col("group_key"))
    row = sized.agg(F.sum("size").alias("n"), F.sum(F.when(real, F.col("size")).otherwise(0)).alias("in"), F.sum(F.when(real, F.col("size") - 1).otherwise(0)).alias("extra"))
    return row.select(F.coalesce(F.col("in") / F.col("n"), F.lit(0.0)).alias("rate"), F.coalesce(F.col("extra") / F.col("n"), F.lit(0.0)).alias("redundant_copy_rate"))


def overflow_rate(frequency: DataFrame, max_length: int = 64) -> DataFrame:
    """One row: the share of tokens of more than ``max_length`` UTF-16 units; 0 without tokens or with a limit of 0 or less."""
    if max_length <= 0:
        return frequency.agg(F.lit(0.0).alias("overflow_rate"))
    over = F.sum(F.when(utf16_length(F.col("tag")) > max_length, F.col("n")).otherwise(0))
    return frequency.agg(F.coalesce(over / F.sum("n"), F.lit(0.0)).alias("overflow_rate"))
