"""Counts of tags, documents and pairs. Samples: (sample_id, tags array<string>); a null array is an empty sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_array(tags_col: str = "tags") -> Column:
    return F.coalesce(F.col(tags_col), F.array().cast("array<string>"))


def sample_counts(samples: DataFrame, tags_col: str = "tags") -> DataFrame:
    """One row: sample_count, token_count; tags that a sample repeats count each time."""
    return samples.agg(F.count("*").alias("sample_count"), F.coalesce(F.sum(F.size(tag_array(tags_col)).cast("long")), F.lit(0)).alias("token_count"))


def term_frequency(samples: DataFrame, tags_col: str = "tags") -> DataFrame:
    """(tag, n): all occurrences. Null and empty lists have none, a null tag is a tag, repeated rows count each."""
    return samples.select(F.explode(tags_col).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def document_frequency(samples: DataFrame, tags_col: str = "tags") -> DataFrame:
    """(tag, df): rows that hold the tag, once or often. Null and empty lists hold none, a null tag is a tag."""
    return samples.select(F.explode(F.array_distinct(tags_col)).alias("tag")).groupBy("tag").agg(F.count("*").alias("df"))


def probabilities(frequency: DataFrame) -> DataFrame:
    """(tag, n, p) of a (tag, n) table."""
    total = frequency.agg(F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0))).alias("__total"))
    return frequency.crossJoin(F.broadcast(total)).select("tag", "n", (F.col("n") / F.col("__total")).alias("p"))  # one row


#: Tags of a sample up to which all its pairs are made: that is linear in tags, and cheaper than to look each tag up.
SHORT = 64


def pairs(samples: DataFrame, tags_col: str = "tags", frequent: DataFrame | None = None) -> DataFrame:
    """(left, right, times) of each sample's distinct tags in order, made within the sample; null tags make none.

    ``frequent`` (tag): in samples of more than ``SHORT`` tags those outside it make no pair. A pair's support is no more
    than either tag's, so tags below the least support can go first; that keeps samples with very many rare tags from
    making their square in pairs. Shorter samples make all theirs where they lie, no tag of them is shuffled. A sample is
    a row, whatever its id: of the long ones rows with equal sets of tags are one group that counts ``times``.
    """
    distinct = F.array_sort(F.array_compact(F.array_distinct(tags_col)))
    rows = samples.select(distinct.alias("t"))
    made = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("left"), y.alias("right")))))
    listed = lambda frame, times: frame.select(F.explode(made).alias("pair"), times.alias("times")).select("pair.left", "pair.right", "times")
    if frequent is None:
        return listed(rows, F.lit(1).cast("long"))
    long = rows.where(F.size("t") > SHORT).select(F.sha2(F.to_json("t").cast("binary"), 256).alias("row"), F.explode("t").alias("tag"))
    kept = long.join(frequent.select("tag"), "tag", "left_semi")
    # equal rows repeat each of their tags equally often
    held = F.collect_set("tag")
    groups = kept.groupBy("row").agg(F.array_sort(held).alias("t"), (F.count("*") / F.size(held)).cast("long").alias("times"))
    return listed(rows.where(F.size("t") <= SHORT), F.lit(1).cast("long")).unionByName(listed(groups, F.col("times")))


def pair_counts(samples: DataFrame, tags_col: str = "tags", min_support: int = 1, documents: DataFrame | None = None) -> DataFrame:
    """(left, right, c) of pairs in ``min_support`` samples or more.

    ``documents`` (tag, df): ``document_frequency`` of the same samples, if it is at hand.
    """
    frequent = None
    if min_support > 1:
        frequent = (document_frequency(samples, tags_col) if documents is None else documents).where(F.col("df") >= min_support)
    return pairs(samples, tags_col, frequent).groupBy("left", "right").agg(F.sum("times").alias("c")).where(F.col("c") >= min_support)
