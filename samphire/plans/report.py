"""The metrics report: one nested row, assembled from one pass each over tags, documents and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samphire.checkpoints import cut_lineage
from samphire.config import MetricsOptions
from samphire.operators import frequency as counts
from samphire.operators import graph, metrics


def metrics_report(samples: DataFrame, options: MetricsOptions = MetricsOptions(), groups: DataFrame | None = None) -> DataFrame:
    """One row of all metrics of ``samples`` (sample_id, tags).

    ``groups`` (sample_id, group_key): a near-duplicate group for each sample; without it, or with another number of
    rows, the rate is null. Samples and tables of counts are checkpointed, as several metrics read each.
    """
    spark = samples.sparkSession
    samples = cut_lineage(samples.select("tags"))
    sized = counts.sample_counts(samples).first()
    n = sized["sample_count"]
    frequency = cut_lineage(counts.term_frequency(samples))
    documents = cut_lineage(counts.document_frequency(samples))
    least = max(1, min(options.min_cooccurrence_for_pmi, options.community_edge_weight_threshold))
    pairs = cut_lineage(counts.pair_counts(samples, min_support=least, documents=documents))

    stops = metrics.stop_tags(documents, n, options.min_document_frequency_for_stop_candidate, options.max_stop_tag_candidates)
    pmi = metrics.pointwise_mutual_information(pairs, documents, n, options.min_cooccurrence_for_pmi, options.max_pmi_anomalies)
    previews = cut_lineage(graph.community_previews(pairs, options.community_edge_weight_threshold, options.community_preview_size))
    masses = metrics.top_k_mass(frequency, options.top_k_values)
    jsd = metrics.jensen_shannon(frequency, metrics.target_frame(spark, options.target_distribution))
    matched = groups is not None and groups.count() == n
    if n == 0:
        hook = spark.range(1).select(F.lit(0.0).alias("rate"), F.lit("No samples.").alias("note"))
    elif matched:
        hook = metrics.near_duplicate_rate(groups).select("rate", F.lit("Computed from provided grouping.").alias("note"))
    else:
        hook = spark.range(1).select(F.lit(None).cast("double").alias("rate"), F.lit("No near-duplicate grouping provided.").alias("note"))

    # lists are bounded by their options, all but the communities, of which each is a preview
    ordered = lambda frame, keys, name: frame.agg(F.array_sort(F.collect_list(F.struct(*keys, F.struct(*frame.columns).alias("row")))).alias("l")).select(F.transform("l", lambda x: x["row"]).alias(name))
    parts = [
        metrics.concentration(frequency),
        metrics.gini(frequency),
        masses.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "mass")))).alias("top_k_mass")),
        jsd.select(F.col("jsd").alias("jensen_shannon_divergence_to_target")),
        ordered(stops, [-F.col("document_frequency"), F.col("tag")], "stop_tag_candidates"),
        ordered(pmi, [-F.round("pmi", 12), -F.col("cooccurrence_count"), F.col("left_tag"), F.col("right_tag")], "pmi_anomaly_cooccurrences"),
        previews.agg(
            F.count("*").alias("community_count"),
            F.coalesce(F.try_divide(F.count("*"), F.sum("size")), F.lit(0.0)).alias("modularity_hint"),
            F.transform(F.array_sort(F.collect_list(F.struct(-F.col("size"), F.array_join("preview_tags", "\u0001"), F.struct("preview_tags", "size").alias("row")))), lambda x: x["row"]).alias("communities"),
        ).select(F.struct("community_count", "modularity_hint", "communities").alias("community_hint")),
        hook.select(F.struct("rate", "note").alias("near_duplicate_rate_hook")),
        metrics.overflow_rate(frequency, options.max_token_length).select(F.col("overflow_rate").alias("token_length_overflow_rate")),
    ]
    row = spark.range(1).select(F.lit(n).cast("long").alias("sample_count"))
    for part in parts:
        row = row.crossJoin(F.broadcast(part))  # one row each
    order = ["sample_count", "token_count", "unique_tag_count", "entropy", "effective_tag_count", "gini", "hhi", "top_k_mass", "jensen_shannon_divergence_to_target", "stop_tag_candidates", "pmi_anomaly_cooccurrences", "community_hint", "near_duplicate_rate_hook", "token_length_overflow_rate"]
    return row.select(*order)
