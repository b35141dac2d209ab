"""Rules over the signals of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samphire.sources.rules import Rule

#: Signal names and the report columns behind them.
SIGNALS = {
    "sampleCount": "sample_count",
    "tokenCount": "token_count",
    "uniqueTagCount": "unique_tag_count",
    "entropy": "entropy",
    "effectiveTagCount": "effective_tag_count",
    "gini": "gini",
    "hhi": "hhi",
    "jsdToTarget": "jensen_shannon_divergence_to_target",
    "communityCount": "community_hint.community_count",
    "modularityHint": "community_hint.modularity_hint",
    "nearDuplicateRate": "near_duplicate_rate_hook.rate",
    "tokenLengthOverflowRate": "token_length_overflow_rate",
}
TOLERANCE = 1e-12
RULES = "rule_id string, description string, severity string, pos int, conditions array<struct<signal:string,operator:string,value:double>>, likely_failure_modes array<string>, actions array<string>"


def report_signals(report: DataFrame) -> DataFrame:
    """(signal, value) of a one-row report, the masses of its k as topKMass:k; null signals left out."""
    size = lambda c: F.size(c).cast("double")
    plain = F.create_map(*[x for name, c in SIGNALS.items() for x in (F.lit(name), F.col(c).cast("double"))], F.lit("stopTagCandidatesCount"), size("stop_tag_candidates"), F.lit("pmiAnomaliesCount"), size("pmi_anomaly_cooccurrences"))
    masses = F.transform(F.map_entries("top_k_mass"), lambda e: F.struct(F.concat(F.lit("topKMass:"), e["key"].cast("string")).alias("key"), e["value"].alias("value")))
    rows = report.select(F.explode(F.concat(F.map_entries(plain), masses)).alias("s"))
    return rows.select(F.col("s.key").alias("signal"), F.col("s.value").alias("value")).where("value IS NOT NULL")


def rules_frame(spark, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.id, r.description, r.severity, i, [(c.signal, c.operator, c.value) for c in r.conditions], list(r.likely_failure_modes), list(r.actions)) for i, r in enumerate(rules)], RULES)


def evaluate(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules all of whose conditions hold, by id and position, with each condition's actual value and explanation.

    A rule without conditions holds. A condition on an unknown or null signal doesn't. topKMass:k reads k as a number, so
    blanks around it or a plus sign before it don't matter.
    """
    each = rules.select("*", F.posexplode_outer("conditions").alias("at", "c"))
    k = F.expr("try_cast(split(c.signal, ':', 2)[1] AS int)")
    name = F.when(F.col("c.signal").startswith("topKMass:"), F.concat(F.lit("topKMass:"), k.cast("string"))).otherwise(F.col("c.signal"))
    joined = each.withColumn("__name", name).join(F.broadcast(signals.withColumnRenamed("signal", "__name")), "__name", "left")  # signals of one report
    v, e = F.col("value"), F.col("c.value")
    holds = F.coalesce(
        F.when(F.col("c.operator") == "GreaterThan", v > e)
        .when(F.col("c.operator") == "GreaterThanOrEqual", v >= e)
        .when(F.col("c.operator") == "LessThan", v < e)
        .when(F.col("c.operator") == "LessThanOrEqual", v <= e)
        .when(F.col("c.operator") == "Equal", F.abs(v - e) < TOLERANCE)
        .when(F.col("c.operator") == "NotEqual", F.abs(v - e) >= TOLERANCE),
        F.lit(False),
    )
    told = F.when(v.isNull(), F.lit("Signal not found.")).when(holds, F.lit("Condition matched.")).otherwise(F.lit("Condition did not match."))
    tried = F.when(F.col("at").isNotNull(), F.struct("at", F.col("c.signal").alias("signal"), F.col("c.operator").alias("operator"), e.alias("expected_value"), v.alias("actual_value"), holds.alias("is_match"), told.alias("explanation")))
    keys = ["pos", "rule_id", "severity", "description"]
    grouped = joined.groupBy(*keys).agg(F.coalesce(F.bool_and(F.when(F.col("at").isNotNull(), holds)), F.lit(True)).alias("ok"), F.array_sort(F.collect_list(tried)).alias("evaluations"), F.first("likely_failure_modes").alias("likely_failure_modes"), F.first("actions").alias("actions"))
    return grouped.where("ok").orderBy("rule_id", "pos").select("rule_id", "severity", "likely_failure_modes", "actions", F.transform("evaluations", lambda x: x.dropFields("at")).alias("conditions"), "description")
