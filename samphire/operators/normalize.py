"""Tag normalization with an audit trail: case, delimiters, aliases, stop tags. Narrow: no row is shuffled."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samphire.config import NormalizationRules
from samphire.functions.text import WHITE, fold, quote, strip

ACTIONS = ("CaseFold", "DelimiterNormalization", "AliasMapping", "StopTagFiltering")


def _bordered(text: str) -> bool:
    """Whether a proper prefix is also a suffix, so that copies of the text can overlap."""
    return any(text.startswith(text[-n:]) for n in range(1, len(text)))


def unify_delimiters(x: Column, rules: NormalizationRules) -> Column:
    """Each delimiter, longest first, becomes the canonical one; runs of that collapse."""
    canonical = rules.canonical_delimiter
    out = strip(x)
    for delimiter in sorted((d for d in rules.delimiters if d.strip()), key=lambda d: -len(d)):
        out = F.replace(out, F.lit(delimiter), F.lit(canonical))
    if not canonical:
        return out
    if not _bordered(canonical):
        out = F.regexp_replace(out, f"(?:{quote(canonical)}){{2,}}", canonical.replace("\\", "\\\\").replace("$", "\\$"))
        return strip(out)
    # copies may overlap: replace doubled ones until none is left; each round shortens the text, and doubling covers any length
    step = lambda acc, _: F.replace(acc, F.lit(canonical * 2), F.lit(canonical))
    return strip(F.aggregate(F.sequence(F.lit(0), F.length(out)), out, step))


def _normalized(values: list[str], rules: NormalizationRules) -> list[str]:
    """``values`` as tokens come out of case folding and delimiters, by the same expressions."""
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["v"] for r in table.select("i", unify_delimiters(fold(F.col("v")), rules).alias("v")).orderBy("i").collect()]  # the rules' own size


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    """The key's value, or null. A literal of small maps, one for each value of a hash: the time doesn't grow with the table."""
    size = max(1, len(pairs) // 4)
    spark = SparkSession.getActiveSession()
    hashes = spark.createDataFrame([(k,) for k in pairs], "k string").select("k", F.pmod(F.xxhash64("k"), F.lit(size)).alias("h")).collect()
    slots: list[dict[str, str]] = [{} for _ in range(size)]
    for row in hashes:
        slots[row["h"]][row["k"]] = pairs[row["k"]]
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")  # constant: folded once
    return F.try_element_at(F.element_at(table, (F.pmod(F.xxhash64(key), F.lit(size)) + 1).cast("int")), key)


def _event(action: str, before: Column, after: Column, message: Column | None = None) -> Column:
    told = F.when(before.eqNullSafe(after), F.lit("No change.")).otherwise(F.concat(F.lit("Transformed '"), before, F.lit("' to '"), after, F.lit("'.")))
    return F.struct(F.lit(action).alias("action"), before.alias("before"), after.alias("after"), (told if message is None else message).alias("message"))


def token_results(tags: Column, rules: NormalizationRules) -> Column:
    """array of (original, normalized, is_filtered, audit) of an array of tokens; null tokens read as empty."""
    told = _normalized([*rules.aliases, *rules.aliases.values(), *rules.stop_tags], rules) if rules.aliases or rules.stop_tags else []
    n = len(rules.aliases)
    aliases = dict(zip(told[:n], told[n : 2 * n], strict=True))  # of keys that become equal the last one wins
    stops = {tag: "" for tag in told[2 * n :]}

    def one(token: Column) -> Column:
        original = F.coalesce(token, F.lit(""))
        folded = fold(original)
        unified = unify_delimiters(folded, rules)
        return F.struct(original.alias("original"), folded.alias("folded"), unified.alias("unified"))

    def aliased(t: Column) -> Column:
        mapped = F.coalesce(_lookup(aliases, t["unified"]), t["unified"]) if aliases else t["unified"]
        return F.struct(t["original"].alias("original"), t["folded"].alias("folded"), t["unified"].alias("unified"), mapped.alias("mapped"))

    def looked_up(t: Column) -> Column:
        stopped = _lookup(stops, t["mapped"]).isNotNull() if stops else F.lit(False)
        return F.struct(*[t[name].alias(name) for name in ("original", "folded", "unified", "mapped")], stopped.alias("stopped"))

    def judged(t: Column) -> Column:
        stopped = t["stopped"]
        normalized = F.when(~stopped, t["mapped"])
        message = F.when(stopped, F.lit("Filtered by stop-tag rule.")).otherwise(F.lit("Token retained."))
        audit = F.array(
            _event(ACTIONS[0], t["original"], t["folded"]),
            _event(ACTIONS[1], t["folded"], t["unified"]),
            _event(ACTIONS[2], t["unified"], t["mapped"]),
            _event(ACTIONS[3], t["mapped"], normalized, message),
        )
        return F.struct(t["original"].alias("original"), normalized.alias("normalized"), stopped.alias("is_filtered"), audit.alias("audit"))

    # a step each, so that what several fields need is found once
    return F.transform(F.transform(F.transform(F.transform(tags, one), aliased), looked_up), judged)


def normalize(samples: DataFrame, rules: NormalizationRules, tags_col: str = "tags") -> DataFrame:
    """``samples`` with ``tokens`` (results with their audit) and ``normalized_tags`` (retained ones, in order)."""
    results = samples.withColumn("tokens", token_results(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), rules))
    return results.withColumn("normalized_tags", F.transform(F.filter("tokens", lambda t: ~t["is_filtered"]), lambda t: t["normalized"]))


def split_caption(caption: Column) -> Column:
    """A caption's tags: parts between commas, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(caption, F.lit("")), ","), strip), lambda t: ~t.rlike(rf"^{WHITE}*$"))
