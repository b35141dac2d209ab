"""The registered queries of the tag-health operators over the star-schema tables, and their SQL for DuckDB.

Order baskets are the samples with small tag sets (words of a part's name and type), documents those with long ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samphire.config import DuplicateOptions, MetricsOptions, NormalizationRules
from samphire.functions import images, text
from samphire.operators import duplicates, graph, metrics, normalize, recommend
from samphire.operators import frequency as counts
from samphire.plans.report import metrics_report
from samphire.sources import rules as rule_files
from samphire.sources import scan, sinks
from samphire.sources.rules import Condition, Rule
from samphire.streaming.counts import windowed_tag_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TARGET = {"economy": 3.0, "small": 1.0, "standard": 2.0, "unseen": 1.0}
RULES = NormalizationRules(" ", ("#", "_", "-"), {"Economy": "eco", "brand 11": "house"}, ("promo", "brand-12"))
EDGE, SUPPORT, LIMIT = 4000, 2, 15
BANDS = DuplicateOptions()
ADVICE = [
    Rule("broad", "Many tags in use.", "Info", (Condition("uniqueTagCount", "GreaterThan", 10.0), Condition("topKMass:1", "LessThan", 0.5))),
    Rule("drift", "Far from the target.", "Warning", (Condition("jsdToTarget", "GreaterThanOrEqual", 0.01),)),
    Rule("empty", "Always.", "Info"),
    Rule("huge", "Never at this size.", "Critical", (Condition("sampleCount", "LessThan", 1.0),)),
    Rule("unknown", "No such signal.", "Info", (Condition("noSuchSignal", "GreaterThan", 0.0),)),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, tags): lower-case words of the names and types of an order's parts."""
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    parts = table(spark, sf_dir, "part").select("p_partkey", words.alias("w"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.flatten(F.collect_list("w")).alias("tags"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, tags): lower-case words of documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.split(F.lower("text"), " ").alias("tags"))


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


TOK = """tok AS (
  SELECT l_orderkey AS sample_id, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS tag
  FROM lineitem JOIN part ON l_partkey = p_partkey),
freq AS (SELECT tag, count(*) AS n FROM tok GROUP BY tag),
ids AS (SELECT count(DISTINCT sample_id) AS samples FROM tok),
uniq AS (SELECT DISTINCT sample_id, tag FROM tok),
docs AS (SELECT tag, count(*) AS df FROM uniq GROUP BY tag),
pairs AS (SELECT a.tag AS l, b.tag AS r, count(*) AS c FROM uniq a JOIN uniq b ON a.sample_id = b.sample_id AND a.tag < b.tag GROUP BY 1, 2)"""
WORDS = """tok AS (SELECT doc_id AS sample_id, unnest(string_split(lower(text), ' ')) AS tag FROM documents),
freq AS (SELECT tag, count(*) AS n FROM tok GROUP BY tag)"""
REACH = f"""edges AS (SELECT l AS a, r AS b FROM pairs WHERE c >= {EDGE} UNION SELECT r, l FROM pairs WHERE c >= {EDGE}),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a),
comps AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query(f"WITH {TOK} SELECT tag, CAST(n AS BIGINT) AS n FROM freq")
def tag_frequency(spark, sf_dir):
    return counts.term_frequency(baskets(spark, sf_dir))


@query(f"WITH {WORDS} SELECT tag, CAST(n AS BIGINT) AS n FROM freq")
def word_frequency(spark, sf_dir):
    return counts.term_frequency(documents(spark, sf_dir))


@query(f"WITH {TOK} SELECT tag, CAST(df AS BIGINT) AS df FROM docs")
def doc_frequency(spark, sf_dir):
    return counts.document_frequency(baskets(spark, sf_dir))


@query(f"WITH {TOK} SELECT tag, CAST(n AS BIGINT) AS n, round(n / (SELECT CAST(sum(n) AS DOUBLE) FROM freq), 6) AS p FROM freq")
def tag_probabilities(spark, sf_dir):
    return counts.probabilities(counts.term_frequency(baskets(spark, sf_dir))).withColumn("p", F.round("p", 6))


@query(f"WITH {TOK} SELECT CAST(samples AS BIGINT) AS sample_count, CAST((SELECT count(*) FROM tok) AS BIGINT) AS token_count FROM ids")
def sample_token_counts(spark, sf_dir):
    return counts.sample_counts(baskets(spark, sf_dir))


CONCENTRATION = """SELECT CAST(sum(n) AS BIGINT) AS token_count, count(*) AS unique_tag_count,
  round(ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n)::DOUBLE, 6) AS entropy,
  round(sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)::DOUBLE), 6) AS hhi,
  round(exp(ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n)::DOUBLE), 4) AS effective_tag_count FROM freq"""


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select("token_count", "unique_tag_count", F.round("entropy", 6).alias("entropy"), F.round("hhi", 6).alias("hhi"), F.round("effective_tag_count", 4).alias("effective_tag_count"))


@query(f"WITH {TOK} {CONCENTRATION}")
def entropy_and_concentration(spark, sf_dir):
    return _rounded(metrics.concentration(counts.term_frequency(baskets(spark, sf_dir))))


@query(f"WITH {WORDS} {CONCENTRATION}")
def word_concentration(spark, sf_dir):
    return _rounded(metrics.concentration(counts.term_frequency(documents(spark, sf_dir))))


GINI = "SELECT round((count(*) + 1 - 2 * sum(s) / max(t)) / count(*), 6) AS gini FROM (SELECT CAST(sum(n) OVER (ORDER BY n, tag ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS s, CAST(sum(n) OVER () AS DOUBLE) AS t FROM freq)"


@query(f"WITH {TOK} {GINI}")
def gini(spark, sf_dir):
    return metrics.gini(counts.term_frequency(baskets(spark, sf_dir))).select(F.round("gini", 6).alias("gini"))


@query(f"WITH {WORDS} {GINI}")
def word_gini(spark, sf_dir):
    return metrics.gini(counts.term_frequency(documents(spark, sf_dir))).select(F.round("gini", 6).alias("gini"))


@query(
    f"""WITH {WORDS}, ranked AS (SELECT n, row_number() OVER (ORDER BY n DESC, tag) AS rank FROM freq)
SELECT k, round(coalesce(sum(CASE WHEN rank <= k THEN n END), 0) / CAST(sum(n) AS DOUBLE), 6) AS mass
FROM ranked, (VALUES (CAST(0 AS INTEGER)), (1), (5), (10), (1000)) AS ks(k) GROUP BY k"""
)
def topk_mass(spark, sf_dir):
    return metrics.top_k_mass(counts.term_frequency(documents(spark, sf_dir)), (10, 5, 1, 0, 1000, 5)).select("k", F.round("mass", 6).alias("mass"))


TARGET_SQL = "target(tag, weight) AS (VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in TARGET.items()) + ")"


@query(
    f"""WITH {TOK}, {TARGET_SQL}, pq AS (
  SELECT coalesce(n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM freq) AS p, coalesce(weight, 0) / (SELECT sum(weight) FROM target) AS q
  FROM freq FULL JOIN target USING (tag))
SELECT round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 6) AS jsd FROM pq"""
)
def jsd(spark, sf_dir):
    found = metrics.jensen_shannon(counts.term_frequency(baskets(spark, sf_dir)), metrics.target_frame(spark, TARGET))
    return found.select(F.round("jsd", 6).alias("jsd"))


@query(f"WITH {TOK}, {TARGET_SQL} SELECT tag FROM freq UNION SELECT tag FROM target")
def union_keys(spark, sf_dir):
    return counts.term_frequency(baskets(spark, sf_dir)).select("tag").union(metrics.target_frame(spark, TARGET).select("tag")).distinct()


@query(
    f"""WITH {WORDS}, docs AS (SELECT tag, count(DISTINCT sample_id) AS df FROM tok GROUP BY tag)
SELECT tag, CAST(df AS BIGINT) AS document_frequency, round(ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1, 6) AS inverse_document_frequency
FROM docs WHERE df >= 2 ORDER BY df DESC, tag LIMIT 25"""
)
def stop_tags(spark, sf_dir):
    samples = documents(spark, sf_dir)
    found = metrics.stop_tags(counts.document_frequency(samples), samples.count(), 2, 25)
    return found.withColumn("inverse_document_frequency", F.round("inverse_document_frequency", 6))


@query(f"WITH {TOK} SELECT l AS left_tag, r AS right_tag, CAST(c AS BIGINT) AS c FROM pairs WHERE c >= {SUPPORT}")
def pair_counts(spark, sf_dir):
    return counts.pair_counts(baskets(spark, sf_dir), min_support=SUPPORT).select(F.col("left").alias("left_tag"), F.col("right").alias("right_tag"), "c")


@query(
    f"""WITH {TOK}, scored AS (
  SELECT l AS left_tag, r AS right_tag, CAST(c AS BIGINT) AS cooccurrence_count, log2((c * (SELECT samples FROM ids)::DOUBLE) / (a.df::DOUBLE * b.df)) AS pmi
  FROM pairs JOIN docs a ON a.tag = l JOIN docs b ON b.tag = r WHERE c >= {SUPPORT})
SELECT left_tag, right_tag, cooccurrence_count, round(pmi, 6) AS pmi FROM scored
ORDER BY round(scored.pmi, 12) DESC, cooccurrence_count DESC, left_tag, right_tag LIMIT {LIMIT}"""
)
def pmi_top(spark, sf_dir):
    samples = baskets(spark, sf_dir)
    found = metrics.pointwise_mutual_information(counts.pair_counts(samples, min_support=SUPPORT), counts.document_frequency(samples), samples.count(), SUPPORT, LIMIT)
    return found.withColumn("pmi", F.round("pmi", 6))


@query(f"WITH RECURSIVE {TOK}, {REACH} SELECT node, component FROM comps")
def community_components(spark, sf_dir):
    pairs = counts.pair_counts(baskets(spark, sf_dir), min_support=EDGE)
    return graph.connected_components(pairs.select(F.col("left").alias("src"), F.col("right").alias("dst")))


@query(f"WITH RECURSIVE {TOK}, {REACH} SELECT count(DISTINCT component) AS community_count, round(coalesce(count(DISTINCT component) / nullif(count(*), 0)::DOUBLE, 0), 6) AS modularity_hint FROM comps")
def community_hint(spark, sf_dir):
    found = graph.community_hint(counts.pair_counts(baskets(spark, sf_dir), min_support=EDGE), EDGE)
    return found.withColumn("modularity_hint", F.round("modularity_hint", 6))


@query(
    f"""WITH RECURSIVE {TOK}, {REACH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY node) AS k FROM comps)
SELECT string_agg(node, ',' ORDER BY node) FILTER (WHERE k <= 5) AS preview, CAST(count(*) AS INTEGER) AS size FROM ranked GROUP BY component"""
)
def community_previews(spark, sf_dir):
    found = graph.community_previews(counts.pair_counts(baskets(spark, sf_dir), min_support=EDGE), EDGE, 5)
    return found.select(F.array_join("preview_tags", ",").alias("preview"), "size")


@query(
    """WITH g AS (SELECT sha256(text) AS k, count(*) AS c FROM documents GROUP BY 1)
SELECT round(sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / sum(c), 6) AS rate, round(sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END)::DOUBLE / sum(c), 6) AS redundant_copy_rate FROM g"""
)
def near_dup_rate(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.sha2("text", 256).alias("group_key"))
    return metrics.near_duplicate_rate(groups).select(F.round("rate", 6).alias("rate"), F.round("redundant_copy_rate", 6).alias("redundant_copy_rate"))


@query(f"WITH {WORDS} SELECT round(sum(CASE WHEN length(tag) > 12 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS overflow_rate FROM freq")
def overflow_rate(spark, sf_dir):
    return metrics.overflow_rate(counts.term_frequency(documents(spark, sf_dir)), 12).select(F.round("overflow_rate", 6).alias("overflow_rate"))


@query(f"WITH {TOK} SELECT sample_id, count(DISTINCT tag) AS distinct_tags, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tok GROUP BY sample_id")
def distinct_tags_per_sample(spark, sf_dir):
    listed = F.array_sort(F.array_distinct("tags"))
    return baskets(spark, sf_dir).select("sample_id", F.size(listed).cast("long").alias("distinct_tags"), F.array_join(listed, ",").alias("tags"))


def _part_tokens(spark, sf_dir):
    tags = F.array(F.col("p_brand"), F.col("p_type"), F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("__"))))
    # the file has few row groups, each of them a task's, and a token takes long
    return normalize.normalize(table(spark, sf_dir, "part").select("p_partkey", tags.alias("tags")).repartition("p_partkey"), RULES)


def _part_token_rows(spark, sf_dir):
    """(p_partkey, pos, t). From an inner generator Spark infers a filter on the list's size, which works all tokens out once more."""
    return _part_tokens(spark, sf_dir).select("p_partkey", F.posexplode_outer("tokens").alias("pos", "t")).where("pos IS NOT NULL")


PART_TOKENS = """src AS (
  SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest([p_brand, p_type, ' ' || replace(p_name, ' ', '__')]) AS original FROM part),
folded AS (SELECT *, lower(original) AS f FROM src),
unified AS (SELECT *, trim(regexp_replace(replace(replace(replace(trim(f), '#', ' '), '_', ' '), '-', ' '), ' {2,}', ' ', 'g')) AS u FROM folded),
mapped AS (SELECT *, CASE u WHEN 'economy' THEN 'eco' WHEN 'brand 11' THEN 'house' ELSE u END AS m FROM unified),
judged AS (SELECT *, m IN ('promo', 'brand 12') AS stopped FROM mapped)"""


@query(f"WITH {PART_TOKENS} SELECT p_partkey, CAST(pos AS INTEGER) AS pos, original, CASE WHEN NOT stopped THEN m END AS normalized, stopped AS is_filtered FROM judged")
def normalize_tokens(spark, sf_dir):
    rows = _part_token_rows(spark, sf_dir)
    return rows.select("p_partkey", "pos", "t.original", "t.normalized", "t.is_filtered")


@query(
    f"""WITH {PART_TOKENS}, events AS (
  SELECT p_partkey, pos, 0 AS step, 'CaseFold' AS action, original AS before, f AS after, NULL AS told FROM judged UNION ALL
  SELECT p_partkey, pos, 1, 'DelimiterNormalization', f, u, NULL FROM judged UNION ALL
  SELECT p_partkey, pos, 2, 'AliasMapping', u, m, NULL FROM judged UNION ALL
  SELECT p_partkey, pos, 3, 'StopTagFiltering', m, CASE WHEN NOT stopped THEN m END, CASE WHEN stopped THEN 'Filtered by stop-tag rule.' ELSE 'Token retained.' END FROM judged)
SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CAST(step AS INTEGER) AS step, action, before, after,
  coalesce(told, CASE WHEN before = after THEN 'No change.' ELSE 'Transformed ''' || before || ''' to ''' || after || '''.' END) AS message FROM events"""
)
def normalize_audit(spark, sf_dir):
    rows = _part_token_rows(spark, sf_dir)
    rows = rows.select("p_partkey", "pos", F.posexplode("t.audit").alias("step", "e"))
    return rows.select("p_partkey", "pos", "step", "e.action", "e.before", "e.after", "e.message")


@query(f"WITH {PART_TOKENS} SELECT m AS tag, count(*) AS n FROM judged WHERE NOT stopped GROUP BY m")
def normalized_frequency(spark, sf_dir):
    return counts.term_frequency(_part_tokens(spark, sf_dir).select(F.col("normalized_tags").alias("tags")))


WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(
    rf"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS collapsed_md5, length(t) = 0 AS blank FROM c"""
)
def ws_collapse(spark, sf_dir):
    t = text.collapse_white_space(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("collapsed_md5"), text.is_blank(t).alias("blank"))


@query(r"SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS INTEGER) AS utf16_length FROM documents")
def utf16_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.utf16_length(F.col("text")).alias("utf16_length"))


def _document_prints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))


@query(
    """WITH g AS (SELECT sha256(text) AS sha256, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS paths FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT 'exact-' || row_number() OVER (ORDER BY n DESC, sha256) AS group_id, sha256, paths FROM g"""
)
def exact_groups(spark, sf_dir):
    return duplicates.exact_groups(_document_prints(spark, sf_dir)).withColumn("paths", F.array_join("paths", ","))


@query("WITH g AS (SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT CAST(doc_id AS VARCHAR) AS path, sha256, copies FROM documents JOIN g ON sha256(text) = g.sha256")
def exact_members(spark, sf_dir):
    return duplicates.exact_members(_document_prints(spark, sf_dir))


def _prints(spark, sf_dir):
    """Documents as files with 64-bit hashes: twenty in a row share a hash but for up to eight bits; every 500th id is a copy."""
    word = lambda at: F.conv(F.substring(F.md5(F.floor(F.col("doc_id") / 20).cast("string")), at, 8), 16, 10).cast("long")
    base = F.shiftleft(word(1), 32).bitwiseOR(word(9)).alias("base")
    flipped = F.expr("aggregate(sequence(1, 8), base, (a, j) -> if(j <= doc_id % 9, a ^ shiftleft(1L, cast((doc_id * (2 * j + 1) + j) % 64 AS int)), a))")
    docs = table(spark, sf_dir, "documents").select("doc_id", base).select("doc_id", flipped.alias("phash"))
    return docs.select(F.format_string("v%07d", "doc_id").alias("path"), F.concat(F.lit("s"), (F.col("doc_id") % 500).cast("string")).alias("sha256"), "phash")


PRINTS = f"""words AS (SELECT doc_id, md5(CAST(doc_id // 20 AS VARCHAR)) AS m FROM documents),
based AS (SELECT doc_id, CAST('0x' || substr(m, 1, 8) AS UBIGINT) * 4294967296 + CAST('0x' || substr(m, 9, 8) AS UBIGINT) AS h FROM words),
prints AS (SELECT printf('v%07d', doc_id) AS path, 's' || CAST(doc_id % 500 AS VARCHAR) AS sha,
  list_reduce(list_prepend(CAST(h AS UBIGINT), list_transform(range(1, doc_id % 9 + 1), lambda j: CAST(1 AS UBIGINT) << CAST((doc_id * (2 * j + 1) + j) % 64 AS UBIGINT))), lambda a, b: xor(a, b)) AS h FROM based),
near AS (SELECT a.path AS left_path, b.path AS right_path, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS d
  FROM prints a JOIN prints b ON a.path < b.path AND a.sha <> b.sha AND bit_count(xor(a.h, b.h)) <= {BANDS.maybe_hamming_threshold}),
findings AS (SELECT *, CASE WHEN d <= {BANDS.likely_hamming_threshold} THEN 'Likely' ELSE 'Maybe' END AS band FROM near)"""


@query(f"WITH {PRINTS} SELECT left_path, right_path, d AS hamming_distance, band, round(1 - d / 64.0::DOUBLE, 6) AS score FROM findings")
def near_findings(spark, sf_dir):
    return duplicates.near_findings(_prints(spark, sf_dir), BANDS).withColumn("score", F.round("score", 6))


@query(
    f"""WITH RECURSIVE {PRINTS},
edges AS (SELECT left_path AS a, right_path AS b FROM findings WHERE band = 'Likely' UNION SELECT right_path, left_path FROM findings WHERE band = 'Likely'),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a),
comps AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
groups AS (SELECT component, string_agg(node, ',' ORDER BY node) AS paths, count(*) AS n FROM comps GROUP BY component),
inside AS (SELECT a.component, f.band, f.d FROM findings f JOIN comps a ON a.node = left_path JOIN comps b ON b.node = right_path AND a.component = b.component)
SELECT 'near-' || row_number() OVER (ORDER BY n DESC, g.component) AS group_id, paths, round(score, 6) AS score, likely_pair_count, maybe_pair_count
FROM groups g JOIN (SELECT component, avg(1 - d / 64.0::DOUBLE) AS score, count(*) FILTER (WHERE band = 'Likely') AS likely_pair_count, count(*) FILTER (WHERE band = 'Maybe') AS maybe_pair_count FROM inside GROUP BY component) USING (component)"""
)
def near_groups(spark, sf_dir):
    return duplicates.near_groups(_prints(spark, sf_dir), BANDS).select("group_id", F.array_join("paths", ",").alias("paths"), F.round("score", 6).alias("score"), "likely_pair_count", "maybe_pair_count")


def _caption_files(spark, sf_dir):
    """Documents as caption files: four a base, one of each kind of ending, some of them blank."""
    ending = F.element_at(F.array(*[F.lit(e) for e in (".booru.txt", ".tags.txt", ".caption.txt", ".txt", ".style.txt")]), (F.col("doc_id") % 5 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/d/"), F.floor(F.col("doc_id") / 5).cast("string"), ending).alias("path"), body.cast("binary").alias("content"))


CAPTIONS = rf"""raw AS (SELECT '/d/' || CAST(doc_id // 5 AS VARCHAR) AS base, doc_id % 5 AS e, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS t FROM documents),
f AS (SELECT base, e, regexp_replace(regexp_replace(t, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g') AS t FROM raw),
roles AS (SELECT base, e, t FROM f WHERE t <> '' UNION ALL SELECT base || CASE e WHEN 0 THEN '.booru' WHEN 1 THEN '.tags' WHEN 2 THEN '.caption' ELSE '.style' END, 3, t FROM f WHERE e <> 3 AND t <> ''),
c AS (SELECT base, arg_min(t, e) FILTER (WHERE e IN (0, 1)) AS booru_tags, arg_min(t, e) FILTER (WHERE e IN (2, 3)) AS short_caption, max(t) FILTER (WHERE e = 4) AS style_tags FROM roles GROUP BY base)"""


@query(f"WITH {CAPTIONS} SELECT base, md5(booru_tags) AS booru_tags, md5(short_caption) AS short_caption, md5(style_tags) AS style_tags FROM c")
def caption_fallback(spark, sf_dir):
    found = scan.captions(_caption_files(spark, sf_dir))
    return found.select("base", *[F.md5(F.col(k).cast("binary")).alias(k) for k in scan.SIDECARS])


def _image_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("/d/"), F.floor(F.col("doc_id") / 5).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit(".PNG")).otherwise(F.lit(".jpg"))).alias("path"), F.col("n_chars").cast("int").alias("width"), (F.col("doc_id") % 100).cast("int").alias("height"))
    found = scan.with_captions(rows, scan.captions(_caption_files(spark, sf_dir)))
    return found.withColumnRenamed("path", "relative_image_path")


IMAGES = f"""{CAPTIONS}, img AS (SELECT '/d/' || CAST(doc_id // 5 AS VARCHAR) AS base, CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS ext, n_chars AS w, doc_id % 100 AS h FROM documents),
rec AS (SELECT img.*, booru_tags IS NOT NULL AS b, short_caption IS NOT NULL AS s, style_tags IS NOT NULL AS y FROM img LEFT JOIN c USING (base))"""


@query(f"WITH {IMAGES} SELECT count(*) AS total_images, count(*) FILTER (WHERE b) AS with_booru_tags, count(*) FILTER (WHERE s) AS with_short_caption, count(*) FILTER (WHERE y) AS with_style_tags, CAST(sum(w * h) AS BIGINT) AS total_pixels FROM rec")
def scan_summary(spark, sf_dir):
    return scan.summarize(_image_rows(spark, sf_dir)).drop("by_extension")


@query(f"WITH {IMAGES} SELECT ext, count(*) AS n FROM rec GROUP BY ext")
def ext_histogram(spark, sf_dir):
    return scan.summarize(_image_rows(spark, sf_dir)).select(F.explode("by_extension").alias("ext", "n"))


@query("SELECT page_id, md5(html) AS md5, sha256(html) AS sha256, '/' || split_part(url, '/', -1) AS tail FROM pages")
def hash_projection(spark, sf_dir):
    html = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html).alias("md5"), F.sha2(html, 256).alias("sha256"), F.concat(F.lit("/"), F.element_at(F.split("url", "/"), -1)).alias("tail"))


OPTIONS = MetricsOptions(target_distribution=TARGET, community_edge_weight_threshold=EDGE, max_pmi_anomalies=LIMIT, max_stop_tag_candidates=LIMIT, max_token_length=6)


def _report(spark, sf_dir):
    return metrics_report(baskets(spark, sf_dir), OPTIONS)


SIGNALS = f"""{TOK}, {REACH}, {TARGET_SQL},
pq AS (SELECT coalesce(n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM freq) AS p, coalesce(weight, 0) / (SELECT sum(weight) FROM target) AS q FROM freq FULL JOIN target USING (tag)),
con AS ({CONCENTRATION}), gin AS ({GINI}),
ranked AS (SELECT n, row_number() OVER (ORDER BY n DESC, tag) AS rank FROM freq),
signals(signal, value) AS (
  SELECT 'sampleCount', samples::DOUBLE FROM ids UNION ALL
  SELECT 'tokenCount', token_count::DOUBLE FROM con UNION ALL
  SELECT 'uniqueTagCount', unique_tag_count::DOUBLE FROM con UNION ALL
  SELECT 'entropy', entropy FROM con UNION ALL
  SELECT 'effectiveTagCount', effective_tag_count FROM con UNION ALL
  SELECT 'hhi', hhi FROM con UNION ALL
  SELECT 'gini', gini FROM gin UNION ALL
  SELECT 'jsdToTarget', sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END) FROM pq UNION ALL
  SELECT 'stopTagCandidatesCount', least({LIMIT}, count(*))::DOUBLE FROM docs WHERE df >= 2 UNION ALL
  SELECT 'pmiAnomaliesCount', least({LIMIT}, count(*))::DOUBLE FROM pairs WHERE c >= {SUPPORT} UNION ALL
  SELECT 'communityCount', count(DISTINCT component)::DOUBLE FROM comps UNION ALL
  SELECT 'modularityHint', coalesce(count(DISTINCT component) / nullif(count(*), 0)::DOUBLE, 0) FROM comps UNION ALL
  SELECT 'tokenLengthOverflowRate', sum(CASE WHEN length(tag) > 6 THEN n ELSE 0 END)::DOUBLE / sum(n) FROM freq UNION ALL
  SELECT 'topKMass:' || k, sum(CASE WHEN rank <= k THEN n END)::DOUBLE / sum(n) FROM ranked, (VALUES (1), (5), (10)) AS ks(k) GROUP BY k)"""


@query(f"WITH RECURSIVE {SIGNALS} SELECT signal, round(value, 4) AS value FROM signals")
def report_signals(spark, sf_dir):
    return recommend.report_signals(_report(spark, sf_dir)).select("signal", F.round("value", 4).alias("value"))


@query(
    f"""WITH RECURSIVE {SIGNALS}
SELECT 'broad' AS rule_id, 'Info' AS severity, CAST(2 AS INTEGER) AS conditions WHERE (SELECT value FROM signals WHERE signal = 'uniqueTagCount') > 10 AND (SELECT value FROM signals WHERE signal = 'topKMass:1') < 0.5
UNION ALL SELECT 'drift', 'Warning', 1 WHERE (SELECT value FROM signals WHERE signal = 'jsdToTarget') >= 0.01
UNION ALL SELECT 'empty', 'Info', 0
UNION ALL SELECT 'huge', 'Critical', 1 WHERE (SELECT value FROM signals WHERE signal = 'sampleCount') < 1"""
)
def recommend_matches(spark, sf_dir):
    found = recommend.evaluate(recommend.report_signals(_report(spark, sf_dir)), recommend.rules_frame(spark, ADVICE))
    return found.select("rule_id", "severity", F.size("conditions").alias("conditions"))


@query(
    f"""WITH RECURSIVE {SIGNALS} SELECT
  CAST(max(CASE WHEN signal = 'sampleCount' THEN value END) AS BIGINT) AS sample_count, CAST(max(CASE WHEN signal = 'tokenCount' THEN value END) AS BIGINT) AS token_count,
  CAST(max(CASE WHEN signal = 'uniqueTagCount' THEN value END) AS BIGINT) AS unique_tag_count, round(max(CASE WHEN signal = 'entropy' THEN value END), 6) AS entropy,
  round(max(CASE WHEN signal = 'gini' THEN value END), 6) AS gini, round(max(CASE WHEN signal = 'hhi' THEN value END), 6) AS hhi,
  round(max(CASE WHEN signal = 'jsdToTarget' THEN value END), 6) AS jsd, round(max(CASE WHEN signal = 'topKMass:5' THEN value END), 6) AS top_5_mass,
  round(max(CASE WHEN signal = 'tokenLengthOverflowRate' THEN value END), 6) AS overflow_rate FROM signals"""
)
def metrics_report_summary(spark, sf_dir):
    r = _report(spark, sf_dir)
    six = lambda c, name: F.round(c, 6).alias(name)
    return r.select("sample_count", "token_count", "unique_tag_count", six("entropy", "entropy"), six("gini", "gini"), six("hhi", "hhi"), six("jensen_shannon_divergence_to_target", "jsd"), six(F.col("top_k_mass")[5], "top_5_mass"), six("token_length_overflow_rate", "overflow_rate"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS tag, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, sf_dir):
    return windowed_tag_counts(table(spark, sf_dir, "events"), "ts", "event_type").select(F.col("window.start").alias("window_start"), "tag", "n")


@query(
    """WITH t AS (SELECT row_number() OVER () AS row, lower(p_name || ' ' || p_type) AS words FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT row, unnest(list_distinct(string_split(words, ' '))) AS tag FROM t)
SELECT a.tag AS left_tag, b.tag AS right_tag, count(*) AS c FROM r a JOIN r b ON a.row = b.row AND a.tag < b.tag GROUP BY 1, 2 HAVING count(*) >= 20"""
)
def pair_counts_by_row(spark, sf_dir):
    """Samples whose ids repeat or are null: each row is a sample."""
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    parts = table(spark, sf_dir, "part").select("p_partkey", words.alias("tags"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 3).alias("sample_id"))
    samples = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("sample_id", "tags")
    return counts.pair_counts(samples, min_support=20).select(F.col("left").alias("left_tag"), F.col("right").alias("right_tag"), "c")


@query(
    f"""WITH {TOK}, g AS (SELECT DISTINCT sample_id, CASE WHEN sample_id % 3 = 0 THEN 'g' || CAST(sample_id % 100 AS VARCHAR) WHEN sample_id % 3 = 1 THEN ' ' END AS k FROM tok),
sized AS (SELECT k, count(*) AS n FROM g GROUP BY k)
SELECT 'nearDuplicateRate' AS signal, round(sum(CASE WHEN n > 1 AND trim(k) <> '' THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS value FROM sized"""
)
def near_duplicate_signal(spark, sf_dir):
    samples = baskets(spark, sf_dir)
    key = F.when(F.col("sample_id") % 3 == 0, F.concat(F.lit("g"), (F.col("sample_id") % 100).cast("string"))).when(F.col("sample_id") % 3 == 1, F.lit(" "))
    report = metrics_report(samples, OPTIONS, samples.select("sample_id", key.alias("group_key")))
    return recommend.report_signals(report).where("signal = 'nearDuplicateRate'").select("signal", F.round("value", 6).alias("value"))


@query(
    f"""WITH RECURSIVE {SIGNALS}, asked(rule_id, pos, signal, operator, expected) AS (VALUES
  ('broad', 0, 'uniqueTagCount', 'GreaterThan', 10.0::DOUBLE), ('broad', 1, 'topKMass:1', 'LessThan', 0.5), ('drift', 0, 'jsdToTarget', 'GreaterThanOrEqual', 0.01),
  ('same', 0, 'communityCount', 'NotEqual', -1.0), ('same', 1, 'hhi', 'LessThanOrEqual', 1.0), ('same', 2, 'stopTagCandidatesCount', 'Equal', {LIMIT}.0))
SELECT rule_id, CAST(pos AS INTEGER) AS pos, asked.signal, operator, expected AS expected_value, round(value, 4) AS actual_value, true AS is_match, 'Condition matched.' AS explanation
FROM asked JOIN signals ON asked.signal = signals.signal"""
)
def recommend_conditions(spark, sf_dir):
    more = Rule("same", "Every other comparison.", "Warning", (Condition("communityCount", "NotEqual", -1.0), Condition("hhi", "LessThanOrEqual", 1.0), Condition("stopTagCandidatesCount", "Equal", float(LIMIT))))
    found = recommend.evaluate(recommend.report_signals(_report(spark, sf_dir)), recommend.rules_frame(spark, [*ADVICE, more]))
    each = found.select("rule_id", F.posexplode("conditions").alias("pos", "c"))
    return each.select("rule_id", "pos", "c.signal", "c.operator", "c.expected_value", F.round("c.actual_value", 4).alias("actual_value"), "c.is_match", "c.explanation")


RULE_JSON = '''{"RULES": [{"Id": "one", "severity": 1, "conditions": [{"signal": "hhi", "operator": "lessthan", "value": 0.5}, {"signal": "topKMass: 5", "operator": 1, "value": 2}]},
  {"id": " ", "severity": "Info"}, {"id": "two", "description": "d", "severity": "critical", "conditions": []}]}'''
RULE_YAML = "rules:\n- id: three\n  severity: Info\n  conditions:\n  - {signal: gini, operator: NotEqual, value: 0}\n"


@query(
    """SELECT CAST(r AS VARCHAR) AS rule_id, s AS severity, CAST(n AS INTEGER) AS pos, g AS signal, o AS operator, v::DOUBLE AS value FROM (VALUES
  ('one', 'Warning', 0, 'hhi', 'LessThan', 0.5), ('one', 'Warning', 1, 'topKMass: 5', 'GreaterThanOrEqual', 2.0), ('two', 'Critical', -1, '', '', 0.0), ('three', 'Info', 0, 'gini', 'NotEqual', 0.0)) AS t(r, s, n, g, o, v)"""
)
def parsed_rules(spark, sf_dir):
    rules = [*rule_files.recommendation_rules_json(RULE_JSON), *rule_files.recommendation_rules_yaml(RULE_YAML)]
    rows = recommend.rules_frame(spark, rules).select("rule_id", "severity", F.posexplode_outer("conditions").alias("pos", "c"))
    return rows.select("rule_id", "severity", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("c.signal", F.lit("")).alias("signal"), F.coalesce("c.operator", F.lit("")).alias("operator"), F.coalesce("c.value", F.lit(0.0)).alias("value"))


@query("SELECT n_name, trim(replace(replace(lower(n_name), ' ', '_'), 'u', '_')) AS normalized FROM nation")
def normalize_by_rule_file(spark, sf_dir):
    rules = rule_files.normalization_rules('{"CANONICALDELIMITER": "_", "delimiters": ["u", "  "], "stopTags": null}')
    names = table(spark, sf_dir, "nation").select("n_name", F.array(F.replace("n_name", F.lit(" "), F.lit("U"))).alias("tags"))
    single = normalize.normalize(names, rules).select("n_name", F.col("normalized_tags")[0].alias("normalized"))
    return single


@query("SELECT DISTINCT '/d/' || CAST(doc_id % 50 AS VARCHAR) AS path FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def distinct_paths(spark, sf_dir):
    path = F.when(F.col("doc_id") % 7 == 0, F.lit(" \t")).when(F.col("doc_id") % 11 != 0, F.concat(F.lit("/d/"), (F.col("doc_id") % 50).cast("string")))
    return scan.clean_paths(table(spark, sf_dir, "documents").select(path.alias("path")))


#: Files of the scan queries as (path, bytes in hexadecimal): images by their headers, captions by their marks.
IMAGE_FILES = {
    "/r/a.png": "89504E470D0A1A0A0000000D49484452000000050000000708020000",
    "/r/deep/b.GIF": "47494638396103000400",
    "/r/c.jpg": "FFD8FFE000064A46FFFFFFC20011080102020304010203040506070809FFDA",
    "/r/d.tiff": "4D4D002A00000008000201000003000000010009000001010004000000010001000000000000",
    "/r/e.bmp": "424D000000000000000000000000280000000B000000F4FFFFFF",
}
CAPTION_FILES = {
    "/r/a.booru.txt": "EFBBBF6F6E652C2074776F",
    "/r/a.tags.txt": "73706172652074616773",
    "/r/a.style.txt": "FFFE000070000000F400010020000000",
    "/r/deep/b.txt": "FEFF00200077D83DDE0000200020DC00006441",
    "/r/deep/b.caption.txt": "20090A",
    "/r/c.caption.txt": "FFFE6300610066000A00E900",
    "/r/d.txt": "61FF62",
}


def _files(spark, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), "path string, hex string").select("path", F.unhex("hex").alias("content"))


def _values(files: dict[str, str]) -> str:
    return ", ".join(f"('{p}', '{h}')" for p, h in files.items())


@query(
    f"""WITH files(path, hex) AS (VALUES {_values(IMAGE_FILES)}),
told(path, width, height, booru_tags, short_caption, style_tags) AS (VALUES
  ('a.png', 5, 7, 'one, two', NULL, 'p' || chr(65780)), ('deep/b.GIF', 3, 4, NULL, 'w' || chr(128512) || ' ' || chr(65533) || 'd' || chr(65533), NULL),
  ('c.jpg', 515, 258, NULL, 'caf ' || chr(233), NULL), ('d.tiff', 9, 65536, NULL, 'a' || chr(65533) || 'b', NULL), ('e.bmp', 11, 12, NULL, NULL, NULL))
SELECT told.path AS relative_image_path, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, md5(from_hex(hex)) AS md5, sha256(from_hex(hex)) AS sha256,
  booru_tags, short_caption, style_tags, booru_tags IS NOT NULL AS has_booru_tags, short_caption IS NOT NULL AS has_short_caption, style_tags IS NOT NULL AS has_style_tags
FROM told JOIN files ON files.path = '/r/' || told.path"""
)
def scan_records(spark, sf_dir):
    found = scan.records(_files(spark, IMAGE_FILES), _files(spark, CAPTION_FILES), "/r")
    return found.select("relative_image_path", "width", "height", "hashes.*", "caption_sources.*", "caption_presence.*")


@query(
    f"""WITH files(path, hex) AS (VALUES {_values({p: h for p, h in IMAGE_FILES.items() if p.endswith((".bmp", ".GIF"))})})
SELECT '{{"relativeImagePath":"' || path[4:] || '","width":' || CASE WHEN path LIKE '%bmp' THEN '11,"height":12' ELSE '3,"height":4' END || ',"hashes":{{"md5":"' || md5(from_hex(hex)) || '","sha256":"' || sha256(from_hex(hex))
  || '"}},"captionSources":{{"booruTags":null,"shortCaption":null,"styleTags":null}},"captionPresence":{{"hasBooruTags":false,"hasShortCaption":false,"hasStyleTags":false}}}}' AS value FROM files"""
)
def scan_json_lines(spark, sf_dir):
    files = _files(spark, {p: h for p, h in IMAGE_FILES.items() if p.endswith((".bmp", ".GIF"))})
    return sinks.json_lines(scan.records(files, _files(spark, CAPTION_FILES).where("false"), "/r"), ["relative_image_path"])


#: Images of the hash query, and the pixel (x, y) of image i in channel c.
HASHED = 12
PIXEL = "((x * x * (i + 3) + y * y * 7 + x * y * (c + 5) + (i + 1) * 37 * c) % 251)"


@query(
    f"""WITH xs AS (SELECT unnest(range(32)) AS x), ks AS (SELECT unnest(range(8)) AS k), pic AS (SELECT unnest(range({HASHED})) AS i),
luma AS (SELECT i, x, y, round(0.0722::DOUBLE * {PIXEL.replace("c", "0")} + 0.7152::DOUBLE * {PIXEL.replace("c", "1")} + 0.2126::DOUBLE * {PIXEL.replace("c", "2")}) AS p
  FROM pic, xs, (SELECT x AS y FROM xs) AS ys),
basis AS (SELECT k, x, CASE WHEN k = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END * cos((2 * x + 1) * k * pi() / 64) AS w FROM ks, xs),
rows_ AS (SELECT i, y, k AS u, sum(p * w) AS r FROM luma JOIN basis USING (x) GROUP BY i, y, k),
coef AS (SELECT i, 8 * k + u AS bit, sum(r * w) AS f FROM rows_ JOIN basis ON basis.x = rows_.y GROUP BY i, k, u),
mid AS (SELECT i, median(f) AS m FROM coef WHERE bit > 0 GROUP BY i),
bits AS (SELECT i, sum(CASE WHEN bit > 0 AND f > m THEN CAST(1 AS HUGEINT) << CAST(bit AS HUGEINT) ELSE 0 END) AS h FROM coef JOIN mid USING (i) GROUP BY i)
SELECT CAST(i AS BIGINT) AS i, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS phash FROM bits"""
)
def image_hashes(spark, sf_dir):
    """Perceptual hashes of made-up images of 32 by 32 pixels in blue, green and red."""
    place = lambda n: (F.floor(F.col("at") / n)).cast("int")
    flat = spark.range(HASHED).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(32 * 32 * 3 - 1))))
    point = flat.select(F.col("id").alias("i"), "at", (place(3) % 32).alias("x"), place(96).alias("y"), (F.col("at") % 3).alias("c"))
    told = point.select("i", "at", F.expr(f"lpad(hex({PIXEL}), 2, '0')").alias("h"))
    raw = told.groupBy("i").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda p: p["h"]), "")).alias("data"))
    return raw.select("i", images.perceptual_hash(F.lit(32), F.lit(32), F.lit(3), F.col("data")).alias("phash"))


QUERIES["metrics_report"] = metrics_report_summary
ORACLES["metrics_report"] = ORACLES["metrics_report_summary"]
