"""Exact and near duplicates of fingerprints (path, sha256, phash long).

Null hashes are never near; null paths are paths like others; repeated rows count each. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samphire.checkpoints import cut_lineage
from samphire.config import DuplicateOptions
from samphire.operators.graph import connected_components
from samphire.operators.numbering import numbered
from samphire.shipping import ship

BITS = 64
#: Values of a chunk that are looked up from one value, at most; the cost of a lookup, in candidates.
MOST_MASKS, LOOKUP_COST = 2000, 100.0
#: Hashes of a shard, about; those of one part of a shard, at most on average; comparisons in one step; links in a batch.
SHARD, PART, BLOCK, BATCH = 1 << 16, 1 << 18, 1 << 17, 1 << 16


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    return 1 - distance / 64.0


def exact_groups(fingerprints: DataFrame) -> DataFrame:
    """(group_id, sha256, paths) of hashes with two paths or more: largest first, then by hash.

    A list for each group, as a report shows them; ``exact_members`` has the groups as rows.
    """
    groups = fingerprints.groupBy("sha256").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("n")).where("n > 1")
    return numbered(groups, [F.desc("n"), "sha256"]).select(F.concat(F.lit("exact-"), F.col("number").cast("string")).alias("group_id"), "sha256", "paths")


def exact_members(fingerprints: DataFrame) -> DataFrame:
    """(path, sha256, copies) of every file that has a copy: the groups as rows, however large one is."""
    sizes = fingerprints.groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1")
    return fingerprints.select("path", "sha256").join(sizes, "sha256").select("path", "sha256", "copies")


@cache
def chunking(radius: int, rows: int) -> tuple[tuple[int, int, int], ...]:
    """(first bit, bits, radius) of the chunks by which ``rows`` hashes are searched at least cost.

    Of hashes within the radius, one chunk at least differs in no more than its own radius, if those radii add up to
    radius - chunks + 1. Few wide chunks make many lookups, many narrow ones make many candidates.
    """
    best, found = None, None
    for n in range(1, min(radius + 1, BITS) + 1):
        widths = [BITS // n + (i < BITS % n) for i in range(n)]
        radii = [(radius - n + 1) // n + (i < (radius - n + 1) % n) for i in range(n)]
        masks = [sum(comb(w, k) for k in range(min(w, r) + 1)) for w, r in zip(widths, radii, strict=True)]
        if max(masks) > MOST_MASKS:
            continue
        # values look up values, hashes meet hashes
        cost = sum(m * (LOOKUP_COST * min(rows, 2**w) + rows * rows / 2**w) for m, w in zip(masks, widths, strict=True))
        if best is None or cost < best:
            best, found = cost, tuple((sum(widths[:i]), w, r) for i, (w, r) in enumerate(zip(widths, radii, strict=True)))
    return found


def masks_within(bits: int, radius: int) -> list[int]:
    """Numbers of ``bits`` bits of which ``radius`` at most are set."""
    return [sum(1 << b for b in on) for k in range(min(bits, radius) + 1) for on in combinations(range(bits), k)]


def links_of_shard(own: np.ndarray, others: np.ndarray, chunk: int, chunks: tuple[tuple[int, int, int], ...], radius: int, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of ``own``, greater one of ``others``, distance) within the radius that ``chunk`` is the first to find.

    ``own`` has one shard's hashes, equal but for the ``low`` lower bits of the chunk; ``others`` those of it and of the
    near shards. Greater is by the chunk's value, then by the hash. Hashes of equal value are compared together.
    """
    at, bits, near = chunks[chunk]
    u = np.uint64
    value = lambda x: (x >> u(at)) & u((1 << bits) - 1)
    own, others = own[np.lexsort((own, value(own)))], others[np.argsort(value(others))]
    values, first = np.unique(value(others), return_index=True)
    first = np.r_[first, len(others)]
    heads, start = np.unique(value(own), return_index=True)
    shards = np.unique(values >> u(low))
    apart = np.bitwise_count(shards ^ (heads[0] >> u(low))).tolist()
    lower = [np.array(masks_within(low, near - k), u) for k in range(near + 1)]
    wanted = np.concatenate([(s << u(low)) | lower[k] for s, k in zip(shards, apart, strict=True) if k <= near])
    for v, group in zip(heads, np.split(own, start[1:]), strict=True):
        asked = wanted ^ (v & u((1 << low) - 1))
        asked = asked[asked >= v]
        place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        place = place[values[place] == asked]
        size = first[place + 1] - first[place]
        end = np.cumsum(size)
        met = others[np.repeat(first[place] - (end - size), size) + np.arange(end[-1])]  # v itself is among them
        step = max(1, BLOCK // len(met))
        for i in range(0, len(group), step):
            distance = np.bitwise_count(group[i : i + step, None] ^ met)
            row, column = np.divmod(np.flatnonzero(distance <= radius), len(met))
            a, b, d = group[i + row], met[column], distance[row, column]
            keep = (value(b) != v) | (b > a)
            for before, wide, most in chunks[:chunk]:
                keep &= np.bitwise_count(((a ^ b) >> u(before)) & u((1 << wide) - 1)) > most
            if keep.any():
                yield a[keep], b[keep], d[keep]


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, hashes, which of them are its own) from sorted batches (shard, phash, own)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None
    for batch in batches:
        shard, phash, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if held and shard[lo] != now:
                yield (now, *map(np.concatenate, zip(*held, strict=True)))
                held = []
            now = int(shard[lo])
            held.append((phash[lo:hi].view(np.uint64), own[lo:hi]))
    if held:
        yield (now, *map(np.concatenate, zip(*held, strict=True)))


def near_hashes(fingerprints: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance) of distinct hashes a < b within the radius, by multi-index hashing.

    A chunk's value (``chunking``) tells by its upper bits in which shard a hash lies, some 65,536 hashes in each. A hash
    goes to its own shards and to those whose upper bits are near, not to each near value: these are looked up within
    the shard's task, in arrays. So a hash is sent some tens of times, a number that grows with the logarithm of the
    table. A shard of very many hashes is dealt into parts, each of which meets all that the shard meets.
    """
    if not 0 <= radius < BITS:
        raise ValueError("a radius from 0 to 63 is expected")
    ship(fingerprints.sparkSession)
    hashes = cut_lineage(fingerprints.where("phash IS NOT NULL").select("phash").distinct())
    rows = hashes.count()
    chunks = chunking(radius, 1 << max(10, rows.bit_length()))
    upper = [min(bits, 24, max(0, (rows - 1) // SHARD).bit_length()) for _, bits, _ in chunks]
    lows = [bits - up for (_, bits, _), up in zip(chunks, upper, strict=True)]
    # the sign bit is masked off after the shift
    high = lambda i: F.shiftrightunsigned("phash", chunks[i][0] + lows[i]).bitwiseAND((1 << upper[i]) - 1) if upper[i] else F.lit(0).cast("long")
    numbers = F.array(*[F.struct(F.lit(i).alias("chunk"), high(i).alias("high")) for i in range(len(chunks))])
    placed = hashes.select("phash", F.explode(numbers).alias("c")).select("phash", "c.chunk", "c.high")
    large = placed.groupBy("chunk", "high").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    dealt = {(r["chunk"] << 24) + r["high"]: -(-r["n"] // PART) for r in large.collect()}  # chunks * rows / PART at most
    lists = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks_within(up, near)]) for up, (_, _, near) in zip(upper, chunks, strict=True)])
    sent = placed.withColumn("mask", F.explode(F.element_at(lists, F.col("chunk") + 1)))
    to = F.col("high").bitwiseXOR(F.col("mask"))
    sent = sent.where(to <= F.col("high")).select("phash", (F.col("mask") == 0).alias("own"), (F.shiftleft(F.col("chunk").cast("long"), 24) + to).alias("to"))
    if dealt:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in dealt.items() for x in pair]), F.col("to")), F.lit(1).cast("long"))
        sent = sent.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        sent = sent.select("phash", (F.col("own") & (F.pmod(F.xxhash64("phash"), F.col("parts")) == F.col("part"))).alias("own"), (F.shiftleft("to", 16) + F.col("part")).alias("shard"))
    else:
        sent = sent.select("phash", "own", F.shiftleft("to", 16).alias("shard"))

    def run(batches):
        fields = ("a", "b", "distance")
        held: list[tuple[np.ndarray, ...]] = []

        def batch() -> pa.RecordBatch:
            a, b, d = map(np.concatenate, zip(*held, strict=True))
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], fields)

        size = 0
        for shard, phash, own in _whole_shards(batches):
            if not own.any():
                continue
            i = shard >> 40
            for found in links_of_shard(phash[own], phash, i, chunks, radius, lows[i]):
                held.append(found)
                size += len(found[0])
                if size >= BATCH:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    tasks = sum(1 << up for up in upper) + sum(dealt.values())
    return sent.select("shard", "phash", "own").repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long, distance int")


def classes(fingerprints: DataFrame) -> DataFrame:
    """(phash, sha256, path, files): files equal in both, by their smallest path."""
    return fingerprints.where("phash IS NOT NULL").groupBy("phash", "sha256").agg(F.min("path").alias("path"), F.count("*").alias("files"))


def near_links(fingerprints: DataFrame, options: DuplicateOptions = DuplicateOptions()) -> DataFrame:
    """(left_path, right_path, hamming_distance, band, score): ``near_findings`` between the smallest paths of hashes.

    With ``near_members`` that says all that the list of all pairs says, in rows that don't grow with the square of the
    files of one hash: a finding holds for all members of its two hashes that aren't exact copies. Files of one hash that
    differ link to its smallest path.
    """
    likely, maybe = options.likely_hamming_threshold, options.maybe_hamming_threshold
    of = classes(fingerprints).groupBy("phash").agg(F.min("path").alias("path"), F.min("sha256").alias("sha"), (F.count("*") == 1).alias("one"))
    left, right = (of.select(F.col("phash").alias(h), F.col("path").alias(f"{h}_path"), F.col("sha").alias(f"{h}_sha"), F.col("one").alias(f"{h}_one")) for h in ("a", "b"))
    pairs = near_hashes(fingerprints, max(likely, maybe)).join(left, "a").join(right, "b")
    pairs = pairs.where(~(F.col("a_one") & F.col("b_one") & F.col("a_sha").eqNullSafe(F.col("b_sha"))))
    heads = of.where("NOT one").select("phash", F.col("path").alias("head"))
    same = classes(fingerprints).join(heads, "phash").where("path <> head")
    rows = pairs.select("a_path", "b_path", "distance").unionByName(same.select(F.col("head").alias("a_path"), F.col("path").alias("b_path"), F.lit(0).alias("distance")))
    return _findings(rows, likely, maybe)


def near_members(fingerprints: DataFrame) -> DataFrame:
    """(path, sha256, class_path): every file with a hash, and the smallest path of that hash."""
    heads = classes(fingerprints).groupBy("phash").agg(F.min("path").alias("class_path"))
    return fingerprints.where("phash IS NOT NULL").join(heads, "phash").select("path", "sha256", "class_path")


def _findings(rows: DataFrame, likely: int, maybe: int) -> DataFrame:
    """Findings from (a_path, b_path, distance)."""
    band = F.when(F.col("distance") <= likely, F.lit("Likely")).when(F.col("distance") <= maybe, F.lit("Maybe"))
    found = rows.select(F.least("a_path", "b_path").alias("left_path"), F.greatest("a_path", "b_path").alias("right_path"), F.col("distance").alias("hamming_distance"), band.alias("band"), similarity(F.col("distance")).alias("score"))
    return found.where("band IS NOT NULL")


def near_findings(fingerprints: DataFrame, options: DuplicateOptions = DuplicateOptions()) -> DataFrame:
    """(left_path, right_path, hamming_distance, band, score) of all near pairs of files that aren't exact copies.

    The list grows with the square of the files of one hash; ``near_links`` with ``near_members`` says the same in fewer
    rows.
    """
    likely, maybe = options.likely_hamming_threshold, options.maybe_hamming_threshold
    links = near_hashes(fingerprints, max(likely, maybe))
    rows = fingerprints.where("phash IS NOT NULL")
    left, right = (rows.select(F.col("path").alias(f"{s}_path"), F.col("sha256").alias(f"{s}_sha"), F.col("phash").alias(f"{s}_hash")) for s in ("a", "b"))
    different = links.join(left, F.col("a") == F.col("a_hash")).join(right, F.col("b") == F.col("b_hash")).select("a_path", "b_path", "a_sha", "b_sha", "distance")
    same = left.join(right, (F.col("a_hash") == F.col("b_hash")) & (F.col("a_path") < F.col("b_path"))).select("a_path", "b_path", "a_sha", "b_sha", F.lit(0).alias("distance"))
    return _findings(different.unionByName(same).where(~F.col("a_sha").eqNullSafe(F.col("b_sha"))), likely, maybe)


def finding_order() -> list[Column]:
    """Likely ones first, then by distance and paths."""
    return [F.when(F.col("band") == "Likely", 0).otherwise(1), F.col("hamming_distance"), F.col("left_path"), F.col("right_path")]


def group_order() -> list[Column]:
    """By the group's number: near-2 before near-10."""
    return [F.element_at(F.split("group_id", "-"), -1).cast("long")]


def near_members_of_groups(fingerprints: DataFrame, options: DuplicateOptions = DuplicateOptions()) -> DataFrame:
    """(path, component) of the files that likely findings join; a component is named by its smallest path."""
    nodes = cut_lineage(_hash_components(fingerprints, options)[0])
    return fingerprints.join(nodes, "phash").select("path", F.col("component.path").alias("component"))


def _hash_components(fingerprints: DataFrame, options: DuplicateOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((phash, component struct(path, phash)), links (a, b, distance), hashes (phash, path, files, shas, squares))."""
    likely, maybe = options.likely_hamming_threshold, options.maybe_hamming_threshold
    links = cut_lineage(near_hashes(fingerprints, max(likely, maybe)))
    of = cut_lineage(
        classes(fingerprints).groupBy("phash").agg(F.min("path").alias("path"), F.sum("files").alias("files"), F.count("*").alias("shas"), F.min("sha256").alias("sha"), F.sum(F.col("files") * F.col("files")).alias("squares"))
    )
    node = F.struct("path", "phash")
    left, right = (of.select(F.col("phash").alias(h), node.alias(f"{h}_node"), F.col("sha").alias(f"{h}_sha"), F.col("shas").alias(f"{h}_shas")) for h in ("a", "b"))
    copies = (F.col("a_shas") == 1) & (F.col("b_shas") == 1) & F.col("a_sha").eqNullSafe(F.col("b_sha"))
    near = links.where(F.col("distance") <= likely).join(left, "a").join(right, "b").where(~copies)
    joined = connected_components(near.select(F.col("a_node").alias("src"), F.col("b_node").alias("dst")))
    alone = of.where("shas > 1").select(node.alias("node")).join(joined.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return joined.unionByName(alone).select(F.col("node.phash").alias("phash"), "component"), links, of


def near_groups(fingerprints: DataFrame, options: DuplicateOptions = DuplicateOptions()) -> DataFrame:
    """(group_id, paths, score, likely_pair_count, maybe_pair_count) of the groups that likely findings join.

    The score is the mean of all findings, maybe ones too, whose ends both lie in the group. Largest groups first, then
    by smallest path. Findings are counted by hash and never listed; ``paths`` is a list, as a report shows it:
    ``near_members_of_groups`` has the members as rows.
    """
    likely = options.likely_hamming_threshold
    made, links, of = _hash_components(fingerprints, options)
    nodes = cut_lineage(made)
    group = lambda h: nodes.select(F.col("phash").alias(h), F.col("component").alias(f"{h}_group"))
    files = lambda h: of.select(F.col("phash").alias(h), F.col("files").alias(f"{h}_files"))
    inside = links.join(group("a"), "a").join(group("b"), "b").where("a_group = b_group").join(files("a"), "a").join(files("b"), "b")
    # copies of one file under two hashes are no finding
    of_class = classes(fingerprints)
    shared = inside.select("a", "b").join(of_class.select(F.col("phash").alias("a"), "sha256", F.col("files").alias("x")), "a").join(of_class.select(F.col("phash").alias("b"), F.col("sha256").alias("sha"), F.col("files").alias("y")), "b")
    shared = shared.where(F.col("sha256").eqNullSafe(F.col("sha"))).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("copies"))
    between = inside.join(shared, ["a", "b"], "left").select(F.col("a_group").alias("component"), "distance", (F.col("a_files") * F.col("b_files") - F.coalesce("copies", F.lit(0))).alias("n"))
    within = of.join(nodes, "phash").select("component", F.lit(0).alias("distance"), ((F.col("files") * F.col("files") - F.col("squares")) / 2).cast("long").alias("n"))
    counts = between.unionByName(within).groupBy("component").agg(
        (F.sum(similarity(F.col("distance")) * F.col("n")) / F.sum("n")).alias("score"),
        F.sum(F.when(F.col("distance") <= likely, F.col("n")).otherwise(0)).alias("likely_pair_count"),
        F.sum(F.when(F.col("distance") > likely, F.col("n")).otherwise(0)).alias("maybe_pair_count"),
    )
    paths = fingerprints.join(nodes, "phash").groupBy("component").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("n"))
    ranked = numbered(paths.join(counts, "component"), [F.desc("n"), "component"])
    return ranked.select(F.concat(F.lit("near-"), F.col("number").cast("string")).alias("group_id"), "paths", "score", "likely_pair_count", "maybe_pair_count")
