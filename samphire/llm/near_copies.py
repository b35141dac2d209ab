"""Near copies by SimHash at a similarity of the word shingles, for radii that blocks of bits can't serve.

At a Jaccard similarity of 0.8 two fingerprints of 256 bits differ in some 39
bits, of very short texts in up to 48. Shards are the values of min-hash bands,
which such a pair shares in all but about one case in a thousand; each shard's
fingerprints make a BK-tree, whose pairs within a wide radius are candidates.
Links are the candidates whose shingle sets have the similarity.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samphire.llm.common import cut_lineage, join_classes, map_text
from samphire.llm.simhash import SHARD_ROWS, BkForest, label_components, least_of_components, mix, shard_number, shard_runs, shingle_hashes, simhash
from samphire.shipping import ship

#: 64-bit words of a fingerprint; bands and min-hashes of each.
PARTS, BANDS, ROWS = 4, 14, 4
#: Shards with more shingles than this are dealt again too, so that a task can hold the sets of two parts.
SHARD_SHINGLES = 1 << 22
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 77) | np.uint64(1)


@functools.cache
def radius_of(similarity: float, bits: int = 64 * PARTS) -> int:
    """Bits within which fingerprints of sets of that Jaccard similarity differ: the mean and four deviations more.

    The mean is the greatest for sets of any size: small ones differ in more bits than large ones, as a tie gives 0.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    for both in range(1, 33):
        for own in range(1, int(both / similarity + 1e-9) - both + 1):
            for x in range(own // 2 + 1):
                y, unequal = own - x, 0.0
                for k, p in enumerate(chance(both)):
                    one = sum(q for i, q in enumerate(chance(x)) if 2 * (k + i) > both + x)
                    other = sum(q for i, q in enumerate(chance(y)) if 2 * (k + i) > both + y)
                    unequal += p * (one * (1 - other) + other * (1 - one))
                share = max(share, unequal)
    return int(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def sketch(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(fingerprint words, band keys, digest, size) of the set of a text's shingles. Without words: zeros, one family of empty texts."""
    hashes = np.unique(shingle_hashes(text, words))
    if not len(hashes):
        return np.zeros(PARTS, np.uint64), np.zeros(BANDS, np.uint64), 0, 0
    prints = simhash(np.stack([hashes, *(mix(hashes, i) for i in range(1, PARTS))], axis=1))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[i : i + 2048, None] * _FACTORS).min(axis=0))
    band = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys ^ band[:, r], r)
    return prints, keys, xxhash.xxh64_intdigest(hashes.tobytes()), len(hashes)


def sketches(docs: DataFrame, words: int, carry: list[str], text_col: str) -> DataFrame:
    """(carried columns, f0..f3 long, keys array<long>, node long, size long) of every whole text; equal sets are one node."""

    def make():
        def work(texts):
            made = [sketch(t, words) for t in texts]
            prints = np.array([m[0] for m in made], np.uint64).reshape(-1, PARTS).view(np.int64)
            keys = np.array([m[1] for m in made], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
            node, size = np.array([m[2] for m in made], np.uint64).view(np.int64), np.array([m[3] for m in made], np.int64)
            return [*(pa.array(np.ascontiguousarray(prints[:, i])) for i in range(PARTS)), lists, pa.array(node), pa.array(size)]

        return work

    fields = [*(T.StructField(f"f{i}", T.LongType()) for i in range(PARTS)), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("node", T.LongType()), T.StructField("size", T.LongType())]
    return map_text(docs, carry, fields, make, text_col)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles binary): the sorted hashes of the text's shingles, without repeats."""

    def make():
        return lambda bodies: [pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in bodies], pa.binary())]

    return map_text(texts, ["node"], [T.StructField("shingles", T.BinaryType())], make, "__body")


def candidates(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(family, node, f0..): the groups of nodes (node, f0.., keys, size) that pairs within the radius connect, shard by shard.

    A family is told by the hash of its members, so one that several shards hold is there once.

    A shard with more than SHARD_ROWS nodes or SHARD_SHINGLES shingles is dealt again by the sets' sizes: alike sets are
    in the same class of sizes or in neighbouring ones, so a window of two classes holds both. A window that is still
    too large is dealt into parts by a hash, and each part goes with every other: no pair of a shard is left out, at a
    cost that grows with the square of such a window.
    """
    ship(nodes.sparkSession)
    prints, keys = [f"f{i}" for i in range(PARTS)], ["key", "window", "low", "high"]
    totals = [F.count("*").alias("rows"), F.sum("size").alias("shingles")]
    dealt = nodes.select("node", *prints, "size", F.explode("keys").alias("key"))
    sizes = dealt.groupBy("key").agg(*totals).where("rows > 1")
    sized = dealt.join(sizes, "key")
    fits = (F.col("rows") <= SHARD_ROWS) & (F.col("shingles") <= SHARD_SHINGLES)
    small = sized.where(fits).select("key", F.lit(-1).cast("long").alias("window"), F.lit(0).alias("low"), F.lit(0).alias("high"), "node", *prints)

    # the width is a trifle more than the similarity's, against rounding
    own = F.floor(F.log(F.greatest("size", F.lit(1))) / (math.log(1 / similarity) + 1e-6)) if similarity < 1 else F.col("size")
    windows = F.array(own, own + 1) if similarity < 1 else F.array(own)
    large = sized.where(~fits).select("key", F.explode(windows).alias("window"), "node", "size", *prints)
    counts = large.groupBy("key", "window").agg(*totals).where("rows > 1")
    parts = F.least("rows", F.ceil(F.greatest(F.col("rows") / SHARD_ROWS, F.col("shingles") / SHARD_SHINGLES))).cast("int")
    parted = large.join(counts.select("key", "window", parts.alias("parts")), ["key", "window"]).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("part")))
    met = parted.withColumn("other", F.explode(others)).select("key", "window", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", *prints)
    shards = small.unionByName(met)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in shard_runs(batches, keys, 1 << 13):
            items = frame["node"].to_numpy()
            forest = BkForest(np.ascontiguousarray(frame[prints].to_numpy(np.int64)).view(np.uint64), shard_number(frame, keys))
            label = label_components(len(items), forest.links(radius))
            family = np.zeros(len(items), np.uint64)
            np.add.at(family, label, mix(items.view(np.uint64), 5))
            many = np.bincount(label, minlength=len(items))[label] > 1
            yield pd.DataFrame({"family": family[label][many].view(np.int64), "node": items[many], **{c: frame[c].to_numpy()[many] for c in prints}})

    fields = "family long, node long, " + ", ".join(f"{c} long" for c in prints)
    return shards.repartition(*keys).sortWithinPartitions(*keys, "node").mapInPandas(gather, fields).distinct()


def alike(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity. No tolerance but that of the last bits: 4 / 5 is 0.8."""
    if len(one) > len(other):
        one, other = other, one
    if len(one) < similarity * len(other) * (1 - 1e-12):
        return False
    at = np.searchsorted(other, one)
    both = int((other[np.minimum(at, len(other) - 1)] == one).sum()) if len(other) else 0
    return both >= similarity * (len(one) + len(other) - both) * (1 - 1e-12)


def confirmed(sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """The smallest item of each item's component by the pairs whose sets are alike; pairs within one aren't compared again."""
    label = np.arange(len(sets))
    for a, b, d in pairs:
        order = np.lexsort((d, a))
        a, b = a[order], b[order]
        while True:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            head = np.r_[True, a[1:] != a[:-1]]  # each item's nearest of those that are left
            x, y = a[head], b[head]
            good = np.array([alike(sets[i], sets[j], similarity) for i, j in zip(x.tolist(), y.tolist(), strict=True)])
            joined = label_components(len(sets), iter([(label[x[good]], label[y[good]], None)]))
            label = joined[label]
            a, b = a[~head], b[~head]
    return label


def links(families: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): a spanning set of the links of each family (family, node, f0..), by the nodes' sets (node, shingles)."""
    ship(families.sparkSession)
    prints = [f"f{i}" for i in range(PARTS)]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in shard_runs(batches, ["family"], 1 << 10):
            items = frame["node"].to_numpy()
            forest = BkForest(np.ascontiguousarray(frame[prints].to_numpy(np.int64)).view(np.uint64), shard_number(frame, ["family"]))
            label = confirmed([np.frombuffer(x, np.uint64) for x in frame["shingles"]], forest.links(radius), similarity)
            linked = label != np.arange(len(items))
            yield pd.DataFrame({"a": items[linked], "b": items[label[linked]]})

    return families.join(sets, "node").repartition("family").sortWithinPartitions("family", "node").mapInPandas(link, "a long, b long").distinct()


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, component_id, first) of every document.

    ``component_id``: the smallest id of its group of copies and near copies; ``first``: whether it is the one of that
    id (of several such rows: of smallest ``text_hash``, the XXH64 of the text; rows equal in both are first together).
    Texts link if their sets of ``words``-word shingles (A-Z folded) have the Jaccard ``similarity`` or more. Null and
    empty texts are copies of each other; texts of fewer words are one shingle, equal or not. Null ids are never a smallest id while another is there; repeated rows give a row each; an
    empty table gives none; other columns are ignored.
    """
    prints = [f"f{i}" for i in range(PARTS)]
    hashed = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__body"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"))
    made = cut_lineage(sketches(hashed, words, ["__id", "text_hash"], "__body"))
    one = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("text_hash").alias("hash"))
    nodes = cut_lineage(made.groupBy("node").agg(F.min(one).alias("__least"), F.count("*").alias("__rows"), *[F.min(c).alias(c) for c in prints], F.min("keys").alias("keys"), F.min("size").alias("size")))
    families = cut_lineage(candidates(nodes.drop("__least", "__rows"), radius_of(similarity), similarity))
    # the text of each candidate's first document: its set is made again, so that no sets are kept of the others. Copies
    # have other ids, so they have other keys too; rows that repeat an id and its text are one, where the join put them
    key = lambda hash_, id_: F.xxhash64(hash_, id_)
    wanted = families.select("node").distinct().join(nodes.select("node", F.col("__least.hash").alias("__hash"), key("__least.hash", "__least.id").alias("__key")), "node")
    rows = hashed.select(key("text_hash", "__id").alias("__key"), "text_hash", "__body").join(wanted, "__key").where("text_hash = __hash")
    texts = rows.groupBy("__key", "node").agg(F.first("__body").alias("__body")).select("node", "__body")
    classes = least_of_components(links(families, shingle_sets(texts, words), radius_of(similarity), similarity), nodes.select("node", "__rows", "__least"), "node")
    found = join_classes(made.select("__id", "text_hash", "node"), classes, "node")
    first = F.col("__id").eqNullSafe(F.col("__first.id")) & (F.col("text_hash") == F.col("__first.hash"))
    return found.select(F.col("__id").alias(id_col), "text_hash", F.col("__first.id").alias("component_id"), first.alias("first"))
