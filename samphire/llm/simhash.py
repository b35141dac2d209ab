"""SimHash near-duplicates, found with BK-trees.

A BK-tree's children are keyed by their integer Hamming distance to the parent;
a search follows only the edges within the radius. Trees are built for shards
of fingerprints that any linked pair is sure (or, for wide radii, very likely)
to share, and each shard's tree is kept in the task that holds the shard: a
broadcast of all trees would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samphire.llm.common import cut_lineage, join_classes, map_text
from samphire.operators.graph import connected_components
from samphire.shipping import ship

SEED = 42
#: Blocks of a 64-bit fingerprint. A pair at 2 bits or fewer differs in at most two of them, so shares the other two.
BLOCK_BITS, BLOCKS, EXACT_RADIUS = 16, 4, 2
#: Shards with more fingerprints than this are dealt again by further bits.
SHARD_ROWS = 4096
#: Pairs (query, node) that a search holds at once.
FRONTIER = 1 << 21


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, repeats included; A-Z in lower case, words between ASCII white space.

    Fewer words than a shingle's: the whole sequence is the one shingle. No word: none.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        shingles = [b" ".join(w)] if w else []
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint words: a bit is 1 if it is set in over half the hashes. ``hashes``: (shingles, words of 64 bits)."""
    if not len(hashes):
        return np.zeros(hashes.shape[1], np.uint64)
    bits = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)])
        bits += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    x = np.asarray(h, np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BkForest:
    """The BK-trees of many shards, built and searched level by level in arrays.

    Items are fingerprints (rows of 64-bit words), in runs by shard. Item i's parent and edge are those that inserting a
    shard's items one after another gives.
    """

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints, self.width = prints, 64 * prints.shape[1] + 1
        n = len(prints)
        heads = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.empty(0, np.int64)
        self.root = np.repeat(heads, np.diff(np.r_[heads, n])) if n else heads
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left = np.setdiff1d(np.arange(n), heads, assume_unique=True)
        at = self.root[left]
        while len(left):
            d = self.distance(left, at)
            _, first, place = np.unique(at * self.width + d, return_index=True, return_inverse=True)
            child = left[first]  # the earliest item that reaches a free edge takes it
            parent[child], edge[child] = at[first], d[first]
            on = child[place] != left
            left, at = left[on], child[place][on]
        order = np.lexsort((edge, parent))
        self.child = order[np.searchsorted(parent[order], 0) :]
        self.key = parent[self.child] * self.width + edge[self.child]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).sum(axis=1, dtype=np.int64)

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, earlier item of its shard, distance) of all pairs within the radius, in chunks of whole items."""
        lengths = np.bincount(self.root, minlength=len(self.root))[self.root] if len(self.root) else self.root
        start = 0
        while start < len(self.root):
            stop = max(start + 1, int(np.searchsorted(np.cumsum(lengths[start:]), FRONTIER, side="right")) + start)
            yield self._search(np.arange(start, stop), radius)
            start = stop

    def _search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, node, found = queries, self.root[queries], []
        while len(q):
            d = self.distance(q, node)
            hit = (d <= radius) & (node < q)
            found.append((q[hit], node[hit], d[hit]))
            lo = np.searchsorted(self.key, node * self.width + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * self.width + np.minimum(d + radius, self.width - 1), side="right")
            count = hi - lo
            q = np.repeat(q, count)
            node = self.child[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(q))]
            later = node < q  # a node's descendants come after it
            q, node = q[later], node[later]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (queries[:0],) * 3


def label_components(n: int, links: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest item of each item's component, by hooking and pointer jumping."""
    label = np.arange(n)
    for a, b, _ in links:
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
            if (label == before).all():
                break
    return label


def shard_runs(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 1 << 15) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut so that each frame holds whole shards; a shard's rows are bounded by the caller."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < least:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[keys] != frame[keys].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield frame.iloc[:cut]
        held, size = [frame.iloc[cut:]], len(frame) - cut
    if size:
        yield pd.concat(held, ignore_index=True)


def shard_number(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
    return np.cumsum(new)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of every whole text: the 64 bits of SimHash over its word shingles, 0 without words."""

    def make():
        def work(texts):
            prints = [simhash(shingle_hashes(t, words)[:, None])[0] for t in texts]
            return [pa.array(np.array(prints, np.uint64).view(np.int64))]

        return work

    return map_text(docs, [id_col], [T.StructField("fingerprint", T.LongType())], make, text_col)


def exact_links(prints: DataFrame) -> DataFrame:
    """(a, b): a spanning set of the links at EXACT_RADIUS bits or fewer, from distinct ``fingerprint`` rows.

    Shards hold the fingerprints that agree on two of the four blocks: six shards a fingerprint, and every link lies in
    one of them. A shard of over SHARD_ROWS is dealt again: of the 32 bits that are still free, its links keep two of
    four parts, so shards by those parts find them all, and no such shard can hold over 2 ** 16 distinct fingerprints.
    Each task links the components of its shards' trees to their smallest items, so links don't grow with a shard's
    square, and no link is lost.
    """
    ship(prints.sparkSession)
    picks = list(combinations(range(BLOCKS), BLOCKS - EXACT_RADIUS))
    block = lambda i: F.shiftrightunsigned("fingerprint", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    ways = F.array(*[F.struct(F.lit(k).alias("way"), F.shiftleft(block(i), BLOCK_BITS).bitwiseOR(block(j)).alias("kept")) for k, (i, j) in enumerate(picks)])
    dealt = prints.select("fingerprint", F.explode(ways).alias("__w")).select("fingerprint", "__w.way", "__w.kept")
    rows = dealt.groupBy("way", "kept").agg(F.count("*").alias("__rows")).where("__rows > 1")
    sized = dealt.join(rows, ["way", "kept"])
    small = sized.where(F.col("__rows") <= SHARD_ROWS).select("fingerprint", "way", "kept", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more"))

    # the free blocks' parts of 8 bits, two of four of which a link of a large shard keeps
    free = [[8 * p for b in range(BLOCKS) if b not in pick for p in (2 * b, 2 * b + 1)] for pick in picks]
    byte = lambda at: F.shiftrightunsigned("fingerprint", at).bitwiseAND(F.lit(255))
    parts = None
    for k, at in enumerate(free):
        own = F.array(*[F.struct(F.lit(n).alias("part"), F.shiftleft(byte(at[i]), 8).bitwiseOR(byte(at[j])).alias("more")) for n, (i, j) in enumerate(combinations(range(4), 2))])
        parts = F.when(F.col("way") == k, own) if parts is None else parts.when(F.col("way") == k, own)
    large = sized.where(F.col("__rows") > SHARD_ROWS).select("fingerprint", "way", "kept", F.explode(parts).alias("__p")).select("fingerprint", "way", "kept", "__p.part", "__p.more")
    keys = ["way", "kept", "part", "more"]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in shard_runs(batches, keys):
            items = frame["fingerprint"].to_numpy()
            forest = BkForest(items.view(np.uint64)[:, None], shard_number(frame, keys))
            label = label_components(len(items), forest.links(EXACT_RADIUS))
            linked = label != np.arange(len(items))
            yield pd.DataFrame({"a": items[linked], "b": items[label[linked]]})

    def searched(shards: DataFrame) -> DataFrame:
        return shards.repartition(*keys).sortWithinPartitions(*keys, "fingerprint").mapInPandas(link, "a long, b long")

    return searched(small).unionByName(searched(large)).distinct()


def least_of_components(links: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(``key``, ``__rows``, ``__first``) of ``nodes`` (key, ``__rows``, ``__least``): the smallest ``__least`` that ``links`` (a, b) reach.

    Nodes go into the graph with their ``__least`` in front, so that a component's smallest node tells it: no join brings
    all nodes of a component together.
    """
    node = F.struct("__least", key)
    left, right = (nodes.select(F.col(key).alias(side), node.alias(f"{side}_node")) for side in ("a", "b"))
    ends = links.join(left, "a").join(right, "b").select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))
    found = connected_components(ends).select(F.col(f"node.{key}").alias(key), F.col("component.__least").alias("__reached"))
    return nodes.join(found, key, "left").select(key, "__rows", F.coalesce("__reached", "__least").alias("__first"))


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every document.

    Documents link if their fingerprints differ in EXACT_RADIUS bits or fewer; ``component_id`` is the smallest id that
    links reach, the document's own included. Null and empty texts have fingerprint 0 and link like any other. Null ids
    take part; they never are a smallest id while another is there. Repeated rows give a row each; an empty table gives
    none; other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs.withColumnRenamed(id_col, "__id"), words, "__id", text_col))
    least = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"))
    nodes = cut_lineage(prints.groupBy("fingerprint").agg(F.min(least).alias("__least"), F.count("*").alias("__rows")))
    classes = least_of_components(exact_links(nodes.select("fingerprint")), nodes, "fingerprint")
    found = join_classes(prints, classes.withColumn("component_id", F.col("__first.id")).drop("__first"), "fingerprint")
    return found.select(F.col("__id").alias(id_col), "fingerprint", "component_id")
