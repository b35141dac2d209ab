"""Nearest neighbours by largest inner product, with randomly rotated one-bit codes.

A vector's residual to its nearest centroid is rotated at random and kept as
one sign bit a dimension, with two scalars: the residual's length and the inner
product of the unit residual with its own code. From those, the inner product
with a query is estimated without bias and with a bound on the error; only
vectors whose upper bound reaches the best found so far are scored exactly.

Index and queries are tables: shards of a cluster meet blocks of queries, and
only those that can hold a result of theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samphire.llm.common import cut_lineage
from samphire.shipping import ship

#: Vectors of a shard of the index and of a block of queries, on average: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 8192, 4096
#: Queries and candidates of one matrix product.
TILE_QUERIES, TILE_ROWS = 512, 4096


class Codes:
    """Rotation and centroids, and what they make of vectors."""

    def __init__(self, sample: np.ndarray, clusters: int = 64, rounds: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        self.centroids = sample[rng.permutation(len(sample))[: min(clusters, len(sample))]].copy()
        for _ in range(rounds):
            near = self.nearest(sample)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, sample)
            n = np.bincount(near, minlength=len(sums))
            self.centroids[n > 0] = sums[n > 0] / n[n > 0, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2, axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(packed bits, cluster, residual length, correction) of each row."""
        cluster = self.nearest(x)
        residual = x - self.centroids[cluster]
        length = np.linalg.norm(residual, axis=1)
        turned = residual @ self.rotation.T
        own = np.abs(turned).sum(axis=1) / (np.sqrt(self.dim) * np.where(length > 0, length, 1))
        return np.packbits(turned >= 0, axis=1), cluster, length, np.where(length > 0, own, 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(__id, __vec array<double>) of the rows that take part: each row is one, whether or not its id repeats.

    Left out: null ids, null and zero vectors, and vectors with a null or non-finite component. Only vectors of one
    length have inner products: those of another length than most (ties: the greater length) are left out too.
    """
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("__id"), vec.alias("__vec")).where("__id IS NOT NULL AND __vec IS NOT NULL")
    sound = F.forall("__vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("__vec", lambda x: x != 0)
    rows = rows.where(sound)
    lengths = rows.groupBy(F.size("__vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("__vec") == (lengths["n"] if lengths else -1))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: greatest score, then smallest id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)]))
    return order[rank < k]


def search(model: Codes, coded: pa.Table, asked: pa.Table, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in ``asked``, position in ``coded``, score): each query's k best of a shard of the index.

    A query's ``floor`` is a score that more than k candidates are known to reach; k rows found raise it. Every row whose
    upper bound reaches the floor is scored exactly.
    """
    all_rows, ids, vectors = coded.column("__row").to_numpy(), coded.column("__id").to_numpy(), matrix(coded.column("__vec").combine_chunks())
    packed = np.frombuffer(b"".join(coded.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    cluster, length, own = (coded.column(c).to_numpy() for c in ("cluster", "length", "own"))
    q_rows, queries, floors = asked.column("__row").to_numpy(), matrix(asked.column("__vec").combine_chunks()), asked.column("floor").to_numpy()
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for j in range(0, len(queries), TILE_QUERIES):
        part = queries[j : j + TILE_QUERIES]
        floor = floors[j : j + TILE_QUERIES].copy()
        turned = (part @ model.rotation.T).astype(np.float32)
        near = (model.centroids @ part.T).astype(np.float32)
        norm = np.linalg.norm(part, axis=1).astype(np.float32)
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for i in range(0, len(ids), TILE_ROWS):
            rows = slice(i, i + TILE_ROWS)
            scale = (length[rows] / (own[rows] * np.sqrt(model.dim))).astype(np.float32)
            spread = (length[rows] * np.sqrt(np.maximum(0, 1 - own[rows] ** 2)) / own[rows] * epsilon / np.sqrt(max(1, model.dim - 1))).astype(np.float32)
            signs = np.unpackbits(packed[rows], axis=1, count=model.dim).astype(np.float32) * 2 - 1
            signs *= scale[:, None]
            upper = turned @ signs.T  # a row for each query
            upper += near[cluster[rows]].T
            upper += norm[:, None] * spread[None, :]
            q, r = np.nonzero(upper >= (floor - 1e-5 * (1 + np.abs(floor)))[:, None].astype(np.float32))
            r = r + i
            other = all_rows[r] != q_rows[j + q]
            q, r = q[other], r[other]
            new = []
            for a in range(0, len(q), 1 << 18):
                qa, ra = q[a : a + (1 << 18)], r[a : a + (1 << 18)]
                score = np.einsum("ij,ij->i", vectors[ra], part[qa])
                good = score >= floor[qa]
                new.append((qa[good], ra[good], score[good]))
            if not new:
                continue
            found = tuple(np.concatenate([old, *x]) for old, x in zip(found, zip(*new, strict=True), strict=True))
            top = best(found[0], ids[found[1]], found[2], k)
            found = tuple(x[top] for x in found)
            full = np.flatnonzero(np.bincount(found[0], minlength=len(part)) == k)
            worst = np.full(len(part), np.inf)
            np.minimum.at(worst, found[0], found[2])
            floor[full] = np.maximum(floor[full], worst[full])
        kept = tuple(np.concatenate([a, b]) for a, b in zip(kept, (found[0] + j, *found[1:]), strict=True))
    return kept


def index(rows: DataFrame, model: Broadcast[Codes]) -> DataFrame:
    """Rows (__row, __id, __vec) with code binary, cluster int, length double and own double: every row, whatever the sample was."""
    schema = "__row long, __id long, __vec array<double>, code binary, cluster int, length double, own double"

    def run(batches):
        for batch in batches:
            packed, cluster, length, own = model.value.encode(matrix(batch.column("__vec"))) if batch.num_rows else (np.empty((0, 1), np.uint8), *[np.empty(0)] * 3)
            made = [pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(cluster.astype(np.int32)), pa.array(length, pa.float64()), pa.array(own, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["__row", "__id", "__vec", "code", "cluster", "length", "own"])

    return rows.mapInArrow(run, schema)


def aim(queries: DataFrame, model: Broadcast[Codes], pilot: Broadcast[np.ndarray], reach: np.ndarray, k: int) -> DataFrame:
    """Queries (__row, __id, __vec, block) with floor double and clusters array<int>: those that may hold a result.

    ``floor``: the 2k-th best score of the ``pilot`` vectors, -inf if they are fewer, so more than k candidates reach it.
    ``reach``: the longest residual of each cluster. A row of a cluster scores no more than the centroid does plus the
    residual's length times the query's, so clusters below the floor are left out without loss.
    """

    def run(batches):
        for batch in batches:
            queries_ = matrix(batch.column("__vec"))
            floor, clusters = np.full(len(queries_), -np.inf), []
            for i in range(0, len(queries_), TILE_QUERIES):
                part = queries_[i : i + TILE_QUERIES]
                if len(pilot.value) > 2 * k:  # the query itself may be among them
                    floor[i : i + TILE_QUERIES] = np.partition(part @ pilot.value.T, -2 * k - 1, axis=1)[:, -2 * k - 1]
                most = part @ model.value.centroids.T + np.linalg.norm(part, axis=1)[:, None] * reach[None, :]
                least = floor[i : i + TILE_QUERIES, None]
                clusters += [np.flatnonzero(x).astype(np.int32) for x in (most >= least - 1e-9 * (1 + np.abs(least))) & (reach >= 0)[None, :]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(clusters, pa.list_(pa.int32()))], names=["__row", "__id", "__vec", "block", "floor", "clusters"])

    return queries.mapInArrow(run, "__row long, __id long, __vec array<double>, block int, floor double, clusters array<int>")


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample_rows: int = 8192,
    epsilon: float = 2.5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest other rows by inner product in double precision.

    ``is_query``: a condition on __id. The model is fitted on at most ``sample_rows`` vectors, those of lowest hash;
    the index holds every vector. ``epsilon``: width of the error bound; at 2.5 almost no neighbour is missed. Ties go
    to the smaller id. Fewer than k others: all of them. Rows that repeat an id are candidates, and queries, each for
    itself. See ``usable`` for the vectors that take no part. Other columns are ignored; an empty table gives no row.

    The index is written once to the shared folder. A cluster's rows are dealt into shards of about SHARD_ROWS and the
    queries into blocks of about BLOCK_ROWS; a task has one shard and one block, so nothing grows with the table. A query
    goes to the shards of the clusters that may hold a result of its own.
    """
    spark = ship(vectors.sparkSession)
    rows = cut_lineage(usable(vectors, id_col, vec_col).select(F.monotonically_increasing_id().alias("__row"), "__id", "__vec"))
    sample = rows.orderBy(F.xxhash64("__id", "__row"), "__row").limit(sample_rows).select("__vec").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sampled = matrix(sample.column("__vec").combine_chunks())
    model, pilot = spark.sparkContext.broadcast(Codes(sampled)), spark.sparkContext.broadcast(sampled)
    coded = cut_lineage(index(rows, model))
    asked = rows.where(is_query)
    told = coded.groupBy("cluster").agg(F.count("*").alias("n"), F.max("length").alias("reach")).collect()  # a row for each centroid
    reach = np.full(len(model.value.centroids), -np.inf)
    parts = [1] * len(reach)
    for row in told:
        reach[row["cluster"]], parts[row["cluster"]] = row["reach"], -(-row["n"] // SHARD_ROWS)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    of_cluster = F.element_at(F.array(*map(F.lit, parts)), F.col("cluster") + 1)
    shard = (F.col("cluster"), F.pmod(F.xxhash64("__row"), of_cluster).cast("int").alias("part"))
    shards = coded.select("*", shard[1], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("__row"), F.lit(blocks)).cast("int"))
    aimed = aim(dealt, model, pilot, reach, k).withColumn("cluster", F.explode("clusters")).drop("clusters")
    aimed = aimed.withColumn("part", F.explode(F.sequence(F.lit(0), of_cluster - 1)))

    def run(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})
        q, r, score = search(model.value, mine, theirs, k, epsilon)
        return pa.table([theirs.column("__row").to_numpy()[q], theirs.column("__id").to_numpy()[q], mine.column("__id").to_numpy()[r], score], names=names)

    names, keys = ["query_row", "query_id", "vec_id", "score"], ["block", "cluster", "part"]
    found = shards.groupBy(*keys).cogroup(aimed.groupBy(*keys)).applyInArrow(run, "query_row long, query_id long, vec_id long, score double")
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
