"""Toxicity by a factorization machine over hashed terms.

Besides a weight, a term has a short vector; the products of the vectors of a
text's terms are weights for pairs, such as an insult and a group it is said of,
that no sum of single weights can give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samphire.llm.common import map_text, slices
from samphire.llm.simhash import mix, shingle_hashes
from samphire.shipping import ship

BUCKETS = 1 << 20
TERM = re.compile(r"[^\W_]+")
#: Bands of three min-hashes that find a training text's near copies.
BANDS = 20
#: Distinct terms whose slots a worker keeps.
KEPT = 200_000
#: Terms whose pairs are looked at in fitting: those in most texts of the sample.
PAIR_TERMS = 1024


def terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class FactorizationMachine:
    """Weights of the active buckets; all others count as 0, with their pairs."""

    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slot = {int(b): i for i, b in enumerate(buckets)}
        self.bias, self.weights, self.factors = bias, weights, factors
        self.known: dict[str, int] = {}

    def slots(self, text: str | None) -> list[int]:
        """Of the active buckets that a text's distinct terms fall in."""
        found, get, learned = set(), self.known.get, {}
        for term in terms(text):
            at = get(term)
            if at is None:
                at = learned[term] = self.slot.get(bucket(term), -1)
            if at >= 0:
                found.add(at)
        if len(self.known) < KEPT:
            self.known.update(learned)
        return sorted(found)

    def margins(self, rows: list[list[int]]) -> np.ndarray:
        """Bias, weights and products of the vectors of each row's slots."""
        flat = np.fromiter((s for row in rows for s in row), np.int64)
        owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        v = self.factors[flat]
        z = self.bias + np.bincount(owner, self.weights[flat] - 0.5 * (v**2).sum(axis=1), minlength=len(rows))
        for f in range(v.shape[1]):
            z += 0.5 * np.bincount(owner, v[:, f], minlength=len(rows)) ** 2
        return z

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins([self.slots(t) for t in texts]), -500, 500)))


def family_keys(text: str | None) -> list[int]:
    """Keys of BANDS bands of min-hashes of the three-word shingles; near copies share one or more of them."""
    hashes = np.unique(shingle_hashes(text, 3))
    if not len(hashes):
        return [0] * BANDS
    least = np.array([mix(hashes, salt).min() for salt in range(3 * BANDS)]).reshape(BANDS, 3)
    return mix(least[:, 0] ^ mix(least[:, 1], 7) ^ mix(least[:, 2], 8), 9).view(np.int64).tolist()


def family_weights(keys: np.ndarray) -> np.ndarray:
    """1 / (rows of the row's family); rows that share a band's key are of one family."""
    head = np.arange(len(keys))
    for band in range(keys.shape[1]):
        _, first, place = np.unique(keys[:, band], return_index=True, return_inverse=True)
        while True:
            low = np.full(len(first), len(keys))
            np.minimum.at(low, place, head)
            new = np.minimum(head, low[place])
            np.minimum.at(new, head, new)
            new = new[new]
            if (new == head).all():
                break
            head = new
    while (head[head] != head).any():
        head = head[head]
    return 1 / np.bincount(head, minlength=len(keys))[head]


def row_blocks(rows: list[np.ndarray], size: int = 1000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, their buckets, the row of each bucket in the block): what is made of a block never grows with the sample."""
    for first in range(0, len(rows), size):
        part = rows[first : first + size]
        yield slice(first, first + len(part)), np.concatenate(part), np.repeat(np.arange(len(part)), [len(r) for r in part])


def bucket_sums(rows: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """For each bucket, the sum of the ``values`` of the rows that hold it."""
    sums = np.zeros(BUCKETS)
    for mine, flat, owner in row_blocks(rows):
        np.add.at(sums, flat, values[mine][owner])
    return sums


def telling(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, least: float = 5) -> np.ndarray:
    """Buckets whose share of positive texts is off the whole's by more than chance gives the most extreme of them all.

    Rows count by ``weight``. The limit is one standard deviation above the expected largest of as many normal deviates
    as there are buckets of weight ``least`` or more, so that rare terms of mislabelled texts stay out.
    """
    n, positive = bucket_sums(rows, weight), bucket_sums(rows, y * weight)
    enough = np.flatnonzero(n >= least)
    n, positive = n[enough], positive[enough]
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    deviate = (positive - n * share) / np.sqrt(n * share * (1 - share))
    return enough[np.abs(deviate) > np.sqrt(2 * np.log(max(2, len(enough)))) + 1]


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, least: float = 5, most: int = PAIR_TERMS) -> np.ndarray:
    """Buckets of pairs whose share of positive texts neither bucket's own share explains, telling by themselves or not.

    The ``most`` buckets of greatest weight are paired. A pair's share must be off both its buckets' shares by more than
    chance gives the most extreme of all the pairs.
    """
    n = bucket_sums(rows, weight)
    top = np.sort(np.argsort(-n, kind="stable")[:most])
    top = top[(n[top] >= least) & (n[top] < weight.sum())]
    if len(top) < 2:
        return top[:0]
    column = np.full(BUCKETS, -1)
    column[top] = np.arange(len(top))
    both, positive = (np.zeros((len(top), len(top))) for _ in range(2))
    for mine, flat, owner in row_blocks(rows, 2000):
        at = column[flat]
        held = np.zeros((mine.stop - mine.start, len(top)), np.float32)
        held[owner[at >= 0], at[at >= 0]] = 1
        scaled = held * weight[mine].astype(np.float32)[:, None]
        both += held.T @ scaled
        scaled *= y[mine].astype(np.float32)[:, None]
        positive += held.T @ scaled
    share = np.clip((np.diag(positive) + 0.5) / (np.diag(both) + 1), 1e-3, 1 - 1e-3)
    positive -= both * share[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        off = np.abs(positive, out=positive) / np.sqrt(both * (share * (1 - share))[:, None])
    off = np.where(both >= least, np.minimum(off, off.T), 0)
    np.fill_diagonal(off, 0)
    pairs = max(2, int((both >= least).sum() // 2))
    return top[(off > np.sqrt(2 * np.log(pairs)) + 1).any(axis=1)]


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rank: int, rounds: int, rate: float = 0.3, l2: float = 3e-4, seed: int = 5):
    """(buckets, bias, weights, factors) of least logistic loss over the telling buckets, by AdaGrad on all rows at once.

    Buckets tell by themselves or with another one. The penalty ``l2`` is on the factors alone: pairs explain what single
    terms can't.
    """
    rng = np.random.default_rng(seed)
    active = np.union1d(telling(rows, y, weight), telling_pairs(rows, y, weight))
    slot = np.full(BUCKETS, -1)
    slot[active] = np.arange(len(active))
    held = []
    for mine, flat, own in row_blocks(rows):
        inside = slot[flat] >= 0
        held.append((slot[flat[inside]], own[inside] + mine.start))
    at, owner = (np.concatenate(x) for x in zip(*held, strict=True))
    w, v = np.zeros(len(active)), rng.normal(0, 0.05, (len(active), rank))
    base = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    b, gw, gv, gb = float(np.log(base / (1 - base))), np.full(w.shape, 1e-8), np.full(v.shape, 1e-8), 1e-8
    per = lambda values, n, to: np.bincount(to, values, minlength=n)
    for _ in range(rounds):
        own = v[at]
        sums = np.stack([per(own[:, f], len(rows), owner) for f in range(rank)], axis=1)
        z = b + per(w[at], len(rows), owner) + 0.5 * ((sums**2).sum(axis=1) - per((own**2).sum(axis=1), len(rows), owner))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / weight.sum()
        dw = per(g[owner], len(active), at)
        dv = np.stack([per(g[owner] * (sums[owner, f] - own[:, f]), len(active), at) for f in range(rank)], axis=1) + l2 * v
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + g.sum() ** 2
        w -= rate / np.sqrt(gw) * dw
        v -= 0.3 * rate / np.sqrt(gv) * dv
        b -= rate / np.sqrt(gb) * g.sum()
    return active, b, w, v


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, rank: int = 4, rounds: int = 1500, seed: int = 5) -> FactorizationMachine:
    """Fit in one task on a bounded sample: the ``sample_rows`` labelled ids of lowest hash, with their whole texts.

    A family of near copies weighs as much as one text, so that one wrong label isn't learned many times. Of documents
    that repeat an id the smallest text counts, of an id's labels the greatest. Without labelled rows every text scores 0.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    picked = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    wanted = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    joined = wanted.join(F.broadcast(picked), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text"))  # at most sample_rows rows

    def hashed(batches):
        for batch in slices(batches):
            texts = batch.column("__text").to_pylist()
            sets = [sorted({bucket(t) for t in terms(x)}) for x in texts]
            keys = pa.array(list(map(family_keys, texts)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("__id").cast(pa.string()), batch.column("__y"), pa.array(sets, pa.list_(pa.int32())), keys], names=["id", "y", "terms", "keys"])

    def fitted(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("y", "ascending")])
        listed = table.column("terms").combine_chunks()
        flat, ends = listed.flatten().to_numpy(), np.cumsum(listed.value_lengths().to_numpy())
        weight = family_weights(table.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS))
        y = (table.column("y").to_numpy() > 0).astype(np.float64)
        active, bias, weights, factors = fit(np.split(flat, ends[:-1]), y, weight, rank, rounds, seed=seed)
        yield pa.RecordBatch.from_pydict({"buckets": [active.astype(np.int64).tobytes()], "bias": [bias], "weights": [weights.tobytes()], "factors": [factors.tobytes()]})

    # one task fits, as all of the bounded sample belongs together: the driver gets the model alone
    rows = joined.mapInArrow(hashed, "id string, y int, terms array<int>, keys array<long>").repartition(1)
    model = rows.mapInArrow(fitted, "buckets binary, bias double, weights binary, factors binary").first()
    if model is None:
        return FactorizationMachine(np.empty(0), -500.0, np.empty(0), np.empty((0, rank)))
    buckets, weights, factors = (np.frombuffer(model[c], kind) for c, kind in (("buckets", np.int64), ("weights", np.float64), ("factors", np.float64)))
    return FactorizationMachine(buckets, model["bias"], weights, factors.reshape(-1, rank))


def score(docs: DataFrame, model: FactorizationMachine, carry: list[str] | None = None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The ``carry`` columns (default: doc_id) and ``score_col``, 0 to 1, of every whole text.

    Null and empty texts, and texts without a known term, have the score of the bias alone. Repeated rows give a row
    each; ids, languages and sources play no part in a score; other columns are ignored.
    """

    def make():
        # a copy for each task: what it has looked up goes with the task
        learned = FactorizationMachine(np.array(list(model.slot)), model.bias, model.weights, model.factors)
        return lambda texts: [pa.array(learned.scores(texts), pa.float64())]

    return map_text(docs, carry if carry is not None else ["doc_id"], [T.StructField(score_col, T.DoubleType())], make, text_col)
