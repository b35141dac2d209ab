"""Language identification as inference of a mixture.

Each language has a distribution over hashed character trigrams. A document's
language proportions are those of greatest likelihood, found by expectation
maximisation; a set of languages is worth its likelihood less a penalty for
each language after the first, and the document gets the set that is worth most.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samphire.llm.common import map_text, slices, text_chunks
from samphire.shipping import ship

#: Buckets of trigrams. A language's table takes eight bytes for each.
BUCKETS = 1 << 15
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: The model goes to every task; of more languages than fit in this many bytes, those of most documents are learned.
MOST_BYTES = 256 << 20


def folded(text: str) -> str:
    """Lower-case runs of letters with single spaces around them; empty if there is no letter."""
    out = NOT_LETTERS.sub(" ", text.lower())
    return f" {out.strip()} " if any(map(str.isalpha, out)) else ""


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the hashed trigrams of folded texts, by text and bucket."""
    joined = "".join(texts)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 3:
        return (np.empty(0, np.int64),) * 3
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    key = owner[2:] * BUCKETS + (h >> np.uint32(17)).astype(np.int64)
    key, count = np.unique(key[owner[2:] == owner[:-2]], return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


class LanguageModel:
    """Trigram probabilities of the learned languages, and the inference."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5, penalty: float = 12.0, rounds: int = 12):
        self.languages, self.penalty, self.rounds = languages, penalty, rounds
        p = counts + smoothing
        self.table = np.ascontiguousarray((p / p.sum(axis=1, keepdims=True)).T.astype(np.float32))

    def proportions(self, like: np.ndarray, count: np.ndarray, heads: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihood) of each text by EM over its allowed languages. ``heads``: where texts begin."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        total = np.add.reduceat(count, heads)
        lengths = np.diff(np.r_[heads, len(count)])
        for _ in range(self.rounds):
            part = like * np.repeat(share.astype(np.float32), lengths, axis=0)
            part *= (count / part.sum(axis=1))[:, None].astype(np.float32)
            share = np.add.reduceat(part, heads, axis=0).astype(np.float64) / total[:, None]
            share /= share.sum(axis=1, keepdims=True)
        mixed = (like * np.repeat(share.astype(np.float32), lengths, axis=0)).sum(axis=1)
        return share, np.add.reduceat(np.log(mixed.astype(np.float64)) * count, heads)

    def infer(self, texts: list[str]) -> np.ndarray:
        """Proportions by text and language over the chosen set; a text without letters has zeros."""
        out = np.zeros((len(texts), len(self.languages)))
        if not self.languages:
            return out
        owner, bucket, count = trigrams(list(map(folded, texts)))
        if not len(owner):
            return out
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        who = owner[heads]
        like, weight = self.table[bucket], count.astype(np.float64)
        single = np.add.reduceat(np.log(like.astype(np.float64)) * weight[:, None], heads, axis=0)
        best = single.argmax(axis=1)
        chosen, worth = np.zeros((len(who), len(self.languages))), single.max(axis=1)
        chosen[np.arange(len(who)), best] = 1
        fine = self.penalty * np.log(np.add.reduceat(weight, heads) + 1)
        full, ceiling = self.proportions(like, weight, heads, np.ones_like(chosen))
        # no set is likelier than all languages together: where even that doesn't pay for a second one, one is the answer
        open_ = np.flatnonzero(ceiling - fine > worth)
        order = np.argsort(-full, axis=1, kind="stable")
        ends = np.r_[heads[1:], len(owner)]
        for size in range(2, len(self.languages) + 1):
            if not len(open_):
                break
            rows = np.concatenate([np.arange(heads[i], ends[i]) for i in open_])
            starts = np.r_[0, np.cumsum(ends[open_] - heads[open_])[:-1]]
            allowed = np.zeros((len(open_), len(self.languages)))
            np.put_along_axis(allowed, order[open_, :size], 1, axis=1)
            share, likelihood = self.proportions(like[rows], weight[rows], starts, allowed)
            value = likelihood - (size - 1) * fine[open_]
            better = value > worth[open_]
            chosen[open_[better]], worth[open_[better]] = share[better], value[better]
            open_ = open_[ceiling[open_] - size * fine[open_] > worth[open_]]
        out[who] = chosen
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **settings) -> LanguageModel:
    """Count the trigrams of every given document with a language. No such document: a model without languages.

    The table of counts has MOST_BYTES at most: of more languages than that holds, those of most documents are learned
    (ties: by name), and the others are never predicted.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    most = MOST_BYTES // (8 * BUCKETS)
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    languages = sorted(r["lang"] for r in common)
    if len(languages) == most:
        known = known.where(F.col("lang").isin(languages))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for start, part in text_chunks(texts):
                own = np.array(langs[start : start + len(part)])
                owner, bucket, count = trigrams(list(map(folded, part)))
                for lang in set(own.tolist()):
                    mine = (own == lang)[owner]
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += np.bincount(bucket[mine], count[mine], minlength=BUCKETS).astype(np.int64)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    summed = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    if summed.num_rows:
        at = np.searchsorted(np.array(languages), np.array(summed.column("lang").to_pylist()))
        counts[at, summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return LanguageModel(languages, counts, **settings)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, proportions map) of every whole text.

    ``lang_pred``: the language of greatest proportion (ties: the first by name), ``score``: that proportion. Null texts
    and texts without letters, and all texts if no language was learned: UNKNOWN, 0 and no proportions. Repeated rows
    give a row each, null ids stay null, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        learned = shared.value

        def work(texts):
            names, scores, maps = [], [], []
            for start, part in text_chunks(texts, 1 << 18):
                for row in learned.infer(part):
                    top = int(row.argmax()) if len(row) else -1
                    found = top >= 0 and row[top] > 0
                    names.append(learned.languages[top] if found else UNKNOWN)
                    scores.append(min(1.0, float(row[top])) if found else 0.0)
                    maps.append([(learned.languages[i], float(row[i])) for i in np.flatnonzero(row > 1e-6)])
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType()))]
    return map_text(docs, [id_col], fields, make, text_col)
