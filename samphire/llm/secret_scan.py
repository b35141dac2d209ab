"""Secret scans: base patterns, and character Markov models of random strings against ordinary identifiers.

A stretch of key-like characters is a secret if a chain trained on random
strings explains it better than one trained on ordinary identifiers: the
log-likelihood ratio of the whole stretch decides, not its length or classes.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samphire.llm.common import hash_sample, map_text, slices
from samphire.shipping import ship

#: The base patterns, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20}

SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
INDEX = {c: i for i, c in enumerate(SYMBOLS)}
#: Code of each ASCII character; what is no symbol ends a run, as does a base span.
OTHER, RESET = len(SYMBOLS), -1e7
TABLE = np.array([INDEX.get(chr(i), OTHER) for i in range(128)], np.int64)
#: A secret takes whole parts between these.
BORDERS = np.array([INDEX[c] for c in "/=_-"])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within each kind."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def codes(token: str) -> np.ndarray:
    return np.fromiter((INDEX[c] for c in token), np.int64, len(token))


def random_tokens(seed: int, each: int) -> list[str]:
    """Labelled samples of the class random: keys in the alphabets in use, 20 to 64 characters."""
    rng = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.digits + "abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return ["".join(rng.choices(a, k=rng.randint(20, 64))) for a in alphabets for _ in range(each)]


class Chain:
    """First-order chain over SYMBOLS: log probabilities of a first character and of each successor."""

    def __init__(self, tokens: list[str], weight: float = 0.5):
        n = len(SYMBOLS)
        first, step = np.full(n, weight), np.full((n, n), weight)
        for token in tokens:
            c = codes(token)
            if len(c):
                first[c[0]] += 1
                np.add.at(step, (c[:-1], c[1:]), 1)
        self.first = np.log(first / first.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))

    def score(self, c: np.ndarray) -> float:
        return float(self.first[c[0]] + self.step[c[:-1], c[1:]].sum())


class SecretModel:
    """The two chains and the log-likelihood ratio above which a stretch of characters is a secret."""

    def __init__(self, random_: list[str], ordinary: list[str], margin: float):
        self.random, self.ordinary, self.margin = Chain(random_), Chain(ordinary), margin
        self.steps = np.full((OTHER + 1, OTHER + 1), RESET)
        self.steps[:OTHER, :OTHER] = self.random.step - self.ordinary.step
        self.steps[OTHER, :OTHER] = self.random.first - self.ordinary.first

    def gains(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of the log ratios before each character and after the last, the greatest of a stretch that ends there)."""
        sums = np.r_[0.0, np.cumsum(self.steps[np.r_[OTHER, c[:-1]], c])]
        return sums, sums[1:] - np.minimum.accumulate(sums[:-1])

    def ratio(self, token: str) -> float:
        """Log-likelihood ratio of the best stretch of a run."""
        return float(self.gains(codes(token))[1].max()) if token else 0.0

    def is_secret(self, token: str) -> bool:
        return self.ratio(token) > self.margin

    def stretches(self, c: np.ndarray, at: int) -> list[tuple[int, int]]:
        """(start, end) of the secrets in a run that begins at ``at``: the best stretch with its whole parts, then in the rest."""
        found, left = [], [(0, len(c))]
        while left:
            low, high = left.pop()
            if low >= high:
                continue
            sums, gain = self.gains(c[low:high])
            last = int(gain.argmax())
            if gain[last] <= self.margin:
                continue
            first = int(sums[: last + 1].argmin())
            border = np.flatnonzero(np.isin(c[low:high], BORDERS))
            start, end = border[border < first], border[border > last]
            if sums[-1] >= 0.9 * gain[last]:  # what is beside the stretch is hardly less random: the whole run is one key
                start = end = border[:0]
            first, last = low + (int(start[-1]) + 1 if len(start) else 0), low + (int(end[0]) if len(end) else high - low)
            found.append((at + first, at + last))
            left += [(low, first), (last, high)]
        return found

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Base spans and, in what they leave, spans of kind markov, by start and then kind."""
        found = base_spans(text)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(points < 128, TABLE[np.minimum(points, 127)], OTHER)
        for a, b, _ in found:
            c[a:b] = OTHER
        if len(c) and (hit := self.gains(c)[1] > self.margin).any():
            ends = np.flatnonzero(c == OTHER)
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(hit))):
                low, high = int(ends[k - 1]) + 1 if k else 0, int(ends[k]) if k < len(ends) else len(c)
                found += [(a, b, "markov") for a, b in self.stretches(c[low:high], low)]
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = 2000, sample_tokens: int = 200_000, seed: int = 7) -> SecretModel:
    """Fit both chains on labelled samples, on the driver.

    Random: generated keys. Ordinary: names of the public functions of this Python's modules, joined and single, capital, numbers, rules of one sign,
    and words outside base spans of at most ``sample_rows`` whole documents (those of lowest hash), at most
    ``sample_tokens`` words in all: a bounded training sample. The margin lies midway between the 99.9th
    percentile of ordinary names and the 1st of random keys of 16 characters or more. An empty table leaves the fixed names alone.
    """
    rows = hash_sample(docs, text_col, sample_rows)
    spark_names = [n for n in dir(F) if not n.startswith("_")] + [n for n in dir(np) if not n.startswith("_")]
    rng = random.Random(seed)
    joined = ["_".join(rng.choices(spark_names, k=rng.randint(2, 4))) + rng.choice(["", "1", "_2", "_v3", "2024", "_10"]) for _ in range(4000)]
    joined += ["".join(p.title() for p in rng.choice(joined).split("_")) for _ in range(4000)] + ["-".join(rng.choice(joined).split("_")) for _ in range(2000)]
    paths = ["/".join(rng.choices(spark_names, k=rng.randint(2, 5))) for _ in range(4000)]
    dates = [f"{rng.choice(spark_names)}-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" for _ in range(1000)]
    # numbers (of cards, accounts, times) and rules of one sign name no key
    numbers = ["".join(rng.choices(string.digits, k=rng.randint(4, 19))) for _ in range(4000)]
    rules = [sign * rng.randint(3, 80) for sign in "+/_=-" for _ in range(200)]
    constants = [j.upper() for j in joined[:2000]]
    words: list[str] = []
    for body in rows:
        if len(words) >= sample_tokens:
            break
        for a, b, _ in sorted(base_spans(body), reverse=True):
            body = body[:a] + " " + body[b:]
        words += re.findall(r"[A-Za-z0-9+/_=-]+", body)
    ordinary = spark_names + joined + paths + dates + numbers + rules + constants + [w for w in words[:sample_tokens] if len(w) < 20]
    ordinary += [w.upper() for w in words[:sample_tokens:10] if len(w) < 20]  # names and headings in capitals
    model = SecretModel(made := random_tokens(seed, 1500), ordinary, 0.0)
    keys = [t[: rng.randint(16, 24)] for t in made]
    high = np.percentile([model.ratio(t) for t in joined + paths + dates + numbers + rules + constants], 99.9)
    low = np.percentile([model.ratio(t) for t in keys], 1)
    model.margin = float((high + low) / 2) if low > high else float(high)
    return model


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every whole text: array of (start, end, kind), code points, end exclusive, by start then kind.

    Null and empty texts have no spans. Repeated rows give a row each, null ids stay null, other columns are ignored.
    """
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def make():
        return lambda texts: [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in model.spans(t or "")] for t in texts], kind)]

    return map_text(docs, [id_col], [T.StructField("spans", T.ArrayType(span))], make, text_col)


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        id_col,
        *[count(k) for k in KINDS[:3]],
        F.sha2(told(F.filter("spans", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span replaced by ``mask``; the length column follows the new text.

    Rows without a span, null texts among them, pass unchanged.
    """
    ship(docs.sparkSession)
    schema = docs.schema
    names = [f.name for f in schema.fields]
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None

    def masked(text: str | None) -> str | None:
        spans = model.spans(text) if text else []
        if not spans:
            return text
        out, last = [], 0
        for start, end, _ in spans:
            if start >= last:
                out += [text[last:start], mask]
            last = max(last, end)
        return "".join([*out, text[last:]])

    def run(batches):
        for batch in slices(batches):
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [masked(t) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if length_at is not None:
                kept = columns[length_at].to_pylist()
                columns[length_at] = pa.array([k if a is b or a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    """The digest of base spans, as ``digests`` computes it; for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k != "markov").encode()).hexdigest()
