"""Token counts by rank-synchronous merging of byte pairs in arrays.

Distinct pre-tokens of a chunk of texts lie one behind another in a flat array
of symbols. Each round looks up the rank of every adjacent pair, takes the
lowest of each pre-token and merges all its occurrences at once; what is left
when no pair has a rank is the number of tokens.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from samphire.llm.array_bpe import byte_symbols, merge, pair_table
from samphire.llm.common import map_text, segments, text_chunks

#: Distinct pre-tokens whose counts a worker keeps; further ones are counted again in each chunk.
KEPT = 400_000
#: The split pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class ArrayBpe:
    """Counts tokens as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.table = pair_table(told["model"])
        self.first = np.array([told["model"]["vocab"][s] for s in byte_symbols()], np.int32)
        self.pieces = regex.compile(PIECES)
        special = sorted((t["content"] for t in told.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.known: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of added tokens whose strings stand in the text."""
        if self.special is None or not any(mark in text for mark in self.marks):
            return self.pieces.findall(text), 0
        found = self.special.findall(text)
        return [p for part in self.special.split(text) for p in self.pieces.findall(part)], len(found)

    def merged_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token: symbols that survive all rounds."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        _, owner = merge(symbols, np.repeat(np.arange(len(raw), dtype=np.int32), sizes), self.table)
        return np.bincount(owner, minlength=len(raw))

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split(text) for text in texts]
        fresh: dict[str, int] = dict.fromkeys(w for words, _ in split for w in words if w not in self.known)
        if fresh:
            words = list(fresh)
            fresh = dict(zip(words, self.merged_counts(words).tolist(), strict=True))
            if len(self.known) < KEPT:
                self.known.update(fresh)
        # what was learned just now may not be kept: look there first
        return [sum(fresh[w] if w in fresh else self.known[w] for w in words) + extra for words, extra in split]


@functools.lru_cache(maxsize=2)
def load(path: str) -> ArrayBpe:
    return ArrayBpe(path)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text.

    ``tokenizer``: path of a byte-level BPE file (.json), readable on every machine. Strings of added tokens inside a
    text count as one token, the library's default. Null and empty text: 0 bytes, 0 tokens. Repeated rows are counted
    each; null ids stay null; other columns are ignored, whatever their names.
    """

    def make():
        bpe = load(tokenizer)

        def work(texts: list[str | None]) -> list[pa.Array]:
            counts = [n for _, run in text_chunks(texts) for n in (bpe.count(run) if len(run) > 1 else [sum(sum(bpe.count([s])) for s in segments(run[0]))])]
            return [pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64())]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_text(docs, [id_col], fields, make, text_col)
