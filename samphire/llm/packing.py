"""Lexical retrieval packing: documents into sequences of a fixed window, neighbours by BM25 together.

Documents are encoded, sorted by weighted min-hashes of their ids and cut into
shards of a bounded number of tokens, so that like ones meet. Each shard has an inverted
index of token ids, weighted by the whole corpus's document frequencies. A seed
document asks it for its nearest unused neighbours, which fill the seed's window;
the last neighbour is cut where the window ends, and its rest stays in the index.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samphire.llm.array_bpe import byte_symbols, merge, pair_table
from samphire.llm.common import cut_lineage, segments, slices, text_chunks
from samphire.llm.simhash import mix
from samphire.shipping import ship

#: Tokens of a shard. A seed's search reads its shard's postings, so its cost follows this, not the corpus.
SHARD_TOKENS = 700_000
#: Tokens of a range partition, on average: its shards follow each other in one task.
PART_TOKENS = 4_000_000
#: Characters that are encoded at once.
CHUNK_CHARS = 1 << 22
#: The split pattern of the word vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Letters whose lower case depends on more than the letter in one of the two libraries, and separators
#: that are white space in one of them.
ODD = ("İ", "Σ", "\x1c", "\x1d", "\x1e", "\x1f")
#: White space beyond ASCII.
SPACES = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: A point or comma after a letter or digit at a run's end is a piece of its own: apart, it makes fewer distinct runs.
MARKS = ("", ".", ",")
#: Distinct runs whose ids a worker keeps.
KEPT = 600_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PIECES_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("tokens", pa.int64()), ("digest", pa.int64()), ("turn", pa.int64()), ("counts", pa.list_(pa.int64()))])


MARK_OF = np.zeros(256, np.int64)
MARK_OF[[ord("."), ord(",")]] = 1, 2


def string_buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array without nulls; bytes end with the last text's."""
    held = texts.buffers()
    offsets = np.frombuffer(held[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(held[2], np.uint8)[: offsets[-1]] if held[2] is not None else np.empty(0, np.uint8)


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one behind another."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return pool[at]


class WordTokenizer:
    """The ids that the tokenizers library gives, each distinct run between white space encoded once.

    Texts are folded here, split and told apart in Arrow, and distinct runs are split and merged as the file says; a text
    that this might do otherwise (strings of added tokens, text that isn't in form NFC, letters whose lower case depends
    on their neighbours, characters that only one side counts as white space) goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.marks = [t["content"] for t in told.get("added_tokens", [])]
        self.plain = self._folds_and_splits(told)
        self.pieces = regex.compile(PIECES)
        self.size = self.library.get_vocab_size()
        if self.plain:
            vocab = told["model"]["vocab"]
            self.table = pair_table(told["model"])
            self.inner, self.last = (np.array([vocab[s + end] for s in byte_symbols()], np.int32) for end in ("", "</w>"))
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        if self.plain:
            self._learn(pa.array(MARKS, pa.large_string()))

    @staticmethod
    def _folds_and_splits(told: dict) -> bool:
        kinds = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        return kinds == ["NFC", "Replace", "Lowercase"] and told["model"].get("end_of_word_suffix") == "</w>"

    def folded(self, text: str) -> str | None:
        """In lower case, with ASCII white space alone; None if the library must encode the text."""
        if not self.plain or any(m in text for m in self.marks) or any(c in text for c in ODD) or not unicodedata.is_normalized("NFC", text):
            return None
        low = text.lower()
        if not low.isascii():
            for space in SPACES:
                if space in low:
                    low = low.replace(space, " ")
        return low

    def _learn(self, fresh: pa.LargeStringArray) -> None:
        """Ids of distinct runs that aren't known: those of letters alone are one piece, others are split by the pattern."""
        runs = fresh.to_numpy(zero_copy_only=False).tolist()
        whole = np.array(pc.utf8_is_alpha(fresh), bool)
        others = [[p.encode("utf-8", "surrogatepass") for p in self.pieces.findall(runs[i])] for i in np.flatnonzero(~whole).tolist()]
        count = whole.astype(np.int64)
        count[~whole] = np.fromiter(map(len, others), np.int64, len(others))
        offsets, data = string_buffers(fresh)
        mixed = b"".join(p for own in others for p in own)
        # a piece is a stretch of the runs' bytes or, behind them, of the split ones'
        size = np.repeat(np.diff(offsets), count)
        start = np.repeat(offsets[:-1], count)
        split = np.repeat(~whole, count)
        size[split] = np.fromiter((len(p) for own in others for p in own), np.int64, int(split.sum()))
        start[split] = len(data) + np.cumsum(size[split]) - size[split]
        raw = gather(np.concatenate([data, np.frombuffer(mixed, np.uint8)]), start, size)
        symbols = self.inner[raw]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[raw[ends]]
        ids, owner = merge(symbols, np.repeat(np.arange(len(size), dtype=np.int32), size), self.table)
        bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))][np.r_[0, np.cumsum(count)]]
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs)), strict=True))
        self.starts = np.r_[self.starts, len(self.pool) + bounds[:-1]]
        self.lengths = np.r_[self.lengths, np.diff(bounds)]
        self.pool = np.r_[self.pool, ids.astype(np.uint32)]

    def _ids_of(self, runs: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, starts, lengths) of the ids of distinct runs."""
        texts = runs.to_numpy(zero_copy_only=False).tolist()
        offsets, data = string_buffers(runs)
        mark = np.zeros(len(texts), np.int64)
        long = np.flatnonzero(np.diff(offsets) > 1)
        mark[long] = MARK_OF[data[offsets[long + 1] - 1]]
        for i in np.flatnonzero(mark).tolist():
            if texts[i][-2].isalnum():
                texts[i] = texts[i][:-1]
            else:
                mark[i] = 0
        before = len(self.known)
        found = np.array(list(map(self.known.get, texts)), np.float64)  # NaN: not known yet
        missed = np.flatnonzero(np.isnan(found))
        if len(missed):
            wanted = [texts[i] for i in missed.tolist()]
            self._learn(pa.array(list(dict.fromkeys(wanted)), pa.large_string()))
            found[missed] = [self.known[w] for w in wanted]
        both = np.stack([found.astype(np.int64), mark], axis=1).ravel()
        lengths = self.lengths[both]
        pool = gather(self.pool, self.starts[both], lengths)
        if len(self.known) > KEPT and len(missed):  # the first ones seen are the frequent ones: they stay
            for word in wanted:
                self.known.pop(word, None)
            self.pool = self.pool[: int(self.starts[before])]
            self.starts, self.lengths = self.starts[:before], self.lengths[:before]
        lengths = lengths.reshape(-1, 2).sum(axis=1)
        return pool, np.cumsum(lengths) - lengths, lengths

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """uint32 ids of each text, ``end_id`` after them."""
        low = [self.folded(t) for t in texts]
        split = pc.ascii_split_whitespace(pa.array(["" if t is None else t.strip() for t in low], pa.large_string()))
        told = split.flatten().dictionary_encode()
        pool, starts, lengths = self._ids_of(told.dictionary)
        runs = told.indices.to_numpy()
        sizes = lengths[runs]
        ids = gather(pool, starts[runs], sizes)
        bounds = np.r_[0, np.cumsum(sizes)][split.offsets.to_numpy()]
        out = []
        for i, text in enumerate(low):
            own = ids[bounds[i] : bounds[i + 1]] if text is not None else np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            out.append(np.append(own, np.uint32(end_id)))
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Bm25:
    """Inverted index of a shard: for each term, the documents that hold it and what it adds to their scores.

    ``weight``: the inverse document frequency of each id in the whole corpus, ``mean``: its mean length. Terms without a
    positive weight (those in over half of all documents) are left out, as the weight's formula says.
    """

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        n = len(docs)
        size = np.array([len(d) for d in docs], np.int64)
        flat, owner = np.concatenate(docs), np.repeat(np.arange(n), size)
        telling = weight[flat] > 0
        pairs, tf = np.unique(flat[telling].astype(np.int64) * n + owner[telling], return_counts=True)
        term, doc = pairs // n, pairs % n
        heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        df = np.diff(np.r_[heads, len(term)])
        use = np.repeat(df > 1, df)  # a term of one document finds no neighbour
        gain = weight[term[use]] * tf[use] * (k1 + 1) / (tf[use] + k1 * (1 - b + b * size[doc[use]] / mean))
        self.n, self.doc, self.gain = n, doc[use].astype(np.int32), gain
        count = df[df > 1]
        self.ends = np.cumsum(count)
        self.starts = self.ends - count
        slot = np.repeat(np.arange(len(count)), count)
        order = np.argsort(self.doc, kind="stable")
        self.slots = slot[order]
        self.bounds = np.searchsorted(self.doc[order], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """Of all documents, for the terms of one of them."""
        own = self.slots[self.bounds[doc] : self.bounds[doc + 1]]
        count = self.ends[own] - self.starts[own]
        at = np.repeat(self.starts[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.bincount(self.doc[at], self.gain[at], minlength=self.n)

    def forget(self, used: np.ndarray) -> None:
        """Drop the postings of ``used`` documents (a mask)."""
        kept = np.r_[0, np.cumsum(~used[self.doc])]
        alive = np.diff(kept) > 0
        self.doc, self.gain = self.doc[alive], self.gain[alive]
        self.starts, self.ends = kept[self.starts], kept[self.ends]


def ranked(score: np.ndarray, among: np.ndarray, first: int = 256) -> Iterator[np.ndarray]:
    """``among`` (ascending) by descending score, then by position, in growing parts, so that few are ordered if few are wanted."""
    while len(among):
        own = score[among]
        if len(among) > 2 * first:
            near = own >= np.partition(own, -first)[-first]  # with all that tie
            part, own, among = among[near], own[near], among[~near]
        else:
            part, among = among, among[:0]
        yield part[np.argsort(-own, kind="stable")]
        first *= 4


def fill(score: np.ndarray, left: np.ndarray, text: np.ndarray, room: int, held: set[int]) -> Iterator[tuple[int, int]]:
    """(document, tokens) that fill ``room`` beside documents whose texts are ``held``.

    Documents that share a telling term come first, by score: each that fits whole, then a cut of the best that doesn't.
    Then come those that share none, and last copies of a text that is already there: only where nothing else is left.
    """
    taken: set[int] = set()
    for related, fresh in ((True, True), (False, True), (False, False)):
        among = np.flatnonzero((left > 0) & (score > 0)) if related else np.flatnonzero(left)
        for part in ranked(score, among):
            small = part[left[part] <= room]
            for d in small.tolist():
                if left[d] <= room and d not in taken and not (fresh and text[d] in held):
                    yield d, int(left[d])
                    room -= int(left[d])
                    taken.add(d)
                    held.add(int(text[d]))
                if not room:
                    return
        for part in ranked(score, among):
            for d in part.tolist():
                if d not in taken and not (fresh and text[d] in held):
                    yield d, room
                    return


def pack_shard(docs: list[np.ndarray], window: int, weight: np.ndarray, mean: float, text: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of full windows; last, those left over, of sequence -1.

    Whole windows of a long document are sequences of their own. The rests are packed: the longest unused one is the
    seed, and its neighbours fill the window (``fill``). ``text``: a number for each document, equal for equal texts.
    """
    sequence = 0
    start = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    text = np.arange(len(docs)) if text is None else text
    for d in np.flatnonzero(left >= window):
        while left[d] >= window:
            yield int(d), int(start[d]), window, sequence, 0
            start[d] += window
            left[d] -= window
            sequence += 1
    index, indexed, total = Bm25(docs, weight, mean), int((left > 0).sum()), int(left.sum())
    for seed in np.argsort(-left, kind="stable").tolist():
        if not left[seed]:
            continue
        if total < window:
            break
        unused = int((left > 0).sum())
        if 2 * unused < indexed:
            index.forget(left == 0)
            indexed = unused
        filled = int(left[seed])
        yield seed, int(start[seed]), filled, sequence, 0
        left[seed] = 0
        for d, take in fill(index.scores(seed), left.copy(), text, window - filled, {int(text[seed])}):
            yield d, int(start[d]), take, sequence, filled
            filled += take
            start[d] += take
            left[d] -= take
        total -= filled
        sequence += 1
    for d in np.flatnonzero(left).tolist():
        yield d, int(start[d]), int(left[d]), -1, 0


def power_sequences(rest: list[tuple[int, int, int]], text: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): all of ``rest`` in sequences of 2 to a power, which need no padding.

    Equal texts go as far apart as they can.
    """
    seen: Counter[int] = Counter()
    turn = []
    for t in text:
        turn.append(seen[t])
        seen[t] += 1
    total, size, room, sequence = sum(n for *_, n in rest), 0, 0, 0
    for i in sorted(range(len(rest)), key=lambda i: (turn[i], i)):
        d, at, n = rest[i]
        while n:
            if not room:
                size = room = 1 << (total.bit_length() - 1)
                total -= size
            take = min(n, room)
            yield d, at, take, sequence, size - room
            at, n, room = at + take, n - take, room - take
            sequence += not room


def encode_all(words: WordTokenizer, texts: list[str], end_id: int) -> list[np.ndarray]:
    """``encode`` of texts of any length: a chunk that is one very long text goes in segments."""
    if len(texts) > 1:
        return words.encode(texts, end_id)
    parts = [words.encode([part], end_id)[0] for part in segments(texts[0])]
    return [np.concatenate([*(p[:-1] for p in parts[:-1]), parts[-1]])]


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row for each document: doc_id, ids binary, tokens, digest (of the ids), turn; and one a task: counts.

    ``turn``: how many copies of the text the task had before. ``counts``: for each id, in how many of the task's documents
    it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(tokenizer)
        size = max(words.size, end_id + 1)
        counts, copies = np.zeros(size, np.int64), Counter()
        for batch in slices(batches):
            for first, part in text_chunks(batch.column("text").to_pylist(), CHUNK_CHARS):
                tokens = encode_all(words, part, end_id)
                bodies = [t.astype(width_of(size)).tobytes() for t in tokens]
                digest = [xxhash.xxh64_intdigest(b) >> 1 for b in bodies]
                turn = np.zeros(len(tokens), np.int64)
                for i, d in enumerate(digest):
                    turn[i] = copies[d]
                    copies[d] += 1
                for t in tokens:
                    counts[np.unique(t)] += 1
                made = [batch.column("doc_id").slice(first, len(tokens)), bodies, [len(t) for t in tokens], digest, turn, pa.nulls(len(tokens), ENCODED.field("counts").type)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x for x, f in zip(made, ENCODED, strict=True)], schema=ENCODED)
        told = [pa.nulls(1, f.type) for f in list(ENCODED)[:-1]]
        yield pa.RecordBatch.from_arrays([*told, pa.array([counts], ENCODED.field("counts").type)], schema=ENCODED)

    return docs.mapInArrow(run, "doc_id long, ids binary, tokens long, digest long, turn long, counts array<long>")


def corpus_weights(made: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents that hold it, BM25's weight) of each id, over all of ``encoded``."""
    counts = made.where("counts IS NOT NULL").select(F.posexplode("counts").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary
    found = np.zeros(max([0, *counts.column("id").to_pylist()]) + 1)
    found[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    return found, np.where(found > 0, np.log((documents - found + 0.5) / (found + 0.5)), 0.0)


def min_hash_ranks(found: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """For each of two min-hashes, the place of every id in it: exponential draws, divided by the ids' weights.

    A document's first id is each of its own with a chance in proportion to the weight, and documents agree on it the more
    often the more weight they share. Ids that find no neighbour (in one document, or without a weight) come last.
    """
    ranks = []
    for salt in (21, 22):
        draw = ((mix(np.arange(len(weight), dtype=np.uint64), salt) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
        late = np.full(len(weight), np.inf)
        np.divide(-np.log(draw), weight, out=late, where=(found > 1) & (weight > 0))
        rank = np.empty(len(weight), np.uint32)
        rank[np.argsort(late, kind="stable")] = np.arange(len(weight), dtype=np.uint32)
        ranks.append(rank)
    return ranks


def keyed(held: DataFrame, ranks: list[np.ndarray]) -> DataFrame:
    """Encoded documents with ``k1`` and ``k2``, the hashes of their first ids. Further copies of a text in a task get
    other ones, so that they go elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            body, tokens = b"".join(batch.column("ids").to_pylist()), batch.column("tokens").to_numpy()
            flat = np.frombuffer(body, "<u2" if len(body) == 2 * tokens.sum() else "<u4")
            turn = batch.column("turn").to_numpy().astype(np.uint64)
            least = [np.minimum.reduceat(r[flat], np.cumsum(tokens) - tokens).astype(np.uint64) for r in ranks]
            keys = [np.where(turn > 0, mix(k ^ mix(turn, 23), 24), k).view(np.int64) for k in (mix(x, 26) for x in least)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, keys)], names=["doc_id", "ids", "tokens", "digest", "k1", "k2"])

    return held.select("doc_id", "ids", "tokens", "digest", "turn").mapInArrow(run, "doc_id long, ids binary, tokens long, digest long, k1 long, k2 long")


def width_of(size: int) -> str:
    """Of an id as it is stored between the stages."""
    return "<u2" if size <= 1 << 16 else "<u4"


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A document is its ids with ``end_id`` after them; each of them lies in exactly one piece. Null and empty texts are
    one end id. Null document ids stay null; repeated rows are packed each; an empty table gives no piece; other columns
    are ignored. ``tokenizer``: path of the file, readable on every machine.

    Documents are encoded once and written to the shared folder; terms weigh what their counts over all documents say.
    They are then sorted by min-hashes of their ids, weighted alike, over range partitions and taken as shards of
    ``shard_tokens`` in that order: like documents meet in a shard, and neither a shard nor a partition grows with the number of like ones. What
    doesn't fill a window goes on to the partition's next shard, and after the last one into sequences of a power of two.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    made = cut_lineage(encoded(rows, tokenizer, end_id))
    held = made.where("counts IS NULL").drop("counts")
    told = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    found, weight = corpus_weights(made, told["n"])
    mean = max(1.0, told["tokens"] / max(1, told["n"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, numbers = width_of(max(load(tokenizer).size, end_id + 1)), count(TaskContext.get().partitionId() << 40)
        waiting: list[tuple] = []  # (doc_id, tokens of the document, digest, ids not packed yet, their start)

        def out(items: list[tuple], pieces: list[tuple]) -> pa.RecordBatch:
            of = {s: next(numbers) for s in dict.fromkeys(p[3] for p in pieces)}
            columns = [
                [items[d][0] for d, *_ in pieces],
                [items[d][4] + a for d, a, *_ in pieces],
                [n for _, _, n, *_ in pieces],
                [items[d][3][a : a + n].astype("<u4").tobytes() for d, a, n, *_ in pieces],
                [items[d][1] for d, *_ in pieces],
                [of[s] for *_, s, _ in pieces],
                [o for *_, o in pieces],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES_OUT, strict=True)], schema=PIECES_OUT)

        def packed(items: list[tuple]) -> tuple[pa.RecordBatch, list[tuple]]:
            pieces = list(pack_shard([i[3] for i in items], window, weight, mean, np.array([i[2] for i in items])))
            rest = [(*items[d][:3], items[d][3][a:], items[d][4] + a) for d, a, _, s, _ in pieces if s < 0]
            return out(items, [p for p in pieces if p[3] >= 0]), rest

        size = 0
        for batch in slices(batches):
            for doc, body, n, digest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "tokens", "digest")), strict=True):
                waiting.append((doc, n, digest, np.frombuffer(body, width), 0))
                size += n
                if size >= shard_tokens:
                    batch_out, waiting = packed(waiting)
                    size = sum(len(w[3]) for w in waiting)
                    yield batch_out
        if waiting:
            batch_out, waiting = packed(waiting)
            yield batch_out
            yield out(waiting, list(power_sequences([(i, 0, len(w[3])) for i, w in enumerate(waiting)], [w[2] for w in waiting])))

    keys = ["k1", "k2", "digest", "doc_id"]
    parts = max(1, -(-told["tokens"] // PART_TOKENS))
    return keyed(held, min_hash_ranks(found, weight)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, SCHEMA)
