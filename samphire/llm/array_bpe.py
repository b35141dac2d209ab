"""Byte-pair merging in arrays, rank by rank for all sequences at once."""

from __future__ import annotations

import heapq

import numpy as np

#: Symbols of a sequence that is merged apart.
LONG = 512
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def pair_table(model: dict) -> PairTable:
    """The merges of a BPE model as the tokenizers library writes it."""
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in merges], np.int64)
    right = np.array([vocab[b] for _, b in merges], np.int64)
    return PairTable(left << 20 | right, np.array([vocab[a + b] for a, b in merges], np.int32))


class PairTable:
    """Open-addressed table from a pair of symbols to (rank, merged symbol), looked up for whole arrays."""

    BITS = 19

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.rank = np.full(1 << self.BITS, NO_RANK, np.int32)
        self.merged = np.zeros(1 << self.BITS, np.int32)
        left, at = np.arange(len(pairs)), self._slot(pairs)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.rank[at[won]], self.merged[at[won]] = pairs[left[won]], left[won], merged[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """The slot that holds each pair, or an empty slot, whose rank is NO_RANK."""
        at = self._slot(pairs)
        open_ = np.flatnonzero((self.keys[at] != pairs) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[at[open_]]
            open_ = open_[(held != pairs[open_]) & (held >= 0)]
        return at


def merge(symbols: np.ndarray, owner: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, owners) that survive: each round merges all occurrences of every owner's pair of lowest rank.

    ``symbols``: one behind another; ``owner``: whose they are, in ascending runs. Both stay in this order. Owners of
    more than LONG symbols take a round a rank and would keep all others waiting: they go to ``merge_long``.
    """
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)]) if len(owner) else np.empty(0, np.int64)
    far = np.repeat(sizes > LONG, sizes)
    if far.any():
        short, long = merge(symbols[~far], owner[~far], table), merge_long(symbols[far], owner[far], table)
        kept, whose = (np.concatenate(x) for x in zip(short, long, strict=True))
        order = np.argsort(whose, kind="stable")
        return kept[order], whose[order]
    final, place = np.full(len(symbols), -1, np.int32), np.arange(len(symbols))
    symbols, left = symbols.copy(), owner
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        lengths = np.diff(np.r_[starts, len(symbols)])
        slots = table.slots(symbols[:-1].astype(np.int64) << 20 | symbols[1:])
        rank = np.where(left[1:] == left[:-1], table.rank[slots], NO_RANK)
        lowest = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
        done = np.repeat(lowest == NO_RANK, lengths)
        final[place[done]] = symbols[done]
        run = np.flatnonzero((rank == np.repeat(lowest, lengths)[:-1]) & (rank != NO_RANK))
        keep = ~done
        if len(run):
            run = every_second(run, rank[run])
            symbols[run] = table.merged[slots[run]]
            keep[run + 1] = False
        symbols, left, place = symbols[keep], left[keep], place[keep]
    alive = final >= 0
    return final[alive], owner[alive]


def every_second(run: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of equal pairs that overlap (x x x) every second one merges, from the left."""
    count = np.arange(len(run))
    heads = np.r_[True, (np.diff(run) != 1) | (rank[1:] != rank[:-1])]
    return run[(count - np.maximum.accumulate(np.where(heads, count, 0))) % 2 == 0]


def merge_long(symbols: np.ndarray, owner: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """``merge`` for long sequences: a round takes the lowest rank of all and touches its occurrences alone.

    Owners merge independently, so ranks can ascend for all together. Places of a rank wait in lists, from the lowest;
    a place whose pair has changed since is passed over.
    """
    n = len(symbols)
    symbols = symbols.copy()
    after, before = np.r_[np.arange(1, n), -1], np.arange(-1, n - 1)
    ends = np.flatnonzero(owner[1:] != owner[:-1])
    after[ends], before[ends + 1] = -1, -1
    alive, rank, slot = np.ones(n, bool), np.full(n, NO_RANK, np.int64), np.zeros(n, np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def look(at: np.ndarray) -> None:
        """Rank the pairs that begin at these places and let them wait."""
        open_ = after[at] >= 0
        rank[at[~open_]] = NO_RANK
        at = at[open_]
        slot[at] = table.slots(symbols[at].astype(np.int64) << 20 | symbols[after[at]])
        rank[at] = table.rank[slot[at]]
        at = at[rank[at] != NO_RANK]
        order = np.argsort(rank[at], kind="stable")
        at = at[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(rank[at]) != 0]) if len(at) else at
        for part in np.split(at, cuts[1:]) if len(at) else []:
            own = int(rank[part[0]])
            if own not in waiting:
                waiting[own] = []
                heapq.heappush(heap, own)
            waiting[own].append(part)

    look(np.arange(n))
    while heap:
        lowest = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(lowest)))
        at = at[alive[at] & (rank[at] == lowest)]
        if not len(at):
            continue
        # overlapping ones follow each other: number the places as if what is gone weren't there
        chain = np.arange(len(at))
        linked = np.r_[False, after[at[:-1]] == at[1:]]
        heads = np.where(linked, 0, chain)
        at = at[(chain - np.maximum.accumulate(heads)) % 2 == 0]
        gone = after[at]
        symbols[at] = table.merged[slot[at]]
        alive[gone] = False
        after[at] = after[gone]
        tail = after[at] >= 0
        before[after[at][tail]] = at[tail]
        left = before[at]
        look(np.unique(np.concatenate([at, left[left >= 0]])))
    return symbols[alive], owner[alive]
