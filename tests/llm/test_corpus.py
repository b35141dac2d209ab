"""Operators over the whole corpus against brute force: packing, near copies, mixing, neighbours, the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from cases import empty, frame, prose, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from samphire.llm import mixing, near_copies, neighbours, packing, queries, simhash
from samphire.operators.graph import connected_components

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(docs, pieces, window=4096):
    """docs: [(id, text)]; every id of every document lies in one piece, sequences are gapless, few aren't full."""
    library = Tokenizer.from_file(WORDS)
    want = sorted(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in docs)
    by = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"] is None, p["doc_id"] or 0, p["start"])):
        assert len(p["ids"]) == 4 * p["length"] > 0
        by.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    # repeated documents have equal pieces: what matters is that the ids come out whole
    got = sum(p["length"] for p in pieces)
    assert got == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    if len({i for i, _ in docs}) == len(docs):
        whole = []
        for own in by.values():
            at = 0
            for p in own:
                assert p["start"] == at
                at += p["length"]
            assert at == own[0]["doc_tokens"]
            whole.append(zlib.crc32(b"".join(bytes(p["ids"]) for p in own)))
        assert sorted(whole) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = [r.asDict() for r in packing.pack(docs, WORDS, shard_tokens=60_000).collect()]
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], pieces)
    again = [r.asDict() for r in packing.pack(docs, WORDS, shard_tokens=60_000).collect()]
    key = lambda p: (p["doc_id"], p["start"])
    assert sorted(pieces, key=key) == sorted(again, key=key)
    check_pieces([r[:2] for r in rows()], [r.asDict() for r in packing.pack(frame(spark), WORDS).collect()])
    assert packing.pack(empty(spark), WORDS).count() == 0
    digests = queries.op1_lexical_packing(spark, SF).collect()
    assert sum(r.length for r in digests) == sum(p["length"] for p in pieces)


def corpus_weights(docs):
    """Plain weights of ids 0 to the greatest, and the mean length."""
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]))
    return np.where(df > 0, np.log((len(docs) - df + 0.5) / (df + 0.5)), 0.0), np.mean([len(d) for d in docs])


def plain_scores(docs, q, weight, mean):
    """Scores of all documents, term by term; terms that no other document has add nothing."""
    want = np.zeros(len(docs))
    for t in set(docs[q].tolist()):
        if weight[t] > 0 and sum(t in d for d in docs) > 1:
            for i, d in enumerate(docs):
                tf = int((d == t).sum())
                want[i] += weight[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return want


def test_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint32) for _ in range(30)]
    weight, mean = corpus_weights(docs)
    index = packing.Bm25(docs, weight, mean)
    for q in range(len(docs)):
        assert index.scores(q) == pytest.approx(plain_scores(docs, q, weight, mean))
    used = np.arange(len(docs)) % 3 == 0
    index.forget(used)
    for q in range(len(docs)):
        assert index.scores(q)[~used] == pytest.approx(plain_scores(docs, q, weight, mean)[~used])
    topic = lambda k, size: rng.integers(1000 * k, 1000 * k + 40, size).astype(np.uint32)
    docs = [topic(k % 4, 50) for k in range(40)]
    together = {}
    for d, _, _, s, _ in packing.pack_shard(docs, 200, *corpus_weights(docs)):
        together.setdefault(s, []).append(d % 4)
    assert np.mean([len(set(v)) == 1 for s, v in together.items() if s >= 0]) > 0.7


def plain_fill(score, left, text, room, held):
    """The rule of ``fill``, one document after another."""
    order = sorted((d for d in range(len(left)) if left[d] > 0), key=lambda d: (-score[d], d))
    out, held = [], set(held)
    for related, fresh in ((True, True), (False, True), (False, False)):
        fits = lambda d: d not in {x for x, _ in out} and (score[d] > 0 or not related) and not (fresh and text[d] in held)  # noqa: B023, E731
        for d in order:
            if left[d] <= room and fits(d):
                out.append((d, int(left[d])))
                held.add(text[d])
                room -= left[d]
        if room:
            for d in order:
                if fits(d):
                    out.append((d, int(room)))
                    room = 0
                    break
        if not room:
            break
    return out


def test_windows_are_filled_by_score_then_position(monkeypatch):
    rng = np.random.default_rng(4)
    ranked = packing.ranked
    for case in range(300):
        n = int(rng.integers(1, 60))
        score = rng.integers(0, 4, n).astype(float)  # many ties
        left, text = rng.integers(0, 30, n), rng.integers(0, 20, n)
        monkeypatch.setattr(packing, "ranked", lambda s, among, case=case: ranked(s, among, 1 + case % 7))
        room = int(rng.integers(1, 80))
        assert list(packing.fill(score, left, text, room, {3})) == plain_fill(score, left, text, room, {3})


def test_copies_go_to_different_windows(spark):
    docs = [(i % 40, prose(i % 40, 30 + i % 40), "en", "s", 1) for i in range(160)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), WORDS, window=256).collect()
    held, size = {}, {}
    for p in pieces:
        held.setdefault(p.sequence_id, []).append(p.doc_id)
        size[p.sequence_id] = size.get(p.sequence_id, 0) + p.length
    # the last windows of a partition may have nothing else left
    assert np.mean([len(set(v)) < len(v) for s, v in held.items() if size[s] == 256]) < 0.2
    alone = packing.pack(spark.createDataFrame([(i, "the same words") for i in range(900)], "doc_id long, text string"), WORDS, window=64).collect()
    check = {}
    for p in alone:
        check[p.sequence_id] = check.get(p.sequence_id, 0) + p.length
    assert sum(check.values()) == 900 * alone[0].doc_tokens and sum(v != 64 for v in check.values()) < 10


def test_like_documents_meet_in_a_shard(spark):
    """Of each document's best neighbour in the whole corpus, the share that the order by min-hashes puts near it."""
    rng = random.Random(8)
    topics = [["".join(rng.choices("abcdefghijklmnoprstuvw", k=8)) for i in range(60)] for k in range(50)]
    common = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=5)) for _ in range(200)]
    for filler in (0, 80):  # words of all topics weigh little
        docs = [(i, " ".join(rng.choices(topics[i % 50], k=80) + rng.choices(common, k=filler))) for i in range(1000)]
        made = packing.encoded(spark.createDataFrame(docs, "doc_id long, text string"), WORDS, 2).cache()
        ranks = packing.min_hash_ranks(*packing.corpus_weights(made, 1000))
        dealt = packing.keyed(made.where("counts IS NULL"), ranks).orderBy("k1", "k2").collect()
        made.unpersist()
        place = {r.doc_id: n // 50 for n, r in enumerate(dealt)}  # 20 shards
        same = [np.mean([place[j] == place[i] for j in range(i % 50, 1000, 50) if j != i]) for i in range(1000)]
        assert np.mean(same) > 2 / 20  # 1 in 20 by chance


def test_first_ids_are_drawn_by_weight():
    """Two ids with weights 3 and 1: the heavier one comes first three times in four; ids without a neighbour come last."""
    weight = np.tile([3.0, 1.0], 20_000)
    found = np.full(40_000, 5.0)
    found[:100] = 1
    weight[100:200] = -0.5
    for rank in packing.min_hash_ranks(found, weight):
        assert sorted(rank) == list(range(40_000))
        assert rank[:200].min() > rank[200:].max()
        pairs = rank[200:].reshape(-1, 2)
        assert abs((pairs[:, 0] < pairs[:, 1]).mean() - 0.75) < 0.02


def brute_components(items, linked):
    label = list(range(len(items)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def plain_simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    plain = sorted((r.doc_id, plain_simhash(r.text)) for r in docs)
    label = brute_components([p for _, p in plain], lambda a, b: (a ^ b).bit_count() <= 2)
    want = {plain[i][0]: (f"{plain[i][1]:016x}", plain[label[i]][0]) for i in range(len(plain))}
    found = queries.op6_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == want
    odd = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(frame(spark)).collect()}
    assert simhash.near_duplicates(frame(spark)).count() == len(rows()) and odd[(3, 0)] == 3 and odd[(4, 0)] == 3 and odd[(6, 0)] == 3 and odd[(None, 0)] == 3
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("rows_", [4096, 8])
def test_exact_links(spark, monkeypatch, rows_):
    """Large shards are dealt again: no link is lost."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows_)
    rng = random.Random(rows_)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(60)} | {base[0] ^ (k << 32) for k in range(60)})
    label = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.exact_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    groups = {}
    for r in connected_components(links, "a", "b").collect():
        groups.setdefault(r.component, set()).add(r.node)
    want = {}
    for v, k in zip(signed, label, strict=True):
        want.setdefault(k, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("radius", [0, 2, 9, 30])
def test_bk_forest(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 2**63, (120, 2), dtype=np.uint64)
    prints[60:] = prints[:60] ^ (np.uint64(1) << rng.integers(0, 63, (60, 2), dtype=np.uint64))
    shard = np.sort(rng.integers(0, 5, 120))
    forest = simhash.BkForest(prints, shard)
    found = {(int(a), int(b), int(d)) for x in forest.links(radius) for a, b, d in zip(*x, strict=True)}
    distance = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum())
    assert found == {(i, j, distance(i, j)) for i in range(120) for j in range(i) if shard[i] == shard[j] and distance(i, j) <= radius}


def test_near_copies(spark):
    rng = random.Random(5)
    texts = []
    for k in range(12):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        texts += [" ".join(words)] + [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in rng.sample(range(200), 3)]
    texts += [" ".join(f"v{rng.randint(0, 5000)}" for _ in range(150)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert found == {i: i // 4 * 4 if i < 48 else i for i in range(len(texts))}
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values())) and kept.columns == docs.columns
    odd = corpus_pipeline.drop_near_copies(spark, frame(spark), SF).collect()
    ids = [r.doc_id for r in odd]
    assert ids.count(2) == 0 and ids.count(1) == 1 and ids.count(3) == 1 and not {4, 6} & set(ids) and ids.count(None) == 1
    assert near_copies.near_copies(empty(spark)).count() == 0


def test_hot_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SHARD_ROWS", 10)
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join([*words[:i], "x", *words[i + 1 :]])) for i in range(60)], "doc_id long, text string")
    assert {r.component_id for r in near_copies.near_copies(docs).collect()} == {0}


def near_pairs(seed):
    """Pairs of texts around a similarity of 0.8: long with own ends, short with one word changed, very short."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    texts = []
    for own in [20, 23, 24, 25, 25, 25, 26, 27, 29, 33] * 8:
        both = fresh(204)
        texts += [both + fresh(own), both + fresh(own)]
    for n in [44, 49, 50, 53, 60] * 8:
        words = fresh(n)
        texts += [words, [*words[:20], "changed", *words[21:]]]
    for n in [7, 8, 9, 10] * 10:
        words = fresh(n)
        texts += [words, [*words, "more"]]
    return [" ".join(t) for t in texts]


def brute_force(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(enumerate(label))


def test_near_copies_around_the_similarity(spark):
    texts = near_pairs(11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert found == brute_force(texts)


def hot_pairs(seed, pairs):
    """Texts of one long passage, all at about 0.77 of each other, of which two and two share more and are at about 0.84."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage, texts = fresh(204), []
    for _ in range(pairs):
        shared = fresh(10)
        texts += [passage + shared + fresh(rng.randint(18, 21)) for _ in range(2)]
    return [" ".join(t) for t in texts]


def test_hot_shards_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SHARD_ROWS", 6)
    texts = hot_pairs(3, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_force(texts)
    assert len(set(want.values())) == 40
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want


def test_mixing(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = {r[0]: r[1:] for r in con.sql(mixing.SQL).fetchall()}
    found = {r[0]: tuple(r)[1:] for r in queries.op8_mixing_sources(spark, SF).collect()}
    assert found == want
    taken, target = {}, {}
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for k, (size, _, aim, took) in found.items():
        assert took <= 3 * size
        taken[sources[k]] = taken.get(sources[k], 0) + took
        target[sources[k]] = aim
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def plain_targets(sizes, limit=3.0):
    """By the rule as told: share by weight, hold at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held, out = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(limit * sizes[s] for s in held)
        free = sum(weight[s] for s in names if s not in held)
        out = {s: limit * sizes[s] if s in held else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in held and out[s] > limit * sizes[s] * (1 + 1e-12)}
        if not over:
            return out
        held |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 100000]) for s in [*"abcdefgh"[: rng.randint(1, 8)], None]}
    sizes["a"] = max(1, sizes.get("a", 0))
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert found == pytest.approx(plain_targets(sizes))


def test_targets_keep_further_columns(spark):
    """So no second sum over the documents, and no join of the two, has to tell a source's documents."""
    found = mixing.targets(spark.createDataFrame([("a", 10, 3), (None, 5, 2)], "source string, source_size long, `docs. of it` long")).collect()
    assert {r.source: r["docs. of it"] for r in found} == {"a": 3, None: 2}


def test_mixing_odd_rows(spark):
    found = mixing.mix(frame(spark), carry=["row"]).collect()
    assert len(found) == len(rows()) and all(0 <= r.taken <= 3 * r.size for r in found)
    assert sorted(r.size for r in found) == sorted(len((r[1] or "").encode().split()) for r in rows())
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert mixing.mix(frame(spark), labels).count() == len(rows())
    assert mixing.mix(empty(spark), labels).count() == 0


def test_mixing_of_equal_rows_and_names(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 4)
    rows = [(1, "a b c d", "s")] * 50 + [(None, "x y", "s")] * 30 + [(i, "w " * i, "t") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("z")).withColumn("target", F.lit("y")).withColumn("__id", F.lit("q")).withColumn("a b", F.lit(1))
    found = mixing.mix(docs, carry=["a b", "__id"]).collect()
    assert len(found) == len(rows) and {(r["a b"], r["__id"]) for r in found} == {(1, "q")}
    for source, size in (("s", 260), ("t", sum(range(2, 30)))):
        own = [r for r in found if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50 and all(r.taken <= 3 * r.size for r in own)
    assert len({r.taken for r in found if r.doc_id == 1}) == 1
    assert mixing.mix(docs, carry=["size", "target", "source"]).count() == len(rows)


def test_better_documents_come_first(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 16)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 1600, "a").otherwise("b").alias("source"))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    found = mixing.mix(docs, labels, weights=(1.0, 5.0)).where("doc_id < 1600").collect()
    mean = lambda q: np.mean([r.taken for r in found if r.doc_id % 2 == q])
    assert mean(1) > 1.5 * mean(0)
    assert sum(r.taken for r in found) == round(found[0].target)


def brute_nearest(ids, x, k, query):
    out = {}
    for i in np.flatnonzero(query(ids)):
        score = np.array([np.einsum("i,i->", x[i], v) for v in x])
        other = ids != ids[i]
        order = np.lexsort((ids[other], -score[other]))[:k]
        out[int(ids[i])] = [(int(ids[other][j]), float(score[other][j])) for j in order]
    return out


def nearest_by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    want = brute_nearest(table.vec_id.to_numpy(), np.array(table.embedding.tolist(), np.float64), 20, lambda i: i % 20 == 0)
    found = nearest_by_query(queries.op10_nearest_neighbours(spark, f"/root/testdata/{sf}").collect())
    assert set(found) == set(want) and all(len(found[q]) == 20 for q in want)
    hit = sum(len({a for a, _ in found[q]} & {a for a, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.98
    assert all(dict(want[q]).get(a, s) == pytest.approx(s, abs=1e-12) for q in found for a, s in found[q])


def test_odd_vectors(spark):
    data = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (5, [2.0, 1.0], 1), (5, [2.0, 1.0], 1), (8, [0.0, 0.0], 1), (9, None, 1), (None, [1.0, 1.0], 1), (10, [1.0, None], 1), (11, [float("nan"), 1.0], 1), (12, [float("inf"), 1.0], 1), (13, [1.0], 1), (40, [-1.0, 0.5], 1)]
    frame_ = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    found = nearest_by_query(neighbours.nearest(frame_, "__id % 20 = 0", k=3).collect())
    assert found == {0: [(5, 2.0), (5, 2.0), (7, 1.0)], 20: [(5, 2.0), (5, 2.0), (0, 1.0)], 40: [(0, -1.0), (7, -1.0), (20, -1.0)]}
    assert neighbours.nearest(frame_.where("false"), "__id % 20 = 0").count() == 0
    assert neighbours.nearest(frame_.where("vec_id = 0"), "__id % 20 = 0").count() == 0
    assert neighbours.nearest(frame_.where("vec_id = 7 or vec_id = 5"), "__id % 20 = 0").count() == 0


def test_neighbours_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 20)  # three blocks
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 10)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16))
    x[500:520] = x[500]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_nearest(np.arange(900), x, 10, lambda i: i % 20 == 0)
    found = nearest_by_query(neighbours.nearest(vectors, "__id % 20 = 0", k=10, sample_rows=60).collect())
    hit = sum(len({a for a, _ in found[q]} & {a for a, _ in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) > 0.97
    assert found[500] == want[500]


def test_repeated_ids_and_clusters_left_out(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((8, 12)) * 10
    x = np.repeat(centers, 150, axis=0) + rng.standard_normal((1200, 12)) * 0.3
    ids = np.arange(1200) // 2  # each id twice
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(vectors, "__id % 20 = 0", k=10, sample_rows=200).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(round(r.score, 9))
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hit = total = 0
    for q in range(0, 600, 20):
        want = np.concatenate([np.sort(score[r])[::-1][:10] for r in np.flatnonzero(ids == q)]).round(9).tolist()
        assert len(got[q]) == 20  # ten for each of its rows
        hit += sum(s in want for s in got[q])
        total += 20
    assert hit / total > 0.97


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        if name != "packing":
            assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    insults = {"idiot", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "clown", "disgusting"}
    named = {i for i, t in first.items() if len(insults & set(t.lower().replace(".", " ").replace(",", " ").split())) >= 2}
    after = {r.doc_id for r in kept["toxicity"]}
    assert len(named & after) < 0.1 * len(named) and len(after) > 0.9 * (len(first) - len(named))
    texts = [r.text for r in kept["near_dedup"]]
    assert len(set(texts)) == len(texts) and {r.text for r in kept["toxicity"]} >= set(texts)
    assert len(kept["secrets"]) == len(kept["near_dedup"]) and not any("AKIA" in r.text for r in kept["secrets"])
    assert all(r.n_chars == len(r.text) for r in kept["secrets"] if "[secret]" in r.text)
    mixed = {}
    for r in kept["mixing"]:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert max(mixed.values()) <= 3 and set(mixed) <= {r.doc_id for r in kept["secrets"]}
    pieces = [r.asDict() for r in kept["packing"]]
    check_pieces([(r.doc_id, r.text) for r in kept["mixing"]], pieces)
    windows, size = {}, {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p["doc_id"])
        size[p["sequence_id"]] = size.get(p["sequence_id"], 0) + p["length"]
    assert sum(len(set(v)) < len(v) for s, v in windows.items() if size[s] == 4096) <= 2  # where nothing else is left


def test_pipeline_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.createDataFrame([(*r[:4], 1) for r in rows()], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("row", F.lit(2))
    for data in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, data, SF)
            assert name == "packing" or made.columns == docs.columns
            made.count()
