import random

import pytest

from samphire.config import DuplicateOptions
from samphire.operators import duplicates, graph


def brute(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert found == brute(edges)


def test_chain_and_empty(spark):
    chain = [(i, i + 1) for i in range(40)]
    found = graph.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()
    assert {r.component for r in found} == {0} and len(found) == 41
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)], "src long, dst long")
    assert sorted(map(tuple, graph.connected_components(odd).collect())) == [(4, 4), (5, 4)]


def test_long_path_and_star(spark):
    path = graph.connected_components(spark.range(9999).selectExpr("id AS src", "id + 1 AS dst"))
    assert path.where("component = 0").count() == 10_000 == path.select("node").distinct().count()
    star = graph.connected_components(spark.range(1, 5000).selectExpr("struct(id AS a, 'x' AS b) AS src", "struct(7000L AS a, 'x' AS b) AS dst"))
    assert star.where("component.a = 1").count() == 5000


PRINTS = [("p1", "s1", 0x0), ("p2", "s1", 0x0), ("p3", "s2", 0x3F), ("p4", "s3", 0xFFF), ("p5", "s4", 0x8000000000000FFF - (1 << 64))]


def test_fixture(spark):
    prints = spark.createDataFrame(PRINTS, "path string, sha256 string, phash long")
    assert [tuple(r) for r in duplicates.exact_groups(prints).collect()] == [("exact-1", "s1", ["p1", "p2"])]
    findings = duplicates.near_findings(prints)
    rows = [(r.left_path, r.right_path, r.hamming_distance, r.band) for r in findings.orderBy(*duplicates.finding_order()).collect()]
    assert rows == [
        ("p4", "p5", 1, "Likely"), ("p1", "p3", 6, "Likely"), ("p2", "p3", 6, "Likely"), ("p3", "p4", 6, "Likely"),
        ("p3", "p5", 7, "Maybe"), ("p1", "p4", 12, "Maybe"), ("p2", "p4", 12, "Maybe"),
    ]
    group = duplicates.near_groups(prints).first()
    assert (group.group_id, group.paths, group.likely_pair_count, group.maybe_pair_count) == ("near-1", ["p1", "p2", "p3", "p4", "p5"], 4, 3)
    assert group.score == pytest.approx(0.888392857143, abs=1e-11)


def test_near_hashes_lose_nothing(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(str(i), str(i), v) for i, v in enumerate(signed)], "path string, sha256 string, phash long")
    found = {(r.a, r.b, r.distance) for r in duplicates.near_hashes(prints, 11).collect()}
    want = {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 11}
    assert found == want


def test_shards_and_their_parts_lose_nothing(spark, monkeypatch):
    """Hashes go to shards of upper bits, not to each near value; a shard of very many hashes is dealt."""
    monkeypatch.setattr(duplicates, "SHARD", 64)
    monkeypatch.setattr(duplicates, "PART", 50)
    monkeypatch.setattr(duplicates, "BATCH", 100)
    rng = random.Random(5)
    # a third has few bits, so that they share shards; some are negative as signed numbers
    hashes = [rng.getrandbits(64) for _ in range(300)] + [sum(1 << b for b in rng.sample(range(64), 5)) for _ in range(300)]
    hashes = list({(h ^ 1 << rng.randrange(64) if rng.random() < 0.5 else h) - (1 << 63) for h in hashes for _ in range(2)})
    frame = spark.createDataFrame([(h,) for h in hashes + hashes[:9] + [None]], "phash long")
    want = {(min(a, b), max(a, b), d) for i, a in enumerate(hashes) for b in hashes[:i] if (d := bin((a ^ b) & (1 << 64) - 1).count("1")) <= 9}
    got = [tuple(r) for r in duplicates.near_hashes(frame, 9).collect()]
    assert len(want) > 1000 and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("seed", range(2))
def test_classes_say_what_pairs_say(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(62) for _ in range(6)]
    prints = []
    for i in range(70):
        hash_ = rng.choice(base) ^ sum(1 << b for b in rng.sample(range(60), rng.choice([0, 0, 2, 5, 7])))
        prints.append((f"p{i:02d}", f"s{hash_ % 1000}-{rng.randint(0, 2)}" if rng.random() < 0.9 else "shared", hash_ if rng.random() < 0.95 else None))
    frame = spark.createDataFrame(prints, "path string, sha256 string, phash long")
    pairs = {(r.left_path, r.right_path): r for r in duplicates.near_findings(frame).collect()}
    sha, hashes = {p: s for p, s, _ in prints}, {p: h for p, _, h in prints}
    want = {}
    for a in sha:
        for b in sha:
            if a < b and sha[a] != sha[b] and None not in (hashes[a], hashes[b]) and bin(hashes[a] ^ hashes[b]).count("1") <= 12:
                want[a, b] = bin(hashes[a] ^ hashes[b]).count("1")
    assert {k: r.hamming_distance for k, r in pairs.items()} == want
    label = brute([k for k, d in want.items() if d <= 6])
    groups = {tuple(r.paths): r for r in duplicates.near_groups(frame).collect()}
    assert sorted(groups) == sorted(tuple(sorted(p for p in label if label[p] == c)) for c in set(label.values()))
    for paths, r in groups.items():
        inside = [d for (a, b), d in want.items() if a in paths and b in paths]
        assert (r.likely_pair_count, r.maybe_pair_count) == (sum(d <= 6 for d in inside), sum(d > 6 for d in inside))
        assert r.score == pytest.approx(sum(1 - d / 64 for d in inside) / len(inside))
    rows = {r.path: r.component for r in duplicates.near_members_of_groups(frame).collect()}
    assert rows == {p: paths[0] for paths in groups for p in paths}
    members = {r.path: r.class_path for r in duplicates.near_members(frame).collect()}
    links = {(r.left_path, r.right_path): r.hamming_distance for r in duplicates.near_links(frame).collect()}
    told = {(a, b): d for a in members for b in members if a < b and sha[a] != sha[b] for d in [0 if members[a] == members[b] else links.get(tuple(sorted((members[a], members[b]))))] if d is not None}
    assert told == want
    flat = spark.range(3000).selectExpr("concat('f', id) AS path", "concat('s', id) AS sha256", "0L AS phash")
    assert duplicates.near_links(flat).count() == 2999 and duplicates.near_groups(flat).first().likely_pair_count == 3000 * 2999 // 2


def test_thresholds(spark):
    with pytest.raises(ValueError):
        DuplicateOptions(-1, 3)
    prints = spark.createDataFrame(PRINTS, "path string, sha256 string, phash long")
    assert {r.band for r in duplicates.near_findings(prints, DuplicateOptions(12, 6)).collect()} == {"Likely"}
    assert duplicates.near_groups(prints, DuplicateOptions(0, 0)).count() == 0
    assert [tuple(r) for r in spark.range(12).selectExpr("concat('near-', id + 1) AS group_id").orderBy(*duplicates.group_order()).collect()] == [(f"near-{i}",) for i in range(1, 13)]


def test_numbers(spark):
    from samphire.operators.numbering import numbered

    frame = spark.range(1000).selectExpr("(id * 37) % 1000 AS k").repartition(7)
    assert [(r.k, r.number) for r in numbered(frame, ["k"]).orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered(frame.where("false"), ["k"]).count() == 0
