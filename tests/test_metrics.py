import math
import random
from collections import Counter
from itertools import combinations

import pytest

from samphire.config import MetricsOptions
from samphire.operators import frequency, metrics
from samphire.plans.report import metrics_report
from samphire.sources import sinks

SAMPLES = [(0, ["cat", "cute", "blue"]), (1, ["cat", "cute", "blue"]), (2, ["dog", "cute", "long_token_overflow"]), (3, ["dog", "calm", "blue"])]
SCHEMA = "sample_id long, tags array<string>"


@pytest.fixture(scope="module")
def report(spark):
    options = MetricsOptions(top_k_values=(3, 1, 2, 2), target_distribution={"cat": 0.5, "dog": 0.5}, max_token_length=8)
    groups = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, "b")], "sample_id long, group_key string")
    return metrics_report(spark.createDataFrame(SAMPLES, SCHEMA), options, groups).first()


def test_core_values(report):
    assert (report.sample_count, report.token_count, report.unique_tag_count) == (4, 12, 6)
    assert report.entropy == pytest.approx(1.704551445267297, abs=1e-12)
    assert report.effective_tag_count == pytest.approx(5.49891854799441, abs=1e-9)
    assert report.gini == pytest.approx(2 / 9, abs=1e-12)
    assert report.hhi == pytest.approx(0.194444444444, abs=1e-11)
    assert report.top_k_mass == pytest.approx({1: 0.25, 2: 0.5, 3: 2 / 3})
    assert report.jensen_shannon_divergence_to_target == pytest.approx(0.459147917027, abs=1e-11)
    assert report.token_length_overflow_rate == pytest.approx(1 / 12)


def test_lists(report):
    assert [(s.tag, s.document_frequency) for s in report.stop_tag_candidates] == [("blue", 3), ("cute", 3), ("cat", 2), ("dog", 2)]
    assert [round(s.inverse_document_frequency, 12) for s in report.stop_tag_candidates] == [1.223143551314, 1.223143551314, 1.510825623766, 1.510825623766]
    assert [(p.left_tag, p.right_tag, p.cooccurrence_count, round(p.pmi, 12)) for p in report.pmi_anomaly_cooccurrences] == [
        ("blue", "cat", 2, 0.415037499279), ("cat", "cute", 2, 0.415037499279), ("blue", "cute", 2, -0.169925001442)
    ]
    assert (report.community_hint.community_count, round(report.community_hint.modularity_hint, 12)) == (1, 0.333333333333)
    assert [(c.preview_tags, c["size"]) for c in report.community_hint.communities] == [(["blue", "cat", "cute"], 3)]


def test_near_duplicate_rate(report, spark):
    assert (report.near_duplicate_rate_hook.rate, report.near_duplicate_rate_hook.note) == (0.5, "Computed from provided grouping.")
    groups = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, "b"), (4, " "), (5, " ")], "sample_id long, group_key string")
    row = metrics.near_duplicate_rate(groups).first()
    assert (row.rate, row.redundant_copy_rate) == pytest.approx((2 / 6, 1 / 6))


def test_defaults_and_outputs(spark, tmp_path):
    row = metrics_report(spark.createDataFrame([(0, ["cat", "cute"]), (1, ["dog"])], SCHEMA)).first()
    assert row.entropy == pytest.approx(math.log(3)) and row.gini == pytest.approx(0) and row.hhi == pytest.approx(1 / 3)
    assert row.top_k_mass == pytest.approx({1: 1 / 3, 5: 1.0, 10: 1.0})
    assert row.jensen_shannon_divergence_to_target is None and row.stop_tag_candidates == [] and row.pmi_anomaly_cooccurrences == []
    assert row.community_hint.community_count == 0 and row.near_duplicate_rate_hook.rate is None
    sinks.write_report(row, str(tmp_path / "r/metrics.json"), str(tmp_path / "r/metrics.md"))
    told, shown = (tmp_path / "r/metrics.json").read_bytes(), (tmp_path / "r/metrics.md").read_text("utf-8-sig")
    assert told.startswith(b"\xef\xbb\xbf") and b'"tokenLengthOverflowRate"' in told and b'"entropy"' in told
    for part in ("# Tag Health Metrics Summary", "M1 Entropy", "### M11 Token-length overflow rate", "- none", "n/a"):
        assert part in shown


def test_no_samples(spark):
    row = metrics_report(spark.createDataFrame([], SCHEMA)).first()
    assert (row.sample_count, row.entropy, row.effective_tag_count, row.gini, row.hhi) == (0, 0, 1, 0, 0)
    assert set(row.top_k_mass.values()) == {0.0} and row.near_duplicate_rate_hook.rate == 0.0 and row.near_duplicate_rate_hook.note == "No samples."
    row = metrics_report(spark.createDataFrame([], SCHEMA), MetricsOptions(target_distribution={"a": 1.0})).first()
    assert row.jensen_shannon_divergence_to_target == pytest.approx(0.5)


def test_null_samples_and_repeats(spark):
    samples = spark.createDataFrame([(0, None), (1, ["a", "a", "b"]), (2, [])], SCHEMA)
    assert frequency.sample_counts(samples).first().asDict() == {"sample_count": 3, "token_count": 3}
    assert {r.tag: r.n for r in frequency.term_frequency(samples).collect()} == {"a": 2, "b": 1}
    assert {r.tag: r.df for r in frequency.document_frequency(samples).collect()} == {"a": 1, "b": 1}
    assert [tuple(r) for r in frequency.pair_counts(samples).collect()] == [("a", "b", 1)]


def test_options_are_checked():
    for bad in ({"target_distribution": {"a": -1.0}}, {"max_token_length": 1.5}, {"top_k_values": ["1"]}):
        with pytest.raises(ValueError):
            MetricsOptions(**bad)


def test_gini_formula(spark):
    import random

    rng = random.Random(4)
    for _ in range(5):
        n = [rng.randint(1, 6) for _ in range(rng.randint(1, 40))]
        total, running, area = sum(n), 0, 0
        for v in sorted(n):
            running += v
            area += running / total
        found = metrics.gini(spark.createDataFrame([(str(i), v) for i, v in enumerate(n)], "tag string, n long")).first().gini
        assert found == pytest.approx((len(n) + 1 - 2 * area) / len(n), abs=1e-12)


def test_pairs_are_counted_by_row(spark):
    rows = [(1, ["a", "b"]), (1, ["c", "d"]), (2, ["b", "a", "a"]), (2, ["c", "d"]), (None, ["a", "b"]), (None, ["a", "b"]), (None, None), (3, [None, "a"]), (4, [])]
    samples = spark.createDataFrame(rows, "sample_id int, tags array<string>")
    for least in (1, 2, 3, 5):
        want = {k: n for k, n in {("a", "b"): 4, ("c", "d"): 2}.items() if n >= least}
        assert {(r.left, r.right): r.c for r in frequency.pair_counts(samples, min_support=least).collect()} == want


def test_short_samples_make_pairs_where_they_lie(spark, monkeypatch):
    """Only tags of samples of more than SHORT tags are looked up; both kinds count together."""
    monkeypatch.setattr(frequency, "SHORT", 4)
    rng = random.Random(3)
    rows = [(i % 3 or None, rng.choices([*"abcdefghijklmnop", None], k=rng.randint(0, 9))) for i in range(120)]
    samples = spark.createDataFrame([*rows, *rows[:20], (1, None)], "sample_id int, tags array<string>")
    all_rows = [*rows, *rows[:20]]
    want = Counter(p for _, tags in all_rows for p in combinations(sorted({t for t in tags if t is not None}), 2))
    for least in (1, 2, 7):
        assert {(r.left, r.right): r.c for r in frequency.pair_counts(samples, min_support=least).collect()} == {p: c for p, c in want.items() if c >= least}
