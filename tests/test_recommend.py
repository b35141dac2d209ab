import json

import pytest

from samphire.operators import recommend
from samphire.sources import rules as files

SIGNALS = [("sampleCount", 100.0), ("topKMass:1", 0.4), ("topKMass:5", 0.75), ("jsdToTarget", 0.2), ("nearDuplicateRate", 0.61), ("tokenLengthOverflowRate", 0.011)]


def evaluate(spark, rules):
    signals = spark.createDataFrame(SIGNALS, "signal string, value double")
    return recommend.evaluate(signals, recommend.rules_frame(spark, rules)).collect()


def test_json_rules(spark):
    rules = files.recommendation_rules_json(json.dumps({"RULES": [
        {"id": "long-words", "description": "d", "severity": "warning", "conditions": [{"signal": "tokenLengthOverflowRate", "operator": 0, "value": 0.008}], "actions": ["x"]},
        {"Id": "copies", "severity": 2, "conditions": [{"signal": "nearDuplicateRate", "operator": "GreaterThan", "value": 0.57}, {"signal": "topKMass: +1", "operator": "greaterthanorequal", "value": 0.3}]},
        {"id": " ", "severity": 0},
    ]}))
    found = evaluate(spark, rules)
    assert [(r.rule_id, r.severity) for r in found] == [("copies", "Critical"), ("long-words", "Warning")]
    assert [c.explanation for c in found[0].conditions] == ["Condition matched."] * 2 and found[0].conditions[1].actual_value == 0.4
    assert found[1].actions == ["x"] and found[1].likely_failure_modes == []


def test_yaml_rules(spark):
    rules = files.recommendation_rules_yaml("rules:\n- id: off-target\n  severity: Warning\n  extra: 1\n  conditions:\n  - {signal: jsdToTarget, operator: GreaterThanOrEqual, value: 0.1}\n")
    assert [r.rule_id for r in evaluate(spark, rules)] == ["off-target"]


def test_unknown_signals_and_operators(spark):
    condition = lambda s, o, v: (files.Condition(s, o, v),)
    rules = [
        files.Rule("bad", "", "Info", condition("moonPhase", "GreaterThan", 0.1)),
        files.Rule("k7", "", "Info", condition("topKMass:7", "LessThan", 9.0)),
        files.Rule("none", "", "Info"),
        files.Rule("equal", "", "Info", condition("jsdToTarget", "Equal", 0.2 + 1e-13)),
        files.Rule("unequal", "", "Info", condition("jsdToTarget", "NotEqual", 0.2 + 1e-13)),
        files.Rule("less", "", "Info", condition("sampleCount", "LessThanOrEqual", 100.0)),
    ]
    assert [r.rule_id for r in evaluate(spark, rules)] == ["equal", "less", "none"]
    with pytest.raises(ValueError):
        files.recommendation_rules_json('{"rules":[{"id":"a","severity":"Loud"}]}')
    with pytest.raises(ValueError):
        files.recommendation_rules_json("  ")
