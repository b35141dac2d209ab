"""Rule files: normalization rules (JSON) and recommendation rules (JSON or YAML), read on the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from samphire.config import NormalizationRules

#: Names in the order of their numbers in rule files.
SEVERITIES = ("Info", "Warning", "Critical")
OPERATORS = ("GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Equal", "NotEqual")


@dataclass(frozen=True)
class Condition:
    signal: str
    operator: str
    value: float


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    severity: str
    conditions: tuple[Condition, ...] = ()
    likely_failure_modes: tuple[str, ...] = ()
    actions: tuple[str, ...] = ()


def _text(value: str | None, what: str) -> str:
    if value is None or not value.strip():
        raise ValueError(f"{what}: a text is expected")
    return value


def _keyed(value: Any, what: str) -> dict[str, Any]:
    if not isinstance(value, Mapping):
        raise ValueError(f"{what}: an object is expected")
    return {str(k).lower(): v for k, v in value.items()}


def _named(value: Any, names: tuple[str, ...], what: str) -> str:
    """A name in any case, or its number."""
    if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < len(names):
        return names[value]
    found = [n for n in names if isinstance(value, str) and n.lower() == value.lower()]
    if not found:
        raise ValueError(f"{what}: one of {', '.join(names)} is expected, not {value!r}")
    return found[0]


def normalization_rules(text: str) -> NormalizationRules:
    """From JSON; names of properties in any case; a blank or missing canonical delimiter is a space."""
    told = _keyed(json.loads(_text(text, "rules")), "rules")
    canonical = told.get("canonicaldelimiter")
    return NormalizationRules(canonical if canonical and canonical.strip() else " ", tuple(told.get("delimiters") or ()), dict(told.get("aliases") or {}), tuple(told.get("stoptags") or ()))


def _rules(told: Any) -> list[Rule]:
    out = []
    for item in _keyed(told, "rules").get("rules") or []:
        rule = _keyed(item, "rule")
        if not str(rule.get("id") or "").strip():
            continue
        conditions = [_keyed(c, "condition") for c in rule.get("conditions") or []]
        out.append(
            Rule(
                rule["id"],
                rule.get("description") or "",
                _named(rule.get("severity", 0), SEVERITIES, "severity"),
                tuple(Condition(c.get("signal") or "", _named(c.get("operator", 0), OPERATORS, "operator"), float(c.get("value") or 0)) for c in conditions),
                tuple(rule.get("likelyfailuremodes") or ()),
                tuple(rule.get("actions") or ()),
            )
        )
    return out


def recommendation_rules_json(text: str) -> list[Rule]:
    return _rules(json.loads(_text(text, "rules")))


def recommendation_rules_yaml(text: str) -> list[Rule]:
    import yaml

    return _rules(yaml.safe_load(_text(text, "rules")))
