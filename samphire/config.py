"""Options of the analyses, with the defaults that users rely on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


def _whole(name: str, value: int, least: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or least is not None and value < least:
        raise ValueError(f"{name}: a whole number" + ("" if least is None else f" of {least} or more") + f" is expected, not {value!r}")


@dataclass(frozen=True)
class MetricsOptions:
    """``top_k_values`` below 1 have mass 0; limits below 0 count as 0."""

    top_k_values: Sequence[int] = (1, 5, 10)
    target_distribution: Mapping[str, float] | None = None
    min_document_frequency_for_stop_candidate: int = 2
    max_stop_tag_candidates: int = 50
    min_cooccurrence_for_pmi: int = 2
    max_pmi_anomalies: int = 50
    community_edge_weight_threshold: int = 2
    community_preview_size: int = 5
    max_token_length: int = 64

    def __post_init__(self) -> None:
        for name in ("min_document_frequency_for_stop_candidate", "max_stop_tag_candidates", "min_cooccurrence_for_pmi", "max_pmi_anomalies", "community_edge_weight_threshold", "community_preview_size", "max_token_length"):
            _whole(name, getattr(self, name))
        for k in self.top_k_values:
            _whole("top_k_values", k)
        if any(v < 0 or v != v for v in (self.target_distribution or {}).values()):
            raise ValueError("target_distribution: weights can't be negative")


@dataclass(frozen=True)
class DuplicateOptions:
    """``list_all_pairs``: a job lists every near pair of files; else pairs of hashes and each hash's files."""

    likely_hamming_threshold: int = 6
    maybe_hamming_threshold: int = 12
    list_all_pairs: bool = True

    def __post_init__(self) -> None:
        _whole("likely_hamming_threshold", self.likely_hamming_threshold, 0)
        _whole("maybe_hamming_threshold", self.maybe_hamming_threshold, 0)


@dataclass(frozen=True)
class NormalizationRules:
    """``canonical_delimiter`` replaces each of ``delimiters``; aliases map once, not along chains."""

    canonical_delimiter: str = " "
    delimiters: Sequence[str] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)
    stop_tags: Sequence[str] = ()
