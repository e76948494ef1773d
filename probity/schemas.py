"""Thresholds and enumerations that operators share. Values are fixed by the methods they belong to."""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
SEVERITY_WEIGHTS = {"CRITICAL": 25.0, "HIGH": 15.0, "MEDIUM": 8.0, "LOW": 3.0, "INFO": 0.0}
ASSET_TYPES = ("DATASET", "MODEL", "INFERENCE", "DISTRIBUTION")
DEFECT_WEIGHTS = {"trigger": 5.0, "label": 3.0, "corrupt": 1.5, "near": 1.0, "exact": 1.0, "ood": 0.75, "annotation": 0.5}


@dataclass(frozen=True)
class Thresholds:
    """Every number that a finding names as its threshold."""

    hamming: int = 5
    dhash: int = 8
    cosine: float = 0.98
    flood_ratio: float = 0.02
    neighbours: int = 15
    disagreement: float = 0.85
    margin: float = 0.40
    ood_percentile: float = 0.99
    ood_min_class: int = 12
    ks_alpha: float = 0.01
    accept_below: float = 30.0
    quarantine_from: float = 70.0
    entry_depth: int = 24
    entry_length: int = 512
    entry_bytes: int = 256 << 20
    entry_ratio: float = 200.0
    archive_entries: int = 200_000
    archive_bytes: int = 2 << 30
    ewma_alpha: float = 0.2
    ewma_warm: int = 8


DEFAULT = Thresholds()
