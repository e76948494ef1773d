"""Severities, decisions and small formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probity.schemas import DEFAULT, SEVERITIES, SEVERITY_WEIGHTS, Thresholds


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL to 4 for INFO; null for anything else."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(SEVERITIES):
        out = F.when(severity == name, F.lit(k)).otherwise(out)
    return out


def severity_weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, F.lit(weight)).otherwise(out)
    return out


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def saturating(mass: Column, scale: float = 45.0) -> Column:
    """100 (1 - e^(-mass / scale))."""
    return F.lit(100.0) * (F.lit(1.0) - F.exp(-mass / scale))


def decision(risk: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(risk >= t.quarantine_from, "QUARANTINE").when(risk >= t.accept_below, "REVIEW").otherwise("ACCEPT")


def status_from_rank(worst: Column) -> Column:
    """Of the least severity rank among findings: DETECTED, SUSPICIOUS or NOT DETECTED."""
    return F.when(worst <= 1, "DETECTED").when(worst == 2, "SUSPICIOUS").otherwise("NOT DETECTED")
