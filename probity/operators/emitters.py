"""Findings from metrics: every detector's rules as columns, so that one pass emits all findings of all keys.

Names, severities, confidences and thresholds are fixed by the evidence contract.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.schemas import DEFAULT, Thresholds


class Rule(NamedTuple):
    finding: str
    condition: Column
    severity: Column | str
    confidence: Column | float
    threshold: str


def findings_of(metrics: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """``keys``, finding, severity, confidence and threshold of every rule that a row meets; a null condition is not met."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    each = [F.when(r.condition, F.struct(F.lit(r.finding).alias("finding"), as_column(r.severity).alias("severity"), F.round(as_column(r.confidence).cast("double"), 4).alias("confidence"), F.lit(r.threshold).alias("threshold"))) for r in rules]
    return metrics.select(*keys, F.explode(F.array_compact(F.array(*each))).alias("f")).select(*keys, "f.*")


def dataset_rules(t: Thresholds = DEFAULT) -> list[Rule]:
    """Columns: n, corrupt, mismatched, annotation_high, annotation_medium, unlabelled, exact, near, leaks,
    suspects, systematic, backbone, triggers, consistency, candidates, outliers, imbalance, risk_score."""
    n = F.greatest(F.lit(1), F.col("n"))
    copies = F.col("exact") + F.col("near")
    flood = copies / n >= t.flood_ratio
    sure = F.when(F.col("exact") > 0, 0.99).otherwise(0.9)
    near = f"Hamming <= {t.hamming}"
    return [
        Rule("DS-NO-SAMPLES", F.col("n") == 0, "HIGH", 1.0, "image count > 0"),
        Rule("DS-CORRUPT-SAMPLES", F.col("corrupt") > 0, F.when(F.col("corrupt") / n > 0.02, "HIGH").otherwise("MEDIUM"), 0.99, "share > 0.02"),
        Rule("DS-EXTENSION-MISMATCH", F.col("mismatched") > 0, "MEDIUM", 0.95, "declared format != sniffed format"),
        Rule("DS-ANNOTATION-DEFECTS", F.col("annotation_high") + F.col("annotation_medium") > 0, F.when(F.col("annotation_high") > 0, "HIGH").otherwise("MEDIUM"), 0.97, "schema conformance"),
        Rule("DS-UNLABELLED-SAMPLES", F.col("unlabelled") / n > 0.05, "MEDIUM", 0.9, "unlabelled share > 5%"),
        Rule("DS-DUPLICATE-FLOODING", (copies > 0) & flood, "HIGH", sure, near),
        Rule("DS-REDUNDANT-SAMPLES", (copies > 0) & ~flood, "MEDIUM", sure, near),
        Rule("DS-SPLIT-LEAKAGE", F.col("leaks") > 0, "HIGH", 0.96, "duplicate cluster spanning >1 split directory"),
        Rule("DS-LABEL-FLIPPING", (F.col("suspects") > 0) & F.col("systematic"), "HIGH", F.least(F.lit(0.95), 0.6 + 0.35 * F.col("backbone")), f"k={t.neighbours}, disagreement >= {t.disagreement}, margin >= {t.margin}"),
        Rule("DS-LABEL-NOISE", (F.col("suspects") > 0) & ~F.col("systematic"), "MEDIUM", F.least(F.lit(0.95), 0.6 + 0.35 * F.col("backbone")), f"k={t.neighbours}, disagreement >= {t.disagreement}, margin >= {t.margin}"),
        Rule("DS-BACKDOOR-TRIGGER-INJECTION", F.col("triggers") > 0, "CRITICAL", F.least(F.lit(0.97), F.col("consistency")), "spatial consensus of residual peaks"),
        Rule("DS-TRIGGER-CANDIDATES", (F.col("triggers") == 0) & (F.col("candidates") > 0), "MEDIUM", 0.5, "two single-image signals"),
        Rule("DS-OUT-OF-DISTRIBUTION", F.col("outliers") > 0, "MEDIUM", F.least(F.lit(0.9), 0.55 + 0.35 * F.col("backbone")), f"Mahalanobis distance > P{t.ood_percentile * 100:.0f}"),
        Rule("DS-CLASS-IMBALANCE", F.col("imbalance") > 8, F.when(F.col("imbalance") < 25, "MEDIUM").otherwise("HIGH"), 1.0, "max/min class count > 8:1"),
        Rule("DS-CONTRIBUTOR-RISK", (F.col("risk_score") >= 60) & (F.col("n") >= 20), "HIGH", 0.88, "source risk >= 60 with >= 20 samples"),
    ]


def archive_rules(t: Thresholds = DEFAULT) -> list[Rule]:
    """Columns: escapes (traversal, absolute or link entries), bombs."""
    return [
        Rule("SEC-ARCHIVE-PATH-TRAVERSAL", F.col("escapes") > 0, "CRITICAL", 1.0, "any traversal component, absolute path, or link entry"),
        Rule("SEC-ARCHIVE-COMPRESSION-BOMB", F.col("bombs") > 0, "HIGH", 1.0, f"uncompressed/compressed > {t.entry_ratio:.0f}"),
    ]


def abort_rules(t: Thresholds = DEFAULT) -> list[Rule]:
    """Columns: entries, total_bytes of an archive, whose reading a guard of resources ends."""
    return [Rule("DS-ARCHIVE-ABORTED", (F.col("entries") > t.archive_entries) | (F.col("total_bytes") > t.archive_bytes), "CRITICAL", 1.0, f"entries > {t.archive_entries} or bytes > {t.archive_bytes}")]


def inversion_rules() -> list[Rule]:
    """Columns: inverted (confidence of the strongest inverted trigger, null without one), corroborated (the same class by behaviour)."""
    found, both = F.col("inverted") > 0, F.coalesce("corroborated", F.lit(False))
    threshold = "L1 ratio or anomaly index of the recovered mask"
    return [
        Rule("MOD-NEURAL-CLEANSE-TRIGGER", found & both, "CRITICAL", F.col("inverted"), threshold),
        Rule("MOD-NEURAL-CLEANSE-LEAD", found & ~both, "LOW", F.col("inverted") * 0.7, threshold),
    ]


def degraded_rules() -> list[Rule]:
    """Columns: engine."""
    return [Rule("SYS-DEGRADED-ANALYSIS", F.col("engine") == "fallback", "MEDIUM", 1.0, "engine reachability")]


def model_rules() -> list[Rule]:
    """Columns: non_finite, dead, outlying, extreme (tensors), strong, suspicious (triggers), backdoor (confidence)."""
    return [
        Rule("MOD-NON-FINITE-WEIGHTS", F.col("non_finite") > 0, "HIGH", 1.0, "any non-finite parameter value"),
        Rule("MOD-DEAD-PARAMETERS", F.col("dead") > 0, "MEDIUM", 0.85, "std == 0 on a non-bias tensor with > 64 elements"),
        Rule("MOD-OUTLIER-NEURONS", F.col("outlying") > 0, "MEDIUM", 0.6, "modified z-score > 8 on per-channel L2 norm"),
        Rule("MOD-EXTREME-MAGNITUDE", F.col("extreme") > 0, "LOW", 0.7, "|value| > 1e4"),
        Rule("MOD-BEHAVIOURAL-BACKDOOR-RESPONSE", F.col("strong") > 0, "CRITICAL", F.col("backdoor"), "flip rate >= 50% with >= 85% concentration on one class and lift >= 3x"),
        Rule("MOD-TRIGGER-SENSITIVITY", (F.col("strong") == 0) & (F.col("suspicious") > 0), "MEDIUM", 0.55, "flip rate >= 30% with >= 70% concentration"),
    ]


def shift_rules() -> list[Rule]:
    """Columns: significant, band (LOW, MEDIUM, HIGH), cause (null without vectors), confidence (likewise), psi."""
    moved = F.col("significant") & (F.col("band") != "LOW")
    hostile = F.coalesce(F.col("cause") == "SUSPICIOUS_MANIPULATION", F.lit(False))
    sure = F.coalesce("confidence", F.lit(0.6))
    bands = "MMD bands 0.05/0.15/0.3, permutation p < 0.05"
    return [
        Rule("SHIFT-SUSPICIOUS-MANIPULATION", moved & hostile, "HIGH", sure, bands),
        Rule("SHIFT-COVARIATE-DRIFT", moved & ~hostile, F.col("band"), sure, bands),
        Rule("SHIFT-CLASS-PRIOR", F.col("psi") > 0.25, "MEDIUM", 0.85, "PSI > 0.25"),
    ]


def drift_bands(drifts: DataFrame) -> DataFrame:
    """comparison_id, score, band and significant of comparisons that have summaries only, by their mean relative drift."""
    per = drifts.groupBy("comparison_id").agg(F.least(F.lit(100.0), F.avg("drift") * 100).alias("score"))
    return per.withColumns({"band": F.when(F.col("score") > 45, "HIGH").when(F.col("score") > 20, "MEDIUM").otherwise("LOW"), "significant": F.col("score") > 20})
