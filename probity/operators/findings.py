"""Lists, scores and summaries of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.scoring import clamp, saturating, severity_rank, severity_weight, status_from_rank
from probity.schemas import SEVERITIES


def owned_by(rows: DataFrame, owner: str) -> DataFrame:
    """Rows of one owner; rows without owner belong to nobody."""
    return rows.filter(F.col("owner_id") == owner)


def listed(findings: DataFrame, limit: int = 100, offset: int = 0, severity: str | None = None, owner: str | None = None) -> DataFrame:
    """A page of findings, newest first (ties by finding_id), of one severity and one owner if they are named."""
    for column, value in (("severity", severity), ("owner_id", owner)):
        if value:
            findings = findings.filter(F.col(column) == value)
    return newest(findings, "created_at", ["finding_id"], limit, offset)


def newest(rows: DataFrame, time: str, ties: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, newest first."""
    return rows.orderBy(F.desc(time), *ties).offset(offset).limit(limit)


def normalised(findings: DataFrame) -> DataFrame:
    """Unknown severities become INFO; confidence is clamped to [0, 1] and rounded to 4 places."""
    known = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("INFO")
    return findings.withColumns({"severity": known, "confidence": F.round(clamp(F.col("confidence")), 4)})


def ranked(findings: DataFrame, key: str, n: int, ties: list[str]) -> DataFrame:
    """The ``n`` worst findings of each ``key``: by severity, then confidence, then ``ties``."""
    return placed(findings, key, ties).filter(F.col("place") <= n)


def placed(findings: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """``findings`` with place, the rank of ``ranked`` within their ``key``."""
    order = Window.partitionBy(key).orderBy(severity_rank(F.col("severity")), F.desc("confidence"), *ties)
    return findings.withColumn("place", F.row_number().over(order))


def statuses(findings: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Status of each ``key`` by its worst finding."""
    worst = F.min(severity_rank(F.col("severity")))
    return findings.groupBy(key).agg(status_from_rank(worst).alias("status"), F.count("*").alias("n_findings"))


def findings_risk(findings: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Saturating risk of each ``key``: mass is severity weight times clamped confidence."""
    mass = F.sum(severity_weight(F.col("severity")) * clamp(F.col("confidence")))
    return findings.groupBy(key).agg(F.round(saturating(mass), 4).alias("risk"))


def noisy_or(rows: DataFrame, key: str, confidence: str) -> DataFrame:
    """1 - product(1 - c) of each ``key``."""
    return rows.groupBy(key).agg((F.lit(1.0) - F.product(F.lit(1.0) - clamp(F.col(confidence)))).alias("fused"))


def acknowledged(findings: DataFrame, acks: DataFrame, key: str = "finding_id") -> DataFrame:
    """First acknowledgement of each finding; one that has a time keeps it, so repeats change nothing."""
    first = acks.groupBy(F.col(key).alias("ack_key")).agg(F.min("acked_at").alias("first_ack"))
    met = findings.join(first, F.col(key) == F.col("ack_key"), "left")
    return met.withColumn("acknowledged_at", F.coalesce("acknowledged_at", "first_ack")).drop("ack_key", "first_ack")


def severity_histogram(findings: DataFrame) -> DataFrame:
    """Count of each severity with its rank, unknown ones last."""
    return findings.groupBy("severity").agg(F.count("*").alias("n")).withColumn("place", F.coalesce(severity_rank(F.col("severity")), F.lit(len(SEVERITIES))))


def risk_trend(analyses: DataFrame, key: str) -> DataFrame:
    """Ordinal of each analysis of a ``key``, oldest first, with its risk and the change since the last."""
    order = Window.partitionBy(key).orderBy("created_at", "analysis_id")
    return analyses.select(key, "analysis_id", F.row_number().over(order).alias("ordinal"), "risk_score", (F.col("risk_score") - F.lag("risk_score").over(order)).alias("change"))


def with_counts(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """Analyses with counts of all and of critical findings."""
    per = findings.groupBy(F.col("analysis_id").alias("f_id")).agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return analyses.join(per, F.col("analysis_id") == F.col("f_id"), "left").select("analysis_id", "type", "risk_score", zero("n_findings"), zero("n_critical"))


def mapped_controls(findings: DataFrame, rules: list[tuple[str, str, str]], key: str) -> DataFrame:
    """Controls of each ``key``: ``rules`` are (pattern, framework, control), met by category.

    The rules are a few constants in the plan; a category meets every rule whose pattern it holds.
    """
    hits = F.array_compact(F.array(*[F.when(F.col("category").rlike(p), F.struct(F.lit(fw).alias("framework"), F.lit(c).alias("control"))) for p, fw, c in rules]))
    each = findings.select(key, F.explode(hits).alias("rule")).select(key, "rule.*").distinct()
    return each.groupBy(key, "framework").agg(F.array_join(F.sort_array(F.collect_set("control")), ",").alias("controls"))
