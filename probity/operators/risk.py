"""Risk of analyses, contributors and the platform, and the decisions that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.scoring import clamp, decision
from probity.schemas import DEFAULT, DEFECT_WEIGHTS


def capped(part: Column, whole: Column, slope: float, cap: float) -> Column:
    return F.least(F.lit(cap), part / whole * slope)


def dataset_risk(counts: DataFrame) -> DataFrame:
    """Half of the capped prevalence terms and half of the findings' risk; 100 without samples.

    Columns: n, trigger, label, systematic (boolean), corrupt, redundant, ood, annotation, ratio (of
    the largest to the smallest class) and finding_risk.
    """
    n = F.col("n").cast("double")
    label = F.when(F.col("systematic"), capped(F.col("label"), n, 250.0, 25.0)).otherwise(capped(F.col("label"), n, 40.0, 8.0))
    terms = [
        capped(F.col("trigger"), n, 1500.0, 45.0), label, capped(F.col("corrupt"), n, 120.0, 15.0), capped(F.col("redundant"), n, 60.0, 15.0),
        capped(F.col("ood"), n, 80.0, 12.0), capped(F.col("annotation"), n, 40.0, 10.0), clamp((F.col("ratio") - 3) * 1.2, 0.0, 8.0),
    ]
    total = sum(terms[1:], terms[0])
    risk = F.lit(0.5) * F.least(F.lit(100.0), total) + F.lit(0.5) * F.col("finding_risk")
    return counts.withColumn("risk", F.when(F.col("n") == 0, F.lit(100.0)).otherwise(risk))


def model_risk(models: DataFrame) -> DataFrame:
    """Columns: verdict, finding_risk, backdoor, weights, structure."""
    built = F.least(F.lit(60.0), F.col("backdoor") * 85) + F.least(F.lit(20.0), F.col("weights") * 20) + F.least(F.lit(20.0), F.col("structure") * 20) + F.when(F.col("verdict") == "SUSPICIOUS", 25.0).otherwise(0.0)
    return models.withColumn("risk", F.when(F.col("verdict") == "MALICIOUS", 100.0).otherwise(F.least(F.lit(100.0), F.greatest("finding_risk", built))))


def overall_risk(analyses: DataFrame, key: str) -> DataFrame:
    """Weighted mean of the latest risk of each pillar, and trust, for every ``key``."""
    weights = {"DATASET": 0.35, "MODEL": 0.35, "INFERENCE": 0.15, "DISTRIBUTION": 0.15}
    latest = latest_per(analyses, [key, "type"], "created_at", "analysis_id")
    parts = [F.coalesce(F.max(F.when(F.col("type") == t, F.col("risk_score"))), F.lit(0.0)) * w for t, w in weights.items()]
    out = latest.groupBy(key).agg(F.round(sum(parts[1:], parts[0]), 4).alias("overall"))
    return out.withColumn("trust", F.round(F.lit(100.0) - F.col("overall"), 4))


def latest_per(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("latest_place", F.row_number().over(order)).filter("latest_place = 1").drop("latest_place")


def posture(analyses: DataFrame) -> DataFrame:
    """By owner: assets, and whether the newest run of any is incomplete (fallback engine or failed)."""
    last = latest_per(analyses, ["owner_id", "sha256"], "created_at", "analysis_id")
    gap = (F.col("engine") == "fallback") | (F.col("status") == "ANALYSIS FAILED")
    return last.groupBy("owner_id").agg(F.count("*").alias("assets"), F.count_if(gap).alias("incomplete"), F.bool_or(gap).alias("coverage_gap"))


def governance(assets: DataFrame) -> DataFrame:
    """Decision and fired rules of every asset.

    Columns: risk, malicious, failed_records, backdoor, critical_open, coverage_gap, n_evidence. Overrides
    quarantine whatever the risk; then the risk band; a gap or no evidence asks for review at least.
    """
    rules = {
        "MALICIOUS_SERIALIZATION": F.col("malicious"),
        "INFERENCE_INTEGRITY_FAILURE": F.col("failed_records") > 0,
        "BACKDOOR_CONFIRMED": F.col("backdoor"),
        "CRITICAL_FINDING": F.col("critical_open") > 0,
        "COMPOSITE_RISK": F.col("risk") >= 30,
        "COVERAGE_GAP": F.col("coverage_gap"),
        "NO_EVIDENCE": F.col("n_evidence") == 0,
    }
    override = list(rules.values())[0]
    for rule in list(rules.values())[1:4]:
        override = override | rule
    banded = decision(F.col("risk"))
    decided = F.when(override, "QUARANTINE").when(banded == "QUARANTINE", "QUARANTINE").when((banded == "REVIEW") | rules["COVERAGE_GAP"] | rules["NO_EVIDENCE"], "REVIEW").otherwise("ACCEPT")
    fired = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])), ",")
    return assets.withColumns({"decision": decided, "rules": fired})


def decided(evidence: DataFrame) -> DataFrame:
    """Decision and the rules that gave it, of an owner's or the platform's evidence.

    Columns as for ``governance``. Overrides name themselves only; else the band of the risk does, with
    coverage gap and missing evidence where they ask for review.
    """
    overrides = [
        F.when(F.col("malicious"), F.lit("MALICIOUS_SERIALIZATION")), F.when(F.col("failed_records") > 0, F.lit("INFERENCE_INTEGRITY_FAILURE")),
        F.when(F.col("backdoor"), F.lit("BACKDOOR_CONFIRMED")), F.when(F.col("critical_open") > 0, F.lit("CRITICAL_FINDING")),
    ]
    review = [
        F.when(F.col("risk") >= DEFAULT.accept_below, F.lit("COMPOSITE_RISK in [30, 70)")), F.when(F.col("coverage_gap"), F.lit("COVERAGE_GAP")), F.when(F.col("n_evidence") == 0, F.lit("NO_EVIDENCE")),
    ]
    rows = evidence.withColumns({"over": F.array_compact(F.array(*overrides)), "ask": F.array_compact(F.array(*review))})
    high = F.col("risk") >= DEFAULT.quarantine_from
    fired = F.when(F.size("over") > 0, F.col("over")).when(high, F.array(F.lit("COMPOSITE_RISK >= 70"))).when(F.size("ask") > 0, F.col("ask")).otherwise(F.array(F.lit("COMPOSITE_RISK < 30")))
    verdict = F.when((F.size("over") > 0) | high, "QUARANTINE").when(F.size("ask") > 0, "REVIEW").otherwise("ACCEPT")
    return rows.withColumns({"decision": verdict, "rules": F.array_join(fired, ",")}).drop("over", "ask")


def contributor_profile(samples: DataFrame, defects: DataFrame) -> DataFrame:
    """Counts of each kind of defect and the risk of every contributor.

    ``samples``: sample_id, contributor; ``defects``: sample_id, kind, one row each. Density weighs the
    kinds; small submissions are damped; triggers set a floor.
    """
    kinds = list(DEFECT_WEIGHTS)
    owned = samples.select(F.col("sample_id").alias("s_id"), "contributor").join(defects, F.col("s_id") == F.col("sample_id"))
    per = owned.groupBy(F.col("contributor").alias("d_contributor")).pivot("kind", kinds).agg(F.count(F.lit(1)))
    whole = samples.groupBy("contributor").agg(F.count("*").alias("n"))
    met = whole.join(per, F.col("contributor").eqNullSafe(F.col("d_contributor")), "left").na.fill(0, kinds)
    mass = sum((F.col(k) * w for k, w in DEFECT_WEIGHTS.items()), F.lit(0.0))
    base = F.lit(100.0) * (1 - F.exp(-mass / F.col("n") / 0.35)) * (0.7 + 0.3 * F.least(F.lit(1.0), F.col("n") / 50))
    floor = F.when(F.col("trigger") > 0, 70 + F.least(F.lit(25.0), 25 * F.col("trigger") / F.col("n"))).otherwise(0.0)
    total = sum((F.col(k) for k in kinds if k != "annotation"), F.lit(0))
    return met.select("contributor", "n", *kinds, total.cast("long").alias("total_defects"), F.round(F.least(F.lit(100.0), F.greatest(base, floor)), 4).alias("risk_score"))


def contributor_register(submissions: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """By name without case, inside the columns of ``scope``: sums, worst risk, submissions, last seen, and the worst submission's name and drivers.

    Columns: name, samples, defects, risk, drivers, analysis_id, archive, created_at.
    """
    key = F.lower("name")
    worst = F.max(F.struct("risk", "created_at", "analysis_id", "name", "drivers"))
    out = submissions.groupBy(*scope, key.alias("key")).agg(
        F.sum("samples").alias("samples"), F.sum("defects").alias("defects"), F.max("risk").alias("max_risk"), F.count_distinct("analysis_id").alias("submissions"),
        F.max("created_at").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("archive")), ",").alias("archives"), worst.alias("worst"),
    )
    return out.select(*scope, "key", "samples", "defects", F.round(F.col("defects") / F.col("samples"), 6).alias("density"), F.round("max_risk", 4).alias("max_risk"), "submissions", "last_seen", "archives", F.col("worst.name").alias("worst_name"), F.col("worst.drivers").alias("worst_drivers"))


def platform_statistics(analyses: DataFrame, findings: DataFrame, records: DataFrame) -> DataFrame:
    """One row: counts, latest risk of each type, compromised share of records."""
    latest = lambda t: F.round(F.max_by(F.when(F.col("type") == t, F.col("risk_score")), F.when(F.col("type") == t, F.struct("created_at", "analysis_id"))), 4)
    a = analyses.agg(F.count("*").alias("analyses"), F.count_distinct("sha256").alias("assets"), *[latest(t).alias(f"{t.lower()}_risk") for t in ("DATASET", "MODEL", "DISTRIBUTION")])
    f = findings.agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if((F.col("severity") == "CRITICAL") & F.col("acknowledged_at").isNull()).alias("critical_open"))
    bad = F.count_if(F.col("status") != "VERIFIED")
    r = records.agg(F.count("*").alias("records"), bad.alias("failed_records"), F.round(F.when(F.count("*") == 0, 0.0).otherwise(F.least(F.lit(100.0), bad / F.count("*") * 100 + F.when(bad > 0, 40.0).otherwise(0.0))), 4).alias("inference_risk"))
    one = F.lit(1).alias("row")  # three one-row frames side by side
    return a.select(one, "*").join(f.select(one, "*"), "row").join(r.select(one, "*"), "row").drop("row")
