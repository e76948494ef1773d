"""Queries over findings, analyses, records and logs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from probity.functions.scoring import severity_rank
from probity.operators import findings as f
from probity.operators import monitoring as m
from probity.operators import provenance as p
from probity.operators import risk as r
from probity.plans.bindings import sql, view

RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 END"
WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 25.0::DOUBLE WHEN 'HIGH' THEN 15.0::DOUBLE WHEN 'MEDIUM' THEN 8.0::DOUBLE WHEN 'LOW' THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END"
AS_OF = datetime.datetime(2024, 1, 20)
RULES = [("^SEC", "CWE", "CWE-22"), ("^SEC|BACKDOOR", "NIST", "MAP-3"), ("LABEL|BACKDOOR", "ATLAS", "AML.T0020"), ("BACKDOOR", "ATLAS", "AML.T0018")]

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = sql(oracle)
        return function

    return add


@query("tenant_findings", "SELECT finding_id, severity, round(confidence, 4) AS confidence FROM findings WHERE owner_id = 'owner3'")
def _(s, d):
    return f.owned_by(view(s, d, "findings"), "owner3").select("finding_id", "severity", F.round("confidence", 4).alias("confidence"))


@query("newest_findings", "SELECT finding_id, severity, created_at FROM findings ORDER BY created_at DESC, finding_id LIMIT 50 OFFSET 20")
def _(s, d):
    return f.newest(view(s, d, "findings").select("finding_id", "severity", "created_at"), "created_at", ["finding_id"], 50, 20)


@query("normalised_findings", "SELECT finding_id, CASE WHEN severity = 'ODD' THEN 'INFO' ELSE severity END AS severity, round(least(1.0, greatest(0.0, raw_confidence)), 4) AS confidence FROM findings")
def _(s, d):
    return f.normalised(view(s, d, "findings").select("finding_id", "severity", F.col("raw_confidence").alias("confidence")))


@query("status_from_findings", f"SELECT analysis_id, CASE WHEN min({RANK}) <= 1 THEN 'DETECTED' WHEN min({RANK}) = 2 THEN 'SUSPICIOUS' ELSE 'NOT DETECTED' END AS status, count(*) AS n_findings FROM findings GROUP BY analysis_id")
def _(s, d):
    return f.statuses(view(s, d, "findings"))


@query("top_findings", f"SELECT analysis_id, finding_id, severity, place FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {RANK} NULLS FIRST, confidence DESC, finding_id) AS place FROM findings) WHERE place <= 3")
def _(s, d):
    return f.ranked(view(s, d, "findings"), "analysis_id", 3, ["finding_id"]).select("analysis_id", "finding_id", "severity", "place")


@query("findings_risk", f"SELECT analysis_id, round(100 * (1 - exp(-sum({WEIGHT} * least(1.0, greatest(0.0, confidence))) / 45)), 4) AS risk FROM findings GROUP BY analysis_id")
def _(s, d):
    return f.findings_risk(view(s, d, "findings"))


@query("noisy_or", "SELECT analysis_id, round(1 - product(1 - least(1.0, greatest(0.0, confidence))), 6) AS fused FROM findings GROUP BY analysis_id")
def _(s, d):
    return f.noisy_or(view(s, d, "findings"), "analysis_id", "confidence").withColumn("fused", F.round("fused", 6))


@query("acknowledged_findings", "SELECT finding_id, severity, coalesce(acknowledged_at, first_ack) AS acknowledged_at FROM findings LEFT JOIN (SELECT finding_id AS k, min(created_at + INTERVAL 2 DAY) AS first_ack FROM findings WHERE analysis_id % 3 = 0 GROUP BY finding_id) ON finding_id = k")
def _(s, d):
    rows = view(s, d, "findings").select("finding_id", "severity", "acknowledged_at", "created_at", "analysis_id")
    acks = rows.filter("analysis_id % 3 = 0").select("finding_id", (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("acked_at"))
    return f.acknowledged(rows, acks).select("finding_id", "severity", "acknowledged_at")


@query("severity_histogram", f"SELECT severity, count(*) AS n, coalesce({RANK}, 5) AS place FROM findings GROUP BY severity")
def _(s, d):
    return f.severity_histogram(view(s, d, "findings"))


@query("risk_trend", "SELECT sha256, analysis_id, row_number() OVER w AS ordinal, round(risk_score, 4) AS risk_score, round(risk_score - lag(risk_score) OVER w, 4) AS change FROM analyses WINDOW w AS (PARTITION BY sha256 ORDER BY created_at, analysis_id)")
def _(s, d):
    return f.risk_trend(view(s, d, "analyses"), "sha256").withColumns({"risk_score": F.round("risk_score", 4), "change": F.round("change", 4)})


@query("analyses_with_counts", "SELECT analysis_id, type, round(risk_score, 4) AS risk_score, (SELECT count(*) FROM findings f WHERE f.analysis_id = analyses.analysis_id) AS n_findings, (SELECT count(*) FROM findings f WHERE f.analysis_id = analyses.analysis_id AND severity = 'CRITICAL') AS n_critical FROM analyses")
def _(s, d):
    return f.with_counts(view(s, d, "analyses"), view(s, d, "findings")).withColumn("risk_score", F.round("risk_score", 4))


@query(
    "control_mapping",
    "WITH rules(pattern, framework, control) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES) + ") SELECT analysis_id, framework, string_agg(DISTINCT control, ',' ORDER BY control) AS controls FROM findings JOIN rules ON regexp_matches(category, pattern) GROUP BY analysis_id, framework",
)
def _(s, d):
    return f.mapped_controls(view(s, d, "findings"), RULES, "analysis_id")


@query("threat_feed", f"SELECT finding_id, severity, created_at FROM findings WHERE {RANK} <= 1 ORDER BY created_at DESC, finding_id LIMIT 200")
def _(s, d):
    rows = view(s, d, "findings").filter(severity_rank(F.col("severity")) <= 1).select("finding_id", "severity", "created_at")
    return f.newest(rows, "created_at", ["finding_id"], 200)


LATEST = "SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY created_at DESC, analysis_id DESC) AS place FROM analyses"


@query("overall_risk", f"SELECT owner_id, round(overall, 4) AS overall, round(100 - round(overall, 4), 4) AS trust FROM (SELECT owner_id, sum(CASE type WHEN 'DATASET' THEN 0.35::DOUBLE WHEN 'MODEL' THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END * risk_score) AS overall FROM ({LATEST.format(keys='owner_id, type')}) WHERE place = 1 GROUP BY owner_id)")
def _(s, d):
    return r.overall_risk(view(s, d, "analyses"), "owner_id")


@query("latest_posture", f"SELECT owner_id, count(*) AS assets, count(*) FILTER (gap) AS incomplete, bool_or(gap) AS coverage_gap FROM (SELECT *, engine = 'fallback' OR status = 'ANALYSIS FAILED' AS gap FROM ({LATEST.format(keys='owner_id, sha256')}) WHERE place = 1) GROUP BY owner_id")
def _(s, d):
    return r.posture(view(s, d, "analyses"))


@query("platform_statistics", """WITH a AS (SELECT count(*) AS analyses, count(DISTINCT sha256) AS assets FROM analyses),
 t AS (SELECT max(CASE WHEN type = 'DATASET' THEN risk END) AS dataset_risk, max(CASE WHEN type = 'MODEL' THEN risk END) AS model_risk, max(CASE WHEN type = 'DISTRIBUTION' THEN risk END) AS distribution_risk FROM (SELECT type, round(risk_score, 4) AS risk, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, analysis_id DESC) AS place FROM analyses) WHERE place = 1),
 f AS (SELECT count(*) AS findings, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'CRITICAL' AND acknowledged_at IS NULL) AS critical_open FROM findings),
 r AS (SELECT count(*) AS records, count(*) FILTER (status <> 'VERIFIED') AS failed_records, round(least(100.0, count(*) FILTER (status <> 'VERIFIED') * 100.0 / count(*) + 40), 4)::DOUBLE AS inference_risk FROM records) SELECT * FROM a, t, f, r""")
def _(s, d):
    return r.platform_statistics(view(s, d, "analyses"), view(s, d, "findings"), view(s, d, "records"))


@query("contributor_register", """SELECT lower(name) AS key, sum(samples)::BIGINT AS samples, sum(defects)::BIGINT AS defects, round(sum(defects)::DOUBLE / sum(samples)::DOUBLE, 6) AS density, round(max(risk), 4) AS max_risk, count(DISTINCT analysis_id) AS submissions, max(created_at) AS last_seen,
 string_agg(DISTINCT archive, ',' ORDER BY archive) AS archives, max(row(risk, created_at, analysis_id, name, drivers))[4] AS worst_name, max(row(risk, created_at, analysis_id, name, drivers))[5] AS worst_drivers FROM submissions GROUP BY lower(name)""")
def _(s, d):
    return r.contributor_register(view(s, d, "submissions"))


GOVERNANCE = """WITH p AS (SELECT analysis_id AS f_id, count(*) AS n_evidence, count(*) FILTER (severity = 'CRITICAL' AND acknowledged_at IS NULL) AS critical_open, count(*) FILTER (category = 'MOD-BACKDOOR') AS n_backdoor FROM findings GROUP BY analysis_id),
 x AS (SELECT analysis_id, risk_score AS risk, analysis_id % 97 = 0 AS malicious, status = 'ANALYSIS FAILED' AS failed, coalesce(n_backdoor, 0) >= 4 AS backdoor, coalesce(critical_open, 0) > 0 AS critical, engine = 'fallback' AS gap, coalesce(n_evidence, 0) = 0 AS nothing FROM analyses LEFT JOIN p ON analysis_id = f_id)
 SELECT analysis_id, CASE WHEN malicious OR failed OR backdoor OR critical OR risk >= 70 THEN 'QUARANTINE' WHEN risk >= 30 OR gap OR nothing THEN 'REVIEW' ELSE 'ACCEPT' END AS decision,
 concat_ws(',', CASE WHEN malicious THEN 'MALICIOUS_SERIALIZATION' END, CASE WHEN failed THEN 'INFERENCE_INTEGRITY_FAILURE' END, CASE WHEN backdoor THEN 'BACKDOOR_CONFIRMED' END, CASE WHEN critical THEN 'CRITICAL_FINDING' END, CASE WHEN risk >= 30 THEN 'COMPOSITE_RISK' END, CASE WHEN gap THEN 'COVERAGE_GAP' END, CASE WHEN nothing THEN 'NO_EVIDENCE' END) AS rules FROM x"""


def asset_evidence(s, d):
    """One row an analysis with what the decision rules read."""
    a, fi = view(s, d, "analyses"), view(s, d, "findings")
    per = fi.groupBy(F.col("analysis_id").alias("f_id")).agg(F.count("*").alias("n_evidence"), F.count_if((F.col("severity") == "CRITICAL") & F.col("acknowledged_at").isNull()).alias("critical_open"), F.count_if(F.col("category") == "MOD-BACKDOOR").alias("n_backdoor"))
    met = a.join(per, F.col("analysis_id") == F.col("f_id"), "left").na.fill(0, ["n_evidence", "critical_open", "n_backdoor"])
    return met.select("analysis_id", F.col("risk_score").alias("risk"), (F.col("analysis_id") % 97 == 0).alias("malicious"), (F.col("status") == "ANALYSIS FAILED").cast("int").alias("failed_records"), (F.col("n_backdoor") >= 4).alias("backdoor"), "critical_open", (F.col("engine") == "fallback").alias("coverage_gap"), "n_evidence")


@query("governance", GOVERNANCE)
def _(s, d):
    return r.governance(asset_evidence(s, d)).select("analysis_id", "decision", "rules")


@query("demo_purge", "SELECT is_demo, count(*) AS n, count(DISTINCT sha256) AS assets FROM analyses GROUP BY is_demo")
def _(s, d):
    return view(s, d, "analyses").groupBy("is_demo").agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("assets"))


@query("latest_rows", f"SELECT sha256, analysis_id, status FROM ({LATEST.format(keys='sha256')}) WHERE place = 1")
def _(s, d):
    return r.latest_per(view(s, d, "analyses"), ["sha256"], "created_at", "analysis_id").select("sha256", "analysis_id", "status")


@query("sensor_windows", """WITH c AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, identifier, count(*) AS n, count(*) FILTER (failed) AS failed FROM attempts GROUP BY ALL)
 SELECT window_start, sum(n)::BIGINT AS events, sum(failed)::BIGINT AS failures, max(failed) AS worst, CASE WHEN max(failed) >= 5 THEN 'HIGH' WHEN sum(failed) > 0 THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM c GROUP BY window_start""")
def _(s, d):
    return m.sensor_counts(view(s, d, "attempts")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("lockout", "WITH x AS (SELECT identifier, count(*) AS failures, max(attempted_at) AS last_failure FROM attempts WHERE NOT successful AND attempted_at > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND attempted_at <= TIMESTAMP '2024-01-20' GROUP BY identifier HAVING count(*) >= 5) SELECT identifier, failures, last_failure, CAST(least(1800, 30 * 2 ** (failures - 5)) AS INTEGER) AS lock_seconds, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(last_failure) < CAST(least(1800, 30 * 2 ** (failures - 5)) AS INTEGER) * 1000000 AS locked FROM x")
def _(s, d):
    return m.lockouts(view(s, d, "attempts"), F.lit(AS_OF).cast("timestamp_ntz"), 7 * 24 * 60)


@query("latest_observation", "SELECT sensor, max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(signal, event_id) AS signal FROM observations GROUP BY sensor")
def _(s, d):
    return m.latest_observation(view(s, d, "observations"), "sensor", "event_id", ["ts", "signal"])


@query("ewma_baseline", """WITH RECURSIVE o AS (SELECT sensor, date_trunc('hour', ts) AS "at", count(*)::DOUBLE AS signal, bool_or(hard) AS hard FROM observations GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY "at") - 1 AS n FROM o),
 e AS (SELECT sensor, "at", signal, hard, n, 0.0::DOUBLE AS z, signal AS mean, 0.0::DOUBLE AS var FROM k WHERE n = 0 UNION ALL
  SELECT k.sensor, k."at", k.signal, k.hard, k.n, CASE WHEN k.n >= 8 THEN (k.signal - e.mean) / greatest(sqrt(e.var), 1.0::DOUBLE) ELSE 0.0::DOUBLE END, (1 - 0.2::DOUBLE) * e.mean + 0.2::DOUBLE * k.signal, (1 - 0.2::DOUBLE) * e.var + 0.2::DOUBLE * (k.signal - e.mean) * (k.signal - e.mean) FROM e JOIN k ON k.sensor = e.sensor AND k.n = e.n + 1)
 SELECT sensor, "at", signal, round(z, 6) AS z, round(mean, 6) AS mean, round(var, 6) AS var, CASE WHEN hard THEN 'ALERT' WHEN n < 8 THEN 'CALIBRATING' WHEN z >= 4 THEN 'ALERT' WHEN z >= 2 THEN 'ELEVATED' ELSE 'NOMINAL' END AS status FROM e""")
def _(s, d):
    hourly = view(s, d, "observations").groupBy("sensor", F.date_trunc("hour", "ts").alias("at")).agg(F.count("*").cast("double").alias("signal"), F.bool_or("hard").alias("hard"))
    return m.baselines(hourly, "sensor").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("sessions", """WITH x AS (SELECT identifier, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM attempts WINDOW w AS (PARTITION BY identifier ORDER BY ts)), y AS (SELECT *, sum(opens) OVER (PARTITION BY identifier ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
 SELECT identifier, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM y GROUP BY identifier, k""")
def _(s, d):
    return m.sessions(view(s, d, "attempts"), "identifier", "6 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("retained_log", "SELECT record_id, ts FROM records ORDER BY ts DESC, record_id LIMIT 2000")
def _(s, d):
    return m.retained(view(s, d, "records").select("record_id", "ts"), "ts", ["record_id"], 2000)


@query("replay_verdicts", """WITH c AS (SELECT *, first_value(record_id) OVER w AS f_id, first_value(record_hash) OVER w AS f_hash FROM records WINDOW w AS (PARTITION BY nonce ORDER BY ts, record_id)),
 n AS (SELECT *, CASE WHEN record_id <> f_id AND record_hash = f_hash THEN 'REPLAY' WHEN record_id <> f_id THEN 'NONCE_REUSE' END AS nv FROM c),
 b AS (SELECT input_hash, model_hash, arg_min(prediction, row(ts, record_id)) AS first FROM n WHERE nv IS NULL GROUP BY ALL)
 SELECT record_id, CASE WHEN nv IS NOT NULL THEN nv WHEN prediction <> first THEN 'SUBSTITUTION' WHEN ts IS NULL OR abs(epoch_us(received_at) - epoch_us(ts)) > 86400000000 THEN 'STALE' ELSE 'OK' END AS verdict FROM n LEFT JOIN b USING (input_hash, model_hash)""")
def _(s, d):
    return p.replay_verdicts(view(s, d, "records"))


@query("link_map", "SELECT conv_id, sequence, lag(current_hash) OVER w IS NULL OR lag(current_hash) OVER w IS NOT DISTINCT FROM previous_hash AS linked FROM chain WINDOW w AS (PARTITION BY conv_id ORDER BY sequence)")
def _(s, d):
    return p.link_map(view(s, d, "chain"), "conv_id")


@query("audit_chain", """WITH j AS (SELECT c.*, p.current_hash AS p_hash, p.sequence AS p_seq FROM chain c LEFT JOIN chain p ON c.conv_id = p.conv_id AND c.sequence = p.sequence + 1),
 v AS (SELECT *, CASE WHEN NOT coalesce(regexp_full_match(current_hash, '[0-9a-f]{64}'), FALSE) THEN 'MALFORMED_HASH' WHEN sequence < 1 OR (sequence > 1 AND p_seq IS NULL) THEN 'SEQUENCE_GAP' WHEN sequence > 1 AND previous_hash IS DISTINCT FROM p_hash THEN 'BROKEN_LINK' WHEN sha256(concat(coalesce(previous_hash, ''), coalesce(payload, ''))) <> current_hash THEN 'DIGEST_MISMATCH' WHEN NOT signature_valid THEN 'BAD_SIGNATURE' END AS reason FROM j),
 x AS (SELECT conv_id, count(*) AS blocks, count(*) FILTER (signature_valid) AS signed, min(CASE WHEN reason IS NOT NULL THEN sequence END) AS broken_at, arg_min(reason, sequence) FILTER (reason IS NOT NULL) AS reason FROM v GROUP BY conv_id)
 SELECT conv_id, blocks, signed, broken_at, reason, CASE WHEN broken_at IS NULL THEN blocks ELSE broken_at - 1 END AS verified FROM x""")
def _(s, d):
    return p.verified_chain(view(s, d, "chain"), "conv_id")
