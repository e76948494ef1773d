"""Queries of emitted findings, coverage, passports, reports, sensors and the causes of shifts."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from probity.functions.scoring import severity_rank
from probity.operators import annotations as a
from probity.operators import coverage as cov
from probity.operators import emitters as em
from probity.operators import findings as f
from probity.operators import models as mod
from probity.operators import monitoring as m
from probity.operators import pixels as px
from probity.operators import triggers as tg
from probity.operators import provenance as prov
from probity.operators import reports as rep
from probity.operators import risk as r
from probity.operators import shift as sh
from probity.plans import corpus, evidence
from probity.plans.bindings import sql, view
from probity.sources import manifest as man

QUERIES, ORACLE = {}, {}
AS_OF = datetime.datetime(2024, 1, 20)


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = sql(oracle)
        return function

    return add


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


RESPONSES = """WITH b AS (SELECT *, count(*) OVER (PARTITION BY trigger_name) AS n FROM responses),
 h AS (SELECT trigger_name, sum(-p * log2(p)) AS entropy, count(*) AS classes FROM (SELECT trigger_name, clean_pred, count(*)::DOUBLE / any_value(n) AS p FROM b GROUP BY ALL) GROUP BY trigger_name),
 x AS (SELECT trigger_name, any_value(n) AS n, count(*) FILTER (pred <> clean_pred) AS flips FROM b GROUP BY trigger_name),
 t AS (SELECT trigger_name, pred AS target, count(*) FILTER (pred <> clean_pred) AS hits, count(*) AS post FROM b GROUP BY trigger_name, pred QUALIFY row_number() OVER (PARTITION BY trigger_name ORDER BY count(*) FILTER (pred <> clean_pred) DESC, pred) = 1),
 y AS (SELECT x.trigger_name, n, flips, CASE WHEN hits > 0 THEN target END AS target, flips::DOUBLE / n AS rate, CASE WHEN flips > 0 THEN hits::DOUBLE / flips ELSE 0 END AS conc, entropy, classes,
  CASE WHEN hits > 0 THEN post::DOUBLE / n / greatest((SELECT count(*) FROM b WHERE b.trigger_name = x.trigger_name AND b.clean_pred = t.target)::DOUBLE / n, 0.1::DOUBLE) ELSE 0 END AS lift FROM x JOIN t USING (trigger_name) JOIN h USING (trigger_name)),
 v AS (SELECT *, CASE WHEN classes <= 1 OR round(entropy, 9) < 1 THEN 'NOT_SCORED' WHEN rate >= 0.5 AND conc >= 0.85 AND lift >= 3 THEN 'STRONG_BACKDOOR_INDICATION' WHEN rate >= 0.3 AND conc >= 0.7 AND lift >= 2 THEN 'SUSPICIOUS' WHEN rate >= 0.3 THEN 'PERTURBATION_SENSITIVE' ELSE 'STABLE' END AS verdict FROM y)"""


@query("trigger_responses", RESPONSES + " SELECT trigger_name, n, flips, target, round(rate, 6) AS flip_rate, round(conc, 6) AS concentration, round(lift, 6) AS lift, verdict FROM v")
def _(s, d):
    return mod.trigger_responses(view(s, d, "responses"), 10)


@query("backdoor_confidence", RESPONSES + """, w AS (SELECT max(row(round(rate, 6) * round(conc, 6) * least(1.0::DOUBLE, round(lift, 6) / 5), target, trigger_name)) AS best FROM v WHERE verdict IN ('STRONG_BACKDOOR_INDICATION', 'SUSPICIOUS')),
 z AS (SELECT coalesce(least(0.95::DOUBLE, greatest(0.0::DOUBLE, (best[1] - 0.2::DOUBLE) / 0.6::DOUBLE)), 0.0::DOUBLE) AS sure, best FROM w) SELECT round(sure, 6) AS confidence, CASE WHEN sure > 0 THEN best[2] END AS target, CASE WHEN sure > 0 THEN best[3] END AS trigger_name FROM z""")
def _(s, d):
    return mod.backdoor_confidence(mod.trigger_responses(view(s, d, "responses"), 10))


TENSORS = """WITH q AS (SELECT tensor, count(*) AS n, stddev_pop(x) AS std, min(x) AS low, max(x) AS high FROM tensors GROUP BY tensor), o AS (SELECT tensor, row_idx, sqrt(sum(x * x)) AS norm FROM tensors GROUP BY ALL),
 o2 AS (SELECT *, abs(norm - median(norm) OVER (PARTITION BY tensor)) AS far, count(*) OVER (PARTITION BY tensor) AS c FROM o), o3 AS (SELECT *, median(far) OVER (PARTITION BY tensor) + 1e-9::DOUBLE AS mad FROM o2),
 o4 AS (SELECT tensor, CASE WHEN any_value(c) > 4 THEN round(count(*) FILTER (0.6745::DOUBLE * far / mad > 8) / count(*), 6) ELSE 0 END AS outlier_rows FROM o3 GROUP BY tensor)"""
REPORTS = TENSORS + """, w AS (SELECT substr(tensor, 1, 7) AS model, count(*) AS tensors, count(*) FILTER (round(std, 6) = 0 AND n > 64) AS dead, count(*) FILTER (abs(high) > 1e4 OR abs(low) > 1e4) AS extreme, count(*) FILTER (outlier_rows > 0 AND n > 1000) AS outlying FROM q JOIN o4 USING (tensor) GROUP BY ALL),
 wr AS (SELECT model, tensors, 0::BIGINT AS non_finite, dead, extreme, outlying, 0::BIGINT AS low_rank, round(least(0.2::DOUBLE, dead / tensors * 2.0::DOUBLE) + least(0.15::DOUBLE, extreme / tensors * 2.0::DOUBLE) + least(0.2::DOUBLE, outlying / tensors * 1.5::DOUBLE), 6) AS anomaly_score FROM w)"""


def reports_of_weights(s, d):
    stats = mod.tensor_statistics(view(s, d, "tensors"))
    return mod.weight_reports(stats.withColumns({"model": F.substring("tensor", 1, 7), "spectral_ratio": F.lit(None).cast("double")}))


@query("tensor_statistics", TENSORS + " SELECT t.tensor, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high, round(count(*) FILTER (x = 0) / count(*), 6) AS zero_share, 0::BIGINT AS non_finite, any_value(outlier_rows) AS outlier_rows FROM tensors t JOIN o4 ON o4.tensor = t.tensor GROUP BY t.tensor")
def _(s, d):
    return mod.tensor_statistics(view(s, d, "tensors"))


@query("weight_reports", REPORTS + " SELECT * FROM wr")
def _(s, d):
    return reports_of_weights(s, d)


@query("spectral_ratios")
def _(s, d):
    e = table(s, d, "embeddings").select(F.concat(F.lit("class"), F.col("label").cast("string")).alias("tensor"), F.col("vec_id").alias("row_idx"), F.col("embedding").alias("values"))
    return mod.spectral_ratios(e)


@query("model_findings", REPORTS + """, z AS (SELECT *, substr(model, 7, 1)::INTEGER % 2 AS strong FROM wr)
 SELECT model, 'MOD-DEAD-PARAMETERS' AS finding, 'MEDIUM' AS severity, 0.85::DOUBLE AS confidence, 'std == 0 on a non-bias tensor with > 64 elements' AS threshold FROM z WHERE dead > 0
 UNION ALL SELECT model, 'MOD-OUTLIER-NEURONS', 'MEDIUM', 0.6::DOUBLE, 'modified z-score > 8 on per-channel L2 norm' FROM z WHERE outlying > 0
 UNION ALL SELECT model, 'MOD-EXTREME-MAGNITUDE', 'LOW', 0.7::DOUBLE, '|value| > 1e4' FROM z WHERE extreme > 0
 UNION ALL SELECT model, 'MOD-BEHAVIOURAL-BACKDOOR-RESPONSE', 'CRITICAL', 0.5::DOUBLE, 'flip rate >= 50% with >= 85% concentration on one class and lift >= 3x' FROM z WHERE strong > 0
 UNION ALL SELECT model, 'MOD-TRIGGER-SENSITIVITY', 'MEDIUM', 0.55::DOUBLE, 'flip rate >= 30% with >= 70% concentration' FROM z WHERE strong = 0""")
def _(s, d):
    rows = reports_of_weights(s, d).withColumns({"strong": F.substring("model", 7, 1).cast("int") % 2, "suspicious": F.lit(1), "backdoor": F.lit(0.5)})
    return em.findings_of(rows, ["model"], em.model_rules())


@query("archive_findings", """WITH x AS (SELECT archive_id, count(*) FILTER (is_link) AS escapes, count(*) FILTER (NOT is_link AND file_size <= 268435456 AND compressed_size > 0 AND file_size::DOUBLE / compressed_size > 200) AS bombs FROM manifest GROUP BY archive_id)
 SELECT archive_id, 'SEC-ARCHIVE-PATH-TRAVERSAL' AS finding, 'CRITICAL' AS severity, 1.0::DOUBLE AS confidence, 'any traversal component, absolute path, or link entry' AS threshold FROM x WHERE escapes > 0
 UNION ALL SELECT archive_id, 'SEC-ARCHIVE-COMPRESSION-BOMB', 'HIGH', 1.0::DOUBLE, 'uncompressed/compressed > 200' FROM x WHERE bombs > 0""")
def _(s, d):
    per = man.manifest_faults(view(s, d, "manifest")).groupBy("archive_id").agg(F.count_if(F.col("fault") == "LINK").alias("escapes"), F.count_if(F.col("fault") == "RATIO").alias("bombs"))
    return em.findings_of(per, ["archive_id"], em.archive_rules())


DRIFT = """WITH m0 AS (SELECT comparison_id, feature, avg(value) FILTER (side = 0) AS x, avg(value) FILTER (side = 1) AS y FROM values GROUP BY ALL), sc AS (SELECT comparison_id, least(100.0::DOUBLE, avg(abs(y - x) / greatest(abs(x), 1e-9)) * 100) AS score FROM m0 WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY comparison_id),
 c AS (SELECT comparison_id, side, cls, count(*)::DOUBLE AS n FROM classes GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY comparison_id, side) AS ratio FROM c),
 z AS (SELECT comparison_id, cls, greatest(coalesce(max(ratio) FILTER (side = 0), 0), 1e-6) AS b, greatest(coalesce(max(ratio) FILTER (side = 1), 0), 1e-6) AS t FROM q GROUP BY ALL), ps AS (SELECT comparison_id, sum((t - b) * ln(t / b)) AS psi FROM z GROUP BY comparison_id)"""


@query("shift_findings", DRIFT + """ SELECT comparison_id, 'SHIFT-COVARIATE-DRIFT' AS finding, CASE WHEN score > 45 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 0.6::DOUBLE AS confidence, 'MMD bands 0.05/0.15/0.3, permutation p < 0.05' AS threshold FROM sc WHERE score > 20
 UNION ALL SELECT comparison_id, 'SHIFT-CLASS-PRIOR', 'MEDIUM', 0.85::DOUBLE, 'PSI > 0.25' FROM ps WHERE psi > 0.25""")
def _(s, d):
    drifts = sh.summary_drift(view(s, d, "values").groupBy("comparison_id", "feature", "side").agg(F.avg("value").alias("value")))
    psi = sh.psi(view(s, d, "classes")).select(F.col("comparison_id").alias("p_id"), "psi")
    rows = em.drift_bands(drifts).join(psi, F.col("comparison_id") == F.col("p_id")).withColumns({"cause": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return em.findings_of(rows, ["comparison_id"], em.shift_rules())


def compared(s, d):
    """Two comparisons of embeddings: low with high labels, even with odd ids; and the PSI of their labels' parities."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    both = e.select(F.lit(1).cast("long").alias("comparison_id"), "id", (F.col("label") < 5).cast("int").alias("side"), "v", "label")
    both = both.union(e.select(F.lit(2).cast("long"), "id", (F.col("id") % 2).cast("int"), "v", "label"))
    psi = sh.psi(both.select("comparison_id", "side", (F.col("label") % 2).cast("string").alias("cls")))
    return both.drop("label"), psi


@query("shift_attribution")
def _(s, d):
    vectors, psi = compared(s, d)
    return sh.attribution(sh.shift_metrics(vectors, psi))


DATASET = f"""WITH def AS ({corpus.DEFECTS}), x AS (SELECT contributor, count(DISTINCT s.sample_id) AS n, count(*) FILTER (kind = 'trigger') AS trig, count(*) FILTER (kind = 'label') AS lab, count(*) FILTER (kind = 'exact') AS exa FROM samples s LEFT JOIN def USING (sample_id) GROUP BY contributor),
 y AS (SELECT *, round(least(100.0::DOUBLE, greatest(100 * (1 - exp(-(5.0::DOUBLE * trig + 3.0::DOUBLE * lab + exa) / n / 0.35::DOUBLE)) * (0.7::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, n / 50.0::DOUBLE)), CASE WHEN trig > 0 THEN 70 + least(25.0::DOUBLE, 25.0::DOUBLE * trig / n) ELSE 0 END)), 4) AS risk FROM x),
 un AS (SELECT contributor, count(*) AS unlabelled FROM samples WHERE sample_id NOT IN (SELECT doc_id FROM labels) GROUP BY contributor),
 im AS (SELECT contributor, max(c)::DOUBLE / min(c) AS imbalance FROM (SELECT contributor, label, count(*) AS c FROM samples GROUP BY ALL) GROUP BY contributor),
 lk AS (SELECT contributor, count(*) AS leaks FROM (SELECT contributor, sha256 FROM samples GROUP BY ALL HAVING count(DISTINCT CASE WHEN path LIKE '%/validation/%' THEN 'val' WHEN path LIKE '%/test/%' THEN 'test' ELSE 'train' END) > 1) GROUP BY contributor),
 g AS (SELECT y.*, coalesce(unlabelled, 0) AS unlabelled, imbalance, coalesce(leaks, 0) AS leaks FROM y LEFT JOIN un USING (contributor) LEFT JOIN im USING (contributor) LEFT JOIN lk USING (contributor))"""


@query("dataset_findings", DATASET + """ SELECT contributor, 'DS-UNLABELLED-SAMPLES' AS finding, 'MEDIUM' AS severity, 0.9::DOUBLE AS confidence, 'unlabelled share > 5%' AS threshold FROM g WHERE unlabelled / n > 0.05
 UNION ALL SELECT contributor, CASE WHEN exa / n >= 0.02 THEN 'DS-DUPLICATE-FLOODING' ELSE 'DS-REDUNDANT-SAMPLES' END, CASE WHEN exa / n >= 0.02 THEN 'HIGH' ELSE 'MEDIUM' END, 0.99::DOUBLE, 'Hamming <= 5' FROM g WHERE exa > 0
 UNION ALL SELECT contributor, 'DS-SPLIT-LEAKAGE', 'HIGH', 0.96::DOUBLE, 'duplicate cluster spanning >1 split directory' FROM g WHERE leaks > 0
 UNION ALL SELECT contributor, CASE WHEN lab >= 8 THEN 'DS-LABEL-FLIPPING' ELSE 'DS-LABEL-NOISE' END, CASE WHEN lab >= 8 THEN 'HIGH' ELSE 'MEDIUM' END, 0.95::DOUBLE, 'k=15, disagreement >= 0.85, margin >= 0.4' FROM g WHERE lab > 0
 UNION ALL SELECT contributor, 'DS-BACKDOOR-TRIGGER-INJECTION', 'CRITICAL', 0.9::DOUBLE, 'spatial consensus of residual peaks' FROM g WHERE trig > 0
 UNION ALL SELECT contributor, 'DS-CLASS-IMBALANCE', CASE WHEN imbalance < 25 THEN 'MEDIUM' ELSE 'HIGH' END, 1.0::DOUBLE, 'max/min class count > 8:1' FROM g WHERE imbalance > 8
 UNION ALL SELECT contributor, 'DS-CONTRIBUTOR-RISK', 'HIGH', 0.88::DOUBLE, 'source risk >= 60 with >= 20 samples' FROM g WHERE risk >= 60 AND n >= 20""")
def _(s, d):
    samples = view(s, d, "samples")
    profile = r.contributor_profile(samples, corpus.defects(s, d))
    missing = a.unlabelled(samples, table(s, d, "labels").withColumnRenamed("doc_id", "sample_id")).groupBy(F.col("contributor").alias("u_c")).agg(F.count("*").alias("unlabelled"))
    sizes = samples.groupBy(F.col("contributor").alias("i_c"), "label").agg(F.count("*").alias("c")).groupBy("i_c").agg((F.max("c") / F.min("c")).alias("imbalance"))
    split = corpus.dup.split_of(F.col("path"))
    leaks = samples.groupBy(F.col("contributor").alias("l_c"), "sha256").agg(F.count_distinct(split).alias("splits")).filter("splits > 1").groupBy("l_c").agg(F.count("*").alias("leaks"))
    met = profile
    for other, key in ((missing, "u_c"), (sizes, "i_c"), (leaks, "l_c")):
        met = met.join(other, F.col("contributor").eqNullSafe(F.col(key)), "left")
    zero = F.lit(0)
    met = met.na.fill(0, ["unlabelled", "leaks"]).withColumns({
        "mismatched": zero, "annotation_high": zero, "annotation_medium": zero, "suspects": F.col("label"), "systematic": F.col("label") >= 8, "backbone": F.lit(1.0), "triggers": F.col("trigger"), "consistency": F.lit(0.9), "candidates": zero, "outliers": zero,
    })
    return em.findings_of(met, ["contributor"], em.dataset_rules())


PLATFORM = """WITH own AS (SELECT DISTINCT owner_id FROM analyses), last AS (SELECT *, row_number() OVER (PARTITION BY owner_id, type ORDER BY created_at DESC, analysis_id DESC) AS p, row_number() OVER (PARTITION BY owner_id, sha256 ORDER BY created_at DESC, analysis_id DESC) AS pa FROM analyses),
 rk AS (SELECT owner_id, round(sum(CASE type WHEN 'DATASET' THEN 0.35::DOUBLE WHEN 'MODEL' THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END * risk_score), 4) AS risk FROM last WHERE p = 1 GROUP BY owner_id),
 gp AS (SELECT owner_id, bool_or(engine = 'fallback' OR status = 'ANALYSIS FAILED') AS gap FROM last WHERE pa = 1 GROUP BY owner_id),
 fo AS (SELECT owner_id, count(*) FILTER (severity = 'CRITICAL' AND acknowledged_at IS NULL) AS critical_open, count(*) FILTER (category = 'MOD-BACKDOOR' AND confidence >= 0.999) AS backdoors FROM findings GROUP BY owner_id),
 ev AS (SELECT o.owner_id, risk, gap, coalesce(critical_open, 0) AS critical_open, coalesce(backdoors, 0) > 400 AS backdoor, o.owner_id = 'owner6' AS malicious FROM own o JOIN rk USING (owner_id) JOIN gp USING (owner_id) LEFT JOIN fo USING (owner_id)),
 de AS (SELECT owner_id, risk, CASE WHEN malicious OR backdoor OR critical_open > 0 OR risk >= 70 THEN 'QUARANTINE' WHEN risk >= 30 OR gap THEN 'REVIEW' ELSE 'ACCEPT' END AS decision,
  CASE WHEN malicious OR backdoor OR critical_open > 0 THEN concat_ws(',', CASE WHEN malicious THEN 'MALICIOUS_SERIALIZATION' END, CASE WHEN backdoor THEN 'BACKDOOR_CONFIRMED' END, CASE WHEN critical_open > 0 THEN 'CRITICAL_FINDING' END) WHEN risk >= 70 THEN 'COMPOSITE_RISK >= 70' WHEN risk >= 30 OR gap THEN concat_ws(',', CASE WHEN risk >= 30 THEN 'COMPOSITE_RISK in [30, 70)' END, CASE WHEN gap THEN 'COVERAGE_GAP' END) ELSE 'COMPOSITE_RISK < 30' END AS rules FROM ev)"""


def owner_evidence(s, d):
    analyses = view(s, d, "analyses")
    fi = view(s, d, "findings").groupBy(F.col("owner_id").alias("f_owner")).agg(F.count_if((F.col("severity") == "CRITICAL") & F.col("acknowledged_at").isNull()).alias("critical_open"), F.count_if((F.col("category") == "MOD-BACKDOOR") & (F.col("confidence") >= 0.999)).alias("backdoors"))
    risk = r.overall_risk(analyses, "owner_id")
    gap = r.posture(analyses).select(F.col("owner_id").alias("g_owner"), "coverage_gap", "assets")
    met = risk.join(gap, F.col("owner_id") == F.col("g_owner")).join(fi, F.col("owner_id") == F.col("f_owner"), "left").na.fill(0, ["critical_open", "backdoors"])
    return r.decided(met.select("owner_id", F.col("overall").alias("risk"), (F.col("owner_id") == "owner6").alias("malicious"), F.lit(0).alias("failed_records"), (F.col("backdoors") > 400).alias("backdoor"), "critical_open", "coverage_gap", F.col("assets").alias("n_evidence")))


@query("platform_governance", PLATFORM + " SELECT owner_id, decision, rules, risk FROM de")
def _(s, d):
    return owner_evidence(s, d).select("owner_id", "decision", "rules", "risk")


@query("assurance_reports", PLATFORM + f""", tf AS (SELECT owner_id, finding_id, severity, row_number() OVER (PARTITION BY owner_id ORDER BY {evidence.RANK} NULLS FIRST, confidence DESC, finding_id) AS place FROM findings WHERE owner_id IS NOT NULL),
 fs AS (SELECT owner_id, count(*) AS n_findings, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, string_agg(finding_id, ',' ORDER BY place) FILTER (place <= 15) AS top FROM tf GROUP BY owner_id),
 rs AS (SELECT concat('owner', record_id % 5) AS owner_id, count(*) AS n_records, count(*) FILTER (status = 'TAMPERED') AS compromised FROM records GROUP BY ALL),
 sb AS (SELECT owner_id, lower(name) AS k, sum(samples)::BIGINT AS samples, sum(defects)::BIGINT AS defects, round(max(risk), 4) AS risk, max(row(risk, s.created_at, analysis_id, name, drivers))[5] AS drivers FROM submissions s JOIN analyses USING (analysis_id) GROUP BY owner_id, lower(name)),
 cp AS (SELECT owner_id, string_agg(concat(k, '/', samples, '/', defects, '/', round(risk)::BIGINT, '/', drivers), ';' ORDER BY place) AS contributors FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY risk DESC, defects DESC, k) AS place FROM sb) WHERE place <= 8 GROUP BY owner_id),
 lb AS (SELECT bool_or(NOT regexp_full_match(current_hash, '[0-9a-f]{{64}}') OR (sequence > 1 AND previous_hash IS DISTINCT FROM p) OR sha256(concat(coalesce(previous_hash, ''), payload)) <> current_hash OR NOT signature_valid) AS broken, count(*) AS ledger_blocks, count(*) FILTER (signature_valid) AS ledger_signed, max(row(conv_id, sequence, current_hash))[3] AS ledger_head FROM (SELECT *, lag(current_hash) OVER (PARTITION BY conv_id ORDER BY sequence) AS p FROM chain)),
 pl AS (SELECT owner_id, {", ".join(f"max({c}) FILTER (type = '{t}') AS {t.lower()}_{n}" for t in ("DATASET", "MODEL", "DISTRIBUTION") for c, n in (("sha256", "asset"), ("status", "status"), ("round(risk_score, 4)", "risk")))} FROM last WHERE p = 1 GROUP BY owner_id)
 SELECT de.*, pl.* EXCLUDE (owner_id), coalesce(n_findings, 0) AS n_findings, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(top, '') AS top, coalesce(n_records, 0) AS n_records, coalesce(compromised, 0) AS compromised, CASE WHEN compromised > 0 THEN 'COMPROMISED' ELSE 'VERIFIED' END AS integrity, coalesce(contributors, '') AS contributors, NOT (SELECT broken FROM lb) AS ledger_valid, (SELECT ledger_blocks FROM lb) AS ledger_blocks, (SELECT ledger_signed FROM lb) AS ledger_signed, (SELECT ledger_head FROM lb) AS ledger_head
 FROM de LEFT JOIN cp USING (owner_id) LEFT JOIN pl USING (owner_id) LEFT JOIN fs USING (owner_id) LEFT JOIN rs USING (owner_id)""")
def _(s, d):
    latest = r.latest_per(view(s, d, "analyses"), ["owner_id", "type"], "created_at", "analysis_id")
    worst = f.placed(view(s, d, "findings").filter("owner_id is not null"), "owner_id", ["finding_id"])
    records = view(s, d, "records").select(F.concat(F.lit("owner"), (F.col("record_id") % 5).cast("string")).alias("owner_id"), "status")
    owners = view(s, d, "analyses").select(F.col("analysis_id").alias("o_id"), "owner_id")
    register = r.contributor_register(view(s, d, "submissions").join(owners, F.col("analysis_id") == F.col("o_id")), ("owner_id",))
    blocks = view(s, d, "chain")
    ledger = cov.ledger_state(blocks, prov.verified_chain(blocks, "conv_id"), "conv_id")
    return cov.assurance_reports(owner_evidence(s, d), latest, worst, records, register, ledger)


COVERED = """WITH an AS (SELECT analysis_id, type, analysis_id % 3 > 0 AS ready, CASE WHEN analysis_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS backbone, analysis_id % 5 > 0 AS labels, analysis_id % 7 > 1 AS consensus, CASE WHEN type = 'MODEL' THEN CASE WHEN analysis_id % 2 = 1 AND analysis_id % 8 = 1 THEN 'ONNX' ELSE 'TORCH' END ELSE CASE analysis_id % 16 WHEN 0 THEN 'COCO_JSON' WHEN 4 THEN 'YOLO' ELSE 'IMAGE_FOLDER' END END AS layout, analysis_id % 6 > 1 AS executed, analysis_id % 9 > 2 AS recovered, analysis_id % 10 > 4 AS inverted FROM analyses),
 cm AS (SELECT analysis_id, unnest(CASE type WHEN 'DATASET' THEN [
  {'threat': 'Exact duplicate flooding', 'covered': TRUE, 'confidence': 1.0::DOUBLE}, {'threat': 'Near-duplicate flooding', 'covered': TRUE, 'confidence': CASE WHEN ready THEN 0.95 ELSE 0.72 END::DOUBLE}, {'threat': 'Label flipping / systematic mislabelling', 'covered': labels, 'confidence': CASE WHEN labels THEN 0.88::DOUBLE * backbone ELSE 0 END},
  {'threat': 'Backdoor trigger injection (static patch)', 'covered': consensus, 'confidence': CASE WHEN consensus THEN 0.93 ELSE 0.45 END::DOUBLE}, {'threat': 'Backdoor trigger injection (blended)', 'covered': consensus, 'confidence': CASE WHEN consensus THEN 0.7 ELSE 0.3 END::DOUBLE}, {'threat': 'Input-aware / warping backdoors', 'covered': FALSE, 'confidence': 0::DOUBLE}, {'threat': 'Clean-label poisoning', 'covered': FALSE, 'confidence': 0::DOUBLE},
  {'threat': 'Out-of-distribution blind spots', 'covered': TRUE, 'confidence': round(0.85::DOUBLE * backbone, 4)}, {'threat': 'Annotation manipulation', 'covered': layout IN ('COCO_JSON', 'YOLO'), 'confidence': CASE WHEN layout IN ('COCO_JSON', 'YOLO') THEN 0.97 ELSE 0 END::DOUBLE}, {'threat': 'Archive-level supply chain attack', 'covered': TRUE, 'confidence': 1.0::DOUBLE}, {'threat': 'Evaluation contamination', 'covered': TRUE, 'confidence': 0.9::DOUBLE}]
  WHEN 'MODEL' THEN [{'threat': 'Malicious deserialisation', 'covered': TRUE, 'confidence': 0.98::DOUBLE}, {'threat': 'Model substitution', 'covered': TRUE, 'confidence': 1.0::DOUBLE}, {'threat': 'Structural trojanisation', 'covered': recovered OR layout = 'ONNX', 'confidence': CASE WHEN recovered OR layout = 'ONNX' THEN 0.85 ELSE 0.2 END::DOUBLE}, {'threat': 'Backdoor (patch trigger)', 'covered': inverted, 'confidence': CASE WHEN inverted THEN 0.86 ELSE 0 END::DOUBLE},
  {'threat': 'Weight-level anomaly', 'covered': TRUE, 'confidence': 0.9::DOUBLE}, {'threat': 'Behavioural backdoor confirmation', 'covered': executed, 'confidence': CASE WHEN executed THEN 0.8 ELSE 0 END::DOUBLE}, {'threat': 'Serialization format risk', 'covered': TRUE, 'confidence': 1.0::DOUBLE}] END, recursive := true) FROM an WHERE type IN ('DATASET', 'MODEL'))"""


def configured(s, d):
    """Analyses with what their engines had at hand."""
    i = F.col("analysis_id")
    dataset = F.when(i % 16 == 0, "COCO_JSON").when(i % 16 == 4, "YOLO").otherwise("IMAGE_FOLDER")
    return view(s, d, "analyses").withColumns({
        "embedding_ready": i % 3 > 0, "backbone": F.when(i % 3 > 0, 1.0).otherwise(0.5), "has_labels": i % 5 > 0, "consensus": i % 7 > 1, "layout": F.when(F.col("type") == "MODEL", F.when(i % 8 == 1, "ONNX").otherwise("TORCH")).otherwise(dataset),
        "executed": i % 6 > 1, "architecture_recovered": i % 9 > 2, "inverted": i % 10 > 4,
    })


@query("coverage_matrix", COVERED + " SELECT * FROM cm")
def _(s, d):
    return cov.coverage_matrix(configured(s, d))


@query("passports", COVERED + ", rules(pattern, framework, control) AS (VALUES " + ", ".join(f"('{x}', '{y}', '{z}')" for x, y, z in evidence.RULES) + """), ct AS (SELECT analysis_id, framework, string_agg(DISTINCT control, ',' ORDER BY control) AS controls FROM findings JOIN rules ON regexp_matches(category, pattern) GROUP BY ALL), ck AS (SELECT analysis_id, string_agg(concat(framework, '=', controls), ';' ORDER BY concat(framework, '=', controls)) AS controls FROM ct GROUP BY analysis_id),
 ff AS (SELECT analysis_id, count(*) AS n_findings, count(*) FILTER (severity = 'CRITICAL') AS critical, string_agg(concat(severity, ':', finding_id), ',' ORDER BY concat(severity, ':', finding_id)) AS listed FROM findings GROUP BY analysis_id),
 cc AS (SELECT analysis_id, count(*) AS threats, count(*) FILTER (covered) AS covered, round(min(confidence) FILTER (covered), 4) AS least_confidence FROM cm GROUP BY analysis_id)
 SELECT x.analysis_id, type AS kind, sha256, status, CASE WHEN x.analysis_id % 12 = 0 THEN 'ACCEPT' WHEN coalesce(critical, 0) > 0 OR risk_score >= 70 THEN 'QUARANTINE' WHEN engine = 'fallback' THEN 'REVIEW' WHEN risk_score < 30 THEN 'ACCEPT' ELSE 'REVIEW' END AS decision, round(risk_score, 4) AS risk, coalesce(n_findings, 0) AS n_findings, coalesce(critical, 0) AS critical, coalesce(listed, '') AS findings,
 coalesce(threats, 0) AS threats, coalesce(covered, 0) AS covered, least_confidence, coalesce(controls, '') AS controls FROM analyses x LEFT JOIN ff USING (analysis_id) LEFT JOIN cc USING (analysis_id) LEFT JOIN ck USING (analysis_id) WHERE type IN ('DATASET', 'MODEL')""")
def _(s, d):
    rows, fi = configured(s, d).withColumn("decision", F.when(F.col("analysis_id") % 12 == 0, "ACCEPT")), view(s, d, "findings")
    return cov.passports(rows, fi, cov.coverage_matrix(rows), f.mapped_controls(fi, evidence.RULES, "analysis_id"))


@query("sensor_readings", """WITH b AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS w, identifier, count(*) FILTER (failed) AS failed FROM attempts GROUP BY ALL), ch AS (SELECT c.conv_id, bool_or(NOT regexp_full_match(current_hash, '[0-9a-f]{64}') OR (sequence > 1 AND previous_hash IS DISTINCT FROM p) OR sha256(concat(coalesce(previous_hash, ''), payload)) <> current_hash OR NOT signature_valid) AS broken FROM (SELECT *, lag(current_hash) OVER (PARTITION BY conv_id ORDER BY sequence) AS p FROM chain) c GROUP BY conv_id)
 SELECT w AS window_start, 'auth' AS sensor, sum(failed)::BIGINT AS signal, CASE WHEN max(failed) >= 5 THEN 'HIGH' ELSE 'INFO' END AS severity FROM b GROUP BY w
 UNION ALL SELECT time_bucket(INTERVAL 15 MINUTE, ts), 'provenance', count(*) FILTER (status = 'TAMPERED'), CASE WHEN count(*) FILTER (status = 'TAMPERED') > 0 THEN 'HIGH' ELSE 'INFO' END FROM records GROUP BY 1
 UNION ALL SELECT NULL, 'ledger', CASE WHEN count(*) FILTER (broken) > 0 THEN 1 ELSE 0 END, CASE WHEN count(*) FILTER (broken) > 0 THEN 'CRITICAL' ELSE 'INFO' END FROM ch
 UNION ALL SELECT time_bucket(INTERVAL 15 MINUTE, created_at::TIMESTAMP), 'supply_chain', count(*) FILTER (severity = 'CRITICAL'), CASE WHEN count(*) FILTER (severity = 'CRITICAL' AND category LIKE 'SEC-%') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'HIGH' ELSE 'INFO' END FROM findings GROUP BY 1
 UNION ALL SELECT time_bucket(INTERVAL 15 MINUTE, created_at::TIMESTAMP), 'traffic', count(*), 'INFO' FROM analyses GROUP BY 1
 UNION ALL SELECT w, 'operations', count(*), 'HIGH' FROM (SELECT time_bucket(INTERVAL 15 MINUTE, created_at::TIMESTAMP) AS w FROM analyses WHERE engine = 'fallback' OR status LIKE '%FAIL%' UNION ALL SELECT time_bucket(INTERVAL 15 MINUTE, ts) FROM attempts WHERE failed) GROUP BY w""")
def _(s, d):
    at = lambda rows, c: rows.withColumn("ts", F.col(c).cast("timestamp"))
    attempts = at(view(s, d, "attempts"), "ts")
    chains = prov.verified_chain(view(s, d, "chain"), "conv_id").select(F.col("broken_at").isNotNull().alias("broken"))
    out = m.sensor_readings(attempts, at(view(s, d, "records"), "ts"), at(view(s, d, "findings"), "created_at"), at(view(s, d, "analyses"), "created_at"), attempts.filter("failed").select("ts"), chains)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("recent_attempts", "SELECT identifier, attempted_at, successful FROM attempts WHERE attempted_at >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY")
def _(s, d):
    return m.kept_since(view(s, d, "attempts"), "attempted_at", F.lit(AS_OF).cast("timestamp_ntz"), 5).select("identifier", "attempted_at", "successful")


@query("orphan_labels", "SELECT concat('labels/', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '.txt') AS path FROM lineitem WHERE l_orderkey % 50 = 7 OR l_linenumber > 4")
def _(s, d):
    name = lambda folder, end: F.concat(F.lit(folder), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(end)).alias("path")
    li = table(s, d, "lineitem")
    return a.orphan_labels(li.select(name("labels/", ".txt")), li.filter("l_orderkey % 50 <> 7 AND l_linenumber <= 4").select(name("images/train/", ".jpg")))


@query("format_mismatches", "SELECT page_id, 'page.png' AS path, 'png' AS declared, 'html' AS format FROM pages WHERE page_id % 4 = 1 AND (html LIKE '<!DO%' OR html LIKE '<htm%')")
def _(s, d):
    path = F.when(F.col("page_id") % 4 == 1, "page.png").when(F.col("page_id") % 4 == 2, "page.htm").otherwise("page.txt")
    return man.format_mismatches(table(s, d, "pages").select("page_id", path.alias("path"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content")))


@query("manifest_digests", """SELECT event_id, sha256(concat('{"event_type":"', event_type, '","user":', CAST(user_id AS VARCHAR), '}')) AS digest FROM events""")
def _(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.sha2(prov.canonical_json(F.to_json(F.struct(F.col("user_id").alias("user"), "event_type"))), 256).alias("digest"))


def pictures(s, d):
    """Embeddings of 64 numbers as grey images of 8 x 8."""
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("pixels"), F.lit(8).alias("h"), F.lit(8).alias("w"), "label")


@query("average_hashes", "SELECT vec_id AS id, CASE WHEN u >= 9223372036854775808::UBIGINT THEN (u - 9223372036854775808::UBIGINT)::BIGINT + (-9223372036854775808) ELSE u::BIGINT END AS ahash FROM (SELECT vec_id, bit_or(CASE WHEN x > mean THEN (1::UBIGINT << (64 - i)::UBIGINT) ELSE 0::UBIGINT END) AS u FROM (SELECT vec_id, list_sum(embedding::DOUBLE[]) / 64 AS mean, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY vec_id)")
def _(s, d):
    return pictures(s, d).select("id", px.average_hash(F.col("pixels")).alias("ahash"))


@query("image_hashes")
def _(s, d):
    return px.image_hashes(pictures(s, d))


def byte_pictures(s, d):
    """Embeddings as images of 8 x 8 bytes."""
    grey = lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(F.lit(128.0) + F.lit(200.0) * x.cast("double"))))
    return pictures(s, d).withColumns({"pixels": F.transform("pixels", grey), "c": F.lit(1)})


def stamped_pictures(s, d):
    """The same with a stamp on every third image of label 3 and an overlay on every fourth of label 5, beside all others."""
    y, x = (lambda i: F.floor(i / 8)), (lambda i: i % 8)
    stamp = lambda v, i: F.when(y(i).between(2, 5) & x(i).between(2, 5), F.when((y(i) + x(i)) % 2 == 0, 255.0).otherwise(0.0)).otherwise(v)
    overlay = lambda v, i: F.least(F.lit(255.0), v + 110.0 * ((y(i) * 5 + x(i) * 3) % 7 < 3).cast("int"))
    kept = F.when((F.col("label") == 3) & (F.col("id") % 3 == 0), F.transform("pixels", stamp)).when((F.col("label") == 5) & (F.col("id") % 4 == 0), F.transform("pixels", overlay)).otherwise(F.col("pixels"))
    return byte_pictures(s, d).withColumn("pixels", kept)


def small_clusters(s, d):
    return tg.trigger_clusters(stamped_pictures(s, d), 8, 8, 1, patch=4, cell=3, coarse=1)


@query("image_features", """WITH p AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: least(255.0, greatest(0.0, floor(128.0::DOUBLE + 200.0::DOUBLE * x)))) AS g FROM embeddings),
 x AS (SELECT id, unnest(g) AS v, unnest(range(0, 64)) AS i, g FROM p), e AS (SELECT id, v, g[least(i // 8 + 1, 7) * 8 + i % 8 + 1] - g[greatest(i // 8 - 1, 0) * 8 + i % 8 + 1] AS dy, CASE WHEN i // 8 IN (0, 7) THEN 1 ELSE 2 END AS hy, g[i // 8 * 8 + least(i % 8 + 1, 7) + 1] - g[i // 8 * 8 + greatest(i % 8 - 1, 0) + 1] AS dx, CASE WHEN i % 8 IN (0, 7) THEN 1 ELSE 2 END AS hx FROM x),
 h AS (SELECT id, sum(-(n / 64.0::DOUBLE) * log2(n / 64.0::DOUBLE)) AS entropy FROM (SELECT id, v, count(*) AS n FROM x GROUP BY id, v) GROUP BY id)
 SELECT id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(CASE WHEN sqrt((dy / hy) ** 2 + (dx / hx) ** 2) > 32 THEN 1.0 ELSE 0.0 END), 6) AS edge_density, round(any_value(entropy), 6) AS entropy FROM e JOIN h USING (id) GROUP BY id""")
def _(s, d):
    features = px.image_features(byte_pictures(s, d))
    return features.select("id", *[F.round(c, 6).alias(c) for c in ("mean", "std", "edge_density", "entropy")])


@query("image_descriptors")
def _(s, d):
    return px.image_descriptors(byte_pictures(s, d))


@query("trigger_clusters")
def _(s, d):
    return small_clusters(s, d)[0]


@query("trigger_candidates")
def _(s, d):
    members = small_clusters(s, d)[1]
    return px.trigger_candidates(px.screened(stamped_pictures(s, d), 4), members)


@query("demo_removed", "SELECT 'analyses' AS table_name, count(*) FILTER (is_demo AND owner_id = 'owner2') AS removed, count(*) FILTER (NOT (is_demo AND owner_id = 'owner2')) AS kept FROM analyses UNION ALL SELECT 'findings', count(*) FILTER (analysis_id % 9 = 0 AND owner_id = 'owner2'), count(*) FILTER (NOT coalesce(analysis_id % 9 = 0 AND owner_id = 'owner2', FALSE)) FROM findings")
def _(s, d):
    tables = {"analyses": view(s, d, "analyses"), "findings": view(s, d, "findings").withColumn("is_demo", F.col("analysis_id") % 9 == 0)}
    return rep.purged(tables, "owner2")[1]


@query("without_demo", "SELECT analysis_id, owner_id FROM analyses WHERE NOT (is_demo AND owner_id = 'owner2')")
def _(s, d):
    return rep.purged({"analyses": view(s, d, "analyses")}, "owner2")[0]["analyses"].select("analysis_id", "owner_id")


@query("saved_analyses", """WITH w AS (SELECT analysis_id, bool_or(severity = 'CRITICAL') AS critical FROM findings GROUP BY analysis_id)
 SELECT analysis_id, CASE WHEN critical THEN 'QUARANTINED' WHEN w.analysis_id IS NOT NULL THEN 'ASSESSED' WHEN a.analysis_id % 10 = 0 THEN 'SAVED' ELSE status END AS status, CASE WHEN a.analysis_id % 10 = 0 THEN risk_score / 2 ELSE risk_score END AS risk_score FROM analyses a LEFT JOIN w USING (analysis_id)""")
def _(s, d):
    old = view(s, d, "analyses").select("analysis_id", "status", "risk_score")
    new = old.filter("analysis_id % 10 = 0").select("analysis_id", F.lit("SAVED").alias("status"), (F.col("risk_score") / 2).alias("risk_score"))
    return rep.upserted(old, new, view(s, d, "findings"), "analysis_id")


@query("corrupt_by_reason", """WITH b AS (SELECT CASE WHEN page_id % 40 = 7 THEN '' WHEN page_id % 25 = 3 THEN substr(html, 3) ELSE html END AS html FROM pages), x AS (SELECT CASE WHEN coalesce(html, '') = '' THEN 'EMPTY' WHEN NOT (html LIKE '<!DO%' OR html LIKE '<htm%') THEN 'UNKNOWN_FORMAT' END AS reason FROM b), y AS (SELECT reason, count(*) AS n FROM x GROUP BY reason)
 SELECT reason, n, round(n / (SELECT count(*) FROM x), 6) AS share, CASE WHEN (SELECT count(reason) / count(*) FROM x) > 0.02 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM y WHERE reason IS NOT NULL""")
def _(s, d):
    # every 40th page lost its content on the way, every 25th its first characters
    damaged = F.when(F.col("page_id") % 40 == 7, "").when(F.col("page_id") % 25 == 3, F.substr("html", F.lit(3))).otherwise(F.col("html"))
    html = F.coalesce(damaged, F.lit(""))
    reason = F.when(html == "", "EMPTY").when(man.sniffed(F.encode(html, "utf-8")) != "html", "UNKNOWN_FORMAT")
    return man.corrupt_by_reason(table(s, d, "pages").select(reason.alias("reason")))


@query("newest_events", "SELECT record_id, prediction, ts FROM records ORDER BY ts DESC, record_id LIMIT 100 OFFSET 50")
def _(s, d):
    return f.newest(view(s, d, "records").select("record_id", "prediction", "ts"), "ts", ["record_id"], 100, 50)


@query("high_risk_contributors", "SELECT count(*) AS contributors, count(*) FILTER (risk >= 60) AS high_risk FROM (SELECT lower(name) AS k, max(risk) AS risk FROM submissions GROUP BY lower(name))")
def _(s, d):
    return r.contributor_register(view(s, d, "submissions")).agg(F.count("*").alias("contributors"), F.count_if(F.col("max_risk") >= 60).alias("high_risk"))
