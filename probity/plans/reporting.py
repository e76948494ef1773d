"""Queries of reports, and of the remaining model-side and annotation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.operators import annotations as a
from probity.operators import duplicates as dup
from probity.operators import emitters as em
from probity.operators import findings as fin
from probity.operators import models as mod
from probity.operators import pixels as px
from probity.operators import provenance as prov
from probity.operators import reports as rep
from probity.operators import risk as r
from probity.plans import corpus, evidence
from probity.plans.bindings import sql, view

QUERIES, ORACLE = {}, {}
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLE[name] = sql(oracle)
        return function

    return add


@query("audit_redaction", "SELECT finding_id, category, CASE WHEN coalesce(owner_id = 'owner1', FALSE) THEN severity END AS severity, CASE WHEN coalesce(owner_id = 'owner1', FALSE) THEN created_at END AS created_at, NOT coalesce(owner_id = 'owner1', FALSE) AS redacted FROM findings")
def _(s, d):
    return rep.redacted(view(s, d, "findings"), "owner1", ["finding_id", "category"], ["severity", "created_at"], "owner_id")


@query("model_records", "SELECT record_id, prediction FROM records WHERE model_hash IN (SELECT CAST(analysis_id % 5 AS VARCHAR) FROM analyses WHERE type = 'MODEL' AND analysis_id % 5 <> 1)")
def _(s, d):
    known = view(s, d, "analyses").filter("analysis_id % 5 <> 1").withColumn("model_hash", (F.col("analysis_id") % 5).cast("string"))
    return rep.records_of_models(view(s, d, "records"), known).select("record_id", "prediction")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def _(s, d):
    return rep.table_counts({t: s.read.parquet(f"{d}/{t}.parquet") for t in TABLES})


@query("shared_features", "SELECT comparison_id, feature FROM values WHERE side = 0 INTERSECT SELECT comparison_id, feature FROM values WHERE side = 1")
def _(s, d):
    return rep.shared_features(view(s, d, "values"))


@query("content_ids", "SELECT sample_id, concat_ws('-', 'AST', upper(substr(sha256, 1, 16)), contributor) AS asset_id FROM samples")
def _(s, d):
    return view(s, d, "samples").select("sample_id", rep.content_id("AST", F.col("sha256"), F.col("contributor")).alias("asset_id"))


@query("replaced_findings", "SELECT finding_id, analysis_id, severity FROM findings WHERE analysis_id % 10 <> 0 OR analysis_id NOT IN (SELECT analysis_id FROM findings WHERE analysis_id % 10 = 0 AND severity = 'LOW') UNION ALL SELECT finding_id, analysis_id, 'INFO' FROM findings WHERE analysis_id % 10 = 0 AND severity = 'LOW'")
def _(s, d):
    old = view(s, d, "findings").select("finding_id", "analysis_id", "severity")
    return rep.replaced(old, old.filter("analysis_id % 10 = 0 AND severity = 'LOW'").withColumn("severity", F.lit("INFO")), "analysis_id")


@query("emitted_findings", f"""WITH def AS ({corpus.DEFECTS}), x AS (SELECT contributor, count(DISTINCT s.sample_id) AS n, count(*) FILTER (kind = 'trigger') AS trig, count(*) FILTER (kind = 'label') AS lab, count(*) FILTER (kind = 'exact') AS exa FROM samples s LEFT JOIN def USING (sample_id) GROUP BY contributor),
 y AS (SELECT *, round(least(100.0::DOUBLE, greatest(100 * (1 - exp(-(5.0::DOUBLE * trig + 3.0::DOUBLE * lab + exa) / n / 0.35::DOUBLE)) * (0.7::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, n / 50.0::DOUBLE)), CASE WHEN trig > 0 THEN 70 + least(25.0::DOUBLE, 25.0::DOUBLE * trig / n) ELSE 0 END)), 4) AS risk FROM x)
 SELECT contributor, CASE WHEN exa / n >= 0.02 THEN 'DS-DUPLICATE-FLOODING' ELSE 'DS-REDUNDANT-SAMPLES' END AS finding, CASE WHEN exa / n >= 0.02 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 0.99::DOUBLE AS confidence, 'Hamming <= 5' AS threshold FROM y WHERE exa > 0
 UNION ALL SELECT contributor, 'DS-CONTRIBUTOR-RISK', 'HIGH', 0.88::DOUBLE, 'source risk >= 60 with >= 20 samples' FROM y WHERE risk >= 60 AND n >= 20""")
def _(s, d):
    profile = r.contributor_profile(view(s, d, "samples"), corpus.defects(s, d))
    rules = [x for x in em.dataset_rules() if x.finding in ("DS-CORRUPT-SAMPLES", "DS-DUPLICATE-FLOODING", "DS-REDUNDANT-SAMPLES", "DS-CONTRIBUTOR-RISK")]
    return em.findings_of(profile, ["contributor"], rules)


@query("listed_findings", "SELECT finding_id, severity, created_at FROM findings WHERE severity = 'HIGH' AND owner_id = 'owner3' ORDER BY created_at DESC, finding_id LIMIT 50 OFFSET 10")
def _(s, d):
    return fin.listed(view(s, d, "findings"), 50, 10, "HIGH", "owner3").select("finding_id", "severity", "created_at")


@query("degraded_findings", "SELECT analysis_id, 'SYS-DEGRADED-ANALYSIS' AS finding, 'MEDIUM' AS severity, 1.0::DOUBLE AS confidence, 'engine reachability' AS threshold FROM analyses WHERE engine = 'fallback'")
def _(s, d):
    return em.findings_of(view(s, d, "analyses"), ["analysis_id"], em.degraded_rules())


@query("aborted_archives", "SELECT archive_id, 'DS-ARCHIVE-ABORTED' AS finding, 'CRITICAL' AS severity, 1.0::DOUBLE AS confidence, 'entries > 200000 or bytes > 2147483648' AS threshold FROM manifest GROUP BY archive_id HAVING count(*) > 200000 OR sum(file_size) > 2147483648")
def _(s, d):
    per = view(s, d, "manifest").groupBy("archive_id").agg(F.count("*").alias("entries"), F.sum("file_size").alias("total_bytes"))
    return em.findings_of(per, ["archive_id"], em.abort_rules())


@query("fingerprint_sketches")
def _(s, d):
    hashes = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("label") % 3).alias("source"), px.average_hash(F.col("embedding")).alias("phash"))
    return dup.sketched_counts(dup.hash_sketches(hashes, ["source"], ["phash"]), ["source"], ["phash"])


@query("owner_report", f"""WITH g AS ({evidence.GOVERNANCE}), f AS (SELECT owner_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS fired FROM (SELECT owner_id, unnest(string_split(rules, ',')) AS rule FROM g JOIN analyses USING (analysis_id) WHERE rules <> '') GROUP BY owner_id)
 SELECT owner_id, count(*) AS assets, count(*) FILTER (decision = 'ACCEPT') AS accept, count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'QUARANTINE') AS quarantine, round(max(risk_score), 4) AS highest_risk, coalesce(max(fired), '') AS fired FROM g JOIN analyses USING (analysis_id) LEFT JOIN f USING (owner_id) GROUP BY owner_id""")
def _(s, d):
    decided = r.governance(evidence.asset_evidence(s, d)).select(F.col("analysis_id").alias("g_id"), "decision", "rules", "risk")
    return rep.owner_report(decided.join(view(s, d, "analyses").select("analysis_id", "owner_id"), F.col("g_id") == F.col("analysis_id")))


@query("import_verdicts", """SELECT p_brand AS checkpoint, CASE max(v) WHEN 2 THEN 'MALICIOUS' WHEN 1 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict, count(*) FILTER (v > 0) AS findings FROM (
 SELECT p_brand, CASE WHEN concat(p_type, '.', p_name) = 'PROMO.red widget' OR p_size = 50 AND p_partkey % 30 = 0 THEN 2 WHEN p_partkey % 90 = 1 OR NOT p_type IN ('PROMO', 'ECONOMY', 'STANDARD') THEN 1 ELSE 0 END AS v FROM part) GROUP BY p_brand""")
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    refs = p.select(F.col("p_brand").alias("checkpoint"), F.col("p_type").alias("module"), F.col("p_name").alias("name"), ((F.col("p_size") == 50) & (F.col("p_partkey") % 30 == 0)).alias("stream_truncated"), F.when(F.col("p_partkey") % 90 == 1, "tar").otherwise("zip").alias("container"))
    return mod.import_verdicts(refs, ["PROMO.red widget"], ["PROMO", "ECONOMY", "STANDARD"])


@query("operator_risk", """WITH x AS (SELECT s_nationkey AS model, count(DISTINCT CASE WHEN s_suppkey % 7 < 2 THEN s_suppkey % 7 END) AS suspicious, count(*) FILTER (s_acctbal < 0) AS orphans, bool_or(s_suppkey % 13 = 0) AS custom FROM supplier GROUP BY s_nationkey)
 SELECT model, suspicious, orphans, custom, round(least(1.0::DOUBLE, least(0.5::DOUBLE, suspicious * 0.15::DOUBLE) + least(0.3::DOUBLE, orphans * 0.05::DOUBLE) + CASE WHEN custom THEN 0.2::DOUBLE ELSE 0 END), 6) AS score FROM x""")
def _(s, d):
    n = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("model"), F.concat(F.lit("op"), (F.col("s_suppkey") % 7).cast("string")).alias("op_type"), F.when(F.col("s_suppkey") % 13 == 0, "custom").otherwise("").alias("domain"), (F.col("s_acctbal") < 0).alias("is_orphan"))
    return mod.operator_risk(n, ["op0", "op1"], [""])


@query("prediction_diversity", """WITH c AS (SELECT event_id % 4 AS model, 32 * (1 + event_id % 3) AS resolution, user_id % 10 AS cls, count(*)::DOUBLE AS c, sum((event_id % 50) / 100.0::DOUBLE + 0.5::DOUBLE) AS conf FROM events GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY model, resolution) AS p FROM c),
 e AS (SELECT model, resolution, count(*) AS classes, sum(-p * log2(p)) AS entropy, sum(conf) / sum(c) AS conf FROM p GROUP BY model, resolution), z AS (SELECT *, round(entropy - 2.5::DOUBLE * greatest(0::DOUBLE, conf - 0.95::DOUBLE), 9) AS score FROM e)
 SELECT model, resolution, classes, round(entropy, 6) AS entropy, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, resolution DESC) AS q FROM z) WHERE q = 1""")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    rows = e.select((F.col("event_id") % 4).alias("model"), (32 * (1 + F.col("event_id") % 3)).alias("resolution"), (F.col("user_id") % 10).alias("cls"), ((F.col("event_id") % 50) / 100.0 + 0.5).alias("confidence"))
    return mod.prediction_diversity(rows)


@query("model_risk", "SELECT analysis_id, round(CASE WHEN analysis_id % 50 = 1 THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(risk_score / 2, least(60.0::DOUBLE, (analysis_id % 10) / 10.0::DOUBLE * 85) + least(20.0::DOUBLE, (analysis_id % 3) * 10.0::DOUBLE) + 5.0::DOUBLE + CASE WHEN analysis_id % 50 = 5 THEN 25.0::DOUBLE ELSE 0 END)) END, 6) AS risk FROM analyses WHERE type = 'MODEL'")
def _(s, d):
    i = F.col("analysis_id")
    rows = view(s, d, "analyses").filter("type = 'MODEL'").select("analysis_id", F.when(i % 50 == 1, "MALICIOUS").when(i % 50 == 5, "SUSPICIOUS").otherwise("CLEAN").alias("verdict"), (F.col("risk_score") / 2).alias("finding_risk"), ((i % 10) / 10.0).alias("backdoor"), ((i % 3) * 0.5).alias("weights"), F.lit(0.25).alias("structure"))
    return r.model_risk(rows).select("analysis_id", F.round("risk", 6).alias("risk"))


@query("yolo_defects", "SELECT l_orderkey AS path, l_linenumber AS line_no, CASE WHEN l_linenumber < 2 THEN 'negative-class' WHEN l_linenumber - 2 >= 5 THEN 'class-overflow' WHEN l_quantity > 45 THEN 'coordinates-out-of-range' WHEN l_discount = 0 THEN 'degenerate-box' END AS defect FROM lineitem WHERE l_linenumber < 2 OR l_linenumber - 2 >= 5 OR l_quantity > 45 OR l_discount = 0")
def _(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    value = F.concat((F.col("l_linenumber") - 2).cast("string"), F.lit(" 0.5  0.5 "), F.when(F.col("l_quantity") > 45, "1.5").otherwise("0.1"), F.lit(" "), F.when(F.col("l_discount") == 0, "0").otherwise("0.2"))
    return a.yolo_defects(li.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line_no"), value.alias("value")), 5)


def sealed_records(s, d):
    """Events as records whose hash binds every field; every seventh has a bad signature."""
    e = s.read.parquet(f"{d}/events.parquet")
    text = lambda c: F.col(c).cast("string")
    rows = e.select(
        text("event_id").alias("record_id"), text("user_id").alias("input_hash"), F.lit("model").alias("model_identifier"), F.md5("event_type").alias("model_hash"), F.col("props").alias("config_json"),
        F.col("event_type").alias("prediction"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("timestamp").alias("ts"), F.concat(F.lit("n"), text("event_id")).alias("nonce"),
    )
    return rows.withColumn("record_hash", prov.bound_digest()).withColumn("signature_valid", F.col("record_id").cast("long") % 7 != 0)


@query("sealed_records", """SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN event_id % 10 = 3 THEN 'TAMPERED' WHEN event_id % 7 = 0 THEN 'FORGED' ELSE 'VERIFIED' END AS status,
 CASE WHEN event_id % 10 = 3 THEN CASE WHEN event_id % 20 = 3 THEN 'input_hash,prediction' ELSE 'prediction' END ELSE '' END AS altered, FALSE AS unsigned FROM events""")
def _(s, d):
    sealed = sealed_records(s, d)
    number = F.col("record_id").cast("long")
    shown = sealed.drop("record_hash", "signature_valid").withColumns({"prediction": F.when(number % 10 == 3, "forged").otherwise(F.col("prediction")), "input_hash": F.when(number % 20 == 3, "other").otherwise(F.col("input_hash"))})
    return prov.verified(sealed, shown)
