"""What an assessment could see: coverage of threats by analysis, passports and assurance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _covered(rules: list[tuple[str, Column, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(threat).alias("threat"), covered.alias("covered"), F.round(sure.cast("double"), 4).alias("confidence")) for threat, covered, sure in rules])


def dataset_coverage() -> Column:
    """Threats, whether they are covered and with what confidence, fixed by the evidence contract.

    Columns: embedding_ready, backbone (confidence of the vectors), has_labels, consensus, layout.
    """
    yes, no = F.lit(True), F.lit(False)
    ready, labels, consensus, backbone = F.col("embedding_ready"), F.col("has_labels"), F.col("consensus"), F.col("backbone")
    annotated = F.col("layout").isin("COCO_JSON", "YOLO")
    return _covered([
        ("Exact duplicate flooding", yes, F.lit(1.0)),
        ("Near-duplicate flooding", yes, F.when(ready, 0.95).otherwise(0.72)),
        ("Label flipping / systematic mislabelling", labels & (backbone > 0), F.when(labels, 0.88 * backbone).otherwise(0.0)),
        ("Backdoor trigger injection (static patch)", consensus, F.when(consensus, 0.93).otherwise(0.45)),
        ("Backdoor trigger injection (blended)", consensus, F.when(consensus, 0.70).otherwise(0.3)),
        ("Input-aware / warping backdoors", no, F.lit(0.0)),
        ("Clean-label poisoning", no, F.lit(0.0)),
        ("Out-of-distribution blind spots", backbone > 0, 0.85 * backbone),
        ("Annotation manipulation", annotated, F.when(annotated, 0.97).otherwise(0.0)),
        ("Archive-level supply chain attack", yes, F.lit(1.0)),
        ("Evaluation contamination", yes, F.lit(0.9)),
    ])


def model_coverage() -> Column:
    """The same for models. Columns: executed, architecture_recovered, inverted (trigger inversion ran), layout."""
    yes = F.lit(True)
    graph = F.col("architecture_recovered") | (F.col("layout") == "ONNX")
    return _covered([
        ("Malicious deserialisation", yes, F.lit(0.98)),
        ("Model substitution", yes, F.lit(1.0)),
        ("Structural trojanisation", graph, F.when(graph, 0.85).otherwise(0.2)),
        ("Backdoor (patch trigger)", F.col("inverted"), F.when(F.col("inverted"), 0.86).otherwise(0.0)),
        ("Weight-level anomaly", yes, F.lit(0.9)),
        ("Behavioural backdoor confirmation", F.col("executed"), F.when(F.col("executed"), 0.8).otherwise(0.0)),
        ("Serialization format risk", yes, F.lit(1.0)),
    ])


def coverage_matrix(analyses: DataFrame) -> DataFrame:
    """analysis_id, threat, covered and confidence of every dataset and model analysis; the rules are constants of the plan.

    Columns: analysis_id, type and those of ``dataset_coverage`` and ``model_coverage``.
    """
    rows = F.when(F.col("type") == "DATASET", dataset_coverage()).when(F.col("type") == "MODEL", model_coverage())
    return analyses.select("analysis_id", F.explode(rows).alias("c")).select("analysis_id", "c.*")


def passports(analyses: DataFrame, findings: DataFrame, coverage: DataFrame, controls: DataFrame) -> DataFrame:
    """One row for each dataset and model analysis: subject, decision, risk, its findings, covered threats and controls.

    ``analyses``: analysis_id, type, sha256, status, engine, risk_score and decision (null: not stored);
    ``findings``: analysis_id, finding_id, severity; ``coverage``: of ``coverage_matrix``; ``controls``:
    analysis_id, framework, controls. A stored decision stands; else a critical finding or a risk of 70
    quarantines, the fallback engine asks for review, and 30 is the bar of acceptance.
    """
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "severity", "finding_id"))), ",")
    f = findings.groupBy(F.col("analysis_id").alias("f_id")).agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), listed.alias("findings"))
    c = coverage.groupBy(F.col("analysis_id").alias("c_id")).agg(F.count("*").alias("threats"), F.count_if("covered").alias("covered"), F.round(F.min(F.when(F.col("covered"), F.col("confidence"))), 4).alias("least_confidence"))
    k = controls.groupBy(F.col("analysis_id").alias("k_id")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "framework", "controls"))), ";").alias("controls"))
    rows = analyses.filter(F.col("type").isin("DATASET", "MODEL")).join(f, F.col("analysis_id") == F.col("f_id"), "left").join(c, F.col("analysis_id") == F.col("c_id"), "left").join(k, F.col("analysis_id") == F.col("k_id"), "left")
    risk = F.col("risk_score")
    own = F.when((F.coalesce("critical", F.lit(0)) > 0) | (risk >= 70), "QUARANTINE").when(F.col("engine") == "fallback", "REVIEW").when(risk < 30, "ACCEPT").otherwise("REVIEW")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "analysis_id", F.col("type").alias("kind"), "sha256", "status", F.coalesce("decision", own).alias("decision"), F.round(risk, 4).alias("risk"),
        zero("n_findings"), zero("critical"), F.coalesce("findings", F.lit("")).alias("findings"), zero("threats"), zero("covered"), "least_confidence", F.coalesce("controls", F.lit("")).alias("controls"),
    )


def ledger_state(blocks: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """One row: ledger_valid, ledger_blocks, ledger_signed and ledger_head, the last block's hash of the last chain that has a key.

    ``blocks``: ``key``, sequence, current_hash; ``chains``: of ``verified_chain``. Without blocks the ledger is
    valid, of length 0 and headless.
    """
    head = blocks.filter(F.col(key).isNotNull() & F.col("sequence").isNotNull()).agg(F.max(F.struct(key, "sequence", "current_hash"))["current_hash"].alias("head"))
    state = chains.agg((F.count_if(F.col("broken_at").isNotNull()) == 0).alias("ledger_valid"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("ledger_blocks"), F.coalesce(F.sum("signed"), F.lit(0)).alias("ledger_signed"))
    return state.withColumn("ledger_head", head.scalar())


def riskiest(register: DataFrame, owner: str, most: int = 8) -> DataFrame:
    """Of each owner the ``most`` contributors of greatest risk (ties: more defects, then name) as one text.

    Columns: owner and those of ``contributor_register``. An entry is name/samples/defects/risk/drivers, risk as a whole number.
    """
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("max_risk"), F.desc("defects"), "key"))
    entry = F.concat_ws("/", "key", "samples", "defects", F.round("max_risk").cast("long"), "worst_drivers")
    rows = register.withColumn("place", place).filter(F.col("place") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", entry.alias("entry")))), lambda s: s["entry"])
    return rows.groupBy(F.col(owner).alias("c_owner")).agg(F.array_join(listed, ";").alias("contributors"))


def assurance_reports(evidence: DataFrame, latest: DataFrame, findings: DataFrame, records: DataFrame, contributors: DataFrame, ledger: DataFrame, top: int = 15) -> DataFrame:
    """One row an owner: latest asset and risk of each pillar, findings by severity with the worst, integrity, decision,
    contributors and the state of the ledger, which all owners share.

    ``evidence``: of ``decided``, with owner_id; ``latest``: the newest analysis of each owner and type;
    ``findings``: owner_id, finding_id, severity, place (rank within the owner); ``records``: owner_id, status;
    ``contributors``: ``contributor_register`` by owner_id; ``ledger``: the row of ``ledger_state``.
    """
    pillar = lambda t, c: F.max(F.when(F.col("type") == t, F.col(c)))
    assets = latest.groupBy(F.col("owner_id").alias("a_owner")).agg(*[pillar(t, c).alias(f"{t.lower()}_{name}") for t in ("DATASET", "MODEL", "DISTRIBUTION") for c, name in (("sha256", "asset"), ("status", "status"))], *[F.round(pillar(t, "risk_score"), 4).alias(f"{t.lower()}_risk") for t in ("DATASET", "MODEL", "DISTRIBUTION")])
    counted = findings.groupBy(F.col("owner_id").alias("f_owner")).agg(F.count("*").alias("n_findings"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM")])
    # apart from the counts, so that a place which is a row number needs an owner's first ones of each task only
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "finding_id"))), lambda s: s["finding_id"]), ",")
    worst = findings.filter(F.col("place") <= top).groupBy(F.col("owner_id").alias("t_owner")).agg(listed.alias("top"))
    f = counted.join(worst, F.col("f_owner") == F.col("t_owner"), "left")
    bad = F.count_if(F.col("status").isin("TAMPERED", "FORGED", "REPLAYED"))
    r = records.groupBy(F.col("owner_id").alias("r_owner")).agg(F.count("*").alias("n_records"), bad.alias("compromised"))
    state = ledger.select(F.struct("*")).scalar()
    rows = evidence.join(assets, F.col("owner_id") == F.col("a_owner"), "left").join(riskiest(contributors, "owner_id"), F.col("owner_id") == F.col("c_owner"), "left").join(f, F.col("owner_id") == F.col("f_owner"), "left").join(r, F.col("owner_id") == F.col("r_owner"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "owner_id", "decision", "rules", F.round("risk", 4).alias("risk"), *[c for c in assets.columns if c != "a_owner"], zero("n_findings"), zero("critical"), zero("high"), zero("medium"), F.coalesce("top", F.lit("")).alias("top"),
        zero("n_records"), zero("compromised"), F.when(F.coalesce("compromised", F.lit(0)) > 0, "COMPROMISED").otherwise("VERIFIED").alias("integrity"),
        F.coalesce("contributors", F.lit("")).alias("contributors"), *[state[c].alias(c) for c in ledger.columns],
    )
