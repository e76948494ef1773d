"""Model-side result tables: trigger responses, class masks, tensors, imports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.operators.prefix import quantiles
from probity.storage import materialise


def trigger_responses(rows: DataFrame, classes: int) -> DataFrame:
    """By trigger: flip rate, top target of flips, concentration, lift and verdict.

    Columns: sample, trigger_name, clean_pred, pred. The target's prior is its share among clean
    predictions of the trigger's rows, 1 / ``classes`` at least; its share after the trigger counts all
    predictions, flipped or not. A clean baseline of one class, or of less than one bit of entropy, leaves
    nothing to flip away from: such a trigger is NOT_SCORED. Ties of targets go to the lesser class.
    """
    flip = F.col("pred") != F.col("clean_pred")
    per = rows.groupBy("trigger_name").agg(F.count("*").alias("n"), F.count_if(flip).alias("flips"))
    # by class: how often it was predicted before, after, and after a flip
    each = lambda c, name: rows.groupBy("trigger_name", F.col(c).alias("cls")).agg(F.count("*").alias(name), F.count_if(flip).alias("flipped"))
    after = each("pred", "post_n")
    top = after.filter("flipped > 0").groupBy(F.col("trigger_name").alias("t_name")).agg(F.max(F.struct("flipped", (-F.col("cls")).alias("neg"), "post_n")).alias("top"))
    top = top.select("t_name", F.col("top.flipped").alias("hits"), (-F.col("top.neg")).alias("target"), F.col("top.post_n").alias("post_n"))
    priors = each("clean_pred", "prior_n").join(per.select(F.col("trigger_name").alias("n_name"), F.col("n").alias("of")), F.col("trigger_name") == F.col("n_name"))
    p = F.col("prior_n") / F.col("of")
    base = priors.groupBy(F.col("trigger_name").alias("b_name")).agg(F.sum(-p * F.log2(p)).alias("entropy"), F.count("*").alias("classes"))
    met = per.join(top, F.col("trigger_name") == F.col("t_name"), "left").join(base, F.col("trigger_name") == F.col("b_name"))
    met = met.join(priors.select(F.col("trigger_name").alias("c_name"), "cls", "prior_n"), (F.col("trigger_name") == F.col("c_name")) & (F.col("target") == F.col("cls")), "left")
    rate, concentration = F.col("flips") / F.col("n"), F.coalesce(F.col("hits") / F.col("flips"), F.lit(0.0))
    lift = F.coalesce("post_n", F.lit(0)) / F.col("n") / F.greatest(F.coalesce("prior_n", F.lit(0)) / F.col("n"), F.lit(1.0 / max(2, classes)))
    verdict = (
        F.when((F.col("classes") <= 1) | (F.round("entropy", 9) < 1), "NOT_SCORED")
        .when((rate >= 0.5) & (concentration >= 0.85) & (lift >= 3), "STRONG_BACKDOOR_INDICATION")
        .when((rate >= 0.3) & (concentration >= 0.7) & (lift >= 2), "SUSPICIOUS")
        .when(rate >= 0.3, "PERTURBATION_SENSITIVE")
        .otherwise("STABLE")
    )
    return met.select("trigger_name", "n", "flips", "target", F.round(rate, 6).alias("flip_rate"), F.round(concentration, 6).alias("concentration"), F.round(lift, 6).alias("lift"), verdict.alias("verdict"))


def backdoor_confidence(scored: DataFrame) -> DataFrame:
    """One row of ``trigger_responses``: confidence in a backdoor, and the target and trigger that best speak for it.

    A trigger scores flip rate times concentration times min(1, lift / 5); .2 to .8 becomes 0 to 1, .95 at most.
    """
    score = F.col("flip_rate") * F.col("concentration") * F.least(F.lit(1.0), F.col("lift") / 5)
    strong = F.col("verdict").isin("STRONG_BACKDOOR_INDICATION", "SUSPICIOUS")
    best = scored.agg(F.max(F.when(strong, F.struct(score.alias("score"), "target", "trigger_name"))).alias("b"))
    sure = F.coalesce(F.least(F.lit(0.95), F.greatest(F.lit(0.0), (F.col("b.score") - 0.2) / 0.6)), F.lit(0.0))
    return best.select(F.round(sure, 6).alias("confidence"), F.when(sure > 0, F.col("b.target")).alias("target"), F.when(sure > 0, F.col("b.trigger_name")).alias("trigger_name"))


def mask_anomalies(rows: DataFrame) -> DataFrame:
    """Classes whose mask is far smaller than the model's median. Columns: model, cls, l1_norm, attack_success."""
    mid = quantiles(rows, ["model"], "l1_norm", {"mid": 0.5}).select(F.col("model").alias("m_model"), "mid", F.col("n").alias("classes")).filter("classes >= 3")
    away = rows.join(mid, F.col("model") == F.col("m_model")).withColumn("d", F.abs(F.col("l1_norm") - F.col("mid")))
    mad = quantiles(away, ["model"], "d", {"mad": 0.5}).select(F.col("model").alias("d_model"), "mad")
    met = away.join(mad, F.col("model") == F.col("d_model"))
    index = F.when(F.col("mad") > 0, F.col("d") / (1.4826 * F.col("mad"))).otherwise(0.0)
    ratio = F.col("l1_norm") / F.col("mid")
    flag = (F.col("attack_success") >= 0.85) & ((ratio <= 0.35) | ((index > 2) & (ratio <= 0.55)))
    return met.select("model", "cls", F.round(index, 6).alias("anomaly_index"), F.round(ratio, 6).alias("l1_ratio"), flag.alias("flagged"))


def tensor_statistics(rows: DataFrame) -> DataFrame:
    """By tensor: count, finite moments, extremes, zero share of finite values, non-finite count, share of outlying rows.

    Columns: tensor, row_idx, x. A row outlies if the modified z of its norm (non-finite values as 0)
    within the tensor is beyond 8, in tensors of more than 4 rows. Without finite values moments are 0.
    """
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    good = F.when(~bad, F.col("x"))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    base = rows.groupBy("tensor").agg(
        F.count("*").alias("n"), zero(F.avg(good)).alias("mean"), zero(F.stddev_pop(good)).alias("std"), zero(F.min(good)).alias("low"), zero(F.max(good)).alias("high"),
        zero(F.count_if(good == 0) / F.nullif(F.count(good), F.lit(0))).alias("zero_share"), F.count_if(bad).alias("non_finite"),
    )
    norms = materialise(rows.groupBy("tensor", "row_idx").agg(F.sqrt(F.coalesce(F.sum(good * good), F.lit(0.0))).alias("norm")), "norms")
    mid = quantiles(norms, ["tensor"], "norm", {"mid": 0.5}).select(F.col("tensor").alias("m_tensor"), F.col("n").alias("rows"), "mid")
    away = norms.join(mid, F.col("tensor") == F.col("m_tensor")).select("tensor", "rows", F.abs(F.col("norm") - F.col("mid")).alias("far"))
    mad = quantiles(away, ["tensor"], "far", {"mad": 0.5}).select(F.col("tensor").alias("d_tensor"), (F.col("mad") + 1e-9).alias("mad"))
    odd = away.join(mad, F.col("tensor") == F.col("d_tensor")).groupBy(F.col("tensor").alias("o_tensor")).agg(F.when(F.max("rows") > 4, F.count_if(0.6745 * F.col("far") / F.col("mad") > 8) / F.count("*")).otherwise(0.0).alias("outlier_rows"))
    return base.join(odd, F.col("tensor") == F.col("o_tensor"), "left").drop("o_tensor").withColumn("outlier_rows", F.round("outlier_rows", 6))


def weight_reports(tensors: DataFrame) -> DataFrame:
    """By model: tensors, those non-finite, dead, extreme, with outlying rows and of low rank, and an anomaly score of at most 1.

    Columns: model, tensor, n, std, low, high, non_finite, outlier_rows and spectral_ratio (null if not known).
    """
    dead = (F.col("std") == 0) & (F.col("n") > 64) & ~F.contains(F.lower("tensor"), F.lit("bias"))
    extreme = (F.abs("high") > 1e4) | (F.abs("low") > 1e4)
    low_rank = F.coalesce((F.col("spectral_ratio") > 0.85) & (F.col("n") > 4096), F.lit(False))
    per = tensors.groupBy("model").agg(
        F.count("*").alias("tensors"), F.count_if(F.col("non_finite") > 0).alias("non_finite"), F.count_if(dead).alias("dead"), F.count_if(extreme).alias("extreme"),
        F.count_if((F.col("outlier_rows") > 0) & (F.col("n") > 1000)).alias("outlying"), F.count_if(low_rank).alias("low_rank"),
    )
    part = lambda c, slope, cap: F.least(F.lit(cap), F.col(c) / F.col("tensors") * slope)
    score = F.when(F.col("non_finite") > 0, 0.6).otherwise(0.0) + part("dead", 2.0, 0.2) + part("extreme", 2.0, 0.15) + part("outlying", 1.5, 0.2) + part("low_rank", 1.0, 0.1)
    return per.withColumn("anomaly_score", F.round(F.least(F.lit(1.0), score), 6))


def spectral_ratios(rows: DataFrame, side: int = 512) -> DataFrame:
    """tensor and spectral_ratio: the largest singular value over the Frobenius norm of its first ``side`` rows and columns.

    Columns: tensor, row_idx, values (array). The slice is cut before it is grouped, so a group is bounded.
    Non-finite values count as 0. Tensors of one row or one column have none.
    """
    place = F.row_number().over(Window.partitionBy("tensor").orderBy("row_idx"))
    cut = rows.withColumn("place", place).filter(F.col("place") <= side).select("tensor", "place", F.transform(F.slice("values", 1, side), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double"))).alias("v"))

    def solve(table: pa.Table) -> pa.Table:
        x = np.stack(table.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
        ratio = None
        if min(x.shape) >= 2:
            singular = np.linalg.svd(x, compute_uv=False)
            ratio = round(float(singular[0] / (np.sqrt((singular**2).sum()) + 1e-9)), 6)
        return pa.table({"tensor": table.column("tensor")[:1].cast(pa.string()), "spectral_ratio": pa.array([ratio], pa.float64())})

    return cut.groupBy("tensor").applyInArrow(solve, "tensor string, spectral_ratio double")


def import_verdicts(references: DataFrame, critical: list[str], allowed: list[str]) -> DataFrame:
    """Verdict of each checkpoint by its import references.

    Columns: checkpoint, module, name, stream_truncated, container. Lists hold modules or module.name.
    """
    full = F.concat_ws(".", "module", "name")
    is_in = lambda names: F.col("module").isin(names) | full.isin(names)
    rank = F.when(is_in(critical) | F.col("stream_truncated"), 2).when((F.col("container") != "zip") | ~is_in(allowed), 1).otherwise(0)
    worst = references.groupBy("checkpoint").agg(F.max(rank).alias("worst"), F.count_if(rank > 0).alias("findings"))
    return worst.select("checkpoint", F.when(F.col("worst") == 2, "MALICIOUS").when(F.col("worst") == 1, "SUSPICIOUS").otherwise("CLEAN").alias("verdict"), "findings")


def operator_risk(nodes: DataFrame, suspicious: list[str], domains: list[str]) -> DataFrame:
    """By model: min(.5, .15 suspicious operators) + min(.3, .05 orphans) + .2 for a custom domain, at most 1."""
    per = nodes.groupBy("model").agg(F.count_distinct(F.when(F.col("op_type").isin(suspicious), F.col("op_type"))).alias("suspicious"), F.count_if("is_orphan").alias("orphans"), F.coalesce(F.bool_or(~F.col("domain").isin(domains)), F.lit(False)).alias("custom"))
    score = F.least(F.lit(0.5), F.col("suspicious") * 0.15) + F.least(F.lit(0.3), F.col("orphans") * 0.05) + F.when(F.col("custom"), 0.2).otherwise(0.0)
    return per.withColumn("score", F.round(F.least(F.lit(1.0), score), 6))


def prediction_diversity(rows: DataFrame) -> DataFrame:
    """Best resolution of each model: entropy less 2.5 max(0, confidence - .95). Columns: model, resolution, cls, confidence."""
    counted = rows.groupBy("model", "resolution", "cls").agg(F.count("*").alias("c"), F.sum("confidence").alias("conf"))
    whole = Window.partitionBy("model", "resolution")
    p = F.col("c") / F.sum("c").over(whole)
    per = counted.select("model", "resolution", "c", "conf", (-p * F.log2(p)).alias("h")).groupBy("model", "resolution").agg(F.sum("h").alias("entropy"), F.count("*").alias("classes"), (F.sum("conf") / F.sum("c")).alias("confidence"))
    score = F.col("entropy") - 2.5 * F.greatest(F.lit(0.0), F.col("confidence") - 0.95)
    best = per.withColumn("score", score).groupBy("model").agg(F.max(F.struct(F.round("score", 9).alias("score"), "resolution", "classes", F.round("entropy", 6).alias("entropy"))).alias("b"))
    return best.select("model", "b.resolution", "b.classes", "b.entropy", F.round("b.score", 6).alias("score"))
