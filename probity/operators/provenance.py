"""Prediction records and hash-chained logs."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUND = ("record_id", "input_hash", "model_identifier", "model_hash", "config_json", "prediction", "confidence", "ts", "nonce")


def _number(x: float) -> str:
    """A double as ECMAScript writes it."""
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    digits, power = repr(abs(x)), 0
    if "e" in digits:
        digits, _, exp = digits.partition("e")
        power = int(exp)
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    figures = (whole + part).lstrip("0")
    point = len(whole) + power - (len(whole + part) - len(figures))
    figures = figures.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    k = len(figures)
    if k <= point <= 21:
        return sign + figures + "0" * (point - k)
    if 0 < point <= 21:
        return sign + figures[:point] + "." + figures[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + figures
    e = point - 1
    return sign + figures[0] + ("." + figures[1:] if k > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))


def canonical(value) -> str:
    """Canonical JSON: sorted keys by UTF-16 units, shortest numbers, least escapes."""
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, (int, float)):
        return _number(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"


@F.pandas_udf(T.StringType())
def canonical_json(column: pd.Series) -> pd.Series:
    """Canonical form of JSON strings; null where a string is no JSON or holds no JSON number."""

    def one(text):
        try:
            return None if text is None else canonical(json.loads(text, parse_constant=lambda c: float(c)))
        except ValueError:
            return None

    return column.map(one)


def bound_digest(prefix: str = "") -> Column:
    """SHA-256 over the bound fields, each with its name, nulls told apart from texts."""
    parts = [F.coalesce(F.concat(F.lit(f"{c}="), F.col(prefix + c).cast("string")), F.lit(f"{c}~")) for c in BOUND]
    return F.sha2(F.concat_ws("|", *parts), 256)


def verified(sealed: DataFrame, presented: DataFrame) -> DataFrame:
    """Status of each presented record and the fields that differ from the sealed one.

    The sealed record carries record_hash and signature_valid (null: unsigned). A right hash with a bad
    signature is FORGED, a wrong hash TAMPERED; no sealed record UNKNOWN.
    """
    s = sealed.select(*[F.col(c).alias(f"s_{c}") for c in (*BOUND, "record_hash", "signature_valid")])
    met = presented.join(s, F.col("record_id") == F.col("s_record_id"), "left")
    same = bound_digest() == F.col("s_record_hash")
    altered = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"s_{c}")), F.lit(c)) for c in BOUND[1:]])), ",")
    status = F.when(F.col("s_record_id").isNull(), "UNKNOWN").when(same & (F.col("s_signature_valid") == F.lit(False)), "FORGED").when(~same, "TAMPERED").otherwise("VERIFIED")
    return met.select("record_id", status.alias("status"), F.when(F.col("s_record_id").isNotNull(), altered).alias("altered"), (F.col("s_record_id").isNotNull() & F.col("s_signature_valid").isNull()).alias("unsigned"))


def replay_verdicts(records: DataFrame, as_of: Column | None = None, skew_hours: int = 24) -> DataFrame:
    """Verdict of each record: REPLAY, NONCE_REUSE, SUBSTITUTION, STALE or OK.

    Columns: record_id, nonce, record_hash, input_hash, model_hash, prediction, ts, received_at. The first
    claim of a nonce, and the earliest prediction of an input by a model among records whose nonce
    stands, bind later ones. A nonce shared by many is one key; claims are firsts, so both steps are
    aggregates joined back rather than windows over a group.
    """
    claim = records.groupBy(F.col("nonce").alias("n_nonce")).agg(F.min(F.struct("ts", "record_id", "record_hash")).alias("first"))
    met = records.join(claim, F.col("nonce") == F.col("n_nonce"), "left")
    later = F.col("record_id") != F.col("first.record_id")
    nonce = F.when(later & (F.col("record_hash") == F.col("first.record_hash")), "REPLAY").when(later, "NONCE_REUSE")
    marked = met.withColumn("nonce_verdict", nonce).drop("first", "n_nonce")
    bound = marked.filter("nonce_verdict is null").groupBy(F.col("input_hash").alias("b_input"), F.col("model_hash").alias("b_model")).agg(F.min_by("prediction", F.struct("ts", "record_id")).alias("b_prediction"))
    met = marked.join(bound, (F.col("input_hash") == F.col("b_input")) & (F.col("model_hash") == F.col("b_model")), "left")
    at = as_of if as_of is not None else F.col("received_at")
    stale = F.col("ts").isNull() | (F.abs(F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) > skew_hours * 3_600_000_000)
    verdict = F.when(F.col("nonce_verdict").isNotNull(), F.col("nonce_verdict")).when(F.col("prediction") != F.col("b_prediction"), "SUBSTITUTION").when(stale, "STALE").otherwise("OK")
    return met.select("record_id", verdict.alias("verdict"))


def verified_chain(blocks: DataFrame, key: str) -> DataFrame:
    """First break of each chain, its reason, and blocks before it.

    Columns: key, sequence, payload, previous_hash, current_hash, signature_valid. A block's hash is the
    SHA-256 of the previous hash and the payload. Each block meets the one before by equality of
    sequence, so a long chain is no single task.
    """
    prior = blocks.select(F.col(key).alias("p_key"), (F.col("sequence") + 1).alias("p_next"), F.col("current_hash").alias("p_hash"), F.lit(True).alias("p_known"))
    twice = blocks.groupBy(F.col(key).alias("t_key"), F.col("sequence").alias("t_sequence")).agg(F.count("*").alias("copies"))
    met = blocks.join(prior.groupBy("p_key", "p_next").agg(F.min("p_hash").alias("p_hash"), F.min("p_known").alias("p_known")), (F.col(key) == F.col("p_key")) & (F.col("sequence") == F.col("p_next")), "left")
    met = met.join(twice, (F.col(key) == F.col("t_key")) & (F.col("sequence") == F.col("t_sequence")))
    digest = F.sha2(F.concat(F.coalesce("previous_hash", F.lit("")), F.coalesce("payload", F.lit(""))), 256)
    reason = (
        F.when(~F.coalesce(F.col("current_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "MALFORMED_HASH")
        .when((F.col("sequence") < 1) | (F.col("copies") > 1) | ((F.col("sequence") > 1) & F.col("p_known").isNull()), "SEQUENCE_GAP")
        .when((F.col("sequence") > 1) & ~F.col("previous_hash").eqNullSafe(F.col("p_hash")), "BROKEN_LINK")
        .when(digest != F.col("current_hash"), "DIGEST_MISMATCH")
        .when(F.col("signature_valid") == F.lit(False), "BAD_SIGNATURE")
    )
    judged = met.withColumn("reason", reason)
    out = judged.groupBy(key).agg(F.count("*").alias("blocks"), F.min(F.when(F.col("reason").isNotNull(), F.struct("sequence", "reason"))).alias("first"), F.count_if(F.col("signature_valid")).alias("signed"))
    return out.select(key, "blocks", "signed", F.col("first.sequence").alias("broken_at"), F.col("first.reason").alias("reason"), F.when(F.col("first").isNull(), F.col("blocks")).otherwise(F.col("first.sequence") - 1).alias("verified"))


def link_map(blocks: DataFrame, key: str) -> DataFrame:
    """For each block whether it links to the one before; the first does."""
    order = Window.partitionBy(key).orderBy("sequence")
    before = F.lag("current_hash").over(order)
    return blocks.select(key, "sequence", (before.isNull() | before.eqNullSafe(F.col("previous_hash"))).alias("linked"))
