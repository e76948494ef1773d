"""Windowed sensors, their baselines, and lock-outs from event logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.schemas import DEFAULT, Thresholds
from probity.storage import materialise


def sensor_counts(events: DataFrame, width: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Counts of each window: events, errors, worst identifier's errors, and severity by hard rules.

    Columns: ts, identifier, failed (boolean). Errors are first counted by identifier, so no window's
    rows meet in one task.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    per = events.groupBy(window.alias("w"), "identifier").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    out = per.groupBy("w").agg(F.sum("n").alias("events"), F.sum("failed").alias("failures"), F.max("failed").alias("worst"))
    severity = F.when(F.col("worst") >= 5, "HIGH").when(F.col("failures") > 0, "MEDIUM").otherwise("INFO")
    return out.select(F.col("w.start").alias("window_start"), "events", "failures", "worst", severity.alias("severity"))


def baselines(observations: DataFrame, key: str, t: Thresholds = DEFAULT) -> DataFrame:
    """EWMA state of each observation: z against the state before it, mean, variance, status.

    Columns: key (a string, null being one of its own), at, signal (not null), hard (boolean: a rule that no calibration
    softens). Observations go by time, then signal. Rows are dealt by range of key and time, so that a long key is many
    segments. What a segment does to the state it begins with is a mean linear in the mean and a variance quadratic in
    it, six numbers taken around the segment's first signal; along a key these are composed, and
    every segment is then scored from its own beginning.
    """
    a, warm = t.ewma_alpha, t.ewma_warm

    def effect(table: pa.Table) -> pa.Table:
        """From (mean, var) before: mean = c + p d + m and var = p var + v0 + v1 d + v2 d d, with d = mean - c; and both if the key begins here."""
        x = table.sort_by([("at", "ascending"), ("signal", "ascending")]).column("signal").to_numpy()
        c = float(x[0])
        p, m, v0, v1, v2, mean, var = 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
        for k, off in enumerate((x - c).tolist()):
            u = off - m
            v0, v1, v2 = (1 - a) * v0 + a * u * u, (1 - a) * v1 - 2 * a * u * p, (1 - a) * v2 + a * p * p
            p, m = (1 - a) * p, (1 - a) * m + a * off
            if k:
                var, mean = (1 - a) * var + a * (off - mean) ** 2, (1 - a) * mean + a * off
        row = {"segment": table.column("segment")[0].as_py(), "k": table.column("k")[0].as_py(), "n": table.num_rows, "c": c, "p": p, "m": m, "v0": v0, "v1": v1, "v2": v2, "mean": c + mean, "var": var}
        return pa.table({name: pa.array([v], pa.string() if name == "k" else pa.int64() if name in ("segment", "n") else pa.float64()) for name, v in row.items()})

    def begins(table: pa.Table) -> pa.Table:
        """The state before each of a key's segments, of which there are at most as many as tasks."""
        out = []
        for r in table.sort_by("segment").to_pylist():
            mean, var, n = (out[-1][1]) if out else (0.0, 0.0, 0)
            d = mean - r["c"]
            after = (r["mean"], r["var"], r["n"]) if not out else (r["c"] + r["p"] * d + r["m"], r["p"] * var + r["v0"] + r["v1"] * d + r["v2"] * d * d, n + r["n"])
            out.append(((r["segment"], mean, max(var, 0.0), n), after))
        columns = zip(("b_segment", "mean0", "var0", "n0"), zip(*[x for x, _ in out], strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)
        return pa.table({"b_k": pa.array([table.column("k")[0].as_py()] * len(out), pa.string()), **{name: pa.array(x, kind) for name, x, kind in columns}})

    def fold(table: pa.Table, begin: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("signal", "ascending")])
        mean, var, n0 = (begin.column(c)[0].as_py() for c in ("mean0", "var0", "n0"))
        rows = []
        for n, x in enumerate(table.column("signal").to_pylist(), n0):
            off = x - mean
            z = off / max(var**0.5, 1.0) if n >= warm else 0.0
            mean, var = (x, 0.0) if n == 0 else ((1 - a) * mean + a * x, (1 - a) * var + a * off * off)
            rows.append((z, mean, var, n))
        columns = zip(("z", "mean", "var", "n"), zip(*rows, strict=True), (pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)
        return pa.table({**{c: table.column(c) for c in ("k", "at", "signal", "hard")}, **{name: pa.array(x, kind) for name, x, kind in columns}})

    rows = observations.select(F.col(key).cast("string").alias("k"), F.col("at").cast("timestamp").alias("at"), F.col("signal").cast("double").alias("signal"), "hard")
    rows = materialise(rows.repartitionByRange("k", "at", "signal").withColumn("segment", F.spark_partition_id().cast("long")), "segments")
    effects = rows.groupBy("segment", "k").applyInArrow(effect, "segment long, k string, n long, c double, p double, m double, v0 double, v1 double, v2 double, mean double, var double")
    states = effects.groupBy("k").applyInArrow(begins, "b_k string, b_segment long, mean0 double, var0 double, n0 long")
    each = rows.groupBy("segment", "k").cogroup(states.groupBy("b_segment", "b_k")).applyInArrow(fold, "k string, at timestamp, signal double, hard boolean, z double, mean double, var double, n long")
    status = F.when(F.col("hard"), "ALERT").when(F.col("n") < warm, "CALIBRATING").when(F.col("z") >= 4, "ALERT").when(F.col("z") >= 2, "ELEVATED").otherwise("NOMINAL")
    return each.select(F.col("k").alias(key), "at", "signal", F.round("z", 6).alias("z"), F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"), status.alias("status"))


def lockouts(attempts: DataFrame, as_of, minutes: int = 15, free: int = 5) -> DataFrame:
    """By identifier: failures within ``minutes`` before ``as_of``, when the lock ends, and if it holds.

    The lock is min(30 min, 2^(f - 5) 30 s) after the last failure, from five failures on.
    """
    recent = attempts.filter(~F.col("successful") & (F.col("attempted_at") > as_of - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("attempted_at") <= as_of))
    per = recent.groupBy("identifier").agg(F.count("*").alias("failures"), F.max("attempted_at").alias("last_failure")).filter(F.col("failures") >= free)
    wait = F.least(F.lit(1800.0), F.pow(F.lit(2.0), F.col("failures") - free) * 30.0).cast("int")
    return per.select("identifier", "failures", "last_failure", wait.alias("lock_seconds"), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_failure").cast("timestamp")) < wait * 1_000_000).alias("locked"))


def latest_observation(observations: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The newest observation of each sensor."""
    return observations.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("last")).select(key, "last.*")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of each key, closed by a gap."""
    per = events.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return per.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def retained(rows: DataFrame, order: str, ties: list[str], newest: int) -> DataFrame:
    """The newest rows of a log."""
    return rows.orderBy(F.desc(order), *ties).limit(newest)


def kept_since(rows: DataFrame, time: str, as_of, days: int = 30) -> DataFrame:
    """The rows of a log of the last ``days`` before ``as_of``."""
    return rows.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def sensor_readings(attempts: DataFrame, records: DataFrame, findings: DataFrame, analyses: DataFrame, errors: DataFrame, chains: DataFrame, width: str = "15 minutes") -> DataFrame:
    """window_start, sensor, signal and severity of every window in which one of six sensors has rows.

    ``attempts``: ts, identifier, failed; ``records``: ts, status; ``findings``: ts, category, severity;
    ``analyses``: ts, engine, status; ``errors``: ts; ``chains``: broken (boolean), which has no time: its
    one reading has no window. Severity is INFO where no hard rule holds. Logins are counted by
    identifier first, so that no window's rows meet in one task.
    """
    window = F.window("ts", width)["start"].alias("window_start")
    signal = lambda rows, cond: rows.groupBy(window).agg(F.count_if(cond).alias("signal"))
    out = lambda rows, name, severity: rows.select("window_start", F.lit(name).alias("sensor"), "signal", severity.alias("severity"))
    info = F.lit("INFO")
    login = sensor_counts(attempts, width).select("window_start", F.col("failures").alias("signal"), "worst")
    bad = F.col("status").isin("TAMPERED", "REPLAYED", "FORGED")
    critical = F.col("severity") == "CRITICAL"
    supply = findings.groupBy(window).agg(F.count_if(critical).alias("signal"), F.count_if(critical & (F.col("category").startswith("SEC-") | (F.col("category") == "SUPPLY_CHAIN"))).alias("hostile"))
    failed = (F.col("engine") == "fallback") | F.contains("status", F.lit("FAIL"))
    ran = analyses.filter(failed).select("ts").union(errors.select("ts")).groupBy(window).agg(F.count("*").alias("signal"))
    broken = chains.agg(F.count_if("broken").alias("signal")).select(F.lit(None).cast("timestamp").alias("window_start"), F.when(F.col("signal") > 0, 1).otherwise(0).cast("long").alias("signal"))
    return (
        out(login, "auth", F.when(F.col("worst") >= 5, "HIGH").otherwise(info))
        .union(out(signal(records, bad), "provenance", F.when(F.col("signal") > 0, "HIGH").otherwise(info)))
        .union(out(broken, "ledger", F.when(F.col("signal") > 0, "CRITICAL").otherwise(info)))
        .union(out(supply, "supply_chain", F.when(F.col("hostile") > 0, "CRITICAL").when(F.col("signal") > 0, "HIGH").otherwise(info)))
        .union(out(signal(analyses, F.lit(True)), "traffic", info))
        .union(out(ran, "operations", F.when(F.col("signal") > 0, "HIGH").otherwise(info)))
    )
