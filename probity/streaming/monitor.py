"""Streaming forms of windowed counts, enrichment, replay checks and sensor baselines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from probity.schemas import DEFAULT


def event_stream(spark, folder: str, schema, pattern: str = "events.parquet") -> DataFrame:
    """Parquet files of a folder as a stream, with ``ts`` as an instant."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each window and type; a window is final when the watermark passes it, later rows are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sensor_stream(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Failures of each window. Columns: ts, failed."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("events"), F.count_if("failed").alias("failures"))
    return counted.select(F.col("w.start").alias("window_start"), "events", "failures", F.when(F.col("failures") > 0, "MEDIUM").otherwise("INFO").alias("severity"))


def enriched(findings: DataFrame, register: DataFrame, key: str) -> DataFrame:
    """Findings of a stream with the static register's row of their ``key``."""
    return findings.join(register, key, "left")


def first_claims(records: DataFrame, late: str = "24 hours") -> DataFrame:
    """Records whose nonce was not seen within the watermark: exact replays go."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["nonce"])


DAY_MS = 86_400_000
RECORD = ("record_id", "record_hash", "input_hash", "model_hash", "prediction", "ts", "received_at")


class NonceGuard(StatefulProcessor):
    """Adds to each record of a nonce a verdict against the first claim, which is kept for a day of event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "record_id long, record_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "record_id"])
        claim = self.claim.get() if self.claim.exists() else None
        verdict = []
        for record_id, record_hash in zip(batch["record_id"].tolist(), batch["record_hash"].tolist(), strict=True):
            if claim is None:
                claim = (record_id, record_hash)
                self.claim.update(claim)
                self.handle.registerTimer(int(batch["ts"].iloc[0].timestamp() * 1000) + DAY_MS)
            verdict.append("OK" if claim[0] == record_id else "REPLAY" if claim[1] == record_hash else "NONCE_REUSE")
        yield batch.drop(columns="nonce").assign(verdict=verdict)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.claim.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _claimed(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Records of a stream (nonce and ``columns``) with verdict; ``ts`` stays the event time of what follows."""
    types = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in columns)
    late = records.select("nonce", *columns).withWatermark("ts", "24 hours")
    return late.groupBy("nonce").transformWithStateInPandas(statefulProcessor=NonceGuard(), outputStructType=f"{types}, verdict string", outputMode="append", timeMode="eventTime", eventTimeColumnName="ts")


def nonce_verdicts(records: DataFrame) -> DataFrame:
    """record_id and verdict of a stream of records (nonce, record_id, record_hash, ts). Needs the RocksDB state store."""
    return _claimed(records, ("record_id", "record_hash", "ts")).select("record_id", "verdict")


class BindingGuard(StatefulProcessor):
    """Verdict of each accepted record of an (input, model) pair against the pair's first prediction, kept for a day of event time.

    Records that the nonce guard rejected bind nothing and keep its verdict.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "prediction string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "record_id"])
        accepted = batch["verdict"] == "OK"
        first = self.first.get()[0] if self.first.exists() else None
        if first is None and accepted.any():
            first = batch.loc[accepted, "prediction"].iloc[0]
            self.first.update((first,))
            self.handle.registerTimer(int(batch["ts"].iloc[0].timestamp() * 1000) + DAY_MS)
        other = accepted & (batch["prediction"] != first)
        yield pd.DataFrame({"record_id": batch["record_id"], "verdict": batch["verdict"].mask(other, "SUBSTITUTION").mask(accepted & ~other & batch["stale"], "STALE")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        yield pd.DataFrame([], columns=["record_id", "verdict"])

    def close(self) -> None:
        pass


def _bound(claimed: DataFrame) -> DataFrame:
    return claimed.groupBy("input_hash", "model_hash").transformWithStateInPandas(statefulProcessor=BindingGuard(), outputStructType="record_id long, verdict string", outputMode="append", timeMode="eventTime")


def binding_verdicts(records: DataFrame) -> DataFrame:
    """record_id and OK or SUBSTITUTION of a stream of accepted records (input_hash, model_hash, record_id, prediction, ts)."""
    late = records.select("input_hash", "model_hash", "record_id", "prediction", "ts").withWatermark("ts", "24 hours")
    return _bound(late.withColumns({"verdict": F.lit("OK"), "stale": F.lit(False)}))


def record_verdicts(records: DataFrame) -> DataFrame:
    """record_id and OK, REPLAY, NONCE_REUSE, SUBSTITUTION or STALE of a stream of records (nonce and ``RECORD``), in one query of two guards.

    A record is stale if it was received over a day from its time. Claims and bindings end a day of event time after
    they were made. Rows without ts have no event time and are dropped.
    """
    stale = F.abs(F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros("ts")) > DAY_MS * 1000
    claimed = _claimed(records.filter(F.col("ts").isNotNull()), RECORD).withColumn("stale", F.coalesce(stale, F.lit(True)))
    return _bound(claimed)


def reading_stream(sources: dict[str, DataFrame], width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """window_start, sensor, signal and severity of final windows, from streams of events by sensor.

    auth: ts, identifier, failed; provenance: ts, status; ledger: ts, broken; supply_chain: ts, category, severity; traffic: ts;
    operations: ts of failures. Sources that are absent give nothing. Failed logins are first counted by identifier.
    """
    none = F.lit(None).cast("string").alias("identifier")
    shapes = {
        "auth": lambda d: (F.col("identifier").cast("string").alias("identifier"), F.col("failed"), F.lit(False)),
        "provenance": lambda d: (none, F.col("status").isin("TAMPERED", "REPLAYED", "FORGED"), F.lit(False)),
        "ledger": lambda d: (none, F.col("broken"), F.lit(False)),
        "supply_chain": lambda d: (none, F.col("severity") == "CRITICAL", (F.col("severity") == "CRITICAL") & (F.col("category").startswith("SEC-") | (F.col("category") == "SUPPLY_CHAIN"))),
        "traffic": lambda d: (none, F.lit(True), F.lit(False)),
        "operations": lambda d: (none, F.lit(True), F.lit(False)),
    }
    rows = None
    for sensor, stream in sources.items():
        who, hit, hostile = shapes[sensor](stream)
        one = stream.select("ts", F.lit(sensor).alias("sensor"), who, F.coalesce(hit, F.lit(False)).cast("long").alias("hit"), F.coalesce(hostile, F.lit(False)).cast("long").alias("hostile")).withWatermark("ts", late)
        rows = one if rows is None else rows.union(one)
    per = rows.groupBy(F.window("ts", width).alias("w"), "sensor", "identifier").agg(F.sum("hit").alias("hit"), F.sum("hostile").alias("hostile"))
    whole = per.groupBy(F.window(F.window_time("w"), width).alias("w"), "sensor").agg(F.sum("hit").alias("signal"), F.max("hit").alias("worst"), F.sum("hostile").alias("hostile"))
    some, sensor = F.col("signal") > 0, F.col("sensor")
    severity = (
        F.when(sensor == "auth", F.when(F.col("worst") >= 5, "HIGH").otherwise("INFO"))
        .when(sensor == "supply_chain", F.when(F.col("hostile") > 0, "CRITICAL").when(some, "HIGH").otherwise("INFO"))
        .when((sensor == "ledger") & some, "CRITICAL").when(sensor.isin("provenance", "operations") & some, "HIGH").otherwise("INFO")
    )
    return whole.select(F.col("w.start").alias("window_start"), "sensor", "signal", severity.alias("severity"))


def scored_readings(sources: dict[str, DataFrame], width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Readings of final windows, each scored against its sensor's baseline: sensor, at, signal, z, status. One query from events to verdicts."""
    readings = reading_stream(sources, width, late)
    return baseline_stream(readings.select("sensor", F.col("window_start").alias("at"), F.col("signal").cast("double").alias("signal"), (F.col("severity") != "INFO").alias("hard")))


def session_stream(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Final sessions of each key of a stream (``key``, ts): started, ended and n; a late row within the watermark joins what it bridges."""
    grown = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grown.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


class Baseline(StatefulProcessor):
    """EWMA mean and variance of a sensor; a row is scored against the state before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ewma", "mean double, var double, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("at")
        mean, var, n = self.state.get() if self.state.exists() else (0.0, 0.0, 0)
        a, out = DEFAULT.ewma_alpha, []
        hard = batch["hard"].tolist() if "hard" in batch else [False] * len(batch)
        for at, signal, ruled in zip(batch["at"].tolist(), batch["signal"].tolist(), hard, strict=True):
            z = (signal - mean) / max(var**0.5, 1.0) if n >= DEFAULT.ewma_warm else 0.0
            status = "ALERT" if ruled else "CALIBRATING" if n < DEFAULT.ewma_warm else "ALERT" if z >= 4 else "ELEVATED" if z >= 2 else "NOMINAL"
            off = signal - mean
            mean, var = (signal, 0.0) if n == 0 else ((1 - a) * mean + a * signal, (1 - a) * var + a * off * off)
            n += 1
            out.append((key[0], at, float(signal), z, status))
        self.state.update((float(mean), float(var), n))
        yield pd.DataFrame(out, columns=["sensor", "at", "signal", "z", "status"])

    def close(self) -> None:
        pass


def baseline_stream(observations: DataFrame) -> DataFrame:
    """Scores of a stream of observations (sensor, at, signal and, if rules name some, hard); rows of a micro-batch go in order of time."""
    return observations.groupBy("sensor").transformWithStateInPandas(statefulProcessor=Baseline(), outputStructType="sensor string, at timestamp, signal double, z double, status string", outputMode="append", timeMode="none")
