from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from probity.operators import monitoring, provenance
from probity.streaming import monitor

T0 = datetime.datetime(2024, 1, 1)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def streamed(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_tumbling_counts_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    h = lambda x: T0 + datetime.timedelta(hours=x)
    events = streamed(spark, tmp_path, [[(h(0.1), "a", 1.0), (h(0.2), "a", 2.0)], [(h(9), "a", 1.0)], [(h(9.5), "a", 1.0)], [(h(0.3), "a", 5.0), (h(30), "b", 1.0)]], schema)
    got = {(r.window_start, r.event_type): (r.n, r.total) for r in drained(monitor.tumbling_counts(events), "tumbling")}
    assert got[(h(0), "a")] == (2, 3.0)


def test_nonce_guard_equals_batch_order(spark, tmp_path):
    schema = "nonce string, record_id long, record_hash string, ts timestamp"
    batches = [[("n1", 1, "x", T0), ("n2", 2, "x", T0)], [("n1", 3, "x", T0)], [("n1", 4, "y", T0)]]
    got = {r.record_id: r.verdict for r in drained(monitor.nonce_verdicts(streamed(spark, tmp_path, batches, schema)), "nonces")}
    assert got == {1: "OK", 2: "OK", 3: "REPLAY", 4: "NONCE_REUSE"}


def test_baseline_stream_equals_batch(spark, tmp_path):
    rows = [("s", T0 + datetime.timedelta(hours=i), float(i % 3) if i < 12 else 40.0) for i in range(14)]
    stream = streamed(spark, tmp_path, [rows[:5], rows[5:]], "sensor string, at timestamp, signal double")
    got = [(r.at, round(r.z, 6), r.status) for r in sorted(drained(monitor.baseline_stream(stream), "baseline"), key=lambda r: r.at)]
    batch = monitoring.baselines(spark.createDataFrame(rows, "sensor string, at timestamp, signal double").withColumn("hard", F.lit(False)), "sensor").orderBy("at").collect()
    assert got == [(r.at, r.z, r.status) for r in batch] and got[12][2] == "ALERT"


def test_one_stream_gives_all_verdicts_of_records(spark, tmp_path):
    schema = "nonce string, record_id long, record_hash string, input_hash string, model_hash string, prediction string, ts timestamp, received_at timestamp"
    h = lambda x: T0 + datetime.timedelta(hours=x)
    row = lambda nonce, i, digest, inp, pred, at, got=None: (nonce, i, digest, inp, "m", pred, h(at), h(at if got is None else got))
    batches = [
        [row("n1", 1, "x", "i1", "cat", 0), row("n2", 2, "y", "i2", "dog", 0.1), row("n3", 3, "z", "i1", "dog", 0.2)],
        [row("n1", 4, "x", "i1", "cat", 1), row("n2", 5, "q", "i1", "cow", 1), row("n4", 6, "w", "i3", "cat", 1, 30), row("n5", 7, "v", "i3", "cat", 1.5)],
        [row("n6", 8, "u", "i2", "cat", 2), row("n7", 9, "t", "i2", "dog", 2.5)],
    ]
    got = {r.record_id: r.verdict for r in drained(monitor.record_verdicts(streamed(spark, tmp_path, batches, schema)), "verdicts")}
    batch = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {r.record_id: r.verdict for r in provenance.replay_verdicts(batch).collect()}
    assert got == want and set(got.values()) == {"OK", "REPLAY", "NONCE_REUSE", "SUBSTITUTION", "STALE"}


def test_events_to_scored_readings_in_one_stream(spark, tmp_path):
    m = lambda x: T0 + datetime.timedelta(minutes=x)
    rng = random.Random(3)
    attempts = [(m(15 * w + rng.random() * 14), f"u{rng.randrange(3)}", rng.random() < 0.3) for w in range(14) for _ in range(6)] + [(m(15 * 12 + k), "u9", True) for k in range(9)]
    records = [(m(15 * w + 3), rng.choice(["VERIFIED", "VERIFIED", "FORGED"])) for w in range(14)]
    found = [(m(15 * w + 5), rng.choice(["SEC-X", "DATA"]), rng.choice(["CRITICAL", "LOW"])) for w in range(14)]
    ran = [(m(15 * w + k), "engine", "DONE") for w in range(14) for k in range(w % 4 + 1)]
    schemas = {"auth": "ts timestamp, identifier string, failed boolean", "provenance": "ts timestamp, status string", "supply_chain": "ts timestamp, category string, severity string", "traffic": "ts timestamp, engine string, status string"}
    rows = {"auth": attempts, "provenance": records, "supply_chain": found, "traffic": ran}
    last = m(15 * 40)  # moves every watermark past all windows
    ends = {"auth": (last, "u", False), "provenance": (last, "VERIFIED"), "supply_chain": (last, "DATA", "LOW"), "traffic": (last, "engine", "DONE")}
    cut = m(15 * 7)
    streams = {k: streamed(spark, tmp_path / k, [[r for r in v if r[0] < cut], [r for r in v if r[0] >= cut], [ends[k]]], schemas[k]) for k, v in rows.items()}
    got = sorted((r.sensor, r.at, r.signal, round(r.z, 6), r.status) for r in drained(monitor.scored_readings(streams), "scored") if r.at < last)
    frames = {k: spark.createDataFrame(v, schemas[k]) for k, v in rows.items()}
    none = spark.createDataFrame([], "ts timestamp")
    batch = monitoring.sensor_readings(frames["auth"], frames["provenance"], frames["supply_chain"], frames["traffic"], none, spark.createDataFrame([], "broken boolean")).filter("window_start is not null")
    want = monitoring.baselines(batch.select("sensor", F.col("window_start").alias("at"), F.col("signal").cast("double").alias("signal"), (F.col("severity") != "INFO").alias("hard")), "sensor")
    assert got == sorted((r.sensor, r.at, r.signal, r.z, r.status) for r in want.collect()) and {r[4] for r in got} >= {"ALERT", "CALIBRATING", "NOMINAL"}


def test_late_row_joins_two_sessions(spark, tmp_path):
    m = lambda x: T0 + datetime.timedelta(minutes=x)
    events = streamed(spark, tmp_path, [[("a", m(0)), ("a", m(5))], [("a", m(25)), ("b", m(20))], [("a", m(15))], [("z", m(600))]], "who string, ts timestamp")
    got = sorted((r.who, r.started, r.ended, r.n) for r in drained(monitor.session_stream(events, "who", "11 minutes", "1 hour"), "sessions"))
    assert got == [("a", m(0), m(36), 4), ("b", m(20), m(31), 1)]


def test_static_register_failures_and_first_claims(spark, tmp_path):
    m = lambda x: T0 + datetime.timedelta(minutes=x)
    register = spark.createDataFrame([("c1", 80)], "contributor string, risk int")
    findings = streamed(spark, tmp_path / "f", [[("c1", 1)], [("c2", 2)]], "contributor string, finding_id long")
    assert {(r.contributor, r.finding_id, r.risk) for r in drained(monitor.enriched(findings, register, "contributor"), "enriched")} == {("c1", 1, 80), ("c2", 2, None)}
    events = streamed(spark, tmp_path / "e", [[(m(1), True), (m(2), False)], [(m(20), False)], [(m(300), False)]], "ts timestamp, failed boolean")
    got = {r.window_start: (r.events, r.failures, r.severity) for r in drained(monitor.sensor_stream(events), "failures")}
    assert got[m(0)] == (2, 1, "MEDIUM") and got[m(15)] == (1, 0, "INFO")
    claims = streamed(spark, tmp_path / "c", [[("n", 1, m(0))], [("n", 2, m(1)), ("k", 3, m(1))]], "nonce string, record_id long, ts timestamp")
    assert {r.record_id for r in drained(monitor.first_claims(claims), "claims")} == {1, 3}
