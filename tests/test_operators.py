from __future__ import annotations

import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from probity.operators import annotations, duplicates, findings, graph, models, monitoring, provenance, risk, shift, vectors
from probity.plans import corpus
from probity.sources import manifest

T0 = datetime.datetime(2024, 1, 1)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(20)] + [(300, 300), (None, 5)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(20)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(80)]
    for v in list(values[:40]):
        for _ in range(rng.randrange(0, 7)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values += values[:3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    first = {}
    for i, v in enumerate(signed):
        first.setdefault(v, i)
    ids = sorted(first.values())
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in ids for j in ids if i < j and (values[i] ^ values[j]).bit_count() <= 5}
    got = {tuple(r) for r in duplicates.near_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, fingerprint long")).collect()}
    assert got == want


def test_splits_and_leaks(spark):
    rows = [(1, "a/training/x.png"), (1, "a/holdout/x.png"), (2, "train/y"), (2, "b/train/z"), (3, "none/q")]
    assert [(r.cluster, r.splits) for r in duplicates.leaks(spark.createDataFrame(rows, "cluster long, path string")).collect()] == [(1, "test,train")]


def test_decision_bands_and_overrides(spark):
    base = {"malicious": False, "failed_records": 0, "backdoor": False, "critical_open": 0, "coverage_gap": False, "n_evidence": 3}
    cases = [(0.0, {}, "ACCEPT"), (29.9, {}, "ACCEPT"), (30.0, {}, "REVIEW"), (69.9, {}, "REVIEW"), (70.0, {}, "QUARANTINE"), (100.0, {}, "QUARANTINE"), (0.0, {"malicious": True}, "QUARANTINE"),
             (0.0, {"failed_records": 1}, "QUARANTINE"), (0.0, {"backdoor": True}, "QUARANTINE"), (0.0, {"critical_open": 2}, "QUARANTINE"), (0.0, {"coverage_gap": True}, "REVIEW"), (0.0, {"n_evidence": 0}, "REVIEW")]
    rows = [{"id": i, "risk": x, **base, **c} for i, (x, c, _) in enumerate(cases)]
    got = {r.id: r.decision for r in risk.governance(spark.createDataFrame(rows)).collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(cases)}


def test_overall_risk_weights(spark):
    rows = [("o", "DATASET", 100.0, T0, 1), ("o", "DATASET", 10.0, T0 - datetime.timedelta(1), 2)]
    out = risk.overall_risk(spark.createDataFrame(rows, "owner_id string, type string, risk_score double, created_at timestamp, analysis_id long"), "owner_id").first()
    assert (out.overall, out.trust) == (35.0, 65.0)


def test_unknown_findings_are_normalised(spark):
    rows = spark.createDataFrame([("X", 1.7), ("HIGH", -0.2)], "severity string, confidence double")
    assert [tuple(r) for r in findings.normalised(rows).collect()] == [("INFO", 1.0), ("HIGH", 0.0)]


def test_shift_statistics(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 1, 300), rng.normal(0.6, 1, 300)
    rows = [(1, "f", 0, float(v)) for v in x] + [(1, "f", 1, float(v)) for v in y]
    grid = np.concatenate([x, y])
    want = max(abs((x <= v).mean() - (y <= v).mean()) for v in grid)
    assert abs(shift.ks_by_feature(spark.createDataFrame(rows, "comparison_id long, feature string, side int, value double")).first().ks - want) < 1e-6
    ones = [("flat", 1.0)] * 100 + [("spike", float(i == 0)) for i in range(100)]
    g = {r.k: r.gini for r in shift.gini(spark.createDataFrame(ones, "k string, v double"), "k", "v").collect()}
    assert g["flat"] == 0 and g["spike"] > 0.9


def test_mmd_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y, z = rng.normal(0, 1, (90, 6)), rng.normal(0, 1, (80, 6)), rng.normal(2.5, 1, (80, 6))
    rows = [(c, i + 1000 * s, s, v.tolist()) for c, other in ((1, y), (2, z)) for s, part in ((0, x), (1, other)) for i, v in enumerate(part)]
    got = {r.comparison_id: r for r in shift.mmd2(spark.createDataFrame(rows, "comparison_id long, id long, side int, v array<double>"), trials=100, block=40).collect()}
    for c, other in ((1, y), (2, z)):
        both = np.concatenate([x, other])
        d2 = ((both[:, None] - both[None]) ** 2).sum(-1)
        gamma = 1 / np.median(d2[np.triu_indices(len(both), 1)])
        k = np.exp(-gamma * d2)
        np.fill_diagonal(k, 0)
        n, m = len(x), len(other)
        want = k[:n, :n].sum() / (n * (n - 1)) + k[n:, n:].sum() / (m * (m - 1)) - 2 * k[:n, n:].mean()
        assert abs(got[c].gamma - gamma) < 1e-9 and abs(got[c].mmd2 - want) < 1e-9
    assert got[1].p_value > 0.05 and got[2].p_value < 0.05


def test_nearest_equals_numpy_and_outliers(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (150, 8))
    df = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, label int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {(r.id, r.place): r.other for r in vectors.nearest(df, 5, block=40).collect()}
    assert all(got[(i, p + 1)] == np.argsort(-s[i], kind="stable")[p] for i in range(150) for p in range(5))
    planted = [(i, 0, rng.normal(0, 0.1, 8).tolist()) for i in range(250)] + [(300 + i, 1, rng.normal(3, 0.1, 8).tolist()) for i in range(250)] + [(900 + i, 0, rng.normal(40, 0.1, 8).tolist()) for i in range(3)]
    flagged = {r.id for r in vectors.mahalanobis(spark.createDataFrame(planted, "id long, label int, v array<double>")).filter("flagged").collect()}
    assert {900, 901, 902} <= flagged and len(flagged) <= 6


def test_label_flips_are_found(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0 if i < 40 else 1 if i < 50 else 1, (rng.normal(0, 0.05, 6) + ([1, 0, 0, 0, 0, 0] if i < 50 else [0, 1, 0, 0, 0, 0])).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    suspects = vectors.label_suspects(df, vectors.nearest(df, 30))
    assert {r.id for r in suspects.collect()} <= set(range(40, 50))


def test_records_and_chain(spark):
    names = provenance.BOUND
    sealed = [dict(zip(names, ("r1", "i", "m", "h", "{}", "STOP", 0.9, T0, "n"), strict=True)), dict(zip(names, ("r2", "i", "m", "h", "{}", "STOP", 0.9, T0, "n"), strict=True)), dict(zip(names, ("r3", "i", "m", "h", "{}", "STOP", 0.9, T0, None), strict=True))]
    schema = "record_id string, input_hash string, model_identifier string, model_hash string, config_json string, prediction string, confidence double, ts timestamp, nonce string"
    clean = spark.createDataFrame([tuple(r.values()) for r in sealed], schema)
    with_hash = clean.withColumn("record_hash", provenance.bound_digest()).withColumn("signature_valid", F.when(F.col("record_id") == "r2", False).when(F.col("record_id") == "r1", True))
    sealed[0]["prediction"] = "SPEED"
    shown = spark.createDataFrame([tuple(r.values()) for r in sealed], schema)
    got = {r.record_id: (r.status, r.altered, r.unsigned) for r in provenance.verified(with_hash, shown).collect()}
    assert got == {"r1": ("TAMPERED", "prediction", False), "r2": ("FORGED", "", False), "r3": ("VERIFIED", "", True)}
    blocks, prior = [], None
    for k in range(1, 6):
        own = hashlib.sha256(((prior or "") + f"p{k}").encode()).hexdigest()
        blocks.append(("c", k, f"p{k}", prior, own, True))
        prior = own
    schema = "chain string, sequence long, payload string, previous_hash string, current_hash string, signature_valid boolean"
    judge = lambda rows: provenance.verified_chain(spark.createDataFrame(rows, schema), "chain").first()
    assert (judge(blocks).reason, judge(blocks).verified) == (None, 5)
    assert judge([*blocks[:2], (*blocks[2][:2], "edited", *blocks[2][3:]), *blocks[3:]]).reason == "DIGEST_MISMATCH"
    assert judge([*blocks[:2], *blocks[3:]]).reason == "SEQUENCE_GAP"


def test_canonical_json(spark):
    cases = {'{"b":1,"a":[1.0,true,null,"\\u00e9"]}': '{"a":[1,true,null,"é"],"b":1}', "1e21": "1e+21", "0.000001": "0.000001", "1e-7": "1e-7", "-0.0": "0", "123456789012345680000": "123456789012345680000", "NaN": None, "{": None, "4.50": "4.5"}
    rows = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r.j: r.c for r in rows.select("j", provenance.canonical_json("j").alias("c")).collect()} == cases


def test_import_operator_and_diversity_tables(spark):
    refs = [("a", "os", "system", False, "zip"), ("b", "torch", "Tensor", False, "zip"), ("c", "odd", "x", False, "zip"), ("d", "torch", "Tensor", True, "zip")]
    got = {r.checkpoint: r.verdict for r in models.import_verdicts(spark.createDataFrame(refs, "checkpoint string, module string, name string, stream_truncated boolean, container string"), ["os.system"], ["torch"]).collect()}
    assert got == {"a": "MALICIOUS", "b": "CLEAN", "c": "SUSPICIOUS", "d": "MALICIOUS"}
    nodes = [("m", "Loop", "", False), ("m", "Conv", "custom", True)]
    assert models.operator_risk(spark.createDataFrame(nodes, "model string, op_type string, domain string, is_orphan boolean"), ["Loop"], [""]).first().score == 0.4
    preds = [("m", 32, c, 0.5) for c in (1, 2)] + [("m", 64, 1, 0.99), ("m", 64, 1, 0.99)]
    assert models.prediction_diversity(spark.createDataFrame(preds, "model string, resolution int, cls int, confidence double")).first().resolution == 32


def test_paths_yolo_and_files(spark, tmp_path):
    names = ["a/b.png", "../x", "/abs", "C:\\x", "a\0b", "", "x/" * 30]
    got = [r.fault for r in spark.createDataFrame([(n,) for n in names], "p string").select(manifest.path_fault(F.col("p")).alias("fault")).collect()]
    assert got == [None, "TRAVERSAL", "ABSOLUTE", "ABSOLUTE", "NUL", "EMPTY", "TOO_DEEP"]
    lines = [("f", 1, "0 0.5 0.5 0.1 0.1"), ("f", 2, "1 1.5 0.5 0.1 0.1"), ("f", 3, "-1 .5 .5 .1 .1"), ("f", 4, "9 .5 .5 .1 .1"), ("f", 5, "x"), ("f", 6, "0 .5 .5 0 .1")]
    yolo = annotations.yolo_defects(spark.createDataFrame(lines, "path string, line_no int, value string"), 2)
    assert {r.line_no: r.defect for r in yolo.collect()} == {2: "coordinates-out-of-range", 3: "negative-class", 4: "class-overflow", 5: "malformed", 6: "degenerate-box"}
    (tmp_path / "a.txt").write_bytes(b"abc")
    row = manifest.scan_corpus(spark, f"file://{tmp_path}").first()
    assert (row.sha256, row.kind) == (hashlib.sha256(b"abc").hexdigest(), "text")


def test_lockout_backoff(spark):
    rows = [("u", False, T0 + datetime.timedelta(seconds=i)) for i in range(6)] + [("v", False, T0)]
    out = monitoring.lockouts(spark.createDataFrame(rows, "identifier string, successful boolean, attempted_at timestamp"), F.lit(T0 + datetime.timedelta(seconds=30))).collect()
    assert [(r.identifier, r.lock_seconds, r.locked) for r in out] == [("u", 60, True)]


def test_equal_fingerprints_of_unequal_content_are_near_copies(spark):
    rows = [(1, 7, "x"), (2, 7, "x"), (3, 7, "y"), (4, 0xFFF << 40, "p"), (5, 0xFFF << 40, "p"), (6, (0xFFF << 40) + 1, "q"), (7, -99, "z"), (8, -99, "z"), *[(100 + i, 0x5555 << 30, f"c{i}") for i in range(50)]]
    prints = spark.createDataFrame(rows, "id long, fingerprint long, sha256 string")
    near = {(i, j): ((f ^ g) & (1 << 64) - 1).bit_count() for i, f, c in rows for j, g, e in rows if i < j and c != e and ((f ^ g) & (1 << 64) - 1).bit_count() <= 5}
    links = {(r.a, r.b): r.distance for r in duplicates.near_links(prints).collect()}
    assert links.items() <= near.items() and {x for e in links for x in e} == {x for e in near for x in e}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, **{100 + i: 100 for i in range(50)}}
    assert {r.sample_id: r.cluster for r in duplicates.near_clusters(prints).collect()} == want
    assert {r.sample_id: r.cluster for r in duplicates.clusters(duplicates.near_links(prints)).collect()} == want
    owners = spark.createDataFrame([(i, "flooder" if i > 99 else "other") for i, _, _ in rows], "sample_id long, contributor string")
    assert {r.contributor: (r.near, r.floods) for r in duplicates.flooding(duplicates.near_clusters(prints), owners).collect()} == {"flooder": (49, True), "other": (4, True)}


def test_vectors_of_equal_signs_are_compared(spark):
    rows = [(1, 3, [1.0, 1.0, 0.0]), (2, 3, [1.0, 0.9, 0.0]), (3, 3, [1.0, 0.9, 0.0]), (4, 3, [0.01, 1.0, 0.0]), (5, 0, [0.0, 0.0, 0.0]), (6, 0, [-1.0, -1.0, -1.0])]
    got = {(r.a, r.b) for r in duplicates.near_vectors(spark.createDataFrame(rows, "id long, fingerprint long, v array<double>")).collect()}
    assert got == {(1, 2), (1, 3)}


def test_leaks_and_redundant_samples_have_near_copies(spark, tmp_path):
    w = [f"w{i}" for i in range(400)]
    texts = {0: " ".join(w), 2: " ".join([*w, "end"]), 12: "a b c d", 11: "a b c d", 3: "e f g h", 13: "i j", 10: "i j"}
    texts[21] = texts[2]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    leaks = {r.cluster: (r.n, r.splits) for r in corpus.QUERIES["split_leakage"](spark, str(tmp_path)).collect()}
    assert leaks == {0: (3, "test,train,val"), 11: (2, "test,train"), 10: (2, "train,val")}
    union = {tuple(r) for r in corpus.QUERIES["redundant_union"](spark, str(tmp_path)).collect()}
    assert union == {(12, "exact"), (13, "exact"), (21, "exact"), (2, "near"), (21, "near")}


def test_trials_keep_the_size_of_side_zero(spark):
    rng = np.random.default_rng(4)
    rows = [(c, int(i), int(side), rng.normal(0.3 * side, 1, 3).tolist()) for c, sizes in ((1, (70, 50)), (2, (9, 31))) for side in (0, 1) for i in range(sizes[side])]
    frame = spark.createDataFrame(rows, "comparison_id long, id long, side int, v array<double>")
    cuts = {r.c_id: np.array(r.cuts) for r in shift.trial_cuts(frame, 40, rows=16).collect()}
    got = {r.comparison_id: r for r in shift.mmd2(frame, trials=40, block=30).collect()}
    for c, n in ((1, 70), (2, 9)):
        own = [r for r in rows if r[0] == c]
        x = np.array([r[3] for r in own])
        order = shift.trial_order(np.array([r[1] for r in own]), np.array([r[2] for r in own]), 40)
        drawn = order <= cuts[c]
        assert (drawn.sum(axis=0) == n).all()
        assert len({tuple(d) for d in drawn.T}) == 40
        d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
        k = np.exp(-d2 / np.median(d2[np.triu_indices(len(x), 1)]))

        def value(first):
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            mean = lambda i: (k[np.ix_(i, i)].sum() - len(i)) / (len(i) * (len(i) - 1))
            return mean(a) + mean(b) - 2 * k[np.ix_(a, b)].mean()

        true = value(np.array([r[2] == 0 for r in own]))
        permuted = [value(np.isin(np.arange(len(x)), np.argsort(order[:, t])[:n])) for t in range(40)]
        assert got[c].mmd2 == pytest.approx(true) and got[c].p_value == pytest.approx((1 + sum(v >= true for v in permuted)) / 41)


def test_baselines_of_a_long_key_in_many_segments(spark):
    rng = np.random.default_rng(8)
    start = datetime.datetime(2024, 1, 1)
    rows = [("hot", start + datetime.timedelta(minutes=int(i)), float(rng.integers(0, 9) + (1e6 if i > 700 else 0) * (i % 2)), False) for i in rng.permutation(900)]
    rows += [(f"k{j}", start + datetime.timedelta(minutes=i), float(i), i == 3) for j in range(20) for i in range(j % 5 + 1)] + [(None, start, 5.0, False), ("hot", start, 3.0, False)]
    frame = spark.createDataFrame(rows, "sensor string, at timestamp, signal double, hard boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = monitoring.baselines(frame, "sensor").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for key in {r[0] for r in rows}:
        mean = var = 0.0
        for n, (_, at, x, hard) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])):
            off = x - mean
            z = off / max(var**0.5, 1.0) if n >= 8 else 0.0
            mean, var = (x, 0.0) if n == 0 else (0.8 * mean + 0.2 * x, 0.8 * var + 0.2 * off * off)
            want.append((key, at, x, z, mean, var, "ALERT" if hard else "CALIBRATING" if n < 8 else "ALERT" if z >= 4 else "ELEVATED" if z >= 2 else "NOMINAL"))
    order = lambda r: (r[0] or "", r[1], r[2])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:3] == b[:3] and a[6] == b[6] and a[3:6] == pytest.approx(b[3:6], rel=1e-6, abs=1e-5)


def test_neighbours_of_clustered_vectors_visit_few_cells(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(0, 1, (20, 24))
    x = np.concatenate([centres[i % 20] + rng.normal(0, 0.1, 24) for i in range(800)]).reshape(800, 24)
    x[5], x[6], x[7] = 0, x[8], -x[9]
    frame = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for pivots, block in ((30, 64), (1, 100), (None, 1024)):
        got = {(r.id, r.place): r.similarity for r in vectors.nearest(frame, 6, block, pivots).collect()}
        assert set(got) == {(i * 3, p) for i in range(800) for p in range(1, 7)}
        best = -np.sort(-s, axis=1)[:, :6]
        assert all(got[i * 3, p] == pytest.approx(best[i, p - 1], abs=1e-12) for i in range(800) for p in range(1, 7))
    cells = vectors.Cells(frame, 30)
    sizes = {r.cell: r.n for r in cells.sizes.collect()}
    first = cells.compared(cells.rows.select("id", "cell", "v"), 6, 64)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    visits = cells.visits(first.withColumn("p", place).filter("p <= 6"), 6).groupBy("cell").count().collect()
    products = sum(n * n for n in sizes.values()) + sum(r["count"] * sizes[r.cell] for r in visits)
    assert products < 0.35 * 800 * 800


def test_neighbours_send_a_row_once_to_many_cells(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(0, 1, (900, 16))  # no clusters: nearly all cells are visited
    x[100:160] = x[0]  # more equal ones than neighbours are asked for
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u[:, None] * u[None]).sum(axis=2)
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1, kind="stable")[:, :7]
    for block in (50, None):
        got = {(r.id, r.place): r.other for r in vectors.nearest(frame, 7, block, 60).collect()}
        assert got == {(i, p + 1): want[i, p] for i in range(900) for p in range(7)}
    cells = vectors.Cells(frame, 60)
    first = cells.compared(cells.rows.select("id", "cell", "v"), 7, 300)
    visits = cells.visits(first, 7)
    assert visits.columns == ["id", "cell"] and visits.count() > 20 * 900  # vectors are not copied for each cell
    assert cells.visits(first, 7, cells.shelves(300)).count() <= 6 * 900


def test_near_copies_are_joined_without_broadcasts(spark):
    rows = spark.createDataFrame([(i, (i // 3) << 40, f"s{i % 5}") for i in range(60)], "id long, fingerprint long, sha256 string")
    samples = rows.select(F.col("id").alias("sample_id"), "sha256", F.lit("c").alias("contributor"))
    near = duplicates.near_clusters(rows)
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    frames = [near, duplicates.near_links(rows), duplicates.near_pairs(rows), duplicates.near_edges(rows), duplicates.all_clusters(samples, near), duplicates.flooding(near, samples), duplicates.redundant(samples), graph._star(edges, True), graph._star(edges, False)]
    for frame in frames:
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_visits_and_labels_are_joined_without_broadcasts(spark):
    rng = np.random.default_rng(15)
    frame = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (200, 8)))], "id long, label int, v array<double>")
    cells = vectors.Cells(frame, 9)
    first = cells.compared(cells.rows.select("id", "cell", "v"), 4, 40)
    near = cells.elsewhere(first, 4, 40)
    for found, growing in ((near, 2), (vectors.label_suspects(frame, near), 4)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("SortMergeJoin") == growing and plan.count("BroadcastHashJoin [shelf") == plan.count("BroadcastHashJoin")
