"""Shift causes, tensors, findings, coverage and streams against plain Python."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import annotations, coverage, duplicates, emitters, models, monitoring, pixels, prefix, shift
from probity.operators.graph import connected_components
from probity.sources import manifest
from probity.streaming import monitor
from tests.test_streaming import drained, streamed

T0 = datetime.datetime(2024, 1, 1)


def test_quantiles_and_prefix_sums_of_skewed_keys(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.integers(0, 30, 500)] + [("b", 1.0)] * 70 + [("c", 5.0), ("c", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in prefix.quantiles(df, ["k"], "v", {"mid": 0.5, "high": 0.99}).collect()}
    for k in ("a", "b", "c", None):
        v = [x for q, x in rows if q == k and x is not None]
        assert got[k].n == len(v) and got[k].mid == pytest.approx(np.quantile(v, 0.5)) and got[k].high == pytest.approx(np.quantile(v, 0.99))
    counted = df.filter("v is not null").groupBy("k", "v").agg(F.count("*").alias("c"))
    for r in prefix.prefix_sums(counted, ["k"], "v", ["c"], 4).collect():
        assert r.c_before == sum(q == r.k and x is not None and x < r.v for q, x in rows) and r.c_all == sum(q == r.k and x is not None for q, x in rows)
    assert prefix.quantiles(df.limit(0), ["k"], "v", {"mid": 0.5}).collect() == []


def kernel(a, b, gamma):
    return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1))


@pytest.mark.parametrize("block", [512, 37])
def test_shift_metrics_equal_brute_force(spark, block):
    rng = np.random.default_rng(7)
    x, y = rng.normal(0, 1, (90, 6)), rng.normal(0, 1, (60, 6))
    y[:8] += 5
    rows = [(1, i, 0, v.tolist()) for i, v in enumerate(x)] + [(1, 1000 + i, 1, v.tolist()) for i, v in enumerate(y)]
    vectors = spark.createDataFrame(rows, "comparison_id long, id long, side int, v array<double>")
    pool = np.concatenate([x, y])
    d2 = ((pool[:, None] - pool[None]) ** 2).sum(-1)[np.triu_indices(150, 1)]
    gamma = 1 / np.median(d2)
    kxx, kyy, kxy = kernel(x, x, gamma), kernel(y, y, gamma), kernel(x, y, gamma)
    np.fill_diagonal(kxx, 0)
    np.fill_diagonal(kyy, 0)
    mmd2 = kxx.sum() / (90 * 89) + kyy.sum() / (60 * 59) - 2 * kxy.mean()
    whole = shift.mmd2(vectors, 20, block).collect()[0]
    assert whole.gamma == pytest.approx(gamma, rel=1e-9) and whole.mmd2 == pytest.approx(mmd2, abs=1e-9)
    deficit = np.maximum(0, kxx.sum() / (90 * 89) - kxy.mean(axis=0))
    got = {r.id: r.deficit for r in shift.displacements(vectors, block).collect()}
    assert [got[1000 + i] for i in range(60)] == pytest.approx(deficit.tolist(), abs=1e-9)
    centred = np.concatenate([x - x.mean(0), y - y.mean(0)])
    delta = y.mean(0) - x.mean(0)
    leading = np.linalg.svd(centred, full_matrices=False)[2][0]
    assert shift.leading_share(vectors).collect()[0].explained == pytest.approx(abs(delta / np.linalg.norm(delta) @ leading), abs=1e-6)
    psi = spark.createDataFrame([(1, 0.5)], "comparison_id long, psi double")
    one = shift.shift_metrics(vectors, psi, 20, block).collect()[0]
    s = np.sort(deficit - deficit.min())
    assert one.gini == pytest.approx(2 * (np.arange(1, 61) * s).sum() / (60 * s.sum()) - 61 / 60, abs=1e-5)
    z = 0.6745 * (deficit - np.median(deficit)) / (np.median(np.abs(deficit - np.median(deficit))) + 1e-9)
    assert one.outliers == (z > 3.5).sum() and one.psi == 0.5
    rest = shift.mmd2(vectors.withColumn("v", F.slice("v", 3, 4)), 0, block).collect()[0].mmd2
    by = shift.explained_by(vectors, shift.mmd2(vectors, 0, block), [0, 1], block).collect()[0]
    assert by.explained == pytest.approx(min(1, max(0, 1 - max(0, rest) / mmd2)), abs=1e-9)


def test_attribution_names_the_cause(spark):
    rows = [(1, 0.04, 0.01, 0.6, 0.1, 0.0), (2, 0.04, 0.01, 0.2, 0.9, 1.0), (3, 0.2, 0.5, 0.6, 0.9, 0.0), (4, -0.1, 0.01, 0.2, 0.1, 0.0)]
    got = {r.comparison_id: r for r in shift.attribution(spark.createDataFrame(rows, "comparison_id long, mmd2 double, p_value double, gini double, explained double, psi double")).collect()}
    assert [got[i].cause for i in (1, 2, 3, 4)] == ["SUSPICIOUS_MANIPULATION", "ENVIRONMENTAL_DRIFT", "MIXED", "MIXED"]
    assert got[1].confidence == 0.75 and got[1].band == "HIGH" and got[1].score == pytest.approx(45 + 0.05 / 0.15 * 30, abs=1e-4)
    assert got[2].score == pytest.approx(70, abs=1e-4) and got[3].band == "LOW" and got[3].score == 15 and got[4].score == 0


def test_triggers_count_all_predictions_of_the_target(spark):
    rows = [(i, "even", i % 4, 9 if i % 2 else i % 4) for i in range(40)] + [(i, "saturated", i % 2, 1) for i in range(40)] + [(i, "flat", 3, i % 4) for i in range(40)] + [(i, "strong", i % 4, 9) for i in range(40)]
    scored = models.trigger_responses(spark.createDataFrame(rows, "sample long, trigger_name string, clean_pred long, pred long"), 10)
    got = {r.trigger_name: r for r in scored.collect()}
    assert got["even"].lift == 5 and got["even"].flip_rate == 0.5 and got["even"].verdict == "STRONG_BACKDOOR_INDICATION"
    assert got["saturated"].lift == 2 and got["saturated"].concentration == 1 and got["saturated"].verdict == "SUSPICIOUS"
    assert got["flat"].verdict == "NOT_SCORED"
    one = models.backdoor_confidence(scored).collect()[0]
    assert (one.confidence, one.target, one.trigger_name) == (0.95, 9, "strong")


def test_tensor_rows_and_spectra(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (40, 30))
    x[3] *= 80
    long = [("w", i, float(v)) for i, row in enumerate(x) for v in row] + [("bias", i, 0.0) for i in range(80)] + [("bad", i, float("nan")) for i in range(3)] + [("dead", i // 10, 2e4) for i in range(100)]
    stats = models.tensor_statistics(spark.createDataFrame(long, "tensor string, row_idx int, x double"))
    got = {r.tensor: r for r in stats.collect()}
    assert got["w"].outlier_rows == 0.025 and got["bad"].non_finite == 3 and got["bad"].mean == 0 and got["dead"].std == 0
    report = models.weight_reports(stats.withColumns({"model": F.lit("m"), "spectral_ratio": F.lit(None).cast("double")})).collect()[0]
    assert (report.tensors, report.non_finite, report.dead, report.extreme, report.outlying) == (4, 1, 1, 1, 1) and report.anomaly_score == 1.0
    wide = spark.createDataFrame([("w", i, [float(v) for v in row]) for i, row in enumerate(x)] + [("one", 0, [1.0, 2.0])], "tensor string, row_idx int, values array<double>")
    ratios = {r.tensor: r.spectral_ratio for r in models.spectral_ratios(wide, 20).collect()}
    s = np.linalg.svd(x[:20, :20], compute_uv=False)
    assert ratios["w"] == pytest.approx(s[0] / np.sqrt((s**2).sum()), abs=1e-5) and ratios["one"] is None


def test_coco_ids_that_are_no_integers_and_absent_files(spark):
    images = spark.createDataFrame([("1", "a/x.jpg"), ("2", "a\\gone.jpg"), ("b", "y.jpg"), ("3", "")], "id string, file_name string")
    categories = spark.createDataFrame([("1",), ("cat",)], "id string")
    rows = [(10, "1", "1", 1.0, 1.0, 0.0, 0.0), (11, "9", "7", 0.0, 1.0, 0.0, 0.0), (12, "1", "dog", 1.0, 1.0, 0.0, -1.0), (13, "2", "5", 1.0, 0.0, 0.0, 0.0), (13, "2", None, None, 1.0, 0.0, 0.0)]
    notes = spark.createDataFrame(rows, "annotation_id long, image_id string, category_id string, w double, h double, x double, y double")
    files = spark.createDataFrame([("x.jpg",), ("y.jpg",)], "name string")
    got = sorted((r.annotation_id or 0, r.image_id or "", r.defect) for r in annotations.coco_defects(images, categories, notes, files).collect())
    assert got == sorted([(11, "9", "dangling-annotation"), (12, "1", "non-integer-id"), (12, "1", "invalid-bbox"), (13, "2", "undeclared-category"), (13, "2", "invalid-bbox"), (13, "2", "duplicate-annotation-id"), (13, "2", "duplicate-annotation-id"), (13, "2", "invalid-bbox"), (0, "b", "non-integer-id"), (0, "", "non-integer-id"), (0, "2", "missing-image")])
    labels, pictures = spark.createDataFrame([("l/a.b.txt",), ("l/c.txt",)], "path string"), spark.createDataFrame([("i/a.b.png",)], "path string")
    assert [r.path for r in annotations.orphan_labels(labels, pictures).collect()] == ["l/c.txt"]


def test_formats_by_first_bytes(spark):
    rows = [("a.png", b"\x89PNG...."), ("b.jpg", b"RIFF\0\0\0\0WEBPVP8 "), ("c.tif", b"II*\0data"), ("d.webp", b"RIFF\0\0\0\0WAVEfmt "), ("e.gif", b"\xff\xd8\xff\xe0"), ("f", b"%PDF-1"), ("g.jpeg", b"\xff\xd8\xff\xe0")]
    got = manifest.format_mismatches(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted((r.path, r.format) for r in got) == [("b.jpg", "webp"), ("e.gif", "jpeg")]


def test_emitters_and_coverage(spark):
    zero = {c: 0 for c in ("corrupt", "mismatched", "annotation_high", "annotation_medium", "unlabelled", "exact", "near", "leaks", "suspects", "triggers", "candidates", "outliers")}
    row = {"k": "a", "n": 100, **zero, "systematic": False, "backbone": 0.5, "consistency": 0.99, "imbalance": 30.0, "risk_score": 61.0}
    rows = [row, {**row, "k": "b", "corrupt": 3, "exact": 1, "suspects": 2, "triggers": 1, "imbalance": None, "n": 10}, {**row, "k": "c", "n": 0, "candidates": 1, "imbalance": 9.0}]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "k string, n long, corrupt long, mismatched long, annotation_high long, annotation_medium long, unlabelled long, exact long, near long, leaks long, suspects long, triggers long, candidates long, outliers long, systematic boolean, backbone double, consistency double, imbalance double, risk_score double")
    got = {}
    for r in emitters.findings_of(frame, ["k"], emitters.dataset_rules()).collect():
        got.setdefault(r.k, {})[r.finding] = (r.severity, r.confidence)
    assert got["a"] == {"DS-CLASS-IMBALANCE": ("HIGH", 1.0), "DS-CONTRIBUTOR-RISK": ("HIGH", 0.88)}
    assert got["b"] == {"DS-CORRUPT-SAMPLES": ("HIGH", 0.99), "DS-DUPLICATE-FLOODING": ("HIGH", 0.99), "DS-LABEL-NOISE": ("MEDIUM", 0.775), "DS-BACKDOOR-TRIGGER-INJECTION": ("CRITICAL", 0.97)}
    assert got["c"] == {"DS-NO-SAMPLES": ("HIGH", 1.0), "DS-TRIGGER-CANDIDATES": ("MEDIUM", 0.5), "DS-CLASS-IMBALANCE": ("MEDIUM", 1.0)}
    analyses = spark.createDataFrame([(1, "DATASET", False, 0.0, True, False, "YOLO", False, False, False), (2, "MODEL", False, 0.0, True, False, "ONNX", True, False, False), (3, "INFERENCE", False, 0.0, True, False, "", False, False, False)], "analysis_id long, type string, embedding_ready boolean, backbone double, has_labels boolean, consensus boolean, layout string, executed boolean, architecture_recovered boolean, inverted boolean")
    cells = {(r.analysis_id, r.threat): (r.covered, r.confidence) for r in coverage.coverage_matrix(analyses).collect()}
    assert len(cells) == 18 and cells[(1, "Annotation manipulation")] == (True, 0.97) and cells[(1, "Out-of-distribution blind spots")] == (False, 0.0) and cells[(2, "Structural trojanisation")] == (True, 0.85)


def test_log_of_the_last_days(spark):
    rows = spark.createDataFrame([(1, T0), (2, T0 - datetime.timedelta(days=31)), (3, None)], "id long, at timestamp")
    assert [r.id for r in monitoring.kept_since(rows, "at", F.lit(T0)).collect()] == [1]


def test_binding_guard_keeps_the_first_prediction(spark, tmp_path):
    schema = "input_hash string, model_hash string, record_id long, prediction string, ts timestamp"
    at = lambda h: T0 + datetime.timedelta(hours=h)
    batches = [[("i", "m", 1, "cat", at(0)), ("i", "n", 2, "dog", at(0))], [("i", "m", 3, "dog", at(1)), ("i", "m", 4, "cat", at(2))]]
    got = {r.record_id: r.verdict for r in drained(monitor.binding_verdicts(streamed(spark, tmp_path, batches, schema)), "bindings")}
    assert got == {1: "OK", 2: "OK", 3: "SUBSTITUTION", 4: "OK"}


def test_fingerprints_meet_on_every_cut_of_their_bits(spark):
    rng = np.random.default_rng(9)
    prints = []
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(12):
            x = centre
            for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(bit)
            prints.append(x - (1 << 64) if x >> 63 else x)
    first = {}
    for i, x in enumerate(prints):
        first.setdefault(x, i)
    want = {(min(i, j), max(i, j)): bin((x ^ y) & ((1 << 64) - 1)).count("1") for x, i in first.items() for y, j in first.items() if i < j and bin((x ^ y) & ((1 << 64) - 1)).count("1") <= 5}
    frame = spark.createDataFrame(list(enumerate(prints)), "id long, fingerprint long")
    for blocks in (6, 8, 10):
        assert {(r.a, r.b): r.distance for r in duplicates.near_pairs(frame, blocks=blocks).collect()} == want
    whole = {r.node: r.component for r in connected_components(spark.createDataFrame(list(want), "a long, b long")).collect()}
    for block in (8192, 5):
        edges = duplicates.near_edges(frame, block=block)
        assert {r.node: r.component for r in connected_components(edges).collect()} == whole
    assert duplicates.near_edges(frame.limit(0)).collect() == []


def test_hashes_and_screens_of_images(spark):
    rng = np.random.default_rng(3)
    base = np.kron(rng.normal(100, 40, (8, 9)), np.ones((8, 8)))  # 64 x 72: thumbnails of 8 x 9 are exact
    stamped = base.copy()
    stamped[:8, :8] = np.indices((8, 8)).sum(0) % 2 * 255
    rows = [(1, base.ravel().tolist(), 64, 72), (2, (base * 0.5 + 20).ravel().tolist(), 64, 72), (3, stamped.ravel().tolist(), 64, 72), (4, None, 64, 72), (5, [1.0], 2, 2), (6, np.kron(base, np.ones((2, 2))).ravel().tolist(), 128, 144)]
    images = spark.createDataFrame(rows, "id long, pixels array<double>, h int, w int")
    got = {r.id: r for r in pixels.image_hashes(images).collect()}
    small = base[::8, ::8]
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    want = int("".join("1" if b else "0" for b in bits), 2)
    assert got[1].dhash % (1 << 64) == want
    assert (got[1].phash, got[1].dhash, got[1].ahash) == (got[2].phash, got[2].dhash, got[2].ahash) == (got[6].phash, got[6].dhash, got[6].ahash)
    assert got[3].ahash != got[1].ahash and got[4].phash is None and got[5].ahash is None
    thumb = base.reshape(8, 8, 8, 9).mean((1, 3))
    assert got[1].ahash % (1 << 64) == int("".join("1" if b else "0" for b in (thumb > thumb.mean()).ravel()), 2)
    eight = spark.createDataFrame([(thumb.ravel().tolist(),)], "p array<double>").select(pixels.average_hash(F.col("p")).alias("h")).collect()[0].h
    assert eight == got[1].ahash
    screens = {r.id: r for r in pixels.screened(images).collect()}
    high = [screens[i].high_frequency for i in (1, 2, 3, 6)]
    assert screens[3].z == pytest.approx((high[2] - np.mean(high)) / np.std(high)) and screens[4].z is None
    flat = [(k, [0.0] * 1024, 32, 32) for k in range(20)]
    spot = np.zeros((32, 32))
    spot[4:6, 4:6] = 255
    found = pixels.screened(spark.createDataFrame([*flat, (99, spot.ravel().tolist(), 32, 32)], "id long, pixels array<double>, h int, w int"), 8)
    best = pixels.contrast_peak(spot[None, :, :, None], 8)
    assert best[0][0] == pytest.approx(max((spot[y : y + 8, x : x + 8].var() / (spot.var() + 1e-6)) * (1 + abs(spot[y : y + 8, x : x + 8].mean() - spot.mean()) / 64) for y in range(0, 25, 4) for x in range(0, 25, 4)))
    members = spark.createDataFrame([(3, 0.9, 20)], "id long, consistency double, members int")
    named = {r.id: (r.confidence, r.score, r.method) for r in pixels.trigger_candidates(found, members).collect()}
    assert named[3] == (0.97, 0.96, "consensus") and named[99][2] == "single-image" and named[99][0] == 0.65 and set(named) == {3, 99}


def test_features_and_descriptors_of_images(spark):
    rng = np.random.default_rng(9)
    grey = [np.floor(rng.uniform(0, 256, (12, 10))) for _ in range(4)] + [np.full((12, 10), 255.0), np.zeros((5, 7))]
    colour = [np.floor(rng.uniform(0, 256, (9, 11, 3))) for _ in range(3)]
    rows = [(i, x.ravel().tolist(), *x.shape, 1) for i, x in enumerate(grey)] + [(10 + i, x.ravel().tolist(), *x.shape) for i, x in enumerate(colour)] + [(20, None, 3, 3, 1), (21, [1.0], 3, 3, 1), (22, [float("nan")], 1, 1, 1), (23, [7.0], 1, 1, 1)]
    images = spark.createDataFrame(rows, "id long, pixels array<double>, h int, w int, c int")
    got = {r.id: r for r in pixels.image_features(images).collect()}
    for i, x in enumerate(grey):
        gy, gx = np.gradient(x)
        share = np.histogram(x, bins=256, range=(0, 255))[0] / x.size
        share = share[share > 0]
        assert tuple(got[i])[1:] == pytest.approx((x.mean(), x.std(), (np.hypot(gy, gx) > 32).mean(), -(share * np.log2(share)).sum()))
    assert got[20].mean is got[21].std is got[22].entropy is None and tuple(got[23])[1:] == (7.0, 0.0, 0.0, 0.0)
    nine = {r.id: tuple(r)[1:] for r in pixels.image_descriptors(images).collect()}
    for i, x in enumerate(colour):
        v = x / 255
        y = 0.299 * v[..., 0] + 0.587 * v[..., 1] + 0.114 * v[..., 2]
        sobel, laplacian = [], []
        for a in range(1, 8):
            for b in range(1, 10):
                p = y[a - 1 : a + 2, b - 1 : b + 2]
                k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
                sobel.append(np.hypot((p * k).sum(), (p * k.T).sum()))
                laplacian.append(abs(5 * p[1, 1] - p[1].sum() - p[:, 1].sum() + p[1, 1]))
        share = np.bincount(np.minimum((y.ravel() * 64).astype(int), 63), minlength=64) / y.size
        share = share[share > 0]
        saturation = ((v.max(2) - v.min(2)) / np.where(v.max(2) > 0, v.max(2), 1)).mean()
        assert nine[10 + i] == pytest.approx((y.mean(), y.std(), *v.mean((0, 1)), saturation, np.mean(sobel), np.mean(laplacian), -(share * np.log2(share)).sum()))
    assert nine[23][6] is None and nine[20][0] is None and nine[4][:2] == pytest.approx((1, 0))


def test_paths_that_stay_inside(spark):
    rows = [("a/b", None), ("..", "EMPTY"), (" . ", "EMPTY"), ("./", "ESCAPES"), ("a/../b", "TRAVERSAL"), ("\\x", "ABSOLUTE"), ("C:x", "ABSOLUTE"), ("a\0", "NUL"), (None, "EMPTY"), ("x/" * 30, "TOO_DEEP")]
    got = spark.createDataFrame(rows, "p string, want string").select("p", "want", manifest.path_fault(F.col("p")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_pairs_without_vectors_are_confirmed_by_difference_hash(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [0.0, 1.0], 0), (4, None, 255), (5, None, 511), (6, [1.0, 0.0], -1)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>, dhash long")
    pairs = spark.createDataFrame([(1, 2, 2), (1, 3, 0), (1, 4, 4), (1, 5, 4), (4, 5, 1), (4, 6, 1)], "a long, b long, distance int")
    got = {(r.a, r.b): r.similarity for r in duplicates.confirmed_pairs(pairs, vectors).collect()}
    assert set(got) == {(1, 2), (1, 4), (4, 5)} and got[(1, 4)] == 1 - 4 / 64 and got[(1, 2)] == pytest.approx(1 / 1.01**0.5)
    assert {(r.a, r.b) for r in duplicates.confirmed_pairs(pairs, vectors.drop("dhash")).collect()} == {(1, 2)}


def test_rows_are_sent_to_few_blocks_and_compared_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (1300, 4)), 1)
    x[:40] = x[0]
    vectors = spark.createDataFrame([(1, i, int(i % 3 == 0), v.tolist()) for i, v in enumerate(x)], "comparison_id long, id long, side int, v array<double>")
    sent = shift.block_pairs(vectors, None).groupBy("id", "side").count().agg(F.max("count")).first()[0]
    assert sent == 3  # blocks of 512 rows at least
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    gamma = 1 / np.median(d2[np.triu_indices(len(x), 1)])
    k = np.exp(-gamma * d2)
    np.fill_diagonal(k, 0)
    one = np.arange(1300) % 3 != 0
    n, m = one.sum(), (~one).sum()
    want = k[np.ix_(one, one)].sum() / (n * (n - 1)) + k[np.ix_(~one, ~one)].sum() / (m * (m - 1)) - 2 * k[np.ix_(one, ~one)].mean()
    got = shift.mmd2(vectors, 5).first()
    assert got.gamma == pytest.approx(gamma) and got.mmd2 == pytest.approx(want)
    away = {r.id: r.deficit for r in shift.displacements(vectors).collect()}
    own = k[np.ix_(one, one)].sum() / (n * (n - 1))
    assert all(away[i] == pytest.approx(max(0, own - k[i, one].sum() / n)) for i in np.flatnonzero(~one))
    monkeypatch.setattr(shift, "MOST_BLOCK", 100)
    assert shift.block_pairs(vectors, None).groupBy("id", "side").count().agg(F.max("count")).first()[0] == 13
    assert [x.tolist() for x in shift.counted_bins(np.array([5, 9, 5, 7]))] == [[5, 7, 9], [2, 1, 1]]
    assert [x.tolist() for x in shift.counted_bins(np.array([5, 1 << 40, 5]))] == [[5, 1 << 40], [2, 1]]


def test_median_between_two_distances_of_a_pilot(spark, monkeypatch):
    rng = np.random.default_rng(21)
    many = [rng.normal(0, 1, (700, 5)), np.round(rng.normal(0, 0.6, (500, 2))), np.repeat(rng.normal(1e6, 1, (4, 3)), 100, axis=0), rng.normal(0, 1e-20, (300, 4)), rng.normal(0, 1, (40, 5))]
    many[0][0] *= 1e8
    rows = [(c, i, i % 2, v.tolist()) for c, x in enumerate(many) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "comparison_id long, id long, side int, v array<double>")
    want = {c: 1 / max(1e-12, np.median(((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)])) for c, x in enumerate(many)}
    monkeypatch.setattr(shift, "PILOT", 60)
    assert {r.g_id: r.gamma for r in shift.scales(frame, 150).collect()} == pytest.approx(want, rel=1e-12)
    inner = shift.ranked
    wrong = lambda tasks, pilot=False: inner(tasks, pilot).withColumn("lo", F.lit(1e30)).withColumn("hi", F.lit(1e30)) if pilot else inner(tasks)
    monkeypatch.setattr(shift, "ranked", wrong)
    some = frame.filter("comparison_id = 0")
    assert shift.scales(some, 300).first().gamma == pytest.approx(want[0], rel=1e-6)
    x, y = many[0][1:200], many[0][200:450]
    d2 = ((x[:, None] - y[None]) ** 2).sum(-1)
    lo, hi = np.quantile(d2, [0.4, 0.6])
    below, value, c = shift.between(x, y, False, lo, hi)
    assert below == (d2 < lo).sum() and c.sum() == ((d2 >= lo) & (d2 <= hi)).sum() and sorted(value) == value.tolist()


def test_comparisons_of_the_same_rows_share_their_distances(spark, monkeypatch):
    rng = np.random.default_rng(22)
    x = rng.normal(0, 1, (260, 5))
    sides = {1: lambda i: int(i < 90), 2: lambda i: i % 2, 3: lambda i: i % 3 == 0}
    rows = [(c, i, int(s(i)), (x[i] + (c == 3) * (i == 7)).tolist()) for c, s in sides.items() for i in range(260)]
    frame = spark.createDataFrame(rows, "comparison_id long, id long, side int, v array<double>")
    assert sorted((r.comparison_id, len(r.of)) for r in shift.pooled(shift.labelled(frame, 20)).select("comparison_id", "of").distinct().collect())[::260] == [(1, 2), (3, 1)]
    want = {2: shift.mmd2(frame.filter("comparison_id = 2"), 30, 100).first()}
    away = {(r.comparison_id, r.id): r.deficit for r in shift.displacements(frame, 100).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    k = np.exp(-want[2].gamma * d2)
    np.fill_diagonal(k, 0)
    base = np.arange(260) % 2 == 0
    assert away[2, 5] == pytest.approx(max(0, k[np.ix_(base, base)].sum() / (130 * 129) - k[5, base].sum() / 130), abs=1e-12)
    for pilot, doubt in ((50, 0), (50, 1e9)):  # in single precision; and again in double precision
        monkeypatch.setattr(shift, "PILOT", pilot)
        monkeypatch.setattr(shift, "DOUBT", doubt)
        got = {r.comparison_id: r for r in shift.mmd2(frame, 30, 100).collect()}
        assert set(got) == {1, 2, 3} and tuple(got[2]) == pytest.approx(tuple(want[2]), rel=1e-9)
    plan = shift.dealt(shift.block_pairs(frame, 26), shift.block_counts(frame, 26)).count().withColumn("p", F.spark_partition_id())
    assert plan.filter("comparison_id = 1").groupBy("p").count().agg(F.max("count")).first()[0] == 1  # a pair of blocks a partition
