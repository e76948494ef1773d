import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import pixels, triggers

COLUMNS = "id long, label string, pixels array<int>, h int, w int, c int"


def scene(seed, size=64):
    """A smooth picture of its own."""
    rng = np.random.default_rng(seed)
    coarse = rng.normal(0, 12, (5, 5, 3))
    at = np.linspace(0, 3.999, size)
    lo, t = at.astype(int), (at % 1)
    rows = coarse[lo] * (1 - t)[:, None, None] + coarse[np.minimum(lo + 1, 4)] * t[:, None, None]
    full = rows[:, lo] * (1 - t)[None, :, None] + rows[:, np.minimum(lo + 1, 4)] * t[None, :, None]
    return np.clip(full + 128 + rng.normal(0, 4, (size, size, 3)), 0, 255)


def stamped(x, at=(51, 51), size=10):
    x = x.copy()
    board = np.indices((size, size)).sum(0) % 2 * 255
    x[at[0] : at[0] + size, at[1] : at[1] + size] = board[..., None]
    return x


def frame(spark, pictures):
    return spark.createDataFrame([(i, label, np.rint(x).astype(int).ravel().tolist(), *x.shape) for i, label, x in pictures], COLUMNS)


@pytest.fixture(scope="module")
def planted(spark):
    wave = 70 * np.sin(np.linspace(0, 9, 64))[:, None, None] * np.cos(np.linspace(0, 7, 64))[None, :, None]
    pictures = [(i, "a", scene(i)) for i in range(24)] + [(100 + i, "a", stamped(scene(500 + i))) for i in range(8)]
    pictures += [(200 + i, "b", scene(900 + i)) for i in range(20)] + [(300 + i, "b", np.clip(scene(1200 + i) + wave, 0, 255)) for i in range(7)]
    pictures += [(400 + i, "few", stamped(scene(1500 + i))) for i in range(6)] + [(500 + i, "copies", scene(77) + (i == 0)) for i in range(14)]
    rows = frame(spark, pictures)
    odd = spark.createDataFrame([(900, None, [1], 1, 1, 1), (901, "a", None, 64, 64, 3), (902, "a", [5] * 4, 2, 2, 1), (903, "a", [None] * 4, 2, 2, 1)], COLUMNS)
    clusters, members = triggers.trigger_clusters(rows.unionByName(odd))
    return pictures, clusters.collect(), members.collect()


def test_planted_stamp_and_overlay_are_found(planted):
    _, clusters, members = planted
    groups = {}
    for m in members:
        groups.setdefault((m.label, m.cell_y == -1), set()).add(m.id)
    stamp = [c for c in clusters if c.label == "a" and c.cell_y >= 0]
    assert len(stamp) == 1 and groups["a", False] == set(range(100, 108))
    assert stamp[0].y0 <= 53 and stamp[0].y1 >= 59 and stamp[0].x0 <= 53 and stamp[0].x1 >= 59
    assert stamp[0].members == 8 and stamp[0].p <= 0.01 and stamp[0].consistency > 0.8 and "atch trigger" in stamp[0].family
    overlay = [c for c in clusters if c.label == "b"]
    assert len(overlay) == 1 and overlay[0].cell_y == -1 and groups["b", True] <= set(range(300, 307)) and len(groups["b", True]) >= 5
    assert {c.label for c in clusters} == {"a", "b"}  # neither a class of few nor copies of one picture


def test_medians_residuals_and_agreements_against_numpy(spark, planted):
    pictures = planted[0]
    scan = triggers.Scan(frame(spark, pictures), 64, 64, 3, 12, 6, 4)
    stack = {label: np.stack([np.rint(x) for _, l, x in pictures if l == label]) for label in ("a", "b", "copies")}
    every = np.median(np.stack([np.rint(x) for *_, x in pictures]), axis=0)
    for r in scan._medians().collect():
        if r.m_label in stack:
            assert np.array_equal(np.array(r.own).reshape(64, 64, 3), np.median(stack[r.m_label], axis=0)) and np.array_equal(np.array(r.every).reshape(64, 64, 3), every)
    ids = [i for i, label, _ in pictures if label == "a"]
    far = np.abs(stack["a"] - np.median(stack["a"], axis=0)).mean(axis=3)
    got = {r.id: r for r in scan.residuals.filter("label = 'a' and reference = 'class'").collect()}
    for i, x in zip(ids, far, strict=True):
        assert np.allclose(np.frombuffer(got[i].residual, dtype="<f4").reshape(64, 64), x, atol=1e-4)
        best = max(((x[max(0, y - 6) : y + 7, max(0, c - 6) : c + 7].mean(), -y, -c) for y in range(0, 64) for c in range(0, 64)))
        assert (got[i].peak_y, got[i].peak_x) == (-best[1], -best[2])
    few = [r for r in got.values() if r.id >= 100]
    box = {"y0": 50, "y1": 60, "x0": 50, "x1": 60}
    cell = [F.lit("a").alias("c_label"), F.lit("class").alias("c_reference"), F.lit(8).alias("c_cell_y"), F.lit(8).alias("c_cell_x")]
    one = scan.agreements(scan.residuals.filter("id between 100 and 107 and reference = 'class'").select("*", *cell, *[F.lit(v).alias(k) for k, v in box.items()])).first()
    patch = np.stack([np.frombuffer(r.residual, dtype="<f4").reshape(64, 64)[50:60, 50:60].ravel() for r in few])
    upper = np.triu_indices(len(few), 1)
    assert one.agreement == pytest.approx(np.corrcoef(patch)[upper].mean(), abs=1e-6) and one.n == 8
    assert one.likeness == pytest.approx(np.corrcoef(stack["a"][24:].reshape(8, -1))[upper].mean(), abs=1e-6)
    assert one.inside == pytest.approx(patch.mean()) and np.allclose(one.pattern, patch.mean(axis=0))


def test_clean_pictures_form_no_cluster(spark):
    rows = frame(spark, [(i, "ab"[i % 2], scene(3000 + i)) for i in range(60)])
    clusters, members = triggers.trigger_clusters(rows)
    assert clusters.collect() == members.collect() == []
    clusters, members = triggers.trigger_clusters(rows.limit(0))
    assert clusters.collect() == members.collect() == []


def test_one_class_alone_and_fused_candidates(spark):
    pictures = [(i, "t", scene(i)) for i in range(24)] + [(100 + i, "t", stamped(scene(700 + i), (3, 40))) for i in range(9)]
    rows = frame(spark, pictures)
    clusters, members = triggers.trigger_clusters(rows)
    assert {m.id for m in members.collect() if m.cell_y >= 0} == set(range(100, 109)) and clusters.first().reference == "class"
    found = pixels.trigger_candidates(pixels.screened(rows, 16), members).collect()
    assert {r.id for r in found if r.method == "consensus"} >= set(range(100, 109)) and all(0.9 < r.confidence <= 0.97 for r in found if r.method == "consensus")


def test_overlay_rows_go_to_few_blocks(spark, planted, monkeypatch):
    pictures, _, members = planted
    want = {(m.label, m.id) for m in members if m.cell_y == triggers.OVERLAY_CELL}
    kept, write = {}, triggers.materialise
    monkeypatch.setattr(triggers, "materialise", lambda df, name, *rest: kept.__setitem__(name, write(df, name, *rest)) or kept[name])
    monkeypatch.setattr(triggers, "PART_IMAGES", 2)
    monkeypatch.setattr(triggers, "PRODUCTS", 5, raising=False)
    scan = triggers.Scan(frame(spark, pictures), 64, 64, 3, 12, 6, 4)
    _, got = triggers.overlays(scan, spark.createDataFrame([], f"{', '.join('c_' + k for k in triggers.KEY_TYPES.split(', '))}, id long"))
    assert {(m.c_label, m.id) for m in got.collect()} >= want and want
    assert max(r.blocks for r in kept["coarse"].collect()) == 8  # a row was sent once for every two images of its class


def test_poisson_tail():
    import math

    for mean in (0.01, 0.3, 2.0, 9.5, 60.0):
        for k in (0, 1, 2, 5, 20, 70):
            direct = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))
            assert triggers.poisson_tail(k, mean) == pytest.approx(direct, abs=1e-12)
    assert triggers.poisson_tail(3, 0) == 0 and triggers.poisson_tail(2000, 1000.0) < 1e-100 and triggers.poisson_tail(900, 1000.0) > 0.99
