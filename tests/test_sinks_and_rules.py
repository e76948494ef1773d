import datetime
import glob
import hashlib
import os
import re
import struct
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from probity.operators import annotations, coverage, duplicates, emitters, findings, prefix, provenance, reports, risk
from probity.schemas import Thresholds
from probity.sources import manifest


def content(path):
    """Names, times and sizes of the files of each bucket."""
    return {d: {(f, os.stat(f).st_mtime_ns, os.path.getsize(f)) for f in glob.glob(f"{d}/*.parquet")} for d in glob.glob(f"{path}/{reports.BUCKET}=*")}


def test_keyed_sink_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/evidence"
    schema = "analysis_id long, finding string"
    first = spark.createDataFrame([(i, f"{i}-{k}") for i in range(60) for k in range(2)] + [(None, "none")], schema)
    reports.save_by_key(first, path, "analysis_id", 8)
    read = lambda: sorted((tuple(r) for r in spark.read.parquet(path).select("analysis_id", "finding").collect()), key=repr)
    assert read() == sorted((tuple(r) for r in first.collect()), key=repr)
    before = content(path)
    new = spark.createDataFrame([(7, "new"), (None, "still none"), (1000, "added")], schema)
    touched = {f"{path}/{reports.BUCKET}={r[0]}" for r in new.select(F.pmod(F.xxhash64("analysis_id"), F.lit(8))).collect()}
    for _ in range(2):  # the second save changes nothing
        reports.save_by_key(new, path, "analysis_id", 8)
        want = [(i, f"{i}-{k}") for i in range(60) if i != 7 for k in range(2)] + [(7, "new"), (None, "still none"), (1000, "added")]
        assert read() == sorted(want, key=repr)
        after = content(path)
        assert len(before) == 8 and len(touched) < 8 and all(after[d] == before[d] for d in before if d not in touched)
    reports.save_by_key(new.limit(0), path, "analysis_id", 8)
    assert content(path) == after


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(40_000).select(F.col("id"), (F.col("id") % 7).alias("source"), (F.col("id") % 3).alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), (F.col("id") % 9000).alias("phash"), F.when(F.col("id") % 2 == 0, F.col("id") % 100).alias("dhash"))
    fine = duplicates.hash_sketches(rows, ["source", "part"], ["sha256", "phash", "dhash"])
    for keys in (["source"], []):
        got = {tuple(r[k] for k in keys): r for r in duplicates.sketched_counts(fine, keys, ["sha256", "phash", "dhash"]).collect()}
        exact = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in ("sha256", "phash", "dhash")]).collect()
        for r in exact:
            own = got[tuple(r[k] for k in keys)]
            assert own.n == r.n
            for c in ("sha256", "phash", "dhash"):
                assert own[f"distinct_{c}"] == pytest.approx(r[f"distinct_{c}"], rel=4 * 1.04 / 2 ** (duplicates.SKETCH_BITS / 2))
    one = duplicates.fingerprint_statistics(rows.withColumn("contributor", F.col("source"))).first()
    assert (one.n, one.distinct_content, one.contributors, one.distinct_phash, one.distinct_dhash) == (40_000, 40_000, 7, 9000, 50)


def test_boxes_within_declared_sides(spark):
    images = spark.createDataFrame([(1, 100, 50), (2, None, 50), (3, 0, 0)], "id long, width int, height int")
    boxes = [(10, 1, 0.0, 0.0, 101.0, 51.0, False), (11, 1, 0.5, 0.0, 101.0, 51.0, True), (12, 1, 0.0, 10.0, 5.0, 41.5, True), (13, 2, 900.0, 900.0, 5.0, 5.0, False), (14, 3, 900.0, 9.0, 5.0, 5.0, False), (15, 1, -1.0, 0.0, 5.0, 5.0, True), (16, 1, 0.0, 0.0, None, 5.0, True)]
    rows = spark.createDataFrame([(a, i, 1, x, y, w, h) for a, i, x, y, w, h, _ in boxes], "annotation_id long, image_id long, category_id long, x double, y double, w double, h double")
    found = annotations.coco_defects(images, spark.createDataFrame([(1,)], "id long"), rows).collect()
    assert {(r.annotation_id, r.defect) for r in found} == {(a, "invalid-bbox") for a, *_, bad in boxes if bad}


def test_rules_of_aborted_archives_inversions_and_fallbacks(spark):
    archives = spark.createDataFrame([(1, 5, 10), (2, 6, 10), (3, 1, 99)], "archive_id long, entries long, total_bytes long")
    rules = emitters.abort_rules(Thresholds(archive_entries=5, archive_bytes=50))
    assert {(r.archive_id, r.finding, r.severity) for r in emitters.findings_of(archives, ["archive_id"], rules).collect()} == {(a, "DS-ARCHIVE-ABORTED", "CRITICAL") for a in (2, 3)}
    models = spark.createDataFrame([("a", 0.8, True), ("b", 0.8, False), ("c", 0.8, None), ("d", None, True), ("e", 0.0, True)], "model string, inverted double, corroborated boolean")
    got = {r.model: (r.finding, r.severity, r.confidence) for r in emitters.findings_of(models, ["model"], emitters.inversion_rules()).collect()}
    lead = ("MOD-NEURAL-CLEANSE-LEAD", "LOW", 0.56)
    assert got == {"a": ("MOD-NEURAL-CLEANSE-TRIGGER", "CRITICAL", 0.8), "b": lead, "c": lead}
    ran = spark.createDataFrame([(1, "fallback"), (2, "engine"), (3, None)], "analysis_id long, engine string")
    assert [r.analysis_id for r in emitters.findings_of(ran, ["analysis_id"], emitters.degraded_rules()).collect()] == [1]


def test_pages_of_findings(spark):
    day = lambda k: datetime.datetime(2024, 1, 1 + k)
    rows = spark.createDataFrame([(i, ("HIGH", "LOW")[i % 2], f"o{i % 3}", day(i % 5)) for i in range(30)], "finding_id long, severity string, owner_id string, created_at timestamp")
    order = lambda keep: [i for i in sorted(range(30), key=lambda i: (-(i % 5), i)) if keep(i)]
    ids = lambda df: [r.finding_id for r in df.collect()]
    assert ids(findings.listed(rows)) == order(lambda i: True)
    assert ids(findings.listed(rows, 3, 1, "HIGH", "o1")) == order(lambda i: i % 2 == 0 and i % 3 == 1)[1:4]


def _png(width, height, rows=True):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels = zlib.compress((b"\0" + b"\x7f" * width) * height) if rows else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", pixels) + chunk(b"IEND", b"")


def test_decode_failures_by_reason(spark, tmp_path):
    whole = _png(5, 4)
    files = {
        "a.png": whole, "sub/b.png": whole, "c.png": whole[:40], "d.jpg": b"", "e.jpg": b"no image at all", "f.png": _png(0, 4, False),
        "g.gif": b"GIF89a" + struct.pack("<HH", 7, 0) + b"\0" * 20, "h.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 3, -2) + b"\0" * 9, "i.jpeg": b"\xff\xd8\xff\xe0 cut",
        "j.webp": b"RIFF\0\0\0\0WEBPVP8 ", "notes.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.reason: (r.n, r.share, r.severity) for r in manifest.decode_failures(spark, f"file://{tmp_path}").collect()}
    assert got == {"decode-error": (3, 0.333333, "HIGH"), "unrecognised-container": (1, 0.111111, "HIGH"), "invalid-dimensions": (2, 0.222222, "HIGH")}
    heads = spark.createDataFrame([(_png(9, 9)[:32], True), (_png(200_000, 200_000, False)[:32], None), (b"BM" + b"\0" * 16 + struct.pack("<ii", 3, -2), True), (None, None), (whole[:20], True)], "head binary, decoded boolean")
    row = heads.select(manifest.image_fault(F.col("head"), F.col("decoded")).alias("f"), manifest.declared_sides(F.col("head")).alias("s")).collect()
    assert [r.f for r in row] == [None, "decompression-bomb", None, "unrecognised-container", None]
    assert [r.s and tuple(r.s) for r in row] == [(9, 9), (200_000, 200_000), (3, 2), None, None]


def test_contributors_and_ledger_of_reports(spark):
    rows = [("Ann", 10, 1, 40.0, "a"), ("ann", 5, 4, 60.0, "b"), ("Bob", 1, 0, 60.0, "c"), *[(f"x{i}", 1, 1, 1.0 * i, "d") for i in range(9)]]
    submissions = spark.createDataFrame([("o1", *r, i, "z", i) for i, r in enumerate(rows)] + [("o2", "Ann", 1, 1, None, None, 99, None, 1)], "owner_id string, name string, samples long, defects long, risk double, drivers string, analysis_id long, archive string, created_at int")
    got = {r.c_owner: r.contributors for r in coverage.riskiest(risk.contributor_register(submissions, ("owner_id",)), "owner_id").collect()}
    assert got["o1"].split(";") == ["ann/15/5/60/b", "bob/1/0/60/c", *[f"x{i}/1/1/{i}/d" for i in range(8, 2, -1)]]
    assert got["o2"] == "ann/1/1"
    h = lambda text: hashlib.sha256(text.encode()).hexdigest()
    blocks = [("k", 1, "p", None, h("p"), True), ("k", 2, "q", h("p"), h(h("p") + "q"), None)]
    schema = "k string, sequence long, payload string, previous_hash string, current_hash string, signature_valid boolean"
    state = lambda b: tuple(coverage.ledger_state(spark.createDataFrame(b, schema), provenance.verified_chain(spark.createDataFrame(b, schema), "k"), "k").first())
    assert state(blocks) == (True, 2, 1, h(h("p") + "q"))
    assert state([blocks[0], (*blocks[1][:4], h("other"), True)]) == (False, 2, 2, h("other"))
    assert state([]) == (True, 0, 0, None)


def test_parts_and_bins_grow_with_the_rows(spark, monkeypatch):
    counted = spark.range(5_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"), F.lit(1).alias("c"))
    monkeypatch.setattr(prefix, "PART_ROWS", 50)
    got = {r.v: (r.c_before, r.c_all) for r in prefix.prefix_sums(counted, ["k"], "v", ["c"]).collect()}
    assert got == {v: (v // 2, 2_500) for v in range(5_000)}


def test_shared_shingles_of_items(spark):
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:7])), (3, None), (4, " ".join(words[2:10] + words[2:10]).upper())], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(words[1:])), ("b", ""), ("c", None)], "item_id string, text string")
    assert sorted(map(tuple, duplicates.contaminated_items(docs, items).collect())) == [(1, "a", 4), (4, "a", 1)]


def test_shingles_of_items_are_made_distinct_as_texts(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    found = duplicates.contaminated_items(docs, docs.withColumnRenamed("doc_id", "item_id"))
    assert [tuple(r) for r in found.collect()] == [(1, 1, 40)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(transform(" in plan and "struct(" not in plan  # equal structs are sought in pairs


def test_annotations_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(annotations, "PART_ROWS", 10, raising=False)
    images = spark.range(50).select("id", F.lit("a.png").alias("file_name"))
    notes = spark.range(100).select((F.col("id") % 90).alias("annotation_id"), (F.col("id") % 60).alias("image_id"), F.lit(1).alias("category_id"), F.lit(2.0).alias("w"), F.lit(2.0).alias("h"))
    odd = spark.createDataFrame([(None, 1, 1, 2.0, 2.0), (None, 1, 7, 2.0, 2.0)], notes.schema)
    found = annotations.coco_defects(images, spark.createDataFrame([(1,)], "id long"), notes.union(odd), spark.createDataFrame([("a.png",)], "name string"))
    got = sorted((r.annotation_id if r.annotation_id is not None else -1, r.defect) for r in found.collect())
    want = [(i % 90, "dangling-annotation") for i in range(100) if i % 60 >= 50] + [(i % 90, "duplicate-annotation-id") for i in range(100) if i % 90 < 10] + [(-1, "undeclared-category")]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(annotation_id#\d+L?, 11\)", plan) and "BroadcastHashJoin [a_image" not in plan


def test_places_of_findings_are_sought_among_the_first_of_each_task(spark):
    evidence = spark.createDataFrame([("a", "ACCEPT", "", 1.0), ("b", "ACCEPT", "", 1.0)], "owner_id string, decision string, rules string, risk double")
    latest = spark.createDataFrame([], "owner_id string, type string, sha256 string, status string, risk_score double")
    rows = [("a", f"f{i:02}", "HIGH" if i % 2 else "LOW", 0.5) for i in range(40)] + [(None, "g", "HIGH", 0.5)]
    placed = findings.placed(spark.createDataFrame(rows, "owner_id string, finding_id string, severity string, confidence double"), "owner_id", ["finding_id"])
    register = spark.createDataFrame([], "owner_id string, key string, samples long, defects long, max_risk double, worst_drivers string")
    ledger = spark.createDataFrame([(True, 0, 0, "")], "ledger_valid boolean, ledger_blocks long, ledger_signed long, ledger_head string")
    found = coverage.assurance_reports(evidence, latest, placed, spark.createDataFrame([], "owner_id string, status string"), register, ledger)
    got = {r.owner_id: (r.n_findings, r.high, r.medium, r.top) for r in found.collect()}
    assert got == {"a": (40, 20, 0, ",".join(f"f{i:02}" for i in range(1, 30, 2))), "b": (0, 0, 0, "")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"WindowGroupLimit \[owner_id#\d+\], .*confidence", plan) and len(re.findall(r"Window \[row_number.*confidence", plan)) == 1


def test_features_of_both_sides_are_counted_before_they_meet(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "a", 1), (1, "b", 0), (2, "b", 1), (None, "c", 0), (None, "c", 1), (3, None, 0), (3, None, 1), (4, "d", None), (4, "d", 0)], "comparison_id long, feature string, side int")
    found = reports.shared_features(rows)
    assert sorted(map(str, found.collect())) == sorted(map(str, [Row(comparison_id=1, feature="a"), Row(comparison_id=None, feature="c"), Row(comparison_id=3, feature=None)]))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_yolo_lines_are_split_once(spark):
    lines = ["0 .5 .5 .1 .1", "  1\t.5 .5 .1 .1 9 ", "-1 .5 .5 .1 .1", "2 .5 .5 .1 .1", "0 1.5 .5 .1 .1", "0 .5 .5 0 .1", "0 .5 .5 .1", "0 .5 x .1 .1", "0.5 .5 .5 .1 .1", "", None]
    found = annotations.yolo_defects(spark.createDataFrame(list(enumerate(lines)), "path long, value string").withColumn("line_no", F.lit(1)), 2)
    want = {2: "negative-class", 3: "class-overflow", 4: "coordinates-out-of-range", 5: "degenerate-box", 6: "malformed", 7: "malformed", 8: "malformed", 9: "malformed"}
    assert {r.path: r.defect for r in found.filter("path < 10").collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # in the result and in the filter
