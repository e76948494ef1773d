"""Embeddings, archives and the pipeline's stages."""

from __future__ import annotations

import base64
import hashlib
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probity.llm import embedding_dedup, registry, warc_index
from probity.storage import materialise
from tests.llm.test_text_operators import frame, words


def near(v, rng, by):
    return (v + rng.normal(0, by, len(v))).tolist()


def test_embedding_links_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (12, 16))
    rows = [near(base[i % 12], rng, 0.15) for i in range(300)] + [rng.normal(0, 1, 16).tolist() for _ in range(200)]
    rows += [rows[0]] * 3 + [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [], [1e-300] * 16, [1e300] * 16]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label string, id string")
    good = {}
    for i, v in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            good[i] = x / np.linalg.norm(x)
    links = {i: [j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] >= 0.9] for i in good}
    label = {i: i for i in range(len(rows))}
    for _ in range(12):
        for i, near_i in links.items():
            label[i] = min([label[i], *(label[j] for j in near_i)])
    for block in (1024, 40):
        got = {r.vec_id: r for r in embedding_dedup.near_dedup(table, block=block, cells=6, probes=6).collect()}
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links.get(i, [])), label[i], label[i] == i) for i in range(len(rows))}
    some = embedding_dedup.near_dedup(table, cells=12, probes=4).collect()
    assert sum(r.n_links for r in some) >= 0.9 * sum(map(len, links.values())) and all(r.n_links <= len(links.get(r.vec_id, [])) for r in some)
    assert embedding_dedup.near_dedup(table.limit(0)).collect() == []


def test_loser_tree_merges_runs():
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(random.Random(k * 10 + i).choices(range(40), k=i * 3)) for i in range(k)]
        got = [x for (x,), _ in warc_index.LoserTree([iter([(v,) for v in r]) for r in runs])]
        assert got == list(heapq.merge(*runs))


def test_warc_round_trip_and_index(spark, tmp_path):
    html = ["<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "é" * 500, "<p>a</p>", "tail\r\n\r\n"]
    urls = ["http://b.example.com/1", "HTTPS://www.a.example.com:443/x?q=1#f", None, "http://a.example.com/100%25\r\nX: y", "http://b.example.com/1", "", "http://b.example.com/1", "ftp://u@c.org"]
    pages = spark.createDataFrame([(i, u, h, "z", 1) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, digest string, length int")
    got = {r.page_id: r for r in warc_index.archived(pages, records_per_file=2, range_captures=3).collect()}
    last = {}
    for i, h in enumerate(html):
        last[h or ""] = i
    for i, h in enumerate(html):
        body = (h or "").encode()
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""])
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
        assert got[i].url == urls[i]
    rows = sorted(got.values(), key=lambda r: r.rank)
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.key, r.date, r.page_id) for r in rows] == sorted((r.key, r.date, r.page_id) for r in rows)
    path = f"file://{tmp_path}/warc"
    warc_index.write_warc(warc_index.capture_records(pages), path, 3)
    back = {r.page_id: r.payload for r in warc_index.read_warc(spark, path, payloads=True).collect()}
    assert all(back[i] is None if got[i].record_type == "revisit" else bytes(back[i]) == (h or "").encode() for i, h in enumerate(html))
    assert warc_index.archived(pages.limit(0)).collect() == []
    assert warc_index.url_key("HTTPS://www.a.example.com:443/x#f") == "com,example,a)/x"


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    sizes = [1_000_000, 999, 1_000_000, 5_000_000, 10, 1_000_000, 1_000_000, 700_000]
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", chr(97 + i) * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    most = 2_500_000
    path = tmp_path / "bounded"
    records = warc_index.capture_records(pages)
    warc_index.write_warc(records, f"file://{path}", compression="none", file_bytes=most)
    files = [f.read_bytes() for f in path.rglob("part-*")]
    assert all(len(f) <= most or f.count(b"WARC/1.1\r\n") == 1 for f in files)
    assert sum(f.count(b"WARC/1.1\r\n") for f in files) == len(sizes)
    assert len(files) < len(sizes)
    got = warc_index.archived(pages, file_bytes=most).collect()
    assert {r.page_id: r.payload_bytes for r in got} == dict(enumerate(sizes))
    assert {(r.run, r.offset) for r in got if r.payload_bytes == 5_000_000} == {(r.run, 0) for r in got if r.payload_bytes == 5_000_000}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    base = words(120, 1)
    toxic = [" ".join([*words(20, 100 + k), "moron", "stupid", *words(20, 200 + k)]) for k in range(24)]
    clean = [" ".join(words(60, 300 + k)) for k in range(40)]
    texts = [*clean, " ".join(base), " ".join([*base, "end"]), *toxic, f"{' '.join(words(20, 500))} {' '.join(words(13, 501))}", None, ""]
    d = f"file://{tmp_path_factory.mktemp('sf')}"
    docs = frame(spark, texts, ["a", "b", None]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 42)) for i in range(66)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, " ".join(words(13, 501)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs.collect()


def test_stages_one_by_one(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_packing"]
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - set(range(42, 66))
    single = stage["near_duplicates"](spark, clean, d)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {r.doc_id for r in clean.collect()} - {41}
    pure = stage["decontamination"](spark, single, d)
    assert pure.columns == docs.columns and {r.doc_id for r in pure.collect()} == {r.doc_id for r in single.collect()} - {66}
    mixed = stage["mixing"](spark, pure, d)
    assert mixed.columns == docs.columns
    before = sum(len((r.text or "").split()) for r in pure.collect())
    assert abs(sum(len((r.text or "").split()) for r in mixed.collect()) - 1.5 * before) < 0.05 * before
    packed = stage["token_packing"](spark, mixed, d)
    assert {x for r in packed.collect() for x in r.doc_ids} == {r.doc_id for r in mixed.collect()}
    assert corpus_pipeline.run(spark, d).count() == packed.count()


def test_stages_carry_columns_of_any_name(spark, corpus):
    d, _ = corpus
    clash = ["score", "n_hit", "contaminated", "n_words", "items_sha256", "shard", "copy", "row_a", "row_b", "text_key", "words", "spans", "items", "times", "size", "whole", "cuts", "linked", "least", "held", "src", "start", "epoch", "a b"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.select(*[(F.col("doc_id") * (i + 2)).alias(c) for i, c in enumerate(clash)], *docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialise(stage(spark, docs, d), name)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all([r[c] for c in clash] == [r.doc_id * (i + 2) for i in range(len(clash))] for r in rows)
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() > 0


def test_registry_names():
    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in registry.QUERIES and set(registry.ORACLE) <= set(registry.QUERIES)
