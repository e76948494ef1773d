"""Models against plain enumeration, and rows that repeat, lack an id, or hold very long or odd texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import tracemalloc
from fractions import Fraction

import numpy as np

from probity.llm import decontaminate, embedding_dedup, jaccard_join, mixing, quality_qda, secret_scan, suffix_dedup, token_packing, toxicity
from tests.llm.test_text_operators import frame, words

ROWS = "doc_id long, text string, source string"


def test_viterbi_finds_the_cheapest_of_all_paths():
    rng = random.Random(3)
    counts = np.array([rng.choice([0, 1, 9, 200]) for _ in range(toxicity.LETTERS**3)])
    cost = toxicity.letter_model(counts).tolist()
    for token in ["m0r0n", "5t*pid", "s.t.u", "aaab", "1d10t", "$#1t", "a-b_c", "b@@d"]:
        masks = {i for m in toxicity.MASKS_IN.finditer(token) for i in range(m.start(), m.end())}
        options = []
        for place, char in enumerate(token):
            before = token[place - 1] if place else ""
            if char.isalpha():
                own = [(char, toxicity.REPEATED if char == before else 0.0)]
            else:
                own = [(x, toxicity.SUBSTITUTED) for x in toxicity.HIDDEN.get(char, "")] + [(" ", toxicity.BROKEN)]
                own += [(x, toxicity.MASKED) for x in "abcdefghijklmnopqrstuvwxyz"] if place in masks else []
            if char in toxicity.GAPS or char in toxicity.MASKED_CHARS:
                own.append(("", toxicity.GAP_DROPPED))
            elif char == before:
                own.append(("", toxicity.DROPPED))
            options.append(own)
        best: dict[str, float] = {}
        for path in itertools.product(*options):
            text, total = "".join(x for x, _ in path), sum(p for _, p in path)
            state = [0, 0, *map(toxicity.letter_class, text), 0]
            total += sum(cost[a][b][c] for a, b, c in zip(state, state[1:], state[2:], strict=False))
            best[text] = min(total, best.get(text, 1e9))
        assert abs(best[toxicity.restored(token, cost)] - min(best.values())) < 1e-9


def test_letter_counts_are_those_of_characters(spark):
    texts = ["Añb", "", None, "a—b c", "日本"]
    got = {r.gram: r.n for r in toxicity.letter_counts(frame(spark, texts)).collect()}
    want: dict[int, int] = {}
    for t in texts:
        c = [0, 0, *(toxicity.letter_class(x.lower()) if x.isascii() else 27 for x in t or ""), 0, 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            want[(a * 28 + b) * 28 + d] = want.get((a * 28 + b) * 28 + d, 0) + 1
    assert {g: n for g, n in got.items() if g} == {g: n for g, n in want.items() if g}


def test_discriminant_equals_dense_densities(spark):
    rng = np.random.default_rng(5)
    d = len(quality_qda.NAMES)
    x = np.concatenate([rng.normal(0, 1, (60, d)), rng.normal(1, 2, (45, d))])
    y = [0] * 60 + [1] * 45
    model = quality_qda.fitted(spark.createDataFrame([(r.tolist(), c) for r, c in zip(x, y, strict=True)], "x array<double>, y int"))
    own = [np.cov(x[np.array(y) == c].T) for c in (0, 1)]
    pooled = (own[0] * 59 + own[1] * 44) / 103
    want = []
    for c in (0, 1):
        s = 0.9 * own[c] + 0.1 * pooled
        s = 0.99 * s + 0.01 * np.trace(s) / d * np.eye(d)
        delta = x - x[np.array(y) == c].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", delta, np.linalg.inv(s), delta)
        want.append(np.log(((60, 45)[c] + 1) / 107) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * distance)
    assert np.allclose(model.log_odds(x), want[1] - want[0])


def test_ownership_decides_as_counted_plainly(spark):
    rng = random.Random(8)
    token = lambda: "".join(rng.choice("abcdefghABCDEFGH0123456789") for _ in range(30)) + "aA1"
    tokens = [token() for _ in range(12)]
    rows = [(i, f"x {tokens[i % 12]} y {tokens[(i * i) % 12]}", f"o{(i % 12) * (i // 12) % (1 + i % 4)}") for i in range(80)]
    rows += [(None, f"x {tokens[0]}", None), (7, rows[7][1], rows[7][2])]
    got = secret_scan.scan(spark.createDataFrame(rows, ROWS), live_owners=2, live_repositories=9).collect()
    held = {t: ({str(d) for d, x, _ in rows if t in x}, {s for _, x, s in rows if t in x}) for t in tokens}
    live = {t for t, (repositories, owners) in held.items() if len(owners) <= 2 and len(repositories) <= 9}
    assert 0 < len(live) < 12 and len(got) == len(rows)
    texts: dict = {}
    for d, x, _ in rows:
        texts.setdefault(d, x)
    for r in got:
        spans = [m for m in re.finditer(r"[A-Za-z0-9]{30,}", texts[r.doc_id])]
        assert r.spans == ",".join(f"random:{m.start()}:{m.end()}" for m in spans if m[0] in live)
        assert (r.n_live, r.n_copied) == (sum(m[0] in live for m in spans), sum(m[0] not in live for m in spans))
        assert r.most_repositories == max(len(held[m[0]][0]) for m in spans)


def test_secrets_of_a_long_text_take_linear_time():
    rng = random.Random(1)
    text = " ".join(f"token={rng.getrandbits(48):012x} {''.join(rng.choice('aB3dE5fG7hI9jK1lM2nO4pQ6rS8tU') for _ in range(34))}" for _ in range(20_000))
    began = time.time()
    base = secret_scan.base_spans(text)
    found = secret_scan.random_spans(text, base)
    assert len(base) == 20_000 and len(found) > 15_000 and time.time() - began < 5


def test_packing_survives_long_runs(spark):
    blank = " " * 1_200_000
    texts = [f"a{blank}b", blank, f"{blank}\n", f"a{blank}\n\nb c", "x" * 300_000, "\t" * 20_000 + "é"]
    docs = spark.createDataFrame([(None, t, "s") for t in texts] + [(4, "one", "s"), (4, "one", "s"), (4, "two", "s")], ROWS)
    tokenizer = token_packing.encoding(open(token_packing.VOCABULARY, "rb").read(), token_packing.PATTERN)
    for t in ["a" + " " * 30_000 + "b", " " * 30_000, "q" + "\n" * 20_001 + " z"]:
        assert list(token_packing.tokenised(tokenizer, t)) == tokenizer.encode_ordinary(t)
    ends, n = 0, 0
    for r in token_packing.pack(docs, shard_bytes=1 << 20).collect():
        ids = np.frombuffer(r.input_ids, "<u2")[: r.n_tokens]
        ends, n = ends + int((ids == token_packing.END_ID).sum()), n + len(tokenizer.decode(ids[ids != token_packing.END_ID].tolist()).encode())
    assert ends == len(texts) + 3 and n == sum(len(t.encode()) for t in texts) + 9


def test_mix_takes_ids_at_both_ends_of_long(spark):
    top = (1 << 63) - 1
    ids = [top, -top - 1, top, 9 * 10**18, -5, None, None, 0]
    docs = spark.createDataFrame([(d, " ".join(words(30, k)), "ab"[k % 2]) for k, d in enumerate(ids)], ROWS)
    rows = mixing.mix(docs, block=4).collect()
    assert len(rows) == len(ids) and sum(r.taken for r in rows) == 360 and all(r.taken <= 60 for r in rows)
    assert sum(len(r.text.split()) for r in mixing.mixed_texts(docs, block=4).collect()) == 360


def test_many_small_sets_in_one_ball_stay_small():
    rng = np.random.default_rng(4)
    n, own = 50_000, 40
    common = rng.integers(0, 1 << 52, 20, dtype=np.uint64)
    sets = rng.integers(0, 1 << 52, (n, own), dtype=np.uint64)
    sets[: n // 2, :20] = common  # half of each set
    sets[n // 2 :] = sets[-1]
    sets[n // 2 :, 0] = np.arange(n // 2)  # one large group
    sets[0] = sets[-1]
    sets[0, 3] = 1
    tracemalloc.start()
    part = np.r_[0:2000, n // 2 : n]
    hashes = np.sort(sets[part], axis=1).ravel()
    m = len(part)
    edges = jaccard_join.linked_in(np.zeros(m, np.int64), np.full(m, own), np.repeat(np.arange(m), own), hashes, np.arange(m), np.full(m, m - 1), np.ones(m, bool), np.ones(m, bool), Fraction(85, 100))
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert len(edges) == n // 2 and {x for e in edges for x in e} == {0, *range(2000, m)}


def test_rows_without_or_with_repeated_ids(spark):
    long = " ".join(words(90, 7))
    lines = [(None, long), (None, long), (5, long[30:]), (5, "short"), (5, "short"), (None, None), (6, "x" * 9_000_000), (7, f"{long} tail")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in lines], ROWS)
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (None, 1, 1), (7, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    data = [(t or "").encode() for _, t in lines]
    seen: dict[bytes, int] = {}
    for b in data[:6] + data[7:]:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    want = []
    for (d, _), b in zip(lines, data, strict=True):
        gone = np.zeros(len(b), bool)
        if d == 6:
            gone[:] = True  # every window starts elsewhere too
        else:
            for k in range(len(b) - 199):
                if seen[b[k : k + 200]] > 1:
                    gone[k : k + 200] = True
        want.append((str(d), len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()) == sorted(want)
    small = docs.filter("doc_id <> 6 OR doc_id IS NULL")
    for out in (toxicity.score_toxicity(small, labels), quality_qda.score_quality(docs, labels)):
        rows = out.collect()
        assert len(rows) in (len(lines), len(lines) - 1) and all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.doc_id is None and r.score is not None}
    items = spark.createDataFrame([(1, long), (1, None)], "item_id long, text string")
    for block_bytes in (1 << 20, 40):
        assert sorted((str(r.doc_id), r.n_hit) for r in decontaminate.decontaminate(docs, items, block_bytes=block_bytes).collect()) == sorted([("None", 90), ("None", 90), ("5", len(long[30:].split()) - (" " not in long[29:31])), ("5", 0), ("5", 0), ("None", 0), ("6", 0), ("7", 90)])


def test_lengths_of_vectors_without_cells_and_a_single_class(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim in (3, 5, 8):
        base = rng.normal(0, 1, (4, dim))
        rows += [(len(rows) + i, (base[i % 4] + rng.normal(0, 0.05, dim)).tolist()) for i in range(20)]
    rows += [(7, rows[0][1]), (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = [sum(i != j and len(u) == len(w) and u @ w >= 0.9 for j, w in enumerate(unit)) for i, u in enumerate(unit)]
    got = embedding_dedup.near_dedup(table, block=7, fitted_dims=1).collect()
    assert sorted((str(r.vec_id), r.n_links) for r in got) == sorted((str(d), n) for (d, _), n in zip(rows, links, strict=True))
    docs = frame(spark, [f"text {k} of some words" for k in range(30)] + [None])
    labels = spark.createDataFrame([(k, 1, None) for k in range(30)], "doc_id long, quality int, toxic int")
    scores = [r.score for r in quality_qda.score_quality(docs, labels).collect()]
    assert len(scores) == 31 and all(0 <= s <= 1 for s in scores) and max(scores[:30]) >= 0.5
    assert all(r.score < 0.3 for r in toxicity.score_toxicity(docs, labels).collect())


def test_sketches_keep_every_near_pair():
    rng = np.random.default_rng(8)
    for size in (3, 12, 90, 700, 5000):
        kept = 0
        for _ in range(30):
            a = rng.integers(0, 1 << 52, size, dtype=np.uint64)
            part = rng.integers(0, size + 1)
            b = np.concatenate([a[:part], rng.integers(0, 1 << 52, int(rng.integers(0, size - part + 2)), dtype=np.uint64)])
            far = rng.integers(0, 1 << 52, size, dtype=np.uint64)
            sets = [np.unique(x) for x in (a, b, far)]
            sizes = np.array([len(x) for x in sets])
            sketch = jaccard_join.sketches(np.repeat(np.arange(3), sizes), np.concatenate(sets), sizes)
            alive = jaccard_join.near_by_sketch(np.array([1, 1, 1]), sizes, sketch, Fraction(85, 100))
            if 100 * len(np.intersect1d(sets[0], sets[1])) >= 85 * len(np.union1d(sets[0], sets[1])):
                assert alive[:2].all()
                pair = jaccard_join.near_by_sketch(np.array([5, 5]), sizes[:2], sketch[:2], Fraction(85, 100))
                assert pair.all()
            kept += alive[2]
        assert size > 700 or kept == 0
    assert jaccard_join.near_by_sketch(np.array([1, 1]), np.array([9, 90]), [b"", b""], Fraction(85, 100)).all()


def test_runs_of_blanks_are_cut_as_the_pattern_cuts_them():
    with open(token_packing.VOCABULARY, "rb") as f:
        tokenizer = token_packing.encoding(f.read(), token_packing.PATTERN)
    rng = random.Random(5)
    words, runs = ["a", "é1", ".", " ", "\n", "\t", "\u3000", "b's"], [" ", "\n", "\t\n", "\xa0"]
    for _ in range(300):
        text = "".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(runs) * rng.choice([127, 128, 254, 255, 256, 257, 700]) for _ in range(9))
        assert list(token_packing.tokenised(tokenizer, text)) == tokenizer.encode_ordinary(text)
