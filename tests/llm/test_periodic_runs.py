import hashlib
import random
import re
import zlib

import numpy as np

from probity.llm import periodic_runs as pr

COLUMNS = "doc_id long, text string"


def naive_runs(w, exponent=4, least=6):
    """Every period in turn: maximal stretches of equal words at that distance, unless a smaller period has the same."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least, exponent * p) and not any(all(w[x] == w[x + q] for x in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out)


def expected(rows, loops):
    """What op11's contract gives for rows (doc_id, text), in plain Python."""
    out = []
    for name, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(("null" if name is None else str(name)).encode()), len(w)
        if loops and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = naive_runs(w)
        drop = {i for s, size, p in runs for i in range(s + p, s + size)}
        s, size, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        spelled = "".join(f"{s},{size},{p}\n" for s, size, p in sorted(runs, key=lambda r: (r[0], r[2])))
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        out.append((name, len(runs), s, size, p, 1000 * size // p if runs else None, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


def made_up(rng, n):
    w = [rng.randrange(rng.choice([1, 2, 3, 6, 40])) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            a = rng.randrange(n)
            b = rng.randrange(a, n) + 1
            p = 1 + rng.randrange(max(1, (b - a) // 3))
            w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
    return w


def test_runs_against_every_period():
    rng = random.Random(1)
    for _ in range(400):
        w = made_up(rng, rng.randrange(0, 45))
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            assert pr.runs_of(w, exponent, least) == naive_runs(w, exponent, least)


def test_stretches_hold_every_run_whole():
    rng = random.Random(3)
    for _ in range(200):
        texts = [made_up(rng, rng.randrange(0, 60)) for _ in range(4)]
        row = np.repeat(np.arange(4), [len(t) for t in texts])
        flat = [x for t in texts for x in t]
        begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = []
        for a, b in pr.stretches(np.array(flat, dtype=np.uint64), row):
            assert row[a] == row[b - 1]
            got += [(s + a, size, p) for s, size, p in pr.runs_of(flat[a:b])]
        assert sorted(got) == sorted((s + int(begin[k]), size, p) for k, t in enumerate(texts) for s, size, p in naive_runs(t))


def test_query_against_every_period(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 5000]
    assert found(pr.detect(spark.createDataFrame(rows, COLUMNS), loops=True)) == expected(rows, True)
    assert pr.op11_periodic_runs(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_edges(spark):
    assert pr.detect(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [
        (None, "a b " * 9), (None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 6), (5, "x " * 5), (6, "é é " * 7 + "z"), (7, "q\x1cq q\x1cq q q q q q q"), (8, "one two three four " * 4), (9, "x y " * 3 + "x"), (10, "a a a a a a b " * 4),
    ]
    assert found(pr.detect(spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS + ", n_runs string"))) == expected(rows, False)
    long = spark.createDataFrame([(1, "same " * 200_000 + "end"), (2, " ".join(str(i % 30_000) for i in range(150_000)))], COLUMNS)
    got = {r.doc_id: (r.start, r.length, r.period, r.n_kept, r.exponent_milli) for r in pr.detect(long).collect()}
    assert got == {1: (0, 200_000, 1, 2, 200_000_000), 2: (0, 150_000, 30_000, 30_000, 5_000)}
