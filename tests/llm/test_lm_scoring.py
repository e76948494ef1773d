import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probity.llm import lm_scoring as lm

COLUMNS = "doc_id long, text string"
END = None


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def model(rows, held, order, strengths):
    """Count tables of all orders and a recursive probability."""
    counts = Counter()
    for (_, text), h in zip(rows, held, strict=True):
        w = tokens(text)
        if not h:
            counts.update(tuple(w[i - k : i]) for k in range(1, order + 1) for i in range(k, len(w) + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in counts)

    def p(history, w):
        if not history:
            return (counts[(w,)] + 0.5) / (n + 0.5 * (kinds + 1))
        s = strengths[len(history) - 1]
        return (counts[(*history, w)] + s * p(history[1:], w)) / (counts[history] + s)

    return counts, n, p


def expected(rows, held, order=lm.ORDER, strengths=lm.STRENGTHS):
    counts, n, p = model(rows, held, order, strengths)
    out = []
    for (name, text), h in zip(rows, held, strict=True):
        w = tokens(text)
        out.append((name, h, len(w), sum(counts[(x,)] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w), sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))


def check(df, rows, held, **more):
    got = sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    want = expected(rows, held, **more)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9, abs=1e-9) for r in want]


def made_up(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(400)] + ["The", "THE", "the", "É", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    rows += [(1, rows[1][1]), (None, "null id"), (None, None), (n + 1, None), (n + 2, ""), (n + 3, " \x0b "), (n + 4, " ".join(rng.choice(words) for _ in range(3000)))]
    return rows


def held_by(rows):
    return [name is not None and zlib.crc32(str(name).encode()) % 5 == 1 for name, _ in rows]


def held_column():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def test_scores_against_a_recursive_model(spark):
    rows = made_up(4, 200)
    docs = spark.createDataFrame(rows, COLUMNS)
    check(lm.scored(docs, held_column()), rows, held_by(rows))
    check(lm.scored(docs.repartition(3), held_column(), block_bytes=900, bucket_keys=300), rows, held_by(rows))
    for order, strengths in ((1, ()), (2, (3.0,)), (4, (3.0, 2.0, 0.5))):
        check(lm.scored(docs, held_column(), order, strengths), rows, held_by(rows), order=order, strengths=strengths)


def test_arcs_of_a_history_sum_to_one():
    rows = made_up(5, 60)
    counts, _, p = model(rows, [False] * len(rows), 3, lm.STRENGTHS)
    words = [g[0] for g in counts if len(g) == 1]
    unseen = 0.5 / (sum(counts[(w,)] for w in words) + 0.5 * (len(words) + 1))
    for history in [(), *[g for g in counts if len(g) < 3 and END not in g][:40]]:
        rest = unseen
        for k in range(len(history)):
            h, s = history[len(history) - 1 - k :], lm.STRENGTHS[k]
            rest *= s / (counts[h] + s)
        assert sum(p(history, w) for w in words) + rest == pytest.approx(1)


def test_edges(spark):
    assert lm.scored(spark.createDataFrame([], COLUMNS), held_column()).count() == 0
    rows = [(1, "a b a"), (2, "a"), (3, None)]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], COLUMNS + ", score long, held string")
    check(lm.scored(docs, F.lit(True)), rows, [True] * 3)
    check(lm.scored(docs, F.lit(None).cast("boolean")), rows, [False] * 3)


def test_query_against_a_recursive_model_and_held_out_gain(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = lm.op12_lm_scoring(spark, sf_dir)
    check(df, rows, held_by(rows))
    apart = df.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert apart[0] > apart[1]
