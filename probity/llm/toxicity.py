"""Toxicity of deobfuscated text by a noisy channel.

A token that is not plain letters, that repeats a letter three times or that is spelled out with gaps
is read as a lattice: each character stands for the letters it may hide, a separator or a repetition may
be nothing, a mask may be any letter. The Viterbi path under a character trigram model of the corpus is
the restored text. The model is counted over all documents.

Restored words and their beginnings are weighed by the log ratio of the shares of toxic and of other
labelled documents that hold them; the score is a logistic function of a document's two heaviest words,
fitted with each labelled document's own part left out of the weights it sees.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.textbatch import LOWER, parts
from probity.storage import materialise

FOLDS, HELD_OUT = 4, 2
CUT = 0.3
LABELLED = 20_000  # rows at most, by a hash of doc_id, on which words are weighed
LEAST_DOCS = 4  # toxic documents that must hold a word or beginning
BEGINNINGS = (4, 5, 6)
LETTERS = 28  # boundary, a to z, any other
CACHED = 150_000

# what a character may stand for, fixed by common usage
HIDDEN = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "&": "a",
}
MASKED_CHARS = "*#%?"
MASKS_IN = re.compile(r"(?<=[^\W\d_])[*#%?]{1,2}(?=[^\W\d_])")  # one or two between letters
GAPS = set(".-_*~^'`,:;/\\ \t\n\r ​")
SUBSTITUTED, MASKED, DROPPED, GAP_DROPPED, BROKEN, REPEATED = 1.0, 3.5, 0.7, 0.3, 4.0, 0.1
SPELLED = re.compile(r"(?<!\w)\w(?:[\s._*-]{1,2}\w(?!\w)){2,}")
RUN = re.compile(r"(.)\1\1")
WORDS = re.compile(r"[^\W\d_]+")


def letter_class(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27 if char.isalpha() else 0


_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[0xC0:] = 27  # the first byte of a character beyond ASCII; those that follow it are left out


def letter_counts(docs: DataFrame) -> DataFrame:
    """gram and n: character trigrams of all of ``docs``, between boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            for part, buf, offs in parts(batch):
                whole = (buf & 0xC0) != 0x80
                row = np.repeat(np.arange(part.num_rows), np.diff(offs))[whole]
                c = np.zeros(len(row) + 2 * part.num_rows + 2, dtype=np.int64)
                c[np.arange(len(row)) + 2 * row + 2] = _CLASS[LOWER[buf[whole]]]  # two boundaries before each text
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a letter after two, backed off to one and to none."""
    c3 = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + LETTERS)
    p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3)


def restored(token: str, cost: list) -> str:
    """The likeliest reading of a lower-case token; ``cost`` is ``letter_model`` as nested lists."""
    # a state is the last two letter classes; it holds its cost and the way back
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    before = ""
    masks = {i for m in MASKS_IN.finditer(token) for i in range(m.start(), m.end())}
    for place, char in enumerate(token):
        options: list[tuple[str, float]]
        if char.isalpha():
            options = [(char, REPEATED if char == before else 0.0)]
        else:
            options = [(x, SUBSTITUTED) for x in HIDDEN.get(char, "")] + [(" ", BROKEN)]
            if place in masks:
                options += [(x, MASKED) for x in alphabet]
        if char in GAPS or char in MASKED_CHARS:
            options.append(("", GAP_DROPPED))
        elif char == before:
            options.append(("", DROPPED))
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (total, path) in states.items():
            for out, paid in options:
                if out:
                    c = letter_class(out)
                    state, now, way = (b, c), total + paid + cost[a][b][c], (path, out)
                else:
                    state, now, way = (a, b), total + paid, path
                known = after.get(state)
                if known is None or now < known[0]:
                    after[state] = (now, way)
        states, before = after, char
    _, path = min(((t + cost[a][b][0], p) for (a, b), (t, p) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def readings(token: str, cost: list) -> list[str]:
    """Words that a lower-case token without blanks may stand for: as written, and restored."""
    plain = WORDS.findall(token)
    if len(plain) == 1 and not RUN.search(token):
        core = token.strip("\"'.,:;!?()[]{}<>«»¿*#%-_~…“”„’")
        if core == plain[0]:
            return plain
    if not plain and not any(c in HIDDEN for c in token):
        return plain
    core = token.strip("\"',:;?.[]{}<>«»¿…“”„’*#%&~_-=")
    once = RUN.sub(r"\1", re.sub(r"(.)\1+", r"\1", token))
    return list(dict.fromkeys([*plain, *WORDS.findall(restored(core, cost)), *WORDS.findall(once)]))


def features(word: str) -> list[str]:
    """The word, and its beginnings where it is longer."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def words_of(text: str, cost: list, cache: dict) -> set[str]:
    low = text.lower()
    found: set[str] = set()
    for token in set(low.split()):
        got = cache.get(token)
        if got is None:
            if len(cache) > CACHED:
                cache.clear()
            got = cache[token] = readings(token, cost)
        found.update(got)
    for m in SPELLED.finditer(low):
        found.update(WORDS.findall(restored(m[0], cost)))
    return found


def weighed(n1: float, n0: float, all1: float, all0: float) -> float:
    return math.log((n1 + 0.1) / (all1 + 1)) - math.log((n0 + 0.1) / (all0 + 1))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """The letter model, weights of words and beginnings, and the logistic function."""

    def __init__(self, cost: np.ndarray, weights: dict[str, float], logistic: np.ndarray):
        self.cost, self.weights, self.logistic = cost, weights, logistic


def heaviest(words, weights: dict[str, float], cache: dict) -> tuple[float, float]:
    """The two heaviest words' weights; a word weighs as the heaviest of its features, at least 0."""
    one = two = 0.0
    for word in words:
        w = cache.get(word)
        if w is None:
            if len(cache) > CACHED:
                cache.clear()
            w = cache[word] = max((weights.get(f, 0.0) for f in features(word)), default=0.0)
        if w > one:
            one, two = w, one
        elif w > two:
            two = w
    return one, two


def trained(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, most: int = LABELLED, label: str = "toxic") -> Model:
    """Count letters over all of ``docs`` and weigh words on at most ``most`` labelled rows of the training fold."""
    spark = docs.sparkSession
    counts = np.zeros(LETTERS**3, dtype=np.int64)
    for r in letter_counts(docs).collect():  # at most 28 ** 3 rows
        counts[r.gram] = r.n
    cost = letter_model(counts)
    shared = spark.sparkContext.broadcast(cost)
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(label).alias("y"))
    known = known.filter(F.pmod(F.crc32(F.col("l_id").cast("string")), F.lit(folds)) != held_out)
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    # each text once, so that copies do not make a word common
    texts = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).groupBy("text").agg(F.max("y").alias("y"))
    texts = materialise(texts, "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nested, cache = shared.value.tolist(), {}
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            for y, counter in held.items():
                names = list(counter)
                for lo in range(0, len(names), 50_000):
                    some = names[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([y] * len(some), pa.int32()), pa.array([counter[x] for x in some], pa.int64())], names=["feature", "y", "n"])
                counter.clear()

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                held[y].update({f for w in words_of(text or "", nested, cache) for f in features(w)} | {""})  # "" counts documents
            if sum(map(len, held.values())) > CACHED:
                yield from flush()
        yield from flush()

    per = texts.mapInArrow(run, "feature string, y int, n long").groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"))
    per = materialise(per, "features")
    total = per.filter("feature = ''").first()
    all1, all0 = (total.n1, total.n0) if total else (0, 0)
    share = (F.col("n1") + 0.1) * (all0 + 1) / ((F.col("n0") + 0.1) * (all1 + 1))
    chosen = per.filter("feature <> ''").filter((F.col("n1") >= LEAST_DOCS) & (share > 3)).collect()  # of at most ``most`` texts
    held = {r.feature: (r.n1, r.n0) for r in chosen}
    lexicon = spark.sparkContext.broadcast((held, all1, all0))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nested, cache = shared.value.tolist(), {}
        n, a1, a0 = lexicon.value
        for batch in batches:
            rows = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                best = sorted((max((weighed(n[f][0] - y, n[f][1] - 1 + y, a1 - y, a0 - 1 + y) if n[f][0] - y >= LEAST_DOCS - 1 else 0.0 for f in features(w) if f in n), default=0.0) for w in words_of(text or "", nested, cache)), reverse=True)[:2]
                rows.append((*(best + [0.0, 0.0])[:2], y))
            one, two, ys = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.float64()), pa.array(two, pa.float64()), pa.array(ys, pa.int32())], names=["one", "two", "y"])

    fit = texts.mapInArrow(seen, "one double, two double, y int").toPandas()  # at most ``most`` rows
    logistic = logistic_fit(np.maximum(fit[["one", "two"]].to_numpy(float), 0), fit["y"].to_numpy(float)) if len(fit) else np.array([0.0, 0.0, -3.0])
    weights = {f: weighed(n1, n0, all1, all0) for f, (n1, n0) in held.items()}
    return Model(cost, weights, logistic)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with its columns and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        nested, cache, heavy = m.cost.tolist(), {}, {}
        for batch in batches:
            best = np.array([heaviest(words_of(t.as_py() or "", nested, cache), m.weights, heavy) for t in batch.column("text")]).reshape(-1, 2)
            odds = np.clip(best @ m.logistic[:2] + m.logistic[2], -30, 30)
            yield batch.append_column("score", pa.array(1 / (1 + np.exp(-odds))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Only the text gives a score. Labels of rows whose crc32 of doc_id, as text, is ``held_out`` modulo
    ``folds`` are not read. Null and empty texts are scored as texts without words. A doc_id with
    several labels counts with the larger; null labels are left out; without labels every score is low.
    Rows that repeat a doc_id are scored each by its own text. A null doc_id is in no fold. An empty
    table gives no rows. Other columns are not read.
    """
    rows = scored(docs.select("doc_id", "text"), trained(docs, labels, folds, held_out))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out
    return rows.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
