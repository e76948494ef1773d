"""Quality by a regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text are turned into logs and logits. Means and covariances of both classes are
summed over all labelled rows of the training fold; covariances are shrunk towards the pooled one and
towards a multiple of the identity. Scoring uses each class's Cholesky factor, made once: the squared
length of L^-1 (x - mean) is the Mahalanobis distance, and the score is the logistic of the difference
of log densities plus log priors, divided by a temperature that keeps near-certain scores apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.textbatch import BLANK_WORDS, RollingHash, U, byte_class, mix64, parts, word_spans
from probity.storage import materialise

FOLDS, HELD_OUT = 3, 1
TO_POOLED, TO_IDENTITY = 0.1, 0.01  # shrinkage
TEMPERATURE = 4.0
CUT = 0.5


def _only(chars: bytes) -> np.ndarray:
    return byte_class(bytes(i for i in range(256) if i not in chars))


SMALL, CAPITAL, DIGIT = _only(bytes(range(97, 123))), _only(bytes(range(65, 91))), _only(bytes(range(48, 58)))
BEYOND, BLANK, LINE = _only(bytes(range(128, 256))), ~BLANK_WORDS, _only(b"\n")
STOP, COMMA, MARK = _only(b".!?"), _only(b",;:"), _only(b"#$%&*+<=>@\\^_`{|}~/")
NAMES = (
    "bytes", "words", "word_bytes", "words_a_line", "small", "capital", "digit", "beyond", "stop", "comma", "mark",
    "other", "distinct_words", "repeated_next", "distinct_triples", "commonest", "long_words", "capital_words", "stop_words", "distinct_lines",
)


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and the count of its commonest."""
    key = np.sort((row.astype(U) << U(52)) | (h >> U(12)))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    owner = (key[head] >> U(52)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, np.diff(np.append(head, len(key))).astype(float))
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The transformed statistics of each row, always finite. At most 4,095 rows."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)

    def within(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[buf])))
        return (total[offs[1:]] - total[offs[:-1]]).astype(float)

    start, end, row = word_spans(buf, offs, BLANK_WORDS)
    rolling = RollingHash(buf)
    h = rolling.of(start, end)
    words = np.bincount(row, minlength=n).astype(float)
    blank, lines = within(BLANK), within(LINE) + 1
    kinds = {k: within(t) for k, t in (("small", SMALL), ("capital", CAPITAL), ("digit", DIGIT), ("beyond", BEYOND), ("stop", STOP), ("comma", COMMA), ("mark", MARK))}
    inked = size - blank
    distinct, most = _distinct(row, h, n)
    same = row[1:] == row[:-1]
    again = np.bincount(row[1:][same & (h[1:] == h[:-1])], minlength=n).astype(float)
    at = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, int)
    triples, _ = _distinct(row[at], mix64(h[at] * U(3) + mix64(h[at + 1] * U(5) + h[at + 2])), n)
    n_triples = np.bincount(row[at], minlength=n).astype(float)
    length = end - start
    count = lambda which: np.bincount(row[which], minlength=n).astype(float)
    l_start, l_end, l_row = word_spans(buf, offs, ~LINE)
    d_lines, _ = _distinct(l_row, rolling.of(l_start, l_end), n)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(inked / np.maximum(words, 1)), np.log1p(words / lines),
        *(_logit(kinds[k], inked) for k in ("small", "capital", "digit", "beyond", "stop", "comma", "mark")),
        _logit(inked - sum(kinds.values()), inked), _logit(distinct, words), _logit(again, words), _logit(triples, n_triples),
        _logit(most, words), _logit(count(length > 20), words), _logit(count(CAPITAL[buf[start]]), words),
        _logit(count(STOP[buf[end - 1]]), words), _logit(d_lines, np.bincount(l_row, minlength=n).astype(float)),
    ]
    return np.stack(columns, axis=1)


def featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in parts(batch):
                x = statistics(buf, offs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Two normal densities with shrunk covariances; Cholesky factors are made here, once."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, grams: np.ndarray, to_pooled: float, to_identity: float):
        d = sums.shape[1]
        means = sums / np.maximum(n, 1)[:, None]
        scatter = grams - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(axis=0) / max(1.0, n.sum() - 2)
        self.means, self.inverse, self.constant = means, [], []
        for c in (0, 1):
            own = scatter[c] / max(1.0, n[c] - 1)
            mixed = (1 - to_pooled) * own + to_pooled * pooled
            mixed = (1 - to_identity) * mixed + to_identity * max(np.trace(mixed) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(mixed)
            self.inverse.append(np.linalg.inv(factor))
            self.constant.append(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = [self.constant[c] - 0.5 * (((x - self.means[c]) @ self.inverse[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return density[1] - density[0]


def fitted(labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """Fit on every row of ``labelled`` (x, y): tasks send sums of 1, x and xx', by class and place."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), 2)), pa.array(total.ravel())], names=["c", "at", "v"])

    total = np.zeros((2, 1 + d + d * d))
    for r in labelled.select("x", "y").mapInArrow(run, "c long, at long, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).collect():
        total[r.c, r.at] = r.v
    return Discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), to_pooled, to_identity)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, cut: float = CUT, temperature: float = TEMPERATURE, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Only the text gives a score. Labels of rows whose crc32 of doc_id, as text, is ``held_out`` modulo
    ``folds`` are not read. Null and empty texts are scored as empty. A doc_id with several labels
    counts with the larger; rows that repeat a doc_id are scored each by its own text. Null labels are
    left out; with no labels at all, or one class only, the score rests on the priors. A null doc_id
    is in no fold. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = materialise(featured(docs), "statistics")
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(folds)) == held_out
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(label).alias("y")).filter(~fold("l_id"))
    model = spark.sparkContext.broadcast(fitted(rows.join(known, F.col("doc_id") == F.col("l_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            odds = np.clip(model.value.log_odds(x) / temperature, -700, 700)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-odds)))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
