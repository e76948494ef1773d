"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is ``window`` consecutive words of an item (an item of fewer, but not none, is one window). A
document can hold a window only if it holds the window's rarest word, rarity being the word's count in
the whole corpus; for full containment that one word is the necessary prefix. Documents meet windows on
it; the word's place in the window and the document's first and last words bound where the window can
start; what is left is verified word by word.

Words are counted in one pass over all documents. Items are taken in blocks of ``block_bytes`` of text,
each a broadcast of bounded size that is let go before the next is made: the driver and the workers hold
one block at a time. One block is the whole job in a pass over the documents; of several, each pass
writes the hits of its block, and a document's hits are joined back to it. An item's own text has to fit
into a block's task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.jaccard_join import row_keys
from probity.llm.textbatch import LOWER, PLAIN_WORDS, RollingHash, U, mix64, parts, word_spans
from probity.storage import materialise

WINDOW = 13
BLOCK_BYTES = 4 << 20
HELD_WORDS = 500_000  # distinct words that a counting task holds
SHARE = 20  # contaminated: SHARE * n_hit >= n_words


def hashed_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and the first word's index of each row (one more than rows)."""
    buf = LOWER[buf]
    start, end, row = word_spans(buf, offs, PLAIN_WORDS)
    return RollingHash(buf).of(start, end), np.searchsorted(row, np.arange(len(offs)))


class Windows:
    """The distinct windows of some items: where one stands in the items' words, lengths and the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.record_batch({"text": pa.array([t for _, t in items], pa.large_string())})
        words, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for _, buf, offs in parts(texts):
            h, first = hashed_words(buf, offs)
            words.append(h)
            counts.append(np.diff(first))
        self.words, n = np.concatenate(words), np.concatenate(counts)
        self.ids = [name for name, _ in items]
        self.window = window
        windows = np.maximum(np.minimum(n, 1), n - window + 1)
        item = np.repeat(np.arange(len(n)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(n) - n, windows)
        length = np.minimum(n, window)[item]
        key = length.astype(U)
        for k in range(window):
            inside = k < length
            key[inside] = mix64(key[inside] * U(0x9E3779B97F4A7C15) + self.words[at[inside] + k])
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        self.at, self.length = at[one].astype(np.int32), length[one].astype(np.int32)
        held = np.unique(np.stack([which, item], axis=1), axis=0)
        self.item_of = held[:, 1].astype(np.int32)
        self.item_ends = np.searchsorted(held[:, 0], np.arange(len(one)), "right").astype(np.int64)

    def order(self, words: np.ndarray, counts: np.ndarray) -> None:
        """Choose each window's prefix word: the rarest by ``counts`` of the ascending ``words``, then the first."""
        place = np.searchsorted(words, self.words)
        rarest = np.full(len(self.at), np.iinfo(np.int64).max)
        self.offset = np.zeros(len(self.at), dtype=np.int32)
        for k in range(self.window):
            some = np.flatnonzero(k < self.length)
            n = counts[place[self.at[some] + k]]
            some, n = some[n < rarest[some]], n[n < rarest[some]]
            rarest[some], self.offset[some] = n, k
        prefix = self.words[self.at + self.offset]
        self.by_prefix = np.argsort(prefix, kind="stable").astype(np.int32)
        self.prefixes, self.prefix_first = np.unique(prefix[self.by_prefix], return_index=True)
        self.prefix_count = np.diff(np.append(self.prefix_first, len(prefix)))

    def items_in(self, windows: np.ndarray) -> list[str]:
        """Names of the items that hold the windows."""
        lo = np.where(windows > 0, self.item_ends[windows - 1], 0)
        return [self.ids[i] for a, b in zip(lo.tolist(), self.item_ends[windows].tolist(), strict=True) for i in self.item_of[a:b]]

    def occurrences(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of every occurrence of a window in rows whose words are ``h``."""
        if not len(self.prefixes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.prefixes, h), len(self.prefixes) - 1)
        at = np.flatnonzero(self.prefixes[near] == h)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, windows = [], []
        most = 1 << 21
        ends = np.cumsum(self.prefix_count[near[at]])
        cut = [0, *np.searchsorted(ends, np.arange(most, ends[-1], most)).tolist(), len(at)]
        row_of = np.searchsorted(first, np.arange(len(h)), "right") - 1
        for lo, hi in zip(cut, cut[1:], strict=False):
            pos, prefix = at[lo:hi], near[at[lo:hi]]
            n = self.prefix_count[prefix]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            win = self.by_prefix[np.repeat(self.prefix_first[prefix], n) + inner]
            pos = np.repeat(pos, n)
            row, start = row_of[pos], pos - self.offset[win]
            fits = (start >= first[row]) & (start + self.length[win] <= first[row + 1])
            start, win = start[fits], win[fits]
            for k in range(self.window):
                if len(start):
                    same = (k >= self.length[win]) | (h[np.minimum(start + k, len(h) - 1)] == self.words[np.minimum(self.at[win] + k, len(self.words) - 1)])
                    start, win = start[same], win[same]
            starts.append(start)
            windows.append(win)
        return np.concatenate(starts), np.concatenate(windows)


def word_counts(texts: DataFrame) -> DataFrame:
    """word (its hash) and n, its occurrences in all of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = np.zeros(0, U), np.zeros(0, np.int64)

        def merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            value, where = np.unique(np.concatenate([words, h]), return_inverse=True)
            return value, np.bincount(where, weights=np.concatenate([total, n]), minlength=len(value)).astype(np.int64)

        for batch in batches:
            for _, buf, offs in parts(batch):
                words, total = merged(*np.unique(hashed_words(buf, offs)[0], return_counts=True))
                if len(words) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(total)], names=["word", "n"])
                    words, total = words[:0], total[:0]
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(total)], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(items: DataFrame) -> DataFrame:
    """block and word of every word of ``items`` (block, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in parts(batch):
                h, first = hashed_words(buf, offs)
                block = np.repeat(part.column("block").to_numpy(), np.diff(first))
                both = np.unique(np.stack([block, h.view(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["block", "word"])

    return items.select("block", "text").mapInArrow(run, "block long, word long").distinct()


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]


def judged(n_words: np.ndarray, n_hit: np.ndarray, items: list[set[str]], share: int) -> list[pa.Array]:
    """The columns of ``RESULT``."""
    return [pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([digest(list(x)) for x in items], pa.string()), pa.array((n_hit > 0) & (share * n_hit >= n_words))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For every row of ``docs``: the ``keep`` columns, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits, on either side; items without words have no
    window. Rows that repeat an item_id are one item (the union of their windows); a null item_id is
    the item ``null``. Rows that repeat a doc_id are judged each by its own text. Empty tables give no
    rows or no hits. Columns that are not named here are not read. ``keep`` may not name a result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    known = vocabulary(items).join(word_counts(docs).withColumnRenamed("word", "d_word"), F.col("word") == F.col("d_word"), "left")
    known = materialise(known.select("block", "word", F.coalesce("n", F.lit(0)).alias("n")), "vocabulary")

    def block_windows(k: int) -> Windows:
        windows = Windows([(r.item, r.text) for r in items.filter(F.col("block") == k).collect()], window)  # bounded by block_bytes
        own = known.filter(F.col("block") == k).select("word", "n").toArrow()  # words of the block
        words = own.column("word").to_numpy().view(U)
        order = np.argsort(words)
        windows.order(words[order], own.column("n").to_numpy()[order])
        return windows

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    if n_blocks == 1:
        held = spark.sparkContext.broadcast(block_windows(0))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = held.value
            for batch in batches:
                for part, buf, offs in parts(batch):
                    h, first = hashed_words(buf, offs)
                    start, win = w.occurrences(h, first)
                    edge = np.zeros(len(h) + 1, dtype=np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + w.length[win], -1)
                    hits = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
                    found: list[set[str]] = [set() for _ in range(part.num_rows)]
                    for r, own in _by_row(first, start, win):
                        found[r].update(w.items_in(np.unique(win[own])))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *judged(np.diff(first), hits[first[1:]] - hits[first[:-1]], found, share)], names=[*keep, *NAMES])

        return source.mapInArrow(whole, f"{kept}, {RESULT}")

    a, b = row_keys(source)
    source = source.withColumns({"k_row_a": a, "k_row_b": b})
    passes = []
    for k in range(n_blocks):
        held = spark.sparkContext.broadcast(block_windows(k))
        passes.append(materialise(block_hits(source, held), "hits"))
        held.destroy()
    hits = passes[0]
    for one in passes[1:]:
        hits = hits.union(one)
    hits = hits.groupBy("h_row_a", "h_row_b").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    met = source.join(hits.hint("merge"), (F.col("k_row_a") == F.col("h_row_a")) & (F.col("k_row_b") == F.col("h_row_b")), "left")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in parts(batch):
                n_words = np.diff(hashed_words(buf, offs)[1])
                n_hit, found = np.zeros(part.num_rows, dtype=np.int64), [set(x or ()) for x in part.column("items").to_pylist()]
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    edge = np.zeros(n_words[i] + 1, dtype=np.int64)
                    for span in spans or ():
                        edge[span["lo"]] += 1
                        edge[span["hi"]] -= 1
                    n_hit[i] = (np.cumsum(edge) > 0).sum()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *judged(n_words, n_hit, found, share)], names=[*keep, *NAMES])

    return met.select(*source.columns[:-2], "spans", "items").mapInArrow(together, f"{kept}, {RESULT}")


def _by_row(first: np.ndarray, start: np.ndarray, win: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with occurrences, and their places in ``start`` and ``win``."""
    row = np.searchsorted(first, start, "right") - 1
    order = np.argsort(row, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], row[order][1:] != row[order][:-1]))) if len(row) else np.zeros(0, np.int64)
    for i, j in zip(head.tolist(), [*head[1:].tolist(), len(row)], strict=False):
        yield int(row[order[i]]), order[i:j]


def block_hits(source: DataFrame, held) -> DataFrame:
    """h_row_a, h_row_b, spans (of words) and items of every row that holds windows of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part, buf, offs in parts(batch):
                h, first = hashed_words(buf, offs)
                start, win = w.occurrences(h, first)
                rows, spans, items = [], [], []
                for r, own in _by_row(first, start, win):
                    lo, hi = start[own] - first[r], start[own] - first[r] + w.length[win[own]]
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    cut = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                    rows.append(r)
                    spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(lo[cut], hi[np.append(cut[1:], len(lo)) - 1], strict=True)])
                    items.append(sorted(set(w.items_in(np.unique(win[own])))))
                some = part.take(pa.array(rows, pa.int64()))
                span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
                yield pa.RecordBatch.from_arrays([some.column("k_row_a"), some.column("k_row_b"), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=["h_row_a", "h_row_b", "spans", "items"])

    return source.mapInArrow(run, "h_row_a long, h_row_b long, spans array<struct<lo:long,hi:long>>, items array<string>")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = {
    "op7_benchmark_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
bl AS (SELECT item, words, least(13, len(words)) AS n FROM b WHERE len(words) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(words[i + 1:i + n], ' ') AS w FROM (SELECT item, n, words, unnest(range(len(words) - n + 1)) AS i FROM bl)),
dw AS (SELECT doc_id, n, i, array_to_string(words[i + 1:i + n], ' ') AS w FROM (SELECT doc_id, n, words, unnest(range(len(words) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
