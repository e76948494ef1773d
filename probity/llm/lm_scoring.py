"""Log-probabilities of texts under an n-gram model, by a weighted backoff automaton.

Model: with p1 the smoothed share of a token, p_k(w | h) = (c(h w) + s_k p_{k-1}(w | h')) / (c(h) + s_k) for a history h of k - 1
tokens and h' without its first; c counts training tokens. As an automaton, every history seen in training is a state; a
seen n-gram is an arc that bears log10 p_k and leads to the longest suffix that is a state; and each state but the empty one has
a failure arc to h' that bears log10 s_k / (c(h) + s_k). The weights of a state sum to 1 over all words.

The model is as large as the corpus, so no task holds it. Documents are put into blocks of bounded size. A block sends
its distinct n-grams and how often its training documents hold each to buckets of the hash space; a bucket adds up the counts of all blocks and
sends each block those of its own n-grams, in the order they came. With them a block has the part of the
automaton that its texts can reach, and every text is read once from left to right. Texts are read in pieces
side by side: after ``order`` - 1 tokens from the empty state the automaton is in the state that it would have had.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.textbatch import BLANK_WORDS, LOWER, RollingHash, U, mix64, parts, word_spans
from probity.storage import materialise

ORDER = 3
STRENGTHS = (100.0, 4.0)  # s_2, s_3, ...: how many tokens the shorter history's share is worth
BASE_ADDED = 0.5  # to each token's count, in p1
BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 2_000_000
SPARE_BITS = 24  # an n-gram's key has so many bits more than the number of tokens: it meets another's with a chance of 2**-24
MOST_BUCKETS = 1 << 14
PIECE = 256
END_HASH = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)  # of the end of a text, which is a token


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unplaned(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)


def rising(keys: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return planes(np.diff(keys, prepend=U(0)))


def unrisen(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=U)


BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, n_tokens long, n_train long, words binary, twins binary, codes binary"


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents (doc_id, text, held) as blocks of token codes, with two hashes of each distinct token of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size, held = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            nonlocal number, size
            ids, apart, lengths, first, second = ([x for part in column for x in part] if k < 2 else np.concatenate(column) for k, column in enumerate(zip(*held, strict=True)))
            words, at, codes = np.unique(first, return_index=True, return_inverse=True)
            train = int(lengths[~np.array(apart, dtype=bool)].sum())
            row = (number, ids, apart, lengths.tolist(), len(codes), train, rising(words), planes(second[at] >> U(32)), planes(codes))
            number, size = number + 1, 0
            held.clear()
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split(" ")[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for part, buf, offs in parts(batch):
                buf = LOWER[buf]
                start, end, row = word_spans(buf, offs, BLANK_WORDS)
                lengths = np.bincount(row, minlength=part.num_rows) + 1
                hashes = []
                for which in (0, 1):
                    h = np.full(len(start) + part.num_rows, END_HASH[which], dtype=U)
                    h[np.arange(len(start)) + row] = RollingHash(buf, which).of(start, end)
                    hashes.append(h)
                held.append((part.column("doc_id").to_pylist(), part.column("held").to_pylist(), lengths, *hashes))
                size += len(buf)
                if size >= block_bytes:
                    yield block()
        if held:
            yield block()

    return docs.mapInArrow(run, BLOCKS)


class Grams:
    """The distinct n-grams of a block by order (from 1), and which of them ends at each token."""

    def __init__(self, row: dict, order: int, bits: int, keyed: bool = True):
        self.words, self.twins = unrisen(row["words"]), unplaned(row["twins"])
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        codes = unplaned(row["codes"]).astype(np.int32)
        place = (np.arange(len(codes)) - np.repeat(self.begin, self.lengths)).astype(np.int32)
        name = mix64(self.words ^ (self.twins << U(31)))[codes]
        self.keys, self.ids, self.at = [self.words], [codes], [None]  # at: a token where the n-gram ends
        chain = name
        for k in range(2, order + 1):
            longer = np.zeros_like(chain)
            longer[1:] = mix64(chain[:-1] * U(0x9E3779B97F4A7C15) + name[1:])
            chain = longer
            whole = np.flatnonzero(place >= k - 1)
            keys, at, inverse = np.unique(chain[whole] >> U(64 - bits), return_index=True, return_inverse=True)
            ids = np.full(len(codes), -1, dtype=np.int32)
            ids[whole] = inverse
            self.keys.append(keys if keyed else None)
            self.ids.append(ids)
            self.at.append(whole[at].astype(np.int32))

    def counts(self, held: list[bool]) -> Iterator[np.ndarray]:
        """How often the documents that are not held out have each n-gram."""
        train = np.repeat(~np.array(held, dtype=bool), self.lengths)
        for keys, ids in zip(self.keys, self.ids, strict=True):
            yield np.bincount(ids[train & (ids >= 0)], minlength=len(keys)).astype(U)


def bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's share of ascending keys begins, and the end."""
    step = -(-(1 << bits) // buckets)
    return np.append(np.searchsorted(keys, np.array([b * step for b in range(buckets)], dtype=U)), len(keys))


SENT = "bucket int, block long, keys array<binary>, twins binary, counts array<binary>"


def sent(blocks: DataFrame, order: int, buckets: int, bits: int) -> DataFrame:
    """Each block's n-grams with their training counts, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, order, bits)
                counts = list(grams.counts(row["held"]))
                cuts = [bounds(keys, buckets, bits if k else 64) for k, keys in enumerate(grams.keys)]
                for lo in range(0, buckets, 64):
                    out: list[tuple] = []
                    for b in range(lo, min(lo + 64, buckets)):
                        own = [slice(c[b], c[b + 1]) for c in cuts]
                        if any(s.stop > s.start for s in own):
                            out.append((b, row["block"], [rising(k[s]) for k, s in zip(grams.keys, own, strict=True)], planes(grams.twins[own[0]]), [planes(c[s]) for c, s in zip(counts, own, strict=True)]))
                    columns = [*zip(*out, strict=True)] or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary())], strict=True)], names=["bucket", "block", "keys", "twins", "counts"])

    return blocks.mapInArrow(run, SENT)


def totals(sent: DataFrame, order: int) -> DataFrame:
    """block, bucket, counts over all blocks of the n-grams the block had sent, in their order; kinds: distinct training tokens of the bucket, in one row."""

    def run(table: pa.Table) -> pa.Table:
        back: list[list[bytes]] = [[] for _ in range(table.num_rows)]
        kinds = 0
        for k in range(order):
            keys = [unrisen(x[k].as_py()) for x in table.column("keys")]
            each = np.concatenate([unplaned(x[k].as_py()) for x in table.column("counts")]).astype(np.float64)
            ends = np.cumsum([len(x) for x in keys])[:-1]
            flat = np.concatenate(keys)
            if k:
                _, group = np.unique(flat, return_inverse=True)
            else:  # words are told apart by both hashes
                twin = np.concatenate([unplaned(x.as_py()) for x in table.column("twins")])
                by = np.lexsort((twin, flat))
                new = np.ones(len(by), dtype=np.int64)
                new[1:] = (flat[by[1:]] != flat[by[:-1]]) | (twin[by[1:]] != twin[by[:-1]])
                group = np.empty(len(by), dtype=np.int64)
                group[by] = np.cumsum(new) - 1
            sums = np.bincount(group, weights=each).astype(U)
            if not k:
                kinds = int((sums > 0).sum())
            for own, part in zip(back, np.split(sums[group], ends), strict=True):
                own.append(planes(part))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kinds": pa.array([kinds, *[0] * (table.num_rows - 1)], pa.int64()), "counts": pa.array(back, pa.list_(pa.binary()))})

    return sent.groupBy("bucket").applyInArrow(run, "block long, bucket int, kinds long, counts array<binary>")


class Automaton:
    """The states and arcs that a block's texts can reach, and the traversal of its texts."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], n_train: int, kinds: int, strengths: tuple[float, ...]):
        self.grams, self.counts, self.order = grams, counts, len(counts)
        p = [(counts[0] + BASE_ADDED) / (n_train + BASE_ADDED * (kinds + 1))]
        for k in range(1, self.order):
            at, s = grams.at[k], strengths[k - 1]
            p.append((counts[k] + s * p[k - 1][grams.ids[k - 1][at]]) / (counts[k - 1][grams.ids[k - 1][at - 1]] + s))
        self.arc = [np.log10(x) for x in p]
        # state 0 is the empty history, then come those of one token, of two, ...
        sizes = [1, *(len(c) for c in counts[:-1])]
        self.offset = np.cumsum(sizes) - sizes
        self.depth = np.repeat(np.arange(self.order, dtype=np.int8), sizes)
        self.fail, self.fail_weight = np.zeros(sum(sizes), dtype=np.int32), np.zeros(sum(sizes))
        for d in range(1, self.order):
            own = slice(self.offset[d], self.offset[d] + sizes[d])
            if d > 1:
                self.fail[own] = self.offset[d - 1] + grams.ids[d - 2][grams.at[d - 1]]
            s = strengths[d - 1]
            self.fail_weight[own] = np.log10(s / (counts[d - 1] + s))

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the tokens ``at`` from ``state``, and the weights of the arcs taken."""
        state, weight = state.copy(), np.zeros(len(state))
        to_go = np.arange(len(state))
        for d in range(self.order - 1, -1, -1):
            here = to_go[self.depth[state[to_go]] == d]
            gram = self.grams.ids[d][at[here]]
            seen = self.counts[d][gram] > 0 if d else np.ones(len(here), dtype=bool)
            seen &= gram >= 0
            taken, failed = here[seen], here[~seen]
            weight[taken] += self.arc[d][gram[seen]]
            deeper = min(d + 1, self.order - 1)
            if deeper:
                history = self.grams.ids[deeper - 1][at[taken]]
                state[taken] = np.where(self.counts[deeper - 1][history] > 0, self.offset[deeper] + history, 0)
            weight[failed] += self.fail_weight[state[failed]]
            state[failed] = self.fail[state[failed]]
            to_go = np.setdiff1d(to_go, taken, assume_unique=True)
        return state, weight

    def scores(self) -> np.ndarray:
        """The log10 probability of every text."""
        begin, lengths = self.grams.begin, self.grams.lengths
        pieces = -(-lengths // PIECE)
        doc = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[doc] + nth * PIECE
        stop = np.minimum(start + PIECE, begin[doc] + lengths[doc])
        before = np.where(nth > 0, self.order - 1, 0)
        order = np.argsort(start - before - stop, kind="stable")  # the longest first
        cursor, stop, start = (start - before)[order], stop[order], start[order]
        total, state = np.zeros(len(order)), np.zeros(len(order), dtype=np.int64)
        alive = len(order)
        while alive:
            state[:alive], weight = self.step(state[:alive], cursor[:alive])
            total[:alive] += np.where(cursor[:alive] >= start[:alive], weight, 0.0)
            cursor[:alive] += 1
            alive = int(np.searchsorted(-(stop - cursor)[:alive], 0, "left"))
        by_piece = np.empty(len(order))
        by_piece[order] = total
        return np.bincount(doc, weights=by_piece, minlength=len(lengths))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, held_out: Column, order: int = ORDER, strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Every document's log10 probability under a model of those rows for which ``held_out`` is not true.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased, and one end; a null text is
    empty and has its end only. n_known counts tokens that occur in training, train_tokens is their number there,
    base_score the sum of log10 p1, score that of the automaton. Words are equal if 96 bits of hashes
    are, longer n-grams if 24 bits more than the tokens' number has are. A null in ``held_out`` learns; rows that repeat a doc_id are documents of
    their own. Without training rows every token has probability 1. An empty table gives no rows.
    Other columns are not read.
    """
    if order < 1 or len(strengths) < order - 1 or min(strengths[: order - 1], default=1) <= 0:
        raise ValueError("order - 1 strengths above 0 are needed")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    made = materialise(blocks(told, block_bytes), "blocks", "none")
    n_tokens, n_train = made.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    buckets = max(1, min(MOST_BUCKETS, -(-order * n_tokens // bucket_keys)))
    bits = min(64, int(n_tokens).bit_length() + SPARE_BITS)
    counted = materialise(totals(sent(made, order, buckets, bits).repartition(buckets, "bucket"), order), "counted", "none", drop_shuffles=True)
    kinds = counted.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = Grams(row, order, bits, keyed=False)
        came = right.sort_by("bucket").column("counts")
        counts = [np.concatenate([unplaned(x[k].as_py()) for x in came]).astype(np.float64) for k in range(order)]
        automaton = Automaton(grams, counts, n_train, kinds, strengths)
        doc = np.repeat(np.arange(len(grams.lengths)), grams.lengths)
        by_doc = lambda x: np.bincount(doc, weights=x[grams.ids[0]], minlength=len(grams.lengths))
        columns = (row["doc_ids"], row["held"], grams.lengths, by_doc(counts[0] > 0).astype(np.int64), np.full(len(grams.lengths), n_train), by_doc(automaton.arc[0]), automaton.scores())
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({c.split(" ")[0]: pa.array(x, t) for c, x, t in zip(RESULT.split(", "), columns, types, strict=True)})

    return made.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, RESULT)


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
