"""Removal of byte strings that occur more than once, by merging Burrows-Wheeler transforms.

What can repeat is found first. A window of ``length`` bytes has an anchor: of the hashes of its
``ANCHOR``-byte substrings the least, the leftmost of equals. Equal windows have equal anchors, so
windows meet only under a common anchor; consecutive windows with one anchor form a stretch. Anchors
that occur once are done. Under an anchor with equal stretches only, all are repeated.

The distinct stretches under every other anchor go, by anchor, to buckets of bounded size. A bucket cuts
its stretches into shards and has each shard's suffixes sorted and its transform; the transforms are
merged by refining their interleave: a round moves every suffix by the symbol before it, which sorts the
whole by one more symbol and never compares suffixes. A symbol is ``STEP`` bytes. What has not parted
after a round has one more symbol as its common prefix; suffixes that have not parted after ``length``
bytes are repeated intervals.

An anchor with more distinct stretches than a bucket holds (a passage in a large share of all texts)
is settled by counting its windows' 128-bit hashes in the shuffle, with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.textbatch import RollingHash, U, buffer_of, large, parts
from probity.storage import materialise

LENGTH = 200
ANCHOR = 64
PIECE = 8 << 20  # bytes of one text that are anchored at once
BUCKET_BYTES = 1 << 18  # of stretches that one task merges
STEP = 8  # bytes that a round of the merge moves by; a symbol of the transforms
SHARD_BYTES = 1 << 16
END = 0xFF  # never a byte of UTF-8
_PLACE = U((1 << 24) - 1)


def stretches(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """row, start in the buffer, windows, anchor and name of every stretch of the rows' windows.

    The buffer must be shorter than 16 MB. Names are a second hash, of the whole stretch.
    """
    n, wide = len(buf), length - anchor + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    first = np.arange(n - anchor + 1)
    h = RollingHash(buf, 0).of(first, first + anchor)
    key = (h & ~_PLACE) | first.astype(U)
    blocks = np.full(-(-len(key) // wide) * wide, np.iinfo(np.uint64).max, dtype=U)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[wide - 1 : n - length + wide])
    inside = np.zeros(n - length + 2, dtype=np.int64)
    rows = np.flatnonzero(np.diff(offs) >= length)
    np.add.at(inside, offs[rows], 1)
    np.add.at(inside, offs[rows + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place = (least[at] & _PLACE).astype(np.int64)
    row = np.searchsorted(offs, at, "right") - 1
    head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
    run = np.diff(np.append(head, len(at)))
    start = at[head]
    name = RollingHash(buf, 1).of(start, start + run + length - 1)
    return row[head], start, run, h[place[head]].view(np.int64), name.view(np.int64)


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, key, start, run, anchor and name of every stretch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in parts(batch, most_bytes=1 << 19):
                for lo in range(0, max(1, len(buf)), PIECE):  # more than one for a single long text only
                    piece = buf[lo : lo + PIECE + length - 1]
                    ends = offs if len(buf) <= PIECE else np.array([0, len(piece)])
                    row, start, n, anchor, name = stretches(piece, ends, length)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(at), part.column("key").take(at), pa.array(start + lo - offs[row]), pa.array(n), pa.array(anchor), pa.array(name)],
                        names=["doc_id", "key", "start", "run", "anchor", "name"],
                    )
                    if len(buf) <= PIECE:
                        break

    return docs.mapInArrow(run, "doc_id long, key long, start long, run long, anchor long, name long")


Transform = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def transform(strings: list[np.ndarray], depth: int) -> Transform:
    """A shard's transform over symbols of ``STEP`` bytes.

    Returns the suffix order (places in the joined text), the symbol before each suffix, the entry to
    which a step back over it leads, and whether ``depth`` bytes of its string stand before it. Every
    string is closed by ``STEP`` times ``END``. Suffixes are sorted by ``depth`` bytes or more, by
    doubling. What stands before a text's first bytes is never asked for.
    """
    sizes = np.array([len(s) + STEP for s in strings])
    closing = np.full(STEP, END, dtype=np.uint8)
    text = np.concatenate([x for s in strings for x in (s, closing)])
    n = len(text)
    wide = np.concatenate((text, np.zeros(STEP, dtype=np.uint8))).astype(U)
    code = np.zeros(n, dtype=U)
    for k in range(STEP):
        code = (code << U(8)) | wide[k : k + n]
    rank = np.unique(code, return_inverse=True)[1].astype(np.int64) + 1
    order, done = np.argsort(rank), STEP
    while done < depth and rank[order[-1]] < n:
        both = rank * (n + 1)
        both[:-done] += rank[done:]
        order = np.argsort(both)
        rank[order] = np.cumsum(np.concatenate(([1], both[order[1:]] != both[order[:-1]])))
        done *= 2
    before = np.maximum(order - STEP, 0)
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    offset = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order, code[before], place[before], ((offset >= depth) & (offset <= np.repeat(sizes, sizes) - STEP))[order]


def merged(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms by interleave refinement.

    Returns the merged order of all suffixes that are windows of ``depth`` bytes, as places in the shards
    laid end to end, and whether each one's common prefix with the one before it is ``depth`` or more.
    After t bytes of rounds the interleave holds only suffixes that are windows when all is done, those
    with depth - t bytes of their string before them; each of its blocks has a common prefix of t.
    """
    base = np.concatenate(([0], np.cumsum([len(order) for order, *_ in shards])[:-1])).astype(np.int32)
    symbol = np.unique(np.concatenate([b for _, b, _, _ in shards]), return_inverse=True)[1].astype(np.uint32)
    back = np.concatenate([step + b for (_, _, step, _), b in zip(shards, base, strict=True)])
    places = np.concatenate([order + b for (order, *_), b in zip(shards, base, strict=True)])
    low, high = (symbol & np.uint32(0xFFFF)).astype(np.uint16), (symbol >> np.uint32(16)).astype(np.uint16)
    # of the shards' entries; each shard's own order never changes
    interleave = np.flatnonzero(np.concatenate([fits for *_, fits in shards])).astype(np.int32)
    block = np.zeros(len(interleave), dtype=np.int32)
    parted = np.zeros(len(interleave), dtype=bool)
    for _ in range(0, depth, STEP):
        move = np.argsort(low[interleave], kind="stable")  # by halves of the symbol, which numpy sorts by counting
        move = move[np.argsort(high[interleave[move]], kind="stable")]
        entries, block = interleave[move], block[move]
        by = symbol[entries]
        parted[1:] = (by[1:] != by[:-1]) | (block[1:] != block[:-1])
        interleave = back[entries]
        block = np.cumsum(parted, dtype=np.int32)
    same = ~parted
    same[:1] = False
    return places[interleave], same


def repeated_windows(strings: list[np.ndarray], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string the starts of its windows that also start elsewhere in ``strings``; ``length`` is a multiple of ``STEP``."""
    shards, own, held = [], [], 0
    for s in strings:
        own.append(s)
        held += len(s) + STEP
        if held >= shard_bytes:
            shards.append(transform(own, length))
            own, held = [], 0
    if own:
        shards.append(transform(own, length))
    place, same = merged(shards, length)
    again = same | np.append(same[1:], False)
    sizes = np.array([len(s) + STEP for s in strings])
    ends = np.cumsum(sizes)
    at = np.sort(place[again])
    which = np.searchsorted(ends, at, "right")
    offset = at - (ends - sizes)[which]
    cut = np.searchsorted(which, np.arange(len(strings) + 1))
    return [offset[cut[i] : cut[i + 1]] for i in range(len(strings))]


def spans_of(starts: np.ndarray, length: int) -> list[dict]:
    """Ascending window starts as maximal spans of bytes."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return [{"lo": int(a), "hi": int(b) + length} for a, b in zip(starts[np.concatenate(([0], gap + 1))], starts[np.append(gap, len(starts) - 1)], strict=True)]


SPANS = "array<struct<lo:long,hi:long>>"
SPANS_ARROW = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, name and bytes of the stretches in ``wanted`` (anchor, name, at: doc_id, key, start, run)."""
    per_doc = wanted.groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.key").alias("w_key")).agg(F.collect_list(F.struct("anchor", "name", F.col("at.start").alias("start"), (F.col("at.run") + length - 1).alias("size"))).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(large(batch.column("text")))
            cuts = batch.column("cuts")
            flat = cuts.flatten()
            n = np.diff(np.asarray(cuts.offsets))
            start = flat.field("start").to_numpy() + np.repeat(offs[:-1], n)
            size = flat.field("size").to_numpy()
            for lo in range(0, len(start), 20_000):
                some = slice(lo, lo + 20_000)
                data = [buf[s : s + z].tobytes() for s, z in zip(start[some].tolist(), size[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field("anchor")[some], flat.field("name")[some], pa.array(data, pa.binary())], names=["anchor", "name", "data"])

    met = docs.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")))
    # a row that stands twice has its stretches cut twice
    return met.select("text", "cuts").mapInArrow(run, "anchor long, name long, data binary")


def merged_spans(cut: DataFrame, buckets: int, length: int, shard_bytes: int) -> DataFrame:
    """anchor, name and the spans of each stretch that other stretches of its anchor have too."""

    def solve(table: pa.Table) -> pa.Table:
        table = table.group_by(["anchor", "name"]).aggregate([("data", "min")])
        strings = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("data_min")]
        found = [spans_of(x, length) for x in repeated_windows(strings, length, shard_bytes)]
        return pa.table({"anchor": table.column("anchor"), "name": table.column("name"), "spans": pa.array(found, SPANS_ARROW)})

    return cut.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(solve, f"anchor long, name long, spans {SPANS}")


def counted_spans(cut: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many stretches for a task: windows are counted by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, name, data in zip(batch.column("anchor").to_pylist(), batch.column("name").to_pylist(), batch.column("data"), strict=True):
                buf = np.frombuffer(data.as_buffer(), dtype=np.uint8)
                at = np.arange(len(buf) - length + 1)
                one, two = (RollingHash(buf, k).of(at, at + length).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * len(at)), pa.array([name] * len(at)), pa.array(at), pa.array(one), pa.array(two)], names=["anchor", "name", "at", "one", "two"])

    windows = cut.mapInArrow(run, "anchor long, name long, at long, one long, two long").distinct()
    again = materialise(windows.groupBy(F.col("one").alias("o"), F.col("two").alias("t")).agg(F.count("*").alias("n")).filter("n > 1"), "windows")
    met = windows.join(again, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t")))
    starts = met.groupBy("anchor", "name").agg(F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))).alias("spans"))
    return starts.select("anchor", "name", "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``kept_text``, kept bytes too.

    A byte goes if it is covered by ``length`` bytes that start anywhere else too, in any row. Null and
    empty texts have no bytes. Rows that repeat a doc_id are texts of their own; a row that stands twice
    loses all windows. Texts shorter than ``length`` stay whole. A null doc_id is a row like others. An
    empty table gives no rows. Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    seen = occurrences(docs, length)
    anchors = seen.groupBy(F.col("anchor").alias("a_anchor")).agg(F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi"))
    anchors = materialise(anchors.filter("n > 1").select("a_anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    shared = materialise(seen.join(anchors, F.col("anchor") == F.col("a_anchor")).drop("a_anchor"), "stretches")
    mixed = shared.filter("mixed")
    distinct = mixed.groupBy("anchor", "name").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "start", "run")).alias("at"))
    distinct = materialise(distinct, "distinct")
    sizes = distinct.groupBy(F.col("anchor").alias("s_anchor")).agg(F.sum(F.col("at.run") + length).alias("volume"))
    cut = materialise(fetched(docs, distinct, length).join(sizes, F.col("anchor") == F.col("s_anchor")).withColumn("large", F.col("volume") > bucket_bytes).drop("s_anchor", "volume"), "cut")
    volume = cut.filter("not large").agg(F.coalesce(F.sum(F.length("data") + 1), F.lit(0))).first()[0]
    buckets = max(1, -(-volume // bucket_bytes))
    some = merged_spans(cut.filter("not large").drop("large"), buckets, length, shard_bytes).union(counted_spans(cut.filter("large").drop("large"), length))
    some = materialise(some.filter(F.size("spans") > 0).select(F.col("anchor").alias("m_anchor"), F.col("name").alias("m_name"), "spans"), "spans")
    whole = F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("run") + length - 1).alias("hi")))
    whole_names = distinct.filter("n > 1").select(F.col("anchor").alias("m_anchor"), F.col("name").alias("m_name"))
    of_string = (F.col("anchor") == F.col("m_anchor")) & (F.col("name") == F.col("m_name"))
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi")))
    removed = (
        shared.filter("not mixed").select("doc_id", "key", whole.alias("spans"))
        .union(mixed.join(whole_names, of_string).select("doc_id", "key", whole.alias("spans")))
        .union(mixed.join(some, of_string).select("doc_id", "key", moved.alias("spans")))
    )
    removed = removed.groupBy(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key")).agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffer_of(large(batch.column("text")))
            spans = batch.column("spans")
            bounds, flat = np.asarray(spans.offsets), spans.values
            lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
            rows = []
            for i in range(batch.num_rows):
                own = buf[offs[i] : offs[i + 1]]
                if bounds[i] == bounds[i + 1]:
                    rows.append((len(own), 0, 0, own.tobytes()))
                    continue
                edge = np.zeros(len(own) + 1, dtype=np.int64)
                np.add.at(edge, lo[bounds[i] : bounds[i + 1]], 1)
                np.add.at(edge, hi[bounds[i] : bounds[i + 1]], -1)
                gone = np.cumsum(edge[:-1]) > 0
                rows.append((len(own), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), own[~gone].tobytes()))
            size, n, runs, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            out = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if kept_text:
                out.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)

    met = docs.join(removed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left")
    met = met.select("doc_id", "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
