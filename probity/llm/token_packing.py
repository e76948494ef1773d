"""Token ids, packed into fixed-length rows.

Documents go to shards by a hash of doc_id and text, enough of them that a shard's text is bounded. A shard is
one task: it tokenises its documents, splits those longer than a row into full rows and a rest, and
packs the pieces by best-fit decreasing. The open row with the least room that still suffices is found
by a segment tree over capacities. Every packed row holds ids (little-endian, padded), the cumulative
lengths of its segments and positions that restart with each segment.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50_256  # closes every document; free in the vocabulary
ROW = 2_048
SHARD_BYTES = 8 << 20
#: a run of blanks (Unicode's White_Space) that is cut before the pattern sees it: its look-ahead needs a stack and time that grow with the run's square
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")


class CapacityTree:
    """How many open rows have each capacity; finds the least capacity of at least c in O(log row)."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def least(self, capacity: int) -> int:
        """The least capacity from ``capacity`` on that some open row has, or -1."""
        node = self.size + capacity
        if self.count[node]:
            return capacity
        while node > 1:
            if not node & 1 and self.count[node + 1]:  # a right sibling holds larger capacities
                node += 1
                while node < self.size:
                    node *= 2
                    node += not self.count[node]
                return node - self.size
            node >>= 1
        return -1


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Pieces (by place in ``lengths``, which are 1 to ``row``) of each packed row; the longest go first."""
    tree, open_rows, rows = CapacityTree(row), [[] for _ in range(row + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room < 0:
            at, room = len(rows), row
            rows.append([])
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
        rows[at].append(i)
        if room > lengths[i]:
            open_rows[room - lengths[i]].append(at)
            tree.add(room - lengths[i], 1)
    return rows


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """The tokenizer of a vocabulary file's bytes; made once in each worker."""
    import tiktoken

    pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})


def tokenised(tokenizer, text: str) -> Iterator[int]:
    """The ids of ``text``, long runs of blanks cut as the pattern cuts them.

    The pattern takes a run but for its last blank as one piece, the whole run at the end of a text; the
    last blank goes on with what follows.
    """
    at = 0
    for blank in LONG_BLANK.finditer(text):
        end = blank.end() - (blank.end() < len(text))
        yield from tokenizer.encode_ordinary(text[at : blank.start()])
        yield from tokenizer._encode_single_piece(text[blank.start() : end])
        at = end
    yield from tokenizer.encode_ordinary(text[at:])


PACKED = "shard long, row int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<int>, n_tokens int"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, row: int = ROW, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed rows of all documents.

    shard and row name a packed row; input_ids are ``row`` ids (uint16 if all fit, else uint32),
    ``end_id`` as padding; segment i is ids cu_seqlens[i] to cu_seqlens[i + 1], the tokens of doc_ids[i]
    from starts[i] on; position_ids (uint16 or uint32) restart at 0 with every segment and with the
    padding. A document's segments by ``starts`` are its whole text and one ``end_id``. Null and empty
    texts are ``end_id`` alone. Rows that repeat a doc_id are documents of their own, told apart by
    their segments only. Nulls stand in doc_ids where doc_id is null. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    id_type = np.dtype("<u2") if end_id < 1 << 16 and len(ranks.value.splitlines()) < 1 << 16 else np.dtype("<u4")
    at_type = np.dtype("<u2") if row <= 1 << 16 else np.dtype("<u4")

    def run(table: pa.Table) -> pa.Table:
        tokenizer = encoding(ranks.value, pattern)
        order = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        doc, start, ids = [], [], []
        for name, text in zip(order.column("doc_id").to_pylist(), order.column("text"), strict=True):
            own = np.array([*tokenised(tokenizer, text.as_py() or ""), end_id], dtype=id_type)
            for at in range(0, len(own), row):
                doc.append(name)
                start.append(at)
                ids.append(own[at : at + row])
        shard = table.column("shard")[0].as_py()
        out: dict[str, list] = {c.split(" ")[0]: [] for c in PACKED.split(", ")}
        for k, pieces in enumerate(best_fit([len(x) for x in ids], row)):
            lengths = [len(ids[i]) for i in pieces]
            used = sum(lengths)
            line = np.full(row, end_id, dtype=id_type)
            line[:used] = np.concatenate([ids[i] for i in pieces])
            ends = np.concatenate(([0], np.cumsum(lengths)))
            place = np.arange(row) - np.repeat(np.append(ends[:-1], used), [*lengths, row - used])
            for column, x in zip(out, (shard, k, line.tobytes(), ends.tolist(), place.astype(at_type).tobytes(), [doc[i] for i in pieces], [start[i] for i in pieces], used), strict=True):
                out[column].append(x)
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), types, strict=True)})

    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"))
    return placed.repartition(shards, "shard").groupBy("shard").applyInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, a folder for each shard's matrix."""
    packed.write.partitionBy("shard").parquet(path)


def op5_token_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
