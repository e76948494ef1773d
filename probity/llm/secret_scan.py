"""Secret scans weighed by corpus-wide ownership.

Every text is scanned for candidate credentials. Values are hashed, and each hash is counted over the
whole corpus by distinct repositories and distinct owners: a value that many owners or repositories
hold is a copied example, one that few hold and that looks random is a live-looking credential of its
owner. Base kinds
(assign, access, hex) are always reported; of the wider ``random`` candidates those that are
owner-specific are added. Values leave a task as hashes only.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.textbatch import byte_class, parts, word_spans
from probity.storage import materialise

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RANDOM = re.compile(r"[A-Za-z0-9_-]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, RANDOM_LEAST = 8, 16, 32, 24
RANDOM_BITS = 3.5  # of entropy a character
LIVE_OWNERS = 2  # at most, of a live-looking value
LIVE_REPOSITORIES = 20  # likewise
KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = 3
ASSIGN_HINTS = ("passw", "secret", "token", "api")


def _only(chars: str) -> np.ndarray:
    return byte_class(bytes(i for i in range(256) if chr(i) not in chars))


HEX_BYTES = _only("0123456789abcdef")
RANDOM_BYTES = _only("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
DIGIT_BYTES = _only("0123456789")


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, kind, end and value of every base match, in code points, in order."""
    low = text.lower()
    found = []
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found


def hex_spans(text: str) -> list[tuple[int, int, int, str]]:
    return [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]


def random_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with a digit, a capital and a small letter and high entropy that touch no base match."""
    starts = [s for s, *_ in base]  # ascending
    reach = list(accumulate((e for _, _, e, _ in base), max))
    out = []
    for m in RANDOM.finditer(text):
        v = m[0]
        before = bisect_left(starts, m.end())
        if len(v) >= RANDOM_LEAST and re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v) and entropy(v) >= RANDOM_BITS and (not before or reach[before - 1] <= m.start()):
            out.append((m.start(), 3, m.end(), v))
    return out


def spelled(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(spans))


FOUND = "array<struct<start:int,kind:int,end:int,hash:string>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, repository, owner, a key of the row's text, base counts and digest, and all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in parts(batch):
                n = part.num_rows
                long_hex, long_random = np.zeros(n, bool), np.zeros(n, bool)
                start, end, row = word_spans(buf, offs, HEX_BYTES)
                long_hex[row[end - start >= HEX_LEAST]] = True
                start, end, row = word_spans(buf, offs, RANDOM_BYTES)
                wide = end - start >= RANDOM_LEAST
                start, end, row = start[wide], end[wide], row[wide]
                digits = np.concatenate(([0], np.cumsum(DIGIT_BYTES[buf])))
                long_random[row[digits[end] > digits[start]]] = True
                out: dict[str, list] = {k: [] for k in ("key", "n_assign", "n_access", "n_hex", "base_sha256", "base_spans", "found")}
                for i, text in enumerate(part.column("text").to_pylist()):
                    text = text or ""
                    base = base_spans(text)
                    if long_hex[i]:
                        base += hex_spans(text)
                    base.sort()
                    found = base + (random_spans(text, base) if long_random[i] else [])
                    count = Counter(k for _, k, _, _ in base)
                    spans = spelled(base)
                    for name, x in zip(out, (int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if found else 0, count[0], count[1], count[2], hashlib.sha256(spans.encode()).hexdigest(), spans, [{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in found]), strict=True):
                        out[name].append(x)
                types = {"found": pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())])), "base_sha256": pa.string(), "base_spans": pa.string()}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("repository"), part.column("owner"), *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], names=["doc_id", "repository", "owner", *out])

    return docs.mapInArrow(run, f"doc_id long, repository string, owner string, key long, n_assign long, n_access long, n_hex long, base_sha256 string, base_spans string, found {FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """For every candidate hash: distinct repositories and distinct owners in the corpus.

    Pairs of a hash and a holder are made distinct before they are counted, so that a hash that all hold
    is spread over its holders.
    """
    held = [found.select("hash", c).distinct().groupBy(F.col("hash").alias(f"{c}_hash")).agg(F.count("*").alias(n)) for c, n in (("repository", "repositories"), ("owner", "owners"))]
    return held[0].join(held[1], F.col("repository_hash") == F.col("owner_hash")).select(F.col("owner_hash").alias("o_hash"), "repositories", "owners")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """Every row's secrets: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_owners, most_repositories.

    ``spans`` lists kind:start:end of base matches and of owner-specific random-looking tokens, by
    start, then kind. n_live counts the candidates held by at most ``live_owners`` owners and at most
    ``live_repositories`` repositories, n_copied the others; most_owners and most_repositories are the
    most that hold one of the row's candidates (0 without any). Null texts are empty and have no spans; rows that repeat a doc_id are scanned each by
    its own text, and a repeated row counts again in its hash's occurrences but not in distinct
    repositories or owners. A null repository or owner counts as one of its own. An empty table gives
    no rows. Other columns are not read.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    rows = materialise(scanned(docs.select("doc_id", name(repository).alias("repository"), name(owner).alias("owner"), "text")), "scanned")
    found = rows.filter(F.size("found") > 0).select("doc_id", "key", "repository", "owner", F.explode("found").alias("f")).select("doc_id", "key", "repository", "owner", "f.*")
    known = found.join(ownership(found), F.col("hash") == F.col("o_hash"))
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    kept = F.struct("start", "kind", "end")
    # rows with the same doc_id and text have the same spans
    by_row = known.groupBy(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key")).agg(
        F.sort_array(F.collect_set(F.when((F.col("kind") < BASE_KINDS) | live, kept))).alias("all"),
        F.count_distinct(F.when(live, kept)).alias("n_live"),
        F.count_distinct(F.when(~live, kept)).alias("n_copied"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    kind = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = rows.join(by_row, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key")) & (F.size("found") > 0), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, "base_spans").alias("spans"), *map(zero, ("n_live", "n_copied", "most_owners", "most_repositories")))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
