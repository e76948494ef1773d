"""WARC archives and their globally ordered capture index.

Archives are written by Spark's text writer: a record's head and block are the value, and the two line
ends that close a record are the line separator, so a file of rows is a WARC file. Payloads stay the
bytes they are. Reading takes whole files, which ``records_per_file`` and ``file_bytes`` bound, and
follows Content-Length, so payloads may hold anything.

The index is merged externally. Every archive gives a run: its captures in order of URL key, date and
record. Captures go by range of that order to tasks, each of which holds the slices of the runs that
fall in its range and merges them with a loser tree; ranges follow each other, so the whole is in
global order. Ranges cut inside a URL's history where it is long.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.storage import materialise, new_path

RECORDS_PER_FILE = 20_000
FILE_BYTES = 64 << 20  # of a file's plain stream; a larger record has a file of its own
RANGE_CAPTURES = 200_000  # of an index range, which one task merges
REVISIT_LEAST = 0  # bytes; smaller payloads are always responses
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
SAFE = re.compile(r"%([0-9A-F]{2})")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 5 hex digits are 4 base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def header_safe(text: Column) -> Column:
    """Percent signs and control characters of a header's value in percent form, to be undone exactly."""
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def capture_records(pages: DataFrame, revisit_least: int = REVISIT_LEAST, start: str = "2020-01-01 00:00:00") -> DataFrame:
    """page_id, url, date, digest, length, refers_to (null: a response) and payload of each page.

    Of equal payloads of ``revisit_least`` bytes or more that with the largest page_id is the response.
    A page's date is its column ``fetched`` if there is one, else ``start`` and page_id seconds.
    """
    date = F.col("fetched") if "fetched" in pages.columns else F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.coalesce(F.pmod("page_id", F.lit(1 << 31)), F.lit(0)))
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", date.alias("date"), payload.alias("payload")).withColumns({"digest": base32_sha1(F.encode("payload", "utf-8")), "length": F.octet_length("payload").cast("long")})
    last = rows.filter(F.col("length") >= revisit_least).groupBy(F.col("digest").alias("r_digest"), F.col("length").alias("r_length")).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    met = rows.join(last.filter("n > 1"), (F.col("digest") == F.col("r_digest")) & (F.col("length") == F.col("r_length")), "left")
    return met.select("page_id", "url", "date", "digest", "length", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"), "payload")


def filed(size: Column, most: int) -> Column:
    """The file, from 0 on in each task, of rows of these sizes, so that a file of several rows has at most ``most`` bytes.

    Only the sizes leave the JVM.
    """

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        file, held = 0, 0
        for sizes in batches:
            out = []
            for n in sizes:
                if held and held + n > most:
                    file, held = file + 1, 0
                held += n
                out.append(file)
            yield pd.Series(out, dtype="int64")

    return place.asNondeterministic()(size)


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Write ``capture_records`` as WARC/1.1 files under ``path``. Revisits carry no block.

    A file holds at most ``records_per_file`` records and, of several, ``file_bytes`` bytes of plain stream.
    With gzip a file is one compressed stream; offsets in the index are those of the plain stream.
    """
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    is_revisit = F.col("refers_to").isNotNull()
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), header_safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(is_revisit, F.concat(F.lit("X-Payload-Length: "), F.col("length"))),
        F.concat(F.lit("Content-Length: "), F.when(is_revisit, 0).otherwise(F.col("length"))),
    )
    block = F.when(is_revisit, "").otherwise(F.col("payload"))
    rows = records.select(F.concat(head, F.lit(END), block).alias("value"))
    rows = rows.withColumn("file_no", filed(F.octet_length("value") + len(END), file_bytes))
    rows.write.partitionBy("file_no").option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def url_key(url: str | None) -> str:
    """A sort key: host labels reversed, without scheme, leading www, fragment and default port; then the path."""
    if url is None:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r":(80|443)$", "", host.rpartition("@")[2].lower())
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def parsed(stream: IO[bytes]) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Headers, offset and block of every record of a WARC file; one record is held at a time."""
    at = 0
    while line := stream.readline():
        head, size = {}, len(line)
        while (line := stream.readline()) != b"\r\n":
            size += len(line)
            name, colon, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            if colon:
                head[name] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, at, block
        at += size + 2 + len(block) + 4


def page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


CAPTURE = "run string, key string, date string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long"


def read_warc(spark, path: str, payloads: bool = False) -> DataFrame:
    """The captures of all archives under ``path``, each file's in the order of the index: its run.

    A response's digest and length are those of the block that was read; a difference from the header
    raises. With ``payloads``, the block too (null for revisits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                stream = io.BytesIO(data.as_buffer())
                for head, at, block in parsed(gzip.GzipFile(fileobj=stream) if name.endswith(".gz") else stream):
                    kind = head["WARC-Type"]
                    url = head.get("WARC-Target-URI")
                    url = None if url is None else SAFE.sub(lambda m: chr(int(m[1], 16)), url)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["X-Payload-Length"] if kind == "revisit" else head["Content-Length"])
                    body = None if kind == "revisit" else block
                    if body is not None and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"{name} at {at}: the payload does not have its digest")
                    rows.append(("/".join(name.split("/")[-2:]), url_key(url), head["WARC-Date"], page_of(head["WARC-Record-ID"]), url, kind, page_of(head["WARC-Refers-To"]) if kind == "revisit" else None, size, digest, at, body if payloads else None))
                rows.sort(key=order)
                for lo in range(0, len(rows), 2000):
                    columns = list(zip(*rows[lo : lo + 2000], strict=True))
                    types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                    if payloads:
                        arrays.append(pa.array(columns[10], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, names=NAMES + ["payload"] * payloads)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURE + ", payload binary" * payloads)


NAMES = [c.split(" ")[0] for c in CAPTURE.split(", ")]
ORDER = ("key", "date", "page_id", "run", "offset")


def order(row: tuple) -> tuple:
    """The index's order of a capture in the columns of ``CAPTURE``; a null record comes first."""
    return (row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[9])


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or a < b or (a == b and i < j))

    def _enter(self, winner: int) -> None:
        """First fill: a contestant waits at the first empty node, else plays on."""
        node = (winner + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        while self.k and self.heads[(winner := self.losers[0])] is not None:
            yield self.heads[winner], winner
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.k) // 2
            while node > 0:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def merged_index(captures: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """The captures in global order, with ``rank``, their place in it from 1 on.

    ``captures`` must be a written table: it is counted and sampled for the ranges first.
    """
    n = captures.count()
    ranges = max(1, -(-n // range_captures))
    spread = captures.repartitionByRange(ranges, *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = list(zip(*(table.column(c).to_pylist() for c in ORDER), strict=True))
        keys = [(k, d, p is not None, p or 0, r, o) for k, d, p, r, o in keys]
        # a shuffle may interleave blocks of a run: each ascending stretch is merged as a run of its own
        runs: list[list[tuple]] = []
        of_run: dict[str, list[tuple]] = {}
        for i, key in enumerate(keys):
            own = of_run.get(key[4])
            if own is None or own[-1][0] > key:
                own = of_run[key[4]] = []
                runs.append(own)
            own.append((key, i))
        taken = np.fromiter((head[1] for head, _ in LoserTree([iter(r) for r in runs])), np.int64, len(keys))
        out = table.take(pa.array(taken))
        out = out.append_column("range_no", pa.array([TaskContext.get().partitionId()] * len(keys), pa.int32())).append_column("position", pa.array(range(len(keys)), pa.int64()))
        yield from out.to_batches(max_chunksize=5000)

    merged = materialise(spread.mapInArrow(run, CAPTURE + ", range_no int, position long"), "index")
    sizes = merged.groupBy(F.col("range_no").alias("r_no")).agg(F.count("*").alias("r_size"))  # a row a range
    before = Window.orderBy("r_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("r_no", F.coalesce(F.sum("r_size").over(before), F.lit(0)).alias("r_start"))
    return merged.join(sizes, F.col("range_no") == F.col("r_no")).withColumn("rank", F.col("r_start") + F.col("position") + 1).drop("r_no", "r_start", "range_no", "position")


def archived(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE, revisit_least: int = REVISIT_LEAST, range_captures: int = RANGE_CAPTURES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files, read them back and merge their index.

    One row a page. Null html is the empty payload; a null url sorts first with an empty key. Rows that
    repeat a page_id are records of their own; of equal payloads those with the largest page_id are all
    responses. A null page_id is never a response that others refer to, unless no other is left. An
    empty table gives no rows. Other columns but ``fetched`` are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(capture_records(pages, revisit_least), path, records_per_file, file_bytes=file_bytes)
    captures = materialise(read_warc(spark, path), "captures")
    return merged_index(captures, range_captures)


def op1_warc_index_merge(spark, sf_dir: str) -> DataFrame:
    index = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").alias("url_key"), F.col("date").alias("warc_date"), "rank")


# base32 in SQL: the 40 bits of 10 hex digits as 8 letters
_HEX = "upper(sha1(coalesce(html, '')))"
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr({_HEX}, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * i}) & 31 AS INTEGER) + 1, 1)" for g in range(4) for i in range(8)
)
ORACLE = {
    "op1_warc_index_merge": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, {_LETTERS} AS digest,
  split_part(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#', 1) AS rest FROM pages),
m AS (SELECT html, max(page_id) AS last, count(*) AS copies FROM p GROUP BY html),
k AS (SELECT p.*, last, copies, split_part(rest, '/', 1) AS host0 FROM p JOIN m ON p.html = m.html),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(host0, '^.*@', '')), ':(80|443)$', ''), '^www\\.', '') AS host FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to,
  coalesce(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(rest, len(host0) + 1), '') AS url_key,
  strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 2147483648), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
  row_number() OVER (ORDER BY url_key, warc_date, page_id) AS rank FROM h"""
}
