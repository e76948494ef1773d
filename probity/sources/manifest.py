"""Corpora and archive manifests: names, limits, formats, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.schemas import ASSET_TYPES, DEFAULT, SEVERITIES, Thresholds

IMAGES, TEXTS = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff"), ("txt", "json", "csv", "xml", "yaml", "yml")
IMAGE_FORMATS, UNTRIED = ("png", "jpeg", "gif", "bmp", "webp", "tiff"), ("webp", "tiff")
IMAGE_PIXELS = 64_000_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind_of(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*TEXTS), "text").otherwise("other")


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, sha256 and kind of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), kind_of(F.col("path")).alias("kind"))


def _number(content: Column, at: int, size: int, little: bool = True) -> Column:
    """The unsigned number in ``size`` bytes from byte ``at`` (the first is 1) on."""
    order = range(at + size - 1, at - 1, -1) if little else range(at, at + size)
    return F.conv(F.concat(*[F.hex(F.substring(content, k, 1)) for k in order]), 16, 10).cast("long")


def declared_sides(content: Column) -> Column:
    """Width and height that the head of a PNG, GIF or BMP declares, as a struct; null for other formats and cut heads."""
    kind, size = sniffed(content), F.octet_length(content)
    signed = lambda x: F.abs(F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))  # noqa: E731  a BMP may run from the top
    sides = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return (
        F.when((kind == "png") & (size >= 24), sides(_number(content, 17, 4, False), _number(content, 21, 4, False)))
        .when((kind == "gif") & (size >= 10), sides(_number(content, 7, 2), _number(content, 9, 2)))
        .when((kind == "bmp") & (size >= 26), sides(signed(_number(content, 19, 4)), signed(_number(content, 23, 4))))
    )


def image_fault(content: Column, decoded: Column, pixels: int = IMAGE_PIXELS) -> Column:
    """Why an image cannot be read, or null: ``decoded`` says whether a decoder could (null: none was tried).

    A head that names no image format is an unrecognised container; a side of 0 and more than twice ``pixels`` are
    faults by the head alone, whatever the decoder made of them. A null content is unrecognised.
    """
    sides = declared_sides(content)
    return (
        F.when(~F.coalesce(sniffed(content).isin(*IMAGE_FORMATS), F.lit(False)), "unrecognised-container")
        .when((sides["width"] <= 0) | (sides["height"] <= 0), "invalid-dimensions")
        .when(sides["width"] * sides["height"] > 2 * pixels, "decompression-bomb")
        .when(~decoded, "decode-error")
    )


def decode_failures(spark: SparkSession, folder: str, pixels: int = IMAGE_PIXELS) -> DataFrame:
    """reason, n, share and severity of the images below a folder that cannot be read, as ``corrupt_by_reason`` gives them.

    Files that no extension declares an image are left out. Formats that Spark's image reader does not know
    (``UNTRIED``) are judged by their heads only, and its decoder lets an end pass that is cut after the pixels. Spark's readers skip
    files of no bytes, so these are not counted. A folder without faults gives no rows.
    """
    place = F.col("_metadata.file_path")
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(kind_of(F.col("path")) == "image")
    heads = heads.select(place.alias("path"), F.substring("content", 1, 32).alias("head"))  # the bytes stay where they are read
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    images = images.select(place.alias("i_path"), (F.col("image.width") >= 0).alias("decoded"))
    met = heads.join(images, F.col("path") == F.col("i_path"), "left")
    tried = F.when(~sniffed(F.col("head")).isin(*UNTRIED), F.coalesce("decoded", F.lit(False)))
    return corrupt_by_reason(met.select(image_fault(F.col("head"), tried, pixels).alias("reason")))


def path_fault(path: Column, t: Thresholds = DEFAULT) -> Column:
    """Why an archive entry's name is unsafe, or null."""
    slashed = F.translate(path, "\\", "/")
    parts = F.split(slashed, "/")
    return (
        F.when(path.isNull() | F.trim(path).isin("", ".", ".."), "EMPTY")
        .when(slashed.startswith("/") | path.rlike("^[A-Za-z]:"), "ABSOLUTE")
        .when(F.instr(path, "\0") > 0, "NUL")
        .when(F.array_contains(parts, ".."), "TRAVERSAL")
        .when(F.size(parts) > t.entry_depth, "TOO_DEEP")
        .when(F.length(path) > t.entry_length, "TOO_LONG")
        .when(~F.exists(parts, lambda p: ~p.isin("", ".")), "ESCAPES")
    )


def manifest_faults(manifest: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Fault of every entry, and whether the archive was given up at or before it.

    Columns: archive_id, entry_no, file_size, compressed_size, is_link. Bytes are summed over accepted
    entries; the first breach of an archive's total ends it.
    """
    own = F.when(F.col("is_link"), "LINK").when(F.col("file_size") > t.entry_bytes, "OVERSIZED").when((F.col("compressed_size") > 0) & (F.col("file_size") / F.col("compressed_size") > t.entry_ratio), "RATIO")
    up = Window.partitionBy("archive_id").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = manifest.withColumn("fault", own)
    total = F.sum(F.when(F.col("fault").isNull(), F.col("file_size")).otherwise(0)).over(up)
    return rows.select("archive_id", "entry_no", "fault", total.alias("accepted_bytes"), ((total > t.archive_bytes) | (F.count("*").over(up) > t.archive_entries)).alias("aborted"))


MAGIC = (("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp"), ("504B0304", "zip"), ("25504446", "pdf"), ("3C21444F", "html"), ("3C68746D", "html"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))
RIFF, WEBP = "52494646", "57454250"  # a RIFF container says at byte 9 what it holds


def sniffed(content: Column) -> Column:
    """Format by the first bytes (of a binary column), or ``unknown``."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith(RIFF) & (F.substring(head, 17, 8) == WEBP), "webp").otherwise("unknown")
    for magic, name in reversed(MAGIC):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


#: extensions that name a format otherwise than itself
NAMED = {"jpg": "jpeg", "tif": "tiff", "htm": "html"}


def format_mismatches(files: DataFrame) -> DataFrame:
    """Files whose extension declares another known format than their first bytes. Columns: path, content (binary).

    Unknown bytes and extensions that name none of the formats in ``MAGIC`` are not judged.
    """
    declared = extension(F.col("path"))
    for short, name in NAMED.items():
        declared = F.when(declared == short, name).otherwise(declared)
    known = [*dict.fromkeys(name for _, name in MAGIC), "webp"]
    rows = files.withColumns({"declared": declared, "format": sniffed(F.col("content"))})
    return rows.filter(F.col("declared").isin(*known) & (F.col("format") != "unknown") & (F.col("declared") != F.col("format"))).drop("content")


def corrupt_by_reason(files: DataFrame) -> DataFrame:
    """reason, n, share of all files and severity of files that cannot be read. Columns: reason (null: readable)."""
    per = files.groupBy("reason").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # over the reasons
    bad = F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    rows = per.withColumns({"share": F.round(share, 6), "severity": F.when(bad > 0.02, "HIGH").otherwise("MEDIUM")})
    return rows.filter("reason is not null")


def violations(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """One row for each row and rule that it breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def evidence_rules() -> dict[str, Column]:
    """Rules of the evidence tables: domains, digests, finite numbers."""
    return {
        "severity": F.col("severity").isin(*SEVERITIES),
        "type": F.col("type").isin(*ASSET_TYPES),
        "digest": F.col("digest").rlike("^[0-9a-f]{64}$"),
        "confidence": F.col("confidence").between(0, 1) & ~F.isnan("confidence"),
    }
