"""Clusters of images of one class that share a pattern: a stamp at one place, or an overlay on the whole image.

Images (id, label, pixels of 0 to 255, h, w, c) of one size are compared with two references, the median
image of their class and that of the corpus; medians are exact, from counts of values by place. A
stamp makes independent images differ most from the reference at the same place: peaks of smoothed
residuals are counted by cell, and cells with more than chance allows (Poisson tail, Bonferroni) are tested further.
Agreement of n patterns is their mean pairwise correlation, (|sum z|^2 - sum |z|^2) / (n (n - 1)) for
normalised z, so it is made of sums. Overlays have no peak; they are the neighbourhood of the image
whose coarse residual agrees with most others of its class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators.pixels import box_sums, family, stacks, summed
from probity.operators.prefix import quantiles
from probity.storage import materialise

# values fixed by the method
PATCH_AGREEMENT = 0.80
OVERLAY_AGREEMENT = 0.85
LOCALITY = 2.0
CONTRAST = 1.5  # of a stamp's place against the same place outside the class
COPIES = 0.95  # agreement of whole images from which they are copies of one another
ALPHA = 0.01
LEAST_CLASS = 12
LEAST_MEMBERS = 3
MOST_SHARE = 0.6  # of a class that an overlay may hold
OVERLAP = 0.5

PART_IMAGES = 256  # of a class in one task
MOST_IMAGES, OVERLAY_BLOCKS = 32_768, 8  # of a block of coarse residuals, and how many blocks there are until they hold that many
PRODUCTS = 1 << 22  # made at once
BLOCK_CLUSTERS = 16  # whose references are sent to all tasks at once
KEY = ("label", "reference", "cell_y", "cell_x")
KEY_TYPES = "label string, reference string, cell_y int, cell_x int"
OVERLAY_CELL = -1


def smoothed(stack: np.ndarray, size: int) -> np.ndarray:
    """Means over boxes of ``size`` // 2 to each side, cut at the border."""
    ends = [(np.maximum(np.arange(n) - size // 2, 0), np.minimum(np.arange(n) + size // 2 + 1, n)) for n in stack.shape[-2:]]
    return box_sums(summed(stack), *ends) / np.multiply.outer(*(b - a for a, b in ends))


def normalised(rows: np.ndarray) -> np.ndarray:
    """Rows without their means, of length 1; constant rows are zero."""
    centred = rows - rows.mean(axis=1, keepdims=True)
    length = np.linalg.norm(centred, axis=1, keepdims=True)
    return centred / np.where(length > 0, length, 1)


def poisson_tail(k: int, mean: float) -> float:
    """The chance of ``k`` or more where ``mean`` are expected."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    log_term = k * math.log(mean) - mean - math.lgamma(k + 1)
    if k <= mean:  # the lesser side has fewer terms that count
        total, term, i = 0.0, 1.0, k
        while i > 0 and term > 1e-18:
            term *= i / mean
            total += term
            i -= 1
        return max(0.0, 1.0 - math.exp(log_term) * total)
    total = term = 1.0
    i = k
    while term > 1e-18 * total:
        i += 1
        term *= mean / i
        total += term
    return min(1.0, math.exp(log_term) * total)


def _table(kinds: str, columns: list) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    named = [c.split(" ") for c in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, (_, t) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _same(a: str, b: str):
    out = None
    for k in KEY:
        one = F.col(f"{a}{k}") == F.col(f"{b}{k}")
        out = one if out is None else out & one
    return out


def _as(prefix: str) -> list:
    return [F.col(k).alias(f"{prefix}{k}") for k in KEY]


class Scan:
    """Images of one size with their residuals, and the sizes of the method."""

    def __init__(self, images: DataFrame, height: int, width: int, channels: int, patch: int, cell: int, coarse: int):
        self.shape, self.patch, self.cell, self.coarse = (height, width, channels), patch, cell, coarse
        self.area = height * width
        self.pictures = materialise(self._pictures(images), "pictures")
        sizes = self.pictures.groupBy(F.col("label").alias("n_label")).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_CLASS)
        self.sizes = materialise(sizes, "sizes")
        self.residuals = materialise(self._residuals(), "residuals")

    def _pictures(self, images: DataFrame) -> DataFrame:
        """id, label and bytes of the whole images of the size, sorted by label in each task."""
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, stack in stacks(batch):
                    if stack.shape[1:] == shape:
                        yield _table("id long, label string, pixels binary", [batch.column("id").take(rows), batch.column("label").take(rows), [x.tobytes() for x in np.clip(np.rint(stack), 0, 255).astype(np.uint8)]])

        own = images.filter(F.col("label").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "pixels", "h", "w", *(["c"] if "c" in images.columns else []))
        return own.mapInArrow(run, "id long, label string, pixels binary").sortWithinPartitions("label")

    def _medians(self) -> DataFrame:
        """m_label and, as float64 bytes, the medians by place of its class and of the corpus."""
        size = math.prod(self.shape)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            label, held = None, np.zeros(size * 256, dtype=np.int64)
            place = np.arange(size) * 256

            def counted() -> pa.RecordBatch:
                some = np.flatnonzero(held)
                made = _table("label string, place int, value int, n long", [[label] * len(some), some // 256, some % 256, held[some]])
                held[:] = 0
                return made

            for batch in batches:
                for name, raw in zip(batch.column("label").to_pylist(), batch.column("pixels"), strict=True):
                    if name != label:
                        if label is not None:
                            yield counted()
                        label = name
                    held[place + np.frombuffer(raw.as_buffer(), dtype=np.uint8)] += 1
            if label is not None:
                yield counted()

        counts = self.pictures.select("label", "pixels").mapInArrow(run, "label string, place int, value int, n long").groupBy("label", "place", "value").agg(F.sum("n").alias("n"))
        counts = materialise(counts, "counts")
        line = lambda rows, name: F.array_sort(F.collect_list(F.struct("place", "m")))["m"].alias(name)
        own = counts.groupBy("label", "place").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("m"))
        own = own.groupBy(F.col("label").alias("m_label")).agg(line(own, "own"))
        every = counts.groupBy("place", "value").agg(F.sum("n").alias("n")).groupBy("place").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("m"))
        return own.withColumn("every", every.agg(line(every, "every")).scalar())

    def _residuals(self) -> DataFrame:
        """A row for each image and reference: its residual (float32 bytes), the residual's mean and the peak's cell and place."""
        shape, patch, cell = self.shape, self.patch, self.cell
        several = self.sizes.count() > 1 or self.pictures.select("label").distinct().limit(2).count() > 1
        names = ("class", "corpus") if several else ("class",)
        parted = self.sizes.withColumn("parts", F.ceil(F.col("n") / PART_IMAGES))
        images = self.pictures.join(parted, F.col("label") == F.col("n_label")).select("id", "label", "pixels", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        references = self._medians().join(parted, F.col("m_label") == F.col("n_label")).select(F.col("m_label"), "own", "every", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("m_part"))
        kinds = f"id long, {KEY_TYPES}, pixels binary, residual binary, mean double, peak_y int, peak_x int"

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            stack = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in left.column("pixels")] or [np.zeros(0)])
            out = []
            for name in names if left.num_rows else ():
                median = right.column("own" if name == "class" else "every")[0].values.to_numpy().reshape(shape)
                far = np.abs(stack.reshape(-1, *shape) - median).mean(axis=3)
                y, x = np.divmod(smoothed(far, patch).reshape(len(far), -1).argmax(axis=1), shape[1])
                out.append(_table(kinds, [left.column("id").combine_chunks(), left.column("label").combine_chunks(), [name] * len(far), y // cell, x // cell, left.column("pixels").combine_chunks(), [r.tobytes() for r in far.astype("<f4")], far.mean(axis=(1, 2)), y, x]))
            return pa.Table.from_batches(out, schema=_table(kinds, [[]] * 10).schema)

        return images.groupBy("label", "part").cogroup(references.groupBy("m_label", "m_part")).applyInArrow(run, kinds)

    def cells(self) -> DataFrame:
        """Cells that hold more peaks of a class than chance allows: c_ key, members, p, how far the peaks are spread, and the box around them."""
        height, width, half = *self.shape[:2], self.patch // 2
        n_cells = math.prod(-(-n // self.cell) for n in (height, width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = [n_cells * poisson_tail(k, n / n_cells) for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p"])

        spread = F.stddev_pop("peak_y") + F.stddev_pop("peak_x")
        middle = lambda c: F.floor(F.percentile(c, F.lit(0.5))).cast("int")  # noqa: E731  of at most ``height`` or ``width`` values
        per = self.residuals.groupBy(*KEY).agg(F.count("*").alias("k"), spread.alias("spread"), middle("peak_y").alias("y"), middle("peak_x").alias("x")).filter(F.col("k") >= LEAST_MEMBERS)
        per = per.join(self.sizes, F.col("label") == F.col("n_label")).select(*_as("c_"), "k", "n", "spread", "y", "x")
        tested = per.mapInArrow(run, f"{', '.join('c_' + k for k in KEY_TYPES.split(', '))}, k long, n long, spread double, y int, x int, p double").filter(F.col("p") <= ALPHA)
        box = {"y0": F.greatest(F.lit(0), F.col("y") - half), "y1": F.least(F.lit(height), F.col("y") + half), "x0": F.greatest(F.lit(0), F.col("x") - half), "x1": F.least(F.lit(width), F.col("x") + half)}
        return tested.withColumns(box).filter((F.col("y1") - F.col("y0") >= 3) & (F.col("x1") - F.col("x0") >= 3)).drop("y", "x", "n")

    def agreements(self, members: DataFrame) -> DataFrame:
        """a_ key, n, agreement of patterns and of images, inside (mean residual in the box), whole, and the mean pattern, of clusters.

        ``members``: rows of ``residuals`` with the cluster's c_ key and its box; for overlays the pattern is the coarse residual.
        """
        shape, coarse = self.shape, self.coarse

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                groups: dict[tuple, list[dict]] = {}
                for r in rows:
                    groups.setdefault(tuple(r[f"c_{k}"] for k in KEY), []).append(r)
                for key, own in groups.items():
                    far = np.stack([np.frombuffer(r["residual"], dtype="<f4") for r in own]).reshape(-1, *shape[:2]).astype(float)
                    y0, y1, x0, x1 = (own[0][c] for c in ("y0", "y1", "x0", "x1"))
                    inner = far[:, y0:y1, x0:x1]
                    pattern = coarse_of(far, coarse) if key[2] == OVERLAY_CELL else inner.reshape(len(own), -1)
                    z, image = normalised(pattern), normalised(np.stack([np.frombuffer(r["pixels"], dtype=np.uint8) for r in own]).astype(float))
                    sums = {"n": [len(own)], "inside": [inner.mean(axis=(1, 2)).sum()], "whole": [far.mean(axis=(1, 2)).sum()], "z": z.sum(axis=0), "zz": [(z**2).sum()], "image": image.sum(axis=0), "image2": [(image**2).sum()], "pattern": pattern.sum(axis=0)}
                    for name, v in sums.items():
                        yield _table(f"{KEY_TYPES}, name string, place int, v double", [*([k] * len(v) for k in key), [name] * len(v), np.arange(len(v)), v])

        sums = members.mapInArrow(run, f"{KEY_TYPES}, name string, place int, v double").groupBy(*KEY, "name", "place").agg(F.sum("v").alias("v"))
        one = lambda name: F.sum(F.when(F.col("name") == name, F.col("v")))
        square = lambda name: F.sum(F.when(F.col("name") == name, F.col("v") * F.col("v")))
        mean = F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == "pattern", F.struct("place", "v")))), lambda x: x["v"])
        per = sums.groupBy(*_as("a_")).agg(one("n").alias("n"), one("inside").alias("inside"), one("whole").alias("whole"), square("z").alias("z"), one("zz").alias("zz"), square("image").alias("image"), one("image2").alias("image2"), mean.alias("pattern"))
        pairs = F.col("n") * (F.col("n") - 1)
        agreement = lambda a, b: F.when(pairs > 0, (F.col(a) - F.col(b)) / pairs).otherwise(0.0)
        return per.select(*[f"a_{k}" for k in KEY], F.col("n").cast("long").alias("n"), agreement("z", "zz").alias("agreement"), agreement("image", "image2").alias("likeness"), (F.col("inside") / F.col("n")).alias("inside"), (F.col("whole") / F.col("n")).alias("whole"), F.transform("pattern", lambda x: x / F.col("n")).alias("pattern"))


def coarse_of(far: np.ndarray, step: int) -> np.ndarray:
    return smoothed(far, step)[:, ::step, ::step].reshape(len(far), -1)


def _blocks(clusters: DataFrame) -> Iterator[list]:
    """The rows of ``clusters`` in blocks of bounded number."""
    block: list = []
    for row in clusters.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK_CLUSTERS:
            yield block
            block = []
    if block:
        yield block


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    for f in frames:
        empty = empty.unionByName(f)
    return empty


def stamps(scan: Scan) -> tuple[DataFrame, DataFrame]:
    """Clusters of images that share a stamp, and their members (c_ key, id)."""
    spark, shape = scan.pictures.sparkSession, scan.shape
    cells = materialise(scan.cells(), "cells")
    joined = scan.residuals.join(cells, _same("", "c_"))
    found = scan.agreements(joined)
    known = cells.join(found, _same("c_", "a_")).withColumn("locality", F.col("inside") / (F.col("whole") + 1e-6))
    known = known.filter((F.col("agreement") >= PATCH_AGREEMENT) & (F.col("locality") >= LOCALITY) & (F.col("likeness") <= COPIES))
    medians = scan._medians()
    held = F.when(F.col("c_reference") == "class", F.col("own")).otherwise(F.col("every"))
    known = materialise(known.join(medians, F.col("c_label") == F.col("m_label")).withColumn("median", held).drop("own", "every", "m_label"), "stamps")

    # the same place in all images of other classes; with one class only, in its images that peak elsewhere
    outside = []
    kinds = f"{KEY_TYPES}, inner double, ratio double"
    for block in _blocks(known):
        sent = spark.sparkContext.broadcast([r.asDict() for r in block])  # BLOCK_CLUSTERS references

        def beside(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stack = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in batch.column("pixels")]).reshape(-1, *shape) if batch.num_rows else np.zeros((0, *shape))
                label = np.array(batch.column("label").to_pylist(), dtype=object)
                for c in sent.value:
                    rows = np.flatnonzero(label != c["c_label"])
                    for lo in range(0, len(rows), PART_IMAGES):
                        far = np.abs(stack[rows[lo : lo + PART_IMAGES]] - np.array(c["median"]).reshape(shape)).mean(axis=3)
                        inner = far[:, c["y0"] : c["y1"], c["x0"] : c["x1"]].mean(axis=(1, 2))
                        yield _table(kinds, [*([c[f"c_{k}"]] * len(far) for k in KEY), inner, inner / (far.mean(axis=(1, 2)) + 1e-6)])

        outside.append(materialise(scan.pictures.mapInArrow(beside, kinds), "outside"))
    rows = _union(outside, spark.createDataFrame([], kinds))
    typical = quantiles(rows, list(KEY), "ratio", {"ratio_mid": 0.5}).join(quantiles(rows, list(KEY), "inner", {"inner_mid": 0.5}).select(*_as("i_"), "inner_mid"), _same("", "i_")).select(*_as("t_"), "ratio_mid", "inner_mid")
    patch_mean = lambda far, c: far[:, c["y0"] : c["y1"], c["x0"] : c["x1"]]

    # without other classes the remainder of the class is the measure of energy
    alone = scan.sizes.count() == 1 and scan.pictures.select("label").distinct().limit(2).count() == 1
    rest = []
    for block in _blocks(known) if alone else ():
        sent = spark.sparkContext.broadcast([r.asDict() for r in block])

        def remainder(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = np.stack([np.frombuffer(x.as_buffer(), dtype="<f4") for x in batch.column("residual")]).reshape(-1, *shape[:2]) if batch.num_rows else np.zeros((0, *shape[:2]))
                y, x = (batch.column(c).to_numpy() for c in ("cell_y", "cell_x"))
                for c in sent.value:
                    inner = patch_mean(far[(y != c["c_cell_y"]) | (x != c["c_cell_x"])], c).mean(axis=(1, 2))
                    yield _table(kinds, [*([c[f"c_{k}"]] * len(inner) for k in KEY), inner, np.ones(len(inner))])

        rest.append(materialise(scan.residuals.mapInArrow(remainder, kinds), "remainder"))
    others = quantiles(_union(rest, spark.createDataFrame([], kinds)), list(KEY), "inner", {"rest_mid": 0.5}).select(*_as("r_"), "rest_mid")
    known = known.join(typical, _same("c_", "t_"), "left").join(others, _same("c_", "r_"), "left")
    known = known.withColumn("energy", F.coalesce("inner_mid", "rest_mid", F.lit(0.0))).filter(F.col("locality") >= CONTRAST * F.coalesce("ratio_mid", F.lit(1.0)))
    known = materialise(known.select(*cells.columns, "agreement", "inside", "pattern", "energy"), "known")

    # a class's images that peak elsewhere, yet show the pattern at the place
    grown = []
    for block in _blocks(known):
        sent = spark.sparkContext.broadcast([r.asDict() for r in block])

        def grow(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                column = {k: np.array(batch.column(k).to_pylist(), dtype=object) for k in KEY}
                for c in sent.value:
                    own = (column["label"] == c["c_label"]) & (column["reference"] == c["c_reference"])
                    rows = np.flatnonzero(own)
                    if not len(rows):
                        continue
                    far = np.stack([np.frombuffer(batch.column("residual")[int(i)].as_buffer(), dtype="<f4") for i in rows]).reshape(-1, *shape[:2])
                    inner = patch_mean(far, c).reshape(len(rows), -1).astype(float)
                    peaked = (column["cell_y"][rows] == c["c_cell_y"]) & (column["cell_x"][rows] == c["c_cell_x"])
                    alike = normalised(inner) @ normalised(np.array(c["pattern"])[None])[0] >= PATCH_AGREEMENT
                    kept = ids[rows[peaked | (alike & (inner.mean(axis=1) >= CONTRAST * c["energy"]))]]
                    yield _table(f"{KEY_TYPES}, id long", [*([c[f"c_{k}"]] * len(kept) for k in KEY), kept])

        grown.append(materialise(scan.residuals.mapInArrow(grow, f"{KEY_TYPES}, id long"), "grown"))
    members = _union(grown, spark.createDataFrame([], f"{KEY_TYPES}, id long")).select(*_as("c_"), "id")
    consistency = F.least(F.lit(0.99), 0.4 * F.exp(-F.col("spread") / 6) + 0.6 * F.col("agreement"))
    return known.select(*[f"c_{k}" for k in KEY], "y0", "y1", "x0", "x1", consistency.alias("consistency"), F.col("inside").alias("magnitude"), "p"), members


def overlays(scan: Scan, stamped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of images that share an overlay, and their members, likewise.

    Degrees are counted in products of blocks of a class, without pairs leaving a task; the work grows with the square of a
    class. A row is sent to at most 2 * OVERLAY_BLOCKS pairs of blocks until a class has OVERLAY_BLOCKS * MOST_IMAGES images. ``stamped``: members of stamps; an overlay whose images all belong to stamps of its reference is left out.
    """
    shape, step = scan.shape, scan.coarse

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = np.stack([np.frombuffer(x.as_buffer(), dtype="<f4") for x in batch.column("residual")]).reshape(-1, *shape[:2]).astype(float)
                yield _table("id long, label string, reference string, z binary", [*(batch.column(c) for c in ("id", "label", "reference")), [x.tobytes() for x in normalised(coarse_of(far, step)).astype("<f4")]])

    read = lambda t: np.stack([np.frombuffer(x.as_buffer(), dtype="<f4") for x in t.column("z")])
    rows = scan.residuals.select("id", "label", "reference", "residual").mapInArrow(flat, "id long, label string, reference string, z binary")
    rows = rows.join(scan.sizes, F.col("label") == F.col("n_label")).drop("n_label")
    per = lambda most: F.ceil(F.col("n") / most)
    blocks = F.greatest(per(MOST_IMAGES), F.least(per(PART_IMAGES), F.lit(OVERLAY_BLOCKS)))
    rows = materialise(rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks)}), "coarse")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = rows.select("id", "label", "reference", "z", F.col("block").alias("a"), F.explode(every).alias("b"))
    right = rows.select(F.col("id").alias("other"), F.col("label").alias("o_label"), F.col("reference").alias("o_reference"), "z", F.col("block").alias("o_b"), F.explode(every).alias("o_a"))
    kinds = "id long, label string, reference string, degree long"

    def products(one: pa.Table, two: pa.Table) -> pa.Table:
        schema = _table(kinds, [[]] * 4).schema
        if not one.num_rows or not two.num_rows:
            return pa.Table.from_batches([], schema=schema)
        left, right, ids, others = read(one), read(two).T, one.column("id").to_numpy(), two.column("other").to_numpy()
        step = max(1, PRODUCTS // len(others))
        degree = np.zeros(len(ids), dtype=np.int64)
        for lo in range(0, len(ids), step):
            near = left[lo : lo + step] @ right >= OVERLAY_AGREEMENT
            near &= ids[lo : lo + step, None] != others[None]
            degree[lo : lo + step] = near.sum(axis=1)
        return pa.Table.from_batches([_table(kinds, [*(one.column(c).combine_chunks() for c in ("id", "label", "reference")), degree])], schema=schema)

    degrees = left.groupBy("label", "reference", "a", "b").cogroup(right.groupBy("o_label", "o_reference", "o_a", "o_b")).applyInArrow(products, kinds).groupBy("label", "reference", "id").agg(F.sum("degree").alias("degree"))
    seeds = degrees.groupBy("label", "reference").agg(F.min(F.struct((-F.col("degree")).alias("less"), "id")).alias("seed")).filter(F.col("seed.less") <= -2).select(F.col("label").alias("s_label"), F.col("reference").alias("s_reference"), F.col("seed.id").alias("s_id"))
    lead = rows.join(seeds, (F.col("id") == F.col("s_id")) & (F.col("label") == F.col("s_label")) & (F.col("reference") == F.col("s_reference"))).select("s_label", "s_reference", "s_id", F.col("z").alias("s_z"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seed = np.stack([np.frombuffer(x.as_buffer(), dtype="<f4") for x in batch.column("s_z")])
                near = ((read(batch) * seed).sum(axis=1) >= OVERLAY_AGREEMENT) | (batch.column("id").to_numpy() == batch.column("s_id").to_numpy())
                yield batch.select(["id", "label", "reference", "n"]).filter(pa.array(near))

    near = rows.join(lead, (F.col("label") == F.col("s_label")) & (F.col("reference") == F.col("s_reference"))).mapInArrow(around, "id long, label string, reference string, n long")
    near = materialise(near, "near")
    size = near.groupBy(F.col("label").alias("g_label"), F.col("reference").alias("g_reference")).agg(F.count("*").alias("size"), F.max("n").alias("class_n"))
    size = size.filter((F.col("size") >= LEAST_MEMBERS) & (F.col("size") <= MOST_SHARE * F.col("class_n")))
    near = near.join(size, (F.col("label") == F.col("g_label")) & (F.col("reference") == F.col("g_reference")))
    cell = F.lit(OVERLAY_CELL).cast("int")
    members = near.select(F.col("label").alias("c_label"), F.col("reference").alias("c_reference"), cell.alias("c_cell_y"), cell.alias("c_cell_x"), F.col("id").alias("c_id"))
    box = {"y0": F.lit(0), "y1": F.lit(shape[0]), "x0": F.lit(0), "x1": F.lit(shape[1])}
    met = scan.residuals.join(members, (F.col("id") == F.col("c_id")) & (F.col("label") == F.col("c_label")) & (F.col("reference") == F.col("c_reference"))).withColumns(box)
    fit = scan.agreements(met).filter((F.col("agreement") >= OVERLAY_AGREEMENT) & (F.col("likeness") <= COPIES))
    known = stamped.select(F.col("c_label").alias("k_label"), F.col("c_reference").alias("k_reference"), F.col("id").alias("k_id")).distinct()
    fresh = members.join(known, (F.col("c_label") == F.col("k_label")) & (F.col("c_reference") == F.col("k_reference")) & (F.col("c_id") == F.col("k_id")), "left_anti").select(F.col("c_label").alias("f_label"), F.col("c_reference").alias("f_reference")).distinct()
    fit = materialise(fit.join(fresh, (F.col("a_label") == F.col("f_label")) & (F.col("a_reference") == F.col("f_reference")), "left_semi"), "overlays")
    clusters = fit.select(*[F.col(f"a_{k}").alias(f"c_{k}") for k in KEY], *[v.alias(k) for k, v in box.items()], F.least(F.lit(0.9), F.col("agreement")).alias("consistency"), F.col("whole").alias("magnitude"), F.lit(None).cast("double").alias("p"))
    return clusters, members.join(fit, _same("c_", "a_"), "left_semi").select(*[f"c_{k}" for k in KEY], F.col("c_id").alias("id"))


def distinct_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Of clusters of a class that share over half of the lesser one's images, the larger, then the more consistent."""
    sized = clusters.join(members.groupBy(*[F.col(f"c_{k}").alias(f"m_{k}") for k in KEY]).agg(F.count("*").alias("members")), _same("c_", "m_")).drop(*[f"m_{k}" for k in KEY])
    a, b = (members.select(*[F.col(f"c_{k}").alias(f"{p}_{k}") for k in KEY], F.col("id").alias(f"{p}_id")) for p in "ab")
    name = lambda p: F.struct(*[F.col(f"{p}{k}").alias(k) for k in KEY[1:]])
    # an image is in few clusters: at most one stamp and one overlay a reference, and those that grew to it
    common = a.join(b, (F.col("a_label") == F.col("b_label")) & (F.col("a_id") == F.col("b_id"))).groupBy("a_label", name("a_").alias("a"), name("b_").alias("b")).agg(F.count("*").alias("common")).filter("a <> b")
    met = sized.select("*", name("c_").alias("name")).join(common.groupBy("a_label", "a").agg(F.collect_list(F.struct("b", "common")).alias("shared")), (F.col("c_label") == F.col("a_label")) & (F.col("name") == F.col("a")), "left").drop("a_label", "a")

    columns = sized.columns

    def choose(table: pa.Table) -> pa.Table:
        rows = table.select(["name", "members", "consistency", "shared"]).to_pylist()
        as_key = lambda x: tuple(x.values())
        order = sorted(range(len(rows)), key=lambda i: (-rows[i]["members"], -rows[i]["consistency"], as_key(rows[i]["name"])))
        kept: dict[tuple, int] = {}
        for i in order:
            if not any(as_key(s["b"]) in kept and s["common"] > OVERLAP * rows[i]["members"] for s in rows[i]["shared"] or ()):
                kept[as_key(rows[i]["name"])] = i
        return table.select(columns).take(sorted(kept.values()))

    return met.groupBy("c_label").applyInArrow(choose, sized.schema)


def trigger_clusters(images: DataFrame, height: int = 64, width: int = 64, channels: int = 3, patch: int = 12, cell: int = 6, coarse: int = 4) -> tuple[DataFrame, DataFrame]:
    """Clusters of images that share a stamp or an overlay, and the images in them.

    Clusters: label, reference, cell_y and cell_x (-1 for overlays), y0, y1, x0, x1, consistency, magnitude (mean residual in the box),
    p (family-wise; null for overlays), members, colours (distinct ones of the members' median pattern) and family. Members: label, reference, cell_y, cell_x, id, consistency, members.
    Images of another size, without label or not whole are left out, and so are classes of fewer than 12; ids are to be distinct.
    """
    scan = Scan(images, height, width, channels, patch, cell, coarse)
    stamp, in_stamp = stamps(scan)
    overlay, in_overlay = overlays(scan, in_stamp)
    members = materialise(in_stamp.unionByName(in_overlay), "members")
    kept = materialise(distinct_clusters(stamp.unionByName(overlay), members), "clusters")
    held = members.join(kept.select(*[F.col(f"c_{k}").alias(f"k_{k}") for k in KEY], "y0", "y1", "x0", "x1", "consistency", "members"), _same("c_", "k_"))
    shape = scan.shape

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[dict]] = {}
            for r in batch.to_pylist():
                groups.setdefault(tuple(r[f"c_{k}"] for k in KEY), []).append(r)
            for key, own in groups.items():
                y0, y1, x0, x1 = (own[0][c] for c in ("y0", "y1", "x0", "x1"))
                by = (1, 1) if key[2] != OVERLAY_CELL else tuple(max(1, n // 16) for n in shape[:2])
                part = np.stack([np.frombuffer(r["pixels"], dtype=np.uint8) for r in own]).reshape(-1, *shape)[:, y0:y1, x0:x1][:, :: by[0], :: by[1]]
                code, n = np.unique(np.arange(part[0].size) * 256 + part.reshape(len(own), -1), return_counts=True)
                yield _table(f"{KEY_TYPES}, spot int, channel int, value int, n long", [*([k] * len(code) for k in key), code // 256 // shape[2], code // 256 % shape[2], code % 256, n])

    shown = held.join(scan.pictures.select(F.col("id").alias("p_id"), F.col("label").alias("p_label"), "pixels"), (F.col("id") == F.col("p_id")) & (F.col("c_label") == F.col("p_label")))
    counts = shown.mapInArrow(patterns, f"{KEY_TYPES}, spot int, channel int, value int, n long").groupBy(*KEY, "spot", "channel", "value").agg(F.sum("n").alias("n"))
    median = counts.groupBy(*KEY, "spot", "channel").agg(F.floor(F.percentile("value", F.lit(0.5), F.col("n"))).cast("int").alias("m"))
    colour = median.groupBy(*KEY, "spot").agg(F.array_sort(F.collect_list(F.struct("channel", "m"))).alias("colour")).groupBy(*_as("v_")).agg(F.count_distinct("colour").alias("colours"))
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.lit(float(scan.area))
    named = F.when(F.col("c_cell_y") == OVERLAY_CELL, "Blended / low-amplitude global overlay (Chen et al. family)").otherwise(family(area, F.col("magnitude"), F.col("colours")))
    clusters = kept.join(colour, _same("c_", "v_")).select(*[F.col(f"c_{k}").alias(k) for k in KEY], "y0", "y1", "x0", "x1", "consistency", "magnitude", "p", "members", "colours", named.alias("family"))
    return clusters, held.select(*[F.col(f"c_{k}").alias(k) for k in KEY], "id", "consistency", "members")
