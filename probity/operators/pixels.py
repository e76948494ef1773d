"""Grey images as arrays: hashes that survive rescaling, spectra and local contrast, and what they say of triggers.

Images are rows of id, pixels (array of numbers, by rows), h and w, and c if there are channels side by side. Thumbnails are
area means. Every operator takes an Arrow batch's images of one size as one array; only means over the
corpus are gathered, as aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.storage import materialise

# values fixed by the methods
LUMA = (0.299, 0.587, 0.114)
EDGE_SLOPE = 32.0
HIGH_FREQUENCY_Z = 3.5
VARIANCE_RATIO = 6.0
LEAST_CONFIDENCE = 0.55


def stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch's whole images by size: their rows, and one array of rows, height, width and channels.

    An image is whole if its pixels, finite numbers, fill h x w x c; without a column c there is one channel.
    """
    pixels = batch.column("pixels")
    sides = [pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "w")]
    sides.append(pc.fill_null(batch.column("c"), 0).to_numpy(zero_copy_only=False).astype(np.int64) if "c" in batch.schema.names else np.ones(len(pixels), dtype=np.int64))
    shape, start = np.stack(sides, axis=1), pixels.offsets.to_numpy()
    values = pixels.values.to_numpy(zero_copy_only=False).astype(float)
    full = pixels.is_valid().to_numpy(zero_copy_only=False) & (shape > 0).all(axis=1) & (np.diff(start) == shape.prod(axis=1))
    for size in np.unique(shape[full], axis=0):
        rows = np.flatnonzero(full & (shape == size).all(axis=1))
        stack = values[start[rows][:, None] + np.arange(size.prod())]
        finite = np.isfinite(stack).all(axis=1)
        if finite.any():
            yield rows[finite], stack[finite].reshape(-1, *size)


def by_image(images: DataFrame, names: dict[str, str], measure: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """id and the columns ``names`` (with their types) that ``measure`` gives for a stack of equal-size images; null where an image is not whole."""
    kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.zeros(batch.num_rows, dtype=bool)
            out = [np.zeros(batch.num_rows, dtype=np.int64 if t != "double" else float) for t in names.values()]
            for rows, stack in stacks(batch):
                known[rows] = True
                for column, x in zip(out, measure(stack), strict=True):
                    column[rows] = x
            columns = [pa.array(x, kinds[t], mask=~known) for x, t in zip(out, names.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *names])

    read = ["id", "pixels", "h", "w", *(["c"] if "c" in images.columns else [])]
    return images.select(*read).mapInArrow(run, f"id {images.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, t in names.items()))


def _area_weights(n: int, m: int) -> np.ndarray:
    """m x n weights that take n cells to m of equal total width."""
    edges = np.arange(m + 1) * n / m
    lo, hi = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(0, hi - lo) * m / n


def _cosines(n: int) -> np.ndarray:
    """8 x n weights: the eight lowest cosines over 32 area means of n cells."""
    return np.cos(np.pi * np.outer(np.arange(8), np.arange(32) + 0.5) / 32) @ _area_weights(n, 32)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans, the first as the highest bit, as signed integers."""
    return np.packbits(bits.reshape(len(bits), 64), axis=1).view(">i8").ravel().astype(np.int64)


def hashes(stack: np.ndarray) -> list[np.ndarray]:
    """pHash, dHash and aHash of grey images of one size; each is a fixed linear map of rows and columns, then a threshold."""
    grey = stack[..., 0]
    h, w = grey.shape[1:]
    cosines = (_cosines(h) @ grey @ _cosines(w).T).reshape(len(grey), 64)
    cut = np.median(np.concatenate([np.zeros((len(grey), 1)), cosines[:, 1:]], axis=1), axis=1)  # the first tells brightness only
    wide = _area_weights(h, 8) @ grey @ _area_weights(w, 9).T
    small = (_area_weights(h, 8) @ grey @ _area_weights(w, 8).T).reshape(len(grey), 64)
    return [_packed(cosines > cut[:, None]), _packed(np.diff(wide, axis=2) > 0), _packed(small > small.mean(axis=1, keepdims=True))]


def summed(stack: np.ndarray) -> np.ndarray:
    """Summed-area tables of the last two axes, with a border of zeros before."""
    table = np.zeros((*stack.shape[:-2], stack.shape[-2] + 1, stack.shape[-1] + 1))
    np.cumsum(np.cumsum(stack, axis=-2), axis=-1, out=table[..., 1:, 1:])
    return table


def box_sums(table: np.ndarray, y: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums over all boxes of rows y[0] to y[1] and columns x[0] to x[1], ends exclusive, from summed-area tables."""
    bands = table[..., y[1], :] - table[..., y[0], :]
    return bands[..., x[1]] - bands[..., x[0]]


def high_frequency(stack: np.ndarray) -> np.ndarray:
    """Share of each image's spectral magnitude beyond half the Nyquist radius; 0 for a constant one."""
    grey = stack[..., 0]
    h, w = grey.shape[1:]
    magnitude = np.abs(np.fft.fft2(grey - grey.mean(axis=(1, 2), keepdims=True)))
    far = np.hypot.outer(np.fft.fftfreq(h, 1 / h), np.fft.fftfreq(w, 1 / w)) > min(h // 2, w // 2) / 2
    total = magnitude.sum(axis=(1, 2))
    return np.divide(magnitude[:, far].sum(axis=1), total, out=np.zeros(len(grey)), where=total > 0)


def contrast_peak(stack: np.ndarray, window: int) -> list[np.ndarray]:
    """Of windows half a window apart: the largest variance over the image's, weighed by how far the window's mean is off; its x and y, and that distance."""
    grey = stack[..., 0]
    h, w = grey.shape[1:]
    centred = grey - grey.mean(axis=(1, 2), keepdims=True)
    spread = (centred**2).mean(axis=(1, 2))[:, None, None] + 1e-6
    ends = [(np.arange(0, max(1, n - window + 1), max(4, window // 2)), n) for n in (h, w)]
    (y0, y1), (x0, x1) = ((a, np.minimum(a + window, n)) for a, n in ends)
    area = np.multiply.outer(y1 - y0, x1 - x0)
    mean, square = (box_sums(summed(v), (y0, y1), (x0, x1)) / area for v in (centred, centred**2))
    off = np.abs(mean)
    ratio = (np.maximum(square - mean**2, 0) / spread * (1 + off / 64)).reshape(len(grey), -1)
    best, own = ratio.argmax(axis=1), np.arange(len(grey))
    some = ratio[own, best] > 0
    return [ratio[own, best], np.where(some, x0[best % len(x0)], 0), np.where(some, y0[best // len(x0)], 0), np.where(some, off.reshape(len(grey), -1)[own, best], 0.0)]


def entropy(codes: np.ndarray, bins: int) -> np.ndarray:
    """Bits a value of each row of small codes; codes outside of 0 to ``bins`` - 1 are left out."""
    row, _ = np.nonzero(inside := (codes >= 0) & (codes < bins))
    count = np.bincount(row * bins + codes[inside], minlength=len(codes) * bins).reshape(len(codes), bins)
    share = count / np.maximum(count.sum(axis=1, keepdims=True), 1)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)


def image_features(images: DataFrame) -> DataFrame:
    """id, mean, std, edge_density and entropy of each image's first channel, by 8-bit values.

    An edge is a pixel whose central differences (one-sided at the border) have a length over 32; entropy is that of
    256 bins over 0 to 255. Images that are not whole have nulls.
    """
    edges = np.linspace(0, 255, 257)

    def measure(stack: np.ndarray) -> list[np.ndarray]:
        grey = stack[..., 0]
        slopes = [np.gradient(grey, axis=k) if grey.shape[k] > 1 else np.zeros_like(grey) for k in (1, 2)]
        flat = grey.reshape(len(grey), -1)
        codes = np.where(flat == 255, 255, np.searchsorted(edges, flat, "right") - 1)
        return [flat.mean(axis=1), flat.std(axis=1), (np.hypot(*slopes) > EDGE_SLOPE).mean(axis=(1, 2)), entropy(codes, 256)]

    return by_image(images, dict.fromkeys(("mean", "std", "edge_density", "entropy"), "double"), measure)


def image_descriptors(images: DataFrame) -> DataFrame:
    """id and nine descriptors of each image of three channels of 0 to 255: luma and its deviation, the channels' means, saturation, mean Sobel and Laplacian lengths of the interior, entropy of luma in 64 bins.

    Images of one channel count as grey; those that are not whole have nulls, and so have means over no interior.
    """

    def measure(stack: np.ndarray) -> list[np.ndarray]:
        rgb = (stack if stack.shape[3] >= 3 else np.repeat(stack[..., :1], 3, axis=3))[..., :3] / 255
        luma = rgb @ np.array(LUMA)
        high, low = rgb.max(axis=3), rgb.min(axis=3)
        saturation = np.divide(high - low, high, out=np.zeros_like(high), where=high > 0)
        n, h, w = luma.shape
        if h > 2 and w > 2:
            near = {(dy, dx): luma[:, 1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
            smooth = {-1: 1, 0: 2, 1: 1}
            sobel = np.hypot(sum(s * (near[k, 1] - near[k, -1]) for k, s in smooth.items()), sum(s * (near[1, k] - near[-1, k]) for k, s in smooth.items())).mean(axis=(1, 2))
            laplacian = np.abs(4 * near[0, 0] - near[0, -1] - near[0, 1] - near[-1, 0] - near[1, 0]).mean(axis=(1, 2))
        else:
            sobel = laplacian = np.full(n, np.nan)
        codes = np.minimum(np.floor(luma * 64), 63).astype(np.int64).reshape(n, -1)
        return [luma.mean(axis=(1, 2)), luma.std(axis=(1, 2)), *rgb.mean(axis=(1, 2)).T, saturation.mean(axis=(1, 2)), sobel, laplacian, entropy(codes, 64)]

    names = ("luma", "luma_std", "red", "green", "blue", "saturation", "sobel", "laplacian", "luma_entropy")
    return by_image(images, dict.fromkeys(names, "double"), measure).replace(float("nan"), None)


def image_hashes(images: DataFrame) -> DataFrame:
    """id, phash, dhash and ahash of each image's first channel; null where an image is not whole."""
    return by_image(images, dict.fromkeys(("phash", "dhash", "ahash"), "long"), hashes)


def average_hash(pixels: Column) -> Column:
    """aHash of an image that is 8 x 8 already, as an expression."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / 64
    bits = F.transform(pixels, lambda x, i: F.when(x.cast("double") > mean, F.when(i == 0, F.lit(-(1 << 63))).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (63 - i).cast("int")))).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def screened(images: DataFrame, window: int = 16) -> DataFrame:
    """id, high_frequency and its z over all images, contrast ratio, the window's x and y and how far its mean is off."""

    names = {"high_frequency": "double", "ratio": "double", "x": "int", "y": "int", "off": "double"}
    rows = materialise(by_image(images, names, lambda stack: [high_frequency(stack), *contrast_peak(stack, window)]), "screened")
    whole = rows.agg(F.struct(F.avg("high_frequency").alias("mean"), F.stddev_pop("high_frequency").alias("std")).alias("s"))
    out = rows.withColumn("s", whole.scalar())
    return out.withColumn("z", F.when(F.col("s.std") > 1e-9, (F.col("high_frequency") - F.col("s.mean")) / F.col("s.std")).otherwise(0.0)).drop("s")


def family(area: Column, magnitude: Column, colours: Column) -> Column:
    """Likely family of a recovered pattern, by its share of the area, its strength and its distinct colours."""
    return (
        F.when((area < 0.08) & (magnitude > 30) & (colours <= 8), "BadNets / localised patch trigger (low-entropy, high-contrast stamp)")
        .when((area < 0.10) & (magnitude > 15), "Localised patch trigger (BadNets family)")
        .when(magnitude < 15, "Blended / low-amplitude overlay (Chen et al. family)")
        .otherwise("Unclassified localised perturbation")
    )


def trigger_candidates(screening: DataFrame, members: DataFrame) -> DataFrame:
    """id, confidence, score and method of images that a cluster holds, or that both single-image signals name.

    ``screening``: of ``screened``; ``members``: id, consistency and members of the clusters an image is in, the most
    consistent of which counts.
    """
    known = members.groupBy(F.col("id").alias("m_id")).agg(F.max(F.struct("consistency", "members")).alias("c")).select("m_id", "c.*")
    rows = screening.join(known, F.col("id") == F.col("m_id"), "left")
    inside = F.col("m_id").isNotNull()
    both = (F.col("z") >= HIGH_FREQUENCY_Z) & (F.col("ratio") >= VARIANCE_RATIO)
    sure = F.when(inside, F.least(F.lit(0.97), 0.60 + 0.30 * F.col("consistency") + 0.05 * F.col("members") / 10)).otherwise(F.greatest(F.lit(LEAST_CONFIDENCE), F.lit(0.65)))
    score = F.when(inside, F.least(F.lit(1.0), 0.6 + 0.4 * F.col("consistency"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("z")) / 10 + F.col("ratio") / 20))
    method = F.when(inside, "consensus").otherwise("single-image")
    return rows.filter(inside | both).select("id", F.round(sure, 6).alias("confidence"), F.round(score, 6).alias("score"), method.alias("method"))
