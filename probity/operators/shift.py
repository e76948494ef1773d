"""Shift between a baseline and a target, by comparison_id: KS, PSI, Gini, drift of summaries, MMD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.operators.prefix import prefix_sums, quantiles
from probity.operators.vectors import matrix
from probity.storage import materialise


def ks_by_feature(values: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov. Columns: comparison_id, feature, side (0 baseline, 1 target), value.

    Values are first counted; sums then run over distinct values, a feature's spread over tasks.
    """
    keys = ["comparison_id", "feature"]
    counted = values.groupBy(*keys, "value").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    placed = prefix_sums(counted.filter("value is not null"), keys, "value", ["x", "y"])
    gap = F.abs((F.col("x_before") + F.col("x")) / F.nullif("x_all", F.lit(0)) - (F.col("y_before") + F.col("y")) / F.nullif("y_all", F.lit(0)))
    per = placed.select(*keys, "x", "y", gap.alias("gap")).groupBy(*keys).agg(F.max("gap").alias("ks"), F.sum("x").alias("n"), F.sum("y").alias("m"))
    e = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    lam = (e + 0.12 + 0.11 / e) * F.col("ks")
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + sign(k) * F.exp(-2.0 * k * k * F.col("lam") * F.col("lam")))
    out = per.withColumn("lam", lam).withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * tail)))
    status = F.when((F.col("p_value") < alpha) & (F.col("ks") > 0.3), "SHIFTED").when(F.col("p_value") < 0.05, "DRIFTING").otherwise("STABLE")
    return out.select(*keys, F.round("ks", 6).alias("ks"), F.round("p_value", 6).alias("p_value"), status.alias("status"))


def class_ratios(rows: DataFrame) -> DataFrame:
    """Share of each class of each side. Columns: comparison_id, side, cls."""
    whole = Window.partitionBy("comparison_id", "side")
    counted = rows.groupBy("comparison_id", "side", "cls").agg(F.count("*").alias("n"))
    return counted.withColumn("ratio", F.col("n") / F.sum("n").over(whole))


def psi_by_class(rows: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Baseline and target share of every class of either side, their difference and its part of PSI."""
    ratios = class_ratios(rows)
    side = lambda s, c: F.greatest(F.coalesce(F.max(F.when(F.col("side") == s, F.col("ratio"))), F.lit(0.0)), F.lit(floor)).alias(c)
    both = ratios.groupBy("comparison_id", "cls").agg(side(0, "b"), side(1, "t"))
    return both.select("comparison_id", "cls", F.round("b", 6).alias("baseline_ratio"), F.round("t", 6).alias("target_ratio"), F.round(F.col("t") - F.col("b"), 6).alias("delta"), ((F.col("t") - F.col("b")) * F.log(F.col("t") / F.col("b"))).alias("term"))


def psi(rows: DataFrame) -> DataFrame:
    return psi_by_class(rows).groupBy("comparison_id").agg(F.round(F.sum("term"), 6).alias("psi"))


def summary_drift(summaries: DataFrame) -> DataFrame:
    """Relative change of features that both sides have. Columns: comparison_id, feature, side, value."""
    keys = ["comparison_id", "feature"]
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    both = summaries.groupBy(*keys).agg(side(0).alias("baseline_mean"), side(1).alias("target_mean")).filter("baseline_mean is not null and target_mean is not null")
    drift = F.abs(F.col("target_mean") - F.col("baseline_mean")) / F.greatest(F.abs(F.col("baseline_mean")), F.lit(1e-9))
    status = F.when(F.col("drift") > 0.2, "DRIFTED").when(F.col("drift") > 0.08, "WATCH").otherwise("STABLE")
    out = both.withColumn("drift", drift)
    return out.select(*keys, F.round("baseline_mean", 4).alias("baseline_mean"), F.round("target_mean", 4).alias("target_mean"), F.round("drift", 6).alias("drift"), status.alias("status"))


def gini(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Gini coefficient of ``value``, moved to a least of zero, for each ``key``. Ranks are by counted values."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    low = rows.groupBy(F.col(key).alias("low_key")).agg(F.min(value).alias("low"))
    placed = prefix_sums(counted, [key], value, ["c"]).join(low, F.col(key).eqNullSafe(F.col("low_key")))
    x = F.col(value) - F.col("low")
    # equal values at ranks r + 1 to r + c: their ranks sum to c r + c (c + 1) / 2
    ranks = F.col("c") * F.col("c_before") + F.col("c") * (F.col("c") + 1) / 2
    per = placed.groupBy(key).agg(F.sum("c").alias("n"), F.sum(x * F.col("c")).alias("total"), F.sum(x * ranks).alias("weighted"))
    g = 2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return per.select(key, F.round(F.when(F.col("total") <= 1e-12, 0.0).otherwise(g), 6).alias("gini"))


def mad_outliers(rows: DataFrame, key: str, row_id: str, value: str, cut: float = 3.5) -> DataFrame:
    """Rows whose modified z, 0.6745 (x - median) / MAD, is beyond ``cut`` within their ``key``."""
    mid = quantiles(rows, [key], value, {"mid": 0.5}).select(F.col(key).alias("m_key"), "mid")
    away = rows.join(mid, F.col(key) == F.col("m_key")).select(key, row_id, value, (F.col(value) - F.col("mid")).alias("d"))
    mad = quantiles(away.withColumn("far", F.abs("d")), [key], "far", {"mad": 0.5}).select(F.col(key).alias("d_key"), "mad").filter("mad > 0")
    z = 0.6745 * F.col("d") / F.col("mad")
    return away.join(mad, F.col(key) == F.col("d_key")).withColumn("z", z).filter(F.abs("z") > cut).select(key, row_id, F.round("z", 6).alias("z"))


PAIR = ["comparison_id", "one", "two"]
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 512, 32_768, 8  # rows of a block, and how many blocks there are between the two
PRODUCTS = 1 << 21  # distances that a task holds at once
TILE_ROWS, TILE_COLUMNS = 128, 1_024  # of the products that a task makes at once
PILOT = 4_096  # rows of a group whose pairs say where the median is
ROUNDED = 1e-9  # of a distance, by which products may miss it
MOST_PARTS = 1_024  # partitions that pairs of blocks are dealt to
VALUED, LISTED = 1 << 14, 1 << 20  # pairs whose distance is made by itself at once, distances listed before they are counted
DOUBT = 3e-4  # standard deviations of the trials within which single precision doesn't settle which of two is greater
SHARED = 8  # most comparisons of the same rows that are summed together


def block_counts(vectors: DataFrame, block: int | None) -> DataFrame:
    """n_id, total rows and blocks of each comparison."""
    n_rows = vectors.groupBy(F.col("comparison_id").alias("n_id")).agg(F.count("*").alias("total"))
    per = lambda rows: F.ceil(F.col("total") / rows)
    blocks = per(block) if block else F.greatest(per(MOST_BLOCK), F.least(per(LEAST_BLOCK), F.lit(BLOCKS)))
    return n_rows.withColumn("blocks", blocks.cast("int"))


def block_pairs(vectors: DataFrame, block: int | None, *held: str) -> DataFrame:
    """Rows (comparison_id, id, side, v and ``held``) once for each pair of blocks that they are compared in.

    A pair is comparison_id, one and two; ``at`` is the row's own block, total the rows of the comparison.
    Without ``block`` there are up to BLOCKS blocks until they have MOST_BLOCK rows, so up to some BLOCKS * MOST_BLOCK rows a
    row is sent a bounded number of times, and beyond that once for every MOST_BLOCK rows.
    """
    counts = F.broadcast(block_counts(vectors, block))  # a row a comparison
    placed = vectors.join(counts, F.col("comparison_id") == F.col("n_id")).withColumn("at", F.pmod(F.xxhash64("id", "side"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("comparison_id", "id", "side", "v", "total", "at", F.least("at", "other").alias("one"), F.greatest("at", "other").alias("two"), *held)


def dealt(tasks: DataFrame, counts: DataFrame):
    """``tasks`` grouped by pair of blocks; pairs are dealt in turn to as many partitions as there are pairs, MOST_PARTS at most.

    ``counts``: those of ``block_counts``. All pairs ask for much the same time, so dealing by a hash would leave some tasks several.
    """
    pairs = counts.agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2)).first()[0]
    parts = int(min(MOST_PARTS, max(1, pairs or 1)))
    number = F.col("two").cast("long") * (F.col("two") + 1) / 2 + F.col("one")
    part = F.pmod(F.xxhash64("comparison_id") % parts + number.cast("long"), F.lit(parts)).cast("int")
    return tasks.withColumn("part", part).repartitionById(parts, "part").groupBy("part", *PAIR)


def centred(table: pa.Table) -> np.ndarray:
    """The vectors moved to medians of zero, which keeps distances and leaves products small."""
    x = matrix(table)
    mid = np.median(x, axis=0)
    return x - np.where(np.isfinite(mid), mid, 0)


def halves(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool, Iterator[tuple[slice, np.ndarray]]]:
    """The rows of both blocks, whether the blocks are one, and for slices of the left rows their squared distances to the right ones.

    Rows go by id and side, so that every pass over the same pair of blocks finds the same bits.
    """
    at, one, two = table.column("at").to_numpy(), table.column("one")[0].as_py(), table.column("two")[0].as_py()
    order = np.lexsort((table.column("side").to_numpy(), table.column("id").to_numpy()))
    left, right = order[at[order] == one], order[at[order] == two]
    x = centred(table)
    a, b = x[left], x[right]
    error = (x.shape[1] + 8) * np.finfo(float).eps

    def distances() -> Iterator[tuple[slice, np.ndarray]]:
        own, step = (b * b).sum(1)[None], max(1, PRODUCTS // max(1, len(b)))
        for lo in range(0, len(a), step):
            some = a[lo : lo + step]
            both = (some * some).sum(1)[:, None] + own
            d2 = both - 2 * some @ b.T
            d2[d2 <= error * both] = 0.0
            yield slice(lo, lo + len(some)), d2

    return left, right, one == two, distances()


def facing(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool, np.ndarray]:
    """The places of both blocks' rows, whether the blocks are one, and all vectors."""
    at, one, two = table.column("at").to_numpy(), table.column("one")[0].as_py(), table.column("two")[0].as_py()
    return np.flatnonzero(at == one), np.flatnonzero(at == two), one == two, centred(table)


def factors(x: np.ndarray, y: np.ndarray, by: float = 1.0, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product is ``by`` times the squared distances of x and y."""
    left = np.column_stack([x, (x * x).sum(1), np.ones(len(x))]) * by
    right = np.column_stack([-2 * y, np.ones(len(y)), (y * y).sum(1)])
    return left.astype(kind), np.ascontiguousarray(right.T.astype(kind))


def slices(n: int, step: int) -> list[slice]:
    return [slice(lo, min(lo + step, n)) for lo in range(0, n, step)]


def between(x: np.ndarray, y: np.ndarray, same: bool, lo: float, hi: float) -> tuple[int, np.ndarray, np.ndarray]:
    """How many pairs of x and y have a squared distance below ``lo``, and the distinct ones from ``lo`` to ``hi`` with their counts.

    Of one block (``same``) each pair counts once. Products in single precision, with a bound of their error, settle nearly
    all pairs, products in double precision most of the others; what is within the bound of lo and hi is computed by itself.
    """
    below, values, counts, fresh = 0, [np.zeros(0)], [np.zeros(0, np.int64)], 0
    norms = [np.sqrt((v * v).sum(1)) for v in (x, y)]
    reach = sum(float(v[np.isfinite(v)].max(initial=0.0)) for v in norms)
    precise = not 1e-15 < reach < 1e15  # too small or too large for single precision
    levels = []
    for kind in (np.float64,) if precise else (np.float32, np.float64):
        error = (x.shape[1] + 8) * float(np.finfo(kind).eps) * reach * reach + float(np.finfo(kind).tiny)
        first, last = np.nextafter(kind(lo - error), kind(-np.inf)), np.nextafter(kind(hi + error), kind(np.inf))
        levels.append((*factors(x, y, kind=kind), first, last))

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([((x[i[m]] - y[j[m]]) ** 2).sum(axis=1) for m in slices(len(i), VALUED)] or [np.zeros(0)])

    for columns in slices(len(y), TILE_COLUMNS):
        for rows in slices(len(x), TILE_ROWS):
            if same and columns.stop <= rows.start:
                continue
            for level, (left, right, first, last) in enumerate(levels):
                d2 = left[rows] @ right[:, columns]
                if same and columns.start < rows.stop:
                    d2[np.arange(columns.start, columns.stop) <= np.arange(rows.start, rows.stop)[:, None]] = np.inf
                low = d2 < first
                unsure = np.flatnonzero((d2 <= last) ^ low)
                if len(unsure) <= d2.size >> 5 or level + 1 == len(levels):
                    break
            below += int(np.count_nonzero(low))
            if not len(unsure):
                continue
            i, j = np.divmod(unsure, d2.shape[1])
            value = near(i + rows.start, j + columns.start)
            below += int(np.count_nonzero(value < lo))
            values.append(value[(value >= lo) & (value <= hi)])
            counts.append(np.ones(len(values[-1]), np.int64))
            fresh += len(values[-1])
            if fresh > LISTED:
                values, counts, fresh = *counted_values(values, counts), 0
    values, counts = counted_values(values, counts)
    return below, values[0], counts[0]


def counted_values(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    distinct, at = np.unique(np.concatenate(values), return_inverse=True)
    return [distinct], [np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)]


def counted_bins(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of integers and how often they occur, by a count of all places between least and greatest where these are few."""
    low, high = (int(bits.min()), int(bits.max())) if len(bits) else (0, 0)
    if high - low > max(1 << 16, len(bits)):
        return np.unique(bits, return_counts=True)
    n = np.bincount(bits - low)
    at = np.flatnonzero(n)
    return at + low, n[at]


def ranked(tasks: DataFrame, pilot: bool = False) -> DataFrame:
    """g_id, lo and hi: the two middle ones of the squared distances of all pairs in ``tasks`` of each comparison.

    Distances are counted by the leading bits of their floats, which are in order as integers; the bins
    that hold the two ranks are then counted by more bits, and once more by all. Each count is
    made in the tasks of block pairs and leaves them as one row a bin. With ``pilot``, where some pairs are not in ``tasks``,
    the ranks are so far from the middle as to hold the middle ones of all pairs, short of a rare chance.
    """
    state = tasks.groupBy(F.col("comparison_id").alias("s_id")).agg((F.max("two") > 0).alias("wide"))
    state = state.select("s_id", "wide", F.explode(F.array(F.lit(0), F.lit(1))).alias("which"), F.lit(-1).cast("long").alias("parent"), F.lit(None).cast("long").alias("rank"))

    def counter(shift: int, before: int | None):
        def counts(table: pa.Table) -> pa.Table:
            _, right, same, distances = halves(table)
            values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for rows, d2 in distances:
                bits = (d2[np.arange(len(right)) > np.arange(rows.start, rows.stop)[:, None]] if same else d2.ravel()).view(np.int64)
                if before is not None:
                    top = bits >> before
                    p0, p1 = (table.column(c)[0].as_py() for c in ("p0", "p1"))
                    bits = bits[(top == p0) | (top == p1)]
                value, n = counted_bins(bits >> shift)
                values.append(value)
                counts.append(n)
            value, at = np.unique(np.concatenate(values), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(counts), minlength=len(value)).astype(np.int64)
            parent = np.full(len(value), -1) if before is None else value >> (before - shift)
            return pa.table({"comparison_id": pa.array([table.column("comparison_id")[0].as_py()] * len(value), pa.int64()), "parent": pa.array(parent), "bin": pa.array(value), "c": pa.array(n)})

        return counts

    for shift, before in ((40, None), (20, 40), (0, 20)):
        bins = state.groupBy("s_id").agg(*[F.max(F.when(F.col("which") == w, F.col("parent"))).alias(f"p{w}") for w in (0, 1)])
        asked = tasks.join(bins, F.col("comparison_id") == F.col("s_id")).drop("s_id")
        counted = asked.groupBy(*PAIR).applyInArrow(counter(shift, before), "comparison_id long, parent long, bin long, c long").groupBy("comparison_id", F.col("parent").alias("b_parent"), "bin").agg(F.sum("c").alias("c"))
        upto = Window.partitionBy("comparison_id", "b_parent").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over the bins of one parent
        counted = materialise(counted.withColumn("lesser", F.coalesce(F.sum("c").over(upto), F.lit(0))).withColumn("pairs", F.sum("c").over(Window.partitionBy("comparison_id", "b_parent"))), "bins")
        met = counted.join(state, (F.col("comparison_id") == F.col("s_id")) & (F.col("b_parent") == F.col("parent")))
        middle = F.floor((F.col("pairs") - 1 + F.col("which")) / 2)
        apart = F.when(F.col("wide") & F.lit(pilot), F.ceil(3 * F.sqrt("pairs"))).otherwise(0) * (2 * F.col("which") - 1)
        met = met.withColumn("want", F.coalesce("rank", F.greatest(F.lit(0), F.least(F.col("pairs") - 1, middle + apart))))
        state = met.filter((F.col("lesser") <= F.col("want")) & (F.col("want") < F.col("lesser") + F.col("c"))).select("s_id", "wide", "which", F.col("bin").alias("parent"), (F.col("want") - F.col("lesser")).alias("rank"))
        state = materialise(state, "middles")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d2 = pa.array(batch.column("parent").to_numpy().view(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("s_id"), d2], names=["g_id", "d2"])

    middles = state.select("s_id", "parent").mapInArrow(distances, "g_id long, d2 double")
    return middles.groupBy("g_id").agg(F.min("d2").alias("lo"), F.max("d2").alias("hi"))


def scales(vectors: DataFrame, block: int | None = None) -> DataFrame:
    """g_id and gamma, 1 over the exact median squared distance of all pairs of a comparison.

    Rows are first dealt to groups of some PILOT rows; the pairs inside groups give two distances between which the
    median is. One pass over all pairs counts those below and lists those between, which are ranked. Should
    the median not be between them after all, all pairs are counted by their bits.
    """
    counts = vectors.groupBy(F.col("comparison_id").alias("n_id")).agg(F.count("*").alias("total"))
    groups = F.ceil(F.col("total") / PILOT).cast("int")
    placed = vectors.join(F.broadcast(counts), F.col("comparison_id") == F.col("n_id")).withColumn("at", F.pmod(F.xxhash64("side", "id", F.lit(1)), groups).cast("int"))
    bracket = materialise(ranked(placed.select("comparison_id", "id", "side", "v", "at", F.col("at").alias("one"), F.col("at").alias("two")), True), "bracket")
    middle = lambda: (1.0 / F.greatest((F.col("lo") + F.col("hi")) / 2, F.lit(1e-12))).alias("gamma")
    totals = materialise(counts.join(bracket, F.col("n_id") == F.col("g_id")), "totals")
    small, large = totals.filter(F.col("total") <= PILOT).select("g_id", middle()), totals.filter(F.col("total") > PILOT)
    large = large.withColumns({"lo": F.col("lo") - F.col("hi") * ROUNDED, "hi": F.col("hi") * (1 + ROUNDED)})
    if not large.take(1):
        return small

    def listed(table: pa.Table) -> pa.Table:
        left, right, same, x = facing(table)
        below, value, c = between(x[left], x[right], same, table.column("lo")[0].as_py(), table.column("hi")[0].as_py())
        name = table.column("comparison_id")[0].as_py()
        return pa.table({"comparison_id": pa.array([name] * (len(value) + 1), pa.int64()), "d2": pa.array([None, *value.tolist()], pa.float64()), "c": pa.array([below, *c.tolist()], pa.int64())})

    some = vectors.join(F.broadcast(large.select("g_id", "lo", "hi")), F.col("comparison_id") == F.col("g_id")).drop("g_id")
    tasks = block_pairs(some, block, "lo", "hi").select(*PAIR, "at", "v", "lo", "hi")
    found = materialise(dealt(tasks, block_counts(some, block)).applyInArrow(listed, "comparison_id long, d2 double, c long"), "listed")
    below = found.filter("d2 is null").groupBy(F.col("comparison_id").alias("b_id")).agg(F.sum("c").alias("below"))
    counted = found.filter("d2 is not null").groupBy("comparison_id", "d2").agg(F.sum("c").alias("c"))
    sizes = below.join(large.select("g_id", F.expr("total * (total - 1) div 2").alias("pairs")), F.col("b_id") == F.col("g_id")).drop("g_id")
    placed = prefix_sums(counted, ["comparison_id"], "d2", ["c"]).join(F.broadcast(sizes), F.col("comparison_id") == F.col("b_id"))

    def ranked_at(which: int):
        rank = F.floor((F.col("pairs") - 1 + which) / 2) - F.col("below")
        return F.max(F.when((F.col("c_before") <= rank) & (rank < F.col("c_before") + F.col("c")), F.col("d2")))

    exact = placed.groupBy(F.col("comparison_id").alias("g_id")).agg(ranked_at(0).alias("lo"), ranked_at(1).alias("hi")).filter("lo is not null and hi is not null")
    exact = materialise(exact.select("g_id", middle()), "exact")
    missed = large.select(F.col("g_id").alias("l_id")).join(exact, F.col("l_id") == F.col("g_id"), "left_anti")
    if missed.take(1):
        rest = vectors.join(F.broadcast(missed), F.col("comparison_id") == F.col("l_id"), "left_semi")
        exact = exact.union(materialise(ranked(block_pairs(rest, block)).select("g_id", middle()), "counted"))
    return small.union(exact)


def labelled(vectors: DataFrame, trials: int) -> DataFrame:
    """comparison_id, id, side, v and bits: whether the row is on side 0, truly and in each of ``trials``."""
    rows = vectors.select(F.col("comparison_id").cast("long").alias("comparison_id"), F.col("id").cast("long").alias("id"), F.col("side").cast("int").alias("side"), "v")
    none = rows.select(F.col("comparison_id").alias("c_id")).distinct().withColumn("cuts", F.array().cast("array<bigint>"))
    cuts = materialise(trial_cuts(rows, trials) if trials else none, "cuts")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, of, bits = batch.column("side").to_numpy(), batch.column("comparison_id").to_numpy(), np.empty(batch.num_rows, object)
            for name in np.unique(of):
                own = np.flatnonzero(of == name)
                cut = np.array(batch.column("cuts")[int(own[0])].as_py(), dtype=np.int64)
                drawn = np.column_stack([side[own] == 0, trial_order(batch.column("id").to_numpy()[own], side[own], trials) <= cut])
                bits[own] = [b.tobytes() for b in np.packbits(drawn, axis=1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("comparison_id", "id", "side", "v")], pa.array(bits, pa.binary())], names=["comparison_id", "id", "side", "v", "bits"])

    met = rows.join(F.broadcast(cuts), F.col("comparison_id") == F.col("c_id")).select("comparison_id", "id", "side", "v", "cuts")
    return met.mapInArrow(label, "comparison_id long, id long, side int, v array<double>, bits binary")


def pooled(rows: DataFrame) -> DataFrame:
    """``rows`` of ``labelled`` with ``of``, their comparisons (comparison_id, bits) in order; comparisons of the same ids and vectors have one row for each.

    comparison_id is that of the first of up to SHARED comparisons whose rows are the same, so that distances are made once for all of them.
    """
    exact = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    per = rows.groupBy(F.col("comparison_id").alias("p_id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), exact("id", "v").alias("one"), exact("v", "id", F.lit(1)).alias("two"))
    alike = Window.partitionBy("n", "ids", "one", "two")
    per = per.withColumn("shelf", F.floor((F.row_number().over(alike.orderBy("p_id")) - 1) / SHARED))
    together = Window.partitionBy("n", "ids", "one", "two", "shelf")
    per = materialise(per.withColumns({"pool": F.min("p_id").over(together), "members": F.count("*").over(together)}).filter("ids = n and members > 1").select("p_id", "pool"), "pools")
    own = F.struct("comparison_id", "bits")
    if not per.take(1):
        return rows.select("comparison_id", "id", "side", "v", F.array(own).alias("of"))
    met = rows.join(F.broadcast(per), F.col("comparison_id") == F.col("p_id"), "left")
    alone = met.filter("pool is null").select("comparison_id", "id", "side", "v", F.array(own).alias("of"))
    shared = met.filter("pool is not null").groupBy("pool", "id").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(own)).alias("of"))
    return alone.union(shared.select(F.col("pool").alias("comparison_id"), "id", F.lit(0).alias("side"), "v", "of"))


SUMS = "comparison_id long, trial int, xx double, yy double, xy double, nx double, all double, gamma double, id long, s double"


def kernel_sums(vectors: DataFrame, trials: int, block: int | None, rows: bool = False, scale: DataFrame | None = None, double: bool = False) -> DataFrame:
    """What every pair of blocks adds to a comparison's kernel sums under the true labels (trial 0) and ``trials`` random ones.

    xx, yy and xy are sums inside and between the sides, nx the rows of side 0, all those of both. With ``rows`` there is also a row
    (trial null) with s, its sum of kernel values to side 0, for each id of side 1. ``scale``: g_id and gamma, if they are known already.
    Of more than PILOT rows the random trials are summed in single precision, TILE_COLUMNS values at a time, unless ``double``;
    kernel values, the true labels' sums and the sums of tiles are in double precision in any case.
    """
    pool = materialise(pooled(labelled(vectors, trials)), "pool")
    scale = scales(pool.select("comparison_id", "id", "side", "v"), block) if scale is None else scale
    scaled = pool.join(F.broadcast(materialise(scale, "scale")), F.col("comparison_id") == F.col("g_id")).drop("g_id")
    tasks = block_pairs(scaled, block, "of", "gamma").drop("side")

    def sums(table: pa.Table) -> pa.Table:
        left, right, same, x = facing(table)
        of = table.column("of").combine_chunks()
        names, gamma, width = [c["comparison_id"] for c in of[0].as_py()], table.column("gamma")[0].as_py(), trials + 1
        bits = np.frombuffer(b"".join(of.flatten().field("bits").to_pylist()), np.uint8).reshape(len(x), len(names), -1)
        drawn = np.unpackbits(bits, axis=2, count=width).reshape(len(x), -1)
        a, b, true = drawn[left], drawn[right], np.arange(len(names)) * width
        one, two = factors(x[left], x[right], -gamma)
        kind = np.float64 if double or table.column("total")[0].as_py() <= PILOT else np.float32
        xx, ax, ka_sum = np.zeros((3, drawn.shape[1]))
        room, rough = np.empty(TILE_ROWS * TILE_COLUMNS), np.empty(TILE_ROWS * TILE_COLUMNS, np.float32)
        whole, to_left, to_right = np.zeros(drawn.shape[1]), np.zeros((len(left), len(names))), np.zeros((len(right), len(names)))
        for columns in slices(len(right), TILE_COLUMNS):
            of_right = np.column_stack([b[columns], np.ones(columns.stop - columns.start)]).astype(kind)
            true_right = of_right[:, [*true, -1]].astype(float)
            for at in slices(len(left), TILE_ROWS):
                shape = at.stop - at.start, columns.stop - columns.start
                k = np.matmul(one[at], two[:, columns], out=room[: shape[0] * shape[1]].reshape(shape))
                np.minimum(k, 0, out=k)
                np.exp(k, out=k)
                if same:
                    i = np.arange(max(at.start, columns.start), min(at.stop, columns.stop))
                    k[i - at.start, i - columns.start] = 0
                of_left = a[at].astype(float)
                if kind is np.float64:
                    ka = k @ of_right
                    ka, kx = ka[:, :-1], np.repeat(ka[:, -1:], len(xx), axis=1)
                else:
                    fine = rough[: shape[0] * shape[1]].reshape(shape)
                    np.copyto(fine, k, casting="same_kind")
                    ka, exact = (fine @ of_right).astype(float), k @ true_right
                    ka, kx = ka[:, :-1], np.repeat(ka[:, -1:], len(xx), axis=1)
                    ka[:, true], kx[:, true] = exact[:, :-1], exact[:, -1:]
                xx += np.einsum("ij,ij->j", of_left, ka)
                ax += np.einsum("ij,ij->j", of_left, kx)
                ka_sum += ka.sum(axis=0)
                whole += kx.sum(axis=0)
                if rows:
                    to_left[at] += ka[:, true]
                    if not same:
                        to_right[columns] += k.T @ of_left[:, true]
        yy, xy = whole - ax - ka_sum + xx, ax - xx + (0 if same else ka_sum - xx)
        xx, yy = (v * (1 if same else 2) for v in (xx, yy))
        size = a.sum(axis=0, dtype=np.int64).astype(float) if same else np.zeros(drawn.shape[1])
        none = lambda n, kind: pa.nulls(n, kind)
        out, n = [], len(xx)
        out.append([pa.array(np.repeat(names, width), pa.int64()), pa.array(np.tile(np.arange(width, dtype=np.int32), len(names))), *map(pa.array, (xx, yy, xy, size, np.full(n, float(len(left) if same else 0)), np.full(n, gamma))), none(n, pa.int64()), none(n, pa.float64())])
        ids = table.column("id").to_numpy() if rows else None
        for place, sent, to, lab in ((left, True, to_left, a), (right, not same, to_right, b)) if rows else ():
            for c, name in enumerate(names):
                far = np.flatnonzero(lab[:, true[c]] == 0) if sent else np.zeros(0, np.int64)
                n = len(far)
                out.append([pa.array(np.full(n, name), pa.int64()), none(n, pa.int32()), *[none(n, pa.float64()) for _ in range(6)], pa.array(ids[place[far]], pa.int64()), pa.array(to[far, c])])
        named = [f.split()[0] for f in SUMS.split(", ")]
        return pa.concat_tables([pa.table(dict(zip(named, columns, strict=True))) for columns in out])

    return dealt(tasks, block_counts(scaled, block)).applyInArrow(sums, SUMS)


def settled(vectors: DataFrame, trials: int, block: int | None, rows: bool = False) -> DataFrame:
    """``kernel_sums``, once more in double precision of the comparisons where a trial is too near to the true labels for single precision."""
    sums = materialise(kernel_sums(vectors, trials, block, rows), "sums")
    each = statistics(sums).filter(F.col("all") > PILOT)
    drawn = each.filter("trial > 0").groupBy(F.col("comparison_id").alias("d_id")).agg(F.stddev("mmd2").alias("spread"))
    true = each.filter("trial = 0").select(F.col("comparison_id").alias("t_id"), F.col("mmd2").alias("true"))
    met = each.filter("trial > 0").join(true, F.col("comparison_id") == F.col("t_id")).join(drawn, F.col("comparison_id") == F.col("d_id"))
    near = materialise(met.filter(F.abs(F.col("mmd2") - F.col("true")) <= DOUBT * F.col("spread")).select(F.col("comparison_id").alias("u_id")).distinct(), "unsure")
    if not near.take(1):
        return sums
    scale = sums.filter("gamma is not null").join(F.broadcast(near), F.col("comparison_id") == F.col("u_id")).groupBy(F.col("comparison_id").alias("g_id")).agg(F.first("gamma").alias("gamma"))
    again = kernel_sums(vectors.join(F.broadcast(near), F.col("comparison_id") == F.col("u_id"), "left_semi"), trials, block, rows, scale, True)
    return sums.join(F.broadcast(near), F.col("comparison_id") == F.col("u_id"), "left_anti").union(materialise(again, "sums"))


def trial_sums(sums: DataFrame) -> DataFrame:
    per = sums.filter("trial is not null").groupBy("comparison_id", "trial").agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy", "nx", "all")], F.first("gamma").alias("gamma"))
    return per.withColumn("ny", F.col("all") - F.col("nx"))


def deficits(sums: DataFrame) -> DataFrame:
    """comparison_id, id and deficit of ``displacements``, of ``kernel_sums`` with rows."""
    n = F.greatest(F.lit(1), F.col("nx") * (F.col("nx") - 1))
    reference = trial_sums(sums).filter("trial = 0").select(F.col("comparison_id").alias("r_id"), (F.col("xx") / n).alias("reference"), "nx")
    per = sums.filter("trial is null").groupBy("comparison_id", "id").agg(F.sum("s").alias("s"))
    met = per.join(F.broadcast(reference), F.col("comparison_id") == F.col("r_id"))
    return met.select("comparison_id", "id", F.greatest(F.lit(0.0), F.col("reference") - F.col("s") / F.col("nx")).alias("deficit"))


def displacements(vectors: DataFrame, block: int | None = None, scale: DataFrame | None = None) -> DataFrame:
    """comparison_id, id and deficit of every row of side 1: how far its mean kernel value to the baseline falls short of the baseline's own.

    ``scale``: g_id and gamma, if they are known already.
    """
    return deficits(materialise(kernel_sums(vectors, 0, block, True, scale), "affinities"))


def leading_share(vectors: DataFrame) -> DataFrame:
    """comparison_id and explained: the cosine, without sign, of the shift of the means and the leading component within sides.

    The Gram matrix of all rows, centred by their side, is summed in tasks; what is left is one matrix
    of the vectors' dimension for each comparison.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(float)
            which, side = batch.column("comparison_id").to_numpy(), batch.column("side").to_numpy()
            for key in set(zip(which.tolist(), side.tolist(), strict=True)):
                own = x[(which == key[0]) & (side == key[1])]
                flat = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
                total[key] = total[key] + flat if key in total else flat
        for (c, s), flat in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(flat), pa.int64()), pa.array([s] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int64()), pa.array(flat)], names=["comparison_id", "side", "at", "x"])

    def solve(table: pa.Table) -> pa.Table:
        side, at, x = table.column("side").to_numpy(), table.column("at").to_numpy(), table.column("x").to_numpy()
        both = [x[side == s][np.argsort(at[side == s])] for s in (0, 1)]
        explained = 0.0
        if all(map(len, both)):
            d = int(((4 * len(both[0]) - 3) ** 0.5 - 1) / 2)
            means = [b[1 : d + 1] / b[0] for b in both]
            gram = sum(b[d + 1 :].reshape(d, d) - b[0] * np.outer(m, m) for b, m in zip(both, means, strict=True))
            delta = means[1] - means[0]
            norm = np.linalg.norm(delta)
            if norm > 1e-9:
                explained = float(abs(delta / norm @ np.linalg.eigh(gram)[1][:, -1]))
        return pa.table({"comparison_id": pa.array([table.column("comparison_id")[0].as_py()], pa.int64()), "explained": pa.array([explained])})

    summed = vectors.select("comparison_id", "side", "v").mapInArrow(parts, "comparison_id long, side int, at long, x double").groupBy("comparison_id", "side", "at").agg(F.sum("x").alias("x"))
    return summed.groupBy("comparison_id").applyInArrow(solve, "comparison_id long, explained double")


def explained_by(vectors: DataFrame, whole: DataFrame, axes: list[int], block: int | None = None) -> DataFrame:
    """comparison_id and explained: the part of MMD squared (``whole`` of ``mmd2``) that goes when the named ``axes`` (from 0) are left out."""
    rest = vectors.withColumn("v", F.filter("v", lambda x, i: ~i.isin(axes)))
    left = mmd2(rest, 0, block).select(F.col("comparison_id").alias("l_id"), F.col("mmd2").alias("left"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.col("left")) / F.col("mmd2")))
    return whole.join(left, F.col("comparison_id") == F.col("l_id")).select("comparison_id", F.when(F.col("mmd2") > 1e-9, share).otherwise(0.0).alias("explained"))


def shift_metrics(vectors: DataFrame, psi_by: DataFrame, trials: int = 200, block: int | None = None, axes: list[int] | None = None) -> DataFrame:
    """The columns that ``attribution`` reads, of every comparison. ``psi_by``: comparison_id, psi."""
    sums = settled(vectors, trials, block, True)
    whole = materialise(relabelled(sums), "mmd")
    away = materialise(deficits(sums), "deficits")
    concentration = gini(away, "comparison_id", "deficit").withColumnRenamed("comparison_id", "c_id")
    mid = quantiles(away, ["comparison_id"], "deficit", {"mid": 0.5}).select(F.col("comparison_id").alias("m_id"), "mid")
    far = away.join(mid, F.col("comparison_id") == F.col("m_id")).select("comparison_id", (F.col("deficit") - F.col("mid")).alias("d"), F.abs(F.col("deficit") - F.col("mid")).alias("far"))
    mad = quantiles(far, ["comparison_id"], "far", {"mad": 0.5}).select(F.col("comparison_id").alias("d_id"), (F.col("mad") + 1e-9).alias("mad"))
    outliers = far.join(mad, F.col("comparison_id") == F.col("d_id")).groupBy(F.col("comparison_id").alias("o_id")).agg(F.count_if(0.6745 * F.col("d") / F.col("mad") > 3.5).alias("outliers"))
    explained = (leading_share(vectors) if axes is None else explained_by(vectors, whole, axes, block)).withColumnRenamed("comparison_id", "e_id")
    met = whole.join(concentration, F.col("comparison_id") == F.col("c_id")).join(outliers, F.col("comparison_id") == F.col("o_id")).join(explained, F.col("comparison_id") == F.col("e_id"))
    met = met.join(psi_by.select(F.col("comparison_id").alias("p_id"), "psi"), F.col("comparison_id") == F.col("p_id"), "left")
    return met.select("comparison_id", "mmd2", "p_value", "gini", "outliers", "explained", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def attribution(metrics: DataFrame) -> DataFrame:
    """Cause, its confidence, score and band of a shift. Columns: comparison_id, mmd2, p_value, gini, explained, psi."""
    x = F.sqrt(F.greatest(F.lit(0.0), F.col("mmd2")))
    raw = (
        F.when(x <= 0.05, x / 0.05 * 20).when(x <= 0.15, 20 + (x - 0.05) / 0.10 * 25).when(x <= 0.30, 45 + (x - 0.15) / 0.15 * 30).otherwise(F.least(F.lit(95.0), 75 + (x - 0.30) * 40))
    )
    weak = F.col("p_value") >= 0.05
    score = F.when(weak, F.least(raw, F.lit(15.0))).otherwise(raw) + F.least(F.lit(15.0), 20 * F.col("psi"))
    local, unlit = F.col("gini") > 0.45, F.col("explained") < 0.4
    cause = F.when(local & unlit, "SUSPICIOUS_MANIPULATION").when(~local & ~unlit, "ENVIRONMENTAL_DRIFT").otherwise("MIXED")
    sure = F.when(local & unlit, F.least(F.lit(0.9), 0.45 + 0.5 * F.col("gini"))).when(~local & ~unlit, F.least(F.lit(0.9), 0.5 + 0.4 * F.col("explained"))).otherwise(0.5)
    band = F.when(weak | (x <= 0.05), "LOW").when(x <= 0.15, "MEDIUM").otherwise("HIGH")
    return metrics.select("comparison_id", cause.alias("cause"), F.round(sure, 6).alias("confidence"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 4).alias("score"), band.alias("band"))


def trial_order(ids: np.ndarray, side: np.ndarray, trials: int) -> np.ndarray:
    """Rows by trials: a number for each, without ties in a trial, whose order is the trial's permutation."""
    z = (ids.astype(np.uint64) * np.uint64(2) + side.astype(np.uint64))[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, trials + 1, dtype=np.uint64)[None] * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(31)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(29)
    return (z ^ np.uint64(1 << 63)).view(np.int64)


TRIAL_BINS = 12  # bits


def trial_cuts(vectors: DataFrame, trials: int, rows: int = 2048) -> DataFrame:
    """c_id and cuts: for every trial of a comparison the n-th least number of ``trial_order`` among its rows, n being those of side 0.

    All trials are counted at once by the numbers' leading bits; only the numbers of the bin that holds the n-th,
    one of 2^TRIAL_BINS, are then ranked.
    """
    keyed = vectors.select("comparison_id", F.col("id").cast("long").alias("id"), F.col("side").cast("int").alias("side"))
    kinds = "comparison_id long, trial int, bin int, c long"
    ranked_kinds = "comparison_id long, trial int, number long"

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        of = batch.column("comparison_id").to_numpy()
        for name in np.unique(of):
            own = np.flatnonzero(of == name)
            for lo in range(0, len(own), rows):
                at = own[lo : lo + rows]
                yield name, at, trial_order(batch.column("id").to_numpy()[at], batch.column("side").to_numpy()[at], trials)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, _, z in groups(batch):
                code, c = np.unique((z >> (64 - TRIAL_BINS)) + (1 << TRIAL_BINS - 1) + (np.arange(trials) << TRIAL_BINS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), name)), pa.array((code >> TRIAL_BINS).astype(np.int32)), pa.array((code & (1 << TRIAL_BINS) - 1).astype(np.int32)), pa.array(c)], names=["comparison_id", "trial", "bin", "c"])

    bins = keyed.mapInArrow(counted, kinds).groupBy("comparison_id", "trial", "bin").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy("comparison_id", "trial").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over 2^TRIAL_BINS rows
    wanted = keyed.groupBy(F.col("comparison_id").alias("w_id")).agg(F.count_if(F.col("side") == 0).alias("want"))
    placed = bins.withColumn("lesser", F.coalesce(F.sum("c").over(upto), F.lit(0))).join(wanted, F.col("comparison_id") == F.col("w_id"))
    held = materialise(placed.filter((F.col("lesser") < F.col("want")) & (F.col("want") <= F.col("lesser") + F.col("c"))).select(F.col("comparison_id").alias("h_id"), "trial", "bin", (F.col("want") - F.col("lesser")).alias("rank")), "held")
    per = held.groupBy("h_id").agg(F.array_sort(F.collect_list(F.struct("trial", "bin")))["bin"].alias("bins"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, z in groups(batch):
                bin_of = np.array(batch.column("bins")[int(at[0])].as_py())
                row, trial = np.nonzero((z >> (64 - TRIAL_BINS)) + (1 << TRIAL_BINS - 1) == bin_of)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), name)), pa.array(trial.astype(np.int32)), pa.array(z[row, trial])], names=["comparison_id", "trial", "number"])

    numbers = keyed.join(per, F.col("comparison_id") == F.col("h_id")).select("comparison_id", "id", "side", "bins").mapInArrow(inside, ranked_kinds)
    place = F.row_number().over(Window.partitionBy("comparison_id", "trial").orderBy("number"))
    met = numbers.withColumn("place", place).join(held.select("h_id", F.col("trial").alias("h_trial"), "rank"), (F.col("comparison_id") == F.col("h_id")) & (F.col("trial") == F.col("h_trial"))).filter(F.col("place") == F.col("rank"))
    return met.groupBy(F.col("comparison_id").alias("c_id")).agg(F.array_sort(F.collect_list(F.struct("trial", "number")))["number"].alias("cuts"))


def mmd2(vectors: DataFrame, trials: int = 200, block: int | None = None) -> DataFrame:
    """comparison_id, n, m, gamma, mmd2 (unbiased, RBF) and p_value by relabelling.

    Columns: comparison_id, id, side, v (array of double). Rows go to blocks; every pair of blocks is a
    task that makes one kernel matrix, tile by tile, and, by matrix products, its sums under the true labels and all
    ``trials`` random ones, each of which puts the n rows of least hash of (trial, id, side) on side 0. Each block
    pair is one task's work; only sums leave it. The kernel scale is 1 over the median squared
    distance of all pairs.
    """
    return relabelled(settled(vectors, trials, block))


def statistics(sums: DataFrame) -> DataFrame:
    """mmd2 of every comparison and trial of ``kernel_sums``."""
    value = F.col("xx") / (F.col("nx") * (F.col("nx") - 1)) + F.col("yy") / (F.col("ny") * (F.col("ny") - 1)) - 2 * F.col("xy") / (F.col("nx") * F.col("ny"))
    return trial_sums(sums).filter("nx > 1 and ny > 1").select("comparison_id", "trial", "nx", "ny", "all", "gamma", value.alias("mmd2"))


def relabelled(sums: DataFrame) -> DataFrame:
    """The result of ``mmd2``, of ``kernel_sums``."""
    each = materialise(statistics(sums), "trials")
    true = each.filter("trial = 0").select(F.col("comparison_id").alias("t_id"), F.col("mmd2").alias("true"), "nx", "ny", "gamma")
    met = each.select("comparison_id", "trial", "mmd2").join(true.select("t_id", "true"), F.col("comparison_id") == F.col("t_id")).groupBy("comparison_id").agg((F.count_if((F.col("trial") > 0) & (F.col("mmd2") >= F.col("true"))) + 1).alias("above"), (F.count_if(F.col("trial") > 0) + 1).alias("of"))
    return met.join(true, F.col("comparison_id") == F.col("t_id")).select("comparison_id", F.col("nx").cast("long").alias("n"), F.col("ny").cast("long").alias("m"), "gamma", F.col("true").alias("mmd2"), (F.col("above") / F.col("of")).alias("p_value"))
