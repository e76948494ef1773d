"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one kept per group.

Equal vectors are first joined into one with a count. Centres are fitted on a bounded sample (the
``sample`` vectors that come first by hash); every vector is then assigned to its ``probes`` nearest
cells. Two vectors meet if they share a cell, and count once, in the first cell they share. A cell too
large for a task is cut into blocks; every pair of blocks is a task that multiplies two matrices and
returns each vector's links and the edges that hold linked vectors together, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators.graph import connected_components
from probity.storage import materialise

COSINE = 0.9
SAMPLE = 20_000  # vectors at most on which the centres are fitted
SAMPLE_BYTES = 128 << 20  # of doubles at most, likewise
MOST_CELLS = 4_096
PROBES = 4
FITTED_DIMS = 64  # lengths of vectors that get cells of their own, the commonest; others are compared whole, in blocks
BLOCK = 1_024  # vectors of a block
ROUNDS = 8


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``k`` unit centres of unit rows ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), dtype=np.int32)
    for lo in range(0, len(x), 2048):
        near = x[lo : lo + 2048] @ centres.T
        top = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.tile(np.arange(n), (len(near), 1))
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        out[lo : lo + 2048] = np.take_along_axis(top, order, axis=1)
    return out


def unit(table: pa.Table | pa.RecordBatch, column: str = "v") -> np.ndarray:
    """The vectors as unit rows in double precision."""
    lists = table.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of double) of the vectors that can link: not null, not zero, all components finite."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull()).filter(~bad & some)


def block_links(table: pa.Table, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each vector of a pair of blocks, and the edges that hold linked vectors together."""
    ids = table.column("id").to_numpy()
    copies = table.column("copies").to_numpy()
    side = table.column("block").to_numpy()
    one = table.column("one")[0].as_py()
    two = table.column("two")[0].as_py()
    cell = table.column("cell")[0].as_py()
    cells = np.stack(table.column("cells").to_numpy(zero_copy_only=False))
    x = unit(table)
    left, right = np.flatnonzero(side == one), np.flatnonzero(side == two)
    links = np.zeros(len(ids), dtype=np.int64)
    label = np.arange(len(ids))
    edges: list[tuple[int, int]] = []
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        keep = i < j if one == two else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        # the first cell, in i's order, that both are in
        shared = (cells[i][:, :, None] == cells[j][:, None, :]).any(axis=2)
        first = cells[i][np.arange(len(i)), shared.argmax(axis=1)] if len(i) else np.zeros(0, int)
        other = (cells[j][:, :, None] == cells[i][:, None, :]).any(axis=2)
        second = cells[j][np.arange(len(j)), other.argmax(axis=1)] if len(j) else first
        here = np.where(ids[i] < ids[j], first, second) == cell
        i, j = i[here], j[here]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if label[a] != label[b]:
                edges.append((int(ids[a]), int(ids[b])))
                label[label == label[b]] = label[a]
    return links, edges


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE, probes: int = PROBES, block: int = BLOCK, cells: int | None = None, fitted_dims: int = FITTED_DIMS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors of different lengths never link; those of the ``fitted_dims`` commonest lengths meet in cells,
    the others all with all of their length, in blocks. Null or zero vectors, and those that hold null or
    non-finite components, link with nothing: 0 links and their own id. Equal vectors link with each
    other. Rows that repeat an id are vectors of their own, each counted; they share the id in the
    result. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col)
    # one row for each distinct vector; -0.0 and 0.0 are one value
    good = good.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    name = F.sha2(F.array_join(F.transform("v", lambda c: c.cast("string")), ","), 256)
    named = materialise(good.withColumn("name", name), "vectors")
    distinct = named.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    distinct = materialise(distinct.withColumn("dim", F.size("v")), "distinct")
    n = distinct.count()
    k = cells or int(min(MOST_CELLS, max(1, round(n**0.5))))

    centres = {}
    for row in distinct.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(fitted_dims).collect():
        some = distinct.filter(F.col("dim") == row.dim).orderBy(F.xxhash64("name")).limit(max(1, min(sample, SAMPLE_BYTES // (8 * max(1, row.dim))))).select("v").toArrow()
        centres[row.dim] = spherical_kmeans(unit(some), min(k, some.num_rows))
    held = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                own = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                c = held.value.get(dim)
                at = nearest(unit(own), c, min(probes, len(c))) if c is not None else np.zeros((own.num_rows, 1), np.int32)
                at = np.pad(at, ((0, 0), (0, probes - at.shape[1])), constant_values=-1)
                fixed = pa.ListArray.from_arrays(pa.array(np.arange(own.num_rows + 1, dtype=np.int32) * probes), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("copies"), own.column("dim"), own.column("v"), fixed], names=["id", "copies", "dim", "v", "cells"])

    spread = materialise(distinct.select("id", "copies", "dim", "v").mapInArrow(assign, "id long, copies long, dim int, v array<double>, cells array<int>"), "cells")
    members = spread.withColumn("cell", F.explode("cells")).filter("cell >= 0")
    sizes = members.groupBy(F.col("dim").alias("s_dim"), F.col("cell").alias("s_cell")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, (F.col("dim") == F.col("s_dim")) & (F.col("cell") == F.col("s_cell"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = placed.withColumn("other", other).select("id", "copies", "dim", "v", "cells", "cell", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))

    def solve(table: pa.Table) -> pa.Table:
        links, edges = block_links(table, cosine)
        some = np.flatnonzero(links)
        ids = table.column("id").to_numpy()
        a, b = ([e[s] for e in edges] for s in (0, 1))
        return pa.table({"a": pa.array([*ids[some].tolist(), *a], pa.int64()), "b": pa.array([None] * len(some) + b, pa.int64()), "n": pa.array([*links[some].tolist(), *[0] * len(a)], pa.int64())})

    found = materialise(tasks.groupBy("dim", "cell", "one", "two").applyInArrow(solve, "a long, b long, n long"), "links")
    links = found.filter("b is null").groupBy(F.col("a").alias("l_id")).agg(F.sum("n").alias("far"))
    groups = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "g_id")
    known = distinct.select("name", F.col("id").alias("d_id"), "copies").join(links, F.col("d_id") == F.col("l_id"), "left").join(groups, F.col("d_id") == F.col("g_id"), "left")
    known = known.select(F.col("name").alias("k_name"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "d_id").alias("component_id"))
    linked = named.join(known, F.col("name") == F.col("k_name")).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    rest = lone(vectors, id_col, vector_col)
    return linked.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def lone(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The vectors that cannot link, as rows of the result."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists(v, lambda c: c != 0)
    alone = v.isNull() | ~F.coalesce(~bad & some, F.lit(False))
    return vectors.filter(alone).select(F.col(id_col).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
