"""Exact and near duplicates, their clusters and what follows from them.

Joins whose sides grow with the input are merge joins by hint: a side whose shuffle is small compresses
to a fraction of what its broadcast takes in the driver.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.operators.graph import connected_components
from probity.schemas import DEFAULT, Thresholds
from probity.storage import materialise

BINS, BIN_ROWS = 4_096, 65_536  # least number of groups of small keys, and rows of a group on average


def exact_groups(samples: DataFrame) -> DataFrame:
    """sha256, sample_count and first_id of content that occurs more than once. Columns: sample_id, sha256."""
    return samples.groupBy("sha256").agg(F.count("*").alias("sample_count"), F.min("sample_id").alias("first_id")).filter("sample_count > 1")


def redundant(samples: DataFrame) -> DataFrame:
    """Samples whose content an earlier sample has. The first of each content is joined back by equality."""
    first = samples.groupBy(F.col("sha256").alias("g_sha")).agg(F.min("sample_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return samples.join(first.hint("merge"), F.col("sha256") == F.col("g_sha")).filter(F.col("sample_id") > F.col("first_id")).drop("g_sha", "n")


def simhash64(rows: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """64-bit SimHash over distinct word shingles; texts of fewer words have none."""
    tokens = rows.select(key, F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), " ").alias("w")).filter(F.size("w") >= words)
    shingles = tokens.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.array_join(F.slice("w", i, words), " ")))).alias("s"))
    hashed = shingles.select(key, F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 16), 16, -10).cast("long").alias("h"))
    # a sum counts two bits, the upper one in its upper half
    votes = hashed.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("h", b).bitwiseAND((1 << 32) + 1)).alias(f"b{b}") for b in range(32)])
    bits = F.lit(0).cast("long")
    for b in range(64):
        count = F.shiftrightunsigned(f"b{b - 32}", 32) if b >= 32 else F.col(f"b{b}").bitwiseAND((1 << 32) - 1)
        bits = bits.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(key, bits.alias("fingerprint"))


def _pieces(x: Column, blocks: int) -> list[Column]:
    """The bits of ``x`` cut into ``blocks``."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [F.shiftrightunsigned(x, lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def blocks_for(n: int, radius: int) -> int:
    """Into how many blocks bits are cut so that a key of all but ``radius`` of them tells ``n`` fingerprints apart, by chance."""
    blocks = radius + 1
    while blocks < 2 * radius and 64 * (blocks - radius) // blocks < n.bit_length():
        blocks += 1
    return blocks


def keyed(one: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``one`` (id, fingerprint) once for each choice of ``blocks`` - ``radius`` blocks: ``choice`` and ``bits``.

    Two fingerprints within ``radius`` bits agree on at least that many blocks (pigeonhole), so they
    share a key.
    """
    bits = _pieces(F.col("fingerprint"), blocks)
    width = -(-64 // blocks)
    chosen = []
    for choice in combinations(range(blocks), blocks - radius):
        key = F.lit(0).cast("long")
        for k in choice:
            key = F.shiftleft(key, width).bitwiseOR(bits[k])
        chosen.append(key)
    return one.select("id", "fingerprint", F.posexplode(F.array(*chosen)).alias("choice", "bits"))


def near_pairs(prints: DataFrame, radius: int = DEFAULT.hamming, content: tuple[str, ...] = (), blocks: int | None = None) -> DataFrame:
    """Pairs of distinct fingerprints within ``radius`` bits. Columns: id, fingerprint.

    Fingerprints meet on keys of ``keyed``; the more there are, the more bits a key has. A pair counts
    once, under the first blocks that it agrees on. Equal fingerprints go as one, their least id. With
    columns of ``content`` only rows equal in these too go as one. ``near_links`` and ``near_clusters``
    put the rows that went as one back.
    """
    one = materialise(prints.groupBy("fingerprint", *content).agg(F.min("id").alias("id")).select("id", "fingerprint"), "fingerprints")
    blocks = blocks or blocks_for(one.count(), radius)
    rows = keyed(one, radius, blocks)
    a = rows.select(F.col("id").alias("a"), F.col("fingerprint").alias("fa"), "choice", "bits")
    b = rows.select(F.col("id").alias("b"), F.col("fingerprint").alias("fb"), F.col("choice").alias("choice_b"), F.col("bits").alias("bits_b"))
    distance = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    met = a.join(b.hint("merge"), (F.col("choice") == F.col("choice_b")) & (F.col("bits") == F.col("bits_b")) & (F.col("a") < F.col("b"))).withColumn("distance", distance).filter(F.col("distance") <= radius)
    same = F.array_compact(F.array(*[F.when(x == y, F.lit(k)) for k, (x, y) in enumerate(zip(_pieces(F.col("fa"), blocks), _pieces(F.col("fb"), blocks), strict=True))]))
    named = F.array(*[F.array(*map(F.lit, choice)) for choice in combinations(range(blocks), blocks - radius)])
    return met.filter(F.slice(same, 1, blocks - radius) == F.get(named, F.col("choice"))).select("a", "b", "distance")


def near_edges(prints: DataFrame, radius: int = DEFAULT.hamming, block: int = 8192) -> DataFrame:
    """Edges a, b that hold together what pairs of distinct fingerprints within ``radius`` bits hold together.

    Columns: id, fingerprint. The fingerprints under one key are compared in a task, in pairs of blocks
    where they are more than ``block``, and only edges that join what is apart leave it; so a group
    of near copies gives an edge a member, not its pairs.
    """
    one = materialise(prints.groupBy("fingerprint").agg(F.min("id").alias("id")).select("id", "fingerprint"), "fingerprints")
    count = one.count()
    blocks = blocks_for(count, radius)
    bins = max(BINS, count * comb(blocks, radius) // BIN_ROWS)
    rows = keyed(one, radius, blocks)
    sizes = rows.groupBy(F.col("choice").alias("s_choice"), F.col("bits").alias("s_bits")).agg(F.count("*").alias("n")).filter("n > 1")
    met = rows.join(sizes.hint("merge"), (F.col("choice") == F.col("s_choice")) & (F.col("bits") == F.col("s_bits"))).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = met.select("id", "fingerprint", "choice", "bits", "at", F.least("at", "other").alias("one"), F.greatest("at", "other").alias("two"), "blocks")
    few = F.pmod(F.xxhash64("choice", "bits"), F.lit(bins))  # small keys share a group
    tasks = tasks.withColumn("bin", F.when(F.col("blocks") == 1, few).otherwise(F.xxhash64("choice", "bits", "one", "two")))

    def solve(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("choice", "bits", "one", "two")]
        ids, prints, at = (table.column(c).to_numpy() for c in ("id", "fingerprint", "at"))
        order = np.lexsort((at, *columns))
        ids, prints, at = ids[order], prints[order].view(np.uint64), at[order]
        columns = [c[order] for c in columns]
        change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(ids) > 1 else np.zeros(0, bool)
        head = np.flatnonzero(np.concatenate(([True], change)))
        found: list[tuple[int, int]] = []
        for i, j in zip(head.tolist(), [*head[1:].tolist(), len(ids)], strict=True):
            own, x, side = ids[i:j], prints[i:j], at[i:j]
            inner = columns[2][i] == columns[3][i]
            label = np.arange(j - i)
            for k in range(j - i if inner else int((side == side[0]).sum())):
                far = label != label[k]
                if not inner:
                    far &= side != side[0]
                rest = np.flatnonzero(far)
                for r in rest[np.bitwise_count(x[rest] ^ x[k]) <= radius].tolist():
                    if label[r] != label[k]:
                        found.append((int(own[k]), int(own[r])))
                        label[label == label[r]] = label[k]
        a, b = ([x[k] for x in found] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tasks.groupBy("bin").applyInArrow(solve, "a long, b long").distinct()


def with_copies(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """``pairs``, and the closest pair of each copy's original with the copy (id, original) in its place."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    ends = [pairs.select(F.col(x).alias("node"), F.struct("distance", F.col(y).alias("other"), *[c for c in rest if c != "distance"]).alias("pair")) for x, y in (("a", "b"), ("b", "a"))]
    closest = ends[0].union(ends[1]).groupBy("node").agg(F.min("pair").alias("pair"))
    met = copies.join(closest.hint("merge"), F.col("original") == F.col("node"))
    return pairs.unionByName(met.select(F.least("id", "pair.other").alias("a"), F.greatest("id", "pair.other").alias("b"), *[F.col(f"pair.{c}").alias(c) for c in rest]))


def near_links(prints: DataFrame, radius: int = DEFAULT.hamming) -> DataFrame:
    """``near_pairs`` and as many more that every near copy has one. Columns: id, fingerprint, sha256.

    Rows of one fingerprint and unequal content are near copies too. They are linked by two stars: to the
    first row of the least content, and that content's own rows to a row of the greatest. Rows of one
    fingerprint and one content are exact copies; each takes the closest pair of its original. So no
    link joins equal content, links hang together as all pairs do, and no group's pairs are listed.
    """
    prints = materialise(prints, "prints")
    pairs = materialise(near_pairs(prints, radius), "pairs")
    ends = prints.groupBy(F.col("fingerprint").alias("g")).agg(F.min("id").alias("original"), F.min(F.struct("sha256", "id")).alias("low"), F.max(F.struct("sha256", (-F.col("id")).alias("minus"))).alias("high"))
    met = prints.join(ends.hint("merge"), F.col("fingerprint") == F.col("g"))
    varied = F.col("low.sha256") != F.col("high.sha256")
    hub = F.when(F.col("sha256") != F.col("low.sha256"), F.col("low.id")).when(F.col("id") != F.col("low.id"), -F.col("high.minus"))
    stars = met.filter(varied).withColumn("hub", hub).filter("hub is not null").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.lit(0).alias("distance"))
    copies = met.filter(~varied & (F.col("id") != F.col("original"))).select("id", "original")
    return with_copies(pairs, copies).unionByName(stars)


def near_clusters(prints: DataFrame, radius: int = DEFAULT.hamming) -> DataFrame:
    """sample_id, cluster and redundant of every near copy, exact copies of near copies among them.

    Columns: id, fingerprint, sha256. Components are sought over one row a fingerprint; its other rows
    are joined back by equality. A fingerprint near no other is a cluster if its contents differ.
    """
    prints = materialise(prints, "prints")
    near = clusters(near_edges(prints, radius)).select(F.col("sample_id").alias("node"), "cluster")
    groups = prints.groupBy(F.col("fingerprint").alias("g")).agg(F.min("id").alias("original"), (F.min("sha256") != F.max("sha256")).alias("varied"))
    groups = groups.join(near.hint("merge"), F.col("original") == F.col("node"), "left").filter("varied or node is not null").select("g", F.coalesce("cluster", "original").alias("cluster"))
    return prints.join(groups.hint("merge"), F.col("fingerprint") == F.col("g")).select(F.col("id").alias("sample_id"), "cluster", (F.col("id") != F.col("cluster")).alias("redundant"))


def near_vectors(rows: DataFrame, radius: int = DEFAULT.hamming, cosine: float = DEFAULT.cosine) -> DataFrame:
    """Confirmed pairs of distinct vectors, and one for each exact copy of a vector that has any.

    Columns: id, fingerprint, v. Vectors of one fingerprint are compared unless they are equal.
    """
    rows = materialise(rows, "vectors")
    pairs = materialise(confirmed_pairs(near_pairs(rows, radius, ("v",)), rows.select("id", "v"), cosine), "pairs")
    first = rows.groupBy(F.col("fingerprint").alias("g"), F.col("v").alias("g_v")).agg(F.min("id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    copies = rows.join(first.hint("merge"), (F.col("fingerprint") == F.col("g")) & (F.col("v") == F.col("g_v"))).filter("id <> original").select("id", "original")
    return with_copies(pairs, copies)


def confirmed_pairs(pairs: DataFrame, vectors: DataFrame, cosine: float = DEFAULT.cosine, dhash: int = DEFAULT.dhash) -> DataFrame:
    """Pairs whose vectors (id, v as array of double) have ``cosine`` or more.

    With a column ``dhash``, pairs of which one has no vector are kept within ``dhash`` bits of each other's
    difference hash, with one less the distance's share of 64 bits as similarity.
    """
    hashed = "dhash" in vectors.columns
    side = lambda k: vectors.select(F.col("id").alias(f"i{k}"), F.col("v").alias(f"v{k}"), *([F.col("dhash").alias(f"d{k}")] if hashed else []))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    met = pairs.join(side("a").hint("merge"), F.col("a") == F.col("ia")).join(side("b").hint("merge"), F.col("b") == F.col("ib"))
    angle = F.try_divide(dot(F.col("va"), F.col("vb")), F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb"))))
    similarity = F.when(angle >= cosine, angle)
    if hashed:
        bits = F.bit_count(F.col("da").bitwiseXOR(F.col("db")))
        similarity = F.coalesce(similarity, F.when((F.col("va").isNull() | F.col("vb").isNull()) & (bits <= dhash), 1 - F.col("distance") / 64))
    return met.select("a", "b", "distance", similarity.alias("similarity")).filter("similarity is not null")


def clusters(pairs: DataFrame) -> DataFrame:
    """sample_id, cluster (its least sample) and whether the sample is redundant."""
    return connected_components(pairs.select("a", "b")).select(F.col("node").alias("sample_id"), F.col("component").alias("cluster"), (F.col("node") != F.col("component")).alias("redundant"))


def all_clusters(samples: DataFrame, near: DataFrame) -> DataFrame:
    """``samples`` in a cluster of near or of exact copies, with cluster, its least sample.

    ``near`` is of ``near_clusters`` and holds all exact copies of what it holds, so an exact group lies
    in one of its clusters as a whole or in none.
    """
    groups = exact_groups(samples).select(F.col("sha256").alias("g"), "first_id")
    met = samples.join(near.select(F.col("sample_id").alias("n_id"), F.col("cluster").alias("n_cluster")).hint("merge"), F.col("sample_id") == F.col("n_id"), "left")
    met = met.join(groups.hint("merge"), F.col("sha256") == F.col("g"), "left").withColumn("cluster", F.coalesce("n_cluster", "first_id"))
    return met.filter("cluster is not null").drop("n_id", "n_cluster", "g", "first_id")


def flooding(clustered: DataFrame, samples: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """By contributor: samples, near copies charged to it, share, and whether it floods."""
    copies = clustered.filter("redundant").select(F.col("sample_id").alias("c_id"))
    met = samples.join(copies.hint("merge"), F.col("sample_id") == F.col("c_id"), "left")
    per = met.groupBy("contributor").agg(F.count("*").alias("n"), F.count("c_id").alias("near"))
    share = F.col("near") / F.col("n")
    return per.select("contributor", "n", "near", F.round(share, 6).alias("share"), (share >= t.flood_ratio).alias("floods"))


SPLIT = r"(?i)(?:^|/)(train|training|test|val|valid|validation|dev|eval|holdout)(?:/|$)"
ALIASES = {"training": "train", "valid": "val", "validation": "val", "dev": "val", "eval": "test", "holdout": "test"}


def split_of(path: Column) -> Column:
    """The split that a path names, aliases resolved; empty if none."""
    named = F.lower(F.regexp_extract(path, SPLIT, 1))
    out = named
    for alias, split in ALIASES.items():
        out = F.when(named == alias, split).otherwise(out)
    return out


def leaks(members: DataFrame) -> DataFrame:
    """Clusters that lie in more than one split. Columns: cluster, path."""
    named = members.withColumn("split", split_of(F.col("path"))).filter("split <> ''")
    per = named.groupBy("cluster").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n_splits"))
    return per.filter("n_splits > 1")


def contaminated_items(docs: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """Evaluation items found in documents: shared distinct ``words``-word shingles of each pair.

    Shingles meet by two 64-bit hashes of different seeds, as 128 bits; a pair counts from one shared shingle on,
    so every shared one is joined. Rows that repeat an id add up. Other columns are not read.
    """

    def shingled(rows: DataFrame, key: str) -> DataFrame:
        w = rows.select(key, F.split(F.lower(F.coalesce("text", F.lit(""))), " ").alias("w")).filter(F.size("w") >= words)
        # made distinct as texts: of structs array_distinct compares every two
        each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.array_join(F.slice("w", i, words), " ")))
        return w.select(key, F.explode(each).alias("x")).select(key, F.xxhash64("x").alias("s"), F.xxhash64(F.lit(1), "x").alias("t"))

    own = shingled(items, "item_id").withColumnsRenamed({"s": "item_s", "t": "item_t"})
    met = shingled(docs, "doc_id").join(own, (F.col("s") == F.col("item_s")) & (F.col("t") == F.col("item_t")))
    return met.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def fingerprint_statistics(samples: DataFrame) -> DataFrame:
    """One row: samples, distinct contents and contributors, and distinct hashes of those of phash and dhash that there are."""
    hashes = [F.count_distinct(c).alias(f"distinct_{c}") for c in ("phash", "dhash") if c in samples.columns]
    return samples.agg(F.count("*").alias("n"), F.count_distinct("sha256").alias("distinct_content"), F.count_distinct("contributor").alias("contributors"), *hashes)


SKETCH_BITS = 14  # of HLL buckets: a relative standard error of 1.04 / 2^7, some 0.8 %


def hash_sketches(samples: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys``, n and an HLL sketch of each of ``columns``; sketches of any grouping can be merged to coarser ones."""
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), *[F.hll_sketch_agg(c, SKETCH_BITS).alias(c) for c in columns])


def sketched_counts(sketches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys``, n and the estimated number of distinct values of each of ``columns``, from sketches of finer groups."""
    merged = sketches.groupBy(*keys) if keys else sketches.groupBy()
    return merged.agg(F.sum("n").alias("n"), *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"distinct_{c}") for c in columns])


def redundant_union(exact: DataFrame, near: DataFrame) -> DataFrame:
    """Both kinds of redundant samples; one that is both counts twice, as ``kind`` shows."""
    return exact.select("sample_id", F.lit("exact").alias("kind")).unionByName(near.select("sample_id", F.lit("near").alias("kind")))
