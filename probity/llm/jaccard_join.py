"""n-gram Jaccard join by PartEnum signatures, exact.

Sets are banded by size so that two sets of similarity t or more lie in one band or in two that touch.
A tag covers a band and the one below; two sets of one band meet under that band's tag alone, so what only
sets of the band below share says nothing new, which the last bit of a signature tells. Two such sets differ in D elements at most, D known from their
sizes. A hash cuts the feature domain into parts, each cut again into sub-parts: with fewer than k + 1
differences allowed a part, D // (k + 1) + 1 + m parts leave at least m + 1 parts in which both sets
differ in at most k sub-parts, and then all other sub-parts of it hold the same elements in both. A
signature is the content of a subset of a part's sub-parts, all but k of them; every subset of every
part is enumerated. Tags of few differences take k = 1 of three sub-parts, wider ones k = 0 of one. Of
the parts, a set shows the first ones only, as many as its own size asks for.

Signatures of few elements are common by chance. A set leaves out those of fewer than c elements, c
being the largest number (of at most ``FULL``) for which that touches at most m of its parts. Of two
near sets take the one with the larger c: at least one of their m + 1 good parts keeps all signatures
in it, so the signature they share has c elements or more and both show it.

Every signature that several sets show has a leading set, the one of the least name, and makes the
others members of its ball. All sets with a signature in common are in one ball, so solving the balls
one by one, exactly and without listing their pairs, finds every link. A set has a sketch, its elements
counted by ``CELLS`` cells of a hash; two sketches bound what two sets can have in common, and a
member that the bound keeps from all others of its ball leaves it. A ball too large for a task is
solved in blocks, each with the leading set; what that leaves apart meets in pairs of blocks, but for
pairs of blocks inside the ball's largest group, which is one already.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.textbatch import BLANK_WORDS, U, hidden, mix64, parts, shingle_sets, sums_by
from probity.operators.graph import connected_components
from probity.storage import materialise

WORDS = 4
SIMILARITY = Fraction(85, 100)
SLACK = 0.12  # m as a share of the parts
FULL = 4  # elements that make a signature uncommon enough
FEW = 64  # differences, below which subsets of sub-parts are enumerated
FLUSH = 600_000  # signatures that a map task holds at once
FLUSH_SETS = 60_000
PART_SHINGLES = 1_000_000  # whose signatures meet in one task
BALL_SHINGLES = 1_000_000  # that one task compares
CELLS = 128  # of a sketch
SKETCHED = 4_096  # members at most of a ball whose sketches are compared; larger ones keep all
COUNTED = 1 << 19  # common elements counted at once


def bands(similarity: Fraction, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band."""
    low, first, last = 1, [], []
    while low <= most:
        high = int(low / similarity)
        first.append(low)
        last.append(high)
        low = high + 1
    return np.array(first), np.array(last)


def signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, similarity: Fraction = SIMILARITY, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Row and 63-bit signature of every signature of the sets; the last bit is 0."""
    row, sig = marked_signatures(rows, hashes, counts, similarity, slack)
    return row, sig >> U(1) << U(1)


def marked_signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, similarity: Fraction = SIMILARITY, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """``signatures`` with the last bit set where the tag is of the band above the set's."""
    first, last = bands(similarity, max(1, int(counts.max(initial=1))) * 2)
    apart = 1 - similarity
    num, den = apart.numerator, apart.denominator
    near = (num * counts) // (den - num)  # D with the set as the smaller one; 0: only the same set is near enough
    band = np.searchsorted(first, counts, "right") - 1
    found = []
    for step in (0, 1):
        tag = np.minimum(band + step, len(last) - 1)
        widest = (2 * num * last[tag]) // (2 * den - num)  # D of any two sets of the tag
        for k, n_sub in ((1, 3), (0, 1)):
            own = (near > 0) & ((widest < FEW) == (k > 0))
            inside = own[rows]
            at = np.cumsum(own) - 1
            row, sig = _enumerated(at[rows[inside]], hashes[inside], tag[own], np.minimum(near, widest)[own], widest[own], k, n_sub, slack)
            found.append((np.flatnonzero(own)[row], (sig >> U(1) << U(1)) | U(step)))
    return np.concatenate([row for row, _ in found]), np.concatenate([sig for _, sig in found])


def _enumerated(rows: np.ndarray, hashes: np.ndarray, tag: np.ndarray, d: np.ndarray, widest: np.ndarray, k: int, n_sub: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets under one tag each; ``k`` sub-parts of a part's ``n_sub`` may differ."""
    subsets = list(combinations(range(n_sub), n_sub - k))
    n_parts = widest // (k + 1) + 1
    spare = np.ceil(slack * n_parts).astype(np.int64) + 1
    n_parts, shown = n_parts + spare, d // (k + 1) + 1 + spare
    base = np.concatenate(([0], np.cumsum(shown)))
    place = mix64(hashes + (U(0x5851F42D4C957F2D) * (tag[rows].astype(U) + U(1))))
    part = (place % n_parts[rows].astype(U)).astype(np.int64)
    keep = part < shown[rows]
    where = base[rows] + part
    if n_sub > 1:
        where = where * n_sub + ((mix64(place) >> U(20)) % U(n_sub)).astype(np.int64)
    where, h = where[keep], mix64(hashes[keep] + U(1))
    size = base[-1] * n_sub
    n = np.bincount(where, minlength=size).reshape(-1, n_sub)
    # sums of 28 bits are exact in floats
    low = np.bincount(where, weights=(h & U(0xFFFFFFF)).astype(float), minlength=size).astype(U).reshape(-1, n_sub)
    high = np.bincount(where, weights=((h >> U(28)) & U(0xFFFFFFF)).astype(float), minlength=size).astype(U).reshape(-1, n_sub)
    row = np.repeat(np.arange(len(tag)), shown)
    order = (np.arange(base[-1]) - base[row]).astype(U) * U(len(subsets))
    held, sigs = [], []
    for j, own in enumerate(subsets):
        pick = list(own)
        count = n[:, pick].sum(axis=1)
        content = mix64(low[:, pick].sum(axis=1) + (high[:, pick].sum(axis=1) << U(32)) + count.astype(U))
        held.append(count)
        sigs.append(mix64(content + (order + U(j)) * U(0xD6E8FEB86659FD93) + tag[row].astype(U) * U(0xA0761D6478BD642F)))
    fewest = np.minimum.reduce(held)
    least = np.zeros(len(tag), dtype=np.int64)
    for c in range(1, FULL + 1):
        least[np.bincount(row[fewest < c], minlength=len(tag)) <= spare] = c
    full = [count >= least[row] for count in held]
    return np.concatenate([row[f] for f in full]), np.concatenate([s[f] for s, f in zip(sigs, full, strict=True)])


def set_names(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each row's set, equal for equal sets."""
    a = sums_by(rows, mix64(hashes + U(0x1234567)), n_rows)
    b = sums_by(rows, mix64(hashes ^ U(0x2545F4914F6CDD1D)), n_rows)
    return mix64(a).view(np.int64), mix64(b).view(np.int64)


def sketches(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each row's elements by cell; empty where a cell holds more than 16 bits count."""
    cell = (mix64(hashes + U(0x3C6EF372)) % U(CELLS)).astype(np.int64)
    n = np.bincount(rows * CELLS + cell, minlength=len(counts) * CELLS).reshape(-1, CELLS)
    whole = n.max(axis=1, initial=0) < 1 << 16
    return [x.tobytes() if w else b"" for x, w in zip(n.astype(np.uint16), whole.tolist(), strict=True)]


def described(docs: DataFrame, words: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, the set's two names and sketch and the columns of ``carried``, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in parts(batch):
                rows, hashes, counts = shingle_sets(buf, offs, words, BLANK_WORDS)
                a, b = set_names(rows, hashes, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(a), pa.array(b), pa.array(sketches(rows, hashes, counts), pa.binary()), *[part.column(c) for c in carried]], names=["doc_id", "n_shingles", "set_a", "set_b", "sketch", *carried])

    return docs.select("doc_id", "text", *carried).mapInArrow(run, ", ".join(["doc_id long, n_shingles long, set_a long, set_b long, sketch binary", *[f"{c} long" for c in carried]]))


def text_hash() -> Column:
    return F.xxhash64("text")


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of all columns of a row, its nulls included; rows equal in both are the same."""
    known = [F.col(f"`{c}`") for c in docs.columns]
    return tuple(F.xxhash64(F.lit(k), *known, *[x.isNull() for x in known]) for k in (1, 2))


def _stars(sig: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Distinct pairs (least node, other node) of the nodes that share a signature, unless all are of the band below its tag."""
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    value = sig >> U(1)
    head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    length = np.diff(np.append(head, len(sig)))
    lead = np.repeat(np.minimum.reduceat(node, head), length)
    other = (lead != node) & np.repeat(sig[head] & U(1) == 0, length)  # in order, so the first tells of all
    return np.unique(np.stack([lead[other], node[other]], axis=1), axis=0)


def _by_part(sig: np.ndarray, at: np.ndarray, names: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """Signatures, dealt by value: of each part the signatures, the sets that show them and their names."""
    part = ((sig >> U(1)) % U(n_parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, sig, at = part[order], sig[order], at[order]
    head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    blobs = []
    for i, j in zip(head, [*head[1:], len(part)], strict=True):
        own, place = np.unique(at[i:j], return_inverse=True)
        blobs.append((sig[i:j].tobytes(), place.astype(np.uint16).tobytes(), names[own].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(part[head]), *(pa.array(x, pa.binary()) for x in zip(*blobs, strict=True))], names=["part", "sigs", "places", "names"])


def candidate_stars(docs: DataFrame, words: int, similarity: Fraction, n_parts: int) -> DataFrame:
    """lead and node of every set that shares a signature with a set of a lesser name, the lead."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets that this task has shown; forgetting some would only show them again
        sigs: list[np.ndarray] = []
        places: list[np.ndarray] = []
        names: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part, buf, offs in parts(batch):
                rows, hashes, counts = shingle_sets(buf, offs, words, BLANK_WORDS)
                name, _ = set_names(rows, hashes, part.num_rows)
                new = np.zeros(part.num_rows, dtype=bool)
                for i, x in enumerate(name.tolist()):
                    if counts[i] and x not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > 200_000:
                    seen.clear()
                row, sig = marked_signatures(rows, hashes, np.where(new, counts, 0), similarity)
                sigs.append(sig)
                places.append(row + sum(map(len, names)))
                names.append(name)
                held += len(sig)
                if held >= FLUSH or sum(map(len, names)) >= FLUSH_SETS:
                    if held:
                        yield _by_part(np.concatenate(sigs), np.concatenate(places), np.concatenate(names), n_parts)
                    sigs, places, names, held = [], [], [], 0
        if held:
            yield _by_part(np.concatenate(sigs), np.concatenate(places), np.concatenate(names), n_parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        for batch in batches:
            for s, p, n in zip(*(batch.column(c) for c in ("sigs", "places", "names")), strict=True):
                sigs.append(np.frombuffer(s.as_buffer(), dtype=U).copy())
                nodes.append(np.frombuffer(n.as_buffer(), dtype=np.int64)[np.frombuffer(p.as_buffer(), dtype=np.uint16)])
        if sigs:
            pairs = _stars(np.concatenate(sigs), np.concatenate(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["lead", "node"])

    shown = docs.select("text").mapInArrow(show, "part int, sigs binary, places binary, names binary")
    return shown.repartition(n_parts, "part").mapInArrow(meet, "lead long, node long").distinct()


def linked_in(group: np.ndarray, sizes: np.ndarray, owner: np.ndarray, hashes: np.ndarray, label: np.ndarray, pivot: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: Fraction) -> list[tuple[int, int]]:
    """Spanning edges between sets of one ``group`` of similarity or more.

    ``label`` names what is one already. ``left`` sets are held against ``right`` ones by counting
    what they have in common, those apart whose label is their ``pivot``. That loses nothing if a
    group's left and right sets are the same or its right sets all have the label ``pivot``.
    """
    n, label = len(sizes), label.copy()
    num, den = similarity.numerator, similarity.denominator
    element = mix64(hashes + mix64(group[owner].astype(U) + U(1)))
    listed = right[owner]
    order = np.argsort(element[listed], kind="stable")
    value, holder = element[listed][order], owner[listed][order]
    head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    value, length = value[head], np.diff(np.append(head, len(holder)))
    near = np.minimum(np.searchsorted(value, element), max(0, len(value) - 1))
    met = (value[near] == element) & left[owner] if len(value) else np.zeros(len(element), bool)
    near, length = near, np.where(met, length[near], 0) if len(value) else np.zeros(len(element), np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    cost = np.concatenate(([0], np.cumsum(length)))
    cost = cost[ends[1:]] - cost[ends[:-1]]
    edges: list[tuple[int, int]] = []
    todo = np.flatnonzero(left)
    while len(todo):
        todo = todo[label[todo] != pivot[todo]]
        take = max(1, int(np.searchsorted(np.cumsum(cost[todo]), COUNTED, "right")))
        some, todo = todo[:take], todo[take:]
        at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in some.tolist()]) if len(some) else np.zeros(0, np.int64)
        run = length[at]
        where = np.repeat(head[near[at]], run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run) if len(head) else np.zeros(0, np.int64)
        key, both = np.unique(np.repeat(owner[at], run) * n + holder[where], return_counts=True)
        i, j = key // n, key % n
        fits = (label[i] != label[j]) & (both * den >= (sizes[i] + sizes[j] - both) * num)
        for a, b in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
            if label[a] != label[b]:
                edges.append((a, b))
                label[label == (label[a] if label[a] != pivot[a] else label[b])] = label[b] if label[a] != pivot[a] else label[a]
    return edges


def solved(table: pa.Table, similarity: Fraction) -> pa.Table:
    """Edges between linked sets of the groups (ball, one, two) in ``table``; of a pair of blocks, between the two."""
    name, label = table.column("m_a").to_numpy(), table.column("label").to_numpy()
    block, main = table.column("block").to_numpy(), table.column("main").to_numpy()
    keys = [table.column(c).to_numpy() for c in ("ball", "one", "two")]
    order = np.lexsort((name, *keys))
    same = np.concatenate(([False], np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in (name, *keys)])))
    order = order[~same]  # a set can be fetched twice
    name, label, block, main = (x[order] for x in (name, label, block, main))
    ball, one, two = (k[order] for k in keys)
    group = np.cumsum(np.concatenate(([False], (ball[1:] != ball[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
    data = table.column("data").combine_chunks().take(pa.array(order))
    own = [np.frombuffer(x.as_buffer(), dtype=U) for x in data]
    sizes = np.array([len(x) for x in own], dtype=np.int64)
    # labels by group: a set in two balls is two here
    _, label = np.unique(np.stack([group, label], axis=1), axis=0, return_inverse=True)
    label = label.reshape(-1)
    inner = one == two
    pivot = np.full(len(name), -1, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    leads = {int(group[i]): int(label[i]) for i in first} | {int(group[i]): int(label[i]) for i in np.flatnonzero(name == ball)}
    mains = {int(group[i]): int(label[i]) for i in np.flatnonzero(main & ~inner)}
    for i in range(len(name)):
        pivot[i] = leads[int(group[i])] if inner[i] else mains.get(int(group[i]), -1)
    found = linked_in(group, sizes, np.repeat(np.arange(len(own)), sizes), np.concatenate(own), label, pivot, inner | (block == one), inner | (block == two), similarity)
    return pa.table({"a": pa.array([int(name[i]) for i, _ in found], pa.int64()), "b": pa.array([int(name[j]) for _, j in found], pa.int64())})


def verified_edges(docs: DataFrame, placed: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """Edges between sets that are linked, enough to hold each group together.

    ``placed``: fetch_id, by_text, m_a, m_b of a set and bin, ball, one, two, block, label, main of a place
    where it is compared. A set is fetched by a doc_id of its own or, where it has none, by a hash of
    its text (``by_text``).
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that share id and text; solved drops those that other tasks fetch
        for batch in batches:
            for part, buf, offs in parts(batch):
                rows, hashes, counts = shingle_sets(buf, offs, words, BLANK_WORDS)
                a, b = set_names(rows, hashes, part.num_rows)
                ends = np.concatenate(([0], np.cumsum(counts)))
                fits = np.flatnonzero((a == np.asarray(part.column("m_a"))) & (b == np.asarray(part.column("m_b"))))
                fits = np.array([i for i in fits if (x := int(a[i])) not in seen and not seen.add(x)], dtype=np.int64)
                data = pa.array([hashes[ends[i] : ends[i + 1]].tobytes() for i in fits], pa.binary())
                kept = part.take(pa.array(fits))
                yield pa.RecordBatch.from_arrays([kept.column("m_a"), kept.column("places"), data], names=["m_a", "places", "data"])

    place = "bin long, ball long, one int, two int, block int, label long, main boolean"
    per_set = placed.groupBy("fetch_id", "by_text", "m_a", "m_b").agg(F.collect_list(F.struct(*[c.split(" ")[0] for c in place.split(", ")])).alias("places"))
    keyed = docs.select("text", F.coalesce("doc_id", text_hash()).alias("key"), F.col("doc_id").isNull().alias("no_id"))
    met = keyed.join(per_set.hint("merge"), (F.col("key") == F.col("fetch_id")) & (F.col("no_id") == F.col("by_text"))).select("text", "m_a", "m_b", "places")
    fetched = met.mapInArrow(sets, f"m_a long, places array<struct<{place.replace(' ', ':').replace(',:', ',')}>>, data binary")
    spread = fetched.select("m_a", "data", F.explode("places").alias("p")).select("m_a", "data", "p.*")
    return spread.groupBy("bin").applyInArrow(lambda table: solved(table, similarity), "a long, b long")


def near_by_sketch(ball: np.ndarray, sizes: np.ndarray, sketch: list[bytes], similarity: Fraction) -> np.ndarray:
    """Which rows the sketches let be near another row of their ball; rows of a ball stand together."""
    num, den = similarity.numerator, similarity.denominator
    cells = np.zeros((len(ball), CELLS), dtype=np.int32)
    known = np.array([len(x) > 0 for x in sketch], dtype=bool)
    if known.any():
        cells[known] = np.frombuffer(b"".join(sketch), dtype=np.uint16).reshape(-1, CELLS)
    alive = ~known
    head = np.flatnonzero(np.concatenate(([True], ball[1:] != ball[:-1])))
    ends = np.append(head[1:], len(ball))

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = np.minimum(np.minimum(cells[i], cells[j]).sum(axis=-1), np.minimum(sizes[i], sizes[j]))
        return (most * den >= (sizes[i] + sizes[j] - most) * num) | ~known[i] | ~known[j]

    two = head[ends - head == 2]
    both = near(two, two + 1)
    alive[two[both]] = alive[two[both] + 1] = True
    for lo, hi in zip(head[ends - head > 2].tolist(), ends[ends - head > 2].tolist(), strict=True):
        for i in range(lo, hi - 1):
            rest = np.arange(i + 1, hi)
            rest = rest[~alive[rest]] if alive[i] else rest
            met = rest[near(np.full(len(rest), i), rest)] if len(rest) else rest
            if len(met):
                alive[i] = alive[met] = True
    return alive


def thinned(members: DataFrame, similarity: Fraction) -> DataFrame:
    """``members`` without sketch, and without those that no other of their ball can be near to."""
    kept = [f for f in members.schema if f.name != "sketch"]
    sizes = members.groupBy(F.col("ball").alias("n_ball")).agg(F.count("*").alias("n_members"))
    sized = members.join(sizes, F.col("ball") == F.col("n_ball")).drop("n_ball")
    bins = int(max(1, members.count() // SKETCHED))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ball")
        alive = near_by_sketch(table.column("ball").to_numpy(), table.column("m_n").to_numpy(), table.column("sketch").to_pylist(), similarity)
        return table.select([f.name for f in kept]).filter(pa.array(alive))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    small = sized.filter(F.col("n_members") <= SKETCHED).drop("n_members").withColumn("bin", F.pmod(F.xxhash64("ball"), F.lit(bins)))
    return small.groupBy("bin").applyInArrow(run, schema).union(sized.filter(F.col("n_members") > SKETCHED).select([f.name for f in kept]))


def in_blocks(members: DataFrame, ball_shingles: int) -> DataFrame:
    """``placed`` of the members (ball, m_a, m_n, fetch_id, by_text, m_b), each block with the ball's leading set.

    Small balls share bins by hash; a ball of more than an eighth of ``ball_shingles`` has its own.
    """
    total = members.agg(F.coalesce(F.sum("m_n"), F.lit(0))).first()[0]
    bins = int(max(1, -(-total * 4 // ball_shingles)))
    volume = members.groupBy(F.col("ball").alias("v_ball")).agg(F.sum("m_n").alias("volume"))
    sized = members.join(volume, F.col("ball") == F.col("v_ball")).withColumn("blocks", F.ceil(F.col("volume") / ball_shingles).cast("int"))
    here = F.pmod(F.xxhash64("m_b"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = sized.withColumn("one", F.explode(F.when(F.col("m_a") == F.col("ball"), everywhere).otherwise(F.array(here))))
    alone = F.col("volume") * 8 > ball_shingles
    spread = spread.withColumn("bin", F.when(alone, F.xxhash64("ball", "one")).otherwise(F.pmod(F.xxhash64("ball"), F.lit(bins))))
    return spread.select("fetch_id", "by_text", "m_a", "m_b", "bin", "ball", "one", F.col("one").alias("two"), F.col("one").alias("block"), F.col("m_a").alias("label"), F.lit(False).alias("main"), "blocks")


def across_blocks(members: DataFrame, groups: DataFrame, ball_shingles: int) -> DataFrame:
    """``placed`` of the balls in several blocks whose sets are not one group yet.

    The ball's largest group, by volume, is cut into blocks of its own, numbered from the others' on;
    every pair of blocks is compared but for those of the largest group.
    """
    named = members.join(groups.select(F.col("node").alias("g_node"), F.col("component").alias("g_label")), F.col("m_a") == F.col("g_node"), "left")
    named = named.withColumn("label", F.coalesce("g_label", "m_a")).drop("g_node", "g_label")
    by_label = named.groupBy(F.col("ball").alias("l_ball"), F.col("label").alias("l_label")).agg(F.sum("m_n").alias("volume"))
    by_ball = by_label.groupBy("l_ball").agg(F.max(F.struct("volume", "l_label")).alias("top"), F.sum("volume").alias("all"), F.count("*").alias("labels"))
    blocks = lambda v: F.ceil(v * 2 / ball_shingles).cast("int")
    wanted = by_ball.filter((F.col("all") > ball_shingles) & (F.col("labels") > 1)).select("l_ball", F.col("top.l_label").alias("top"), blocks(F.col("top.volume")).alias("n_main"), blocks(F.col("all") - F.col("top.volume")).alias("n_rest"))
    met = named.join(wanted, F.col("ball") == F.col("l_ball")).withColumn("main", F.col("label") == F.col("top"))
    met = met.withColumn("block", F.when(F.col("main"), F.col("n_rest") + F.pmod(F.xxhash64("m_b"), F.col("n_main"))).otherwise(F.pmod(F.xxhash64("m_b"), F.col("n_rest"))).cast("int"))
    others = F.when(F.col("main"), F.sequence(F.lit(0), F.col("n_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_rest") + F.col("n_main") - 1))
    met = met.withColumn("other", F.explode(others)).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    return met.select("fetch_id", "by_text", "m_a", "m_b", F.xxhash64("ball", "one", "two").alias("bin"), "ball", "one", "two", "block", "label", "main")


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY, ball_shingles: int = BALL_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Sets hold the distinct ``words``-word shingles of a text; of a text of fewer words, the sequence
    of all. Texts that are null or without words have the empty set, no link and their own doc_id as
    component. Rows with the same set are linked; so rows that repeat a doc_id stand each for its own
    text and get the least doc_id that their set reaches. A null doc_id is a row like others and
    never the least unless all are null. Other columns are not read. An empty table gives no rows.
    """
    return grouped(docs.select("doc_id", "text"), words, similarity, ball_shingles).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY, ball_shingles: int = BALL_SHINGLES, carried: tuple[str, ...] = ()) -> DataFrame:
    """``jaccard_join`` with linked, which rows of one group alone share (null without words), and the columns of ``carried``."""
    hashed = docs.withColumn("text_key", F.when(F.col("doc_id").isNull(), text_hash()))
    own = materialise(described(hashed, words, ("text_key", *carried)), "sets")
    n_parts = int(max(1, (own.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]) // PART_SHINGLES))
    sets = own.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.min("text_key").alias("text_key"), F.first("sketch").alias("sketch"))
    stars = materialise(candidate_stars(docs, words, similarity, n_parts), "stars")
    balls = stars.select(F.col("lead").alias("ball"), "node").union(stars.select("lead", "lead").distinct())
    members = sets.join(balls, F.col("set_a") == F.col("node")).select("ball", F.coalesce("least", "text_key").alias("fetch_id"), F.col("least").isNull().alias("by_text"), F.col("set_a").alias("m_a"), F.col("set_b").alias("m_b"), F.col("n").alias("m_n"), "sketch")
    members = materialise(thinned(materialise(members, "candidates"), similarity), "members")
    placed = materialise(in_blocks(members, ball_shingles), "placed")
    edges = materialise(verified_edges(docs, placed.drop("blocks"), words, similarity), "edges")
    groups = connected_components(edges)
    if not placed.filter("blocks > 1").isEmpty():
        groups = connected_components(edges.union(verified_edges(docs, across_blocks(members, groups, ball_shingles), words, similarity)))
    # a group's least doc_id, of the sets in it
    reach = sets.select("set_a", "least").join(groups, F.col("set_a") == F.col("node"))
    low = reach.groupBy(F.col("component").alias("low_component")).agg(F.min("least").alias("low"))
    far = reach.join(low, F.col("component") == F.col("low_component")).select(F.col("set_a").alias("far_a"), "low", "component")
    near = sets.join(far, F.col("set_a") == F.col("far_a"), "left").select(F.col("set_a").alias("near_a"), F.col("set_b").alias("near_b"), F.least("least", "low").alias("component_id"), F.coalesce("component", "set_a").alias("linked"))
    out = own.join(near, (F.col("set_a") == F.col("near_a")) & (F.col("set_b") == F.col("near_b")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "linked", *carried)


def single(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group, that of the least doc_id (null last), and all rows without words.

    Other columns, whatever their names, come back as they were.
    """
    own = hidden(docs, "doc_id", "text")
    a, b = row_keys(own)
    keyed = own.withColumns({"row_a": a, "row_b": b})
    rows = grouped(keyed, words, similarity, carried=("row_a", "row_b"))
    first = rows.filter("linked is not null").groupBy("linked").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_a", "row_b")).alias("row"))
    first = first.select(F.col("row.row_a").alias("kept_a"), F.col("row.row_b").alias("kept_b"), F.lit(1).cast("long").alias("times"))
    empty = rows.filter("linked is null").groupBy(F.col("row_a").alias("kept_a"), F.col("row_b").alias("kept_b")).agg(F.count("*").alias("times"))
    met = keyed.dropDuplicates(["row_a", "row_b"]).join(first.union(empty).hint("merge"), (F.col("row_a") == F.col("kept_a")) & (F.col("row_b") == F.col("kept_b")))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(own.columns).toDF(*docs.columns)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op8_ngram_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM l),
s AS (SELECT doc_id, unnest(shingles) AS shingle FROM l),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT n.doc_id, n_shingles, m.component_id FROM n JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = n.doc_id"""
}
