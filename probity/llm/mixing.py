"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, its documents laid end to end, are packed into blocks of ``block`` words.
A source with N blocks gets n slots, n being its target over its size times N. Slot j stands for
epoch ``j div N`` and for the block to which the source's pseudorandom permutation of [0, N) for that
epoch maps ``j mod N``; blocks and slots meet by block index. The mix has one number of output shards.
Each slot draws its shard evenly, by a seeded hash of source and slot (``drawn_shard``), so that the counts of a source
over the shards are one multinomial draw, and each shard's counts over the sources are one by target
weight. A source's total is held at n, which keeps it at its target and every block at no more than
``ceil(n / N)`` draws; the shards' totals vary as the draws do.

Permutation: swap-or-not. A round with key K pairs x with (K - x) mod N and, by a bit of a hash of
the larger of the two, takes one or the other. This is a bijection for any N, without tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.jaccard_join import row_keys
from probity.llm.textbatch import hidden
from probity.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST = 2  # times a source's own size
BLOCK = 32  # words
SLOTS_PER_SHARD = 65_536
BUCKETS = 256  # parts at least in which a source's running word count is made
BUCKET_ROWS = 65_536  # of all sources, on average
PIECE_BLOCKS = 50_000  # of a task that cuts documents into pieces
ROUNDS = 6
PRIME = 2_147_483_647
ROW = ("row_a", "row_b", "copy")  # tell rows apart in mixed_texts


def sized(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, source, ``keys`` and size, the number of words (null: 0), of every row."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", *keys, words.cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: source, src (its place by code point, null last), source_size, weight, target.

    Targets share ``share`` of all words by weight; none passes ``most`` times its source's size, and
    the excess is shared anew. With sources in order of cap over weight those at their cap come first,
    and the level of the others is the largest of the levels found after 0, 1, 2, ... caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("source_size") * most / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", F.row_number().over(by_name).cast("long"))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int")).cast("long"))
    src = (
        src.withColumn("capped", F.coalesce(F.sum(F.col("source_size") * most).over(by_cap), F.lit(0)))
        .withColumn("lighter", F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("heft", F.sum("weight").over(everything))
        .withColumn("level", F.max((F.col("total") * F.lit(float(share)) - F.col("capped")) / (F.col("heft") - F.col("lighter"))).over(everything))
    )
    target = F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.col("level"))
    return src.select("source", "src", "source_size", "weight", target.alias("target"))


def slot_counts(targets: DataFrame, block: int = BLOCK, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """``targets`` with n_blocks, n_slots and n_shards, the shards of the whole mix."""
    n = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * n + 0.5)).otherwise(0)
    shards = F.greatest(F.lit(1), F.ceil(F.sum("n_slots").over(Window.partitionBy()) / slots_per_shard)).cast("long")
    return targets.withColumn("n_blocks", n).withColumn("n_slots", slots.cast("long")).withColumn("n_shards", shards)


def laid_out(sizes: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Every row of ``sizes`` with src, n_blocks, n_slots, n_shards and start, its first word's place in its source.

    A source's documents go in order of (bucket, doc_id, size), then of their row keys if they have any. Running sums are made inside buckets
    and over the buckets' totals, so that no source is ordered in one task.
    """
    known = sizes.join(sources.select(F.col("source").alias("name"), "src", "n_blocks", "n_slots", "n_shards"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    known = known.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(-1)) % PRIME * 7919 % PRIME, F.lit(buckets)))
    inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "size", *[c for c in ROW if c in sizes.columns]).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("b_src").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = known.groupBy(F.col("src").alias("b_src"), F.col("bucket").alias("b_bucket")).agg(F.sum("size").alias("b_size"))
    totals = totals.select("b_src", "b_bucket", F.coalesce(F.sum("b_size").over(before), F.lit(0)).alias("b_start"))
    rows = known.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(totals, (F.col("src") == F.col("b_src")) & (F.col("bucket") == F.col("b_bucket"))).withColumn("start", F.col("start") + F.col("b_start")).drop("b_src", "b_bucket", "b_start", "bucket")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each document and block that share words: src, n_blocks, n_slots, start, idx, overlap."""
    last = ((F.col("start") + F.col("size") - 1) / block).cast("long")
    cut = rows.filter(F.col("size") > 0).withColumn("idx", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    held = F.least(F.col("start") + F.col("size"), (F.col("idx") + 1) * block) - F.greatest(F.col("start"), F.col("idx") * block)
    return cut.withColumn("overlap", held)


def _round(x: Column, k: Column) -> Column:
    """x after round k; key and n_blocks are columns. One expression in place of a chain of columns,
    over which the optimizer's search for constraints grows fast."""
    key, n = F.col("key"), F.col("n_blocks")
    pair = ((key * (k + 16_807) + k * 69_621) % PRIME % n + n - x) % n
    h = (F.greatest(x, pair) % PRIME * (key % 65_537 + 48_271 + k * 2) + key + k * 40_692) % PRIME
    return F.when(F.floor((h * h + key) % PRIME / 65_536) % 2 == 1, pair).otherwise(x)


def permuted(slots: DataFrame, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """``slots`` (src, epoch, x, n_blocks) with x taken through its source's permutation for that epoch."""
    keyed = slots.withColumn("key", (F.col("src") * 1_000_003 + F.col("epoch") * 7_368_787 + F.lit(seed)) % PRIME)
    steps = F.array(*[F.lit(k).cast("long") for k in range(1, rounds + 1)])
    return keyed.withColumn("x", F.aggregate(steps, F.col("x"), _round)).drop("key")


def drawn_shard(seed: int) -> Column:
    """The shard of a slot, from 0 on, by two squarings modulo a prime. Columns: src, slot, n_shards."""
    src, slot = F.col("src"), F.col("slot")
    place = (slot % PRIME * 48_271 + F.floor(slot / PRIME) * 69_997 + src * 69_621 + F.lit(seed)) % PRIME
    mixed = (place * place + slot % PRIME + 12_345) % PRIME
    return ((mixed * mixed + place) % PRIME % F.col("n_shards")).cast("long")


def draws(cut: DataFrame, most: int = MOST, seed: int = 20_261, block: int = BLOCK) -> DataFrame:
    """One row a slot: src, slot, epoch, idx (the block drawn), shard.

    Slots are made from the blocks, each at the one document that holds its first word, so that a
    source's slots are as spread as its documents. What joins slots or pieces says merge: Spark guesses their size by
    that of the rows that they are cut from, and would send them through the driver.
    """
    first = cut.filter(F.col("start") <= F.col("idx") * block).select("src", "n_blocks", "n_slots", "n_shards", F.col("idx").alias("x"))
    slots = first.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(most)]))).withColumn("slot", F.col("x") + F.col("epoch") * F.col("n_blocks"))
    slots = permuted(slots.filter(F.col("slot") < F.col("n_slots")), seed)
    return slots.select("src", "slot", "epoch", F.col("x").alias("idx"), drawn_shard(seed).alias("shard"))


def planned(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, slots_per_shard: int = SLOTS_PER_SHARD):
    """The laid-out rows, their pieces and the sources' table; sizes, targets and rows are written once."""
    sizes = materialise(sizes, "sizes")
    sources = materialise(slot_counts(source_targets(sizes, weights, share, most), block, slots_per_shard), "sources")
    rows = materialise(laid_out(sizes, sources, max(BUCKETS, sizes.count() // BUCKET_ROWS)), "rows")
    blocks = sources.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    spread = rows.repartition(int(max(1, -(-blocks // PIECE_BLOCKS))), "src", "start")
    return rows, pieces(spread, block), sources


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard of every row.

    first_shard is the output shard of the first slot that draws the row's first drawn block, null if none is drawn.

    Null and empty texts have size 0 and give nothing. Null sources form one source, the last by
    order. Rows that repeat a doc_id are laid out and counted each on its own. An empty table gives an
    empty result. Other columns are not read.
    """
    rows, cut, sources = planned(sized(docs), weights, share, most, block, slots_per_shard)
    drawn = draws(cut, most, block=block).groupBy(F.col("src").alias("d_src"), F.col("idx").alias("d_idx")).agg(F.count("*").alias("times"), F.min_by("shard", "slot").alias("shard"))
    met = cut.select("src", "start", "idx", "overlap").join(drawn.hint("merge"), (F.col("src") == F.col("d_src")) & (F.col("idx") == F.col("d_idx")))
    taken = met.groupBy(F.col("src").alias("t_src"), F.col("start").alias("t_start")).agg(F.sum(F.col("times") * F.col("overlap")).alias("taken"), F.min_by("shard", "idx").alias("first_shard"))
    named = sources.select(F.col("src").alias("s_src"), "source_size", "target")
    # a document without words can start where another starts
    out = rows.join(taken.hint("merge"), (F.col("src") == F.col("t_src")) & (F.col("start") == F.col("t_start")) & (F.col("size") > 0), "left")
    return out.join(named, F.col("src") == F.col("s_src")).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed_texts(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, slots_per_shard: int = SLOTS_PER_SHARD, split: bool = False) -> DataFrame:
    """The mix as rows with the columns of ``docs`` and shard: one for each document and epoch that draws from it.

    A document drawn whole keeps its text; of one drawn in part, the words drawn are joined by single
    blanks in their order. A row goes to the shard of its first drawn block, so that documents stay
    whole; with ``split`` there is a row for each shard too, which holds exactly the blocks that the shard
    drew. Documents without words are kept once, as they are, in shard 0. Every row is laid out and drawn
    on its own, also where rows repeat a doc_id, have none, or are the same. Other columns, whatever their names,
    come back as they were, but for n_chars, which counts the text anew, and one named shard, which is replaced.
    """
    named = docs.drop("shard")
    docs = hidden(named, "doc_id", "text", "source", "n_chars")
    a, b = row_keys(docs)
    keyed = docs.withColumns({"row_a": a, "row_b": b})
    # rows that are the same are laid out as copies, and their text is joined back once
    same = sized(keyed, "row_a", "row_b").groupBy("row_a", "row_b").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count("*").alias("times"))
    one = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
    rows, cut, _ = planned(one, weights, share, most, block, slots_per_shard)
    drawn = draws(cut, most, block=block).select(F.col("src").alias("d_src"), F.col("idx").alias("d_idx"), "epoch", "shard")
    met = cut.select(*ROW, "size", "src", "start", "idx", "overlap").join(drawn.hint("merge"), (F.col("src") == F.col("d_src")) & (F.col("idx") == F.col("d_idx")))
    at = F.greatest(F.lit(0), F.col("idx") * block - F.col("start"))
    name = [F.col(c).alias(f"m_{c}") for c in ROW]
    keys = [*name, "epoch", *([F.col("shard").alias("part")] if split else [])]
    cuts = F.sort_array(F.collect_list(F.struct(at.cast("int").alias("at"), F.col("overlap").cast("int").alias("n"), "shard")))
    by_doc = met.groupBy(*keys).agg(F.max("size").alias("m_size"), F.sum("overlap").alias("m_taken"), cuts.alias("cuts")).drop("part")
    empty = rows.filter(F.col("size") == 0).select(*name, F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("m_size"), F.lit(0).cast("long").alias("m_taken"), F.array().cast("array<struct<at:int,n:int,shard:bigint>>").alias("cuts"))
    met = by_doc.unionByName(empty)
    out = keyed.dropDuplicates(["row_a", "row_b"]).join(met.hint("merge"), (F.col("row_a") == F.col("m_row_a")) & (F.col("row_b") == F.col("m_row_b")))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    some = F.array_join(F.flatten(F.transform("cuts", lambda c: F.slice(F.col("words"), c["at"] + 1, c["n"]))), " ")
    out = out.withColumn("whole", F.col("m_taken") == F.col("m_size")).withColumn("words", F.when(~F.col("whole"), words))
    text = F.when(F.col("whole"), F.col("text")).otherwise(some)
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    shard = F.coalesce(F.get("cuts", F.lit(0))["shard"], F.lit(0)).cast("long").alias("shard")
    return out.select(*docs.columns, shard).toDF(*named.columns, "shard")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    steps = f"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM s0),
s2 AS (SELECT *, CASE (src - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM s1),
s3 AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS lighter,
  sum(source_size) OVER () AS total, sum(weight) OVER () AS heft FROM s2
  WINDOW before AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, max((CAST(total AS DOUBLE) * CAST({SHARE} AS DOUBLE) - CAST(capped AS DOUBLE)) / CAST(heft - lighter AS DOUBLE)) OVER () AS level FROM s3),
s5 AS (SELECT source, src, source_size, least(CAST(2 * source_size AS DOUBLE), weight * level) AS target,
  CAST(ceil(source_size / {float(BLOCK)}) AS BIGINT) AS n_blocks FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * n_blocks + CAST(0.5 AS DOUBLE)) AS BIGINT) ELSE 0 END AS n_slots FROM s5),
s7 AS (SELECT *, greatest(1, CAST(ceil(CAST(sum(n_slots) OVER () AS DOUBLE) / {SLOTS_PER_SHARD}) AS BIGINT)) AS n_shards FROM s6),
r AS (SELECT doc_id, size, s7.*, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY ((doc_id % {PRIME} * 7919 % {PRIME}) % buckets + buckets) % buckets, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sizes JOIN s7 ON sizes.source IS NOT DISTINCT FROM s7.source
  CROSS JOIN (SELECT greatest({BUCKETS}, count(*) // {BUCKET_ROWS}) AS buckets FROM documents)),
p AS (SELECT *, least(start + size, (idx + 1) * {BLOCK}) - greatest(start, idx * {BLOCK}) AS overlap
  FROM (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS idx FROM r WHERE size > 0)),
x0 AS (SELECT src, n_blocks, n_shards, idx + epoch * n_blocks AS slot, idx AS x, (src * 1000003 + epoch * 7368787 + 20261) % {PRIME} AS key
  FROM p, (SELECT unnest([0, 1]) AS epoch) WHERE start <= idx * {BLOCK} AND idx + epoch * n_blocks < n_slots)"""
    for k in range(1, ROUNDS + 1):
        steps += f""",
y{k} AS (SELECT *, ((key * {16807 + k} + {69621 * k}) % {PRIME} % n_blocks + n_blocks - x) % n_blocks AS pair FROM x{k - 1}),
z{k} AS (SELECT *, (greatest(x, pair) % {PRIME} * (key % 65537 + {48271 + 2 * k}) + key + {40692 * k}) % {PRIME} AS h FROM y{k}),
x{k} AS (SELECT src, n_blocks, n_shards, slot, key, CASE WHEN (h * h + key) % {PRIME} // 65536 % 2 = 1 THEN pair ELSE x END AS x FROM z{k})"""
    return (
        steps
        + f""",
g AS (SELECT *, (slot % {PRIME} * 48271 + slot // {PRIME} * 69997 + src * 69621 + 20261) % {PRIME} AS place FROM x{ROUNDS}),
m AS (SELECT *, (place * place + slot % {PRIME} + 12345) % {PRIME} AS mixed FROM g),
d AS (SELECT src, x, count(*) AS times, arg_min((mixed * mixed + place) % {PRIME} % n_shards, slot) AS shard FROM m GROUP BY src, x),
t AS (SELECT p.src, start, CAST(sum(times * overlap) AS BIGINT) AS taken, arg_min(shard, idx) AS first_shard FROM p JOIN d ON p.src = d.src AND p.idx = d.x GROUP BY p.src, start)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard FROM r LEFT JOIN t ON r.src = t.src AND r.start = t.start AND size > 0"""
    )


ORACLE = {"op6_mixing": _oracle()}
