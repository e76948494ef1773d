"""Running sums and exact quantiles by key, so that the values of one key are spread over tasks.

A key's values are cut at approximate quantiles into parts; sums run inside parts, and over the few
totals of a key's parts. How the cut falls changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.storage import materialise

PARTS, PART_ROWS = 64, 1_000_000  # least number of parts of a key, and rows of a part of the largest key there could be


def prefix_sums(counted: DataFrame, keys: list[str], order: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """``counted`` with c_before and c_all for each c of ``columns``: its sum over lesser ``order`` and over the key.

    ``counted`` has one row for each key and value of ``order``, a number that is not null; a null key is
    a key like others. An empty table gives none. ``parts`` is by default as many as the rows ask for.
    """
    counted = materialise(counted, "counted")
    parts = parts or max(PARTS, counted.count() // PART_ROWS)
    same = lambda prefix: [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]
    named = lambda prefix: [F.col(k).alias(f"{prefix}{k}") for k in keys]

    def all_of(conditions: list):
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c
        return out

    cuts = counted.groupBy(*named("q_")).agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], max(1_000, 16 * parts)).alias("cuts"))
    rows = counted.join(cuts, all_of(same("q_"))).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col(order)))).drop("cuts", *[f"q_{k}" for k in keys])
    totals = rows.groupBy(*named("t_"), F.col("part").alias("t_part")).agg(*[F.sum(c).alias(f"t_{c}") for c in columns])
    lesser = Window.partitionBy(*[f"t_{k}" for k in keys]).orderBy("t_part").rowsBetween(Window.unboundedPreceding, -1)  # over ``parts`` rows a key
    whole = Window.partitionBy(*[f"t_{k}" for k in keys])
    totals = totals.select("t_part", *[f"t_{k}" for k in keys], *[F.coalesce(F.sum(f"t_{c}").over(lesser), F.lit(0)).alias(f"{c}_start") for c in columns], *[F.sum(f"t_{c}").over(whole).alias(f"{c}_all") for c in columns])
    inside = Window.partitionBy(*keys, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    met = rows.join(totals, all_of([*same("t_"), F.col("part") == F.col("t_part")]))
    return met.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_start") for c in columns}).select(*counted.columns, *[f"{c}_before" for c in columns], *[f"{c}_all" for c in columns])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys``, n and a column for each of ``shares``: the exact quantile, linear between ranks. Null values are left out."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    placed = prefix_sums(counted, keys, value, ["c"])
    picks = []
    for name, share in shares.items():
        rank = (F.col("c_all") - 1) * F.lit(float(share))
        at = lambda r: (F.col("c_before") <= r) & (r < F.col("c_before") + F.col("c"))
        picks += [F.max(F.when(at(F.floor(rank)), F.col(value))).alias(f"{name}_lo"), F.max(F.when(at(F.ceil(rank)), F.col(value))).alias(f"{name}_hi")]
    per = placed.groupBy(*keys).agg(F.first("c_all").alias("n"), *picks)
    between = lambda name, share: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * ((F.col("n") - 1) * F.lit(float(share)) - F.floor((F.col("n") - 1) * F.lit(float(share))))
    return per.select(*keys, "n", *[between(name, share).alias(name) for name, share in shares.items()])
