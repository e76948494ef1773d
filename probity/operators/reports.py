"""Reports, redaction, replacement and saving of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.storage import materialise

BUCKET = "key_bucket"  # the column that partitions a saved table


def redacted(events: DataFrame, viewer: str, keep: list[str], hide: list[str], actor: str = "actor") -> DataFrame:
    """``keep`` of all rows, ``hide`` only of the viewer's own and the system's."""
    own = F.coalesce(F.col(actor).isin(viewer, "system"), F.lit(False))
    return events.select(*keep, *[F.when(own, F.col(c)).alias(c) for c in hide], (~own).alias("redacted"))


def records_of_models(records: DataFrame, analyses: DataFrame) -> DataFrame:
    """Records whose model_hash belongs to an analysed model."""
    models = analyses.filter(F.col("type") == "MODEL").select(F.col("model_hash").alias("m_hash")).distinct()
    return records.join(models, F.col("model_hash") == F.col("m_hash"), "left_semi")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def shared_features(values: DataFrame) -> DataFrame:
    """Features that both sides of a comparison have, each once; a key's rows are counted before they meet."""
    sides = values.groupBy("comparison_id", "feature").agg(*[F.count_if(F.col("side") == s).alias(f"n{s}") for s in (0, 1)])
    return sides.filter("n0 > 0 and n1 > 0").select("comparison_id", "feature")


def content_id(prefix: str, digest: Column, owner: Column) -> Column:
    """prefix, the first 16 hex digits in capitals, and the owner if there is one."""
    return F.concat_ws("-", F.lit(prefix), F.upper(F.substring(digest, 1, 16)), owner)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Evidence after a save: all rows of a ``key`` that is saved anew are the new ones, and saving twice changes nothing."""
    again = new.select(F.col(key).alias("saved_key")).distinct()
    return old.join(again, F.col(key).eqNullSafe(F.col("saved_key")), "left_anti").unionByName(new)


def save_by_key(new: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Save rows into a Parquet table so that all rows of a ``key`` in ``new`` are the new ones; other keys stay.

    The table is partitioned by a hash of the key. Only buckets that ``new`` touches are read and written, each as a whole,
    so saving the same rows again leaves the same rows, and a save that failed can be repeated. ``buckets`` has to be
    the same in every save. Columns of ``new`` are those of the table. One writer at a time.
    """
    spark = new.sparkSession
    placed = materialise(new.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "saved")
    touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]  # ``buckets`` at most
    if not touched:
        return
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    if table.getFileSystem(spark._jsc.hadoopConfiguration()).exists(table):
        old = spark.read.schema(placed.schema).parquet(path).filter(F.col(BUCKET).isin(touched))
        placed = materialise(replaced(old, placed, key), "merged")
    placed.repartition(min(buckets, len(touched)), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upserted(old: DataFrame, new: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Assets after a save: the new row of each ``key`` stands for the old, and a status that findings ask for is derived.

    A ``key`` with a critical finding (``findings``: key, severity) is quarantined, one with any other is
    assessed; the rest keep their own. Saving twice changes nothing.
    """
    worst = findings.groupBy(F.col(key).alias("w_key")).agg(F.bool_or(F.col("severity") == "CRITICAL").alias("critical"))
    rows = replaced(old, new, key).join(worst, F.col(key) == F.col("w_key"), "left")
    status = F.when(F.col("critical"), "QUARANTINED").when(F.col("w_key").isNotNull(), "ASSESSED").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(old.columns)


def purged(tables: dict[str, DataFrame], owner: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without demo rows (of ``owner`` only, if named), and how many rows of each go. Columns: is_demo, owner_id.

    Rows whose flag or owner is null stay.
    """
    goes = F.coalesce(F.col("is_demo"), F.lit(False))
    if owner is not None:
        goes = goes & F.coalesce(F.col("owner_id") == owner, F.lit(False))
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count_if(goes).alias("removed"), F.count_if(~goes).alias("kept")).select(F.lit(name).alias("table_name"), "removed", "kept")
        counts = one if counts is None else counts.union(one)
    return {name: df.filter(~goes) for name, df in tables.items()}, counts


def owner_report(decided: DataFrame) -> DataFrame:
    """By owner: assets of each decision, highest risk and the rules that fired. Columns: owner_id, decision, rules, risk."""
    rules = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("rules", ","), lambda x: x != ""))))), ",")
    counts = [F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("ACCEPT", "REVIEW", "QUARANTINE")]
    return decided.groupBy("owner_id").agg(F.count("*").alias("assets"), *counts, F.round(F.max("risk"), 4).alias("highest_risk"), rules.alias("fired"))
